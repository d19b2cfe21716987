"""Benchmark decontamination by template canonicalisation.

Words become a template: numbers, names and units after numbers are typed placeholders, other words stand for
themselves in lower case. Windows of template words are joined by hash, so a question whose numbers or names were
changed still meets its original. A run of joined windows counts if its slots are consistent: equal values of the
benchmark stand against equal values of the document, and different against different ones.

Whether the capital of a sentence's first word is that of a name can't be told, and a quotation may move the word or
change its case. So a window has up to three templates: first words as themselves, capitalised first words as names
too, and all words as themselves. Any template of a benchmark window may meet any of a document's.

A name may have more words than the one that replaced it, which moves all words after it. So a text has a second
reading, in which names of several words count as one; windows of it meet, and form runs, apart from the others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lantern.llm import _words as W
from lantern.llm._storage import light, materialise

WINDOW = 8
#: A run must have so many words, or all but one of a shorter item.
LEAST_RUN = 13
#: Items of fewer words are common phrases: they are one window, and only their exact words are matched.
LEAST_ITEM = 5
#: Benchmark windows that are broadcast to the join at most; beyond it both sides are shuffled.
BROADCAST_WINDOWS = 200_000
FILTER_BITS = 1 << 22

# Words that count as a unit after a number.
UNITS = (
    "mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg gram grams kilogram kilograms oz ounce ounces lb lbs pound pounds ton tons tonne tonnes "
    "ml cl l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hour hours day days week weeks month months year years "
    "dollar dollars euro euros cent cents percent degree degrees mph kph hz khz mhz ghz kb mb gb tb w kw kwh v a j kj cal kcal"
).split()

_SCHEMA = "id long, copy long, reading int, size int, hash long, pos int, length int, first int, last int, plain boolean, offsets array<int>, slots array<string>"
_NUMBER, _NAME, _UNIT = W.mix(np.array([1, 2, 3], W.U))
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_INSIDE = _DIGIT.copy()
_INSIDE[65:91] = _INSIDE[97:123] = _INSIDE[128:] = True
#: Whether a code point is a capital (or title) letter of any script.
_CAPITAL = np.array([c.isupper() or c.istitle() for c in map(chr, range(0x1F000))])
_POINT = np.zeros(256, bool)
_POINT[[44, 46]] = True
_STOP = np.zeros(256, bool)
_STOP[[10, 33, 34, 40, 46, 58, 59, 63]] = True


def _first_points(raw: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Code points of the characters that begin at ``start`` in UTF-8."""
    a, b, c, d = (raw[np.minimum(start + i, len(raw) - 1)].astype(np.int64) for i in range(4))
    two, three = (a & 31) << 6 | b & 63, (a & 15) << 12 | (b & 63) << 6 | c & 63
    four = (a & 7) << 18 | (b & 63) << 12 | (c & 63) << 6 | d & 63
    return np.select([a < 0x80, a < 0xE0, a < 0xF0], [a, two, three], four)


def _unit_hashes() -> np.ndarray:
    chunk = next(W.word_chunks([" ".join(UNITS).encode()], lower=False))
    return np.sort(chunk.hash)


def templates(texts: list[bytes]) -> Iterator[tuple[int, W.Chunk, list[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray]]:
    """(reading, chunk, templates, first words, words after the last): of each template the hashes and placeholders.

    A name is a word that begins with a capital of any script. The first reading has the text's words; in its first
    template names don't begin a sentence, in the second they may, and the third has no placeholders. In the second
    reading capitalised words with one space between them are one name; it has one template.
    """
    units = _unit_hashes()
    for docs in W.chunked(texts):
        raw, base = W.layout(texts, docs)
        digit = _DIGIT[raw]
        inside = _INSIDE[raw]
        inside[1:-1] |= _POINT[raw[1:-1]] & digit[:-2] & digit[2:]
        start, end = W.edges(inside)
        c = W.assemble(docs, raw, W.LOWER[raw], base, start, end)
        every = np.arange(len(start))
        if not len(start):
            yield 0, c, [(c.hash, np.zeros(0, bool))] * 3, every, every
            continue
        stops = np.concatenate([[0], np.cumsum(_STOP[raw])])
        same_text = c.doc[1:] == c.doc[:-1]
        begins = np.ones(len(start), bool)
        begins[1:] = (stops[start[1:]] > stops[end[:-1]]) | ~same_text
        number = digit[start]
        capital = _CAPITAL[np.minimum(_first_points(raw, start), len(_CAPITAL) - 1)]
        after = np.zeros(len(start), bool)
        after[1:] = number[:-1] & same_text
        unit = after & ~number & (units[np.minimum(np.searchsorted(units, c.hash), len(units) - 1)] == c.hash)
        kinds = []
        for name in (capital & ~begins & ~number, capital & ~number):
            kinds.append((np.where(number, _NUMBER, np.where(unit, _UNIT, np.where(name, _NAME, c.hash))), number | unit | name))
        yield 0, c, [*kinds, (c.hash, np.zeros(len(start), bool))], every, every + 1
        name &= ~unit
        follows = np.zeros(len(start), bool)
        follows[1:] = name[1:] & name[:-1] & same_text & (start[1:] == end[:-1] + 1) & (raw[end[:-1]] == 32)
        kept = np.flatnonzero(~follows)
        last = np.append(kept[1:], len(start))
        doc = c.doc[kept]
        merged = W.Chunk(docs, raw, c.data, base, start[kept], end[last - 1], np.searchsorted(doc, np.arange(len(docs) + 1)), doc, c.hash[kept])
        yield 1, merged, [tuple(x[kept] for x in kinds[1])], kept, last


def _windows(sizes: list[int], known):
    """(id, text, reading, words, hash, position, length, words covered, first template, slots) of windows.

    With ``known``, only of those that may be known. Templates that are equal in a window count once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.pieces(batches, 2):
            ids, copies = (np.asarray(batch.column(i), np.int64) for i in (0, 1))
            for reading, c, kinds, begin, after in templates(W.as_bytes(batch.column(2))):
                counts = c.counts()
                text_first = begin[np.minimum(c.first[:-1], len(begin) - 1)] if len(begin) else begin
                text = None
                for k in sizes:
                    first = None
                    for hashes, slot in kinds if k >= LEAST_ITEM else kinds[2:]:
                        c.hash = hashes
                        at, h = c.grams(k)
                        plain = first is None
                        if plain:
                            first = h
                        if known is None:
                            kept = (k == WINDOW) | (counts[c.doc[at]] == k)  # a short item is one window
                        else:
                            table = known.value
                            place = h >> W.U(64 - FILTER_BITS.bit_length() + 1)
                            kept = table[place.astype(np.int64)]
                        if not plain:
                            kept = kept & (h != first)
                        at, h = at[kept], h[kept]
                        if not len(at):
                            continue
                        text = text or c.data.tobytes()
                        offsets = [[j for j in range(k) if slot[i + j]] for i in at.tolist()]
                        slots = [[text[c.start[i + j] : c.end[i + j]].decode() for j in own] for i, own in zip(at.tolist(), offsets)]
                        doc = c.doc[at]
                        row = np.asarray(c.docs)[doc]
                        n = len(at)
                        integers = [np.full(n, reading), counts[doc], h.view(np.int64), at - c.first[doc], np.full(n, k), begin[at] - text_first[doc], after[at + k - 1] - text_first[doc]]
                        kinds_of = [pa.int32(), pa.int32(), pa.int64(), *[pa.int32()] * 4]
                        columns = [pa.array(ids[row]), pa.array(copies[row]), *[pa.array(x, t) for x, t in zip(integers, kinds_of)], pa.array(np.full(n, plain))]
                        columns += [pa.array(offsets, pa.list_(pa.int32())), pa.array(slots, pa.list_(pa.string()))]
                        yield pa.RecordBatch.from_arrays(columns, names=["id", "copy", "reading", "size", "hash", "pos", "length", "first", "last", "plain", "offsets", "slots"])

    return run


def _runs(windows: list[dict]) -> Iterator[tuple[int, int, dict[int, tuple[str, str]]]]:
    """(first word, words, slots) of the runs of windows at consecutive words, by the words of the item.

    The slots are (item's value, document's value) by the item's word.
    """
    start, last, length, pairs = 0, None, 0, {}
    for w in sorted(windows, key=lambda w: w["pos"]):
        if last is not None and w["pos"] > last + 1:
            yield start, last - start + length, pairs
            last = None
        if last is None:
            start, pairs = w["pos"], {}
        last, length = w["pos"], w["length"]
        pairs.update((last + i, x) for i, x in zip(w["offsets"], zip(w["slots"], w["values"])))
    if last is not None:
        yield start, last - start + length, pairs


def _consistent(pairs: set[tuple[str, str]]) -> bool:
    return len({a for a, _ in pairs}) == len({b for _, b in pairs}) == len(pairs)


def _parts(start: int, n: int, slots: dict[int, tuple[str, str]]) -> Iterator[tuple[int, int, set[tuple[str, str]]]]:
    """(first word, words, slots) of a run, or if it has clashing slots, of what is left without a few words at its edges.

    Parts that leave off LEAST_ITEM words or more don't count: values that clash in the middle are no renaming.
    """
    for cut in range(LEAST_ITEM):
        parts = [(start + lead, n - cut, {x for i, x in slots.items() if start + lead <= i < start + lead + n - cut}) for lead in range(cut + 1)]
        kept = [x for x in parts if _consistent(x[2])]
        if kept:
            yield from kept
            return


def _found(size: int, windows: list[dict]) -> Iterator[tuple[int, int, bool]]:
    """(words, first word, exact) of the runs that count.

    Runs of windows with equal values always do; those of the first template, and of all, if their slots are consistent.
    """
    least = size if size < LEAST_ITEM else min(LEAST_RUN, max(size - 1, LEAST_ITEM))
    for start, n, _ in _runs([w for w in windows if w["slots"] == w["values"]]):
        if n >= least:
            yield n, start, True
    for chosen in ([w for w in windows if w["plain"]], windows):
        for start, n, slots in _runs(chosen):
            for first, words, pairs in _parts(start, n, slots):
                # A changed run that is mostly slots is a list of values, not a passage.
                if words >= least and 2 * len(pairs) <= words:
                    yield words, first, all(a == b for a, b in pairs)


def _place(known: dict[int, int], pos: int, step: int) -> int:
    """Where a word of the item stands in the document: as far from the next known one as in the item."""
    at = pos
    while at not in known:
        at += step
    return known[at] + pos - at


def _longest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, item, n_words, start, exact): the longest run of each line of windows."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 2000):
            rows = []
            for r in batch.slice(lo, 2000).to_pylist():
                first = {w["pos"]: w["first"] for w in r["windows"]}
                last = {w["pos"] + w["length"]: w["last"] for w in r["windows"]}
                own = [(_place(last, start + n, 1) - _place(first, start, -1), _place(first, start, -1), exact) for n, start, exact in _found(r["size"], r["windows"])]
                best = min(((-n, start, not exact) for n, start, exact in own), default=None)
                if best:
                    rows.append((r["doc"], r["item"], -best[0], best[1], not best[2]))
            columns = zip(*rows) if rows else [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds)], names=["doc", "item", "n_words", "start", "exact"])


def leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", column: str = "text", item_key: str = "item_id", item_column: str = "text") -> DataFrame:
    """(key, item_id, n_words, start, exact): benchmark items found in documents, with the longest run of each pair.

    ``n_words`` and ``start`` give the run in words of the document (equal runs: the first); ``exact`` tells
    that all its slots have the item's own values. Null keys and null or empty texts take no part; rows with equal
    keys count as one document or item. Empty inputs give no rows; other columns are not read.

    One pass over the documents; what is broadcast is a filter of FILTER_BITS and, if they are few, the benchmark's
    windows. Only windows that pass the filter are joined, and runs form within one pair of document and item, in which
    a task holds no more windows than a few times the item's words.
    """
    spark = docs.sparkSession
    items = benchmark.filter(benchmark[item_key].isNotNull()).select(benchmark[item_key].cast("long").alias("id"), F.xxhash64(benchmark[item_column]).alias("copy"), benchmark[item_column].cast("string").alias("text"))
    asked = materialise(items.mapInArrow(_windows(list(range(1, WINDOW + 1)), None), _SCHEMA).distinct(), "benchmark-windows")
    sizes = sorted(r[0] for r in asked.select("length").distinct().collect())  # WINDOW at most
    places = asked.select(F.shiftrightunsigned("hash", 64 - FILTER_BITS.bit_length() + 1).alias("place")).distinct().toArrow()["place"].to_numpy()
    table = np.zeros(FILTER_BITS, bool)
    table[places] = True
    known = spark.sparkContext.broadcast(table)

    texts = docs.filter(docs[key].isNotNull()).select(docs[key].cast("long").alias("id"), F.xxhash64(docs[column]).alias("copy"), docs[column].cast("string").alias("text"))
    met = texts.mapInArrow(W.tidy(_windows(sizes, known)), _SCHEMA).select(F.col("id").alias("doc"), F.col("copy").alias("doc_copy"), "reading", "hash", "length", F.col("pos").alias("at"), "first", "last", F.col("plain").alias("doc_plain"), F.col("slots").alias("values"))
    right = asked.select(F.col("id").alias("item"), "copy", "reading", "size", "hash", "length", "pos", "plain", "offsets", "slots")
    if asked.count() <= BROADCAST_WINDOWS:
        right = F.broadcast(right)
    met = met.join(right, ["hash", "length", "reading"]).filter(F.size("values") == F.size("slots"))
    window = F.struct("pos", "length", "first", "last", (F.col("plain") & F.col("doc_plain")).alias("plain"), "offsets", "slots", "values")
    lines = met.groupBy("doc", "doc_copy", "item", "copy", "reading", "size", (F.col("at") - F.col("pos")).alias("shift")).agg(F.collect_set(window).alias("windows"))
    best = lines.select("doc", "item", "size", "windows").mapInArrow(W.tidy(_longest), "doc long, item long, n_words long, start long, exact boolean")
    best = best.groupBy("doc", "item").agg(F.min(F.struct((-F.col("n_words")).alias("n"), "start", (~F.col("exact")).alias("changed"))).alias("x"))
    return best.select(F.col("doc").alias(key), F.col("item").alias("item_id"), (-F.col("x.n")).alias("n_words"), F.col("x.start").alias("start"), (~F.col("x.changed")).alias("exact"))


def without_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """The documents in which no benchmark item was found. Rows with a null key stay."""
    found = leaks(docs, benchmark, key, column).select(F.col(key).alias("_leak")).distinct()
    found = light(materialise(found, "leaks"), 1_000_000)
    return docs.join(found, docs[key] == found["_leak"], "left_anti")
