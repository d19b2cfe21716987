"""Substring dedup by relative Lempel-Ziv parsing.

Reference blocks are indexed by content. Of the 26 runs of 25 words in a window of 50 words, the one with the smallest
hash is the window's anchor; consecutive windows with one anchor form a block, of 50 to 75 words. The same text has
the same anchors wherever it stands, so a block is looked up in the index of all documents' blocks as a whole: what
stands in a document with a smaller id may be copied from there. Where a factor ends inside a block, the block differs
although its anchor is known elsewhere; there every window is looked up by itself.

A document is then parsed greedily, left to right: blocks and windows that go on in one source at one distance are one
copy, and at each place the factor is the copy that reaches furthest. The next one may begin before the last one's
end, so windows across the boundary of two factors count too. Together the factors cover exactly the words of windows
that start in an earlier document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lantern.llm import _words as W
from lantern.llm._storage import materialise

#: Text of a batch in which equal blocks are put together before the shuffle.
BATCH_BYTES = 8 << 20
#: Bits of the filters that tell tasks which anchors are shared: 16 an anchor, within these bounds (16 MB at most).
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 27
#: Windows whose anchors are sought at once; a very long text is one chunk.
SLICE_WINDOWS = 10_000
#: Words of 64 bits of a filter that one task packs.
PIECE_WORDS = 8192
#: Spans of this many documents, and eight times as many spans, are broadcast at most; beyond it texts are shuffled.
BROADCAST_SPANS = 100

SPANS = "array<struct<start:int,end:int,source:long,at:int>>"


class _Blocks:
    """Blocks of a run of documents: number of the document, anchor, content, first word, windows."""

    def __init__(self, window: int):
        self.window, self.gram = window, window // 2
        self.size, self.docs, self.parts, self.windows, self.n_windows = 0, 0, [], [], 0

    def add(self, c: W.Chunk) -> None:
        k, w = self.gram, self.window
        sums = W.prefix_sums(c.hash)
        n = len(c.hash)
        if n >= w:
            at = np.flatnonzero(c.doc[: n - w + 1] == c.doc[w - 1 :])
            if len(at):
                starts = np.arange(n - k + 1)
                grams = W.span_hash(sums, starts, starts + k)
                views = np.lib.stride_tricks.sliding_window_view(grams, w - k + 1)
                parts = (at[lo : lo + SLICE_WINDOWS] for lo in range(0, len(at), SLICE_WINDOWS))
                anchor = np.concatenate([part + views[part].argmin(axis=1) for part in parts])
                new = np.ones(len(at), bool)
                new[1:] = (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1) | (c.doc[at[1:]] != c.doc[at[:-1]])
                first = np.flatnonzero(new)
                count = np.diff(np.append(first, len(at)))
                start, doc, a = at[first], c.doc[at[first]], anchor[first]
                content = W.mix(W.span_hash(sums, start, start + count - 1 + w) ^ (a - start).astype(W.U))
                self.parts.append((doc + self.docs, grams[a], content, start - c.first[doc], count, first + self.n_windows))
                self.windows.append(W.mix(W.span_hash(sums, at, at + w) ^ np.repeat(grams[a], count)))
                self.n_windows += len(at)
        self.docs += len(c.docs)
        self.size += len(c.raw)

    def arrays(self) -> tuple[np.ndarray, ...]:
        if not self.parts:
            return tuple(np.zeros(0, t) for t in (np.int64, W.U, W.U, np.int64, np.int64, np.int64))
        return tuple(np.concatenate(x) for x in zip(*self.parts))


def _batches(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[tuple[np.ndarray, np.ndarray, _Blocks]]:
    ids, marks, own = [], [], _Blocks(window)
    W.release_memory()
    for batch in W.pieces(batches, 2):
        keys, hashes = np.asarray(batch.column(0), np.int64), np.asarray(batch.column(1), np.int64)
        for c in W.word_chunks(W.as_bytes(batch.column(2)), lower=False):
            own.add(c)
            ids.append(keys[c.docs])
            marks.append(hashes[c.docs])
            if own.size >= BATCH_BYTES:
                yield np.concatenate(ids), np.concatenate(marks), own
                W.release_memory()
                ids, marks, own = [], [], _Blocks(window)
    if own.docs:
        yield np.concatenate(ids), np.concatenate(marks), own


def _first_of(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by the keys, the last one leading, and where its groups by the leading key begin."""
    order = np.lexsort(keys)
    lead = keys[-1][order]
    return order, np.flatnonzero(np.concatenate([[True], lead[1:] != lead[:-1]])) if len(lead) else np.zeros(0, np.int64)


def _anchors(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each anchor in a batch: the smallest and largest document, and of the contents around it."""
        for ids, _, own in _batches(batches, window):
            doc, anchor, content, *_ = own.arrays()
            order, start = _first_of(anchor)
            d, c = ids[doc[order]], content[order].view(np.int64)
            pick = lambda f, x: f.reduceat(x, start) if len(start) else x
            columns = [anchor[order][start].view(np.int64), pick(np.minimum, d), pick(np.maximum, d), pick(np.minimum, c), pick(np.maximum, c)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["anchor", "lo", "hi", "c_lo", "c_hi"])

    return run


def _filter_of(anchors: DataFrame, bits: int) -> np.ndarray:
    """One bit an anchor at its hash modulo ``bits``. Tasks pack the bits; the driver gets bits / 8 bytes at most."""
    slot = F.pmod("anchor", F.lit(bits))
    words = anchors.select(F.shiftrightunsigned(slot, 6).alias("word"), F.expr(f"shiftleft(1L, cast(pmod(anchor, {bits}L) & 63 as int))").alias("bit"))
    words = words.groupBy("word").agg(F.bit_or("bit").alias("set")).withColumn("piece", F.floor(F.col("word") / PIECE_WORDS))

    def pack(part: pa.Table) -> pa.Table:
        own = np.zeros(PIECE_WORDS, np.int64)
        own[part["word"].to_numpy() % PIECE_WORDS] = part["set"].to_numpy()
        return pa.table({"piece": part["piece"][:1], "bits": pa.array([own.tobytes()], pa.binary())})

    table = np.zeros(max(bits // 64, PIECE_WORDS), np.int64)
    for batch in words.groupBy("piece").applyInArrow(pack, "piece long, bits binary").toArrow().to_batches():
        for piece, value in zip(batch["piece"], batch["bits"]):
            at = piece.as_py() * PIECE_WORDS
            table[at : at + PIECE_WORDS] = np.frombuffer(value.as_buffer(), np.int64)
    return table[: bits // 64].view(W.U)


def _has(table: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    slot = np.mod(anchor.view(np.int64), len(table) * 64).astype(W.U)
    return (table[(slot >> W.U(6)).astype(np.int64)] >> (slot & W.U(63))) & W.U(1) > 0


_BLOCK = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("mark", T.LongType()), T.StructField("content", T.LongType()), T.StructField("starts", T.ArrayType(T.IntegerType())),
    T.StructField("words", T.IntegerType()), T.StructField("windows", T.ArrayType(T.LongType())), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("source", T.LongType()), T.StructField("at", T.IntegerType())]))),
])


def _known(window: int, shared, differing):
    """Rows of blocks with a shared anchor.

    Of equal blocks in a batch those of the smallest document are looked up in the index; later documents copy them
    already. A block whose anchor also has other contents brings its windows along.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType, mask: np.ndarray | None = None) -> pa.Array:
        offsets = np.concatenate([[0], np.cumsum(counts)])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind), mask=None if mask is None else pa.array(mask))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(_BLOCK)
        for ids, marks, own in _batches(batches, window):
            doc, anchor, content, start, count, at = own.arrays()
            kept = _has(shared.value, anchor)
            doc, anchor, start, count, at = (x[kept] for x in (doc, anchor, start, count, at))
            content = W.mix(content[kept] ^ anchor)
            if not len(doc):
                continue
            order, group = _first_of(start, doc, ids[doc], content)
            size = np.diff(np.append(group, len(order)))
            least, stands = (np.repeat(x[order][group], size) for x in (ids[doc], start))
            later = ids[doc[order]] > least
            copies, source, stands = order[later], least[later], stands[later]
            if len(copies):
                by = np.lexsort((start[copies], doc[copies]))
                copies, source, stands = copies[by], source[by], stands[by]
                who, each = np.unique(doc[copies], return_counts=True)
                spans = pa.StructArray.from_arrays([pa.array(start[copies], pa.int32()), pa.array(start[copies] + count[copies] - 1 + window, pa.int32()), pa.array(source, pa.int64()), pa.array(stands, pa.int32())], fields=list(schema.field("spans").type.value_type))
                offsets = pa.array(np.concatenate([[0], np.cumsum(each)]), pa.int32())
                nulls = [pa.nulls(len(who), schema.field(i).type) for i in range(2, 6)]
                yield pa.RecordBatch.from_arrays([pa.array(ids[who]), pa.array(marks[who]), *nulls, pa.ListArray.from_arrays(offsets, spans).cast(schema.field("spans").type)], schema=schema)
            own_rows = order[~later]
            # Repeats of a block in one document are one row with several starts.
            same = np.ones(len(own_rows), bool)
            same[1:] = (content[own_rows][1:] != content[own_rows][:-1]) | (doc[own_rows][1:] != doc[own_rows][:-1])
            lead = np.flatnonzero(same)
            first = own_rows[lead]
            each = np.diff(np.append(lead, len(own_rows)))
            brings = _has(differing.value, anchor[first])
            n = np.where(brings, count[first], 0)
            every = np.concatenate(own.windows)
            ends = np.cumsum(n)
            windows = every[np.repeat(at[first] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
            columns = [pa.array(ids[doc[first]]), pa.array(marks[doc[first]]), pa.array(content[first].view(np.int64)), lists(start[own_rows], each, pa.int32()), pa.array(count[first] - 1 + window, pa.int32()), lists(windows.view(np.int64), n, pa.int64(), ~brings), pa.nulls(len(first), schema.field(6).type)]
            for lo in range(0, len(first), 20_000):
                yield pa.RecordBatch.from_arrays([c.slice(lo, 20_000).cast(f.type) for c, f in zip(columns, schema)], schema=schema)

    return run


def parsed(spans: list[dict]) -> list[dict]:
    """The greedy factors of a document from the spans that are known to be copies, in order.

    Spans that touch in one source at one distance are one copy. From left to right, each factor is the copy that
    reaches furthest of those that begin within what is covered, or else at the next copied word.
    """
    copies: dict[tuple[int, int], list[list[int]]] = {}
    for s in sorted(spans, key=lambda s: (s["start"], s["end"])):
        own = copies.setdefault((s["source"], s["at"] - s["start"]), [])
        if own and s["start"] <= own[-1][1]:
            own[-1][1] = max(own[-1][1], s["end"])
        else:
            own.append([s["start"], s["end"]])
    every = sorted((start, end, source, start + distance) for (source, distance), own in copies.items() for start, end in own)
    found, covered_to, i = [], -1, 0
    while i < len(every):
        begin = max(covered_to, every[i][0])
        best = None
        while i < len(every) and every[i][0] <= begin:
            if best is None or every[i][1] > best[1]:
                best = every[i]
            i += 1
        if best[1] > covered_to:
            found.append(dict(zip(("start", "end", "source", "at"), best)))
            covered_to = best[1]
    return found


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 200):
            part = batch.slice(lo, 200)
            made = pa.array([parsed(x) for x in part.column(2).to_pylist()], part.schema.field(2).type)
            yield pa.RecordBatch.from_arrays([*part.columns[:2], made], schema=part.schema)


def factors(docs: DataFrame, window: int = 50, key: str = "doc_id", column: str = "text") -> DataFrame:
    """(doc_id, mark, spans): the factors of a document, word spans [start, end) that stand in one with a smaller id.

    ``mark`` is the hash of the text, for keys that occur on several texts. ``source`` and ``at`` tell where the copy
    stands: in the smallest document that is known to hold its first block or window. Rows without a key or with fewer
    than ``window`` words have no factors.
    """
    texts = docs.filter(docs[key].isNotNull()).select(docs[key].cast("long").alias("doc_id"), F.xxhash64(docs[column]).alias("mark"), docs[column].cast("string").alias("text"))
    spark = docs.sparkSession
    seen = texts.mapInArrow(W.tidy(_anchors(window)), "anchor long, lo long, hi long, c_lo long, c_hi long")
    seen = seen.groupBy("anchor").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), (F.min("c_lo") != F.max("c_hi")).alias("differ")).filter("lo < hi")
    shared = materialise(seen.select("anchor", "differ"), "anchors")
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (16 * shared.count()).bit_length()))
    filters = [spark.sparkContext.broadcast(_filter_of(df, bits)) for df in (shared, shared.filter("differ"))]

    blocks = materialise(texts.mapInArrow(W.tidy(_known(window, *filters)), _BLOCK), "blocks")
    for x in filters:
        x.destroy()
    place = F.struct(F.col("doc_id").alias("source"), F.array_min("starts").alias("at"))
    index = blocks.filter("content is not null").groupBy("content").agg(F.min(place).alias("place"), F.count("*").alias("n")).filter("n > 1")
    index = materialise(index.select("content", "place.source", "place.at"), "index")
    found = blocks.filter("content is not null").join(index, "content", "left")
    copied = F.coalesce(F.col("source") < F.col("doc_id"), F.lit(False))
    found = found.select("doc_id", "mark", "starts", "words", *[F.when(copied, F.col(c)).alias(c) for c in ("source", "at")], F.when(~copied, F.col("windows")).alias("windows"))
    found = materialise(found.filter("source is not null or windows is not null"), "found")

    span = lambda s, e: F.struct(s.cast("int").alias("start"), e.cast("int").alias("end"), F.col("source"), F.col("at"))
    whole = found.filter("source is not null").select("doc_id", "mark", F.transform("starts", lambda s: span(s, s + F.col("words"))).alias("spans"))
    single = found.filter("windows is not null").select("doc_id", "mark", "starts", F.posexplode("windows").alias("i", "window"))
    place = F.struct(F.col("doc_id").alias("source"), (F.array_min("starts") + F.col("i")).alias("at"))
    earliest = single.groupBy("window").agg(F.min(place).alias("place"), F.max("doc_id").alias("last")).filter("place.source < last").select("window", "place.source", "place.at")
    single = single.join(materialise(earliest, "windows"), "window").filter("source < doc_id")
    single = single.select("doc_id", "mark", F.transform("starts", lambda s: span(s + F.col("i"), s + F.col("i") + window)).alias("spans"))
    batched = blocks.filter("spans is not null").select("doc_id", "mark", "spans")
    every = batched.union(whole).union(single).groupBy("doc_id", "mark").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    return materialise(every.mapInArrow(W.tidy(_parse), every.schema), "factors")


def covered(spans: list[dict] | None, n: int) -> np.ndarray:
    """Which of ``n`` words some span covers."""
    change = np.zeros(n + 1, np.int64)
    for s in spans or []:
        change[s["start"]] += 1
        change[s["end"]] -= 1
    return np.cumsum(change[:-1]) > 0


def _with_spans(docs: DataFrame, found: DataFrame, key: str, column: str) -> DataFrame:
    """``docs`` with ``_spans``. Rows without a key are joined with nothing, apart from the others."""
    size = found.count()
    right = found.select(F.col("doc_id").alias("_doc"), F.col("mark").alias("_mark"), F.col("spans").alias("_spans"))
    if size <= BROADCAST_SPANS and (found.agg(F.sum(F.size("spans"))).first()[0] or 0) <= 8 * BROADCAST_SPANS:
        right = F.broadcast(right)
    else:  # the same plan at every size
        right = right.hint("merge")
    keyed, rest = docs.filter(docs[key].isNotNull()), docs.filter(docs[key].isNull())
    joined = keyed.join(right, (keyed[key].cast("long") == F.col("_doc")) & (F.xxhash64(keyed[column]) == F.col("_mark")), "left").drop("_doc", "_mark")
    return joined.unionByName(rest.withColumn("_spans", F.lit(None).cast(SPANS)))


def kept_words(docs: DataFrame, window: int = 50, key: str = "doc_id", column: str = "text") -> DataFrame:
    """(key, n_words, n_removed, kept_sha256) of every row.

    Words are runs of anything but space and 0x09-0x0D, unchanged. A word is removed if a window of ``window`` words
    covers it whose sequence also starts in a document with a smaller key; windows are judged on the input. A null
    or empty text has no words; rows with a null key lose none; rows with equal keys don't count as earlier for each
    other. Other columns are not read. The texts are read three times and, unless the spans are few, shuffled once.
    """
    kind = docs.schema[key].dataType.simpleString()
    joined = _with_spans(docs.select(docs[key].alias("key"), docs[column].cast("string").alias("text")), factors(docs, window, key, column), "key", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.pieces(batches, 1):
            texts, spans = W.as_bytes(batch.column(1)), batch.column(2)
            n, removed, digest = [], [], []
            for i, text in enumerate(texts):
                words = text.split()  # bytes split at space and 0x09-0x0D only
                own = spans[i].as_py()
                kept = words
                if own:
                    gone = covered(own, len(words))
                    kept = [w for w, g in zip(words, gone.tolist()) if not g]
                n.append(len(words))
                removed.append(len(words) - len(kept))
                digest.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string())], names=["key", "n_words", "n_removed", "kept_sha256"])

    return joined.select("key", "text", "_spans").mapInArrow(W.tidy(run), f"key {kind}, n_words long, n_removed long, kept_sha256 string").withColumnRenamed("key", key)


def cut_text(text: bytes, spans: list[dict]) -> bytes:
    """The text without the covered words and the white space after each."""
    raw = np.frombuffer(text, np.uint8)
    start, _ = W.edges(~W.SPACE[raw])
    gone = covered(spans, len(start))
    bounds = np.append(start, len(raw))
    pieces = [text[: bounds[0]]] + [text[a:b] for a, b, g in zip(bounds[:-1], bounds[1:], gone) if not g]
    return b"".join(pieces)


def remove_repeats(docs: DataFrame, window: int = 50, key: str = "doc_id", column: str = "text") -> DataFrame:
    """``docs`` with repeated passages cut from the texts; a document of which nothing is left is dropped.

    All else of a text stays byte for byte, and documents without repeats stay as they are, empty ones too.
    """
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # names that clash with none of ours
    own_key, own_text = (f"c{docs.columns.index(c)}" for c in (key, column))
    joined = _with_spans(plain, factors(docs, window, key, column), own_key, own_text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.pieces(batches, 0):
            texts, spans = W.as_bytes(batch.column(0)), batch.column(1).to_pylist()
            cut = [cut_text(t, s) if s else t for t, s in zip(texts, spans)]
            keep = [not s or bool(t.strip()) for t, s in zip(cut, spans)]
            values = [t.decode() if s else None for t, s in zip(cut, spans)]
            yield pa.RecordBatch.from_arrays([pa.array(values, pa.string()), pa.array(keep, pa.bool_()), *batch.columns[2:]], names=schema.names)

    schema = T.StructType([T.StructField("_cut", T.StringType()), T.StructField("_keep", T.BooleanType()), *plain.schema.fields])
    changed = joined.select(F.col(own_text).cast("string").alias("_text"), "_spans", *plain.columns).mapInArrow(W.tidy(run), schema).filter("_keep")
    return changed.select(*[(F.coalesce("_cut", c) if c == own_text else F.col(c)).alias(name) for c, name in zip(plain.columns, docs.columns)])
