"""Token ids of whole texts in files: concatenated id arrays with Elias-Fano document boundaries.

Documents are dealt by ranges of their keys, so part files follow each other in the order of keys. A part is a run of
segments, one row each: its keys, the ids of its documents one after the other (two bytes an id where the vocabulary
allows it, else four, little-endian), and their boundaries. A segment knows how many ids stand before it in its part;
how many stand before a part comes from the sums of the parts. So nothing holds a 64-bit offset for each document.
"""

from __future__ import annotations

import itertools
import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lantern.llm import _words as W
from lantern.llm import elias_fano
from lantern.llm._storage import light, materialise

#: Ids of a segment; a longer document is a segment of its own.
SEGMENT_IDS = 1 << 18
SEGMENT_DOCS = 1 << 16
#: Pieces of words whose ids a worker keeps before it starts afresh, and the characters of the longest of them.
KEPT_PIECES, KEPT_LENGTH = 1_000_000, 64
#: Bytes of text that are encoded at once; a longer text is a run of its own.
RUN_BYTES = 4 << 20
SPACES = " \t\n\x0b\x0c\r"
# Fixed value: the pattern by which files with word ends cut texts.
CLASSES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Of each byte of ASCII: letter 1, digit 2, other 0.
_KIND = np.zeros(256, np.uint8)
_KIND[65:91] = _KIND[97:123] = 1
_KIND[48:58] = 2
#: Part files whose sums are formed in one task.
BLOCK = 1024
#: Sums of parts that are broadcast at most.
BROADCAST_PARTS = 1_000_000


def cuts(spec: dict) -> tuple[bool, bool, str] | None:
    """(cut at classes, lower case, characters of words that stay whole) if a file's encoding is that of its words apart.

    That holds for files that drop white space before they merge, and whose normalizer looks at no neighbours beyond it;
    None for all others. Where the file cuts between letters, single digits and other characters, words may be cut there
    too if both neighbours are ASCII, but for words with an apostrophe or a character that begins a special token.
    Words with characters beyond ASCII keep their case, as the normalizer composes before it lowers.
    """
    normal, split = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
    steps = normal.get("normalizers", [normal] if normal else [])
    pieces = split.get("pretokenizers", [split] if split else [])
    tokens = [x["content"] for x in spec["added_tokens"]]
    known = all(x["type"] in ("NFC", "Lowercase") or x["type"] == "Replace" and x["pattern"] == {"Regex": r"\s+"} and x["content"] == " " for x in steps)
    drops = [x["type"] for x in pieces] == ["Split", "ByteLevel"] and pieces[0]["behavior"] == "Removed" and pieces[0]["invert"] and not pieces[1]["add_prefix_space"] and not pieces[1]["use_regex"]
    if not known or not drops or pieces[0]["pattern"].get("Regex") != CLASSES or any(not x or not x.isascii() or set(x) & set(SPACES) for x in tokens):
        return None
    return True, any(x["type"] == "Lowercase" for x in steps), "'" + "".join(x[0] for x in tokens)


class Encoder:
    """Ids of texts by a tokenizer file and its library.

    Where ``cuts`` allows it, the library sees each word, or piece of a word, once for as long as the worker keeps it; the ids
    of a text are then put together from those of its pieces. For other files it sees whole texts.
    """

    def __init__(self, path: str, apart: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self._library = Tokenizer.from_file(path)
        self._library.no_truncation()
        self._library.no_padding()
        self.wide = max(self._library.get_vocab(True).values(), default=0) >= 1 << 16
        with open(path, encoding="utf-8") as f:
            self._cuts = cuts(json.load(f)) if apart else None
        if self._cuts:
            self._whole = np.zeros(256, bool)
            self._whole[[ord(x) for x in self._cuts[2]]] = True
        self._forget()

    def _forget(self) -> None:
        self._place: dict[str, int] = {}
        self._pool, self._first = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self._library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
        """(words, counts, ids) of pieces that the pool doesn't hold; the library takes many together where it keeps them apart."""
        plain = [x for x in words if x.isascii() and not set(x) & set(self._cuts[2])] if self._cuts[0] else []
        rest = set(words).difference(plain)
        for i in range(0, len(plain), 1000):
            own = plain[i : i + 1000]
            found = self._library.encode(" ".join(own), add_special_tokens=False)
            counts = np.bincount(np.array(found.word_ids, np.int64), minlength=len(own))
            if len(counts) == len(own) and counts.all():
                yield own, counts, np.array(found.ids, np.uint32)
            else:
                rest.update(own)
        if rest:
            own = list(rest)
            found = self.whole(own)
            yield own, np.array([len(x) for x in found], np.int64), np.fromiter(itertools.chain.from_iterable(found), np.uint32)

    def _places(self, own: list[str]) -> np.ndarray:
        """Where the ids of each piece stand in the pool, which learns those that it doesn't hold."""
        if len(self._place) + len(own) > KEPT_PIECES or len(self._pool) > 8 * KEPT_PIECES:
            self._forget()
        missing = [x for x in own if x not in self._place]
        if missing:
            words, counts, ids = zip(*self._learn(missing))
            self._place.update(zip(itertools.chain.from_iterable(words), itertools.count(len(self._first) - 1)))
            self._first = np.concatenate([self._first, len(self._pool) + np.cumsum(np.concatenate(counts))])
            self._pool = np.concatenate([self._pool, *ids])
        return np.array([self._place[x] for x in own], np.int64)

    def _pieces(self, texts: list[bytes], docs: list[int]) -> tuple[pa.Array, np.ndarray]:
        """The pieces of some texts in order, and how many stand before each text and in all."""
        raw, base = W.layout(texts, docs)
        inside = ~W.SPACE[raw]
        start, end = W.edges(inside)
        size = end - start
        begin = np.cumsum(size) - size
        data = raw[inside]
        split, lower, _ = self._cuts
        beyond = data >= 128
        held = [np.add.reduceat(x, begin, dtype=np.int32) > 0 if len(begin) else np.zeros(0, bool) for x in (self._whole[data], beyond)]
        whole, foreign = (np.repeat(x, size) for x in held)
        if lower:
            data = np.where(whole | foreign, data, W.LOWER[data])
        new = np.zeros(len(data), bool)
        if split:
            kind = _KIND[data]
            new[1:] = ((kind[1:] != kind[:-1]) | (kind[1:] == 2)) & ~(whole[1:] | beyond[1:] | beyond[:-1])
        new[begin] = True
        at = np.flatnonzero(new)
        before = np.append(begin, len(data))[np.append(np.searchsorted(start, base), len(start))]
        offsets = pa.py_buffer(np.append(at, len(data)))
        return pa.LargeStringArray.from_buffers(len(at), offsets, pa.py_buffer(data)), np.searchsorted(at, before)

    def encode(self, texts: list[bytes]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
        """(places of the texts, counts, ids) for runs of texts; the ids of a run are one array."""
        for docs in _runs(texts):
            if not self._cuts:
                found = self.whole([texts[i].decode() for i in docs])
                yield docs, np.array([len(x) for x in found], np.int64), np.fromiter(itertools.chain.from_iterable(found), np.uint32)
                continue
            pieces, before = self._pieces(texts, docs)
            pieces = pieces.dictionary_encode()
            place = self._places(pieces.dictionary.to_pylist())[pieces.indices.to_numpy(zero_copy_only=False)]
            first = self._first[place]
            size = self._first[place + 1] - first
            ends = np.append(0, np.cumsum(size))
            ids = self._pool[np.repeat((first - ends[:-1]).astype(np.int32), size) + np.arange(ends[-1], dtype=np.int32)]
            yield docs, np.diff(ends[before]), ids
            if (pc.max(pc.utf8_length(pieces.dictionary)).as_py() or 0) > KEPT_LENGTH:
                for x in pieces.dictionary.filter(pc.greater(pc.utf8_length(pieces.dictionary), KEPT_LENGTH)).to_pylist():
                    del self._place[x]


def _runs(texts: list[bytes]) -> Iterator[list[int]]:
    own, size = [], 0
    for i, x in enumerate(texts):
        if own and size + len(x) > RUN_BYTES:
            yield own
            own, size = [], 0
        own.append(i)
        size += len(x)
    if own:
        yield own


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, apart: bool) -> Encoder:
    if (path, apart) not in _encoders:
        _encoders[path, apart] = Encoder(path, apart)
    return _encoders[path, apart]


def write_ids(docs: DataFrame, vocabulary: str, end_id: int, key: str = "doc_id", column: str = "text", apart: bool = True) -> DataFrame:
    """Write the ids of every whole text, each ended by ``end_id``, in ascending order of keys; returns the files' rows.

    (part, segment, before, n_docs, n_ids, wide, keys, boundaries, ids): ``before`` counts the part's ids before the
    segment. A null or empty text has the end id alone. Null keys come first; rows that repeat a key are documents
    of their own, in the order of a hash of their texts. An empty table gives no segments. Other columns aren't read.

    One shuffle, by ranges of (key, hash, row), so that no key is too frequent for a task. A task holds one segment.
    """
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("segment", T.IntegerType()), T.StructField("before", T.LongType()), T.StructField("n_docs", T.IntegerType()), T.StructField("n_ids", T.LongType()), T.StructField("wide", T.BooleanType()), T.StructField("keys", T.ArrayType(docs.schema[key].dataType)), T.StructField("boundaries", T.BinaryType()), T.StructField("ids", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part = encoder(vocabulary, apart), TaskContext.get().partitionId()
        kind = np.dtype("<u4" if coder.wide else "<u2")
        segment, before, keys, sizes, held = 0, 0, [], [], []

        def flush() -> pa.RecordBatch:
            nonlocal segment, before, keys, sizes, held
            total = int(sum(sizes))
            boundaries = elias_fano.encode(np.append(0, np.cumsum(np.array(sizes, np.int64))))
            own = pa.concat_arrays(keys)
            lists = pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own)
            values = [[part], [segment], [before], [len(own)], [total], [coder.wide]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.bool_()]
            row = [pa.array(x, t) for x, t in zip(values, kinds)] + [lists, pa.array([boundaries], pa.binary()), pa.array([b"".join(held)], pa.binary())]
            segment, before, keys, sizes, held = segment + 1, before + total, [], [], []
            return pa.RecordBatch.from_arrays(row, names=schema.names)

        total = 0
        for batch in W.pieces(batches, 1):
            for docs_of, counts, ids in coder.encode(W.as_bytes(batch.column(1))):
                at = 0
                for place, n in zip(docs_of, counts.tolist()):
                    if keys and (total + n + 1 > SEGMENT_IDS or len(keys) >= SEGMENT_DOCS):
                        yield flush()
                        total = 0
                    keys.append(batch.column(0).slice(place, 1))
                    sizes.append(n + 1)
                    held.append(np.append(ids[at : at + n], end_id).astype(kind).tobytes())
                    at, total = at + n, total + n + 1
        if keys:
            yield flush()

    text = docs[column].cast("string")
    rows = docs.select(docs[key].alias("key"), text.alias("text"), F.xxhash64(text).alias("_hash"), F.monotonically_increasing_id().alias("_row"))
    order = [F.col("key").asc_nulls_first(), "_hash", "_row"]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("key", "text")
    return materialise(dealt.mapInArrow(W.tidy(run), schema), "token-ids")


def part_starts(segments: DataFrame) -> DataFrame:
    """(part, start): ids of all parts before each one. Sums go by blocks of BLOCK parts, then over the blocks."""
    parts = segments.groupBy("part").agg(F.sum("n_ids").alias("n")).withColumn("block", F.floor(F.col("part") / BLOCK))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    blocks = parts.groupBy("block").agg(F.sum("n").alias("n"))
    blocks = blocks.select("block", F.coalesce(F.sum("n").over(earlier(Window.orderBy("block"))), F.lit(0)).alias("before"))
    inside = F.coalesce(F.sum("n").over(earlier(Window.partitionBy("block").orderBy("part"))), F.lit(0))
    return parts.join(F.broadcast(blocks), "block").select("part", (inside + F.col("before")).alias("start"))  # a row to 1024 files


def _ids(row: dict, spans: np.ndarray) -> np.ndarray:
    return np.frombuffer(row["ids"], "<u4" if row["wide"] else "<u2")[spans[0] : spans[-1]]


def read_spans(segments: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of every document, read back from the files by select over the boundaries.

    ``start`` counts the ids of all documents before; the checksum is that of the ids as little-endian 32-bit integers.
    """
    kind = segments.schema["keys"].dataType.elementType
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("key", kind), T.StructField("inside", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part, before, wide, keys, boundaries, ids = (batch.column(j)[i] for j in range(6))
                edge = elias_fano.EliasFano(boundaries.as_py()).all()
                all_ids = np.frombuffer(ids.as_buffer(), "<u4" if wide.as_py() else "<u2").astype("<u4")
                sums = [zlib.crc32(all_ids[lo:hi]) for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist())]
                n = len(sums)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part.as_py(), np.int32)), keys.values, pa.array(edge[:-1] + before.as_py()), pa.array(np.diff(edge)), pa.array(sums, pa.int64())], names=schema.names)

    found = segments.select("part", "before", "wide", "keys", "boundaries", "ids").mapInArrow(W.tidy(run), schema)
    starts = light(materialise(part_starts(segments), "part-starts"), BROADCAST_PARTS)
    return found.join(starts, "part").select(F.col("key").alias(key), (F.col("start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def documents_by_key(segments: DataFrame, keys: list, key: str = "doc_id") -> DataFrame:
    """(key, ids) of the documents with one of a few given keys: only segments that may hold them are opened.

    A row for every document with such a key; keys that no document has give none.
    """
    kind = segments.schema["keys"].dataType.elementType
    schema = T.StructType([T.StructField("key", kind), T.StructField("ids", T.ArrayType(T.LongType()))])
    wanted = set(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                at = np.flatnonzero([k in wanted for k in row["keys"]])
                boundaries = elias_fano.EliasFano(row["boundaries"])
                spans = zip(boundaries.select(at).tolist(), boundaries.select(at + 1).tolist())
                ids = [_ids(row, np.array(x)).tolist() for x in spans]
                yield pa.RecordBatch.from_arrays([pa.array([row["keys"][i] for i in at], batch.schema.field("keys").type.value_type), pa.array(ids, pa.list_(pa.int64()))], names=schema.names)

    may = F.arrays_overlap("keys", F.array(*[F.lit(k).cast(kind) for k in keys])) if keys else F.lit(False)
    return segments.filter(may).select("wide", "keys", "boundaries", "ids").mapInArrow(run, schema).withColumnRenamed("key", key)
