"""BPE encoding and decoding by a priority queue of merge ranks over a doubly linked symbol list.

The queue holds ranks with the position of the left symbol. A popped entry is stale, and skipped, when the symbols at
that position are no longer the two that the rank joins. Texts pass through Arrow batches; each Python
worker keeps the result of recent space-delimited chunks, since the merges never cross white space.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: White_Space of Unicode; ``str.split`` also splits at 0x1C-0x1F, which are ordinary characters here.
_NOT_SPACE = regex.compile(r"[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_ODD_SPACE = regex.compile(r"[\x1c-\x1f]")
#: Chunks, and pieces of chunks, kept by a worker before it starts afresh.
CACHE_ENTRIES = 300_000


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class WordBpe:
    """Encoder of a tokenizer file with byte-level symbols and an end-of-word suffix."""

    def __init__(self, path: str, most: int | None = None):
        self._most = CACHE_ENTRIES if most is None else most
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        suffix = model.get("end_of_word_suffix") or ""
        self.tokens = {i: s for s, i in vocab.items()}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.tokens |= {i: s for s, i in self.special.items()}
        self._special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self._pieces = regex.compile(split["pattern"]["Regex"]).findall
        symbols = byte_symbols()
        self._inner = [vocab.get(c, -1) for c in symbols]
        self._last = [vocab.get(c + suffix, -1) for c in symbols]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self._parts = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
        self._rank = {(a, b): rank for rank, (a, b, _) in enumerate(self._parts)}
        self._kept: dict[str, tuple[str, str]] = {}
        self._pieces_kept: dict[str, tuple[str, str]] = {}

    def merge(self, piece: str) -> list[int]:
        data = piece.encode("utf-8", "surrogatepass")
        n = len(data)
        inner = self._inner
        ids = [inner[b] for b in data]
        ids[-1] = self._last[data[-1]]
        if n == 1:
            return ids
        rank_of, parts, push, pop = self._rank.get, self._parts, heapq.heappush, heapq.heappop
        # An entry is rank * n + position, so that ties in rank go to the left.
        queue = [r * n + i for i, pair in enumerate(zip(ids, ids[1:])) if (r := rank_of(pair)) is not None]
        if not queue:
            return ids
        heapq.heapify(queue)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while queue:
            rank, i = divmod(pop(queue), n)
            a, b, made = parts[rank]
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue  # stale
            ids[i], ids[j] = made, -2
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := rank_of((made, ids[k]))) is not None:
                    push(queue, r * n + i)
            h = before[i]
            if h >= 0 and (r := rank_of((ids[h], made))) is not None:
                push(queue, r * n + h)
        return [x for x in ids if x != -2]

    def piece_strings(self, piece: str) -> tuple[str, str]:
        ids = self.merge(piece)
        tokens = self.tokens
        return " ".join(map(str, ids)), " ".join([tokens[i] for i in ids])

    def _look(self, chunk: str) -> tuple[str, str]:
        """Ids and vocabulary strings of a run of characters without white space or special tokens."""
        if chunk.isascii():
            text = chunk.lower()
        else:
            # Lower-casing is by character: a capital sigma has one lower form wherever it stands.
            text = unicodedata.normalize("NFC", chunk).replace("Σ", "σ").lower()
        kept, found = self._pieces_kept, []
        for piece in self._pieces(text):
            one = kept.get(piece)
            if one is None:
                one = self.piece_strings(piece)
                if len(kept) >= self._most:
                    kept.clear()
                if len(piece) <= 64:
                    kept[piece] = one
            found.append(one)
        if len(found) == 1:
            out = found[0]
        else:
            out = " ".join([x[0] for x in found]), " ".join([x[1] for x in found])
        if len(self._kept) >= self._most:
            self._kept.clear()
        if len(chunk) <= 64:
            self._kept[chunk] = out
        return out

    def encode_decode(self, text: str) -> tuple[str, str]:
        """The decimal ids joined by spaces, and the decoded text."""
        if self._special and "<" in text and self._special.search(text):
            parts = self._special.split(text)
        else:
            parts = [text]
        out = []
        for part in parts:
            if part in self.special:
                out.append((str(self.special[part]), part))
            else:
                chunks = _NOT_SPACE.findall(part) if _ODD_SPACE.search(part) else part.split()
                kept = self._kept.get
                out += [kept(c) or self._look(c) for c in chunks]
        return " ".join([x[0] for x in out if x[0]]), " ".join([x[1] for x in out if x[0]])

    def encode(self, text: str) -> list[int]:
        return [int(x) for x in self.encode_decode(text)[0].split()]

    def decode(self, ids: list[int]) -> str:
        """The vocabulary strings in order. The file names no decoder, so a space stands between two of them."""
        return " ".join([self.tokens[i] for i in ids if i in self.tokens])


_models: dict[tuple[str, int | None], WordBpe] = {}


def model(path: str, most: int | None = None) -> WordBpe:
    if (path, most) not in _models:
        _models[path, most] = WordBpe(path, most)
    return _models[path, most]


def encode_documents(docs: DataFrame, vocabulary: str, key: str = "doc_id", column: str = "text") -> DataFrame:
    """Ids and decoded text of every whole text: (key, n_tokens, ids string, decoded string).

    ``vocabulary`` is the path of a tokenizer file on every worker. A null or empty text has no tokens, empty ids and
    an empty decoded text. Repeated rows give repeated rows; other columns are not read. One pass, no shuffle.
    """
    schema = T.StructType([T.StructField("key", docs.schema[key].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.StringType()), T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                pairs = [bpe.encode_decode(x or "") for x in part.column(1).to_pylist()]
                counts = [x.count(" ") + 1 if x else 0 for x, _ in pairs]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), pa.array([x for x, _ in pairs], pa.string()), pa.array([x for _, x in pairs], pa.string())], names=schema.names)

    return docs.select(docs[key].alias("key"), docs[column].cast("string").alias("text")).mapInArrow(run, schema).withColumnRenamed("key", key)


def encode_digests(docs: DataFrame, vocabulary: str, key: str = "doc_id", column: str = "text", most: int | None = None) -> DataFrame:
    """As ``encode_documents``, with lowercase SHA-256 of ids and decoded text in place of the strings.

    The digests are taken beside the encoder, so that the long strings never leave the worker. A worker keeps the results
    of ``most`` chunks and pieces (by default CACHE_ENTRIES), about 200 bytes each, beyond its task.
    """
    schema = T.StructType([T.StructField("key", docs.schema[key].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(vocabulary, most)
        for batch in batches:
            counts, ids, decoded = [], [], []
            for x in batch.column(1):
                a, b = bpe.encode_decode(x.as_py() or "")
                counts.append(a.count(" ") + 1 if a else 0)
                ids.append(hashlib.sha256(a.encode()).hexdigest())
                decoded.append(hashlib.sha256(b.encode("utf-8", "surrogatepass")).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=schema.names)

    return docs.select(docs[key].alias("key"), docs[column].cast("string").alias("text")).mapInArrow(run, schema).withColumnRenamed("key", key)
