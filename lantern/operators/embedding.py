"""Hash embeddings, cosine search with filters, and a versioned index."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lantern.functions.text import tokens
from lantern.functions.vectors import dot

#: Queries of a block and vectors of a product: a task holds about 35 MB of scores.
QUERY_BLOCK, VECTOR_BLOCK = 4096, 1024
#: Tokens whose slots a worker keeps.
KEPT_TOKENS = 200_000


def hash_embeddings(documents: DataFrame, dimensions: int = 256, key: str = "doc_id", column: str = "text") -> DataFrame:
    """(key, embedding): signed feature hashing of tokens and their 4-grams, of norm 1, to six digits.

    A token adds 24 and its letters, 12 at most, for itself and each of its 4-grams, at the slot and with the sign
    that SHA-256 gives the feature. Sums are integers. A narrow pass, in which a worker hashes a token once as long as
    it keeps it; a text without tokens has no row, and a repeated key one for each of its rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _TokenSlots(dimensions)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                n = part.num_rows
                words = part.column(1)
                doc = np.repeat(np.arange(n), words.value_lengths().to_numpy())
                coded = words.flatten().dictionary_encode()
                if not len(coded):
                    continue
                slots, units, first, numbers = known.of(coded.dictionary.to_pylist())
                # Each occurrence of a token brings its run of features.
                token = numbers[coded.indices.to_numpy()]
                size = first[token + 1] - first[token]
                ends = np.cumsum(size)
                feature = np.repeat(first[token] - (ends - size), size) + np.arange(ends[-1])
                sums = np.bincount(np.repeat(doc, size) * dimensions + slots[feature], units[feature], n * dimensions).reshape(n, dimensions)
                kept = np.flatnonzero(sums.any(axis=1))
                sums = sums[kept]
                values = rounded(sums / np.sqrt((sums * sums).sum(axis=1))[:, None])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(kept) + 1) * dimensions, pa.int32()), pa.array(values.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(kept)), lists], names=["key", "embedding"])

    kind = documents.schema[key].dataType.simpleString()
    words = documents.select(documents[key].alias("key"), F.array_distinct(tokens(F.coalesce(documents[column].cast("string"), F.lit("")), 2)).alias("words"))
    return words.mapInArrow(run, f"key {kind}, embedding array<double>").withColumnRenamed("key", key)


class _TokenSlots:
    """Slots and signed units of tokens' features, one run a token, for the tokens met so far."""

    def __init__(self, dimensions: int):
        self.dimensions = dimensions
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.slots, self.units, self.first = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1, np.int64)

    def of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(slots, units, first feature of each known token, number of each word)."""
        if len(self.number) > KEPT_TOKENS:
            self.clear()
        new = [w for w in words if w not in self.number]
        if new:
            self.number.update(zip(new, range(len(self.number), len(self.number) + len(new))))
            features = [f for w in new for f in (w, *(w[i : i + 4] for i in range(len(w) - 3)))]
            hashes = np.frombuffer(b"".join(hashlib.sha256(f.encode()).digest()[6:8] for f in features), ">u2").astype(np.int64)
            size = np.array([max(len(w) - 3, 0) + 1 for w in new])
            weight = np.repeat([24 + min(len(w), 12) for w in new], size)
            self.slots = np.concatenate([self.slots, hashes % self.dimensions])
            self.units = np.concatenate([self.units, np.where((hashes >> 8) % 2 == 0, weight, -weight)])
            self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(size)])
        return self.slots, self.units, self.first, np.array([self.number[w] for w in words])


def rounded(values: np.ndarray, digits: int = 6) -> np.ndarray:
    """Rounded half away from zero, as SQL does."""
    scale = 10.0**digits
    return np.copysign(np.floor(np.abs(values) * scale + 0.5) / scale, values) + 0.0


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows; null components are 0."""
    sizes = np.unique(column.value_lengths().to_numpy())
    if len(sizes) > 1:
        raise ValueError("vectors differ in length")
    return np.asarray(column.flatten().fill_null(0), np.float64).reshape(len(column), -1)


def _best(scores: np.ndarray, keys: np.ndarray, limit: int, least: float | None) -> tuple[np.ndarray, np.ndarray]:
    """(query, column) of each query's highest scores among the columns, ties to the smaller key."""
    n = scores.shape[1]
    floor = np.partition(scores, n - limit, axis=1)[:, n - limit] if n > limit else np.full(len(scores), -np.inf)
    query, at = np.nonzero((scores >= floor[:, None]) & (scores > -np.inf) & (scores >= (-np.inf if least is None else least)))
    order = np.lexsort((keys[at], -scores[query, at], query))
    query, at = query[order], at[order]
    nth = np.arange(len(query)) - np.searchsorted(query, query)
    return query[nth < limit], at[nth < limit]


def nearest(queries: DataFrame, vectors: DataFrame, limit: int, metric: str = "cosine", least: float | None = None, within: tuple[str, str] | None = None, besides_self: bool = False, query: str = "query_id", key: str = "vec_id", column: str = "embedding", digits: int = 6) -> DataFrame:
    """(query, key, score, rank): exact search by ``cosine`` or ``dot`` over all vectors; ties go to the smaller key.

    ``queries`` is (query, query_vector) with integer ids, a stated set. ``within`` names a column of the queries and one
    of the vectors that must be equal; ``besides_self`` leaves out a vector with the query's own id. A null vector takes
    no part, and cosine with a zero vector is 0. Up to QUERY_BLOCK queries are broadcast as one matrix and multiplied by
    the vectors where they lie; more of them are dealt to blocks that meet the vectors in a shuffle (``_tiled``). Either
    way the vectors are read once, a task passes on ``limit`` rows a query, and pairs never leave it.
    """
    own = [F.col(query).cast("long").alias("id"), F.col("query_vector").cast("array<double>").alias("v"), (F.col(within[0]) if within else F.lit("")).cast("string").alias("g")]
    asked = queries.filter("query_vector is not null").select(*own)
    rows = vectors.filter(F.col(column).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(column).cast("array<double>").alias("v"), (F.col(within[1]) if within else F.lit("")).cast("string").alias("g"))
    how = (limit, metric, least, bool(within), besides_self, digits)
    n = asked.count()
    found = _broadcast(asked, rows, how) if n <= QUERY_BLOCK else _tiled(asked, rows, -(-n // QUERY_BLOCK), how)
    w = Window.partitionBy("query").orderBy(F.desc("score"), "key")
    ranked = found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)
    names = [F.col("query").cast(queries.schema[query].dataType).alias(query), F.col("key").cast(vectors.schema[key].dataType).alias(key)]
    return ranked.select(*names, "score", "rank")


FOUND = "query long, key long, score double"


class _Search:
    """The best vectors of a block of queries among the batches (id, v, g) added so far."""

    def __init__(self, block: pa.Table, limit: int, metric: str, least: float | None, grouped: bool, besides_self: bool, digits: int):
        self.limit, self.metric, self.least, self.grouped, self.besides_self, self.digits = limit, metric, least, grouped, besides_self, digits
        block = block.combine_chunks()
        self.ids, self.groups = block["id"].to_numpy(), np.array(block["g"].to_pylist(), object)
        self.matrix = _matrix(block["v"].chunk(0)) if len(block) else np.zeros((0, 0))
        self.norms = np.sqrt((self.matrix * self.matrix).sum(axis=1))
        self.kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, batch: pa.RecordBatch) -> None:
        for lo in range(0, batch.num_rows if len(self.ids) else 0, VECTOR_BLOCK):
            part = batch.slice(lo, VECTOR_BLOCK)
            keys, own = part["id"].to_numpy(), _matrix(part["v"])
            if own.shape[1] != self.matrix.shape[1]:
                raise ValueError("vectors differ in length")
            scores = self.matrix @ own.T
            if self.metric == "cosine":
                size = self.norms[:, None] * np.sqrt((own * own).sum(axis=1))[None, :]
                scores = np.divide(scores, size, out=np.zeros_like(scores), where=size > 0)
            scores = rounded(scores, self.digits)
            if self.grouped:
                scores[self.groups[:, None] != np.array(part["g"].to_pylist(), object)[None, :]] = -np.inf
            if self.besides_self:
                scores[self.ids[:, None] == keys[None, :]] = -np.inf
            query, at = _best(scores, keys, self.limit, self.least)
            self.kept.append((query, keys[at], scores[query, at]))
            if len(self.kept) > 16:
                self.kept = [self._merged()]

    def _merged(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        query, keys, scores = (np.concatenate(x) for x in zip(*self.kept))
        order = np.lexsort((keys, -scores, query))
        query, keys, scores = query[order], keys[order], scores[order]
        first = np.arange(len(query)) - np.searchsorted(query, query) < self.limit
        return query[first], keys[first], scores[first]

    def rows(self) -> Iterator[pa.RecordBatch]:
        if self.kept:
            query, keys, scores = self._merged()
            for lo in range(0, len(query), 50_000):
                part = slice(lo, lo + 50_000)
                yield pa.RecordBatch.from_arrays([pa.array(self.ids[query[part]], pa.int64()), pa.array(keys[part], pa.int64()), pa.array(scores[part])], names=["query", "key", "score"])


def _broadcast(asked: DataFrame, rows: DataFrame, how: tuple) -> DataFrame:
    """(query, key, score) of QUERY_BLOCK queries at most, in a narrow pass over the vectors."""
    shared = rows.sparkSession.sparkContext.broadcast(asked.toArrow())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = _Search(shared.value, *how)
        for batch in batches:
            search.add(batch)
        yield from search.rows()

    return rows.mapInArrow(run, FOUND)


def _tiled(asked: DataFrame, rows: DataFrame, blocks: int, how: tuple) -> DataFrame:
    """(query, key, score) of any number of queries: each block of them meets each piece of the vectors in one place.

    Sorted by place, a block's queries come before its vectors, so a task holds one block and streams the vectors past
    it, however many there are. A vector is sent to every block and a query to every piece; the pieces are as many as
    give each shuffle partition a place.
    """
    spark = rows.sparkSession
    pieces = max(1, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // blocks))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.withColumn("_block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("_piece", every(pieces)).withColumn("_kind", F.lit(0))
    right = rows.withColumn("_piece", F.pmod(F.xxhash64("id"), F.lit(pieces)).cast("int")).withColumn("_block", every(blocks)).withColumn("_kind", F.lit(1))
    both = left.unionByName(right).select("id", "v", "g", (F.col("_block").cast("long") * pieces + F.col("_piece")).alias("place"), "_kind")
    both = both.repartition("place").sortWithinPartitions("place", "_kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, waiting, search = None, [], None
        for batch in batches:
            step = batch["place"].to_numpy() * 2 + batch["_kind"].to_numpy()
            starts = [0, *(np.flatnonzero(np.diff(step)) + 1).tolist(), len(step)] if len(step) else []
            for lo, hi in zip(starts, starts[1:]):
                place, kind = divmod(int(step[lo]), 2)
                if place != now:
                    if search:
                        yield from search.rows()
                    now, waiting, search = place, [], None
                part = batch.slice(lo, hi - lo)
                if kind == 0:
                    waiting.append(part)
                elif waiting:
                    search = search or _Search(pa.Table.from_batches(waiting), *how)
                    search.add(part)
        if search:
            yield from search.rows()

    return both.mapInArrow(run, FOUND)


def semantic_scores(rows: DataFrame, digits: int = 6) -> DataFrame:
    """``rows`` with ``semantic``: inner product of two normalised vectors; 0 where one is missing."""
    return rows.withColumn("semantic", F.round(F.coalesce(dot(F.col("query_vector"), F.col("embedding")), F.lit(0.0)), digits))


VERSION_KEY = ("item_id", "model", "dimensions", "content_hash")


def upsert_versions(index: DataFrame, incoming: DataFrame) -> DataFrame:
    """The index with the incoming revisions: one row a version key, metadata refreshed, one current row an item.

    Both are (item_id, model, dimensions, content_hash, metadata, loaded_at); of equal keys the later row stays, and
    an item's latest incoming hash, or else its latest, is current.
    """
    both = index.select(*VERSION_KEY, "metadata", "loaded_at").withColumn("new", F.lit(0)).unionByName(incoming.select(*VERSION_KEY, "metadata", "loaded_at").withColumn("new", F.lit(1)))
    newest = Window.partitionBy(*VERSION_KEY).orderBy(F.desc("new"), F.desc("loaded_at"))
    kept = both.withColumn("_rn", F.row_number().over(newest)).filter("_rn = 1").drop("_rn")
    latest = Window.partitionBy("item_id", "model", "dimensions").orderBy(F.desc("new"), F.desc("loaded_at"), "content_hash")
    return kept.withColumn("is_current", F.row_number().over(latest) == 1).drop("new")


def load_report(index: DataFrame, incoming: DataFrame) -> DataFrame:
    """One row: how many incoming revisions are new and how many the index already has."""
    rows = incoming.join(index.select(*VERSION_KEY).distinct().withColumn("_known", F.lit(True)), list(VERSION_KEY), "left")
    return rows.agg(F.count_if(F.col("_known").isNull()).alias("indexed"), F.count_if(F.col("_known").isNotNull()).alias("skipped"))


def offline_embeddings(documents: DataFrame, dimensions: int = 384, key: str = "doc_id", column: str = "text") -> DataFrame:
    """(key, embedding): words and letter trigrams, repeats counted, hashed by BLAKE2b, which SQL doesn't have.

    A blank or null text is the zero vector. A narrow pass.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [_blake_vector(t.as_py() or "", dimensions).tolist() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(vectors, pa.list_(pa.float64()))], names=["key", "embedding"])

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(documents[key], documents[column]).mapInArrow(run, f"key {kind}, embedding array<double>").withColumnRenamed("key", key)


def _blake_vector(text: str, dimensions: int) -> np.ndarray:
    line = " ".join(text.casefold().split())
    counts = Counter(f"tok:{w}" for w in re.findall(r"\w+", line))
    counts.update(f"tri:{line[i : i + 3]}" for i in range(len(line) - 2))
    vector = np.zeros(dimensions)
    for feature, n in counts.items():
        digest = hashlib.blake2b(feature.encode(), digest_size=16).digest()
        vector[int.from_bytes(digest[:8], "big") % dimensions] += n if digest[8] & 1 else -n
    size = np.sqrt((vector * vector).sum())
    return vector / size if size else vector
