"""Ranked lexical search: postings in buckets of terms, integer scores, the best documents of every item.

A term is a run of bytes that are ASCII letters or digits or belong to a character beyond ASCII; A-Z are lower-cased.
All scores are 64-bit integers. A task counts a document's terms in one pass over its text, so a posting is made once;
``postings`` are written by buckets of their terms, and their document counts come from the written rows. What
the items look for is then dealt by document, and scores are added and ranked within the tasks that hold the documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lantern.llm import _words as W
from lantern.llm._storage import light, materialise

BUCKETS = 64
#: Bits of the filter of wanted terms: fixed, whatever the number of items. What passes it by chance goes in the join.
FILTER_BITS = 1 << 23
#: Terms of items that are broadcast to the postings at most; more are joined by shuffling.
BROADCAST_TERMS = 500_000

_INSIDE = np.zeros(256, bool)
_INSIDE[48:58] = _INSIDE[65:91] = _INSIDE[97:123] = _INSIDE[128:] = True


def _terms(texts: list[bytes]) -> Iterator[W.Chunk]:
    """The texts in chunks whose words are the terms."""
    for docs in W.chunked(texts):
        raw, base = W.layout(texts, docs)
        start, end = W.edges(_INSIDE[raw])
        yield W.assemble(docs, raw, W.LOWER[raw], base, start, end)


def _places(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> W.U(64 - FILTER_BITS.bit_length() + 1)).astype(np.int64)


def _strings(c: W.Chunk, at: np.ndarray) -> pa.Array:
    """The terms at places ``at`` of a chunk, in lower case."""
    size = c.end[at] - c.start[at]
    offsets = np.zeros(len(at) + 1, np.int32)
    np.cumsum(size, out=offsets[1:])
    inside = np.repeat(c.start[at] - offsets[:-1], size) + np.arange(offsets[-1])
    return pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(c.data[inside]))


def _grouped(c: W.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """A place of each distinct term of each document of a chunk, and its count; within a document, terms are told apart by 64 bits."""
    order = np.lexsort((c.hash, c.doc))
    doc, h = c.doc[order], c.hash[order]
    new = np.ones(len(order), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    first = np.flatnonzero(new)
    return order[first], np.diff(np.append(first, len(order)))


def postings(docs: DataFrame, wanted: np.ndarray | None = None, key: str = "doc_id", column: str = "text") -> DataFrame:
    """Written rows (bucket, term, row, key, tf, n) by buckets of terms, sorted by term; ``n`` counts the document's terms.

    A row is a document, also if rows repeat a key; ``row`` tells them apart. A null text has no terms. With ``wanted``, a
    filter of term hashes, only postings of terms that may be wanted are kept. Rows with a null term hold what a batch
    counted: documents with a term in ``tf``, and their terms in ``n``.

    Buckets are rebalanced, so a bucket with a frequent term is written by several tasks.
    """
    schema = T.StructType([T.StructField("term", T.StringType()), T.StructField("row", T.LongType()), T.StructField("key", docs.schema[key].dataType), T.StructField("tf", T.LongType()), T.StructField("n", T.LongType())])
    known = docs.sparkSession.sparkContext.broadcast(wanted) if wanted is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.pieces(batches, 2):
            rows, some, total = np.asarray(batch.column(0), np.int64), 0, 0
            for c in _terms(W.as_bytes(batch.column(2))):
                counts = c.counts()
                some, total = some + int((counts > 0).sum()), total + int(counts.sum())
                at, tf = _grouped(c)
                if known is not None:
                    kept = known.value[_places(c.hash[at])]
                    at, tf = at[kept], tf[kept]
                doc = np.asarray(c.docs)[c.doc[at]]
                columns = [_strings(c, at), pa.array(rows[doc]), batch.column(1).take(pa.array(doc)), pa.array(tf, pa.int64()), pa.array(counts[c.doc[at]], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)
            none = [pa.nulls(1, pa.string()), pa.nulls(1, pa.int64()), pa.nulls(1, batch.column(1).type), pa.array([some], pa.int64()), pa.array([total], pa.int64())]
            yield pa.RecordBatch.from_arrays(none, names=schema.names)

    texts = docs.select(F.monotonically_increasing_id().alias("row"), docs[key].alias("key"), docs[column].cast("string").alias("text"))
    made = texts.mapInArrow(W.tidy(run), schema).withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int"))
    return materialise(made.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term"), "postings")


def item_terms(items: DataFrame, key: str = "item_id", column: str = "text") -> DataFrame:
    """Written rows (item, key, term, repeats): the terms of each item. A row is an item, also if rows repeat a key."""
    schema = T.StructType([T.StructField("item", T.LongType()), T.StructField("key", items.schema[key].dataType), T.StructField("term", T.StringType()), T.StructField("repeats", T.LongType()), T.StructField("hash", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.pieces(batches, 2):
            for c in _terms(W.as_bytes(batch.column(2))):
                at, repeats = _grouped(c)
                doc = pa.array(np.asarray(c.docs)[c.doc[at]])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(doc), batch.column(1).take(doc), _strings(c, at), pa.array(repeats, pa.int64()), pa.array(c.hash[at].view(np.int64))], names=schema.names)

    rows = items.select(F.monotonically_increasing_id().alias("item"), items[key].alias("key"), items[column].cast("string").alias("text"))
    return materialise(rows.mapInArrow(run, schema), "item-terms")


def wanted_filter(asked: DataFrame) -> np.ndarray:
    """A bitmap of FILTER_BITS places of the items' term hashes; its size doesn't grow with them."""
    place = F.shiftrightunsigned("hash", 64 - FILTER_BITS.bit_length() + 1)
    table = np.zeros(FILTER_BITS, bool)
    table[asked.select(place.alias("place")).distinct().toArrow()["place"].to_numpy()] = True  # FILTER_BITS rows at most
    return table


def search(index: DataFrame, asked: DataFrame, limit: int = 10, key: str = "doc_id", item_key: str = "item_id") -> DataFrame:
    """(item_key, rank, key, score): the ``limit`` best documents of every item with a score above 0.

    Equal scores go by ascending key, nulls first. Items without terms, and an empty index, give no rows.

    The items' terms select postings, which are dealt by document before they meet the items: matches are added up and
    ranked where they arise, and only a task's best rows of each item go on. If the terms are too many to be
    broadcast, they are joined by shuffling and the matches are dealt by item and document.
    """
    every = index.filter("term is null").agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms"))
    held = index.filter("term is not null")
    terms = asked.select("term").distinct()
    df = held.join(light(terms, BROADCAST_TERMS), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.col("documents") + 2) / (2 * F.col("df") + 1)))
    weighed = df.join(F.broadcast(every), F.lit(True)).select("term", weight.alias("w")).filter("w > 0")  # one row
    weighed = materialise(weighed, "term-weights")
    looked = materialise(asked.select("item", F.col("key").alias("item_key"), "term", "repeats").join(weighed, "term"), "weighed-terms")
    part = F.expr("(1000000000 * tf) div (1000 * tf + 8 * (100 - 75 + ((75 * n * documents) div terms)))")
    parts = held.join(light(weighed.select("term"), BROADCAST_TERMS), "term", "left_semi").join(F.broadcast(every), F.lit(True)).select("term", "row", "key", part.alias("part"))
    met = parts.repartition("row").join(light(looked, BROADCAST_TERMS), "term")
    scores = met.groupBy("item", "row").agg(F.first("item_key").alias("item_key"), F.first("key").alias("key"), F.sum(F.col("w") * F.col("repeats") * F.col("part")).alias("score"))
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("key"), "row")
    best = scores.filter("score > 0").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
    return best.select(F.col("item_key").alias(item_key), F.col("rank").cast("int").alias("rank"), F.col("key").alias(key), "score")


def search_documents(docs: DataFrame, items: DataFrame, limit: int = 10, key: str = "doc_id", column: str = "text", item_key: str = "item_id", item_column: str = "text") -> DataFrame:
    """``search`` over an index of the documents that holds the items' terms only."""
    asked = item_terms(items, item_key, item_column)
    return search(postings(docs, wanted_filter(asked), key, column), asked, limit, key, item_key)
