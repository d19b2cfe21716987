"""Exact histogram of encoded lengths, with suffix sums that answer every context limit."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lantern.llm._storage import materialise

#: Lengths whose sums are formed in one task.
BLOCK = 4096

_encodings: dict = {}


def rank_encoding(path: str, pattern: str):
    """A tiktoken encoding of a rank file, built once in each worker."""
    if (path, pattern) not in _encodings:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        _encodings[path, pattern] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path, pattern]


def encoded_lengths(docs: DataFrame, vocabulary: str, pattern: str, column: str = "text") -> DataFrame:
    """(n_tokens, n_docs) of each batch: the map side of the histogram. A null or empty text has length 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = rank_encoding(vocabulary, pattern).encode_ordinary
        counts: dict[int, int] = {}
        for batch in batches:
            for x in batch.column(0):
                n = len(encode(x.as_py() or ""))
                counts[n] = counts.get(n, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], names=["n_tokens", "n_docs"])

    return docs.select(docs[column].cast("string").alias("text")).mapInArrow(run, "n_tokens long, n_docs long")


def length_histogram(docs: DataFrame, vocabulary: str, pattern: str, column: str = "text") -> DataFrame:
    """(n_tokens, n_docs): documents by encoded length. An empty table gives no rows; repeated rows all count.

    A task passes on one row per length that it met, so the shuffle doesn't grow with the documents.
    """
    return encoded_lengths(docs, vocabulary, pattern, column).groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def limits(histogram: DataFrame) -> DataFrame:
    """The histogram with sums from each length on.

    Per length L: ``docs_from`` and ``tokens_from`` (documents and tokens of at least L), ``docs_to`` (at most L),
    ``truncated_tokens`` (tokens kept with limit L), ``lost_tokens``, ``total_docs``, ``total_tokens``, ``share_to``.
    Blocks of BLOCK lengths are summed apart and joined by their totals, one row a block. The histogram, one row a
    length, is written first: three sums read it, and the texts are encoded once.
    """
    histogram = materialise(histogram, "histogram")
    h = histogram.withColumn("block", F.floor(F.col("n_tokens") / BLOCK))
    totals = h.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("t"))
    later = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("block", F.coalesce(F.sum("d").over(later), F.lit(0)).alias("docs_after"), F.coalesce(F.sum("t").over(later), F.lit(0)).alias("tokens_after"))
    every = histogram.agg(F.sum("n_docs").alias("total_docs"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("total_tokens"))
    own = Window.partitionBy("block").orderBy(F.desc("n_tokens"))
    n, docs_from, tokens_from = F.col("n_tokens"), F.col("docs_from"), F.col("tokens_from")
    return (
        h.join(F.broadcast(totals), "block")
        .withColumn("docs_from", F.sum("n_docs").over(own) + F.col("docs_after"))
        .withColumn("tokens_from", F.sum(F.col("n_docs") * n).over(own) + F.col("tokens_after"))
        .join(F.broadcast(every), F.lit(True))  # one row
        .select(
            "n_tokens", "n_docs", "docs_from", "tokens_from",
            (F.col("total_docs") - docs_from + F.col("n_docs")).alias("docs_to"),
            (F.col("total_tokens") - tokens_from + n * docs_from).alias("truncated_tokens"),
            (tokens_from - n * docs_from).alias("lost_tokens"),
            "total_docs", "total_tokens",
            ((F.col("total_docs") - docs_from + F.col("n_docs")) / F.col("total_docs")).alias("share_to"),
        )
    )


def at_limits(table: DataFrame, context_limits: list[int]) -> DataFrame:
    """(context_limit, docs_over, kept_tokens) for any limits: the next length above has the sums that answer it."""
    wanted = table.sparkSession.createDataFrame([(int(x),) for x in context_limits], "context_limit long")
    # A limit's answer is in the first row above it, of which there is one a limit.
    above = table.select("n_tokens", "docs_from", "tokens_from")
    every = table.agg(F.max("total_tokens").alias("total_tokens"))
    found = F.broadcast(wanted).join(above, F.col("n_tokens") > F.col("context_limit"), "left").groupBy("context_limit").agg(F.min(F.struct("n_tokens", "docs_from", "tokens_from")).alias("x"))
    over, beyond = F.coalesce(F.col("x.docs_from"), F.lit(0)), F.coalesce(F.col("x.tokens_from"), F.lit(0))
    return found.join(F.broadcast(every), F.lit(True)).select("context_limit", over.alias("docs_over"), (F.coalesce("total_tokens", F.lit(0)) - beyond + F.col("context_limit") * over).alias("kept_tokens"))


def quantiles(table: DataFrame, shares: list[float]) -> DataFrame:
    """(share, n_tokens): the smallest length that at least this share of the documents doesn't exceed."""
    wanted = table.sparkSession.createDataFrame([(float(x),) for x in shares], "share double")
    return F.broadcast(wanted).join(table, F.col("docs_to") >= F.ceil(F.col("share") * F.col("total_docs"))).groupBy("share").agg(F.min("n_tokens").alias("n_tokens"))
