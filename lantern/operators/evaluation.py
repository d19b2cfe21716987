"""Retrieval quality: ranks of expected results, recall, precision, summaries by variant."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lantern.operators.order_stats import nearest_ranks

LATENCY_SHARES = {"p50": 0.5, "p95": 0.95}


def first_match(results: DataFrame, expected: DataFrame, query: str = "query_id", key: str = "doc_id") -> DataFrame:
    """(query, first_rank) of all queries with results; null if nothing expected was found."""
    flagged = results.join(expected.select(query, key).distinct().withColumn("_hit", F.lit(True)), [query, key], "left")
    return flagged.groupBy(query).agg(F.min(F.when(F.col("_hit"), F.col("rank"))).alias("first_rank"))


def hits_at(rank: Column, cuts: Sequence[int] = (1, 3, 6)) -> list[Column]:
    return [F.coalesce(rank <= k, F.lit(False)).alias(f"hit_at_{k}") for k in cuts]


def lost_in_rerank(pool: DataFrame, final: DataFrame, expected: DataFrame, query: str = "query_id", key: str = "doc_id") -> DataFrame:
    """(query, pool_rank, final_rank, lost): found among the candidates but not in the end."""
    a = first_match(pool, expected, query, key).withColumnRenamed("first_rank", "pool_rank")
    b = first_match(final, expected, query, key).withColumnRenamed("first_rank", "final_rank")
    return a.join(b, query, "left").withColumn("lost", F.col("pool_rank").isNotNull() & F.col("final_rank").isNull())


def recall_at(expected: Column, actual: Column, k: int) -> Column:
    """Null where nothing is expected."""
    return F.when(F.size(expected) > 0, F.size(F.array_intersect(F.slice(actual, 1, k), expected)) / F.size(F.array_distinct(expected)))


def precision_at(expected: Column, actual: Column, k: int) -> Column:
    """Of the first k results, repeats counted; null where nothing is expected or found."""
    top = F.slice(actual, 1, k)
    return F.when((F.size(expected) > 0) & (F.size(top) > 0), F.size(F.filter(top, lambda x: F.array_contains(expected, x))) / F.size(top))


def nearest_rank(values: Column, share: float) -> Column:
    """The element at round((n - 1) * share), halves to even, of a sorted array; ``order_stats`` does it for whole groups."""
    have = F.array_sort(F.array_compact(values))
    return F.when(F.size(have) > 0, F.element_at(have, (F.bround((F.size(have) - 1) * F.lit(share)) + 1).cast("int")))


def by_variant(rows: DataFrame, metrics: Sequence[str], latency: str, variant: str = "variant", shares: Mapping[str, float] = LATENCY_SHARES) -> DataFrame:
    """Means without nulls, and quantiles of the latency by nearest rank; no group is collected, however large."""
    means = rows.groupBy(variant).agg(*[F.round(F.avg(m), 6).alias(f"mean_{m}") for m in metrics])
    found = nearest_ranks(rows, variant, latency, list(shares.values()))
    columns = [F.max(F.when(F.col("share") == float(s), F.col(latency))).alias(name) for name, s in shares.items()]
    found = found.groupBy(F.col(variant).alias("_variant")).agg(*columns)
    return means.join(found, F.col(variant).eqNullSafe(F.col("_variant")), "left").drop("_variant")


def unpivoted_means(rows: DataFrame, metrics: Sequence[str], variant: str = "variant") -> DataFrame:
    """(variant, metric, mean, n) of all numeric metrics."""
    long = rows.unpivot([variant], list(metrics), "metric", "value")
    return long.groupBy(variant, "metric").agg(F.round(F.avg("value"), 6).alias("mean"), F.count("value").alias("n"))


def terms_pass(context: Column, expected: Column, forbidden: Column) -> Column:
    """All expected terms occur in the context and no forbidden one does, whatever their case."""
    low = F.lower(context)
    return F.forall(expected, lambda t: F.contains(low, F.lower(t))) & ~F.exists(forbidden, lambda t: F.contains(low, F.lower(t)))
