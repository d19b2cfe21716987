"""Exact order statistics of groups of any size.

Values are counted, the counts are dealt by ranges of (group, value), and running sums within the ranges, after the sums of
the ranges before, give each value the ranks it covers. So no group is collected, a group with most of the rows takes
many tasks, and what one task sorts are distinct values of one range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lantern.operators.lineage import small, stored

#: Groups, and parts of groups, that are broadcast at most.
BROADCAST_ROWS = 500_000


def ranked_values(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Written rows (group, value, n, upto): each distinct value of a group with its count, and how many values are at most it.

    Null values don't count; a null group is one. An empty table gives no rows.
    """
    counts = stored(rows.filter(F.col(value).isNotNull()).groupBy(F.col(group).alias("_g"), F.col(value).alias("_v")).agg(F.count("*").alias("n")), "value-counts")
    ranged = stored(counts.repartitionByRange(F.col("_g"), F.col("_v")).withColumn("_part", F.spark_partition_id()), "value-ranges")
    before = Window.partitionBy("_g").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("_part", "_g").agg(F.sum("n").alias("_n"))  # a row to a range and group
    offsets = sums.select(F.col("_part").alias("_p"), F.col("_g").alias("_h"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.sum("n").over(Window.partitionBy("_part", "_g").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    own = ranged.withColumn("_inside", inside)
    met = own.join(small(stored(offsets, "range-offsets"), BROADCAST_ROWS), (F.col("_part") == F.col("_p")) & F.col("_g").eqNullSafe(F.col("_h")))
    return stored(met.select(F.col("_g").alias(group), F.col("_v").alias(value), "n", (F.col("_inside") + F.col("_before")).alias("upto")), "ranked-values")


def place(n: Column, share: float) -> Column:
    """The rank, from 1, of a share of ``n`` sorted values: round((n - 1) * share) + 1, halves to even."""
    return (F.bround((n - 1) * F.lit(share)) + 1).cast("long")


def nearest_ranks(rows: DataFrame, group: str, value: str, shares: Sequence[float]) -> DataFrame:
    """(group, share, value): the value at the nearest rank of each share, for every group that has any value."""
    ranked = ranked_values(rows, group, value)
    sizes = ranked.groupBy(F.col(group).alias("_g")).agg(F.max("upto").alias("_n"))
    wanted = F.explode(F.array(*[F.struct(F.lit(float(s)).alias("share"), place(F.col("_n"), s).alias("_rank")) for s in shares]))
    asked = stored(sizes.select("_g", wanted.alias("x")).select("_g", "x.share", "x._rank"), "wanted-ranks")
    holds = F.col(group).eqNullSafe(F.col("_g")) & (F.col("_rank") <= F.col("upto")) & (F.col("_rank") > F.col("upto") - F.col("n"))
    return ranked.join(small(asked, BROADCAST_ROWS), holds).select(group, "share", value)


def histogram(rows: DataFrame, group: str, value: str, bounds: Sequence[float]) -> DataFrame:
    """(group, bound, n_to): how many of a group's values are at most each bound, from its counts of values."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(group).agg(*[F.count_if(F.col(value) <= F.lit(b)).alias(f"_{i}") for i, b in enumerate(bounds)])
    pairs = F.array(*[F.struct(F.lit(float(b)).alias("bound"), F.col(f"_{i}").alias("n_to")) for i, b in enumerate(bounds)])
    return counts.select(group, F.explode(pairs).alias("x")).select(group, "x.bound", "x.n_to")
