"""Dense numbers in a global order, without one task that sorts all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lantern.operators.lineage import small, stored

#: Ranges whose offsets are broadcast at most.
BROADCAST_ROWS = 500_000


def numbered(rows: DataFrame, order: Sequence[str | Column], name: str = "ordinal", start: int = 0) -> DataFrame:
    """``rows`` with their number, from ``start``, in an order; rows that it can't tell apart are numbered in some order.

    Rows are dealt by ranges and written; each range is numbered by itself, after the sums of the ranges before it, of
    which there is one row a range.
    """
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    # The place in a sorted range; ranges are numbered in their order.
    held = stored(ranged.withColumn("_part", F.spark_partition_id()).withColumn("_in", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "ranges")
    sizes = held.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = stored(sizes.select(F.col("_part").alias("_p"), F.coalesce(before, F.lit(0)).alias("_before")), "range-sizes")
    met = held.join(small(offsets, BROADCAST_ROWS), F.col("_part") == F.col("_p"))
    return met.withColumn(name, F.col("_in") + F.col("_before") + start).drop("_part", "_in", "_p", "_before")
