"""Incremental maintenance: what changed, what is missing, shards, backfill windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lantern.functions.text import fingerprint


def stale(records: DataFrame, stored: DataFrame, version: str, key: str = "doc_id", content: str = "text") -> DataFrame:
    """Records whose key and fingerprint the stored table (key, fingerprint) lacks."""
    current = records.withColumn("fingerprint", fingerprint(F.sha2(F.col(content).cast("binary"), 256), version))
    return current.join(stored.select(key, "fingerprint"), [key, "fingerprint"], "left_anti")


def replaced(stored: DataFrame, rebuilt: DataFrame, key: str = "doc_id") -> DataFrame:
    """The stored rows of other keys and the rebuilt ones: the table to write over the old one."""
    return stored.join(rebuilt.select(key).distinct(), key, "left_anti").unionByName(rebuilt)


def missing(source: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows to add: an add-only backfill never changes what is there."""
    return source.join(target.select(*keys).distinct(), list(keys), "left_anti")


def shard(key: Column, shards: int) -> Column:
    """From the first 64 bits of SHA-256 of the key: the same in every language."""
    head = F.conv(F.substring(F.sha2(key.cast("string").cast("binary"), 256), 1, 16), 16, 10).cast("decimal(20,0)")
    return F.pmod(head, F.lit(shards)).cast("int")


def changed(old: DataFrame, new: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(key, changed): names of the columns in which the new row differs, nulls being equal to each other."""
    both = old.alias("o").join(new.alias("n"), key)
    names = F.array_compact(F.array(*[F.when(~F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")), F.lit(c)) for c in columns]))
    return both.select(key, names.alias("changed")).filter(F.size("changed") > 0)


def missing_days(done: DataFrame, first: Column, last: Column, day: str = "day") -> DataFrame:
    """The days from first to last that a state table doesn't have yet."""
    every = done.sparkSession.range(1).select(F.explode(F.sequence(first, last, F.expr("interval 1 day"))).alias(day))
    return every.join(done.select(day).distinct(), day, "left_anti")


def first_wins(rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_rn = 1").drop("_rn")


def pending(records: DataFrame, cursors: DataFrame, manifest: DataFrame, source: str = "source", position: str = "position") -> DataFrame:
    """The records that a resumed load still has to take: those after their source's cursor.

    ``cursors`` is (source, cursor, manifest_hash), ``manifest`` (source, manifest_hash): a source whose manifest has
    changed, or that has no cursor, begins anew.
    """
    valid = cursors.join(manifest.select(F.col(source).alias("_source"), F.col("manifest_hash").alias("_now")), (F.col(source) == F.col("_source")) & (F.col("manifest_hash") == F.col("_now")))
    marks = valid.select(F.col(source).alias("_source"), F.col("cursor").alias("_cursor"))
    rows = records.join(marks, F.col(source) == F.col("_source"), "left")
    return rows.filter(F.col("_cursor").isNull() | (F.col(position) > F.col("_cursor"))).drop("_source", "_cursor")


def advanced(cursors: DataFrame, loaded: DataFrame, manifest: DataFrame, source: str = "source", position: str = "position") -> DataFrame:
    """(source, cursor, manifest_hash) after a load: the last position taken of each source, others as they were."""
    taken = loaded.groupBy(source).agg(F.max(position).alias("cursor")).join(manifest, source).select(source, "cursor", "manifest_hash")
    return taken.unionByName(cursors.select(source, "cursor", "manifest_hash").join(taken.select(source), source, "left_anti"))
