"""Validity in time: predicates, exact lookup of versions, successors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def effective_on(start: Column, end: Column, target: Column, legal_state: Column | None = None) -> Column:
    """Open bounds; without bounds the legal state must not be later; undated rows hold; no target date never does."""
    state = F.lit(None).cast("date") if legal_state is None else legal_state
    within = (start.isNull() | (start <= target)) & (end.isNull() | (target <= end))
    held = F.when(start.isNotNull() | end.isNotNull(), within).otherwise(F.coalesce(state <= target, F.lit(True)))
    return F.when(target.isNull(), False).otherwise(held)


def active_on(status: Column, start: Column, end: Column, target: Column) -> Column:
    """As a registry wants it: active, with a start."""
    return F.coalesce((status == "active") & (start <= target) & (end.isNull() | (target <= end)), F.lit(False))


def lookup(versions: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """(key, target, n_versions, version, conflict): the version of each wanted key on its date.

    ``versions`` is (key, version, status, start, end), ``wanted`` (key, target). More than one valid version is a
    conflict and gives no version.
    """
    met = wanted.join(versions, key, "left").withColumn("_on", active_on(F.col("status"), F.col("start"), F.col("end"), F.col("target")))
    out = met.groupBy(key, "target").agg(F.count_if("_on").alias("n_versions"), F.max(F.when(F.col("_on"), F.col("version"))).alias("version"))
    return out.select(key, "target", "n_versions", F.when(F.col("n_versions") == 1, F.col("version")).alias("version"), (F.col("n_versions") > 1).alias("conflict"))


def successors(versions: DataFrame, keys: list[str], order: list[str], node: str) -> DataFrame:
    """(source, target, relation): each version of a key and the next one."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return versions.select(F.col(node).alias("source"), F.lead(node).over(w).alias("target"), F.lit("temporal_successor").alias("relation")).filter("target is not null")
