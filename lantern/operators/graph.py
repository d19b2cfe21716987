"""Traversal of typed, dated edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lantern.operators.lineage import stored

#: Rounds of a closure whose frontiers are put together.
MERGE = 8


def directed(edges: DataFrame, direction: str = "out") -> DataFrame:
    """(source, target, relation) to walk along: ``out``, ``in`` or ``both``."""
    forward = edges.select("source", "target", "relation")
    backward = edges.select(F.col("target").alias("source"), F.col("source").alias("target"), "relation")
    return {"out": forward, "in": backward, "both": forward.union(backward)}[direction]


def related(seeds: DataFrame, edges: DataFrame, max_depth: int, relations: list[str] | None = None, direction: str = "out") -> DataFrame:
    """(seed, node, depth): nodes within so many steps of each seed, at their least depth, the seed itself at 0.

    Breadth first; each level joins the frontier with the edges, drops what is already known and is written, so that
    the next one doesn't compute it again.
    """
    steps = directed(edges, direction)
    if relations is not None:
        steps = steps.filter(F.col("relation").isin(*relations))
    steps = steps.select("source", "target").distinct()
    known = seeds.select(F.col("seed"), F.col("seed").alias("node"), F.lit(0).alias("depth"))
    frontier = known
    for depth in range(1, max_depth + 1):
        met = frontier.join(steps, frontier["node"] == steps["source"]).select("seed", F.col("target").alias("node")).distinct()
        frontier = met.join(known.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("depth", F.lit(depth))
        if depth < max_depth:
            frontier = stored(frontier, "frontier")
        known = known.unionByName(frontier)
    return known


def closure(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(seed, node): all nodes that each seed reaches, itself included; cycles end.

    Each round joins only the nodes found in the last one. Frontiers are written; every MERGE rounds they are put into
    one table, so that neither the plan nor what a lost executor costs grows with the rounds, and what is known is
    seldom written again.
    """
    steps = edges.select("source", "target").distinct()
    known = frontier = seeds.select("seed", F.col("seed").alias("node")).distinct()
    rounds = 0
    while True:
        met = frontier.join(steps, frontier["node"] == steps["source"]).select("seed", F.col("target").alias("node")).distinct()
        frontier = stored(met.join(known, ["seed", "node"], "left_anti"), "frontier")
        if not frontier.take(1):
            return known
        rounds += 1
        known = known.unionByName(frontier)
        if rounds % MERGE == 0:
            known = stored(known, "known")


def dependencies(references: DataFrame, units: DataFrame, scope: list[str]) -> DataFrame:
    """``references`` (scope, ref_id, article, paragraph, point) with the broadest unit that they name, ties to the smaller id.

    Article is equal; paragraph and point are equal or not given in the reference. A unit stands under its own paragraph
    and point and under none, so that a reference meets one best unit by equality, not every unit of its article. Units
    are never broadcast: the estimate of their size doesn't see what an explode made of a small table.
    """
    specificity = F.col("paragraph").isNotNull().cast("int") + F.col("point").isNotNull().cast("int")
    under = units.select(*scope, "article", "paragraph", "point", F.struct(specificity.alias("specificity"), "unit_id").alias("_unit"))
    for c in ("paragraph", "point"):
        under = under.withColumn(c, F.explode(F.array_distinct(F.array(F.lit(None).cast(units.schema[c].dataType), c))))
    best = under.groupBy(*scope, "article", "paragraph", "point").agg(F.min("_unit").alias("_unit"))
    r, u = references.alias("r"), best.hint("merge").alias("u")
    same = F.col("r.article") == F.col("u.article")
    for c in scope:
        same &= F.col(f"r.{c}") == F.col(f"u.{c}")
    for c in ("paragraph", "point"):
        same &= F.col(f"r.{c}").eqNullSafe(F.col(f"u.{c}"))
    met = r.join(u, same).groupBy("r.ref_id").agg(F.min("u._unit").alias("_unit"))
    return met.select("ref_id", "_unit.unit_id")
