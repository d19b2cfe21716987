"""Counts of the stages of a pass, observed while it runs."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from lantern.operators.lineage import stored


def funnel(rows: DataFrame, stages: Mapping[str, Callable[[DataFrame], DataFrame]], metrics: Mapping[str, Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows that all stages leave, as a written table, and (position, stage, rows, dropped, ...) of each stage.

    Each stage maps a frame to the rows that it keeps. ``metrics`` names further aggregates, taken after every stage. All
    are observed in the one pass that writes the result, so no stage is counted by a scan of its own; a stage is counted
    again only where a lost executor makes Spark run it again. ``candidates`` stands for the rows before the first.
    """
    extra = dict(metrics or {})
    watched = {}

    def observe(df: DataFrame, name: str) -> DataFrame:
        watched[name] = Observation(name)
        return df.observe(watched[name], F.count(F.lit(1)).alias("rows"), *[c.alias(m) for m, c in extra.items()])

    out = observe(rows, "candidates")
    for name, stage in stages.items():
        out = observe(stage(out), name)
    result = stored(out, "funnel")
    found = [{"position": i, "stage": name, **o.get} for i, (name, o) in enumerate(watched.items())]
    before = [None, *[x["rows"] for x in found[:-1]]]
    values = [(x["position"], x["stage"], x["rows"], None if b is None else b - x["rows"], *[None if x[m] is None else float(x[m]) for m in extra]) for x, b in zip(found, before)]
    kinds = "position int, stage string, rows long, dropped long" + "".join(f", `{m}` double" for m in extra)
    return result, rows.sparkSession.createDataFrame(values, kinds)
