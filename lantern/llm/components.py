"""Connected components of an edge table, by the smallest node, without collecting edges anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lantern.llm._storage import materialise


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) of every node that has a link; ``label`` is the smallest node of its component.

    Each round takes the smallest label among a node and its neighbours, then the label of that label. Rounds are
    written tables; a node with very many links is a hot join key of two scans, which adaptive execution splits, and
    minima are formed before the shuffle. Self links and repeated links do no harm; no links give no rows.
    """
    one_way = links.select(F.col(a).alias("src"), F.col(b).alias("dst"))
    both = materialise(one_way.union(one_way.select("dst", "src")).distinct(), "links")
    labels = materialise(both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("label")).withColumnRenamed("src", "node"), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "dst"), "dst").groupBy("src").agg(F.min("label").alias("near"))
        nearest = labels.join(near, labels["node"] == near["src"]).select("node", F.col("label").alias("old"), F.least("label", "near").alias("near"))
        jump = labels.select(F.col("node").alias("near"), F.col("label").alias("far"))
        moved = materialise(nearest.join(jump, "near").select("node", "old", F.least("near", "far").alias("label")), "labels")
        labels = moved.select("node", "label")
        if not moved.filter("label <> old").take(1):
            return labels
