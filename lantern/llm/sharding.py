"""Sharding by a hierarchical weighted hash tree: region, rack and shard levels.

A leaf's draw for a key is -ln(u)/weight with u uniform from a hash of key and leaf. A node's draw is the smallest of
its leaves' draws, which is again such a draw with the node's total weight; each level descends to the child with the
smallest draw. So a change of weight under one node moves keys only into or out of the leaves that changed.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a shard are numbered in so many pieces at once.
PIECES = 64


@dataclass(frozen=True)
class Shard:
    region: int
    rack: int
    index: int
    weight: float = 1.0


def tree(shards: int, regions: int = 2, racks: int = 2) -> list[Shard]:
    """Equal leaves dealt evenly to the racks; one more shard leaves the others where they are."""
    return [Shard(i % (regions * racks) // racks, i % racks, i) for i in range(shards)]


def _draw(key: Column, leaf: Shard) -> Column:
    # 52 bits of the digest: the same number in any engine that has md5.
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", key, F.lit(str(leaf.index))).cast("binary")), 1, 13), 16, 10).cast("double")
    return -F.ln((bits + 0.5) / float(2**52)) / F.lit(float(leaf.weight))


def descend(key: Column, leaves: Sequence[Shard]) -> Column:
    """The shard of a key. A null key counts as an empty string; equal draws go to the smaller number."""
    key = F.coalesce(key.cast("string"), F.lit(""))

    def level(own: Sequence[Shard], names: tuple[str, ...]) -> Column:
        """struct(draw, shard) of the subtree; structs compare by their fields in order."""
        if not names:
            return F.struct(_draw(key, own[0]).alias("draw"), F.lit(own[0].index).alias("shard"))
        groups = sorted({getattr(x, names[0]) for x in own})
        children = [level([x for x in own if getattr(x, names[0]) == g], names[1:]) for g in groups]
        return F.least(*children) if len(children) > 1 else children[0]

    return level(list(leaves), ("region", "rack", "index"))["shard"]


def assign(docs: DataFrame, shards: int = 16, key: str = "doc_id", column: str = "text") -> DataFrame:
    """(key, size, text_crc32, law, shard, slot, grown_shard) of every row.

    The law is ``key``: key and shard count alone decide. ``size`` is the UTF-8 bytes of the text (null: none) plus
    one; ``text_crc32`` of a null text is that of an empty one. ``grown_shard`` is the shard under one more leaf.
    ``slot`` numbers the rows of a shard from 0 without gaps, by piece, key, checksum and size. Rows with a null key
    all have one shard, and their pieces are dealt by the text. Repeated rows have slots of their own.

    Two scans, one shuffle of narrow rows; the counts that join them have shards x PIECES rows at most.
    """
    text = F.coalesce(docs[column].cast("string"), F.lit(""))
    piece = F.when(docs[key].isNotNull(), F.pmod(F.xxhash64(docs[key]), F.lit(PIECES))).otherwise(F.pmod(F.xxhash64(text), F.lit(PIECES))).cast("int")
    placed = docs.select(
        docs[key].alias("key"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        descend(docs[key], tree(shards)).alias("shard"),
        descend(docs[key], tree(shards + 1)).alias("grown_shard"),
        piece.alias("piece"),
    )
    counts = docs.select(descend(docs[key], tree(shards)).alias("shard"), piece.alias("piece")).groupBy("shard", "piece").count()
    before = counts.withColumn("before", F.coalesce(F.sum("count").over(Window.partitionBy("shard").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    own = Window.partitionBy("shard", "piece").orderBy("key", "text_crc32", "size")
    return (
        placed.withColumn("own", F.row_number().over(own))
        .join(F.broadcast(before), ["shard", "piece"])
        .select(F.col("key").alias(key), "size", "text_crc32", "law", "shard", (F.col("before") + F.col("own") - 1).cast("long").alias("slot"), "grown_shard")
    )
