"""Streams: first-seen deduplication, upserts of the latest row, windowed counts with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lantern.operators.incremental import replaced
from lantern.sources import bucketed


def first_seen(stream: DataFrame, key: str, time: str, lateness: str = "1 hour") -> DataFrame:
    """Rows whose key is new within the watermark; state is dropped behind it."""
    return stream.withWatermark(time, lateness).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, time: str, by: str, width: str, lateness: str) -> DataFrame:
    """(start, by, n) of tumbling windows; rows later than the watermark are left out."""
    return stream.withWatermark(time, lateness).groupBy(F.window(time, width), by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), by, "n")


def latest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def upsert_stream(stream: DataFrame, table: str, key: str, order: list[str], checkpoint: str) -> StreamingQuery:
    """Keep the latest row of each key in versions ``table``/v=<batch>; a batch that is run again writes the same."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = latest(batch, key, order)
        if number > 0:
            old = spark.read.parquet(f"{table}/v={number - 1}")
            new = replaced(old, latest(old.join(new.select(key), key, "left_semi").unionByName(new), key, order), key)
        new.write.mode("overwrite").parquet(f"{table}/v={number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upsert_buckets(stream: DataFrame, table: str, keys: list[str], order: list[str], checkpoint: str) -> StreamingQuery:
    """Keep the latest row of each key in a bucketed table; a batch rewrites only the buckets of its keys.

    A batch that is run again, or comes late, changes nothing, as rows older than the table's own don't replace it.
    """
    merge = lambda batch, number: bucketed.upsert(batch, table, keys, order) and None
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
