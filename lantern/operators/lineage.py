"""Cutting lineage by tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only by a session on one machine that names no shared folder, as in tests.
LOCAL_FOLDER = "/tmp/checkpoints"

_written: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a cluster that doesn't set it has no folder that all its machines see."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if spark.sparkContext.master.startswith("local"):
        return LOCAL_FOLDER
    raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")


def reserved(spark: SparkSession, label: str) -> str:
    """A new folder of the shared one, for tables that a caller writes; ``purge`` deletes it too."""
    path = f"{shared_folder(spark).rstrip('/')}/lantern-{uuid.uuid4().hex}/{label}"
    _written.append(path)
    return path


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return a scan of it.

    The scan has no lineage before the files, so a lost executor costs only the tasks it was running. Joins of two
    such scans get their own exchanges, which adaptive execution can split where a key is hot.
    """
    spark = df.sparkSession
    path = reserved(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int) -> DataFrame:
    """A stored table, marked for broadcast if it has at most ``rows`` rows; a larger one is joined by shuffling."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def written() -> list[str]:
    """Paths of the tables that this process wrote and hasn't purged, oldest first."""
    return list(_written)


def purge(spark: SparkSession, keep: list[str] | None = None) -> None:
    """Delete the tables that this process wrote, but for ``keep``; call it once nothing reads them any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for name in [x for x in _written if x not in (keep or [])]:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path.getParent(), True)
        _written.remove(name)
