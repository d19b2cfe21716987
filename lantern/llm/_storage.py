"""Written intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lantern.operators.lineage import purge, shared_folder, written  # noqa: F401
from lantern.operators.lineage import stored as materialise  # noqa: F401


def light(df: DataFrame, rows: int) -> DataFrame:
    """A written table, marked for broadcast if it has at most ``rows`` rows; a larger one is joined by shuffling."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: Bytes of an Arrow batch between the JVM and its Python workers, each of which holds a few of them.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Let the session send texts to Python in batches of BATCH_BYTES; its own default holds 64 MB on either side."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
