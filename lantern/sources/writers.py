"""Writers: append, replace by key, and streams of changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.utils import AnalysisException

from lantern.operators.incremental import missing, replaced


def append_records(df: DataFrame, path: str, form: str = "parquet") -> None:
    df.write.mode("append").format(form).save(path)


def read_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def add_missing(df: DataFrame, path: str, keys: list[str]) -> None:
    """Add rows whose keys the table at ``path`` lacks; never changes others. Partitions of a key are its own."""
    old = read_or_none(df.sparkSession, path)
    (df if old is None else missing(df, old, keys)).write.mode("append").parquet(path)


def replace_keys(df: DataFrame, path: str, to: str, key: str) -> None:
    """Write the table at ``path`` with the rows of these keys replaced to another place, for an atomic switch."""
    old = read_or_none(df.sparkSession, path)
    (df if old is None else replaced(old, df, key)).write.mode("errorifexists").parquet(to)
