"""JSON lines in the order in which they stand in their files, from the first or from the last."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lantern.operators.numbering import numbered
from lantern.sources.readers import RECORD


def ordered_records(spark: SparkSession, paths: Sequence[str], reverse: bool = False, schema: T.StructType = RECORD) -> DataFrame:
    """(fields, source_file, ordinal): the records of some files, numbered from 0 by file name and line; blank lines are skipped.

    With ``reverse`` the last line of the last file is 0. A line's place is that of its split in the file and of the line
    in the split, so the numbers don't depend on how many tasks read a file, nor on the sizes of files. Lines that
    aren't JSON are rows of nulls, as they count too.
    """
    lines = spark.read.text(list(paths)).select("value", F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_line"))
    lines = lines.filter(F.trim("value") != "")
    columns = ["source_file", "_block", "_line"]
    order = [F.desc(c) if reverse else F.asc(c) for c in columns]
    made = numbered(lines, order)
    return made.select(F.from_json("value", schema).alias("r"), "source_file", "ordinal").select("r.*", "source_file", "ordinal")
