"""Tables in buckets of key hashes, of which an upsert rewrites only what its rows touch.

A table is a folder::

    data/<version>/bucket=B/part files     the buckets that a version wrote
    manifest/                              rows (version, bucket, written, rows): where each bucket's rows stand

The rows of the last version of the manifest name, for each bucket, the version whose files hold it. An upsert
writes the buckets of its keys anew and then the manifest, which readers see as a whole or not at all, so a batch that
fails leaves the table as it was, and one that is run again changes nothing but its own buckets. One writer at a time.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lantern.operators.lineage import small, stored

BUCKETS = 64
BROADCAST_ROWS = 500_000
_MANIFEST = "version long, bucket int, written long, rows long, buckets int, schema string"


def bucket_of(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*[F.col(k) for k in keys]), F.lit(buckets)).cast("int")


def manifest(spark: SparkSession, path: str, version: int | None = None) -> list[dict] | None:
    """One row a bucket (BUCKETS at most) of a version, by default the last; None if there is no table."""
    try:
        rows = spark.read.schema(_MANIFEST).parquet(f"{path}/manifest")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    last = rows.agg(F.max("version")).first()[0] if version is None else version
    return [r.asDict() for r in rows.filter(F.col("version") == last).collect()]


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """The table, or an earlier version of it whose files still stand; only the files of its buckets are listed."""
    rows = manifest(spark, path, version)
    return None if not rows else _scan(spark, path, rows)


def _scan(spark: SparkSession, path: str, rows: list[dict]) -> DataFrame:
    schema = T.StructType.fromJson(json.loads(rows[0]["schema"]))
    files = [f"{path}/data/{r['written']}/bucket={r['bucket']}" for r in rows if r["rows"]]
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)


def upsert(batch: DataFrame, path: str, keys: Sequence[str], order: Sequence[str] = (), deleted: Column | None = None, buckets: int = BUCKETS) -> dict:
    """Put a batch's rows in place of those with equal keys; returns (version, touched, rows_before, rows_after).

    Of several rows of a key in the batch that which is last by ``order`` counts, ties by the row's content. With
    ``order``, a row older than the table's own doesn't replace it, so batches may come late or twice. Rows for which
    ``deleted`` holds take their key out. A batch that changes nothing writes nothing.

    Only the buckets of the batch's keys are read and written; the number of buckets is fixed by the first batch.
    """
    spark = batch.sparkSession
    old = manifest(spark, path)
    buckets = old[0]["buckets"] if old else buckets
    gone = F.coalesce(deleted, F.lit(False)) if deleted is not None else F.lit(False)
    columns = batch.columns
    new = stored(batch.withColumn("_gone", gone).withColumn("_bucket", bucket_of(keys, buckets)).withColumn("_new", F.lit(1)), "batch")
    touched = sorted(r[0] for r in new.select("_bucket").distinct().collect())  # BUCKETS at most
    if not touched:
        return {"version": old[0]["version"] if old else 0, "touched": [], "rows_before": 0, "rows_after": 0}
    schema = old[0]["schema"] if old else batch.schema.json()
    held = [r for r in old or [] if r["bucket"] in set(touched)]
    rows = new
    if held:
        table = _scan(spark, path, held).select(*columns)
        rows = new.unionByName(table.withColumn("_gone", F.lit(False)).withColumn("_bucket", bucket_of(keys, buckets)).withColumn("_new", F.lit(0)))
    latest = [F.desc_nulls_last(c) for c in order]
    content = F.xxhash64(*[F.col(c) for c in columns])
    w = Window.partitionBy("_bucket", *keys).orderBy(*latest, F.desc("_new"), F.desc("_gone"), content)
    kept = rows.withColumn("_nth", F.row_number().over(w)).filter("_nth = 1 and not _gone")
    kept = stored(kept.select(*columns, F.col("_bucket").alias("bucket")), "upserted")
    version = (old[0]["version"] if old else 0) + 1
    counts = {r["bucket"]: r["n"] for r in kept.groupBy("bucket").agg(F.count("*").alias("n")).collect()}
    before = sum(r["rows"] for r in held)
    if held and _same(kept, _scan(spark, path, held), columns):
        return {"version": old[0]["version"], "touched": [], "rows_before": before, "rows_after": before}
    # What a failed run left under this version is in no manifest.
    kept.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/{version}")
    stay = [(version, r["bucket"], r["written"], r["rows"], buckets, schema) for r in old or [] if r["bucket"] not in set(touched)]
    made = [(version, b, version, counts.get(b, 0), buckets, schema) for b in touched]
    spark.createDataFrame(stay + made, _MANIFEST).coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    return {"version": version, "touched": touched, "rows_before": before, "rows_after": sum(counts.values())}


def _same(a: DataFrame, b: DataFrame, columns: Sequence[str]) -> bool:
    """Whether two tables hold the same rows, by row counts and two sums of row hashes."""
    def digest(df: DataFrame) -> tuple:
        own = F.xxhash64(*[F.col(c) for c in columns])
        return tuple(df.agg(F.count("*"), F.sum(own.cast("decimal(38,0)")), F.bit_xor(F.xxhash64(own, F.lit(1)))).first())

    return digest(a) == digest(b)


def add_missing(batch: DataFrame, path: str, keys: Sequence[str], buckets: int = BUCKETS) -> dict:
    """Add the rows whose keys the table lacks; no other row changes. Of several rows of a new key one is taken, by content."""
    old = read(batch.sparkSession, path)
    new = batch if old is None else batch.join(old.select(*keys), list(keys), "left_anti").select(*batch.columns)
    return upsert(new, path, keys, buckets=buckets)


def lookup(spark: SparkSession, path: str, wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of the wanted keys; only the buckets that may hold them are opened."""
    rows = manifest(spark, path)
    if not rows:
        raise ValueError(f"no table in {path}")
    asked = stored(wanted.select(*keys).distinct(), "wanted-keys")
    needed = {r[0] for r in asked.select(bucket_of(keys, rows[0]["buckets"])).distinct().collect()}
    found = [r for r in rows if r["bucket"] in needed]
    table = _scan(spark, path, found or [rows[0] | {"rows": 0}])
    return table.join(small(asked, BROADCAST_ROWS), list(keys), "left_semi")
