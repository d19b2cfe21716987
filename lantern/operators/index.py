"""A kept inverted index: postings in buckets of stems, refreshed by fingerprint and searched without the texts.

An index is a folder of Parquet tables::

    postings/generation=G/bucket=B   (stem, term, key, length, w), a generation to each refresh
    documents/<version>              (key, fingerprint, length, generation), one row a document
    dead/<version>                   (key, generation) of postings that a later refresh replaced or removed
    versions                         one row a version; the last one is what readers see

A refresh writes the postings of new and changed documents only, then the two small tables, and its row of
``versions`` last, so that readers see all of a refresh or nothing of it; what a failed one left is overwritten by the next. One refresh may run at a
time.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lantern.functions.text import fingerprint
from lantern.operators import fulltext
from lantern.operators.lineage import small, stored

#: Folders of postings; a search opens those of its stems.
BUCKETS = 64
#: Stems of a search that are sent to the scan as values, so that it skips row groups without them.
STEMS_IN_SCAN = 200
BROADCAST_ROWS = 500_000

_VERSIONS = "version long, documents string, dead string, generations array<long>, n long, total_length long, key string, index_version string"


@dataclass(frozen=True)
class Snapshot:
    """What one version of an index consists of."""

    root: str
    version: int
    documents: str
    dead: str | None
    generations: tuple[int, ...]
    n: int
    total_length: int
    key: str
    index_version: str


def snapshot(spark: SparkSession, root: str) -> Snapshot | None:
    """The last version of the index in a folder; None if there is none yet."""
    try:
        rows = spark.read.schema(_VERSIONS).parquet(f"{root}/versions")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    last = rows.orderBy(F.desc("version")).limit(1).collect()
    return Snapshot(root, **{k: tuple(v) if isinstance(v, list) else v for k, v in last[0].asDict().items()}) if last else None


def _bucket(stem):
    return F.pmod(F.xxhash64(stem), F.lit(BUCKETS)).cast("int")


def _documents(spark: SparkSession, at: Snapshot) -> DataFrame:
    return spark.read.parquet(f"{at.root}/{at.documents}")


def _postings(spark: SparkSession, root: str, key: T.StructField) -> DataFrame:
    kinds = {"length": T.IntegerType(), "term": T.StringType(), "w": T.DoubleType(), "stem": T.StringType(), "generation": T.LongType(), "bucket": T.IntegerType()}
    return spark.read.schema(T.StructType([key, *[T.StructField(k, t) for k, t in kinds.items()]])).parquet(f"{root}/postings")


def postings(spark: SparkSession, at: Snapshot) -> DataFrame:
    """(bucket, stem, term, key, length, w) of the version's documents. Dead rows are few, and broadcast if so."""
    rows = _postings(spark, at.root, _documents(spark, at).schema[at.key]).filter(F.col("generation").isin([*at.generations]))
    if at.dead:
        rows = rows.join(small(spark.read.parquet(f"{at.root}/{at.dead}"), BROADCAST_ROWS), [at.key, "generation"], "left_anti")
    return rows.drop("generation")


def changes(documents: DataFrame, at: Snapshot | None, fields: Mapping[str, float], key: str = "doc_id", index_version: str = "v1") -> DataFrame:
    """(key, fingerprint, old_generation, status) of documents that are new, changed or gone, as a written table.

    A document's fingerprint changes with its fields, their weights or the version of the index. Rows without a key aren't
    indexed; of rows that repeat a key, the one with the greatest fingerprint counts.
    """
    now = documents.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max(_fingerprint(fields, index_version)).alias("fingerprint"))
    if at is None:
        return stored(now.select(key, "fingerprint", F.lit(None).cast("long").alias("old_generation"), F.lit("new").alias("status")), "index-changes")
    old = _documents(documents.sparkSession, at).select(F.col(key).alias("_key"), F.col("fingerprint").alias("_old"), "generation")
    both = now.join(old, F.col(key) == F.col("_key"), "full_outer").filter(~F.col("fingerprint").eqNullSafe(F.col("_old")))
    status = F.when(F.col("_key").isNull(), "new").when(F.col(key).isNull(), "gone").otherwise("changed")
    return stored(both.select(F.coalesce(key, "_key").alias(key), "fingerprint", F.col("generation").alias("old_generation"), status.alias("status")), "index-changes")


def _fingerprint(fields: Mapping[str, float], index_version: str):
    content = F.to_json(F.struct(*[F.col(c).cast("string").alias(f"{c} {w}") for c, w in fields.items()]))
    return fingerprint(F.sha2(content.cast("binary"), 256), index_version)


def refresh(documents: DataFrame, root: str, fields: Mapping[str, float], key: str = "doc_id", index_version: str = "v1") -> DataFrame:
    """Bring the index in a folder up to the documents; returns (key, fingerprint, old_generation, status) of what changed.

    Only new and changed documents are tokenised; if none are, and none is gone, no version is written. The fingerprints
    of all documents are compared, which reads their texts once.
    """
    spark = documents.sparkSession
    at = snapshot(spark, root)
    changed = changes(documents, at, fields, key, index_version)
    if at is not None and changed.isEmpty():
        return changed
    version = at.version + 1 if at else 1
    wanted = changed.filter("status <> 'gone'").select(F.col(key).alias("_key"), F.col("fingerprint").alias("_fingerprint"))
    marked = documents.withColumn("_own", _fingerprint(fields, index_version))
    fresh = marked.join(small(wanted, BROADCAST_ROWS), (F.col(key) == F.col("_key")) & (F.col("_own") == F.col("_fingerprint"))).dropDuplicates([key])
    _write_postings(fulltext.counted(fresh, fields, key), f"{root}/postings/generation={version}", key)
    own = _postings(spark, root, documents.schema[key]).filter((F.col("generation") == version) & (F.col("term") == "")).select(key, "length")
    made = own.join(changed.select(key, "fingerprint"), key).select(key, "fingerprint", "length", F.lit(version).cast("long").alias("generation"))
    if at is None:
        kept, dead = made, None
    else:
        kept = _documents(spark, at).join(changed.select(key), key, "left_anti").unionByName(made)
        dead = changed.filter("old_generation is not null").select(key, F.col("old_generation").alias("generation"))
        if at.dead:
            dead = dead.unionByName(spark.read.parquet(f"{root}/{at.dead}"))
    _commit(spark, root, version, kept, dead, (*(at.generations if at else ()), version), key, index_version)
    return changed


def _write_postings(terms: DataFrame, path: str, key: str) -> None:
    """Postings by buckets of stems, sorted by term; a bucket with a frequent stem is written by several tasks."""
    terms = terms.withColumn("stem", F.left("term", F.lit(fulltext.LEAST)))
    rows = terms.withColumn("bucket", _bucket("stem")).hint("rebalance", "bucket").sortWithinPartitions("bucket", "term")
    rows.write.mode("overwrite").partitionBy("bucket").parquet(path)


def _commit(spark: SparkSession, root: str, version: int, kept: DataFrame, dead: DataFrame | None, generations: tuple[int, ...], key: str, index_version: str) -> None:
    kept.write.mode("overwrite").parquet(f"{root}/documents/{version}")
    if dead is not None:
        dead.write.mode("overwrite").parquet(f"{root}/dead/{version}")
    n, total = spark.read.parquet(f"{root}/documents/{version}").agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    row = (version, f"documents/{version}", f"dead/{version}" if dead is not None else None, [*generations], n, total, key, index_version)
    spark.createDataFrame([row], _VERSIONS).coalesce(1).write.mode("append").parquet(f"{root}/versions")


def compact(spark: SparkSession, root: str) -> Snapshot:
    """Write the live postings as one generation, without those that later refreshes replaced."""
    at = snapshot(spark, root)
    if at is None or at.dead is None and len(at.generations) == 1:
        return at
    version = at.version + 1
    rows = postings(spark, at).hint("rebalance", "bucket").sortWithinPartitions("bucket", "term")
    rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/postings/generation={version}")
    kept = _documents(spark, at).withColumn("generation", F.lit(version).cast("long"))
    _commit(spark, root, version, kept, None, (version,), at.key, at.index_version)
    return snapshot(spark, root)


def vacuum(spark: SparkSession, root: str) -> list[str]:
    """Delete what the last version doesn't read, once no search of an older one runs; returns the folders."""
    at = snapshot(spark, root)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    used = {at.documents, at.dead, *(f"postings/generation={g}" for g in at.generations)}
    gone = []
    for table in ("documents", "dead", "postings"):
        path = jvm.org.apache.hadoop.fs.Path(f"{root}/{table}")
        files = path.getFileSystem(conf)
        for x in files.listStatus(path) if files.exists(path) else []:
            name = f"{table}/{x.getPath().getName()}"
            if x.isDirectory() and name not in used:
                files.delete(x.getPath(), True)
                gone.append(name)
    return sorted(gone)


def hits(spark: SparkSession, at: Snapshot, tokens: DataFrame) -> DataFrame:
    """(token, key, length, weighted_tf) of the wanted tokens as prefixes; only the buckets of their stems are opened."""
    left = tokens.select("token", F.left("token", F.lit(fulltext.LEAST)).alias("stem")).distinct()
    stems = left.select("stem").distinct()
    buckets = [r[0] for r in stems.select(_bucket("stem")).distinct().collect()]  # BUCKETS at most
    few = [r[0] for r in stems.limit(STEMS_IN_SCAN + 1).collect()]
    rows = postings(spark, at).filter(F.col("bucket").isin(buckets))
    if len(few) <= STEMS_IN_SCAN:
        rows = rows.filter(F.col("stem").isin(few))
    return fulltext.matches(rows, small(stored(left, "wanted-stems"), BROADCAST_ROWS), at.key)


def search(queries: DataFrame, root: str, limit: int, query: str = "query_id", column: str = "text", most: int = 24) -> DataFrame:
    """(query, key, score, rank): as ``fulltext.search`` over the indexed documents, from the index alone.

    The number of documents and their mean length stand in the version; an empty index finds nothing.
    """
    spark = queries.sparkSession
    at = snapshot(spark, root)
    if at is None:
        raise ValueError(f"no index in {root}")
    wanted = stored(fulltext.terms_of(queries, query, column, most).select(query, "token").distinct(), "wanted")
    found = stored(hits(spark, at, wanted.select("token")), "hits")
    total = spark.createDataFrame([(float(at.n), at.total_length / at.n if at.n else 0.0)], "n double, mean_length double")
    return fulltext.ranked(fulltext.bm25(found, wanted, query, at.key, total=total), query, at.key, limit=limit)
