"""Readers: JSON lines, several corpora, manifests, dictionaries, evaluation cases, pages of HTML."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Superset of the fields of all record kinds; a file may lack any of them.
RECORD = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("document_id", "source", "source_type", "source_subtype", "authority", "jurisdiction", "act_title", "publication", "legal_state_date", "published_date", "subject", "signature", "category", "tax_domain", "source_url", "content_text", "content_html", "content_sha256", "question_text", "facts_text")]
    + [T.StructField(n, T.ArrayType(T.StringType())) for n in ("legal_provisions", "issues", "law_tags", "keywords", "tax_domains")]
    + [T.StructField("pre_chunked", T.BooleanType())]
    + [T.StructField("provision_units", T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("citation", "text", "article", "unit_type")])))]
)


def records(spark: SparkSession, paths: Sequence[str], schema: T.StructType = RECORD) -> DataFrame:
    """JSON lines with their file; blank lines are skipped."""
    return spark.read.schema(schema).json(list(paths)).withColumn("source_file", F.col("_metadata.file_path"))


def tolerant_records(spark: SparkSession, path: str, schema: T.StructType = RECORD) -> tuple[DataFrame, DataFrame]:
    """The valid records, and the lines that aren't JSON."""
    kept = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    lines = spark.read.text(path).filter(F.trim("value") != "")
    parsed = lines.select(F.from_json("value", kept, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r"), "value")
    return parsed.filter("r._corrupt is null").select("r.*").drop("_corrupt"), parsed.filter("r._corrupt is not null").select(F.col("value").alias("line"))


def corpora(spark: SparkSession, sources: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Several (path, expected type) sources by id, in stable order; a path that occurs again is read once."""
    seen, parts = set(), []
    for source_id, (path, kind) in sources.items():
        if path not in seen:
            seen.add(path)
            parts.append(records(spark, [path]).withColumn("source_id", F.lit(source_id)).withColumn("expected_type", F.lit(kind)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def manifest_hash(spark: SparkSession, paths: Sequence[str]) -> str:
    """SHA-256 over the names and contents of files; each file is hashed where it is read."""
    files = spark.read.format("binaryFile").load(list(paths)).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("hash"))
    row = files.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "hash"))), lambda x: F.concat(x["name"], F.lit(":"), x["hash"])), "\n").cast("binary"), 256).alias("h"))
    return row.first()["h"]


def cases(spark: SparkSession, path: str, schema: T.StructType, required: Sequence[str]) -> DataFrame:
    """Evaluation cases of a JSON list; an id that isn't unique, or a required field that is empty, is an error."""
    rows = spark.read.schema(schema).json(path, multiLine=True)
    empty = F.lit(False)
    for c in required:
        kind = schema[c].dataType
        empty = empty | F.col(c).isNull() | ((F.size(c) == 0) if isinstance(kind, T.ArrayType) else (F.trim(F.col(c).cast("string")) == ""))
    bad = rows.groupBy("id").agg(F.count("*").alias("n"), F.bool_or(empty).alias("empty")).filter("n > 1 or empty").select("id").take(5)
    if bad:
        raise ValueError(f"cases that repeat an id or lack a field: {[r[0] for r in bad]}")
    return rows


def dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(id, kind, phrase, confidence) of a dictionary whose entries have arrays of phrases by kind."""
    rows = spark.read.json(path, multiLine=True)
    kinds = [f.name for f in rows.schema if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StringType)]
    confidence = F.coalesce(F.col("confidence").cast("double"), F.lit(1.0)) if "confidence" in rows.columns else F.lit(1.0)
    parts = [rows.select("id", F.lit(k).alias("kind"), F.explode(k).alias("phrase"), confidence.alias("confidence")) for k in kinds]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.filter(F.trim("phrase") != "")


def jdbc_table(spark: SparkSession, url: str, name: str, key: str, lower: int, upper: int, parts: int) -> DataFrame:
    """A table of a relational store, read in ranges of a numeric key; filters and columns are pushed down."""
    if not name.replace("_", "").isalnum():
        raise ValueError("a table name has letters, digits and underscores only")
    return spark.read.jdbc(url, name, column=key, lowerBound=lower, upperBound=upper, numPartitions=parts)
