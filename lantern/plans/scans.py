"""Queries of scans, sinks and small predicates: tables are written as JSON lines and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lantern.functions import calculations as C
from lantern.functions import text as X
from lantern.operators import selection, temporal
from lantern.operators.lineage import reserved
from lantern.plans.registry import query, table
from lantern.sources import ordered, readers, writers


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.to_json(F.struct(F.col("doc_id").cast("string").alias("document_id"), F.col("source"), F.col("lang").alias("source_type"), F.col("text").alias("content_text"))).alias("value"))


def _lines(df: DataFrame, path: str) -> str:
    """Lines in the order of their documents, a range to each file, as many as the rows need."""
    df.repartitionByRange("doc_id").sortWithinPartitions("doc_id").select("value").write.text(path)
    return path


@query("select doc_id::varchar as document_id, source, sha256(text) as digest from documents")
def jsonl_records(spark, sf_dir):
    """Every record is followed by a blank line, which is no record."""
    rows = _records(spark, sf_dir).withColumn("value", F.explode(F.array("value", F.lit("  "))))
    found = readers.records(spark, [_lines(rows, reserved(spark, "records"))])
    return found.select("document_id", "source", F.sha2(F.col("content_text").cast("binary"), 256).alias("digest"))


@query(
    """
    select doc_id::varchar as document_id, row_number() over (order by doc_id) - 1 as first_to_last, row_number() over (order by doc_id desc) - 1 as last_to_first from documents"""
)
def jsonl_ordinals(spark, sf_dir):
    path = _lines(_records(spark, sf_dir), reserved(spark, "records"))
    up = ordered.ordered_records(spark, [path]).select("document_id", F.col("ordinal").alias("first_to_last"))
    down = ordered.ordered_records(spark, [path], reverse=True).select("document_id", F.col("ordinal").alias("last_to_first"))
    return up.join(down, "document_id")


@query("select case when doc_id % 7 = 3 then 'invalid' else 'valid' end as kind, count(*) as n, count(distinct case when doc_id % 7 <> 3 then doc_id end) as ids from documents group by 1")
def tolerant_jsonl(spark, sf_dir):
    rows = _records(spark, sf_dir).withColumn("value", F.when(F.col("doc_id") % 7 == 3, F.concat(F.lit("{broken "), "value")).otherwise(F.col("value")))
    valid, invalid = readers.tolerant_records(spark, _lines(rows, reserved(spark, "records")))
    counted = valid.agg(F.lit("valid").alias("kind"), F.count("*").alias("n"), F.countDistinct("document_id").alias("ids"))
    return counted.union(invalid.agg(F.lit("invalid").alias("kind"), F.count("*").alias("n"), F.lit(0).cast("long").alias("ids"))).filter("n > 0")


@query(
    """
    select case when lang = 'en' then 'english' else 'others' end as source_id, case when lang = 'en' then 'ruling' else 'statute' end as expected_type, count(*) as n, count(distinct source) as n_sources from documents group by 1, 2"""
)
def corpora_by_source(spark, sf_dir):
    """Two corpora by name; a third name for the path of the first is read no second time."""
    docs, lang = _records(spark, sf_dir), table(spark, sf_dir, "documents").select("doc_id", "lang")
    both = docs.join(lang, "doc_id")
    one, two = (_lines(both.filter(c), reserved(spark, "corpus")) for c in ("lang = 'en'", "lang <> 'en'"))
    found = readers.corpora(spark, {"english": (one, "ruling"), "others": (two, "statute"), "again": (one, "ruling")})
    return found.groupBy("source_id", "expected_type").agg(F.count("*").alias("n"), F.countDistinct("source").alias("n_sources"))


@query("select l_returnflag as flag, 2 * count(*) as n, 2 * sum(l_quantity)::double as quantity from lineitem group by 1")
def appended_records(spark, sf_dir):
    path = reserved(spark, "appended")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_quantity").alias("quantity"))
    for _ in range(2):
        writers.append_records(rows, path, "json")
    back = spark.read.schema("flag string, quantity double").json(path)
    return back.groupBy("flag").agg(F.count("*").alias("n"), F.sum("quantity").alias("quantity"))


@query("select o_orderkey from orders where o_orderstatus = 'O' and o_orderdate::date <= date '1997-01-01' and (o_orderkey % 3 = 0 or date '1997-01-01' <= o_orderdate::date + 500)")
def active_provisions(spark, sf_dir):
    start = F.to_date("o_orderdate")
    status, end = F.when(F.col("o_orderstatus") == "O", "active").otherwise("repealed"), F.when(F.col("o_orderkey") % 3 != 0, F.date_add(start, 500))
    return table(spark, sf_dir, "orders").filter(temporal.active_on(status, start, end, F.to_date(F.lit("1997-01-01")))).select("o_orderkey")


@query(
    """
    with p as (select p_partkey, 'art. ' || (p_size % 5) as required, 'art. ' || (p_partkey % 5) || case p_partkey % 3 when 0 then '' when 1 then ' ust. 1' else '1' end as found from part)
    select p_partkey, case when found = required then 2 when starts_with(found, required || ' ') then 1 else 0 end as specificity from p"""
)
def reference_specificity(spark, sf_dir):
    k, suffix = F.col("p_partkey"), F.when(F.col("p_partkey") % 3 == 0, "").when(F.col("p_partkey") % 3 == 1, " ust. 1").otherwise("1")
    required, found = F.concat(F.lit("art. "), (F.col("p_size") % 5).cast("string")), F.concat(F.lit("art. "), (k % 5).cast("string"), suffix)
    return table(spark, sf_dir, "part").select("p_partkey", X.match_specificity(required, found).alias("specificity"))


@query("select l_orderkey, l_linenumber from lineitem qualify row_number() over (partition by l_orderkey order by l_quantity desc, l_linenumber) <= 2")
def capped_per_document(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return selection.capped(lines, ["l_orderkey"], [F.desc("l_quantity"), "l_linenumber"], 2).select("l_orderkey", "l_linenumber")


@query("select o_custkey, o_orderkey from orders qualify row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) = 1")
def first_per_document(spark, sf_dir):
    return selection.first_by(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


@query("select p_partkey, 'src' || (p_partkey % 4) || ':' || coalesce(nullif(regexp_replace(regexp_replace(lower(p_type), '[^0-9a-z]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'provision') as slug from part")
def citation_slugs(spark, sf_dir):
    source = F.concat(F.lit("src"), (F.col("p_partkey") % 4).cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", X.citation_slug(source, F.col("p_type")).alias("slug"))


@query("select o_orderkey, case o_orderkey % 4 when 0 then o_orderstatus || ',' || o_orderpriority else '' end as parsed from orders")
def json_lists(spark, sf_dir):
    """A list, text that is no JSON, an object, and nothing."""
    given = F.to_json(F.array("o_orderstatus", "o_orderpriority"))
    k = F.col("o_orderkey") % 4
    value = F.when(k == 0, given).when(k == 1, F.lit("[broken")).when(k == 2, F.lit('{"a": 1}'))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(X.json_list(value), ",").alias("parsed"))


@query(
    """
    select o_orderkey, case o_orderkey % 4 when 0 then o_orderdate::date when 1 then o_orderdate::date end as day from orders"""
)
def iso_dates(spark, sf_dir):
    """A date, a date with more after it, one that no calendar has, and words."""
    day, k = F.date_format(F.to_date("o_orderdate"), "yyyy-MM-dd"), F.col("o_orderkey") % 4
    value = F.when(k == 0, F.concat(F.lit(" "), day)).when(k == 1, F.concat(day, F.lit("T10:00:00"))).when(k == 2, F.lit("2024-02-31")).otherwise(F.concat(F.lit("on "), day))
    return table(spark, sf_dir, "orders").select("o_orderkey", C.iso_date(value).alias("day"))
