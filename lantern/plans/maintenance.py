"""Queries of incremental maintenance and the ledger."""

from __future__ import annotations

from pyspark.sql import functions as F

from lantern.functions.text import fingerprint
from lantern.operators import embedding, incremental, inventory
from lantern.plans.registry import query, table


@query("select doc_id, sha256(sha256(text) || chr(0) || 'v2') as fingerprint from documents")
def index_fingerprints(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", fingerprint(F.sha2(F.col("text").cast("binary"), 256), "v2").alias("fingerprint"))


@query("select doc_id from documents left join labels using (doc_id) where coalesce(quality, 0) = 0")
def stale_documents(spark, sf_dir):
    """The stored index has the labelled documents, those of low quality in an older version."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    own = lambda v: fingerprint(F.sha2(F.col("text").cast("binary"), 256), v)
    stored = docs.join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", F.when(F.col("quality") == 0, own("v1")).otherwise(own("v2")).alias("fingerprint"))
    return incremental.stale(docs, stored, "v2").select("doc_id")


@query("select case when l.doc_id is null then source else 'rebuilt' end as source, count(*) as n from documents d left join labels l on d.doc_id = l.doc_id group by 1")
def replaced_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    rebuilt = docs.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi").withColumn("source", F.lit("rebuilt"))
    return incremental.replaced(docs, rebuilt).groupBy("source").agg(F.count("*").alias("n"))


@query("select source, count(*) as n_missing from documents where doc_id not in (select doc_id from labels) group by source")
def backfill_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return incremental.missing(docs, table(spark, sf_dir, "labels"), ["doc_id"]).groupBy("source").agg(F.count("*").alias("n_missing"))


@query("select doc_id, (('0x' || substr(sha256(doc_id::varchar), 1, 16))::uhugeint % 12)::int as shard from documents")
def hash_shards(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", incremental.shard(F.col("doc_id"), 12).alias("shard"))


@query("select doc_id, case when toxic = 1 then 'lang,source' else 'lang' end as changed from documents join labels using (doc_id)")
def metadata_changes(spark, sf_dir):
    old = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    rows = old.join(table(spark, sf_dir, "labels"), "doc_id", "left")
    new = rows.select("doc_id", F.when(F.col("toxic").isNotNull(), "xx").otherwise(F.col("lang")).alias("lang"), F.when(F.col("toxic") == 1, F.lit(None)).otherwise(F.col("source")).alias("source"), "n_chars")
    return incremental.changed(old, new, "doc_id", ["lang", "source", "n_chars"]).select("doc_id", F.array_join("changed", ",").alias("changed"))


@query(
    """
    with s as (select unnest(generate_series((select min(o_orderdate)::date from orders), (select max(o_orderdate)::date from orders), interval 1 day))::date as day)
    select day from s where day not in (select o_orderdate::date from orders where o_orderpriority = '1-URGENT')"""
)
def missing_days(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    lo, hi = orders.agg(F.min(F.to_date("o_orderdate")), F.max(F.to_date("o_orderdate"))).first()
    done = orders.filter("o_orderpriority = '1-URGENT'").select(F.to_date("o_orderdate").alias("day"))
    return incremental.missing_days(done, F.lit(lo), F.lit(hi))


@query("select user_id, sum(case when event_type = 'purchase' then -1 else 1 end * (event_id % 100)) ::bigint as balance from events group by user_id")
def ledger_balances(spark, sf_dir):
    amount = F.when(F.col("event_type") == "purchase", -1).otherwise(1) * (F.col("event_id") % 100)
    return inventory.balances(table(spark, sf_dir, "events").withColumn("amount", amount), "user_id", "amount")


@query(
    """
    with l as (select user_id as account, sum(event_id % 100)::bigint as balance from events group by user_id)
    select coalesce(c_custkey, account) as account, c_name as name, c_custkey is not null as has_profile, coalesce(balance, 0)::bigint as balance from customer full outer join l on c_custkey = account"""
)
def profile_report(spark, sf_dir):
    profiles = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("account"), F.col("c_name").alias("name"))
    ledger = table(spark, sf_dir, "events").select(F.col("user_id").alias("account"), (F.col("event_id") % 100).alias("amount"))
    return inventory.profiles_with_balances(profiles, ledger, "account", "amount").select("account", "name", "has_profile", "balance")


@query("select count(*) filter (where label = 0) as indexed, count(*) filter (where label <> 0) as skipped from embeddings")
def embedding_load_report(spark, sf_dir):
    return embedding.load_report(_index(spark, sf_dir, "label <> 0", 1, "a"), _index(spark, sf_dir, "true", 2, "a"))


def _index(spark, sf_dir, condition, at, mark):
    rows = table(spark, sf_dir, "embeddings").filter(condition)
    return rows.select(F.col("vec_id").alias("item_id"), F.lit("hash").alias("model"), F.lit(64).alias("dimensions"), F.concat(F.lit(mark), F.col("label").cast("string")).alias("content_hash"), F.lit(f"load {at}").alias("metadata"), F.lit(at).alias("loaded_at"))


@query(
    """
    select vec_id as item_id, 'a' || label as content_hash, case when label % 2 = 0 then 'load 1' else 'load 2' end as metadata, label % 2 = 1 as is_current from embeddings
    union all select vec_id, 'b' || label, 'load 2', true from embeddings where label % 2 = 0"""
)
def embedding_versions(spark, sf_dir):
    """Half of the items come again unchanged, half with a new content."""
    incoming = _index(spark, sf_dir, "label % 2 = 1", 2, "a").union(_index(spark, sf_dir, "label % 2 = 0", 2, "b"))
    return embedding.upsert_versions(_index(spark, sf_dir, "true", 1, "a"), incoming).select("item_id", "content_hash", "metadata", "is_current")


@query("with c as (select *, row_number() over (partition by user_id order by ts, event_id) as rn from events where event_type <> 'error') select event_id, user_id, event_type from c where rn = 1")
def first_wins(spark, sf_dir):
    rows = table(spark, sf_dir, "events").filter("event_type <> 'error'")
    return incremental.first_wins(rows, "user_id", ["ts", "event_id"]).select("event_id", "user_id", "event_type")


@query("select date_trunc('day', ts) as \"start\", event_type, count(*) as n from events group by all")
def streamed_counts(spark, sf_dir):
    """The windowed counts of the stream, run here over the whole table as a batch."""
    from lantern.streaming.ingest import windowed_counts

    return windowed_counts(table(spark, sf_dir, "events"), "ts", "event_type", "1 day", "1 hour")
