"""Queries of retrieval quality: documents with an item's text are expected, full text finds them."""

from __future__ import annotations

from pyspark.sql import functions as F

from lantern.operators import evaluation, fulltext
from lantern.operators.lineage import stored
from lantern.plans.registry import query, table
from lantern.plans.retrieval import BM25_SQL, lexical

EXPECTED_SQL = "expected as (select item_id as query_id, doc_id from benchmark b join documents d on contains(d.text, b.text))"


def _expected(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))
    return fulltext.containing(docs, queries)


@query(
    f"""
    with {BM25_SQL}, {EXPECTED_SQL},
    r as (select l.query_id, min(case when e.doc_id is not null then rank end) as first_rank from lex l left join expected e on l.query_id = e.query_id and l.doc_id = e.doc_id where rank <= 20 group by l.query_id)
    select query_id, first_rank::int as first_rank, coalesce(first_rank <= 1, false) as hit_at_1, coalesce(first_rank <= 3, false) as hit_at_3, coalesce(first_rank <= 6, false) as hit_at_6 from r"""
)
def hits_at_k(spark, sf_dir):
    rank = evaluation.first_match(lexical(spark, sf_dir, 20), _expected(spark, sf_dir))
    return rank.select("query_id", "first_rank", *evaluation.hits_at(F.col("first_rank")))


@query(
    f"""
    with {BM25_SQL}, {EXPECTED_SQL},
    r as (select l.query_id, min(case when e.doc_id is not null then rank end) as p, min(case when e.doc_id is not null and rank <= 2 then rank end) as f from lex l left join expected e on l.query_id = e.query_id and l.doc_id = e.doc_id where rank <= 40 group by l.query_id)
    select query_id, p::int as pool_rank, f::int as final_rank, p is not null and f is null as lost from r"""
)
def lost_in_rerank(spark, sf_dir):
    pool = stored(lexical(spark, sf_dir, 40), "pool")
    return evaluation.lost_in_rerank(pool, pool.filter("rank <= 2"), _expected(spark, sf_dir))


@query(
    f"""
    with {BM25_SQL}, {EXPECTED_SQL},
    a as (select query_id, list(doc_id order by rank) as actual from lex where rank <= 10 group by query_id),
    x as (select query_id, list(distinct doc_id) as expected from expected group by query_id)
    select query_id, round(len(list_intersect(actual[1:5], expected)) / len(expected)::double, 6) as recall_at_5, case when expected is not null then round(len(list_intersect(actual[1:5], expected)) / len(actual[1:5])::double, 6) end as precision_at_5
    from a left join x using (query_id)"""
)
def recall_and_precision(spark, sf_dir):
    results = lexical(spark, sf_dir, 10).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"]).alias("actual"))
    wanted = _expected(spark, sf_dir).groupBy("query_id").agg(F.collect_set("doc_id").alias("expected"))
    e, a = F.col("expected"), F.col("actual")
    return results.join(wanted, "query_id", "left").select("query_id", F.round(evaluation.recall_at(e, a, 5), 6).alias("recall_at_5"), F.round(evaluation.precision_at(e, a, 5), 6).alias("precision_at_5"))


@query(
    """
    with v as (select event_type as variant, case when event_id % 7 <> 0 then value end as m, (event_id * 37 % 1000)::bigint as latency from events),
    s as (select variant, round(avg(m), 6) as mean_score, list_sort(list(latency)) as l from v group by variant)
    select variant, mean_score, l[1 + round_even((len(l) - 1) * 0.5, 0)::int] as p50, l[1 + round_even((len(l) - 1) * 0.95, 0)::int] as p95 from s"""
)
def variant_metrics(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("variant"), F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("score"), (F.col("event_id") * 37 % 1000).alias("latency"))
    return evaluation.by_variant(rows, ["score"], "latency")


@query(
    """
    with v as (select event_type as variant, value as score, (event_id % 10)::double as depth from events),
    u as (select variant, 'score' as metric, score as x from v union all select variant, 'depth', depth from v)
    select variant, metric, round(avg(x), 6) as mean, count(x) as n from u group by all"""
)
def metric_means(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("variant"), F.col("value").alias("score"), (F.col("event_id") % 10).cast("double").alias("depth"))
    return evaluation.unpivoted_means(rows, ["score", "depth"])


@query("select source, avg((quality = 1)::int::double) as quality_rate, avg((toxic = 1)::int::double) as toxic_rate, count(*) as n from documents join labels using (doc_id) group by source")
def recognition_rates(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    rate = lambda c: F.avg((F.col(c) == 1).cast("double"))
    return rows.groupBy("source").agg(rate("quality").alias("quality_rate"), rate("toxic").alias("toxic_rate"), F.count("*").alias("n"))


@query(
    """
    with c as (select user_id, count(*) as candidates, count(*) filter (where value > 20) as filtered, count(*) filter (where event_type = 'purchase') as selected, 0 as errors from events group by user_id)
    select user_id, case when errors > 0 then 'backend_error' when selected > 0 then 'results' when candidates = 0 then 'no_candidates' when filtered = 0 then 'all_filtered' else 'selection_empty' end as cause from c"""
)
def empty_result_causes(spark, sf_dir):
    from lantern.operators.inventory import root_cause

    counts = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("candidates"), F.count_if(F.col("value") > 20).alias("filtered"), F.count_if(F.col("event_type") == "purchase").alias("selected"))
    return counts.select("user_id", root_cause(F.col("candidates"), F.col("filtered"), F.col("selected"), F.lit(0)).alias("cause"))


@query(
    """
    with s as (
        select 0 as position, 'candidates' as stage, count(*) as n, max(n_chars) as longest from documents
        union all select 1, 'language', count(*), max(n_chars) from documents where lang in ('en', 'de')
        union all select 2, 'length', count(*), max(n_chars) from documents where lang in ('en', 'de') and n_chars between 200 and 20000
        union all select 3, 'unlabelled', count(*), max(n_chars) from documents where lang in ('en', 'de') and n_chars between 200 and 20000 and doc_id not in (select doc_id from labels))
    select position, stage, n as rows, lag(n) over (order by position) - n as dropped, longest::double as longest from s"""
)
def funnel_counts(spark, sf_dir):
    from lantern.operators.funnel import funnel

    known = table(spark, sf_dir, "labels").select("doc_id")
    stages = {
        "language": lambda df: df.filter("lang in ('en', 'de')"),
        "length": lambda df: df.filter("n_chars between 200 and 20000"),
        "unlabelled": lambda df: df.join(known, "doc_id", "left_anti"),
    }
    return funnel(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), stages, {"longest": F.max("n_chars")})[1]
