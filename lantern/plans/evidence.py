"""Queries of coverage, authority lines, bundles and claims."""

from __future__ import annotations

from pyspark.sql import functions as F

from lantern.operators import evidence
from lantern.plans.registry import query, table


@query(
    """
    with h as (
        select source as axis, bool_or(quality = 1) as p, bool_or(doc_id % 11 = 0) as c, bool_or(lang = 'en') as u, bool_or(toxic = 1) as m, bool_or(case when lang = 'de' then doc_id % 2 = 0 end) as t
        from documents left join labels using (doc_id) group by source),
    f as (select axis, coalesce(p, false) as p, coalesce(c, false) as c, coalesce(u, false) as u, coalesce(m, false) as m, coalesce(t, true) as t from h),
    s as (select *, p::int * 0.35 + c::int * 0.35 + u::int * 0.2 + t::int * 0.1 as raw, m and not c as misled from f),
    v as (select *, round(least(case when misled then greatest(raw - 0.25, 0) else raw end, 1.0)::double, 2) as coverage from s)
    select axis, coverage, case when coverage >= 0.8 and p and c and u and t and not misled then 'covered' when coverage >= 0.45 and p then 'partially_covered' else 'unresolved' end as status,
        concat_ws(',', case when not c then 'controlling_rule' end, case when not u then 'current_law_source' end, case when not p then 'primary_source' end, case when not t then 'treaty_text' end) as missing from v"""
)
def axis_coverage(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    flags = rows.select(F.col("source").alias("axis"), (F.col("quality") == 1).alias("primary"), (F.col("doc_id") % 11 == 0).alias("controlling"), (F.col("lang") == "en").alias("current"), (F.col("toxic") == 1).alias("misleading"), F.when(F.col("lang") == "de", F.col("doc_id") % 2 == 0).alias("treaty"))
    return evidence.axis_coverage(flags).withColumn("missing", F.array_join("missing", ","))


@query(
    """
    with c as (select source as issue, doc_id as card_id, case when doc_id % 10 = 0 then 'historical' when coalesce(toxic, 0) = 1 then 'contrary' else 'supporting' end as stance, n_chars::double as score from documents left join labels using (doc_id)),
    k as (select * from c where score >= 500),
    r as (select *, row_number() over (partition by issue, stance order by score desc, card_id) as rn from k)
    select issue, count(*) filter (where stance = 'supporting') as supporting, count(*) filter (where stance = 'contrary') as contrary, count(*) filter (where stance = 'historical') as historical,
        case when count(*) filter (where stance = 'supporting') >= 3 and count(*) filter (where stance = 'contrary') = 0 then 'dominant' when count(*) filter (where stance = 'supporting') > 0 and count(*) filter (where stance = 'contrary') > 0 then 'mixed' when count(*) filter (where stance = 'supporting') = 1 then 'isolated' else 'unknown' end as dominance,
        coalesce(string_agg(card_id::varchar, ',' order by rn) filter (where stance = 'supporting' and rn <= 3), '') as examples
    from r group by issue"""
)
def authority_lines(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    stance = F.when(F.col("doc_id") % 10 == 0, "historical").when(F.coalesce("toxic", F.lit(0)) == 1, "contrary").otherwise("supporting")
    cards = rows.select(F.col("source").alias("issue"), F.col("doc_id").alias("card_id"), stance.alias("stance"), F.col("n_chars").cast("double").alias("score"))
    lines = evidence.authority_lines(cards, least_score=500.0)
    return lines.withColumn("examples", F.array_join(F.transform("examples", lambda x: x.cast("string")), ","))


@query(
    """
    with b as (select l_orderkey as issue, list_sort(list(distinct l_returnflag)) as kinds, count(distinct l_suppkey) as n_sources from lineitem group by l_orderkey)
    select issue, array_to_string(kinds, ',') as kinds, array_to_string(list_filter(['A', 'N', 'R'], lambda x: not list_contains(kinds, x)), ',') as missing, n_sources,
        round(len(kinds) / 3.0 * least(n_sources, 3) / 3.0, 4)::double as confidence from b"""
)
def evidence_bundles(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("issue"), F.col("l_returnflag").alias("kind"), F.col("l_suppkey").alias("source_id"))
    made = evidence.bundles(rows, F.array(F.lit("A"), F.lit("N"), F.lit("R")))
    return made.withColumn("kinds", F.array_join("kinds", ",")).withColumn("missing", F.array_join("missing", ","))


@query(
    """
    select l_orderkey, l_linenumber, concat_ws(',', case when not l_quantity > 1 then 'quantity' end, case when not l_discount <= 0.08 then 'discount' end, case when l_returnflag = 'N' then null when l_linestatus = 'F' then null else 'status' end) as errors from lineitem"""
)
def claim_errors(spark, sf_dir):
    rules = {"quantity": F.col("l_quantity") > 1, "discount": F.col("l_discount") <= 0.08, "status": (F.col("l_returnflag") == "N") | (F.col("l_linestatus") == "F")}
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.array_join(evidence.errors(rules), ",").alias("errors"))


@query(
    """
    select d.doc_id, l.doc_id is not null as selected, coalesce(quality = 1, false) as claimed, coalesce(toxic = 1, false) as written,
        case when l.doc_id is null then 'dropped_before_selected' when quality <> 1 then 'dropped_before_claimed' when toxic <> 1 then 'dropped_before_written' end as drop_reason
    from documents d left join labels l on d.doc_id = l.doc_id"""
)
def stage_lineage(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    stages = {"selected": labels, "claimed": labels.filter("quality = 1"), "written": labels.filter("toxic = 1")}
    return evidence.lineage(table(spark, sf_dir, "documents"), stages, "doc_id")


@query(
    """
    with c as (select o_orderkey as claim_id, o_orderpriority as topic, o_custkey % 25 as domain from orders),
    b as (select n_nationkey as bundle_id, case when n_nationkey % 5 = 0 then '1-URGENT' else n_name end as topic, n_nationkey as domain from nation),
    m as (select claim_id, bundle_id, 0 as how from c join b on c.topic = b.topic
        union all select claim_id, bundle_id, case when contains(c.topic, b.topic) or contains(b.topic, c.topic) then 1 else 2 end from c join b on c.domain = b.domain)
    select claim_id, bundle_id, how from (select *, row_number() over (partition by claim_id order by how, bundle_id) as rn from m) where rn = 1"""
)
def claim_bindings(spark, sf_dir):
    claims = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("claim_id"), F.col("o_orderpriority").alias("topic"), (F.col("o_custkey") % 25).alias("domain"))
    pool = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("bundle_id"), F.when(F.col("n_nationkey") % 5 == 0, "1-URGENT").otherwise(F.col("n_name")).alias("topic"), F.col("n_nationkey").cast("long").alias("domain"))
    return evidence.bind_claims(claims, pool)


@query(
    """
    select event_id, concat_ws(',', case when not coalesce(value >= 10, false) then 'score_below_minimum' end, case when event_type = 'error' then 'no_source' end) as reasons,
        coalesce(value >= 10, false) and event_type <> 'error' as accepted from events"""
)
def accepted_bindings(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.col("value").alias("score"), F.when(F.col("event_type") != "error", F.col("user_id")).alias("source_id"))
    return evidence.accepted(rows, 10.0).select("event_id", F.array_join("reasons", ",").alias("reasons"), "accepted")
