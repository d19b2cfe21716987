"""Queries of judgments, rules, sources and statutes for the benchmark items, and of the whole local ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lantern.functions import text as X
from lantern.operators import authority, fusion, ranking, temporal
from lantern.plans.registry import query, table
from lantern.plans.retrieval import BM25_SQL, TOKEN, lexical

#: The candidates of an item: its 30 best documents.
POOL_SQL = f"""
    {BM25_SQL},
    pool as (
        select query_id, q.text as query_text, d.doc_id, d.text, d.lang, d.source, d.n_chars, l.score, l.rank,
            case query_id % 4 when 0 then []::varchar[] when 1 then ['EN'] when 2 then ['FR', 'DE'] else ['ES'] end as asked_domains, [upper(d.lang)] as own_domains
        from lex l join documents d using (doc_id) join benchmark q on q.item_id = query_id where l.rank <= 30),
    asked as (select query_id, list(token order by p) as words from qd where p <= 24 group by query_id)"""


def _pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))
    n = F.col("query_id") % 4
    domains = F.when(n == 0, F.array().cast("array<string>")).when(n == 1, F.array(F.lit("EN"))).when(n == 2, F.array(F.lit("FR"), F.lit("DE"))).otherwise(F.array(F.lit("ES")))
    return lexical(spark, sf_dir, 30).join(docs, "doc_id").join(items, "query_id").withColumn("asked_domains", domains).withColumn("own_domains", F.array(F.upper("lang")))


@query(
    f"""
    with {POOL_SQL},
    rows0 as (select query_id, doc_id, doc_id // 4 as document_id, rank as r0, (n_chars % 97) / 97.0 as semantic, case when query_id % 3 <> 0 then (doc_id * 37) % 101 end as crs, not (lang = 'fr') or query_id % 5 = 0 as keep,
        0.25 * (n_chars % 4) as extra, case when lang = 'en' then 0.2 else 0.6 end as w from pool),
    kept as (select *, bool_or(keep) over (partition by query_id) as any_kept from rows0),
    ranks as (select *, row_number() over (partition by query_id order by r0, doc_id) as lexi, row_number() over (partition by query_id order by semantic desc, doc_id) as sem from kept where keep or not any_kept),
    pre as (select *, round((0.65 / (20 + lexi) + 0.35 / (20 + sem) + extra)::double, 6) as preliminary from ranks),
    fst as (select *, row_number() over (partition by query_id order by preliminary desc, doc_id) as first from pre),
    snd as (select *, count(*) filter (first <= 12) over (partition by query_id) as n, row_number() over (partition by query_id order by (first <= 12) desc, crs desc, doc_id) as second from fst),
    mix as (select *, case when crs is null then preliminary when first <= 12 then round(((1 - w) * preliminary + w * (1 - (second - 1) / greatest(n - 1, 1)::double))::double, 6) end as blended from snd),
    plc as (select *, row_number() over (partition by query_id order by blended desc nulls last, case when crs is null then first else second end) as place from mix),
    lead as (select query_id, document_id as leader from plc where lexi = 1),
    win as (select query_id, document_id, place, count(*) over (partition by query_id, document_id) as same from plc where place <= 6),
    state as (select query_id, bool_or(document_id = leader) as held, coalesce(max(case when same > 1 then place end), 6) as victim from win join lead using (query_id) group by query_id),
    ord as (select plc.*, case when held then place when lexi = 1 then victim when place = victim then 6.5 else place end as o from plc join state using (query_id) where blended is not null or (lexi = 1 and not held)),
    fin as (select *, row_number() over (partition by query_id order by o) as rank, count(*) over (partition by query_id) as total from ord),
    one as (select *, row_number() over (partition by query_id, document_id order by rank) = 1 as lone from fin),
    div as (select *, sum(lone::int) over (partition by query_id order by rank) as nth from one),
    pos as (select *, row_number() over (partition by query_id order by case when total <= 6 or (lone and nth <= 6) then 0 else 1 end, rank) as position from div)
    select query_id, doc_id, document_id, preliminary, blended, position::int as position from pos where position <= 6"""
)
def local_candidates_ranked(spark, sf_dir):
    """Four documents in a row count as chunks of one; a third of the items has no second ranker."""
    rows = _pool(spark, sf_dir).withColumn("document_id", F.expr("doc_id div 4")).withColumn("semantic", F.col("n_chars") % 97 / 97.0)
    rows = rows.withColumn("cross", F.when(F.col("query_id") % 3 != 0, F.col("doc_id") * 37 % 101)).withColumn("procedural", F.col("lang") == "fr").withColumn("asks_procedure", F.col("query_id") % 5 == 0)
    return ranking.local_ranked(rows, 0.25 * (F.col("n_chars") % 4), ranking.capped_blend(0.6, [(F.col("lang") == "en", 0.2)]), 12, 6)


#: Cases of the example: pattern of a query, then patterns of a text and their points.
RESULTS = [("the|der|les", [(("tion", "of"), 2.0), (("tion",), 1.3)]), ("ing", [(("keit",), 0.45)])]
TOPICS = [("a", [(("qu", "x"), 1.15), (("qu",), 0.25)]), ("o", [(("sch",), 1.6)])]


@query(
    f"""
    with {POOL_SQL},
    named as (select *, query_text || ' ' || case query_id % 4 when 0 then '' else repeat('I', (query_id % 3 + 1)::int) || ' ' end || 'FSK ' || (query_id % 7) || '/' || (20 + query_id % 3) as asked_text,
        repeat('I', (doc_id % 3 + 1)::int) || ' FSK ' || (doc_id % 7) || '/20' || (20 + doc_id % 3) as signature, lower(text) as low, lower(query_text) as q from pool),
    parts as (
        select query_id, doc_id,
            case when query_id % 7 = doc_id % 7 and query_id % 3 = doc_id % 3 then 3.0 when query_id % 4 <> 0 and query_id % 3 = doc_id % 3 then 0.25 else 0.0 end as sig,
            case when query_id % 4 = 0 then 0.0 when query_id % 3 = doc_id % 3 then 0.7 else -0.35 end as chamber,
            len(list_filter(words, lambda t: len(list_filter(own, lambda x: starts_with(x, left(t, 6)))) > 0)) / greatest(len(words), 1)::double as share,
            least(2.0, case when regexp_matches(q, 'the|der|les') then case when contains(low, 'tion') and contains(low, 'of') then 2.0 when contains(low, 'tion') then 1.3 else 0.0 end else 0.0 end + case when contains(q, 'ing') and contains(low, 'keit') then 0.45 else 0.0 end) as result,
            least(1.8, case when contains(q, 'a') then case when contains(low, 'qu') and contains(low, 'x') then 1.15 when contains(low, 'qu') then 0.25 else 0.0 end else 0.0 end + case when contains(q, 'o') and contains(low, 'sch') then 1.6 else 0.0 end) as topic,
            len(asked_domains) > 0 and not list_has_any(asked_domains, own_domains) as clash
        from (select n.*, coalesce(words, []) as words, list_distinct(regexp_extract_all(low, '{TOKEN}{{3,}}')) as own from named n left join asked using (query_id)))
    select query_id, doc_id, round(greatest(-0.75, least(6.0, case when doc_id % 5 <> 0 then greatest(-0.35, least(4.0, sig + chamber + share)) + result + topic else 0.0 end + case when clash then -0.75 else 0.0 end))::double, 6) as score from parts"""
)
def judgments_matched(spark, sf_dir):
    """Items ask for a signature made from their id, without a chamber in a quarter of them; documents bear one made from theirs."""
    k, d = F.col("query_id"), F.col("doc_id")
    roman = lambda c: F.repeat(F.lit("I"), (c % 3 + 1).cast("int"))
    asked = F.concat("query_text", F.lit(" "), F.when(k % 4 == 0, "").otherwise(F.concat(roman(k), F.lit(" "))), F.lit("FSK "), k % 7, F.lit("/"), 20 + k % 3)
    own = F.concat(roman(d), F.lit(" FSK "), d % 7, F.lit("/20"), 20 + d % 3)
    rows = _pool(spark, sf_dir).withColumn("asked", asked).withColumn("own", own)
    score = authority.judgment_score(
        authority.signature_points(authority.signatures(F.col("asked")), authority.signatures(F.col("own"))),
        authority.chamber_points(authority.chambers(F.col("asked")), authority.chambers(F.col("own"))),
        fusion.term_share(X.query_tokens(F.col("query_text")), F.array_distinct(X.tokens(F.col("text")))),
        authority.case_points(F.col("query_text"), F.col("text"), RESULTS, 2.0),
        authority.case_points(F.col("query_text"), F.col("text"), TOPICS, 1.8),
        authority.domain_clash(F.col("asked_domains"), F.col("own_domains")),
        d % 5 != 0,
    )
    return rows.select("query_id", "doc_id", score.alias("score"))


@query(
    f"""
    with {POOL_SQL},
    w as (select p.*, coalesce(words, []) as words, list_distinct(regexp_extract_all(lower(text), '{TOKEN}{{2,}}')) as own, date '2020-01-01' + (doc_id % 2000)::int as start from pool p left join asked using (query_id)),
    s as (
        select query_id, doc_id, 2.0 * case when len(asked_domains) = 0 then 0.5 when list_has_any(asked_domains, own_domains) then 1.0 else len(list_filter(asked_domains, lambda x: list_contains(own, lower(x)))) / len(asked_domains)::double end
            + case when len(words[1:2]) = 0 then 0.5 else len(list_filter(words[1:2], lambda x: list_contains(own, x))) / len(words[1:2])::double end
            + case when len(words[3:5]) = 0 then 0.5 else len(list_filter(words[3:5], lambda x: list_contains(own, x))) / len(words[3:5])::double end
            + case when start <= date '2023-01-01' and (doc_id % 3 = 0 or start + 400 >= date '2023-01-01') then 1.0 else 0.0 end as score from w),
    r as (select query_id, doc_id, round(score, 6) as score from s)
    select query_id, doc_id, score, row_number() over (partition by query_id order by score desc, doc_id)::int as rank from r qualify rank <= 20"""
)
def metadata_channel(spark, sf_dir):
    words, start = X.query_tokens(F.col("query_text")), F.date_add(F.lit("2020-01-01").cast("date"), (F.col("doc_id") % 2000).cast("int"))
    rows = _pool(spark, sf_dir).withColumn("words", words).withColumn("start", start).withColumn("end", F.when(F.col("doc_id") % 3 != 0, F.date_add("start", 400)))
    fields = [X.coverage(F.col("text"), F.slice("words", 1, 2)), X.coverage(F.col("text"), F.slice("words", 3, 3))]
    domains = authority.field_overlap(F.col("asked_domains"), F.col("own_domains"), X.coverage(F.col("text"), F.col("asked_domains")))
    return authority.metadata_channel(rows, domains, fields, temporal.effective_on(F.col("start"), F.col("end"), F.lit("2023-01-01").cast("date")), 20)


@query(
    """
    with s as (select o_custkey, o_orderkey, case o_orderpriority when '1-URGENT' then 2 when '2-HIGH' then 1 else 0 end as kind, o_orderdate::date as d, o_orderstatus as st from orders)
    select o_custkey, o_orderkey, count(*) over (partition by o_custkey) as n_sources from s qualify row_number() over (partition by o_custkey order by kind desc, d desc, st desc, o_orderkey) = 1"""
)
def sources_preferred(spark, sf_dir):
    kind = F.when(F.col("o_orderpriority") == "1-URGENT", "codified_text").when(F.col("o_orderpriority") == "2-HIGH", "Consolidated_Text")
    priority = authority.source_priority(kind, F.col("o_orderdate").cast("date").cast("string"), F.col("o_orderstatus"))
    return authority.preferred_sources(table(spark, sf_dir, "orders"), ["o_custkey"], priority, "o_orderkey")


@query(
    f"""
    with {POOL_SQL},
    c as (select p.*, coalesce(words, []) as words, lower('art. ' || (doc_id % 50) || ' ' || text) as hay, lower(text) as low,
        1 + [2, 4, 7, 0][(doc_id % 4 + 1)::int] as levels from pool p left join asked using (query_id)),
    s as (
        select *, len(list_filter(words, lambda x: contains(hay, x))) as overlap,
            levels + case when contains(low, 'keit') or contains(low, 'tion') then 4 else 0 end + case when contains(low, 'the') then 1 else 0 end - case when doc_id % 7 = 0 then 10 else 0 end as specificity from c)
    select query_id, doc_id, overlap::int as overlap, specificity::int as specificity, row_number() over (partition by query_id order by (doc_id % 50 = query_id % 50) desc, overlap desc, specificity desc, doc_id % 3 desc, doc_id % 7 = 0, lang desc nulls last, source desc nulls last, doc_id)::int as position
    from s qualify position <= 10"""
)
def rules_for_query(spark, sf_dir):
    """Documents stand for rules, cited down to a paragraph, a point or a letter, or as an article only."""
    levels = F.element_at(F.array(F.lit(" ust. 1"), F.lit(" ust. 2a pkt 3"), F.lit(" ust. 1 pkt 2 lit. c"), F.lit("")), (F.col("doc_id") % 4 + 1).cast("int"))
    rows = _pool(spark, sf_dir).withColumn("article", F.concat(F.lit("art. "), F.col("doc_id") % 50))
    specificity = authority.rule_specificity(F.concat("article", levels), F.col("text"), ("keit", "tion"), ("the",))
    hay, target = F.concat_ws(" ", "article", "text"), F.col("doc_id") % 50 == F.col("query_id") % 50
    return authority.rules_for_query(rows, hay, X.query_tokens(F.col("query_text")), target, specificity, F.col("doc_id") % 7 == 0, ("keit", "tion"), F.col("doc_id") % 3, [F.col("lang"), F.col("source")], 10)


@query(
    rf"""
    with {POOL_SQL},
    t as (select p.*, coalesce(words, [])[1:8] as topics, list_has_any(asked_domains, own_domains) as fits, case when doc_id % 3 = 0 then text else replace(text, chr(10), ' Art. 5a. ') end as statute from pool p left join asked using (query_id)),
    d as (select *, lower(text) as low, lower(query_text) as q, trim(regexp_replace(statute, '[ \t\n\r\f\x0B]+', ' ', 'g')) as clean, regexp_split_to_array(trim(regexp_replace(statute, '[ \t\n\r\f\x0B]+', ' ', 'g')), '\bArt\.\s*[0-9]+[a-z]*\.?') as cut
        from t qualify fits or not bool_or(fits) over (partition by query_id)),
    s as (
        select query_id, doc_id, trim(case when len(cut) > 1 then regexp_extract(clean, '\bArt\.\s*[0-9]+[a-z]*\.?') || cut[2] else clean end) as quote,
            round(score + case when fits then 2.0 else 0.0 end + 0.35 * len(list_filter(topics, lambda x: contains(case when doc_id % 3 = 0 then low else lower(clean) end, x)))
                + case when contains(q, 'the') and contains(low, 'tion') then -4.0 else 0.0 end + case when not contains(q, 'the') and contains(low, 'keit') then 1.2 else 0.0 end + case when contains(low, 'ing') then 0.7 else 0.0 end, 6) as score from d)
    select query_id, doc_id, score, quote from s where quote <> '' qualify row_number() over (partition by query_id order by score desc, doc_id) = 1"""
)
def opening_quotes(spark, sf_dir):
    """Two thirds of the documents are read as statutes whose lines are articles."""
    statute = F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise(F.replace("text", F.lit("\n"), F.lit(" Art. 5a. ")))
    rows = _pool(spark, sf_dir).withColumn("text", statute)
    signed = [("the", "tion", -4.0), ("!the", "keit", 1.2), ("", "ing", 0.7)]
    return authority.opening_quotes(rows, F.col("score"), F.col("asked_domains"), F.col("own_domains"), X.query_tokens(F.col("query_text"), 8), signed)


@query(
    """
    with dict as (select p_partkey as id, p_name as name, case when p_size < 20 then 'product_or_service' when p_size < 35 then 'transaction_type' else 'other' end as kind, [p_brand, 'art. ' || p_size, 'third'] as prov, p_type as term from part),
    plans as (
        select o_orderkey as plan, '  ' || o_orderpriority || '  ' || o_orderstatus as question, [o_orderkey % 150 + 1, o_orderkey * 7 % 150 + 1] as locked, [o_orderkey * 3 % 150 + 1, o_orderkey * 5 % 150 + 1, o_orderkey % 150 + 1] as detected,
            [o_orderpriority, o_orderstatus, 'cut off'] as concepts, [lower(o_orderpriority), ' ', 'cut off'] as synonyms, [o_orderkey % 11 + 1] as roles, case when o_orderkey % 2 = 0 then [o_orderkey % 13 + 1, 5] else [] end as counter from orders),
    l as (select plan, unnest(locked) as id, generate_subscripts(locked, 1) as pl from plans),
    t as (select plan, unnest(detected) as id, generate_subscripts(detected, 1) as pl from plans),
    r as (select plan, unnest(roles || counter) as id, generate_subscripts(roles || counter, 1) as pl from plans where len(counter) > 0),
    every as (
        select plan, [0, 0, 0] as o, 'exact_user_phrase' as type, question as query, false as hard from plans
        union all select plan, [1, pl, 0], 'locked_institution', name, true from l join dict using (id)
        union all select plan, [1, pl, i], 'verified_provision', prov[i], true from l join dict using (id) cross join (select unnest([1, 2]) as i)
        union all select plan, [1, pl, 3], 'statutory_language', term, false from l join dict using (id)
        union all select plan, [2, pl, 0], case kind when 'transaction_type' then 'material_facts' else kind end, name, false from t join dict using (id) where kind <> 'other'
        union all select plan, [3, i, 0], 'legal_concepts', concepts[i], false from plans cross join (select unnest([1, 2]) as i)
        union all select plan, [4, i, 0], 'model_soft_expansion', synonyms[i], false from plans cross join (select unnest([1, 2]) as i)
        union all select plan, [9, 0, 0], 'role_and_direction', string_agg(name, ' ' order by pl), false from (select plan, name, pl, row_number() over (partition by plan order by pl) as nth from r join dict using (id)) where nth <= 2 group by plan),
    clean as (select plan, o, type, trim(regexp_replace(query, ' +', ' ', 'g')) as query, hard from every),
    once as (select * from clean where query <> '' qualify row_number() over (partition by plan, type, lower(query) order by o) = 1),
    placed as (select *, row_number() over (partition by plan order by o) as position from once)
    select plan, position::int as position, type || '_' || position as family_id, type, query, hard, case when hard then 1.4 else 1.0 end::double as weight from placed where position <= 8"""
)
def plan_families(spark, sf_dir):
    """Orders stand for plans and parts for the dictionary."""
    k = F.col("o_orderkey")
    ids = lambda *cs: F.array(*cs).cast("array<string>")
    plans = table(spark, sf_dir, "orders").select(
        k.alias("plan"),
        F.concat(F.lit("  "), "o_orderpriority", F.lit("  "), "o_orderstatus").alias("question"),
        ids(k % 150 + 1, k * 7 % 150 + 1).alias("locked"),
        ids(k * 3 % 150 + 1, k * 5 % 150 + 1, k % 150 + 1).alias("detected"),
        F.array("o_orderpriority", "o_orderstatus", F.lit("cut off")).alias("legal_concepts"),
        F.array(F.lower("o_orderpriority"), F.lit(" "), F.lit("cut off")).alias("synonyms"),
        ids(k % 11 + 1).alias("roles"),
        F.when(k % 2 == 0, ids(k % 13 + 1, F.lit(5).cast("long"))).alias("counter_roles"),
    )
    kind = F.when(F.col("p_size") < 20, "product_or_service").when(F.col("p_size") < 35, "transaction_type").otherwise("other")
    dictionary = table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("concept_id"), F.col("p_name").alias("name"), kind.alias("kind"), F.array("p_brand", F.concat(F.lit("art. "), "p_size"), F.lit("third")).alias("provisions"), F.array("p_type").alias("statutory")
    )
    return authority.plan_families(plans, dictionary, {"product_or_service": "product_or_service", "contract_type": "contract_type", "transaction_type": "material_facts", "payment_type": "material_facts"})
