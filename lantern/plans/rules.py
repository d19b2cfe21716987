"""Queries of filters, query expansion, scores and concepts."""

from __future__ import annotations

from pyspark.sql import functions as F

from lantern.functions import calculations as C
from lantern.operators import concepts, expansion, filters, fulltext, incremental, provisions, ranking, selection
from lantern.plans.registry import query, table
from lantern.plans.retrieval import BM25_SQL, lexical

TOKEN = "[0-9A-Za-zÀ-ÖØ-öø-ÿĄĆĘŁŃŚŹŻąćęłńśźż]"
#: Rules of the example queries: number, pattern of a query, aliases.
EXPANSIONS = [("the", ["article", "definite"]), ("la |les ", ["femme", "article"]), ("tion", ["noun", "xy"])]
EXPANSIONS_SQL = """
    rules(rule, pattern, aliases) as (values (1, 'the', ['article', 'definite']), (2, 'la |les ', ['femme', 'article']), (3, 'tion', ['noun', 'xy'])),
    added as (select item_id as query_id, rule, i, aliases[i] as alias from benchmark join rules on regexp_matches(lower(text), pattern) cross join (select unnest([1, 2]) as i)),
    firsts as (select query_id, alias, min(rule * 10 + i) as place from added group by all),
    placed as (select query_id, alias, row_number() over (partition by query_id order by place) - 1 as position from firsts)"""


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def _lit(*values):
    return F.array(*[F.lit(v) for v in values])


@query("select doc_id from documents where lower(lang) in ('en', 'fr', 'de')")
def kinds_expanded(spark, sf_dir):
    return _docs(spark, sf_dir).filter(filters.of_kinds(F.col("lang"), ["EN", "fr", None], {"fr": ["de"], "es": ["xx"]})).select("doc_id")


@query("select doc_id from documents where coalesce(doc_id % 2 = 1 and upper(lang) in ('EN', 'ES'), false) or (doc_id % 3 = 0 and lang in ('en', 'es'))")
def domains_filtered(spark, sf_dir):
    domain = F.when(F.col("doc_id") % 2 == 1, F.col("lang"))
    tagged = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("art. 1"), F.concat(F.lit("["), F.upper("lang"), F.lit("] art. 2"))))
    return _docs(spark, sf_dir).filter(filters.in_domains(domain, tagged, ["es", "EN"])).select("doc_id")


@query(
    """
    with k as (select * from documents where lang in ('en', 'de') and source in (select max(source) from documents union all select min(source) from documents) and list_has_any(string_split(lower(text), ' '), ['the', 'der']))
    select doc_id, source from k qualify row_number() over (partition by source order by n_chars desc, doc_id) <= 5"""
)
def filtered_before_limit(spark, sf_dir):
    docs = _docs(spark, sf_dir).withColumn("words", F.split(F.lower("text"), " "))
    ends = list(docs.agg(F.min("source"), F.max("source")).first())
    wanted = {"lang": ["en", "de"], "source": ends, "words": ["the", "der"], "n_chars": None}
    return selection.capped(filters.filtered(docs, wanted), ["source"], [F.desc("n_chars"), "doc_id"], 5).select("doc_id", "source")


@query("select event_id from events where list_has_any(json_keys(props), ['k', 'zz']) and list_has_any([event_type, 'x'], ['purchase', 'error'])")
def any_key_contained(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    return rows.filter(filters.any_key(F.json_object_keys("props"), ["k", "zz"]) & filters.any_key(F.array("event_type", F.lit("x")), ["purchase", "error"])).select("event_id")


@query(
    r"""
    with l as (select doc_id, lower(trim(regexp_replace(text, '[ \t\n\r\f\x0B]+', ' ', 'g'))) as t from documents)
    select doc_id, coalesce(t <> '' and regexp_matches(t, 'the|der') and not contains(t, 'license') and not contains(t, '100') and (length(t) - length(replace(t, 'an', ''))) / 2 >= 3, false) as quote_only from l"""
)
def quotes_only(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", filters.quote_only(F.col("text"), "the|der", ["license", "100"], "an", 3).alias("quote_only"))


LINE = "l_orderkey, l_linenumber"


@query(
    f"""
    with c as (select {LINE}, greatest(l_discount * 2, l_tax, (l_quantity - 40) / 50) >= 0.15 as fact, l_returnflag = 'A' as provision, l_linestatus = 'F' as hf, l_orderkey % 2 = 0 as hp, l_linenumber = 7 as exempt, l_quantity < 3 as wrong from lineitem)
    select {LINE} from c where exempt or (not wrong and case when hf and hp then fact and provision when hf then fact else provision end)"""
)
def material_candidates(spark, sf_dir):
    facts = [F.col("l_discount") * 2, F.col("l_tax"), (F.col("l_quantity") - 40) / 50]
    fits = filters.materially_relevant(facts, F.col("l_returnflag") == "A", F.col("l_linestatus") == "F", F.col("l_orderkey") % 2 == 0, F.col("l_linenumber") == 7, F.col("l_quantity") < 3)
    return table(spark, sf_dir, "lineitem").filter(fits).select("l_orderkey", "l_linenumber")


@query(
    f"""
    with c as (select {LINE}, l_linenumber < 6 as required, l_returnflag <> 'N' as matched, l_discount < 0.08 as dom, l_tax < 0.05 as mech, l_quantity > 10 as prov, l_quantity > 20 as pay, l_linestatus = 'F' as tx, l_suppkey % 3 > 0 as asked from lineitem)
    select {LINE}, case when required and not matched then 'irrelevant' when matched and mech and dom and pay and tx then 'direct' when matched and mech and dom and prov and ((asked and pay) or (not asked and tx)) then 'strong_analogy'
        when matched and not mech then 'different_mechanism' when matched then 'context_only' else 'irrelevant' end as relation from c"""
)
def document_relations(spark, sf_dir):
    asked = F.col("l_suppkey") % 3 > 0
    relation = filters.relevance(
        F.col("l_linenumber") < 6, F.col("l_returnflag") != "N", F.col("l_discount") < 0.08, F.col("l_tax") < 0.05, F.col("l_quantity") > 10,
        {"payment": F.col("l_quantity") > 20, "transaction": F.col("l_linestatus") == "F"}, ["payment", "transaction"], {"payment": asked, "transaction": ~asked},
    )
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", relation.alias("relation"))


@query(
    """
    with q as (select doc_id, lower(text) as t, case doc_id % 3 when 0 then 'in the tion' when 1 then 'nothing' else 'keit or la' end as asked from documents)
    select doc_id from q where not (contains(asked, 'the') or contains(asked, 'keit')) or (contains(asked, 'the') and contains(t, 'the')) or (contains(asked, 'keit') and contains(t, 'keit'))"""
)
def of_named_country(spark, sf_dir):
    asked = F.when(F.col("doc_id") % 3 == 0, "in THE tion").when(F.col("doc_id") % 3 == 1, "nothing").otherwise("Keit or la")
    return _docs(spark, sf_dir).filter(filters.of_country(F.col("text"), asked, _lit("the", "keit"))).select("doc_id")


@query(f"with {EXPANSIONS_SQL} select query_id, position::int as position, alias from placed")
def query_expansions(spark, sf_dir):
    return expansion.expansions(table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "query_id"), EXPANSIONS)


@query(
    f"""
    with {EXPANSIONS_SQL},
    tok as (select item_id as query_id, unnest(regexp_extract_all(lower(text), '{TOKEN}{{3,}}')) as t, generate_subscripts(regexp_extract_all(lower(text), '{TOKEN}{{3,}}'), 1) as i from benchmark),
    own as (select query_id, t, row_number() over (partition by query_id order by min(i)) as p from tok group by query_id, t),
    every as (select query_id, 'query' as channel, t, p from own where p <= 24 union all select query_id, 'expansion', alias, position from placed where length(alias) >= 3)
    select query_id, channel, string_agg(case when length(t) >= 4 then t || '*' else t end, ' ' order by p) as boolean_query from every group by query_id, channel"""
)
def complementary_queries(spark, sf_dir):
    made = expansion.complementary(table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "query_id"), EXPANSIONS)
    return made.select("query_id", "channel", expansion.boolean_query(F.col("tokens")).alias("boolean_query"))


@query(
    f"""
    with {EXPANSIONS_SQL}
    select query_id, count(*) as n_docs from (select query_id, doc_id from placed join documents on contains(lower(text), alias) group by all) group by query_id"""
)
def phrase_queries(spark, sf_dir):
    """Phrases only: the words of a query don't widen the search."""
    phrases = expansion.expansions(table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "query_id"), EXPANSIONS)
    each = fulltext.holding(_docs(spark, sf_dir).select("doc_id", F.lower("text").alias("low")), phrases.select("alias").distinct(), "alias", column="low")
    return phrases.join(each, "alias").select("query_id", "doc_id").distinct().groupBy("query_id").agg(F.count("*").alias("n_docs"))


@query(
    """
    with d as (select p_partkey as id, [p_name] as names, string_split(p_name, ' ') as aliases, [p_brand, ''] as hints from part),
    e as (select id, 'canonical' as channel, 0 as position, names[1] as query from d union all select id, 'alias', i - 1, aliases[i] from (select id, aliases, unnest(range(1, len(aliases) + 1)) as i from d) union all select id, 'hint', 0, hints[1] from d)
    select id as concept_id, channel, position::int as position, query from e where trim(query) <> ''"""
)
def institution_channels(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("concept_id"), F.array("p_name").alias("names"), F.split("p_name", " ").alias("aliases"), F.array("p_brand", F.lit("")).alias("hints"))
    return expansion.dictionary_channels(parts, {"names": "canonical", "aliases": "alias", "hints": "hint"})


@query(
    """
    with p as (select o_custkey as issue, o_orderkey as pos, o_orderpriority as q, o_orderstatus = 'F' as hard from orders),
    o as (select *, row_number() over (partition by issue, q order by hard desc, pos) as rn from p),
    r as (select issue, q, hard, row_number() over (partition by issue order by hard desc, pos, q) as position from o where rn = 1)
    select issue, q as query, hard, case when hard then 1.4 else 1.0 end::double as weight, position::int as position from r where position <= 3"""
)
def query_families(spark, sf_dir):
    plan = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("issue"), F.col("o_orderkey").alias("position"), F.col("o_orderpriority").alias("query"), (F.col("o_orderstatus") == "F").alias("hard"))
    return expansion.families(plan, 3)


@query(
    """
    with i as (select distinct o_custkey as issue from orders where o_custkey not in (select o_custkey from orders where o_orderstatus = 'F')),
    c as (select o_custkey as issue, o_orderpriority as query, row_number() over (partition by o_custkey order by o_orderkey, o_orderpriority) as nth from orders join i on issue = o_custkey)
    select issue % 20 as plan, issue, query from c where nth <= 2 qualify row_number() over (partition by issue % 20 order by nth, issue) <= 8"""
)
def primary_gap_recovery(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("issue"), F.col("o_orderkey").alias("position"), F.col("o_orderpriority").alias("query"), "o_orderstatus").withColumn("plan", F.col("issue") % 20)
    return expansion.recovery(orders, orders.filter("o_orderstatus = 'F'"), orders.drop("o_orderstatus"))


@query("select doc_id, sha256(repeat(lang || chr(10), 5) || repeat(source || chr(10), 2) || text) as digest from documents where trim(lang) <> '' and trim(source) <> '' and trim(text) <> ''")
def embedding_texts(spark, sf_dir):
    docs = _docs(spark, sf_dir).filter("trim(lang) <> '' and trim(source) <> '' and trim(text) <> ''")
    return docs.select("doc_id", F.sha2(expansion.repeated_fields({"lang": 5, "source": 2, "text": 1}).cast("binary"), 256).alias("digest"))


@query(
    f"""
    with {BM25_SQL},
    p as (select query_id, l.doc_id, round(2 * score + 0.25 * (n_chars % 4), 6) as preliminary, n_chars, lang from lex l join documents using (doc_id) where rank <= 30),
    f as (select *, row_number() over (partition by query_id order by preliminary desc, doc_id) as first from p),
    s as (select *, count(*) over (partition by query_id) as pool, row_number() over (partition by query_id order by n_chars desc, first) as second, least(0.6, case when lang = 'fr' then 0.2 else 0.6 end) as w from f where first <= 12),
    b as (select *, round(w * (1 - (second - 1) / greatest(pool - 1, 1)::double) + (1 - w) * (1 - (first - 1) / greatest(pool - 1, 1)::double), 6) as blended from s),
    o as (select *, row_number() over (partition by query_id order by blended desc, first) as place from b),
    t as (select *, row_number() over (partition by query_id order by case when first = 1 and place > 4 then 3.5 else place end) as position from o)
    select query_id, doc_id, preliminary, blended, position::int as position from t where position <= 4"""
)
def two_stage_ranked(spark, sf_dir):
    rows = lexical(spark, sf_dir, 30).join(_docs(spark, sf_dir).select("doc_id", "n_chars", "lang"), "doc_id")
    blend = ranking.capped_blend(0.6, [(F.col("lang") == "fr", 0.2)])
    return ranking.two_stage(rows, 2 * F.col("score") + 0.25 * (F.col("n_chars") % 4), F.col("n_chars"), blend, 12, 4)


@query(
    """
    with j as (select doc_id, least(1.0, greatest(0.0, case when contains(text, 'tion') then 0.6 else 0 end + case when contains(text, 'the') then 0.3 else 0 end + case when lang = 'en' then 0.4 else -0.2 end)) as s from documents)
    select doc_id, round(s::double, 6) as score from j"""
)
def judgment_scores(spark, sf_dir):
    parts = [F.when(F.contains("text", F.lit("tion")), 0.6).otherwise(0.0), F.when(F.contains("text", F.lit("the")), 0.3).otherwise(0.0), F.when(F.col("lang") == "en", 0.4).otherwise(-0.2)]
    return _docs(spark, sf_dir).select("doc_id", F.round(ranking.clamped(parts, 0.0, 1.0), 6).alias("score"))


@query("select doc_id, source, row_number() over (partition by source order by (lang = 'en')::int * 2 + (n_chars > 1000)::int desc, doc_id)::int as position from documents qualify position <= 50")
def metadata_ranked(spark, sf_dir):
    score = (F.col("lang") == "en").cast("int") * 2 + (F.col("n_chars") > 1000).cast("int")
    return ranking.placed(_docs(spark, sf_dir).withColumn("score", score), [F.desc("score"), "doc_id"], ["source"], 50).select("doc_id", "source", "position")


CARD_SQL = """
    with c as (
        select doc_id, string_split(lower(text), ' ') as ws, case doc_id % 3 when 0 then 'current' when 1 then 'uncertain' else 'historical' end as status, case when lang = 'en' then 'nsa_judgment' when lang = 'fr' then 'general_interpretation' else 'other' end as kind, doc_id % 5 = 0 as wrong, doc_id % 7 = 0 as penalized from documents),
    d as (
        select *, least(1.0, len(list_intersect(['the', 'of', 'der', 'les'], ws)) / 4.0 * 2.5) as issue, case when kind = 'nsa_judgment' then 1.0 when kind = 'general_interpretation' then 0.72 else 0.3 end as w,
            case status when 'current' then 1.0 when 'uncertain' then 0.45 else 0.15 end as t from c)"""


@query(
    f"""
    {CARD_SQL}
    select doc_id, round_even(greatest(0.0, least(1.0, 5.0 * 0.02000137 + 0.13 + 0.17 * issue + 0.08 * t + 0.05 * w - greatest(case when wrong then 0.35 else 0 end, case when penalized then 0.12 else 0 end)))::double, 4) as score from d"""
)
def authority_card_scores(spark, sf_dir):
    words = F.split(F.lower("text"), " ")
    status = F.when(F.col("doc_id") % 3 == 0, "current").when(F.col("doc_id") % 3 == 1, "uncertain").otherwise("historical")
    kind = F.when(F.col("lang") == "en", "nsa_judgment").when(F.col("lang") == "fr", "general_interpretation").otherwise("other")
    parts = {"family": F.lit(0.02000137), "tax_match": F.lit(1.0), "issue_match": ranking.overlap(_lit("the", "of", "der", "les"), words, 2.5), "temporal_match": ranking.temporal_match(status), "document_authority_weight": ranking.document_weight(kind)}
    return _docs(spark, sf_dir).select("doc_id", ranking.card_score(parts, F.col("doc_id") % 5 == 0, F.col("doc_id") % 7 == 0).alias("score"))


@query(
    f"""
    with c as (select {LINE}, (l_linenumber % 4) / 4.0 as tr, l_tax * 10 as br, l_linenumber % 4 as m, least(l_discount * 10, 1.0) as ps, l_suppkey % 2 = 0 as spec, l_returnflag <> 'N' as same, l_returnflag = 'A' as conf, l_returnflag = 'N' and l_linestatus = 'O' as unk, l_quantity > 45 as orth, l_quantity > 5 as dom from lineitem)
    select {LINE}, round(greatest(0.0, least(100.0, 10 * tr + 15 * br + least(20.0, 20 * ps) * case when spec or ps = 0 then 1.0 else 0.45 end + case when conf then 25.0 when same then 12.0 when unk then 7.0 else 0.0 end + 18 * br + case when dom then 12.0 else 0.0 end
            + case when orth then -55.0 when not same and not unk then -18.0 else 0.0 end))::double, 6) as score,
        case when not dom or orth or (not same and m < 2) then 'different_mechanism' when same and not conf then 'context_only' when same and m >= 2 then 'direct' when same and m > 0 and tr > 0 then 'strong_analogy' when not same and m >= 2 then 'strong_analogy' else 'context_only' end as relation from c"""
)
def research_assessment(spark, sf_dir):
    m = F.col("l_linenumber") % 4
    same, unknown = F.col("l_returnflag") != "N", (F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "O")
    score, relation = ranking.assessment(
        m / 4.0, F.col("l_tax") * 10, m, F.least(F.col("l_discount") * 10, F.lit(1.0)), F.col("l_suppkey") % 2 == 0, same, F.col("l_returnflag") == "A", unknown, F.col("l_quantity") > 45, F.col("l_quantity") > 5, m
    )
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(score, 6).alias("score"), relation.alias("relation"))


@query("select o_orderkey, row_number() over (partition by o_custkey order by case o_orderstatus when 'F' then 0 when 'O' then 1 else 2 end, o_orderdate desc, o_orderkey)::int as position from orders")
def source_priority(spark, sf_dir):
    subtype = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    return ranking.placed(table(spark, sf_dir, "orders"), [subtype, F.desc("o_orderdate"), "o_orderkey"], ["o_custkey"]).select("o_orderkey", "position")


@query(
    f"""
    select {LINE}, row_number() over (partition by l_orderkey order by (l_returnflag = 'A')::int + (l_linestatus = 'F')::int + (l_discount > 0.05)::int desc, l_quantity desc, l_linenumber)::int as position from lineitem"""
)
def rules_prioritised(spark, sf_dir):
    given = [F.when(F.col("l_returnflag") == "A", 1), F.when(F.col("l_linestatus") == "F", 1), F.when(F.col("l_discount") > 0.05, 1)]
    specificity = sum((c.isNotNull().cast("int") for c in given), F.lit(0))
    return ranking.placed(table(spark, sf_dir, "lineitem"), [F.desc(specificity), F.desc("l_quantity"), "l_linenumber"], ["l_orderkey"]).select("l_orderkey", "l_linenumber", "position")


@query(
    """
    with s as (select doc_id, lang as query_id, row_number() over (partition by lang order by n_chars desc, doc_id) as seed from documents qualify seed <= 200),
    l as (select doc_id, query_id, seed, unnest(string_split(text, ' ')) as w, generate_subscripts(string_split(text, ' '), 1) - 1 as chunk_id from documents join s using (doc_id)),
    r as (select *, row_number() over (partition by doc_id order by length(w) desc, chunk_id) as rn from l)
    select query_id, doc_id, chunk_id::int as chunk_id, row_number() over (partition by query_id order by seed, rn)::int as position from r where rn <= 2"""
)
def reranked_within_documents(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    seeds = ranking.placed(docs.withColumnRenamed("lang", "query_id"), [F.desc("n_chars"), "doc_id"], ["query_id"], 200).select("query_id", "doc_id", "position")
    chunks = docs.select("doc_id", F.posexplode(F.split("text", " ")).alias("chunk_id", "w")).withColumn("score", F.length("w"))
    return ranking.within_documents(seeds, chunks, most=2)


@query("with s as (select doc_id, source, (contains(text, 'the'))::int * 2 + (contains(text, 'tion'))::int - (n_chars > 3000)::int as score from documents) select source, doc_id, score from s qualify row_number() over (partition by source order by score desc, doc_id) = 1")
def opening_candidates(spark, sf_dir):
    score = F.contains("text", F.lit("the")).cast("int") * 2 + F.contains("text", F.lit("tion")).cast("int") - (F.col("n_chars") > 3000).cast("int")
    return selection.first_by(_docs(spark, sf_dir).withColumn("score", score), ["source"], [F.desc("score"), "doc_id"]).select("source", "doc_id", "score")


CONCEPTS_SQL = """
    with p(id, kind, phrase, confidence) as (values ('c1', 'exact_phrase', 'tion', 0.99), ('c1', 'abbreviation', 'the', 0.93), ('c2', 'exact_phrase', 'keit', 0.99), ('c3', 'colloquial_alias', 'ción', 0.84)),
    m as (select doc_id, id, kind, confidence from documents join p on contains(lower(text), phrase) qualify row_number() over (partition by doc_id, id order by confidence desc, kind, phrase) = 1),
    r(id, related) as (values ('c1', 'c4'), ('c2', 'c3'), ('c3', 'c4')),
    d as (select doc_id, related as id, max(least(confidence, 0.75)) as confidence from m join r using (id) group by all),
    found as (select doc_id, id, kind, confidence from m union all select doc_id, id, 'related_concept', confidence from d where (doc_id, id) not in (select doc_id, id from m))"""


def _concepts(spark, sf_dir):
    phrases = [("c1", "exact_phrase", "tion", 0.99), ("c1", "abbreviation", "the", 0.93), ("c2", "exact_phrase", "keit", 0.99), ("c3", "colloquial_alias", "ción", 0.84)]
    related = spark.createDataFrame([("c1", "c4"), ("c2", "c3"), ("c3", "c4")], "concept_id string, related_id string")
    return concepts.match_concepts(_docs(spark, sf_dir), spark.createDataFrame(phrases, "concept_id string, kind string, phrase string, confidence double"), related)


@query(f"{CONCEPTS_SQL} select doc_id, id as concept_id, kind, confidence::double as confidence from found")
def concept_matches(spark, sf_dir):
    return _concepts(spark, sf_dir)


@query(f"{CONCEPTS_SQL} select a.doc_id, a.id as concept_id, b.id as incompatible_with from found a join found b on a.doc_id = b.doc_id and (a.id, b.id) in (('c1', 'c3'), ('c2', 'c1'))")
def concept_conflicts(spark, sf_dir):
    return concepts.conflicts(_concepts(spark, sf_dir), spark.createDataFrame([("c1", "c3"), ("c2", "c1")], "concept_id string, incompatible_with string"))


@query(
    """
    with t as (select doc_id, lower(text) as t from documents)
    select doc_id, case when regexp_matches(t, 'tion.*the') then 'rejected' when regexp_matches(t, 'keit|ung') then 'accepted' when regexp_matches(t, 'les') then 'quashed' end as outcome,
        case when regexp_matches(t, 'tion.*the') then 'unfavorable' when regexp_matches(t, 'keit|ung') then 'favorable' when regexp_matches(t, 'les') then 'favorable_or_mixed' end as favorability from t"""
)
def outcomes(spark, sf_dir):
    what, how = concepts.outcome(F.col("text"), [("tion.*the", "rejected", "unfavorable"), ("keit|ung", "accepted", "favorable"), ("les", "quashed", "favorable_or_mixed")], None)
    return _docs(spark, sf_dir).select("doc_id", what.alias("outcome"), how.alias("favorability"))


@query("select doc_id, case when lang = 'de' then 'governing_statute' when regexp_matches(lower(text), 'tion') then 'reasoning' when regexp_matches(lower(text), 'les|los') then 'taxpayer_position' else 'supporting_source' end as role from documents")
def evidence_roles(spark, sf_dir):
    role = F.when(F.col("lang") == "de", "governing_statute").otherwise(concepts.first_rule(F.col("text"), [("tion", "reasoning"), ("les|los", "taxpayer_position")], "supporting_source"))
    return _docs(spark, sf_dir).select("doc_id", role.alias("role"))


@query(
    r"""
    with l as (select doc_id, unnest(regexp_split_to_array(text, '\n')) as x, generate_subscripts(regexp_split_to_array(text, '\n'), 1) - 1 as unit from documents)
    select doc_id, unit::int as unit, nullif(trim(regexp_extract(lower(x), 'the ([a-z]+ [a-z]+)', 1)), '') as condition, case when regexp_matches(lower(x), 'not|kein') then 'exclusion' when regexp_matches(lower(x), 'tion') then 'definition' else 'general' end as rule_type from l"""
)
def rule_unit_types(spark, sf_dir):
    lines = _docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("unit", "unit_text"))
    return concepts.rule_units(lines, "the ([a-z]+ [a-z]+)", [("not|kein", "exclusion"), ("tion", "definition")]).drop("unit_text")


@query(
    """
    with r(pattern, fact) as (values ('the', 'date'), ('tion', 'amount'), ('keit', 'role'), ('les', 'date')),
    f as (select doc_id, list_distinct(list(fact)) as need from documents left join r on regexp_matches(lower(text), pattern) group by doc_id)
    select doc_id, array_to_string(list_sort(list_filter(need, lambda x: x is not null and x <> 'amount')), ',') as missing_facts from f"""
)
def facts_required(spark, sf_dir):
    needs = [("the", "date"), ("tion", "amount"), ("keit", "role"), ("les", "date")]
    found = concepts.unmet_facts(_docs(spark, sf_dir).select("doc_id", F.col("text").alias("unit_text")), needs, _lit("amount"))
    return found.select("doc_id", F.array_join("missing_facts", ",").alias("missing_facts"))


@query("select p_partkey, p_name || ',' || '[' || upper(p_type) || '] ' || trim(regexp_replace(lower(p_name), ' +', ' ', 'g')) as provisions from part")
def provision_alias_lists(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(concepts.provision_aliases(F.array("p_name", "p_name"), F.col("p_type")), ",").alias("provisions"))


@query(
    """
    with c as (select l_orderkey as issue, 'art. ' || (l_partkey % 10) as citation, l_returnflag as lane from lineitem),
    a as (select issue, citation, count(*) as n from c where lane = 'N' group by all),
    m as (select * from a where not exists (select 1 from c where c.lane <> 'N' and c.issue = a.issue and (c.citation = a.citation or starts_with(c.citation, a.citation || ' '))))
    select issue, citation from m qualify row_number() over (partition by issue order by n desc, citation) <= 2"""
)
def back_references(spark, sf_dir):
    cited = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("issue"), F.concat(F.lit("art. "), (F.col("l_partkey") % 10).cast("string")).alias("citation"), "l_returnflag")
    return concepts.back_references(cited.filter("l_returnflag = 'N'"), cited.filter("l_returnflag <> 'N'"))


@query(
    """
    with m as (select source, source < (select max(source) from documents) as same, min(doc_id) + 20 as cursor from documents group by source)
    select source, count(*) as n, min(doc_id) as first from documents join m using (source) where not same or doc_id > cursor group by source"""
)
def resumed_load(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    manifest = docs.groupBy("source").agg(F.lit("v2").alias("manifest_hash"))
    last = docs.agg(F.max("source").alias("_last"))
    cursors = docs.groupBy("source").agg((F.min("doc_id") + 20).alias("cursor")).join(F.broadcast(last), F.lit(True))
    cursors = cursors.select("source", "cursor", F.when(F.col("source") < F.col("_last"), "v2").otherwise("v1").alias("manifest_hash"))
    return incremental.pending(docs, cursors, manifest, position="doc_id").groupBy("source").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))


@query(
    """
    with o as (select o_orderkey, round(o_totalprice * 100)::bigint as cents, o_orderkey % 101 as share from orders),
    t as (select *, (cents * 23 + 50) // 100 as tax from o)
    select o_orderkey, ((tax * share + 50) // 100)::bigint as deductible, (tax - (tax * share + 50) // 100)::bigint as not_deductible from t"""
)
def mixed_invoice_tax(spark, sf_dir):
    net = F.round("o_totalprice", 2)
    own, other = C.mixed_claim(net, F.lit(23), F.col("o_orderkey") % 101)
    cents = lambda c, name: (c * 100).cast("long").alias(name)
    return table(spark, sf_dir, "orders").select("o_orderkey", cents(own, "deductible"), cents(other, "not_deductible"))


@query(
    """
    with o as (select o_orderkey, o_orderkey * 1000 + 12 as a, o_custkey as b, o_orderkey % 2 = 0 as stated from orders)
    select o_orderkey, case when stated then a + 0.5 else a + b + 0.5 end::double as total, greatest(0.0, case when stated then a + 0.5 else a + b + 0.5 end - 2000) * 0.2 as excess from o"""
)
def amounts_from_text(spark, sf_dir):
    """Amounts written as 1 234 567,50: the stated total, or else the sum."""
    big = F.regexp_replace((F.col("o_orderkey") * 1000 + 12).cast("string"), r"(?<=[0-9])(?=(?:[0-9]{3})+$)", " ")
    text = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("Paid 7 and 9; total amount: "), big, F.lit(",50"))).otherwise(F.concat(F.lit("Paid "), big, F.lit(",5 then "), F.col("o_custkey").cast("string"), F.lit(".")))
    total = C.total_amount(text, "total amount").cast("double")
    return table(spark, sf_dir, "orders").select("o_orderkey", total.alias("total"), (F.greatest(F.lit(0.0), total - 2000) * 0.2).alias("excess"))


@query("select o_orderkey, case when o_orderkey % 3 = 0 then date '2020-01-31' else o_orderdate::date end as target from orders")
def dates_from_text(spark, sf_dir):
    written = F.concat(F.lit("as of "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" or 1999-01-01"))
    text = F.when(F.col("o_orderkey") % 6 == 0, "no date").when(F.col("o_orderkey") % 3 == 0, "on 2021-99-77").otherwise(written)
    return table(spark, sf_dir, "orders").select("o_orderkey", C.date_of(text, F.lit("2020-01-31").cast("date")).alias("target"))


@query("select doc_id, concat_ws(',', case when regexp_matches(lower(text), 'tion') and regexp_matches(lower(text), 'the') then 'late' end, case when regexp_matches(lower(text), 'les') and regexp_matches(lower(text), '[0-9]{2}') then 'gap' end) as issues from documents")
def timeline_checks(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.array_join(concepts.timeline_issues(F.col("text"), [("late", "tion", "the"), ("gap", "les", "[0-9]{2}")]), ",").alias("issues"))


@query("select event_type, count(*) filter (where value > 50) as passed, round(avg(value), 6) as mean_value, bool_and(value > 0) as safe, count(*) filter (where props is null) as without_version from events group by event_type")
def safety_summary(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count_if(F.col("value") > 50).alias("passed"), F.round(F.avg("value"), 6).alias("mean_value"), F.bool_and(F.col("value") > 0).alias("safe"), F.count_if(F.col("props").isNull()).alias("without_version"))


@query(
    """
    with once as (select l_orderkey as q, l_partkey as k, min(l_linenumber * 1000000 + l_partkey) as rank, bool_or(l_returnflag = 'R') as fits from lineitem group by q, k),
    pin as (select q, arg_min(k, rank) as k from once where fits group by q)
    select once.q as query_id, once.k as doc_id, row_number() over (partition by once.q order by case when pin.k = once.k then 0 else 1 end, rank)::int as position from once left join pin on pin.q = once.q
    qualify position <= 3"""
)
def pinned_targets(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("doc_id"))
    once = lines.agg(F.min(F.col("l_linenumber") * 1_000_000 + F.col("l_partkey")).alias("rank"), F.collect_set("l_returnflag").alias("references"))
    targets = once.select("query_id").distinct().select("query_id", F.lit(1).alias("target_position"), F.lit("R").alias("reference"))
    return selection.pinned(once, targets, 3)


@query(
    """
    with a as (select doc_id, n_chars as q, 0 as layer, lang as v from documents where doc_id % 2 = 0 union all select doc_id, case when doc_id % 3 = 0 then n_chars + 1 else n_chars end, 1, 'other' from documents where doc_id % 5 <> 0)
    select doc_id, v as kind, layer from a qualify row_number() over (partition by doc_id order by q desc, layer) = 1"""
)
def layers_merged(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    first = docs.filter("doc_id % 2 = 0").select("doc_id", F.col("n_chars").alias("quality"), F.col("lang").alias("kind"))
    second = docs.filter("doc_id % 5 <> 0").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars")).alias("quality"), F.lit("other").alias("kind"))
    return selection.layered(first, second, ["doc_id"], ["quality"]).select("doc_id", "kind", "layer")


@query("select doc_id, array_to_string(list_sort(list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z]+ [0-9]{2,}')), lambda x: not contains(x, 'e'))), ',') as unsupported from documents")
def unsupported_references(spark, sf_dir):
    """References of a text that are not among the allowed ones, here those with an e."""
    found = F.filter(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+ [0-9]{2,}"), F.lit(0))), lambda x: F.contains(x, F.lit("e")))
    return _docs(spark, sf_dir).select("doc_id", F.array_join(F.array_sort(provisions.unsupported(F.col("text"), found, "[a-z]+ [0-9]{2,}")), ",").alias("unsupported"))
