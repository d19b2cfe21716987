"""Queries of candidate generation, fusion and selection: benchmark items are the queries, documents the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lantern.functions import text as X
from lantern.functions import vectors as V
from lantern.operators import embedding, fulltext, fusion, index, selection
from lantern.operators.lineage import reserved
from lantern.plans.registry import query, table

FIELDS = {"text": 1.0, "lang": 1.5, "source": 2.5}
SLOTS = 256
TOKEN = "[0-9A-Za-zÀ-ÖØ-öø-ÿĄĆĘŁŃŚŹŻąćęłńśźż]"

#: BM25 of the first 24 query tokens as prefixes, as common table expressions.
BM25_SQL = f"""
    words as (
        select doc_id, unnest(regexp_extract_all(lower(text), '{TOKEN}+')) as term, 1.0 as w from documents
        union all select doc_id, unnest(regexp_extract_all(lower(lang), '{TOKEN}+')), 1.5 from documents
        union all select doc_id, unnest(regexp_extract_all(lower(source), '{TOKEN}+')), 2.5 from documents),
    post as (select term, doc_id, sum(w) as wtf from words group by all),
    lens as (select doc_id, count(*) as length from words group by doc_id),
    total as (select count(*) as n, (select sum(length) from lens) / count(*)::double as mean_length from documents),
    qt as (select item_id as query_id, unnest(regexp_extract_all(lower(text), '{TOKEN}{{3,}}')) as token, generate_subscripts(regexp_extract_all(lower(text), '{TOKEN}{{3,}}'), 1) as i from benchmark),
    qd as (select query_id, token, row_number() over (partition by query_id order by min(i)) as p from qt group by query_id, token),
    hit as (select query_id, token, doc_id, sum(wtf) as wtf from qd join post on left(term, 3) = left(token, 3) and starts_with(term, token) where p <= 24 group by all),
    df as (select query_id, token, count(*) as df from hit group by all),
    bm as (
        select query_id, doc_id, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * wtf * 2.2 / (wtf + 1.2 * (0.25 + 0.75 * length / mean_length))), 6) as score
        from hit join df using (query_id, token) join lens using (doc_id) cross join total group by query_id, doc_id),
    lex as (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from bm)"""


def lexical(spark: SparkSession, sf_dir: str, limit: int) -> DataFrame:
    queries = table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "query_id")
    return fulltext.search(table(spark, sf_dir, "documents"), queries, FIELDS, limit)


@query(f"with {BM25_SQL} select query_id, doc_id, score, rank::int as rank from lex where rank <= 6")
def bm25_top(spark, sf_dir):
    return lexical(spark, sf_dir, 6)


def _kept_index(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    """An index of an older state of the documents, refreshed to the present one, and what the refresh changed.

    Then, toxic documents weren't there, those of low quality had another text, and some that have gone were there.
    """
    docs = table(spark, sf_dir, "documents")
    marked = docs.join(table(spark, sf_dir, "labels"), "doc_id", "left").fillna(0, ["toxic"]).fillna(1, ["quality"]).filter("toxic = 0")
    older = marked.withColumn("text", F.when(F.col("quality") == 0, F.concat(F.lit("older wording of "), "text")).otherwise(F.col("text")))
    gone = docs.filter("lang = 'de'").withColumn("doc_id", -1 - F.col("doc_id"))
    root = reserved(spark, "index")
    index.refresh(older.select(docs.columns).unionByName(gone), root, FIELDS)
    return root, index.refresh(docs, root, FIELDS)


@query(f"with {BM25_SQL} select query_id, doc_id, score, rank::int as rank from lex where rank <= 6")
def bm25_from_index(spark, sf_dir):
    root, _ = _kept_index(spark, sf_dir)
    return index.search(table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "query_id"), root, 6)


@query(
    """
    select 'new' as status, doc_id from labels join documents using (doc_id) where toxic = 1
    union all select 'changed', doc_id from labels join documents using (doc_id) where toxic = 0 and quality = 0
    union all select 'gone', -1 - doc_id from documents where lang = 'de'"""
)
def index_changes(spark, sf_dir):
    return _kept_index(spark, sf_dir)[1].select("status", "doc_id")


#: Hash embeddings of documents (d) and benchmark items (q) as rows of (kind, k, slot, value).
EMBEDDING_SQL = f"""
    src as (select 'd' as kind, doc_id as k, text as t from documents union all select 'q', item_id, text from benchmark),
    tok as (select distinct kind, k, unnest(regexp_extract_all(lower(t), '{TOKEN}{{2,}}')) as w from src),
    feat as (select kind, k, w as f, 24 + least(length(w), 12) as units from tok
        union all select kind, k, substr(w, i, 4), 24 + least(length(w), 12) from (select kind, k, w, unnest(range(1, length(w) - 2)) as i from tok where length(w) >= 4)),
    hashed as (select kind, k, ('0x' || substr(sha256(f), 13, 4))::int as h, units from feat),
    slots as (select kind, k, h % {SLOTS} as slot, sum(case when (h >> 8) % 2 = 0 then units else -units end)::double as u from hashed group by all),
    norms as (select kind, k, sqrt(sum(u * u)) as size from slots group by all having sum(u * u) > 0),
    emb as (select kind, k, slot, round(u / size, 6) as value from slots join norms using (kind, k) where u <> 0)"""


@query(f"with {EMBEDDING_SQL} select k as doc_id, slot::int as slot, value from emb where kind = 'd' and value <> 0")
def hash_embedding(spark, sf_dir):
    made = embedding.hash_embeddings(table(spark, sf_dir, "documents"), SLOTS).select("doc_id", F.posexplode("embedding").alias("slot", "value"))
    return made.filter("value <> 0").select("doc_id", "slot", "value")


def semantic(spark: SparkSession, sf_dir: str, limit: int) -> DataFrame:
    docs = embedding.hash_embeddings(table(spark, sf_dir, "documents"), SLOTS)
    items = table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "query_id")
    queries = embedding.hash_embeddings(items, SLOTS, key="query_id").withColumnRenamed("embedding", "query_vector")
    return embedding.nearest(queries, docs, limit, metric="dot", key="doc_id")


COSINE = "round(case when list_dot_product(a.e, a.e) > 0 and list_dot_product(b.e, b.e) > 0 then list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) else 0 end, 6)"


@query(
    f"""
    with v as (select vec_id, label, embedding::double[] as e from embeddings),
    s as (select a.vec_id as query_id, b.vec_id, {COSINE} as score from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0),
    r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s where score >= 0.05)
    select query_id, vec_id, score, rank::int as rank from r where rank <= 6"""
)
def vector_top(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    queries = vectors.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return embedding.nearest(queries, vectors, 6, least=0.05, besides_self=True)


@query(
    f"""
    with v as (select vec_id, label, embedding::double[] as e from embeddings),
    s as (select a.vec_id as query_id, b.vec_id, {COSINE} as score from v a join v b on a.vec_id <> b.vec_id and a.label = b.label where a.vec_id % 100 = 0),
    r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
    select query_id, vec_id, score, rank::int as rank from r where rank <= 4"""
)
def vector_top_filtered(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    queries = vectors.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("query_label"), F.col("embedding").alias("query_vector"))
    return embedding.nearest(queries, vectors, 4, within=("query_label", "label"), besides_self=True)


@query("select vec_id, round(sqrt(list_dot_product(embedding::double[], embedding::double[])), 6) as norm from embeddings")
def vector_norms(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(V.norm(F.col("embedding")), 6).alias("norm"))


def _lists(spark: SparkSession, sf_dir: str, most: int = 30) -> DataFrame:
    """Two channels a query: full text, and hash embeddings."""
    lex = lexical(spark, sf_dir, most).select("query_id", F.lit("lexical").alias("channel"), F.lit("user").alias("family"), "doc_id", "rank")
    sem = semantic(spark, sf_dir, most).select("query_id", F.lit("vector").alias("channel"), F.lit("named_institution_vector").alias("family"), "doc_id", "rank")
    return lex.unionByName(sem)


SEMANTIC_SQL = f"""{EMBEDDING_SQL},
    sims as (select q.k as query_id, d.k as doc_id, round(sum(q.value * d.value), 6) as score from emb q join emb d on q.slot = d.slot and q.kind = 'q' and d.kind = 'd' group by all),
    near as (select query_id, doc_id, row_number() over (partition by query_id order by score desc, doc_id) as rank from sims)"""

LISTS_SQL = f"""{BM25_SQL}, {SEMANTIC_SQL},
    lists as (
        select query_id, 'lexical' as channel, 'user' as family, doc_id, rank, 1.0 as w from lex where rank <= 30
        union all select query_id, 'vector', 'named_institution_vector', doc_id, rank, 2.5 from near where rank <= 30)"""


@query(
    f"""
    with {LISTS_SQL},
    f as (select query_id, doc_id, round(sum(w / (60 + rank)), 8) as score, string_agg(distinct family, ',' order by family) as families from lists group by all),
    r as (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from f)
    select query_id, doc_id, score, families, rank::int as rank from r where rank <= 10"""
)
def rank_fusion(spark, sf_dir):
    fused = fusion.reciprocal_rank_fusion(_lists(spark, sf_dir)).filter("rank <= 10")
    return fused.select("query_id", "doc_id", "score", F.array_join("families", ",").alias("families"), "rank")


@query(
    f"""
    with {BM25_SQL}, {SEMANTIC_SQL},
    b as (select query_id, doc_id, coalesce(l.rank, 100000) as lr, coalesce(n.rank, 100000) as sr from (select * from lex where rank <= 120) l full outer join (select * from near where rank <= 120) n using (query_id, doc_id)),
    s as (select *, round(0.65 / (20 + lr) + 0.35 / (20 + sr), 8) as score from b),
    r as (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from s)
    select query_id, doc_id, lr::int as lexical_rank, sr::int as semantic_rank, score, rank::int as rank from r where rank <= 6"""
)
def hybrid_search(spark, sf_dir):
    """The flagship: BM25 and hash embeddings, fused for every query at once."""
    lists = _lists(spark, sf_dir, max(20 * 6, 120))
    return fusion.hybrid(lists.filter("channel = 'lexical'"), lists.filter("channel = 'vector'"), 6)


@query(
    f"""
    with {LISTS_SQL},
    s as (select *, row_number() over (partition by query_id, doc_id order by rank, channel) as seen from lists),
    d as (select query_id, channel, rank, l.doc_id, source, row_number() over (partition by query_id, source order by rank, channel, l.doc_id) as nth from s l join documents using (doc_id) where seen = 1),
    p as (select *, row_number() over (partition by query_id order by rank, channel, doc_id) as position from d where nth <= 2)
    select query_id, doc_id, position::int as position from p where position <= 20"""
)
def channels_interleaved(spark, sf_dir):
    rows = _lists(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    return selection.interleave(rows, 2, 20, key="doc_id", document="source").select("query_id", "doc_id", "position")


@query(
    f"""
    with {BM25_SQL},
    p as (select query_id, l.doc_id, source, rank, count(*) over (partition by query_id) as n, row_number() over (partition by query_id, source order by rank) = 1 as first from lex l join documents using (doc_id) where rank <= 30),
    q as (select *, sum(first::int) over (partition by query_id order by rank) as nth from p)
    select query_id, doc_id, row_number() over (partition by query_id order by case when n <= 8 then 0 when first and nth <= 8 then 0 else 1 end, rank)::int as position from q"""
)
def diverse_window(spark, sf_dir):
    rows = lexical(spark, sf_dir, 30).join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    return selection.diverse_window(rows, 8, document="source").select("query_id", "doc_id", "position")


@query(
    f"""
    with recursive {BM25_SQL},
    p as (select query_id, source, sha256(text) as canonical, rank from lex join documents using (doc_id) where rank <= 30),
    s as (
        select distinct query_id, 0::bigint as rank, []::varchar[] as canons, []::varchar[] as sources, '' as source, '' as canonical, false as taken from p
        union all
        select query_id, rank, case when ok then list_append(canons, canonical) else canons end, case when ok then list_append(sources, source) else sources end, source, canonical, ok
        from (
            select p.*, s.canons, s.sources, not list_contains(s.canons, p.canonical) and len(list_filter(s.sources, lambda x: x = p.source)) < 2 as ok
            from s join p on p.query_id = s.query_id and p.rank = s.rank + 1))
    select query_id, source as doc_id, canonical, rank::int as rank from s where taken"""
)
def diverse_greedy(spark, sf_dir):
    """Canonical ids cross documents here, so each choice depends on those before."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2(F.col("text").cast("binary"), 256).alias("canonical"))
    rows = lexical(spark, sf_dir, 30).join(docs, "doc_id").select("query_id", F.col("source").alias("doc_id"), "canonical", "rank")
    return selection.diverse_greedy(rows, 2)


@query(
    f"""
    with {BM25_SQL},
    k as (select query_id, l.doc_id, rank, case when lang = 'fr' then 'interpretation' when lang = 'de' then 'judgment' else 'statute' end as kind from lex l join documents using (doc_id) where rank <= 30),
    n as (select *, row_number() over (partition by query_id, kind order by rank) as nth from k),
    p as (select *, row_number() over (partition by query_id order by case when kind = 'interpretation' and nth = 1 then 0 when kind = 'judgment' and nth = 1 then 1 else 2 end, rank) as position from n)
    select query_id, doc_id, kind, position::int as position from p where position <= 6"""
)
def balanced_sample(spark, sf_dir):
    return selection.balanced(_kinds(spark, sf_dir), ["interpretation", "judgment"], 6).select("query_id", "doc_id", "kind", "position")


def _kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("lang") == "fr", "interpretation").when(F.col("lang") == "de", "judgment").otherwise("statute").alias("kind")
    return lexical(spark, sf_dir, 30).join(table(spark, sf_dir, "documents").select("doc_id", kind), "doc_id")


@query(
    f"""
    with {BM25_SQL},
    k as (select query_id, l.doc_id, rank, case when lang = 'fr' then 'interpretation' when lang = 'de' then 'judgment' else 'statute' end as kind from lex l join documents using (doc_id) where rank <= 30),
    n as (select *, row_number() over (partition by query_id, kind order by rank) as nth from k)
    select query_id, doc_id, kind from n where nth <= case kind when 'statute' then 3 when 'interpretation' then 2 else 1 end"""
)
def typed_budget(spark, sf_dir):
    return selection.typed_budget(_kinds(spark, sf_dir), {"statute": 3, "interpretation": 2, "judgment": 1}).select("query_id", "doc_id", "kind")


@query(
    f"""
    with {BM25_SQL},
    t as (select query_id, l.doc_id, rank, length(text) as n from lex l join documents using (doc_id) where rank <= 12),
    u as (select *, sum(n + 2) over (partition by query_id order by rank) - 2 as used from t)
    select query_id, doc_id, used::bigint as used from u where rank = 1 or used <= 9000"""
)
def context_for_queries(spark, sf_dir):
    """The end-to-end slice: search, then pack the best documents into a budget of characters."""
    rows = lexical(spark, sf_dir, 12).join(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return selection.packed(rows, 9000, order="rank").select("query_id", "doc_id", "used")


@query(
    """
    with q as (select item_id as query_id, lower(text) as qt from benchmark),
    rules(qp, rp, w) as (values ('tion', 'keit', 2.0), ('the', 'license', 1.5), ('la ', 'les ', 0.5)),
    a as (select query_id, rp, w from q join rules on regexp_matches(qt, qp))
    select query_id, doc_id, sum(w) as score from documents join a on regexp_matches(lower(text), rp) group by all"""
)
def rule_scores(spark, sf_dir):
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))
    return fusion.rule_scores(table(spark, sf_dir, "documents"), queries, [("tion", "keit", 2.0), ("the", "license", 1.5), ("la ", "les ", 0.5)])


@query(
    """
    with c as (select doc_id, n_chars / 1000.0 as a, case when lang = 'en' then 1.0 else 0.5 end as b, case when doc_id % 4 = 0 then -0.5 else 0.0 end as n from documents)
    select doc_id, round(5.0 * a + 0.6 * b + 1.4 * n, 6) as score, case when n < 0 then 'tax_domain' else 'negative_constraint_penalty,tax_domain' end as reasons from (select doc_id, a, b, n from c) x where false
    union all select doc_id, round(5.0 * a + 0.6 * b + 1.1 * b + 1.4 * n, 6), 'tax_domain' from c"""
)
def transparent_rerank(spark, sf_dir):
    b = F.when(F.col("lang") == "en", 1.0).otherwise(0.5)
    parts = F.create_map(F.lit("fusion"), F.col("n_chars") / 1000, F.lit("source_type"), b, F.lit("tax_domain"), b, F.lit("negative_constraint_penalty"), F.when(F.col("doc_id") % 4 == 0, -0.5).otherwise(0.0))
    return table(spark, sf_dir, "documents").select("doc_id", F.round(fusion.weighted_components(parts), 6).alias("score"), F.array_join(fusion.reasons(parts), ",").alias("reasons"))


@query("select doc_id, (contains(lower(text), 'the') )::int + contains(lower(text), 'keit')::int + contains(lower(text), 'ción')::int as hits from documents")
def additive_scan(spark, sf_dir):
    phrases = F.array(F.lit("the"), F.lit("keit"), F.lit("ción"))
    return table(spark, sf_dir, "documents").select("doc_id", fulltext.additive_score(F.col("text"), phrases).alias("hits"))


@query(
    f"""
    with w as (select doc_id, list_distinct(regexp_extract_all(lower(text), '{TOKEN}+')) as ws from documents)
    select doc_id from w where len(list_filter(ws, lambda x: starts_with(x, 'th'))) > 0 and len(list_filter(ws, lambda x: starts_with(x, 'whe') or starts_with(x, 'onst'))) > 0"""
)
def cooccurrence(spark, sf_dir):
    lit = lambda *xs: F.array(*[F.lit(x) for x in xs])
    return table(spark, sf_dir, "documents").filter(fulltext.cooccurring(F.col("text"), lit("th"), lit("whe", "onst"))).select("doc_id")


@query(
    f"""
    with {BM25_SQL},
    e as (select item_id as query_id, doc_id, 0 as priority from benchmark b join documents d on contains(d.text, b.text)),
    c as (select * from e union all select query_id, doc_id, 1 from lex where rank <= 3),
    m as (select *, min(priority) over (partition by query_id) as least from c)
    select query_id, doc_id, priority from m where priority = least"""
)
def exact_before_fulltext(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))
    exact = fulltext.containing(docs, queries).select("query_id", "doc_id", F.lit(0).alias("priority"))
    return fulltext.first_nonempty(exact.union(lexical(spark, sf_dir, 3).select("query_id", "doc_id", F.lit(1))))


@query(
    f"""
    with t as (select doc_id, list_distinct(regexp_extract_all(lower(text), '{TOKEN}{{2,}}')) as ws from documents),
    f as (select doc_id, list_contains(ws, 'the') and list_contains(ws, 'and') as a, list_contains(ws, 'der') as b, list_contains(ws, 'les') as c from t)
    select doc_id, round((a::int + b::int + c::int) / 3.0, 6) as covered from f"""
)
def phrase_coverage(spark, sf_dir):
    phrases = F.array(F.lit("the and"), F.lit("der"), F.lit(" les "), F.lit("  "))
    return table(spark, sf_dir, "documents").select("doc_id", F.round(X.coverage(F.col("text"), phrases), 6).alias("covered"))


@query(
    """
    with p(id, kind, phrase, confidence) as (values ('c1', 'alias', 'tion', 0.9), ('c1', 'hint', 'the', 0.5), ('c2', 'alias', 'keit', 0.8), ('c3', 'alias', 'the', 0.5)),
    m as (select doc_id, id, kind, confidence, row_number() over (partition by doc_id, id order by confidence desc, kind) as rn from documents join p on contains(lower(text), phrase))
    select doc_id, id as concept_id, kind, confidence::double as confidence from m where rn = 1"""
)
def dictionary_matches(spark, sf_dir):
    phrases = spark.createDataFrame([("c1", "alias", "tion", 0.9), ("c1", "hint", "the", 0.5), ("c2", "alias", "keit", 0.8), ("c3", "alias", "the", 0.5)], "concept_id string, kind string, phrase string, confidence double")
    met = fulltext.holding(table(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("low")), phrases, "phrase", column="low")
    return selection.first_by(met, ["doc_id", "concept_id"], [F.desc("confidence"), "kind"]).select("doc_id", "concept_id", "kind", "confidence")


@query(
    f"""
    with {BM25_SQL},
    r(position, pattern) as (values (1, 'keit'), (2, 'tion'), (3, '[0-9]')),
    m as (select query_id, l.doc_id, position, row_number() over (partition by query_id, position order by rank, l.doc_id) as rn from lex l join documents using (doc_id) join r on regexp_matches(lower(text), pattern) where rank <= 12)
    select query_id, doc_id, min(position)::int as met from m where rn = 1 group by all"""
)
def requirements_met(spark, sf_dir):
    rows = lexical(spark, sf_dir, 12).join(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    needs = spark.createDataFrame([(1, "keit"), (2, "tion"), (3, "[0-9]")], "position int, pattern string")
    return selection.required_first(rows, needs).filter("met is not null").select("query_id", "doc_id", "met")


@query(
    f"""
    with {BM25_SQL},
    d as (select query_id, source, l.doc_id as chunk_id, score, text, regexp_matches(text, 'tion')::int + regexp_matches(text, '[0-9]')::int as markers from lex l join documents using (doc_id) where rank <= 30),
    r as (select *, max(score) over (partition by query_id, source) as best, row_number() over (partition by query_id, source order by markers desc, score desc, length(text), chunk_id desc) as rn from d)
    select query_id, source, chunk_id, markers::int as markers, best as score from r where rn = 1"""
)
def document_representatives(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "source", F.col("text").alias("chunk_text"), (F.rlike("text", F.lit("tion")).cast("int") + F.rlike("text", F.lit("[0-9]")).cast("int")).alias("markers"))
    rows = lexical(spark, sf_dir, 30).withColumnRenamed("doc_id", "chunk_id").join(docs, "chunk_id")
    return selection.representatives(rows, document="source")
