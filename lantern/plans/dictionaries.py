"""Queries of phrase dictionaries over the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lantern.operators import dictionary
from lantern.plans.registry import query, table

PHRASES = [
    ("c_en", "exact_phrase", 0, "of the"), ("c_en", "exact_phrase", 1, "In  THE"), ("c_en", "colloquial_alias", 0, "the"), ("c_en", "required_context", 0, "and"), ("c_en", "negative_context", 0, "is a"),
    ("c_de", "lemma_phrase", 0, "der und"), ("c_de", "abbreviation", 0, "das"), ("c_de", "context_any", 0, "die"), ("c_de", "context_any", 1, "und die"),
    ("c_es", "factual_alias", 0, "de la"), ("c_es", "exact_phrase", 0, "que la"), ("c_es", "negative_context", 0, "los"),
    ("c_fr", "abbreviation", 0, "une"), ("c_fr", "material_concept", 0, "les"), ("c_fr", "material_concept", 1, "la"),
    ("c_mark", "exact_phrase", 0, "the."), ("c_mark", "exact_phrase", 1, "la!!"), ("c_mark", "required_context", 0, "it"),
    ("c_off", "exact_phrase", 0, "the"), ("c_mat", "material_concept", 0, "for"), ("c_mat", "material_concept", 1, "was"), ("c_mat", "material_concept", 2, "with"), ("c_mat", "negative_context", 0, "by"),
]
CONCEPTS = [("c_en", "role", "active", False), ("c_de", "form", "active", True), ("c_es", "form", "shadow", False), ("c_fr", "role", "active", True), ("c_mark", "fact", "active", True), ("c_off", "fact", "draft", False), ("c_mat", "fact", "active", False)]
PATTERNS = [("c_fr", "eux (la|le)"), ("c_es", "ci(o|ó)n de")]
RELATED = [("c_en", "c_legal"), ("c_en", "c_de"), ("c_de", "c_legal")]
EXCLUDED = [("c_en", "c_es"), ("c_de", "c_en"), ("c_legal", "c_de")]


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(str(x).lower() if isinstance(x, (bool, int)) else "'" + x.replace("'", "''") + "'" for x in r) + ")" for r in rows)


#: Normalised texts, and hits (doc_id, phrase) by patterns with word boundaries on both sides.
HITS_SQL = rf"""
    p(id, kind, place, phrase) as (values {_values(PHRASES)}),
    c(id, type, status, strict) as (values {_values(CONCEPTS)}),
    x(id, pattern) as (values {_values(PATTERNS)}),
    t as materialized (select doc_id, trim(regexp_replace(regexp_replace(lower(strip_accents(text)), '[‐-―]', '-', 'g'), '[\t\n\x0B\f\r\p{{Z}}]+', ' ', 'g')) as t from documents),
    q as (select distinct phrase, trim(regexp_replace(lower(phrase), ' +', ' ', 'g')) as n from p),
    hit as materialized (
        select doc_id, phrase from t, q where contains(t, n)
        and regexp_matches(t, '(^|[^\p{{L}}\p{{N}}_])' || replace(n, '.', '\.') || '($|[^\p{{L}}\p{{N}}_])')),
    sig as (
        select doc_id, id, kind, place, phrase from hit join p using (phrase)
        union all select doc_id, id, 'safe_regex', 0, pattern from t, x where regexp_matches(t, pattern)),
    ask as (select id, count(distinct phrase) filter (where kind = 'required_context') as asked, count(*) filter (where kind = 'context_any') > 0 as any_asked from p group by id),
    n as (
        select doc_id, id, count(*) filter (where kind = 'required_context') as req, count(*) filter (where kind = 'context_any') as ctx,
            count(*) filter (where kind = 'negative_context') as neg, count(*) filter (where kind = 'material_concept') as mat
        from sig group by all),
    conf(kind, confidence, a, b) as (values ('exact_phrase', 0.99, 0, 0), ('lemma_phrase', 0.95, 1, 1), ('abbreviation', 0.93, 2, 3), ('colloquial_alias', 0.84, 3, 4), ('factual_alias', 0.84, 4, null), ('safe_regex', 0.94, 5, 2)),
    rec as (
        select doc_id, id as concept_id, type as concept_type, kind, phrase, confidence::double as confidence,
            status = 'active' and neg = 0 and req = asked and (not any_asked or ctx > 0) and (not strict or req + ctx > 0) as locked
        from sig join conf using (kind) join c using (id) join n using (doc_id, id) join ask using (id) where status not in ('disabled', 'draft')
        qualify row_number() over (partition by doc_id, id order by a, place, phrase) = 1)"""


def _frames(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    phrases = spark.createDataFrame(PHRASES, "concept_id string, kind string, place int, phrase string")
    concepts = spark.createDataFrame(CONCEPTS, "concept_id string, concept_type string, status string, strict boolean")
    return table(spark, sf_dir, "documents"), concepts, phrases


@query(f"with {HITS_SQL} select doc_id, phrase from hit")
def phrase_hits(spark, sf_dir):
    docs, _, phrases = _frames(spark, sf_dir)
    return dictionary.phrase_hits(docs, phrases).select("doc_id", "phrase")


@query(f"with {HITS_SQL} select * from rec")
def concepts_recognised(spark, sf_dir):
    return dictionary.recognised(*_frames(spark, sf_dir), PATTERNS).drop("evidence")


@query(
    f"""
    with {HITS_SQL},
    best as (select doc_id, id, kind, phrase from sig join conf using (kind) where b is not null qualify row_number() over (partition by doc_id, id order by b, place, phrase) = 1),
    k as (
        select n.doc_id, id, status, strict, neg, req = asked and (not any_asked or ctx > 0) as fits, coalesce(best.kind, case when mat >= 2 and neg = 0 and req = asked and (not any_asked or ctx > 0) then 'contextual_inference' end) as kind, coalesce(phrase, 'contextual_signals') as phrase
        from n join c using (id) join ask using (id) left join best using (doc_id, id) where status not in ('disabled', 'draft'))
    select doc_id, id as concept_id, kind, phrase, case kind when 'contextual_inference' then 0.61 else confidence end::double as confidence,
        (kind = 'exact_phrase' and not strict) or fits as context_satisfied, status = 'active' and kind <> 'contextual_inference' and ((kind = 'exact_phrase' and not strict) or fits) and neg = 0 as locked
    from k left join conf using (kind) where kind is not null"""
)
def institutions_recognised(spark, sf_dir):
    return dictionary.institutions(*_frames(spark, sf_dir), PATTERNS)


RELATED_SQL = f"""{HITS_SQL},
    r(id, related) as (values {_values(RELATED)}),
    far as (select doc_id, related as concept_id, max(least(confidence, 0.75)) as confidence from rec join r on rec.concept_id = r.id group by all),
    every as (select doc_id, concept_id, kind, confidence, locked from rec union all select doc_id, concept_id, 'related_concept', confidence, false from far where (doc_id, concept_id) not in (select doc_id, concept_id from rec))"""


def _every(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary.with_related(dictionary.recognised(*_frames(spark, sf_dir), PATTERNS), spark.createDataFrame(RELATED, "concept_id string, related_id string"))


@query(f"with {RELATED_SQL} select doc_id, concept_id, kind, confidence::double as confidence, locked from every")
def concepts_related(spark, sf_dir):
    return _every(spark, sf_dir)


@query(f"with {RELATED_SQL}, e(a, b) as (values {_values(EXCLUDED)}) select x.doc_id, a as concept_id, b as incompatible_with from every x join e on x.concept_id = a join every y on y.doc_id = x.doc_id and y.concept_id = b")
def concepts_incompatible(spark, sf_dir):
    return dictionary.incompatible(_every(spark, sf_dir), spark.createDataFrame(EXCLUDED, "concept_id string, incompatible_with string"))


@query(f"with {HITS_SQL} select doc_id, id as concept_id, string_agg(phrase, '|' order by place, phrase) as markers from hit join (select distinct id, place, phrase from p) using (phrase) group by all")
def document_markers(spark, sf_dir):
    docs, _, phrases = _frames(spark, sf_dir)
    return dictionary.document_markers(docs, phrases).select("doc_id", "concept_id", F.array_join("markers", "|").alias("markers"))
