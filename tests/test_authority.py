"""Judgments, rules, quotes and the local ranking against loops; vector search by blocks."""

import random

import pytest
from pyspark.sql import functions as F

from lantern.functions import text as X
from lantern.operators import authority, embedding, fulltext, ranking


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_signatures_and_points(spark):
    text = F.lit("wyrok ii fsk 12/20, FSK 7 / 2019; XFSK 3/20 i III FSK 5/21")
    found = [tuple(x) for x in value(spark, authority.signatures(text))]
    assert found == [("II", "12", "2020"), ("", "7", "2019"), ("III", "5", "2021")]
    assert value(spark, authority.chambers(text)) == ["II", "III"]
    points = lambda a, b: value(spark, authority.signature_points(authority.signatures(F.lit(a)), authority.signatures(F.lit(b))))
    assert points("II FSK 1/20", "II FSK 1/2020") == 3.0 and points("FSK 1/20", "II FSK 1/20") == 3.0
    assert points("I FSK 1/20", "II FSK 1/20") == 2.2 and points("I FSK 1/20", "I FSK 2/20") == 0.25
    assert points("FSK 1/20", "FSK 2/20") == 0.0 and points("I FSK 1/20", None) == 0.0


def test_rule_specificity(spark):
    rank = lambda citation, wording=None: value(spark, authority.rule_specificity(F.lit(citation), F.lit(wording), ("fundacja rodzinna",), ("w tym",)))
    assert [rank(c) for c in ("art. 5", "art. 5 ust. 2a", "art. 5 pkt 1", "art. 5 ust. 1 pkt 2", "Art. 5 UST. 1 pkt 2 lit. c", None)] == [1, 3, 3, 5, 8, 1]
    assert rank("art. 5", "Fundacja  rodzinna, w tym") == 4 and rank("art. 5", "w tym") == 2


def test_article_excerpts(spark):
    cut = lambda t: value(spark, authority.article_excerpt(F.lit(t)))
    assert cut("wstęp Art. 5a. Treść\n dalej  Art. 6. inna") == "Art. 5a. Treść dalej" and cut("Art. 7") == "Art. 7"
    assert cut(" bez \n artykułu ") == "bez artykułu" and cut(" \n") is None and cut(None) is None


def test_opening_quote_falls_back_to_all_domains(spark):
    rows = [(1, 10, "a", ["VAT"], "o samochodach", "Art. 1. samochód"), (1, 11, "b", ["CIT"], "o samochodach", "Art. 2. lokal"), (2, 10, "a", ["VAT"], "", " "), (2, 11, "b", ["CIT"], None, "bez"), (3, 12, "c", None, "x", None)]
    df = spark.createDataFrame(rows, "query_id int, doc_id int, name string, own array<string>, query_text string, text string")
    found = authority.opening_quotes(df, F.lit(1.0), F.array(F.lit("CIT")), F.col("own"), X.query_tokens(F.col("query_text"), 8, 4), [])
    assert {(x["query_id"], x["doc_id"], x["score"], x["quote"]) for x in found.collect()} == {(1, 11, 3.0, "Art. 2. lokal"), (2, 11, 3.0, "bez")}
    other = authority.opening_quotes(df, F.lit(1.0), F.array(F.lit("PIT")), F.col("own"), F.array(F.lit("samoch")), [("samoch", "lokal", -0.1), ("!samoch", "", 9.0)])
    assert {(x["query_id"], x["doc_id"], x["score"]) for x in other.collect()} == {(1, 10, 1.35), (2, 11, 10.0)}


def local_by_hand(rows, shortlist, limit):
    """The ranking of one query, step by step: rows are (key, document, rank, semantic, cross, procedural, asks)."""
    kept = [r for r in rows if not r[5] or r[6]] or rows
    lexical = {r[0]: i for i, r in enumerate(sorted(kept, key=lambda r: (r[2], r[0])), 1)}
    semantic = {r[0]: i for i, r in enumerate(sorted(kept, key=lambda r: (-r[3], r[0])), 1)}
    first = {r[0]: round(0.65 / (20 + lexical[r[0]]) + 0.35 / (20 + semantic[r[0]]) + r[0] % 3 / 50, 6) for r in kept}
    ordered = sorted(kept, key=lambda r: (-first[r[0]], r[0]))
    short = ordered[: max(shortlist, limit)]
    if all(r[4] is not None for r in short):
        second = {r[0]: i for i, r in enumerate(sorted(short, key=lambda r: (-r[4], r[0])), 1)}
        blended = {k: round(0.5 * first[k] + 0.5 * (1 - (i - 1) / max(len(short) - 1, 1)), 6) for k, i in second.items()}
        ordered = sorted(short, key=lambda r: (-blended[r[0]], second[r[0]]))
    leader = min(kept, key=lambda r: lexical[r[0]])
    window = ordered[:limit]
    if leader[1] not in [r[1] for r in window]:
        documents = [r[1] for r in window]
        spare = [i for i, d in enumerate(documents) if documents.count(d) > 1]
        window[spare[-1] if spare else -1] = leader
        ordered = window + [r for r in ordered if r not in window]
    if len(ordered) > limit:
        lead, rest = [], []
        for r in ordered:
            (lead if len(lead) < limit and r[1] not in [x[1] for x in lead] else rest).append(r)
        ordered = lead + rest
    return [r[0] for r in ordered[:limit]]


@pytest.mark.parametrize("limit", [1, 3, 5])
def test_local_ranking_by_hand(spark, limit):
    r = random.Random(limit)
    pools = {}
    for q in range(60):
        size, crossed, asks = r.randint(1, 14), q % 3 != 0, r.random() < 0.3
        pools[q] = [(k, r.randint(0, 4), i + 1, r.randint(0, 5) / 5, r.random() if crossed else None, r.random() < 0.3 or q % 10 == 7, asks) for i, k in enumerate(r.sample(range(50), size))]
    rows = [(q, *x) for q, pool in pools.items() for x in pool]
    df = spark.createDataFrame(rows, "query_id int, doc_id int, document_id int, rank int, semantic double, cross double, procedural boolean, asks_procedure boolean")
    found = {}
    for x in ranking.local_ranked(df, F.col("doc_id") % 3 / 50, F.lit(0.5), 6, limit).orderBy("query_id", "position").collect():
        found.setdefault(x["query_id"], []).append(x["doc_id"])
    assert found == {q: local_by_hand(pool, 6, limit) for q, pool in pools.items()}


def test_plan_keeps_its_order_and_counts_a_text_once_a_type(spark):
    plans = spark.createDataFrame([(1, " Umowa  o dzieło ", ["a", "zz"], ["b", "a"], ["umowa o dzieło", "Umowa o Dzieło", "x"], [None], ["a"], ["b"]), (2, None, None, None, None, None, ["a"], [])], "plan int, question string, locked array<string>, detected array<string>, legal_concepts array<string>, synonyms array<string>, roles array<string>, counter_roles array<string>")
    entries = spark.createDataFrame([("a", "Leasing", "other", ["art. 1", "art. 2", "art. 3"], ["t1", "t2"]), ("b", "Najem", "kind", [], None)], "concept_id string, name string, kind string, provisions array<string>, statutory array<string>")
    found = [tuple(x) for x in authority.plan_families(plans, entries, {"kind": "material_facts"}).orderBy("plan", "position").collect()]
    assert [x[3:6] for x in found] == [
        ("exact_user_phrase", "Umowa o dzieło", False), ("locked_institution", "Leasing", True), ("verified_provision", "art. 1", True), ("verified_provision", "art. 2", True),
        ("statutory_language", "t1", False), ("material_facts", "Najem", False), ("legal_concepts", "umowa o dzieło", False), ("role_and_direction", "Leasing Najem", False),
    ]
    assert found[0][2] == "exact_user_phrase_1" and [x[6] for x in found[:2]] == [1.0, 1.4]


def families_by_hand(plan, entries, types, limit):
    _, question, locked, detected, concepts, synonyms, roles, counter = plan
    made = [("exact_user_phrase", question, False)]
    for e in (entries[i] for i in locked or [] if i in entries):
        made += [("locked_institution", e[1], True)] + [("verified_provision", x, True) for x in (e[3] or [])[:2]] + [("statutory_language", x, False) for x in (e[4] or [])[:1]]
    made += [(types[entries[i][2]], entries[i][1], False) for i in detected or [] if i in entries and entries[i][2] in types]
    made += [("legal_concepts", x, False) for x in (concepts or [])[:2]] + [("model_soft_expansion", x, False) for x in (synonyms or [])[:2]]
    names = [entries[i][1] for i in (roles or []) + (counter or []) if i in entries][:2] if roles and counter else []
    made.append(("role_and_direction", " ".join(x for x in names if x is not None), False))
    found, seen = [], set()
    for kind, text, hard in made:
        clean = " ".join((text or "").split())
        if clean and (kind, clean.lower()) not in seen:
            seen.add((kind, clean.lower()))
            found.append((kind, clean, hard))
    return [(i + 1, *x) for i, x in enumerate(found[:limit])]


@pytest.mark.parametrize("few", [50_000, 0])
def test_plans_gathered_once(spark, monkeypatch, few):
    monkeypatch.setattr(authority, "FEW_ENTRIES", few, raising=False)
    r = random.Random(14)
    text = lambda: r.choice(["A  b", " a B", "c", "", " ", "d\te", None, "C"])
    texts = lambda most: None if r.random() < 0.1 else [text() for _ in range(r.randint(0, most))]
    entries = {str(i): (str(i), text(), r.choice(["k", "l", "m", None]), texts(3), texts(2)) for i in range(9)}
    named = lambda: None if r.random() < 0.1 else [r.choice([*entries, "no", None]) for _ in range(r.randint(0, 4))]
    plans = [(k, text(), named(), named(), texts(3), texts(3), named(), named()) for k in range(200)]
    types = {"k": "material_facts", "l": "legal_concepts"}
    left = spark.createDataFrame(plans, "plan int, question string, locked array<string>, detected array<string>, legal_concepts array<string>, synonyms array<string>, roles array<string>, counter_roles array<string>")
    right = spark.createDataFrame(list(entries.values()), "concept_id string, name string, kind string, provisions array<string>, statutory array<string>")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df, found = authority.plan_families(left, right, types, 5), {}
        for x in df.orderBy("plan", "position").collect():
            found.setdefault(x["plan"], []).append((x["position"], x["type"], x["query"], x["hard"]))
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert found == {p[0]: rows for p in plans if (rows := families_by_hand(p, entries, types, 5))}
    # One join with the dictionary, and a plan's families meet once.
    assert plan.count("Join") == 1 and "Window" not in plan and plan.count("Exchange hashpartitioning") == (1 if few else 3)


@pytest.mark.parametrize("metric", ["dot", "cosine"])
def test_vectors_by_blocks_equal_one_block(spark, monkeypatch, metric):
    r = random.Random(5)
    rows = [(i, [float(r.randint(-4, 4)) for _ in range(4)]) for i in range(300)] + [(300, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    queries = df.filter("vec_id % 3 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    search = lambda: {tuple(x) for x in embedding.nearest(queries, df, 4, metric=metric, least=0.1, besides_self=True).collect()}
    one = search()
    plan = embedding.nearest(queries, df, 4)._jdf.queryExecution().toString()
    assert "place" not in plan and one
    monkeypatch.setattr(embedding, "QUERY_BLOCK", 9)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert search() == one
        assert "place" in embedding.nearest(queries, df, 4)._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("few", [64, 0])
def test_texts_hold_phrases(spark, monkeypatch, few):
    monkeypatch.setattr(fulltext, "FEW_PHRASES", few)
    r = random.Random(few)
    word = lambda n: "".join(r.choice("abż😀 ") for _ in range(n))
    texts = [(i, word(r.randint(0, 30))) for i in range(50)] + [(50, None), (51, "")]
    phrases = [(k, word(r.randint(0, 7))) for k in range(40)] + [(40, None), (41, "nowhere"), (42, ""), (42, "a")]
    found = fulltext.holding(spark.createDataFrame(texts, "doc_id int, text string"), spark.createDataFrame(phrases, "p int, phrase string"), "phrase")
    assert {tuple(x) for x in found.select("doc_id", "p", "phrase").collect()} == {(i, k, p) for i, t in texts for k, p in phrases if t is not None and p is not None and p in t}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert ("NestedLoop" in plan) == (few > 0) and "Cartesian" not in plan


def test_sections_of_long_texts(spark):
    lines = ["ignored", "FACTS", "a", "", " b  c ", "Other", "facts", "Question", "facts", "d", "Decision"] + ["x"] * 20_000
    df = spark.createDataFrame([(1, "\n".join(lines)), (2, None), (3, ""), (4, "facts")], "doc_id int, text string")
    found = {x["doc_id"]: x["s"] for x in df.select("doc_id", X.sections(F.col("text"), ["Facts", "question", "decision"]).alias("s")).collect()}
    assert found == {1: {"facts": "a b c Other d", "decision": " ".join(["x"] * 20_000)}, 2: None, 3: {}, 4: {}}
