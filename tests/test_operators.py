"""Operators on small inputs with known results, and against plain loops."""

import json
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lantern.functions import calculations, text, vectors
from lantern.operators import chunking, embedding, evaluation, evidence, fulltext, fusion, graph, incremental, inventory, lineage, provisions, selection, temporal
from lantern.sources import readers, writers
from lantern.streaming import ingest


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_citations_are_normalised_once_each(spark):
    c = text.citations(F.lit("Zob. art. 5a  pkt 28, Art. 21 ust. 25 pkt 1 i art. 5a pkt 28."))
    assert value(spark, c) == ["art. 5a pkt 28", "art. 21 ust. 25 pkt 1"]


def test_specificity_of_references(spark):
    assert [value(spark, text.match_specificity(F.lit("art. 2"), F.lit(x))) for x in ("art. 2", "art. 2 ust. 1", "art. 21")] == [2, 1, 0]


def test_redaction_labels_in_order(spark):
    redacted, labels = text.redact(F.lit("a.b@c.org 12345678901"))
    assert value(spark, redacted) == "[REDACTED_EMAIL] [REDACTED_NATIONAL_ID]"
    assert value(spark, labels) == ["email", "national_id"]


def test_sections_fold_lines_under_headings(spark):
    s = text.sections(F.lit("x\nFacts\na\n b  c\nQuestion\nd"), ["facts", "question"])
    assert value(spark, s) == {"facts": "a b c", "question": "d"}


def chunks_by_loop(body, target, overlap):
    parts = [p.strip() for p in body.split("\n\n") if p.strip()]
    if len(body) <= target or not parts:
        return [body]
    done, now = [], ""
    for p in parts:
        if now and len(now) + 2 + len(p) > target:
            done.append(now)
            tail = now[-overlap:].strip() if len(now) > overlap else ""
            now = f"{tail}\n\n{p}" if tail else p
        else:
            now = f"{now}\n\n{p}" if now else p
    return done + [now]


def test_chunks_against_a_loop(spark):
    r = random.Random(1)
    bodies = ["", "x", "\n\n"] + ["\n\n".join("w" * r.randint(1, 60) for _ in range(r.randint(1, 9))) for _ in range(60)]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "doc_id long, text string")
    found = {}
    for row in chunking.chunks(df, target=100, overlap=20).orderBy("doc_id", "chunk_index").collect():
        found.setdefault(row["doc_id"], []).append(row["chunk_text"])
    assert found == {i: chunks_by_loop(b, 100, 20) for i, b in enumerate(bodies)}


def test_units_have_exact_spans(spark):
    body = "Intro\nArt. 1. One\n§ 2. Two\n1) point\nArt. 2. Next\ntail"
    df = spark.createDataFrame([(1, body)], "doc_id long, text string")
    rows = provisions.units(df).orderBy("unit").collect()
    assert [r["citation"] for r in rows] == ["art. 1", "art. 1 § 2", "art. 1 § 2 pkt 1", "art. 2"]
    assert all(body[r["start"] : r["end"]] == r["text"] for r in rows)
    made = chunking.unit_chunks(provisions.units(df).withColumn("ancestors", F.lit("Act")))
    assert made.count() == 4 and made.select("chunk_id").distinct().count() == 4


def test_vectors(spark):
    a, b = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(4.0), F.lit(3.0))
    assert value(spark, vectors.cosine(a, b)) == pytest.approx(0.96)
    assert value(spark, vectors.cosine(a, F.array(F.lit(0.0), F.lit(0.0)))) == 0
    with pytest.raises(Exception, match="differ in length"):
        value(spark, vectors.cosine(a, F.array(F.lit(1.0))))


def test_versions_keep_one_current_revision(spark):
    schema = "item_id string, model string, dimensions int, content_hash string, metadata string, loaded_at int"
    index = spark.createDataFrame([("p1", "m", 3, "h1", "a", 1), ("p2", "m", 3, "h2", "a", 1)], schema)
    new = spark.createDataFrame([("p1", "m", 3, "h9", "b", 2), ("p2", "m", 3, "h2", "b", 2)], schema)
    rows = {(r["item_id"], r["content_hash"]): (r["metadata"], r["is_current"]) for r in embedding.upsert_versions(index, new).collect()}
    assert rows == {("p1", "h1"): ("a", False), ("p1", "h9"): ("b", True), ("p2", "h2"): ("b", True)}
    assert embedding.load_report(index, new).first() == Row(indexed=1, skipped=1)


def test_fusion_counts_a_key_once_a_list(spark):
    rows = [("q", "c", "user", "a", 1), ("q", "c", "user", "a", 2), ("q", "c", "user", "b", 3), ("q", "d", "named_institution_x", "b", 1)]
    out = fusion.reciprocal_rank_fusion(spark.createDataFrame(rows, "query_id string, channel string, family string, doc_id string, rank int")).orderBy("rank").collect()
    assert [(r["doc_id"], r["score"]) for r in out] == [("b", pytest.approx(1 / 63 + 2.5 / 61, abs=1e-8)), ("a", pytest.approx(1 / 61, abs=1e-8))]
    assert out[0]["channel_ranks"] == {"c:user": 3, "d:named_institution_x": 1}


def test_selectors_against_loops(spark):
    r = random.Random(2)
    rows = [(q, i + 1, r.choice("abcd"), r.choice("uvwxyz")) for q in range(20) for i in range(r.randint(0, 14))]
    df = spark.createDataFrame([(q, k, d, c, f"{k}") for q, k, d, c in rows], "query_id int, rank int, doc_id string, canonical string, chunk_id string")
    greedy, window = {}, {}
    for q in range(20):
        own, seen, per, taken = [x for x in rows if x[0] == q], set(), {}, []
        for _, k, d, c in own:
            if c not in seen and per.get(d, 0) < 2:
                seen.add(c)
                per[d] = per.get(d, 0) + 1
                taken.append(k)
        greedy[q] = taken
        firsts = []
        for _, k, d, _ in own:
            if d not in {x[1] for x in firsts} and len(firsts) < 3:
                firsts.append((k, d))
        lead = [k for k, _ in firsts] if len(own) > 3 else []
        window[q] = lead + [x[1] for x in own if x[1] not in lead]
    got = {q: [] for q in range(20)}
    for row in selection.diverse_greedy(df, 2).orderBy("rank").collect():
        got[row["query_id"]].append(row["rank"])
    assert got == greedy
    got = {q: [] for q in range(20)}
    for row in selection.diverse_window(df, 3).orderBy("position").collect():
        got[row["query_id"]].append(row["rank"])
    assert got == window


def test_dependencies_meet_the_broadest_unit_without_a_broadcast(spark):
    r = random.Random(11)
    some = lambda n: r.choice([None, *range(n)])
    units = [(r.randrange(2), r.randrange(4), some(3), some(2), i) for i in range(60)]
    refs = [(r.randrange(2), i % 90, r.randrange(5), some(4), some(3)) for i in range(120)]
    u = spark.createDataFrame(units, "act int, article int, paragraph long, point int, unit_id int")
    df = graph.dependencies(spark.createDataFrame(refs, "act int, ref_id int, article int, paragraph long, point int"), u, ["act"])
    want = {}
    for act, ref, article, paragraph, point in refs:
        for a, b, c, d, i in units:
            if (a, b) == (act, article) and paragraph in (None, c) and point in (None, d):
                want[ref] = min(want.get(ref, (9, 0)), ((c is not None) + (d is not None), i))
    assert {x["ref_id"]: x["unit_id"] for x in df.collect()} == {k: v[1] for k, v in want.items()}
    assert df.count() == len(want)
    # A small table whose explode makes many units.
    parts = spark.range(100).select(F.lit(1).alias("act"), F.col("id").cast("int").alias("article"), F.explode(F.sequence(F.lit(1).cast("long"), F.lit(50).cast("long"))).alias("paragraph"), F.lit(None).cast("int").alias("point"))
    many = graph.dependencies(spark.createDataFrame(refs, "act int, ref_id int, article int, paragraph long, point int"), parts.withColumn("unit_id", F.col("article")), ["act"])
    assert "Broadcast" not in many._jdf.queryExecution().sparkPlan().toString()


def test_lines_are_dealt_to_as_many_files_as_there_are_partitions(spark):
    from lantern.plans import scans

    rows = spark.range(2000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("value"))
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "9")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        path = scans._lines(rows, lineage.reserved(spark, "lines"))
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    back = spark.read.text(path).groupBy(F.input_file_name().alias("f")).agg(F.min(F.col("value").cast("int")).alias("least"), F.count("*").alias("n")).orderBy("f").collect()
    assert len(back) == 9 and sum(x["n"] for x in back) == 2000
    assert [x["least"] for x in back] == sorted(x["least"] for x in back)


def test_covering_and_pinning_against_loops(spark):
    r = random.Random(7)
    rows = [(q, d, d + 1, r.choice(["interpretive", "judicial", "other"]), r.sample("abc", r.randint(0, 2)), r.sample(["x", "y", "z"], r.randint(0, 2))) for q in range(15) for d in range(r.randint(1, 12))]
    df = spark.createDataFrame(rows, "query_id int, doc_id int, rank int, kind string, families array<string>, references array<string>")
    got = {q: [] for q in range(15)}
    for x in selection.covering(df, ["a", "b", "c"], [("interpretive", 2), ("judicial", 1)], 6).orderBy("position").collect():
        got[x["query_id"]].append(x["doc_id"])
    asked = {q: r.sample(["x", "y", "z"], 2) for q in range(0, 15, 2)}
    targets = spark.createDataFrame([(q, i, t) for q, ts in asked.items() for i, t in enumerate(ts)], "query_id int, target_position int, reference string")
    pins = {q: [] for q in range(15)}
    for x in selection.pinned(df, targets, 1).orderBy("position").collect():
        pins[x["query_id"]].append(x["doc_id"])
    for q in range(15):
        own, taken = [x for x in rows if x[0] == q], []
        for kind, n in (("interpretive", 2), ("judicial", 1)):
            for family in "abc" * n:
                taken += [x[1] for x in own if x[1] not in taken and x[3] == kind and family in x[4]][:1]
        assert got[q] == (taken + [x[1] for x in own if x[1] not in taken])[:6]
        taken = []
        for t in asked.get(q, []):
            taken += [x[1] for x in own if x[1] not in taken and t in x[5]][:1]
        assert pins[q] == (taken + [x[1] for x in own if x[1] not in taken])[: max(1, len(asked.get(q, [])))]


def test_chunks_merge_again(spark):
    r = random.Random(4)
    bodies = ["\n\n".join(f"{i}-{k} " + "".join(r.choice("abcdef ") for _ in range(r.randint(20, 150))).strip() for k in range(r.randint(1, 8))) for i in range(40)]
    df = spark.createDataFrame(list(enumerate(bodies)), "doc_id long, text string")
    again = chunking.merged_documents(chunking.chunks(df, target=300, overlap=60)).collect()
    # A chunk's tail and the next paragraph meet at the overlap, so the text is whole again.
    assert {x["doc_id"]: x["text"].split() for x in again} == {i: b.split() for i, b in enumerate(bodies)}


def test_offline_embeddings(spark):
    df = spark.createDataFrame([(1, "Ala ma ala"), (2, None), (3, "  ")], "doc_id long, text string")
    rows = {x["doc_id"]: x["embedding"] for x in embedding.offline_embeddings(df, 16).collect()}
    assert sum(v * v for v in rows[1]) == pytest.approx(1) and set(rows[2]) == set(rows[3]) == {0.0}


def test_mentions_and_excerpts(spark):
    body = "Wstęp. Z wyjątkiem art. 5 ust. 2 stosuje się zasady. " + "x" * 200 + " Zob. Art. 7."
    rows = provisions.mentions(spark.createDataFrame([(1, body), (2, None)], "doc_id long, text string")).orderBy("start").collect()
    assert [(x["reference"], x["relation"]) for x in rows] == [("art. 5 ust. 2", "exception_to"), ("art. 7", "references")]
    assert all(body[x["start"] : x["end"]].lower().startswith("art.") for x in rows)
    assert value(spark, provisions.unsupported(F.lit("art. 1 i art. 2"), F.array(F.lit("Art. 2")))) == ["art. 1"]
    text = "a" * 50 + "\nHEAD\n" + "b" * 50 + "c" * 50
    short = spark.createDataFrame([(text,), ("short",), (None,)], "t string").select(provisions.excerpt(F.col("t"), "^HEAD$", 40, 10, 5, 12, "|").alias("e")).collect()
    assert [x["e"] for x in short] == ["a" * 10 + "|" + "a" * 4 + "\nHEAD\n" + "b" * 7 + "|" + "c" * 10, "short", None]


def test_packing_stops_at_the_budget(spark):
    df = spark.createDataFrame([(1, i, "x" * n) for i, n in enumerate([30, 4, 4, 1])] + [(2, 0, "x" * 99)], "query_id int, position int, text string")
    kept = selection.packed(df, 40).select("query_id", "position").collect()
    assert sorted(map(tuple, kept)) == [(1, 0), (1, 1), (2, 0)]


def test_layers_and_gaps(spark):
    schema = "k string, article long, quality int"
    a, b = spark.createDataFrame([("x", 1, 1), ("x", 4, 2)], schema), spark.createDataFrame([("x", 1, 1), ("x", 4, 3), ("x", 2, 1)], schema)
    rows = {r["article"]: (r["quality"], r["layer"]) for r in selection.layered(a, b, ["k", "article"], ["quality"]).collect()}
    assert rows == {1: (1, 0), 4: (3, 1), 2: (1, 1)}
    assert selection.missing_numbers(a, "k", "article").first()["missing"] == [2, 3]


def test_validity(spark):
    d = lambda x: F.lit(x).cast("date")
    on = lambda s, e, t, l=None: value(spark, temporal.effective_on(d(s), d(e), d(t), None if l is None else d(l)))  # noqa: E731, E741
    assert on("2024-01-01", None, "2025-01-01") and not on("2024-01-01", "2024-06-01", "2025-01-01")
    assert on(None, None, "2025-01-01") and not on(None, None, "2025-01-01", "2026-01-01") and not on("2024-01-01", None, None)


def test_conflicting_versions(spark):
    v = spark.createDataFrame([("a", "1", "active", "2024-01-01", None), ("a", "2", "active", "2025-01-01", None), ("b", "3", "repealed", "2020-01-01", None)], "k string, version string, status string, start string, end string")
    v = v.withColumn("start", F.to_date("start")).withColumn("end", F.to_date("end"))
    w = spark.createDataFrame([("a", "2024-06-01"), ("a", "2025-06-01"), ("b", "2024-06-01")], "k string, target string").withColumn("target", F.to_date("target"))
    rows = {(r["k"], str(r["target"])): (r["version"], r["conflict"]) for r in temporal.lookup(v, w, "k").collect()}
    assert rows == {("a", "2024-06-01"): ("1", False), ("a", "2025-06-01"): (None, True), ("b", "2024-06-01"): (None, False)}


def test_graph_with_a_cycle(spark):
    edges = spark.createDataFrame([("a", "b", "x"), ("b", "c", "y"), ("c", "a", "x"), ("c", "d", "x")], "source string, target string, relation string")
    seeds = spark.createDataFrame([("a",)], "seed string")
    depth = {r["node"]: r["depth"] for r in graph.related(seeds, edges, 5).collect()}
    assert depth == {"a": 0, "b": 1, "c": 2, "d": 3}
    assert {r["node"] for r in graph.related(seeds, edges, 5, relations=["x"]).collect()} == {"a", "b"}
    assert {r["node"] for r in graph.related(seeds, edges, 1, direction="both").collect()} == {"a", "b", "c"}
    assert {r["node"] for r in graph.closure(seeds, edges).collect()} == set("abcd")


def test_evidence(spark):
    cards = spark.createDataFrame([("i", 1, "supporting", 3.0), ("i", 2, "supporting", 9.0), ("i", 3, "supporting", 5.0), ("j", 4, "contrary", 1.0), ("j", 5, "supporting", 1.0)], "issue string, card_id int, stance string, score double")
    rows = {r["issue"]: (r["dominance"], r["examples"]) for r in evidence.authority_lines(cards, cap=2).collect()}
    assert rows == {"i": ("dominant", [2, 3]), "j": ("mixed", [5])}
    none = evidence.errors({"a": F.lit(None).cast("boolean"), "b": F.lit(True)})
    assert value(spark, none) == ["a"]


def test_metrics(spark):
    lit = lambda *x: F.array(*[F.lit(v) for v in x])
    assert value(spark, evaluation.recall_at(lit(1, 2), lit(2, 3, 1), 2)) == 0.5
    assert value(spark, evaluation.precision_at(lit(1, 2), lit(2, 3, 1), 2)) == 0.5
    assert value(spark, evaluation.recall_at(F.array().cast("array<int>"), lit(1), 2)) is None
    assert value(spark, evaluation.nearest_rank(lit(*range(1, 21)), 0.95)) == 19


def test_calculations(spark):
    assert str(value(spark, calculations.proportion(F.lit(100), F.lit(50), F.lit(300)))) == "16.67"
    assert value(spark, calculations.proportion(F.lit(1), F.lit(1), F.lit(0))) is None
    assert [value(spark, calculations.next_key(F.lit(k))) for k in ("25", "25a", "25z")] == ["25a", "25b", "26"]
    assert value(spark, calculations.iso_date(F.lit("soon"))) is None
    assert str(value(spark, calculations.excess_tax(F.lit(2500000), 2000000, 20))) == "100000.00"


def test_readers(spark, tmp_path):
    path = tmp_path / "r.jsonl"
    path.write_text('{"document_id": "a", "issues": ["x"]}\n\nnot json\n{"document_id": "b"}\n')
    good, bad = readers.tolerant_records(spark, str(path))
    assert sorted(r["document_id"] for r in good.collect()) == ["a", "b"] and bad.count() == 1
    both = readers.corpora(spark, {"one": (str(path), "statute"), "again": (str(path), "statute")})
    assert {r["source_id"] for r in both.collect()} == {"one"}
    assert len(readers.manifest_hash(spark, [str(path)])) == 64
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("question", T.StringType())])
    cases = tmp_path / "c.json"
    cases.write_text(json.dumps([{"id": "1", "question": "q"}]))
    assert readers.cases(spark, str(cases), schema, ["question"]).count() == 1
    cases.write_text(json.dumps([{"id": "1", "question": "q"}, {"id": "1", "question": ""}]))
    with pytest.raises(ValueError):
        readers.cases(spark, str(cases), schema, ["question"])
    words = tmp_path / "d.json"
    words.write_text(json.dumps([{"id": "c", "aliases": ["x", " "], "hints": ["y"], "confidence": 0.5}]))
    assert {(r["kind"], r["phrase"]) for r in readers.dictionary(spark, str(words)).collect()} == {("aliases", "x"), ("hints", "y")}


def test_writers_and_incremental(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    path = str(tmp_path / "t")
    writers.add_missing(df, path, ["doc_id"])
    writers.add_missing(df.union(spark.createDataFrame([(3, "c")], df.schema)), path, ["doc_id"])
    assert spark.read.parquet(path).count() == 3
    writers.replace_keys(spark.createDataFrame([(2, "z")], df.schema), path, str(tmp_path / "t2"), "doc_id")
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "t2")).collect()} == {(1, "a"), (2, "z"), (3, "c")}
    assert inventory.health(df, "text", ["a", "q"]).first()["missing"] == ["q"]
    assert incremental.changed(df, df.withColumn("text", F.when(F.col("doc_id") == 2, "n").otherwise(F.col("text"))), "doc_id", ["text"]).first()["doc_id"] == 2


def test_streams(spark, tmp_path):
    rows = [(1, "a", "2024-01-01 00:00:00"), (1, "b", "2024-01-01 00:05:00"), (2, "c", "2024-01-01 00:06:00")]
    df = spark.createDataFrame(rows, "k int, v string, t string").withColumn("t", F.to_timestamp("t"))
    source = str(tmp_path / "in")
    df.coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(df.schema).parquet(source)
    q = ingest.first_seen(stream, "k", "t").writeStream.format("memory").queryName("seen").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start()
    q.awaitTermination(60)
    assert spark.sql("select distinct k from seen").count() == spark.sql("select k from seen").count() == 2
    q = ingest.upsert_stream(stream, str(tmp_path / "out"), "k", ["t"], str(tmp_path / "c2"))
    q.awaitTermination(60)
    df.filter("k = 2").withColumn("v", F.lit("new")).withColumn("t", F.to_timestamp(F.lit("2024-01-02"))).coalesce(1).write.mode("append").parquet(source)
    q = ingest.upsert_stream(stream, str(tmp_path / "out"), "k", ["t"], str(tmp_path / "c2"))
    q.awaitTermination(60)
    assert {(r["k"], r["v"]) for r in spark.read.parquet(str(tmp_path / "out" / "v=1")).collect()} == {(1, "b"), (2, "new")}


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_documents_that_contain_phrases(spark):
    r = random.Random(7)
    words = lambda n: " ".join(r.choice("abcde") * r.randint(1, 2) for _ in range(n))
    docs = [(i, r.choice([words(r.randint(0, 40)), f"x{words(6)}  {words(5)}\n{words(3)}"])) for i in range(60)] + [(60, None), (61, "")]
    phrases = [(k, t[a : a + r.randint(0, 25)]) for k, (t, a) in enumerate((r.choice(docs[:60])[1], r.randint(0, 20)) for _ in range(80))] + [(90, None), (91, "not there at all in any")]
    found = fulltext.containing(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(phrases, "query_id long, query_text string"))
    assert {(x["query_id"], x["doc_id"]) for x in found.collect()} == {(k, i) for k, p in phrases for i, t in docs if p is not None and t is not None and p in t}


def test_nearest_against_a_loop(spark, monkeypatch):
    monkeypatch.setattr(embedding, "QUERY_BLOCK", 3)
    monkeypatch.setattr(embedding, "VECTOR_BLOCK", 7)
    r = random.Random(8)
    rows = [(i, r.choice("ab"), [float(r.randint(-3, 3)) for _ in range(3)]) for i in range(80)] + [(80, "a", [0.0] * 3)]
    df = spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>").union(spark.createDataFrame([(81, "a", None)], "vec_id long, label string, embedding array<double>"))
    queries = df.filter("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("own"), F.col("embedding").alias("query_vector"))
    found = {}
    for x in embedding.nearest(queries, df, 5, within=("own", "label"), besides_self=True).orderBy("query_id", "rank").collect():
        found.setdefault(x["query_id"], []).append((x["vec_id"], x["score"]))
    size = lambda v: sum(x * x for x in v) ** 0.5
    for i, label, v in rows:
        if i % 10 == 0:
            scores = [(k, float(embedding.rounded(sum(a * b for a, b in zip(v, w)) / (size(v) * size(w)) if size(v) * size(w) else 0.0))) for k, other, w in rows if other == label and k != i]
            assert found[i] == sorted(scores, key=lambda x: (-x[1], x[0]))[:5]
    assert embedding.nearest(queries.limit(0), df, 5).count() == 0 and embedding.nearest(queries, df.limit(0), 5).count() == 0
