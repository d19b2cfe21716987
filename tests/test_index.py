"""The kept index against a rebuilt one and against a search of the texts."""

import pytest

from lantern.operators import fulltext, index
from lantern.operators.lineage import reserved

FIELDS = {"text": 1.0, "source": 2.5}
DOCS = [
    (1, "The tax relief for housing", "act"), (2, "Housing, housing and houses", "act"), (3, "Taxes on tax-free income", "ruling"), (4, "", "act"),
    (5, None, None), (6, "relief relief", "note"), (7, "ab abc abcd abcde", "x"),
]
QUERIES = [(1, "tax relief housing"), (2, "abc"), (3, "none such"), (4, "act act act"), (5, None)]


@pytest.fixture
def root(spark):
    return reserved(spark, "index")


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def found(spark, root, limit=5):
    return sorted(map(tuple, index.search(spark.createDataFrame(QUERIES, "query_id long, text string"), root, limit).collect()))


def direct(spark, rows, limit=5):
    return sorted(map(tuple, fulltext.search(frame(spark, rows), spark.createDataFrame(QUERIES, "query_id long, text string"), FIELDS, limit).collect()))


def statuses(df):
    return sorted((r["doc_id"], r["status"]) for r in df.collect())


def test_refreshed_index_equals_a_rebuilt_one(spark, root):
    assert {s for _, s in statuses(index.refresh(frame(spark, DOCS), root, FIELDS))} == {"new"}
    assert found(spark, root) == direct(spark, DOCS)
    later = [(1, "The tax relief for cars", "act"), (2, "Housing, housing and houses", "statute"), *DOCS[2:5], DOCS[6], (8, "housing relief", "act")]
    assert statuses(index.refresh(frame(spark, later), root, FIELDS)) == [(1, "changed"), (2, "changed"), (6, "gone"), (8, "new")]
    assert found(spark, root) == direct(spark, later)
    index.refresh(frame(spark, DOCS), root, FIELDS)
    assert found(spark, root) == direct(spark, DOCS)
    before = index.snapshot(spark, root)
    assert before.version == 3 and len(before.generations) == 3
    after = index.compact(spark, root)
    assert after.generations == (4,) and after.dead is None and found(spark, root) == direct(spark, DOCS)
    gone = index.vacuum(spark, root)
    assert "postings/generation=1" in gone and "documents/3" in gone and found(spark, root) == direct(spark, DOCS)


def test_nothing_changed_writes_nothing(spark, root):
    index.refresh(frame(spark, DOCS), root, FIELDS)
    assert index.refresh(frame(spark, DOCS[::-1]), root, FIELDS).count() == 0
    assert index.snapshot(spark, root).version == 1
    assert len(statuses(index.refresh(frame(spark, DOCS), root, FIELDS, index_version="v2"))) == len(DOCS)


def test_search_reads_the_index_alone_and_few_buckets(spark, root):
    index.refresh(frame(spark, DOCS), root, FIELDS)
    at = index.snapshot(spark, root)
    asked = spark.createDataFrame([("housing",)], "token string")
    files = index.postings(spark, at).inputFiles()
    plan = index.hits(spark, at, asked)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert all("/postings/generation=1/bucket=" in f for f in files) and len({f.split("bucket=")[1].split("/")[0] for f in files}) > 5
    assert {(r["doc_id"], r["weighted_tf"]) for r in index.hits(spark, at, asked).collect()} == {(1, 1.0), (2, 2.0)}


def test_odd_documents(spark, root):
    index.refresh(frame(spark, []), root, FIELDS)
    assert found(spark, root) == [] and index.snapshot(spark, root).n == 0
    rows = [(None, "housing", "act"), (9, "housing old", "act"), (9, "housing old", "act"), (9, "housing new", "act")]
    index.refresh(frame(spark, rows), root, FIELDS)
    assert index.snapshot(spark, root).n == 1 and {r[1] for r in found(spark, root)} == {9}
    index.refresh(frame(spark, []), root, FIELDS)
    assert found(spark, root) == [] and index.snapshot(spark, root).n == 0
    with pytest.raises(ValueError):
        found(spark, root + "-none")


def test_many_stems_are_joined(spark, root, monkeypatch):
    monkeypatch.setattr(index, "STEMS_IN_SCAN", 0)
    monkeypatch.setattr(index, "BROADCAST_ROWS", 0)
    index.refresh(frame(spark, DOCS), root, FIELDS)
    index.refresh(frame(spark, DOCS[2:]), root, FIELDS)
    assert found(spark, root) == direct(spark, DOCS[2:])


def test_terms_counted_within_rows_equal_counted_occurrences(spark):
    docs = frame(spark, [*DOCS, (8, "act Act", "act"), (8, "act Act", "act"), (None, "tax", "act")])
    totals = lambda df, name: sorted(map(tuple, df.groupBy("doc_id", "length", name).sum().select("doc_id", "length", name, f"sum({df.columns[-1]})").collect()), key=str)
    assert totals(fulltext.counted(docs, FIELDS), "term") == totals(fulltext.occurrences(docs, FIELDS), "term")
    wanted = spark.createDataFrame([("",), ("tax",), ("abc",), ("hou",), ("housing",)], "token string")
    met = fulltext.counted(docs, FIELDS, wanted=frozenset(r[0] for r in wanted.collect()))
    assert totals(met, "term") == totals(fulltext.matches(fulltext.occurrences(docs, FIELDS), wanted), "token")
    assert "HashAggregate" not in fulltext.counted(docs, FIELDS)._jdf.queryExecution().executedPlan().toString()


def test_many_query_tokens_are_met_by_a_join(spark, monkeypatch):
    few = direct(spark, DOCS)
    monkeypatch.setattr(fulltext, "TOKENS_IN_SCAN", 1)
    assert direct(spark, DOCS) == few


def test_the_pool_of_a_rerank_is_ranked_once(spark):
    from lantern.operators import lineage
    from lantern.plans import evaluation

    before = len(lineage.written())
    evaluation.lost_in_rerank(spark, "/root/testdata/sf0.001")
    assert [x for x in lineage.written()[before:] if x.endswith("/pool")]
