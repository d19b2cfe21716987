"""The registered queries over the smallest tables: against SQL where there is one, and the pipeline stage by stage."""

import html
import os
import re
from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from lantern.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    result = duck.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(columns)
    assert Counter(tuple(r[c] for c in columns) for r in df.collect()) == Counter(result.fetchall())


def test_extraction_by_force(spark):
    """The driver's articles have paragraphs, bold text and line breaks only."""
    found = {r["page_id"]: r for r in queries.QUERIES["op4_html_extraction"](spark, SF).collect()}
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(found) == len(pages)
    for page in pages:
        inside = re.search("<article>(.*)</article>", page["html"], re.S)[1]
        lines = [" ".join(html.unescape(re.sub("<br>", " ", re.sub("</?b>", "", x))).split()) for x in re.split("</?(?:p|h1)>", inside)]
        text = "\n\n".join(x for x in lines if x)
        assert found[page["page_id"]]["text"] == text and found[page["page_id"]]["n_chars"] == len(text) and found[page["page_id"]]["url"] == page["url"]


def test_every_operator_has_one_query():
    numbers = sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES)
    assert numbers == list(range(1, 14))


def test_pipeline_stages(spark, duck):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    toxic = {r[0] for r in duck.execute("select doc_id from labels where toxic = 1").fetchall()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = corpus_pipeline.materialise(stage(spark, docs, SF), name)
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert docs.columns == columns and set(after) <= set(before)
        if name == "near_duplicates":
            classes = {r["doc_id"]: r["component_id"] for r in corpus_pipeline.jaccard.similar_documents(docs).collect()}
            assert all(i == c for i, c in classes.items())
        if name != "substring_dedup":
            assert all(before[i] == t for i, t in after.items())
        sizes.append(len(after))
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.5 * sizes[0]
    out = corpus_pipeline.run(spark, SF)
    assert out.count() == sizes[-1]
    assert len(toxic) > 0
