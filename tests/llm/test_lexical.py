"""Ranked lexical search against a plain loop."""

import math
import re
from collections import Counter

import pytest

from lantern.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def expected(docs, items, limit=10):
    own = [(d, Counter(terms(t))) for d, t in docs]
    n_docs, total = sum(bool(c) for _, c in own), sum(c.total() for _, c in own)
    df = Counter(t for _, c in own for t in c)
    out = []
    for item, text in items:
        found = []
        for d, c in own:
            m = 25 + (75 * c.total() * n_docs) // total if total else 0
            score = sum(k * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t, k in Counter(terms(text)).items() if t in c)
            if score > 0:
                found.append((-score, (d is not None, d or 0), d))
        out += [(item, rank, d, -s) for rank, (s, _, d) in enumerate(sorted(found)[:limit], 1)]
    return sorted(out, key=str)


DOCS = [
    (1, "The cat sat. The CAT sat!"), (2, "A dog; a cat_and a ΣIGMA Żółw żółw"), (3, None), (4, ""), (5, "... --"), (7, "Żółw " * 3000 + "tail"),
    (6, "x1 x1 2x"), (6, "x1 x1 2x"), (None, "cat null"), (8, "cat\x00dog{a}"), (9, "only here"), (10, "a"), (11, "a a a a"), (12, "dog a"), (13, "dog a"),
]
ITEMS = [(1, "cat cat dog"), (2, "Żółw σigma"), (3, None), (4, "zzz"), (5, "a a x1 2X"), (None, "only"), (1, "sat"), (6, "the cat a dog x1 tail here null and")]


@pytest.mark.parametrize("broadcast", [0, 500_000])
def test_by_force(spark, broadcast, monkeypatch):
    monkeypatch.setattr(lexical, "BROADCAST_TERMS", broadcast)
    docs = spark.createDataFrame([(*r, 1, 2) for r in DOCS], "doc_id long, text string, term int, n int").repartition(3)
    items = spark.createDataFrame([(*r, 3) for r in ITEMS], "item_id long, text string, doc_id int")
    found = [tuple(r) for r in lexical.search_documents(docs, items, limit=4).collect()]
    assert sorted(found, key=str) == expected(DOCS, ITEMS, 4)


def test_whole_index(spark):
    """An index of all terms answers as one of the items' terms does, and any items."""
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    index = lexical.postings(docs)
    assert index.filter("term is not null").count() == sum(len(set(terms(t))) for _, t in DOCS)
    found = lexical.search(index, lexical.item_terms(spark.createDataFrame(ITEMS, "item_id long, text string")))
    assert sorted(map(tuple, found.collect()), key=str) == expected(DOCS, ITEMS)


def test_nothing(spark):
    docs, items = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert lexical.search_documents(docs.limit(0), items).count() == 0
    assert lexical.search_documents(docs, items.limit(0)).count() == 0
    assert lexical.search_documents(docs.filter("doc_id in (3, 4, 5)"), items).count() == 0
