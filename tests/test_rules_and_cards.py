"""Nested rule units, authority cards, cover density and funnels against plain loops."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lantern.operators import cards, density, lineage, rule_units
from lantern.operators.funnel import funnel

TEXTS = {
    1: "Art. 21.\n25. Reguła ogólna.\n30. Wyłączenie.\n30a. Szczególna reguła obejmuje także:\n1) spłatę  kredytu,\n2) odsetki:\na) bieżące,\nb) zaległe.",
    2: "Art. 5. 1. Pierwszy. 2. Drugi: 1) punkt, 2) inny", 3: "Bez numerów", 4: "", 5: None, 6: " \n ", 7: "1. \n2. pełny", 8: "1) sam punkt a) litera b) druga",
}


def test_nested_units(spark):
    rows = spark.createDataFrame([(k, t, "clash") for k, t in TEXTS.items()], "doc_id int, text string, lead string")
    found = rule_units.nested(rows).orderBy("doc_id", "unit").collect()
    assert [(r["doc_id"], r["citation"], r["lead"], r["text"]) for r in found] == [
        (1, "ust. 25", "", "Reguła ogólna."), (1, "ust. 30", "", "Wyłączenie."), (1, "ust. 30a pkt 1", "Szczególna reguła obejmuje także:", "spłatę kredytu,"),
        (1, "ust. 30a pkt 2 lit. a", "Szczególna reguła obejmuje także: odsetki:", "bieżące,"), (1, "ust. 30a pkt 2 lit. b", "Szczególna reguła obejmuje także: odsetki:", "zaległe."),
        (2, "ust. 1", "", "Pierwszy."), (2, "ust. 2 pkt 1", "Drugi:", "punkt,"), (2, "ust. 2 pkt 2", "Drugi:", "inny"), (3, "", "", "Bez numerów"), (7, "ust. 1", "", "2. pełny"),
        (8, "pkt 1 lit. a", "sam punkt", "litera"), (8, "pkt 1 lit. b", "sam punkt", "druga"),
    ]
    for r in found:
        assert " ".join(TEXTS[r["doc_id"]][r["start"] : r["end"]].split()) == r["text"]


def test_types_are_inherited(spark):
    rows = spark.createDataFrame([(1, "1. Nie stosuje się do umów:\n1) najmu, jeżeli trwają rok;\n2) zwolnionych z podatku")], "doc_id int, text string")
    found = rule_units.typed(rule_units.nested(rows), ["jeżeli ([^;]*)", "gdy (.*)"], [("nie stosuje", "exclusion"), ("zwolnion", "exemption")], [("najmu", "lease"), ("umów", "contract")], F.array(F.lit("contract")))
    assert [(r["condition"], r["rule_type"], r["required_facts"], r["missing_facts"]) for r in found.orderBy("unit").collect()] == [("trwają rok", "exclusion", ["contract", "lease"], ["lease"]), (None, "exemption", ["contract"], [])]


LABELS = [("taxpayer", "^Stanowisko podatnika:"), ("authority", "^Ocena:"), ("court", "^Sąd")]


def test_cards(spark):
    texts = {1: "Wstęp art. 1\nStanowisko podatnika: tak, art. 9 ust. 1.\nOcena: nieprawidłowe, art. 9 ust. 1, art. 2.", 2: "Sąd: zasadna.\n\nSąd: drugi raz.", 3: "prawidłowe", 4: None, 5: "  "}
    rows = spark.createDataFrame([(k, t, "x") for k, t in texts.items()], "doc_id int, text string, card string")
    outcomes = [("nieprawidłowe", "rejected", "bad"), ("zasadna", "quashed", "good"), ("prawidłowe", "accepted", "good")]
    found = cards.extracted(rows, LABELS, {"taxpayer_position": ["taxpayer"], "authority_holding": ["authority"], "court_holding": ["court"]}, outcomes)
    got = {r["doc_id"]: r["card"] for r in found.collect()}
    assert [(k, got[k]["outcome"], got[k]["favourability"], got[k]["provisions"]) for k in sorted(got)] == [
        (1, "rejected", "bad", ["art. 1", "art. 9 ust. 1", "art. 2"]), (2, "quashed", "good", []), (3, "accepted", "good", []), (4, None, None, []), (5, None, None, []),
    ]
    spans = cards.spans(found, ["taxpayer_position", "authority_holding", "court_holding"]).collect()
    assert {(r["doc_id"], r["field"]) for r in spans} == {(1, "taxpayer_position"), (1, "authority_holding"), (2, "court_holding")}
    assert all(texts[r["doc_id"]][r["start"] : r["end"]] == r["quote"] for r in spans)


def covers_by_force(words, terms):
    """All windows that hold the terms and in which no smaller one does."""
    at = [i for i, w in enumerate(words) if w in terms]
    windows = [(a, b) for a in at for b in at if a <= b and terms <= set(words[a : b + 1])]
    return {(a + 1, b + 1) for a, b in windows if not any((c, d) != (a, b) and a <= c and d <= b for c, d in windows)}


@pytest.mark.parametrize("broadcast", [500_000, 0])
def test_covers_by_force(spark, broadcast, monkeypatch):
    monkeypatch.setattr(density, "BROADCAST_ROWS", broadcast)
    r = random.Random(2)
    docs = [(k, " ".join(r.choice(["aa", "bb", "cc", "dd", "ee"]) for _ in range(r.randint(0, 25)))) for k in range(40)] + [(99, None)]
    queries = [(1, "aa bb"), (2, "cc aa dd cc"), (3, "zz aa"), (4, None), (5, "ee"), (6, "")]
    found = density.covers(spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(queries, "query_id int, text string"), {"text": "B"}, most=3)
    truth, matched = set(), {}
    for q, text in queries:
        terms = set(list(dict.fromkeys(re.findall("[a-z]{2,}", text or "")))[:3])
        for d, body in docs:
            words = (body or "").split()
            for a, b in covers_by_force(words, terms) if terms else ():
                truth.add((q, d, a, b))
                matched[q, d, a, b] = sum(w in terms for w in words[a - 1 : b])
    got = {(x["query_id"], x["doc_id"], x["start"], x["end"]): (x["matched"], x["weights"]) for x in found.collect()}
    assert set(got) == truth and all(m == matched[k] and w == pytest.approx(m / 0.4) for k, (m, w) in got.items())
    scores = {}
    for (q, d, a, b), m in matched.items():
        scores[q, d] = scores.get((q, d), 0) + 0.4 / (1 + b - a + 1 - m)
    best = {(x["query_id"], x["doc_id"]): x["score"] for x in density.ranked(found, 1000).collect()}
    assert best == pytest.approx(scores, abs=1e-6)


def test_positions_are_kept_once_for_all_queries(spark):
    r = random.Random(8)
    some = lambda n: " ".join(r.choice(["aa", "bb", "cc"]) for _ in range(n))
    docs = [(k, some(r.randint(0, 3)), some(r.randint(0, 12))) for k in range(30)] + [(98, None, "aa " * 200), (99, "cc", None)]
    queries = [(q, "aa bb") for q in range(20)] + [(50, "cc"), (51, "zz aa")]
    known = set(lineage.written())
    found = density.covers(spark.createDataFrame(docs, "doc_id int, title string, text string"), spark.createDataFrame(queries, "query_id int, text string"), {"title": "A", "text": "C"})
    truth = {}
    for d, title, text in docs:
        words, lead = (title or "").split() + (text or "").split(), len((title or "").split())
        for q, asked in queries:
            for a, b in covers_by_force(words, set(asked.split())):
                at = [i for i in range(a - 1, b) if words[i] in asked.split()]
                truth[q, d, a, b] = (len(at), sum(1.0 if i < lead else 5.0 for i in at))
    got = {(x["query_id"], x["doc_id"], x["start"], x["end"]): (x["matched"], x["weights"]) for x in found.collect()}
    assert got == truth and len(got) == found.count()
    # A row for each document, term and class of field, however often a term stands there and whatever asks for it.
    kept = [p for p in lineage.written() if p not in known and not p.endswith("cover-terms")]
    assert sum(spark.read.parquet(p).count() for p in kept) == len({(d, c, w) for d, *texts in docs for c, t in enumerate(texts) for w in (t or "").split()})


def test_funnel_counts_in_one_pass(spark):
    rows = spark.range(100).withColumn("x", F.col("id") % 7)
    kept, counts = funnel(rows, {"even": lambda d: d.filter("id % 2 = 0"), "large": lambda d: d.filter("id >= 50"), "none": lambda d: d.filter("id < 0")}, {"top": F.max("x")})
    assert kept.count() == 0
    assert [tuple(r) for r in counts.orderBy("position").collect()] == [(0, "candidates", 100, None, 6.0), (1, "even", 50, 50, 6.0), (2, "large", 25, 25, 6.0), (3, "none", 0, 25, None)]
