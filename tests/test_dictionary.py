"""Phrase dictionaries against regular expressions, and the rules of contexts and locks."""

import re
import unicodedata

import pytest

from lantern.operators import dictionary

PHRASES = ["B+R", "pay&refund", "IP-Box", "ulga na  sponsoring", "c++", ".net", "(a)", "vat", "estoński CIT", "ż", "x", "art. 89a", "--", "", "  ", "a b a", "a b"]
TEXTS = [
    (1, "Ulga B+R, pay&refund i IP‑Box."), (2, "ULGA NA\nSPONSORING i ulgana sponsoring"), (3, "C++ c+++ c++d (c++)"), (4, ".NET asp.net ..net"), (5, "vats vat. VAT-u privat"),
    (6, "Estonski cit oraz ESTOŃSKI CIT"), (7, "art.89a art. 89a. art. 89ab"), (8, None), (9, ""), (10, "... -- ..."), (11, "(a) b (a)"), (12, "a b a b a"), (13, "ż z Ż"), (14, "x"), (14, "x y x"),
    (15, "word " * 3000 + "x"), (16, "+B+R B+R+"),
]


def plain(text):
    low = text.lower().replace("ł", "l")
    low = "".join(c for c in unicodedata.normalize("NFD", low) if not unicodedata.combining(c))
    return re.sub(r"\s+", " ", re.sub("[‐-―]", "-", low)).strip()


def expected():
    out = {}
    for key, text in TEXTS:
        for phrase in PHRASES:
            own = plain(phrase)
            if re.search(r"\w", own):
                # Overlapping occurrences count.
                n = len(re.findall(rf"(?<!\w)(?={re.escape(own)}(?!\w))", plain(text or "")))
                if n:
                    out[key, phrase] = out.get((key, phrase), 0) + n
    return out


@pytest.mark.parametrize("broadcast", [500_000, 0])
def test_hits_by_force(spark, broadcast, monkeypatch):
    monkeypatch.setattr(dictionary, "BROADCAST_ROWS", broadcast)
    texts = spark.createDataFrame([(*t, "clash") for t in TEXTS], "doc_id int, text string, phrase string")
    phrases = spark.createDataFrame([(p,) for p in [*PHRASES, None]], "phrase string")
    hits = dictionary.phrase_hits(texts, phrases)
    found = {(r["doc_id"], r["phrase"]): r["n"] for r in hits.collect()}
    assert found == {k: n for k, n in expected().items()}
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def frames(spark, phrases, concepts):
    return spark.createDataFrame(concepts, "concept_id string, concept_type string, status string, strict boolean"), spark.createDataFrame(phrases, "concept_id string, kind string, place int, phrase string")


CONCEPTS = [("csr", "relief", "active", False), ("strict", "relief", "active", True), ("shadow", "relief", "shadow", False), ("off", "relief", "disabled", False), ("draft", "relief", "draft", False)]
DICTIONARY = [
    ("csr", "exact_phrase", 0, "ulga CSR"), ("csr", "lemma_phrase", 0, "ulgi sponsoringowej"), ("csr", "required_context", 0, "podatek"), ("csr", "required_context", 1, "sport"), ("csr", "negative_context", 0, "reklama"),
    ("strict", "exact_phrase", 0, "IP Box"), ("strict", "context_any", 0, "dochód"), ("strict", "context_any", 1, "patent"), ("strict", "material_concept", 0, "patent"), ("strict", "material_concept", 1, "program"),
    ("shadow", "abbreviation", 0, "CFC"), ("off", "exact_phrase", 0, "ulga CSR"), ("draft", "exact_phrase", 0, "ulga CSR"),
]
CASES = [
    (1, "Czy ulga CSR obejmuje podatek i sport?"), (2, "ulga CSR, podatek"), (3, "ulga CSR: podatek, sport, reklama"), (4, "skorzystać z ulgi sponsoringowej, podatek sport"),
    (5, "IP Box"), (6, "IP Box i patent"), (7, "patent na program"), (8, "CFC"), (9, "umowa sponsoringowa"), (10, "dochod z programu, ip-box5"),
]


def test_contexts_and_locks(spark):
    concepts, phrases = frames(spark, DICTIONARY, CONCEPTS)
    texts = spark.createDataFrame(CASES, "doc_id int, text string")
    found = {(r["doc_id"], r["concept_id"]): (r["kind"], r["confidence"], r["locked"], r["evidence"]) for r in dictionary.recognised(texts, concepts, phrases, [("strict", r"ip.box\d")]).collect()}
    assert found == {
        (1, "csr"): ("exact_phrase", 0.99, True, ["podatek", "sport"]), (2, "csr"): ("exact_phrase", 0.99, False, ["podatek"]), (3, "csr"): ("exact_phrase", 0.99, False, ["podatek", "sport"]),
        (4, "csr"): ("lemma_phrase", 0.95, True, ["podatek", "sport"]), (5, "strict"): ("exact_phrase", 0.99, False, []), (6, "strict"): ("exact_phrase", 0.99, True, ["patent"]),
        (8, "shadow"): ("abbreviation", 0.93, False, []), (10, "strict"): ("safe_regex", 0.94, True, ["dochód"]),
    }


def test_institutions(spark):
    concepts, phrases = frames(spark, DICTIONARY, CONCEPTS)
    texts = spark.createDataFrame(CASES, "doc_id int, text string")
    found = {(r["doc_id"], r["concept_id"]): (r["kind"], r["locked"], r["context_satisfied"]) for r in dictionary.institutions(texts, concepts, phrases).collect()}
    assert found == {
        (1, "csr"): ("exact_phrase", True, True), (2, "csr"): ("exact_phrase", True, True), (3, "csr"): ("exact_phrase", False, True), (4, "csr"): ("lemma_phrase", True, True),
        (5, "strict"): ("exact_phrase", False, False), (6, "strict"): ("exact_phrase", True, True), (7, "strict"): ("contextual_inference", False, True), (8, "shadow"): ("abbreviation", False, True),
    }


def test_related_and_incompatible(spark):
    found = spark.createDataFrame([(1, "a", "exact_phrase", 0.99, True), (1, "b", "abbreviation", 0.61, False)], "doc_id int, concept_id string, kind string, confidence double, locked boolean")
    related = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "c"), ("b", "d")], "concept_id string, related_id string")
    every = dictionary.with_related(found, related)
    assert {(r["concept_id"], r["kind"], r["confidence"], r["locked"]) for r in every.collect()} == {("a", "exact_phrase", 0.99, True), ("b", "abbreviation", 0.61, False), ("c", "related_concept", 0.75, False), ("d", "related_concept", 0.61, False)}
    pairs = spark.createDataFrame([("a", "d"), ("d", "x"), ("c", "a")], "concept_id string, incompatible_with string")
    assert {tuple(r) for r in dictionary.incompatible(every, pairs).collect()} == {(1, "a", "d"), (1, "c", "a")}


def test_nothing_to_look_for(spark):
    texts = spark.createDataFrame(CASES, "doc_id int, text string")
    concepts, phrases = frames(spark, DICTIONARY, CONCEPTS)
    assert dictionary.phrase_hits(texts, phrases.limit(0)).count() == 0
    assert dictionary.recognised(texts.limit(0), concepts, phrases).count() == 0
    assert dictionary.recognised(texts, concepts.limit(0), phrases).count() == 0


def test_a_text_is_not_copied_for_each_of_its_words(spark):
    """A lambda after the explode of words ends generated code, so that each word's row would hold the whole text."""
    texts, phrases = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id int, text string"), spark.createDataFrame([("a b",)], "phrase string")
    hits = dictionary.phrase_hits(texts, phrases)
    assert "lambdafunction" not in hits._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r) for r in hits.collect()] == [(1, "a b", 1)]


def test_matches_are_found_once_for_those_related_to_them(spark):
    from lantern.operators import lineage

    found = spark.createDataFrame([(1, "a", "exact_phrase", 0.99, True)], "doc_id int, concept_id string, kind string, confidence double, locked boolean")
    got = dictionary.with_related(found, spark.createDataFrame([("a", "b")], "concept_id string, related_id string"))
    assert {tuple(r) for r in got.collect()} == {(1, "a", "exact_phrase", 0.99, True), (1, "b", "related_concept", 0.75, False)}
    assert any(x.endswith("/recognised") for x in lineage.written())
