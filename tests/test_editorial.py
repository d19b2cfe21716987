"""Units across chunks, relative references and their targets."""

import pytest

from lantern.operators import editorial


def chunks(spark, rows):
    return spark.createDataFrame([(*r, 0) if len(r) == 4 else (*r, None, 0) for r in rows], "doc_id string, chunk_index int, text string, scope string, unit int")


def citations(spark, rows):
    found = editorial.units(chunks(spark, rows), scope="scope").orderBy("doc_id", "unit", "continued").collect()
    return [(r["doc_id"], r["citation"], r["continued"], r["text"]) for r in found]


def test_article_and_first_section_on_one_line(spark):
    text = "Art. 86. 1. Reguła główna z zastrzeżeniem art. 114 oraz\nart. 124.\n2. Kwotę podatku określa faktura.\n10. Prawo powstaje w odpowiednim okresie.\n"
    assert citations(spark, [("vat", 0, text, "86")]) == [
        ("vat", "art. 86", False, ""), ("vat", "art. 86 ust. 1", False, "Reguła główna z zastrzeżeniem art. 114 oraz\nart. 124."),
        ("vat", "art. 86 ust. 2", False, "Kwotę podatku określa faktura."), ("vat", "art. 86 ust. 10", False, "Prawo powstaje w odpowiednim okresie."),
    ]


def test_chunk_takes_its_article_from_the_scope(spark):
    text = "10. Reguła okresu.\n10b. Prawo powstaje po otrzymaniu faktury:\n1) dla zwykłego nabycia;\n11. Trzy następne okresy.\n"
    assert [c for _, c, _, _ in citations(spark, [("vat", 1, text, "86")])] == ["art. 86 ust. 10", "art. 86 ust. 10b", "art. 86 ust. 10b pkt 1", "art. 86 ust. 11"]
    assert citations(spark, [("vat", 1, text)]) == []


def test_state_goes_from_chunk_to_chunk(spark):
    rows = [
        ("a", 1, "dalszy ciąg punktu\nb) litera b\n2) punkt drugi\r\n3. ustęp trzeci"), ("a", 0, "Wstęp\n1. za wcześnie\nArt. 5\n2. ustęp drugi\n1) punkt\na) litera a"),
        ("a", 3, "1) punkt nowego artykułu bez ustępu\n1. ustęp", "6"), ("a", 4, "2. ustęp tego samego artykułu\n1) punkt", "6"), ("a", 2, None), ("b", 0, "§ 3. Paragraf\n1) punkt paragrafu\na) litera\nlit. c) trzecia\npkt 9 dalej\nust. 4 wprost"), ("c", 0, ""),
    ]
    assert citations(spark, rows) == [
        ("a", "art. 5", False, ""), ("a", "art. 5 ust. 2", False, "ustęp drugi"), ("a", "art. 5 ust. 2 pkt 1", False, "punkt"), ("a", "art. 5 ust. 2 pkt 1 lit. a", False, "litera a"),
        ("a", "art. 5 ust. 2 pkt 1 lit. a", True, "dalszy ciąg punktu"), ("a", "art. 5 ust. 2 pkt 1 lit. b", False, "litera b"), ("a", "art. 5 ust. 2 pkt 2", False, "punkt drugi"), ("a", "art. 5 ust. 3", False, "ustęp trzeci"),
        ("a", "art. 6 ust. 1", False, "ustęp"), ("a", "art. 6 ust. 2", False, "ustęp tego samego artykułu"), ("a", "art. 6 ust. 2 pkt 1", False, "punkt"),
        ("b", "§ 3", False, "Paragraf"), ("b", "§ 3 pkt 1", False, "punkt paragrafu"), ("b", "§ 3 pkt 1 lit. a", False, "litera"), ("b", "§ 3 pkt 1 lit. c", False, "trzecia"), ("b", "§ 3 pkt 9", False, "dalej"), ("b", "§ 3 ust. 4", False, "wprost"),
    ]


def test_spans_and_parents(spark):
    text = "Art. 1. 1. Jeden\n  dwa\n1) trzy\na) cztery"
    found = editorial.units(chunks(spark, [("a", 7, text)]), scope="scope").orderBy("unit").collect()
    assert [text[r["start"] : r["end"]] for r in found] == ["Art. 1. ", "1. Jeden\n  dwa\n", "1) trzy\n", "a) cztery"]
    assert [(r["unit_type"], r["parent"], r["chunk_index"]) for r in found] == [("article", None, 7), ("section", "art. 1", 7), ("point", "art. 1 ust. 1", 7), ("letter", "art. 1 ust. 1 pkt 1", 7)]


def test_a_wrapped_reference_opens_nothing_but_the_first_article(spark):
    assert [c for _, c, _, _ in citations(spark, [("a", 0, "art. 7 pierwszy\nart. 8 odesłanie\nArt. 9 drugi")])] == ["art. 7", "art. 9"]


def graph(spark, rows):
    found = editorial.units(chunks(spark, rows), scope="scope")
    names = {(r["doc_id"], r["unit"]): r["citation"] for r in found.collect()}
    return sorted((r["doc_id"], names[r["doc_id"], r["source"]], names[r["doc_id"], r["target"]], r["relation"]) for r in editorial.edges(found).collect())


def test_references(spark):
    text = "Art. 21.\n25. Reguła wydatków.\n30a. Wydatki, o których mowa w ust. 25, obejmują także spłatę kredytu."
    assert graph(spark, [("pit", 0, text)]) == [
        ("pit", "art. 21 ust. 25", "art. 21 ust. 30a", "neighbor"), ("pit", "art. 21 ust. 30a", "art. 21 ust. 25", "neighbor"), ("pit", "art. 21 ust. 30a", "art. 21 ust. 25", "special_rule_for"),
    ]


@pytest.mark.parametrize("reference, target", [("art. 2", "art. 2"), ("art. 2 ust. 1 pkt 2", "art. 2 ust. 1 pkt 2"), ("art. 2 pkt 1", "art. 2 ust. 1 pkt 1"), ("ust. 2", "art. 1 ust. 2"), ("pkt 1", "art. 1 ust. 1 pkt 1"), ("art. 2 ust. 9", None), ("art. 3", None)])
def test_targets(spark, reference, target):
    rows = [("a", 0, f"Art. 1.\n1. Zob. {reference} dalej\n1) jeden\n2. drugi"), ("a", 1, "Art. 2.\n1. ustęp\n1) p\n2) q"), ("b", 0, "Art. 3. inny dokument")]
    found = editorial.units(chunks(spark, rows), scope="scope")
    names = {r["unit"]: r["citation"] for r in found.filter("doc_id = 'a'").collect()}
    got = [(names[r["source"]], names[r["target"]]) for r in editorial.resolved(editorial.references(found), found).collect()]
    assert got == ([("art. 1 ust. 1", target)] if target else [])


def test_versions(spark):
    found = editorial.units(chunks(spark, [("a1", 0, "Art. 1. x\nArt. 2. y"), ("a2", 0, "Art. 1. z"), ("b", 0, "Art. 1. w")]), scope="scope")
    versions = spark.createDataFrame([("a1", "a", "v1", "2020-01-01"), ("a2", "a", "v2", "2024-01-01"), ("b", "b", "v1", None)], "doc_id string, act string, version string, start string")
    assert [tuple(r) for r in editorial.versions_chained(found, versions).collect()] == [("a", "art. 1", "v1", "v2")]


def test_no_chunks(spark):
    found = editorial.units(chunks(spark, []), scope="scope")
    assert found.count() == 0 and editorial.edges(found).count() == 0
