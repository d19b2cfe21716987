"""Queries of rules, authority cards, cover density and bucketed tables; the provisions and rulings are made from customers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lantern.operators import cards, density, provisions, ranking, rule_units
from lantern.operators.lineage import reserved
from lantern.plans.registry import query, table
from lantern.plans.retrieval import TOKEN
from lantern.sources import bucketed

RULES = (
    "Art. {k}.\n1. Zwolnione są dochody:\n1) z pracy, jeżeli trwa rok;\n2) z najmu:\na) lokali,\nb)  gruntów.\n2. Nie stosuje się do {k}.",
    "Art. {k}. 1. Pierwszy {k} 2. Drugi, jeżeli trwa",
    "Tekst bez numerów {k}",
)
KINDS = [("nie stosuje", "exclusion"), ("zwolnione", "exemption")]
NEEDS = [("najmu", "lease"), ("pracy", "employment"), ("zwolnione", "income")]


def _made(spark: SparkSession, sf_dir: str, texts: tuple[str, ...]) -> DataFrame:
    k, text = F.col("c_custkey"), F.lit(None).cast("string")
    for i, t in enumerate(texts):
        text = F.when(k % len(texts) == i, F.replace(F.lit(t), F.lit("{k}"), k.cast("string"))).otherwise(text)
    return table(spark, sf_dir, "customer").select(k.alias("doc_id"), text.alias("text"))


def _sql(texts: tuple[str, ...]) -> str:
    parts = [f"when {i} then replace('" + t.replace("\n", "' || chr(10) || '") + "', '{k}', c_custkey::varchar)" for i, t in enumerate(texts)]
    return f"select c_custkey as doc_id, c_custkey % {len(texts)} as shape, case c_custkey % {len(texts)} {' '.join(parts)} end as text from customer"


#: The units that the texts of RULES have, stated one by one.
UNITS_SQL = f"""
    made as ({_sql(RULES)}),
    stated(shape, unit, paragraph, point, letter, lead, body, raw) as (values
        (0, 0, '1', '1', null, 'Zwolnione są dochody:', 'z pracy, jeżeli trwa rok;', 'z pracy, jeżeli trwa rok;'),
        (0, 1, '1', '2', 'a', 'Zwolnione są dochody: z najmu:', 'lokali,', 'lokali,'), (0, 2, '1', '2', 'b', 'Zwolnione są dochody: z najmu:', 'gruntów.', 'gruntów.'),
        (0, 3, '2', null, null, '', 'Nie stosuje się do {{k}}.', 'Nie stosuje się do {{k}}.'),
        (1, 0, '1', null, null, '', 'Pierwszy {{k}}', 'Pierwszy {{k}}'), (1, 1, '2', null, null, '', 'Drugi, jeżeli trwa', 'Drugi, jeżeli trwa'),
        (2, 0, null, null, null, '', 'Tekst bez numerów {{k}}', 'Tekst bez numerów {{k}}')),
    units as (
        select doc_id, unit, paragraph, point, letter, lead, replace(body, '{{k}}', doc_id::varchar) as body, strpos(text, replace(raw, '{{k}}', doc_id::varchar)) - 1 as "start"
        from made join stated using (shape))"""


@query(f"""with {UNITS_SQL} select doc_id, unit, concat_ws(' ', 'ust. ' || paragraph, 'pkt ' || point, 'lit. ' || letter) as citation, lead, body as text, "start"::int as "start", ("start" + length(body))::int as "end" from units""")
def rule_units_nested(spark, sf_dir):
    return rule_units.nested(_made(spark, sf_dir, RULES)).drop("paragraph", "point", "letter")


@query(
    f"""
    with {UNITS_SQL},
    said as (select *, lower(concat_ws(' ', nullif(lead, ''), body)) as t from units)
    select doc_id, unit, nullif(trim(regexp_extract(t, 'jeżeli ([^;.]*)', 1)), '') as condition,
        case when contains(lower(body), 'nie stosuje') then 'exclusion' when contains(lower(body), 'zwolnione') then 'exemption' when contains(lower(lead), 'nie stosuje') then 'exclusion' when contains(lower(lead), 'zwolnione') then 'exemption' else 'general' end as rule_type,
        concat_ws(',', case when contains(t, 'pracy') then 'employment' end, case when contains(t, 'zwolnione') then 'income' end, case when contains(t, 'najmu') then 'lease' end) as required_facts,
        concat_ws(',', case when contains(t, 'pracy') then 'employment' end, case when contains(t, 'najmu') then 'lease' end) as missing_facts
    from said"""
)
def rules_typed(spark, sf_dir):
    found = rule_units.typed(rule_units.nested(_made(spark, sf_dir, RULES)), ["jeżeli ([^;.]*)"], KINDS, NEEDS, F.array(F.lit("income")))
    return found.select("doc_id", "unit", "condition", "rule_type", F.array_join("required_facts", ",").alias("required_facts"), F.array_join("missing_facts", ",").alias("missing_facts"))


RULINGS = (
    "Wniosek {k}\nStan faktyczny: spółka wypłaca dywidendę.\nStanowisko podatnika: zwolnienie przysługuje, art. {k} ust. 1.\nOcena organu: stanowisko jest nieprawidłowe, art. 5 pkt 2.\nUzasadnienie: art. 5 pkt 2 wyłącza zwolnienie.",
    "Sąd zważył, co następuje: skarga jest zasadna, art. {k}.\nStanowisko podatnika: podatek się nie należy.",
    "Pismo {k} bez nagłówków jest prawidłowe.",
)
LABELS = [("facts", "^Stan faktyczny:"), ("taxpayer", "^Stanowisko podatnika:"), ("authority", "^Ocena organu:"), ("court", "^Sąd zważył"), ("reasons", "^Uzasadnienie:")]
FIELDS = {"facts": ["facts"], "taxpayer_position": ["taxpayer"], "authority_holding": ["authority"], "court_holding": ["court"], "reasoning": ["reasons", "court"]}
OUTCOMES = [("nieprawidłowe", "rejected", "unfavourable"), ("zasadna", "quashed", "favourable"), ("prawidłowe", "accepted", "favourable")]

#: Each field's segment, from the line that it begins with: the label stands at a line's beginning and a segment goes up to the next.
CARDS_SQL = f"""
    made as ({_sql(RULINGS)}),
    cut(shape, field, head, tail) as (values
        (0, 'facts', 'Stan faktyczny:', 'Stanowisko podatnika:'), (0, 'taxpayer_position', 'Stanowisko podatnika:', 'Ocena organu:'), (0, 'authority_holding', 'Ocena organu:', 'Uzasadnienie:'), (0, 'reasoning', 'Uzasadnienie:', null),
        (1, 'court_holding', 'Sąd zważył', 'Stanowisko podatnika:'), (1, 'reasoning', 'Sąd zważył', 'Stanowisko podatnika:'), (1, 'taxpayer_position', 'Stanowisko podatnika:', null)),
    spans as (
        select doc_id, field, strpos(text, head) - 1 as s, case when tail is null then length(text) else strpos(text, tail) - 2 end as e, text from made join cut using (shape))"""


def _cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cards.extracted(_made(spark, sf_dir, RULINGS), LABELS, FIELDS, OUTCOMES)


@query(f"""with {CARDS_SQL} select doc_id, field, s::int as "start", e::int as "end", substr(text, s + 1, e - s) as quote, true as valid from spans""")
def card_spans(spark, sf_dir):
    found = cards.spans(_cards(spark, sf_dir), list(FIELDS)).join(_made(spark, sf_dir, RULINGS), "doc_id")
    return provisions.spans_hold(found, "text", "start", "end", "quote").drop("text")


@query(
    f"""
    with {CARDS_SQL}
    select doc_id, case shape when 0 then 'art. ' || doc_id || ' ust. 1,art. 5 pkt 2' when 1 then 'art. ' || doc_id else '' end as provisions,
        case shape when 0 then 'rejected' when 1 then 'quashed' else 'accepted' end as outcome, case shape when 0 then 'unfavourable' else 'favourable' end as favourability,
        round_even(least(1.0, 0.13 + 0.17 * case shape when 0 then 1.0 when 1 then 0.0 else 0.0 end + 0.20 * case shape when 0 then 0.75 else 0.0 end
            + 0.08 * case doc_id % 2 when 0 then 1.0 else 0.15 end + 0.08 * case when shape < 2 then 1.0 else 0.0 end + 0.05 * case shape when 1 then 1.0 else 0.55 end + 0.08 * case when doc_id % 2 = 0 and shape = 0 then 0.5 else 0.0 end)::double, 4) as score
    from made"""
)
def cards_scored(spark, sf_dir):
    """Cards of rulings, scored for one question about dividends and two provisions."""
    made = _cards(spark, sf_dir).join(_made(spark, sf_dir, RULINGS), "doc_id")
    day = lambda x: F.to_date(F.lit(x))
    even = F.col("doc_id") % 2 == 0
    status = cards.temporal_status(day("2020-01-01"), F.when(~even, day("2021-01-01")), day("2024-06-01"))
    kind = F.when(F.col("doc_id") % 3 == 1, "nsa_judgment").otherwise("individual_interpretation")
    strings = lambda *xs: F.array(*map(F.lit, xs)).cast("array<string>")
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(f"{TOKEN}+"), F.lit(0)))
    two = strings("art. 5 pkt 2", "art. 999999")
    asked: dict[str, Column] = {"tax": F.lit(True), "issues": strings("dywidendę", "spółka"), "facts": strings(), "provisions": two, "payments": strings(), "transactions": strings(), "special_rules": two}
    parts = cards.dimensions(F.col("card"), kind, status, asked, words, F.lit(0.0))
    score = ranking.card_score(parts, F.lit(False), F.lit(False))
    return made.select("doc_id", F.array_join("card.provisions", ",").alias("provisions"), "card.outcome", "card.favourability", score.alias("score"))


@query(
    f"""
    with w as (
        select doc_id, row_number() over (partition by doc_id order by f, i) as p, term, case f when 0 then 1.0 else 0.2 end as weight from (
            select doc_id, 0 as f, unnest(regexp_extract_all(lower(source), '{TOKEN}{{2,}}')) as term, generate_subscripts(regexp_extract_all(lower(source), '{TOKEN}{{2,}}'), 1) as i from documents
            union all select doc_id, 1, unnest(regexp_extract_all(lower(text), '{TOKEN}{{2,}}')), generate_subscripts(regexp_extract_all(lower(text), '{TOKEN}{{2,}}'), 1) from documents)),
    t as (select item_id as query_id, term, min(i) as i from (select item_id, unnest(regexp_extract_all(lower(text), '{TOKEN}{{2,}}')) as term, generate_subscripts(regexp_extract_all(lower(text), '{TOKEN}{{2,}}'), 1) as i from benchmark) group by all),
    q as (select query_id, term from t qualify row_number() over (partition by query_id order by i) <= 2),
    n as (select query_id, count(*) as n from q group by query_id),
    m as materialized (select query_id, doc_id, p, w.term, weight from w join q using (term)),
    ends as (select a.query_id, a.doc_id, a.p as e, b.term, max(b.p) as last from m a join m b on a.query_id = b.query_id and a.doc_id = b.doc_id and b.p <= a.p group by all),
    c as (select query_id, doc_id, s, min(e) as e from (select query_id, doc_id, e, min(last) as s from ends join n using (query_id) group by query_id, doc_id, e, n having count(*) = n) group by all),
    x as (select c.query_id, c.doc_id, s, c.e, count(*) as matched, sum(1 / weight) as inv from c join m on m.query_id = c.query_id and m.doc_id = c.doc_id and p between s and c.e group by all),
    r as (select query_id, doc_id, count(*) as n_covers, round(sum(matched / round(inv::double, 9) / (e - s + 1 - matched + 1)), 6) as score from x group by all)
    select *, row_number() over (partition by query_id order by score desc, doc_id)::int as rank from r qualify rank <= 20"""
)
def cover_density_top(spark, sf_dir):
    queries = table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "query_id")
    found = density.covers(table(spark, sf_dir, "documents"), queries, {"source": "A", "text": "C"}, most=2)
    return density.ranked(found, 20)


@query(
    """
    with o as (select o_custkey as k, o_orderdate::date as day, o_orderkey as v, o_orderstatus = 'P' as gone from orders),
    latest as (select * from o qualify row_number() over (partition by k order by day desc, v desc) = 1)
    select k, day, v from latest where not gone"""
)
def orders_upserted(spark, sf_dir):
    """A table with each customer's last order, put together from three batches that come out of order, one of them twice."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.to_date("o_orderdate").alias("day"), F.col("o_orderkey").alias("v"), (F.col("o_orderstatus") == "P").alias("gone"))
    path = reserved(spark, "orders")
    for part in (2, 0, 2, 1):
        bucketed.upsert(orders.filter(F.col("v") % 3 == part), path, ["k"], ["day", "v"])
    return bucketed.read(spark, path).filter(~F.col("gone")).drop("gone")
