"""Queries of acts in chunks: made from the customers of a nation, one chunk a customer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lantern.operators import editorial
from lantern.plans.registry import query, table

#: Texts of the chunks, by the remainder of the customer's key; {k} is the key, {b} the one before.
TEXTS = (
    "Art. {k}. 1. Reguła\n1) pierwszy, z wyjątkiem ust. 3 pkt 1\na) litera\nb) litera druga, art. {b}",
    "dalszy ciąg\n2) drugi, zob. ust. 1\n2. Ustęp drugi, w rozumieniu art. {b} ust. 1",
    "art. 5 zawinięty\n3. Trzeci\n1) punkt, pkt 2\nc) litera trzecia",
    "§ 7. Paragraf\n1) punkt paragrafu, § 7 pkt 1\nlit. z) ostatnia",
)


def _sql_text() -> str:
    parts = []
    for i, text in enumerate(TEXTS):
        whole = "replace(replace('" + text.replace("\n", "' || chr(10) || '") + "', '{k}', c_custkey::varchar), '{b}', (c_custkey - 1)::varchar)"
        parts.append(f"when {i} then {whole}")
    return f"case c_custkey % {len(TEXTS)} {' '.join(parts)} end"


#: Units (doc, i, k, x, art, par, sec, pt, let, opens) by a state machine that goes from line to line.
UNITS_SQL = rf"""
    texts as (select c_nationkey as doc, c_custkey as k, regexp_replace({_sql_text()}, '^(Art\. [0-9]+\.) 1\.', '\1' || chr(10) || '1.') as t from customer),
    lines as (select doc, k, unnest(string_split(t, chr(10))) as x, generate_subscripts(string_split(t, chr(10)), 1) as n from texts),
    kinds as materialized (
        select doc, k, x, row_number() over (partition by doc order by k, n) as i,
            case when x like 'Art. %' then 'A' when x like 'art. %' then 'W' when x like '§ %' then 'P' when x like 'lit. %' then 'L'
                when regexp_matches(x, '^[0-9]+\. ') then 's' when regexp_matches(x, '^[0-9]+\) ') then 'p' when regexp_matches(x, '^[a-z]\) ') then 'l' else '-' end as kind,
            regexp_extract(x, '^(?:Art\. |art\. |§ |lit\. )?([0-9]+|[a-z])', 1) as label
        from lines),
    steps as (
        select doc, 0::bigint as i, 0::bigint as k, '' as x, null::varchar as art, null::varchar as par, null::varchar as sec, null::varchar as pt, null::varchar as let, '' as opens from (select distinct doc from kinds)
        union all
        select doc, i, k, x,
            case when o = 'A' then label else art end, case when o = 'A' then null when o = 'P' then label else par end,
            case when o in ('A', 'P') then null when o = 's' then label else sec end, case when o in ('A', 'P', 's') then null when o = 'p' then label else pt end,
            case when o in ('A', 'P', 's', 'p') then null when o = 'l' then label else let end, o
        from (
            select r.doc, q.i, q.k, q.x, q.label, art, par, sec, pt, let,
                case when kind = 'A' or kind = 'W' and art is null then 'A' when kind = 'P' then 'P' when kind = 'L' then 'l' when kind = 's' and (art is not null or par is not null) then 's'
                    when kind = 'p' and (sec is not null or par is not null) then 'p' when kind = 'l' and pt is not null then 'l' else '' end as o
            from steps r join kinds q on q.doc = r.doc and q.i = r.i + 1)),
    units as materialized (
        select doc, row_number() over (partition by doc order by i) as unit, i, k, art, par, sec, pt, let, opens,
            concat_ws(' ', 'art. ' || art, '§ ' || par, 'ust. ' || sec, 'pkt ' || pt, 'lit. ' || let) as citation
        from steps where opens <> '')"""


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, text = F.col("c_custkey"), F.lit(None).cast("string")
    for i, t in enumerate(TEXTS):
        whole = F.replace(F.replace(F.lit(t), F.lit("{k}"), k.cast("string")), F.lit("{b}"), (k - 1).cast("string"))
        text = F.when(k % len(TEXTS) == i, whole).otherwise(text)
    return editorial.units(table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("act"), k.alias("chunk"), text.alias("text")), "act", "chunk")


@query(f"with recursive {UNITS_SQL} select doc as act, unit, citation, k as chunk, case opens when 'A' then 'article' when 'P' then 'paragraph' when 's' then 'section' when 'p' then 'point' else 'letter' end as unit_type from units")
def act_units(spark, sf_dir):
    return _units(spark, sf_dir).filter("not continued").select("act", "unit", "citation", "chunk", "unit_type")


#: What each line refers to (doc, unit, article, paragraph, section, point), read from how the texts are made.
REFERENCES_SQL = rf"""{UNITS_SQL},
    said as (select s.doc, s.k, s.x, max(u.unit) as unit from steps s join units u on u.doc = s.doc and u.i <= s.i group by s.doc, s.k, s.x, s.i),
    refs as (
        select doc, unit, null::varchar as art, null::varchar as par, '3' as sec, '1' as pt, true as rel, 'exception_to' as relation from said where x like '%z wyjątkiem ust. 3 pkt 1'
        union all select doc, unit, (k - 1)::varchar, null, null, null, false, 'references' from said where x like 'b) litera druga, art. %'
        union all select doc, unit, null, null, '1', null, true, 'references' from said where x like '2) drugi, zob. ust. 1'
        union all select doc, unit, (k - 1)::varchar, null, '1', null, false, 'defines' from said where x like '2. Ustęp drugi%'
        union all select doc, unit, '5', null, null, null, false, 'references' from said s where x like 'art. 5 zawinięty' and not exists (select 1 from units u where u.doc = s.doc and u.unit = s.unit and u.art = '5' and u.opens = 'A')
        union all select doc, unit, null, null, null, '2', true, 'references' from said where x like '1) punkt, pkt 2'
        union all select doc, unit, null, '7', null, '1', false, 'references' from said where x like '%§ 7 pkt 1'),
    asked as (
        select r.doc, r.unit, case when rel then u.art else r.art end as art, case when rel then u.par else r.par end as par, case when rel then coalesce(r.sec, u.sec) else r.sec end as sec, r.pt, relation
        from refs r join units u using (doc, unit)),
    named as (
        select a.doc, a.unit as source, t.unit as target, relation
        from asked a join units t on t.doc = a.doc and t.art is not distinct from a.art and t.par is not distinct from a.par and (a.sec is null or t.sec = a.sec) and (a.pt is null or t.pt = a.pt)
        qualify row_number() over (partition by a.doc, a.unit, a.art, a.par, a.sec, a.pt, relation order by (t.sec is not null)::int + (t.pt is not null)::int + (t.let is not null)::int, t.unit) = 1)"""


@query(f"with recursive {REFERENCES_SQL} select distinct doc as act, source, target, relation from named where source <> target")
def act_references(spark, sf_dir):
    found = _units(spark, sf_dir)
    return editorial.resolved(editorial.references(found, "act"), found, "act")


@query(
    f"""
    with recursive {UNITS_SQL},
    p as (select *, concat_ws(' ', 'art. ' || art, case when opens <> 'P' then '§ ' || par end, case when opens <> 's' then 'ust. ' || sec end, case when opens <> 'p' then 'pkt ' || pt end) as parent from units),
    above as (select *, case opens when 'A' then '' else parent end as up from p),
    n as (select doc, unit as source, lead(unit) over (partition by doc, up order by unit) as target from above)
    select doc as act, source, target from n where target is not null union all select doc, target, source from n where target is not null"""
)
def act_neighbours(spark, sf_dir):
    return editorial.edges(_units(spark, sf_dir), "act").filter("relation = 'neighbor'").select("act", "source", "target")
