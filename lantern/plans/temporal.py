"""Queries of validity, versions, graphs and calculations."""

from __future__ import annotations

from pyspark.sql import functions as F

from lantern.functions import calculations as C
from lantern.operators import dated, graph, temporal
from lantern.plans.registry import query, table

LINKS = """
    with edges as (
        select 'c' || c_custkey as source, 'n' || c_nationkey as target from customer
        union all select 's' || s_suppkey, 'n' || s_nationkey from supplier
        union all select 'n' || n_nationkey, 'r' || n_regionkey from nation)"""


def _links(spark, sf_dir):
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    edge = lambda t, a, b: table(spark, sf_dir, t).select(a.alias("source"), b.alias("target"), F.lit("part_of").alias("relation"))
    out = edge("customer", name("c", "c_custkey"), name("n", "c_nationkey"))
    out = out.union(edge("supplier", name("s", "s_suppkey"), name("n", "s_nationkey")))
    return out.union(edge("nation", name("n", "n_nationkey"), name("r", "n_regionkey")))


def _versions(spark, sf_dir):
    """Orders as versions of their customer's record: each holds for 400 days, those with status P without an end."""
    start = F.to_date("o_orderdate")
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("record"), F.col("o_orderkey").alias("version"), F.when(F.col("o_orderstatus") == "F", "repealed").otherwise("active").alias("status"), start.alias("start"), F.when(F.col("o_orderstatus") != "P", F.date_add(start, 400)).alias("end"))


@query(
    """
    with v as (select o_custkey as record, o_orderkey as version, case when o_orderstatus = 'F' then 'repealed' else 'active' end as status, o_orderdate::date as s, case when o_orderstatus <> 'P' then o_orderdate::date + 400 end as e from orders)
    select c_custkey as record, count(version) filter (where status = 'active' and s <= date '1997-06-01' and (e is null or date '1997-06-01' <= e)) as n_versions,
        case when count(version) filter (where status = 'active' and s <= date '1997-06-01' and (e is null or date '1997-06-01' <= e)) = 1 then max(version) filter (where status = 'active' and s <= date '1997-06-01' and (e is null or date '1997-06-01' <= e)) end as version,
        count(version) filter (where status = 'active' and s <= date '1997-06-01' and (e is null or date '1997-06-01' <= e)) > 1 as conflict
    from customer left join v on c_custkey = record group by c_custkey"""
)
def exact_lookup(spark, sf_dir):
    wanted = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("record"), F.to_date(F.lit("1997-06-01")).alias("target"))
    return temporal.lookup(_versions(spark, sf_dir), wanted, "record").drop("target")


@query(
    """
    with d(target) as (values (date '1994-01-01'), (date '1996-07-01'), (date '1998-01-01')),
    v as (select o_orderkey, o_orderdate::date as s, case when o_orderstatus <> 'P' then o_orderdate::date + 400 end as e from orders)
    select target, count(*) as n_valid from v join d on s <= target and (e is null or target <= e) group by target"""
)
def validity_join(spark, sf_dir):
    dates = spark.createDataFrame([("1994-01-01",), ("1996-07-01",), ("1998-01-01",)], "d string").select(F.to_date("d").alias("target"))
    return dated.valid_on(_versions(spark, sf_dir), dates).groupBy("target").agg(F.count("*").alias("n_valid"))


@query(
    """
    with n as (select o_orderkey as source, lead(o_orderkey) over (partition by o_custkey order by o_orderdate::date, o_orderkey) as target from orders)
    select source, target from n where target is not null"""
)
def version_successors(spark, sf_dir):
    return temporal.successors(_versions(spark, sf_dir), ["record"], ["start", "version"], "version").drop("relation")


@query(
    f"""{LINKS},
    steps as (select source, target from edges),
    d0 as (select 'c' || c_custkey as seed, 'c' || c_custkey as node, 0 as depth from customer),
    d1 as (select seed, target as node, 1 as depth from d0 join steps on node = source),
    d2 as (select seed, target as node, 2 as depth from d1 join steps on node = source)
    select seed, node, min(depth)::int as depth from (select * from d0 union all select * from d1 union all select * from d2) group by all"""
)
def related_nodes(spark, sf_dir):
    seeds = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("seed"))
    return graph.related(seeds, _links(spark, sf_dir), 2)


@query(
    """
    with recursive e as (select conv_id, turn as source, turn + 1 as target from conversations),
    r(conv_id, seed, node) as (select conv_id, turn, turn from conversations where turn = 0 union select r.conv_id, r.seed, e.target from r join e on r.conv_id = e.conv_id and r.node = e.source)
    select conv_id * 1000 + seed as seed, conv_id * 1000 + node as node from r"""
)
def reference_closure(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    node = F.col("conv_id") * 1000 + F.col("turn")
    seeds = turns.filter("turn = 0").select(node.alias("seed"))
    return graph.closure(seeds, turns.select(node.alias("source"), (node + 1).alias("target")))


@query(
    """
    with r as (select l_orderkey * 10 + l_linenumber as ref_id, l_partkey as article, case when l_linenumber % 2 = 0 then l_suppkey end as paragraph from lineitem),
    u as (select p_partkey as article, s as paragraph, p_partkey * 1000 + coalesce(s, 0) as unit_id from part, (select null as s union all select unnest(range(1, 21)))),
    m as (select ref_id, unit_id, (u.paragraph is not null)::int as spec from r join u on r.article = u.article and (r.paragraph is null or r.paragraph = u.paragraph))
    select ref_id, unit_id from (select *, row_number() over (partition by ref_id order by spec, unit_id) as rn from m) where rn = 1"""
)
def reference_dependencies(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    none = F.lit(None).cast("long")
    refs = lines.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ref_id"), F.col("l_partkey").alias("article"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_suppkey")).alias("paragraph"), none.alias("point"))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("article"), F.explode(F.concat(F.array(none), F.sequence(F.lit(1).cast("long"), F.lit(20).cast("long")))).alias("paragraph"))
    units = parts.select("article", "paragraph", none.alias("point"), (F.col("article") * 1000 + F.coalesce("paragraph", F.lit(0))).alias("unit_id"))
    return graph.dependencies(refs, units, [])


@query(
    """
    with d as (select o_orderkey, o_orderdate::date as event, make_date(year(o_orderdate) + 1, 12, 31) as deadline, (o_orderdate::date + (o_orderkey % 900)::int) as paid from orders)
    select o_orderkey, deadline, case when paid < deadline then 'before_deadline' when paid = deadline then 'on_deadline' else 'after_deadline' end as timing, event + 90 as due from d"""
)
def deadlines(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("event"), F.date_add(F.to_date("o_orderdate"), (F.col("o_orderkey") % 900).cast("int")).alias("paid"))
    rows = rows.withColumn("deadline", C.year_end_deadline(F.col("event"), 1))
    return rows.select("o_orderkey", "deadline", C.against_deadline(F.col("paid"), F.col("deadline")).alias("timing"), F.date_add("event", 90).alias("due"))


@query(
    """
    with m as (select l_orderkey, l_linenumber, l_extendedprice::decimal(18,2) as price, l_quantity::decimal(18,2) as qty from lineitem)
    select l_orderkey, l_linenumber, round(price * 100 / 123.0::decimal(18,2), 0)::bigint as net, round(price * 19 / 100, 0)::bigint as tax, greatest(price - 50000, 0)::double as over_free from m"""
)
def tax_amounts(spark, sf_dir):
    price = F.col("l_extendedprice").cast(C.MONEY)
    over = F.greatest(price - 50000, F.lit(0).cast(C.MONEY)).cast("double")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", C.net_of_gross(price, 23).cast("long").alias("net"), C.share_tax(price, 19).cast("long").alias("tax"), over.alias("over_free"))


@query(
    """
    select s.k as paragraph, case when regexp_matches(s.k, '^[0-9]+$') then s.k || 'a' when s.k like '%z' then (regexp_extract(s.k, '^[0-9]+')::int + 1)::varchar else regexp_extract(s.k, '^[0-9]+') || chr(ascii(right(s.k, 1)) + 1) end as next_paragraph
    from (select p_size::varchar as k from part union select p_size::varchar || substr('abyz', (p_partkey % 4)::int + 1, 1) from part) s"""
)
def next_paragraphs(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    size = F.col("p_size").cast("string")
    keys = part.select(size.alias("paragraph")).union(part.select(F.concat(size, F.substring(F.lit("abyz"), (F.col("p_partkey") % 4 + 1).cast("int"), F.lit(1))))).distinct()
    return keys.select("paragraph", C.next_key(F.col("paragraph")).alias("next_paragraph"))


#: Customers as provisions of an act, numbered 0, 0a, 0z, 0c, 1, 1a, ...; their orders are the versions.
PARAGRAPH_SQL = "(c_custkey // 4)::varchar || substr(' azc', (c_custkey % 4)::int + 1, 1)"
VERSIONS_SQL = f"""
    v as materialized (
        select o_custkey as provision, o_orderkey as version, c_custkey // 200 as document, trim({PARAGRAPH_SQL}) as paragraph, case when o_orderstatus = 'F' then 'repealed' else 'active' end as status,
            o_orderdate::date as s, case when o_orderstatus <> 'P' then o_orderdate::date + 400 end as e from orders join customer on c_custkey = o_custkey),
    d(target) as (values (date '1995-09-01'), (date '1997-03-01')),
    ok as materialized (select target, provision, count(*) as n, max(version) as version from v, d where status = 'active' and s <= target and (e is null or target <= e) group by all)"""


def _provisions(spark, sf_dir):
    k = F.col("c_custkey")
    paragraph = F.trim(F.concat(F.floor(k / 4).cast("string"), F.substring(F.lit(" azc"), (k % 4 + 1).cast("int"), F.lit(1))))
    customers = table(spark, sf_dir, "customer").select(k.alias("record"), F.floor(k / 200).alias("document"), F.lit("1").alias("article"), paragraph.alias("paragraph"))
    return _versions(spark, sf_dir).join(customers, "record").withColumnRenamed("record", "provision")


@query(
    f"""
    with recursive {VERSIONS_SQL},
    p as (select distinct provision, document, paragraph, regexp_extract(paragraph, '^[0-9]+') as number, regexp_extract(paragraph, '[a-z]$') as letter from v),
    steps as (
        select c_custkey as source, c_custkey // 2 as next from customer where c_custkey > 1
        union select a.provision, b.provision from p a join p b on a.document = b.document and b.paragraph = case a.letter when '' then a.number || 'a' when 'z' then (a.number::int + 1)::varchar else a.number || chr(ascii(a.letter) + 1) end),
    r as (
        select c_custkey as seed, target, c_custkey as provision from customer, d
        union select r.seed, r.target, next from r join ok on ok.provision = r.provision and ok.target = r.target and n = 1 join steps on source = r.provision)
    select seed, r.target, r.provision, case when n = 1 then version end as version, n > 1 as conflict from r join ok on ok.provision = r.provision and ok.target = r.target"""
)
def dated_closure(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("seed"))
    seeds = customers.withColumn("target", F.explode(F.array(*[F.to_date(F.lit(x)) for x in ("1995-09-01", "1997-03-01")])))
    links = customers.filter("seed > 1").select(F.col("seed").alias("source"), F.lit(None).cast("long").alias("source_version"), F.floor(F.col("seed") / 2).alias("target"), F.lit("general_rule").alias("type"))
    return dated.applicable(seeds, _provisions(spark, sf_dir), links).drop("depth")


@query(
    """
    with v as (select o_custkey as record, o_orderkey as version, o_orderdate::date as s, case when o_custkey % 7 = 0 then date '1996-12-31' when o_orderstatus <> 'P' then o_orderdate::date + 400 end as e from orders)
    select record, version, date '1992-01-01' + (c_custkey * 3 % 2400)::int as target from v join customer on c_custkey = record where s <= date '1992-01-01' + (c_custkey * 3 % 2400)::int and (e is null or date '1992-01-01' + (c_custkey * 3 % 2400)::int <= e)"""
)
def validity_by_record(spark, sf_dir):
    """Each customer's versions on a date of its own, with end dates that a rule table states for some."""
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("record"))
    dates = customers.withColumn("target", F.date_add(F.to_date(F.lit("1992-01-01")), (F.col("record") * 3 % 2400).cast("int")))
    ends = customers.filter("record % 7 = 0").withColumn("end", F.to_date(F.lit("1996-12-31")))
    return dated.valid_on(dated.with_ends(_versions(spark, sf_dir), ends, "record"), dates, ["record"]).select("record", "version", "target")


@query(
    """
    select count(*) as n_versions, count(*) filter (where trim(o_comment_version) = '') as provisions_without_version, count(*) filter (where s is null) as provisions_without_effective_dates
    from (select case when o_orderkey % 11 = 0 then ' ' else o_orderkey::varchar end as o_comment_version, case when o_orderkey % 13 > 0 then o_orderdate::date end as s from orders)"""
)
def registry_counters(spark, sf_dir):
    version = F.when(F.col("version") % 11 == 0, " ").otherwise(F.col("version").cast("string"))
    return dated.registry_counts(_versions(spark, sf_dir).withColumn("start", F.when(F.col("version") % 13 > 0, F.col("start"))).withColumn("version", version))


@query(
    f"""
    with {VERSIONS_SQL},
    a as (select provision, version, s, max({{'e': coalesce(e, date '9999-12-31'), 'v': version}}) over (partition by provision order by s, version rows between unbounded preceding and 1 preceding) as latest from v where status = 'active')
    select provision, latest.v as version, version as other from a where latest.e >= s"""
)
def overlapping_versions(spark, sf_dir):
    return dated.overlapping(_provisions(spark, sf_dir))
