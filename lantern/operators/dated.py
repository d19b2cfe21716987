"""Validity in time as joins: intervals met by months, end dates from rules, and closures that resolve the version at every hop."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lantern.functions.calculations import next_key
from lantern.operators.lineage import small, stored
from lantern.operators.temporal import active_on, effective_on

BROADCAST_ROWS = 500_000
# The links that a provision's version may have, in the order in which they are followed.
LINK_TYPES = ("related", "special_rule", "exception", "general_rule")
#: The link that is generated from a paragraph to the one that follows it in numbering.
NEXT = "next_paragraph"


def month(day: Column) -> Column:
    return (F.year(day) * 12 + F.month(day)).cast("int")


def with_ends(rows: DataFrame, ends: DataFrame, key: str, end: str = "end") -> DataFrame:
    """``rows`` with the end dates that a rule table (key, end) states, in place of their own."""
    rules = stored(ends.groupBy(F.col(key).alias("_key")).agg(F.min(end).alias("_end")), "end-rules")
    met = rows.join(small(rules, BROADCAST_ROWS), F.col(key) == F.col("_key"), "left")
    return met.withColumn(end, F.coalesce("_end", end)).drop("_key", "_end")


def valid_on(units: DataFrame, dates: DataFrame, keys: Sequence[str] = (), start: str = "start", end: str = "end", target: str = "target", legal_state: str | None = None) -> DataFrame:
    """Units (keys, start, end) with the rows of ``dates`` (keys, target) on whose date they hold; see ``effective_on``.

    A unit's interval is split into the months of which any date is asked for, so that open bounds make no more rows than
    closed ones and the join is one by equality of month and keys; the days are then checked in full. The months
    of all dates there are number some thousands at most, so they go to the tasks as values. A null key meets none.
    """
    asked = stored(dates.filter(F.col(target).isNotNull()).withColumn("_month", month(F.col(target))), "dates")
    months = sorted(r[0] for r in asked.select("_month").distinct().collect())  # 12 a year
    state = F.col(legal_state) if legal_state else F.lit(None).cast("date")
    dated = F.col(start).isNotNull() | F.col(end).isNotNull()
    first = F.coalesce(month(F.col(start)), F.when(~dated, month(state)), F.lit(-(10**9)))
    last = F.coalesce(month(F.col(end)), F.lit(10**9))
    every = F.array(*map(F.lit, months)) if months else F.array().cast("array<int>")
    own = units.withColumn("_month", F.explode(F.filter(every, lambda m: (m >= first) & (m <= last))))
    by = [*keys, "_month"]
    # Columns of the dates that the units have too would clash.
    clash = [c for c in dates.columns if c in units.columns and c not in keys]
    for c in clash:
        asked = asked.withColumnRenamed(c, f"_date_{c}")
    day = F.col(f"_date_{target}" if target in clash else target)
    met = own.join(small(asked, BROADCAST_ROWS), by).filter(effective_on(F.col(start), F.col(end), day, state))
    return met.drop("_month", *[f"_date_{c}" for c in clash if c != target])


def next_paragraphs(versions: DataFrame) -> DataFrame:
    """(source, source_version, target, type): from each version with a paragraph to the provisions with the next one.

    ``versions`` is (provision, version, document, article, paragraph, ...). 25 leads to 25a, 25a to 25b and 25z to 26, within a
    document and article; paragraphs that aren't a number with a letter at most lead nowhere.
    """
    paragraph = F.lower(F.trim("paragraph"))
    own = versions.filter(F.rlike(paragraph, F.lit("^[0-9]+[a-z]?$"))).select(F.col("provision").alias("source"), F.col("version").alias("source_version"), "document", "article", next_key(paragraph).alias("paragraph"))
    found = versions.select(F.col("provision").alias("target"), "document", "article", "paragraph").distinct()
    return own.join(found, ["document", "article", "paragraph"]).select("source", "source_version", "target", F.lit(NEXT).alias("type")).distinct()


def _resolved(wanted: DataFrame, versions: DataFrame) -> DataFrame:
    """(seed, target, provision, n_versions, version): the versions of the wanted provisions that hold on their dates."""
    on = active_on(F.col("status"), F.col("start"), F.col("end"), F.col("target"))
    met = wanted.join(versions.select("provision", "version", "status", "start", "end"), "provision").filter(on)
    return met.groupBy("seed", "target", "provision").agg(F.count("*").alias("n_versions"), F.max("version").alias("version"))


def applicable(seeds: DataFrame, versions: DataFrame, links: DataFrame, types: Sequence[str] = LINK_TYPES, neighbours: bool = True) -> DataFrame:
    """(seed, target, provision, version, depth, conflict): what applies on a date, from provisions and what they lead to.

    ``seeds`` is (seed, target): a provision and a date. ``versions`` is (provision, version, document, article, paragraph,
    status, start, end), ``links`` (source, source_version, target, type), of which a null version stands for all. At every hop the
    version is taken that holds on the seed's date: without one a provision is none, and with several it is a conflict,
    which has no version and leads nowhere. With ``neighbours``, versions also lead to the next paragraph of their article.

    Each round follows the versions that the last one resolved; provisions that were looked up once, held or not, aren't
    again, so cycles end. What a round finds is written.
    """
    steps = links.filter(F.col("type").isin(*types)).select("source", "source_version", "target")
    if neighbours:
        steps = steps.unionByName(next_paragraphs(versions).select("source", "source_version", "target"))
    steps = stored(steps.select("source", "source_version", F.col("target").alias("next")).distinct(), "steps")
    wanted = stored(seeds.select("seed", "target", F.col("seed").alias("provision")).distinct(), "wanted")
    looked, out, depth = wanted, None, 0
    while True:
        found = stored(_resolved(wanted, versions).withColumn("depth", F.lit(depth)), "resolved")
        out = found if out is None else out.unionByName(found)
        single = found.filter("n_versions = 1")
        follows = F.col("source_version").isNull() | (F.col("source_version") == F.col("version"))
        met = single.join(steps, (F.col("provision") == F.col("source")) & follows).select("seed", "target", F.col("next").alias("provision")).distinct()
        wanted = stored(met.join(looked, ["seed", "target", "provision"], "left_anti"), "wanted")
        if wanted.isEmpty():
            break
        looked, depth = looked.unionByName(wanted), depth + 1
        if depth % 8 == 0:
            looked, out = stored(looked, "looked"), stored(out, "applicable")
    version = F.when(F.col("n_versions") == 1, F.col("version"))
    return out.select("seed", "target", "provision", version.alias("version"), "depth", (F.col("n_versions") > 1).alias("conflict"))


def registry_counts(versions: DataFrame) -> DataFrame:
    """One row: versions, those without an id of their own, without a start, and provisions that two versions hold at once."""
    blank = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == ""
    own = versions.agg(F.count("*").alias("n_versions"), F.count_if(blank("version")).alias("provisions_without_version"), F.count_if(F.col("start").isNull()).alias("provisions_without_effective_dates"))
    return own


def overlapping(versions: DataFrame) -> DataFrame:
    """(provision, version, other): active versions of a provision whose times overlap the next one's, by start.

    Compared with the latest end so far, so that a provision of many versions is one sort and no pairs.
    """
    from pyspark.sql import Window

    far = F.lit("9999-12-31").cast("date")
    active = versions.filter((F.col("status") == "active") & F.col("start").isNotNull())
    before = Window.partitionBy("provision").orderBy("start", "version").rowsBetween(Window.unboundedPreceding, -1)
    latest = F.max(F.struct(F.coalesce("end", far).alias("end"), F.col("version").alias("version"))).over(before)
    rows = active.select("provision", "version", "start", latest.alias("_latest")).filter("_latest.end >= start")
    return rows.select("provision", F.col("_latest.version").alias("version"), F.col("version").alias("other"))
