"""Queries that are made from queries: aliases, complementary channels, families and recovery."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lantern.functions.text import query_tokens
from lantern.operators.selection import first_by

HARD, SOFT = 1.4, 1.0


def expansions(queries: DataFrame, rules: Sequence[tuple[str, Sequence[str]]], query: str = "query_id", column: str = "text") -> DataFrame:
    """(query, position, alias): aliases of the rules (pattern, aliases), in their order, whose pattern a query has, each once.

    The rules are a stated list, held against each query in a narrow pass.
    """
    low, none = F.lower(column), F.array().cast("array<string>")
    found = [F.when(F.rlike(low, F.lit(p)), F.array(*map(F.lit, aliases))).otherwise(none) for p, aliases in rules]
    return queries.select(query, F.posexplode(F.array_distinct(F.concat(none, *found))).alias("position", "alias"))


def complementary(queries: DataFrame, rules: Sequence[tuple[str, Sequence[str]]], query: str = "query_id", column: str = "text", most: int = 24) -> DataFrame:
    """(query, channel, tokens): the query's own tokens, and its aliases' if they are others; no empty channel."""
    added = expansions(queries, rules, query, column).groupBy(query).agg(F.array_sort(F.collect_list(F.struct("position", "alias"))).alias("_added"))
    added = added.select(query, F.lit("expansion").alias("channel"), query_tokens(F.array_join(F.transform("_added", lambda x: x["alias"]), " "), most).alias("tokens"))
    own = queries.select(query, F.lit("query").alias("channel"), query_tokens(F.col(column), most).alias("tokens"))
    both = own.unionByName(added).filter(F.size("tokens") > 0)
    return first_by(both, [query, "tokens"], [F.desc("channel")])


def boolean_query(tokens: Column, least: int = 4) -> Column:
    """Tokens of a boolean full-text query: prefixes from ``least`` letters on."""
    return F.array_join(F.transform(tokens, lambda t: F.when(F.length(t) >= least, F.concat(t, F.lit("*"))).otherwise(t)), " ")


def dictionary_channels(definitions: DataFrame, channels: Mapping[str, str], key: str = "concept_id") -> DataFrame:
    """(key, channel, position, query): each array column of a definition as a channel of queries, blank ones left out."""

    def channel(column: str, name: str) -> Column:
        return F.transform(F.coalesce(F.col(column), F.array().cast("array<string>")), lambda q, i: F.struct(F.lit(name).alias("channel"), i.alias("position"), q.alias("query")))

    every = F.concat(*[channel(c, name) for c, name in channels.items()])
    return definitions.select(key, F.explode(every).alias("x")).select(key, "x.channel", "x.position", "x.query").filter(F.trim("query") != "")


def families(plan: DataFrame, limit: int = 8, issue: str = "issue") -> DataFrame:
    """(issue, query, hard, weight, position): the first families of an issue, hard ones before soft ones.

    ``plan`` is (issue, position, query, hard); a query counts once, at its hardest and first mention.
    """
    once = first_by(plan.filter(F.trim("query") != ""), [issue, "query"], [F.desc("hard"), "position"])
    rows = once.withColumn("position", F.row_number().over(Window.partitionBy(issue).orderBy(F.desc("hard"), "position", "query")))
    return rows.filter(F.col("position") <= limit).select(issue, "query", "hard", F.when(F.col("hard"), HARD).otherwise(SOFT).alias("weight"), "position")


def recovery(issues: DataFrame, primary: DataFrame, candidates: DataFrame, per_issue: int = 2, total: int = 8, issue: str = "issue", plan: str = "plan") -> DataFrame:
    """(plan, issue, query): second-pass families (plan, issue, position, query) of the issues without a primary source.

    Each issue has ``per_issue`` families at most and each plan ``total``: the first of all its issues before the second ones.
    ``issues`` and ``primary`` are (plan, issue).
    """
    by = [plan, issue]
    open_issues = issues.select(*by).distinct().join(primary.select(*by).distinct(), by, "left_anti")
    rows = candidates.join(open_issues, by).withColumn("_nth", F.row_number().over(Window.partitionBy(*by).orderBy("position", "query")))
    rows = rows.filter(F.col("_nth") <= per_issue).withColumn("_place", F.row_number().over(Window.partitionBy(plan).orderBy("_nth", issue)))
    return rows.filter(F.col("_place") <= total).select(plan, issue, "query")


def repeated_fields(fields: Mapping[str, int]) -> Column:
    """The fields of an embedding text, each on as many lines as it weighs; blank ones are left out."""
    lines = [F.array_repeat(F.col(c).cast("string"), n) for c, n in fields.items()]
    return F.array_join(F.filter(F.concat(*lines), lambda x: F.trim(x) != ""), "\n")
