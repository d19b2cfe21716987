"""Concepts in texts, rule units, and classes of passages by ordered rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lantern.functions.text import normalize_citation
from lantern.operators.fulltext import holding
from lantern.operators.selection import first_by


def match_concepts(texts: DataFrame, phrases: DataFrame, related: DataFrame, key: str = "doc_id", column: str = "text", most: float = 0.75) -> DataFrame:
    """(key, concept_id, kind, confidence): the best phrase of each concept in a text, and concepts related to those.

    ``phrases`` is (concept_id, kind, phrase, confidence), ``related`` (concept_id, related_id). A derived concept has the confidence of its origin, ``most`` at most, and gives way to
    one that the text has.
    """
    met = holding(texts.select(F.col(key), F.lower(column).alias("_low")), phrases, "phrase", key, "_low")
    found = first_by(met, [key, "concept_id"], [F.desc("confidence"), "kind", "phrase"]).select(key, "concept_id", "kind", "confidence")
    derived = found.join(related, "concept_id").groupBy(key, F.col("related_id").alias("concept_id")).agg(F.max(F.least("confidence", F.lit(most))).alias("confidence"))
    both = found.unionByName(derived.withColumn("kind", F.lit("related_concept"))).withColumn("_derived", F.col("kind") == "related_concept")
    return first_by(both, [key, "concept_id"], ["_derived"]).drop("_derived")


def conflicts(found: DataFrame, incompatible: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, concept_id, incompatible_with): found concepts that exclude others found in the same text."""
    pairs = found.select(key, "concept_id").join(incompatible, "concept_id")
    other = found.select(key, F.col("concept_id").alias("incompatible_with"))
    return pairs.join(other, [key, "incompatible_with"], "left_semi").select(key, "concept_id", "incompatible_with")


def first_rule(text: Column, rules: Sequence[tuple[str, str]], otherwise: str | None = None) -> Column:
    """The name of the first rule (pattern, name) that the lower-cased text fits."""
    low, out = F.lower(text), F.lit(otherwise)
    for pattern, name in reversed(list(rules)):
        out = F.when(F.rlike(low, F.lit(pattern)), name).otherwise(out)
    return out


def outcome(text: Column, rules: Sequence[tuple[str, str, str]], head: int | None = 1200) -> tuple[Column, Column]:
    """(outcome, favourability) by the first rule (pattern, outcome, favourability) that the head of a text, or all of it, fits."""
    start = text if head is None else F.left(text, F.lit(head))
    return first_rule(start, [(p, o) for p, o, _ in rules]), first_rule(start, [(p, f) for p, _, f in rules])


def rule_units(units: DataFrame, conditions: str, kinds: Sequence[tuple[str, str]], column: str = "unit_text") -> DataFrame:
    """``units`` with ``condition``, the clause that the pattern's first group takes from a text, and ``rule_type``."""
    condition = F.nullif(F.trim(F.regexp_extract(F.lower(column), conditions, 1)), F.lit(""))
    return units.withColumn("condition", condition).withColumn("rule_type", first_rule(F.col(column), kinds, "general"))


def unmet_facts(rules: DataFrame, requirements: Sequence[tuple[str, str]], known: Column, column: str = "unit_text") -> DataFrame:
    """``rules`` with ``missing_facts``: facts that the patterns of ``requirements`` (pattern, fact) ask for and that aren't known.

    The requirements are a stated list, held against each text in a narrow pass.
    """
    low = F.lower(column)
    asked = F.array_compact(F.array(*[F.when(F.rlike(low, F.lit(p)), F.lit(fact)) for p, fact in requirements]).cast("array<string>"))
    return rules.withColumn("missing_facts", F.array_sort(F.array_except(asked, known)))


def provision_aliases(provisions: Column, domain: Column) -> Column:
    """The provisions, followed by their normalised forms with the domain before them, each once."""
    canonical = F.transform(provisions, lambda p: F.concat(F.lit("["), F.upper(domain), F.lit("] "), normalize_citation(p)))
    return F.array_distinct(F.concat(provisions, F.coalesce(canonical, F.array().cast("array<string>"))))


def back_references(lane: DataFrame, other: DataFrame, most: int = 2, issue: str = "issue") -> DataFrame:
    """(issue, citation): what a lane cites most often and the other lacks, whole or as part of a narrower citation.

    Both are (issue, citation); ``most`` an issue.
    """
    from lantern.operators.selection import capped

    cited = lane.groupBy(issue, "citation").agg(F.count("*").alias("n"))
    has = other.select(F.col(issue).alias("_issue"), F.col("citation").alias("_has")).distinct()
    covers = (F.col("_has") == F.col("citation")) | F.startswith("_has", F.concat("citation", F.lit(" ")))
    lacks = cited.join(has, (F.col(issue) == F.col("_issue")) & covers, "left_anti")
    return capped(lacks, [issue], [F.desc("n"), "citation"], most).select(issue, "citation")


def timeline_issues(text: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """Codes of the rules (code, pattern, pattern) both of whose patterns the text fits, in order."""
    low = F.lower(text)
    return F.array_compact(F.array(*[F.when(F.rlike(low, F.lit(a)) & F.rlike(low, F.lit(b)), F.lit(code)) for code, a, b in rules]))
