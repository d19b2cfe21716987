"""Coverage, lines of authority, bundles of evidence, and validation of claims."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def axis_coverage(hits: DataFrame, axis: str = "axis") -> DataFrame:
    """(axis, coverage, status, missing) from rows with the flags primary, controlling, current, misleading and treaty.

    ``treaty`` is null where none is needed. A misleading neighbour counts against an axis that has no controlling
    rule. Covered: from .80 with all that is needed; partially: from .45 with a primary source.
    """
    flags = hits.groupBy(axis).agg(*[F.coalesce(F.bool_or(c), F.lit(False)).alias(c) for c in ("primary", "controlling", "current", "misleading")], F.bool_or("treaty").alias("treaty"))
    treaty = F.coalesce("treaty", F.lit(True))
    one = lambda c, w: F.when(c, w).otherwise(0.0)
    misled = F.col("misleading") & ~F.col("controlling")
    score = one(F.col("primary"), 0.35) + one(F.col("controlling"), 0.35) + one(F.col("current"), 0.20) + one(treaty, 0.10)
    flags = flags.withColumn("coverage", F.round(F.least(F.when(misled, F.greatest(score - 0.25, F.lit(0.0))).otherwise(score), F.lit(1.0)), 2))
    full = (F.col("coverage") >= 0.80) & F.col("primary") & F.col("controlling") & F.col("current") & treaty & ~misled
    status = F.when(full, "covered").when((F.col("coverage") >= 0.45) & F.col("primary"), "partially_covered").otherwise("unresolved")
    lacks = errors({"controlling_rule": F.col("controlling"), "current_law_source": F.col("current"), "primary_source": F.col("primary"), "treaty_text": treaty})
    return flags.select(axis, "coverage", status.alias("status"), lacks.alias("missing"))


def authority_lines(cards: DataFrame, issue: str = "issue", least_score: float = 0.0, cap: int = 3) -> DataFrame:
    """(issue, supporting, contrary, historical, dominance, examples) from cards (issue, card_id, stance, score).

    Dominant: three and more in support and none against; mixed: both; isolated: one in support alone. ``examples``
    are the ``cap`` best in support.
    """
    n = lambda s: F.count_if(F.col("stance") == s).alias(s)
    kept = cards.filter(F.col("score") >= least_score)
    lines = kept.groupBy(issue).agg(n("supporting"), n("contrary"), n("historical"))
    # The cap is in the window, so no issue's cards are collected.
    nth = F.row_number().over(Window.partitionBy(issue).orderBy(F.desc("score"), "card_id"))
    best = kept.filter("stance = 'supporting'").withColumn("_nth", nth).filter(F.col("_nth") <= cap)
    best = best.groupBy(F.col(issue).alias("_issue")).agg(F.transform(F.array_sort(F.collect_list(F.struct("_nth", "card_id"))), lambda x: x["card_id"]).alias("examples"))
    lines = lines.join(best, F.col(issue).eqNullSafe(F.col("_issue")), "left").drop("_issue")
    lines = lines.withColumn("examples", F.coalesce("examples", F.array().cast(T.ArrayType(cards.schema["card_id"].dataType))))
    s, c = F.col("supporting"), F.col("contrary")
    return lines.withColumn("dominance", F.when((s >= 3) & (c == 0), "dominant").when((s > 0) & (c > 0), "mixed").when(s == 1, "isolated").otherwise("unknown"))


def bundles(evidence: DataFrame, required: Column, issue: str = "issue") -> DataFrame:
    """(issue, kinds, missing, n_sources, confidence): kinds of source an issue has and lacks.

    Confidence is the share of the required kinds that are there, times 1 with three sources and more, less below.
    """
    own = evidence.groupBy(issue).agg(F.array_sort(F.collect_set("kind")).alias("kinds"), F.countDistinct("source_id").alias("n_sources"))
    share = F.size(F.array_intersect("kinds", required)) / F.size(required)
    return own.select(issue, "kinds", F.array_sort(F.array_except(required, F.col("kinds"))).alias("missing"), "n_sources", F.round(share * F.least(F.col("n_sources"), F.lit(3)) / 3, 4).alias("confidence"))


def errors(rules: Mapping[str, Column]) -> Column:
    """Names of the rules that a row breaks, in order; a rule that can't be judged is broken."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))


def lineage(candidates: DataFrame, stages: Mapping[str, DataFrame], key: str) -> DataFrame:
    """Flags of the stages that each candidate reached, and the first that it didn't."""
    out, lost = candidates.select(key).distinct(), F.lit(None).cast("string")
    for name, df in stages.items():
        out = out.join(df.select(key).distinct().withColumn(name, F.lit(True)), key, "left").fillna(False, [name])
    for name in reversed(list(stages)):
        lost = F.when(~F.col(name), F.lit(f"dropped_before_{name}")).otherwise(lost)
    return out.withColumn("drop_reason", lost)


def bind_claims(claims: DataFrame, pool: DataFrame) -> DataFrame:
    """(claim_id, bundle_id, how): equal topic, else topic contained either way, else the same domain.

    ``claims`` (claim_id, topic, domain), ``pool`` (bundle_id, topic, domain); domains are the join key, and an equal
    topic implies none, so it is a join of its own.
    """
    from pyspark.sql import Window

    c, b = claims.alias("c"), pool.alias("b")
    equal = c.join(b, F.col("c.topic") == F.col("b.topic")).select("c.claim_id", "b.bundle_id", F.lit(0).alias("how"))
    within = F.contains("c.topic", F.col("b.topic")) | F.contains("b.topic", F.col("c.topic"))
    near = c.join(b, F.col("c.domain") == F.col("b.domain")).select("c.claim_id", "b.bundle_id", F.when(within, 1).otherwise(2).alias("how"))
    w = Window.partitionBy("claim_id").orderBy("how", "bundle_id")
    return equal.union(near).withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def accepted(bindings: DataFrame, least: float) -> DataFrame:
    """``bindings`` with the reasons against each; those without any are accepted."""
    reasons = errors({"score_below_minimum": F.col("score") >= least, "no_source": F.col("source_id").isNotNull()})
    return bindings.withColumn("reasons", reasons).withColumn("accepted", F.size("reasons") == 0)
