"""Rank fusion and transparent reranking."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lantern.operators.lineage import small, stored

#: Rows of queries and rules that are broadcast at most.
BROADCAST_ROWS = 500_000

RRF_K = 60
NAMED_CHANNEL_WEIGHT = 2.5
#: Rank of a candidate that a list doesn't have.
ABSENT = 100_000
#: Weights of the named components of the reranker.
COMPONENT_WEIGHTS = {
    "fusion": 5.0, "source_type": 0.6, "tax_domain": 1.1, "taxpayer_role": 0.6, "transaction": 0.9, "payment": 0.7, "jurisdiction": 0.5,
    "positive_constraints": 1.0, "provision_concepts": 1.0, "temporal": 1.2, "explicit_provision": 8.0, "negative_constraint_penalty": 1.4,
    "research_mechanism": 3.4, "research_transaction": 2.4, "research_wrong_neighbor": 8.0, "locked_institution_marker": 7.5,
}


def reciprocal_rank_fusion(lists: DataFrame, k: int = RRF_K, query: str = "query_id", key: str = "doc_id", digits: int = 8) -> DataFrame:
    """(query, key, score, channel_ranks, families, rank) from rows (query, channel, family, key, rank).

    A key counts once a list, at its best rank; ranks are not closed up. Families whose name begins with
    ``named_institution_`` weigh more. Order: score descending, then key.
    """
    once = lists.groupBy(query, "channel", "family", key).agg(F.min("rank").alias("rank"))
    weight = F.when(F.col("family").startswith("named_institution_"), NAMED_CHANNEL_WEIGHT).otherwise(1.0)
    fused = once.groupBy(query, key).agg(
        F.round(F.sum(weight / (k + F.col("rank"))), digits).alias("score"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.concat_ws(":", "channel", "family").alias("channel"), "rank")))).alias("channel_ranks"),
        F.array_sort(F.collect_set("family")).alias("families"),
    )
    return fused.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(F.desc("score"), key)))


def hybrid_score(lexical_rank: Column, semantic_rank: Column, lexical: float = 0.65, semantic: float = 0.35) -> Column:
    return F.lit(lexical) / (20 + lexical_rank) + F.lit(semantic) / (20 + semantic_rank)


def hybrid(lexical: DataFrame, semantic: DataFrame, limit: int, query: str = "query_id", key: str = "doc_id", digits: int = 8) -> DataFrame:
    """Full outer join of two rank lists; an absent rank counts as ABSENT."""
    both = lexical.select(query, key, F.col("rank").alias("lexical_rank")).join(semantic.select(query, key, F.col("rank").alias("semantic_rank")), [query, key], "full_outer")
    both = both.fillna(ABSENT, ["lexical_rank", "semantic_rank"])
    both = both.withColumn("score", F.round(hybrid_score(F.col("lexical_rank"), F.col("semantic_rank")), digits))
    return both.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(F.desc("score"), key))).filter(F.col("rank") <= limit)


def cross_rank_score(rank: Column, pool: Column) -> Column:
    """1 for the first of a pool, 0 for the last."""
    return 1 - (rank - 1) / F.greatest(pool - 1, F.lit(1))


def weighted_components(components: Column, weights: Mapping[str, float] = COMPONENT_WEIGHTS) -> Column:
    """Sum of a map of components times their weights; an unknown component weighs nothing."""
    table = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    return F.aggregate(F.map_entries(components), F.lit(0.0), lambda s, e: s + F.coalesce(F.element_at(table, e["key"]), F.lit(0.0)) * e["value"])


def reasons(components: Column, besides: tuple[str, ...] = ("fusion", "source_type")) -> Column:
    """Names of the components that speak for a candidate."""
    named = F.filter(F.map_entries(components), lambda e: (e["value"] > 0) & ~e["key"].isin(*besides))
    return F.array_sort(F.transform(named, lambda e: e["key"]))


def rule_scores(rows: DataFrame, queries: DataFrame, rules: Sequence[tuple[str, str, float]], query: str = "query_id", key: str = "doc_id", text: str = "text") -> DataFrame:
    """(query, key, score): sum of weights of the rules (query_pattern, row_pattern, weight) that fit query and row.

    The rules are a stated list. Each pattern is held against a text once, in a narrow pass; queries and rows then
    meet by the row patterns that they have. Weights of a query's rules with one pattern are added before.
    """

    def having(texts: DataFrame, own: str, column: str, patterns: list[str]) -> DataFrame:
        low = F.lower(F.col(column))
        found = F.array_compact(F.array(*[F.when(F.rlike(low, F.lit(p)), F.lit(p)) for p in patterns]))
        return texts.select(F.col(own), F.explode(found).alias("_pattern"))

    if not rules:
        return queries.select(query).join(rows.select(key), F.lit(False)).withColumn("score", F.lit(0.0))
    weights = rows.sparkSession.createDataFrame([(a, b, float(w)) for a, b, w in rules], "_pattern string, _row string, weight double")
    active = having(queries, query, "query_text", sorted({a for a, _, _ in rules})).join(F.broadcast(weights), "_pattern")  # the stated list
    active = stored(active.groupBy(query, F.col("_row").alias("_pattern")).agg(F.sum("weight").alias("weight")), "active-rules")
    met = having(rows, key, text, sorted({b for _, b, _ in rules})).join(small(active, BROADCAST_ROWS), "_pattern")
    return met.groupBy(query, key).agg(F.sum("weight").alias("score"))


def section_score(text: Column, signed: Mapping[str, float]) -> Column:
    """Sum of the signed weights of the patterns that a text matches."""
    low = F.lower(text)
    return sum((F.when(F.rlike(low, F.lit(p)), F.lit(w)).otherwise(F.lit(0.0)) for p, w in signed.items()), F.lit(0.0))


def term_share(wanted: Column, found: Column, letters: int = 6) -> Column:
    """Share of the wanted terms with which a found term begins, by so many letters at most."""
    hit = F.filter(wanted, lambda q: F.exists(found, lambda t: F.startswith(t, F.left(q, F.lit(letters)))))
    return F.when(F.size(wanted) > 0, F.size(hit) / F.size(wanted)).otherwise(F.lit(0.0))
