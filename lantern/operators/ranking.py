"""Scores of candidates from named parts, and two-stage ranking."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lantern.operators.fusion import cross_rank_score, hybrid_score
from lantern.operators.selection import diverse_window, first_by

# Weights of the parts of an authority card's score.
CARD_WEIGHTS = {
    "family": 5.0, "tax_match": 0.13, "issue_match": 0.17, "material_fact_match": 0.16, "provision_match": 0.20, "payment_type_match": 0.08,
    "transaction_match": 0.07, "temporal_match": 0.08, "holding_relevance": 0.08, "document_authority_weight": 0.05, "current_special_rule_match": 0.08,
}
# Weight of a document by its kind.
DOCUMENT_WEIGHTS = {"nsa_judgment": 1.0, "wsa_judgment": 0.78, "general_interpretation": 0.72, "individual_interpretation": 0.55}


def clamped(parts: Sequence[Column], low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), sum(parts, F.lit(0.0))))


def document_weight(kind: Column, otherwise: float = 0.3) -> Column:
    out = F.lit(otherwise)
    for name, weight in DOCUMENT_WEIGHTS.items():
        out = F.when(kind == name, weight).otherwise(out)
    return out


def overlap(wanted: Column, found: Column, factor: float, otherwise: float = 0.0) -> Column:
    """Share of the wanted terms that are found, times a factor, 1 at most; ``otherwise`` stands for nothing wanted."""
    share = F.when(F.size(wanted) > 0, F.size(F.array_intersect(wanted, found)) / F.size(F.array_distinct(wanted))).otherwise(F.lit(otherwise))
    return F.least(F.lit(1.0), share * factor)


def temporal_match(status: Column) -> Column:
    return F.when(status == "current", 1.0).when(status == "uncertain", 0.45).otherwise(0.15)


def card_score(parts: Mapping[str, Column], wrong_neighbour: Column, penalized: Column) -> Column:
    """An authority card's score in [0, 1], four digits, half to even; missing parts count nothing."""
    penalty = F.greatest(F.when(wrong_neighbour, 0.35).otherwise(0.0), F.when(penalized, 0.12).otherwise(0.0))
    weighted = [F.lit(w) * parts[c] for c, w in CARD_WEIGHTS.items() if c in parts]
    return F.bround(clamped([*weighted, -penalty], 0.0, 1.0), 4)


def assessment(title_share: Column, body_share: Column, material: Column, provision_share: Column, specific: Column, same: Column, title_confirms: Column, unknown: Column, orthogonal: Column, same_domain: Column, title_hits: Column) -> tuple[Column, Column]:
    """(score from 0 to 100, relation) of a research candidate."""
    mechanism = F.when(title_confirms, 25.0).when(same, 12.0).when(unknown, 7.0).otherwise(0.0)
    provision = F.least(F.lit(20.0), 20 * provision_share) * F.when(specific | (provision_share == 0), 1.0).otherwise(0.45)
    penalty = F.when(orthogonal, -55.0).when(~same & ~unknown, -18.0).otherwise(0.0)
    score = clamped([10 * title_share, 15 * body_share, provision, mechanism, 18 * body_share, F.when(same_domain, 12.0).otherwise(0.0), penalty], 0.0, 100.0)
    relation = (
        F.when(~same_domain | orthogonal | ~same & (material < 2), "different_mechanism")
        .when(same & ~title_confirms, "context_only")
        .when(same & (material >= 2), "direct")
        .when(same & (material > 0) & (title_hits > 0), "strong_analogy")
        .when(~same & (material >= 2), "strong_analogy")
        .otherwise("context_only")
    )
    return score, relation


def capped_blend(base: float, caps: Sequence[tuple[Column, float]]) -> Column:
    """The weight of the cross rank in a row: the least of the base and the caps whose condition holds."""
    return F.least(F.lit(base), *[F.when(c, F.lit(cap)).otherwise(F.lit(base)) for c, cap in caps])


def two_stage(rows: DataFrame, preliminary: Column, cross: Column, blend: Column, shortlist: int, limit: int, query: str = "query_id", key: str = "doc_id", digits: int = 6) -> DataFrame:
    """(query, key, preliminary, blended, position): a shortlist by a weighted sum, reordered with a second ranker.

    ``cross`` is the second ranker's score, an input column. Ranks count from 1 (best) to 0 (last) of the shortlist. The
    leader of the first stage stays: if it falls out of the limit, it takes the last place.
    """
    own = Window.partitionBy(query)
    rows = rows.withColumn("preliminary", F.round(preliminary, digits)).withColumn("_cross", cross).withColumn("_blend", blend)
    rows = rows.withColumn("_first", F.row_number().over(own.orderBy(F.desc("preliminary"), key))).filter(F.col("_first") <= shortlist)
    rows = rows.withColumn("_pool", F.count("*").over(own)).withColumn("_second", F.row_number().over(own.orderBy(F.desc("_cross"), "_first")))
    blended = F.col("_blend") * cross_rank_score(F.col("_second"), F.col("_pool")) + (1 - F.col("_blend")) * cross_rank_score(F.col("_first"), F.col("_pool"))
    rows = rows.withColumn("blended", F.round(blended, digits)).withColumn("_place", F.row_number().over(own.orderBy(F.desc("blended"), "_first")))
    retained = (F.col("_first") == 1) & (F.col("_place") > limit)
    place = F.when(retained, F.lit(float(limit) - 0.5)).otherwise(F.col("_place").cast("double"))
    rows = rows.withColumn("position", F.row_number().over(own.orderBy(place))).filter(F.col("position") <= limit)
    return rows.select(query, key, "preliminary", "blended", "position")


def local_ranked(rows: DataFrame, extra: Column, blend: Column, shortlist: int, limit: int, query: str = "query_id", key: str = "doc_id", document: str = "document_id", digits: int = 6) -> DataFrame:
    """(query, key, document, preliminary, blended, position): the whole local ranking of a query's candidates.

    ``rows`` is (query, key, document, rank, semantic, cross, procedural, asks_procedure), bounded a query by its searches.
    Procedural rows go unless the query asks for procedure or nothing else is left. The preliminary score is the hybrid
    score of both ranks plus ``extra``. The best ``shortlist`` rows (``limit`` at least) are blended with their cross rank
    (1 to 0); where a query has a row of the shortlist without ``cross``, the preliminary order of all rows holds. If the document
    that the search put first isn't among the first ``limit``, its row takes the place of the last row whose document
    stands there twice, or else of the last row. Then documents take turns: the first row of each before second ones.
    """
    own = Window.partitionBy(query)
    rows = rows.withColumn("_keep", F.coalesce(~F.col("procedural") | F.col("asks_procedure"), F.lit(True)))
    rows = rows.withColumn("_any", F.max("_keep").over(own)).filter("_keep or not _any").withColumn("_extra", extra).withColumn("_blend", blend)
    rows = rows.withColumn("_lexical", F.row_number().over(own.orderBy("rank", key))).withColumn("_semantic", F.row_number().over(own.orderBy(F.desc("semantic"), key)))
    rows = rows.withColumn("preliminary", F.round(hybrid_score(F.col("_lexical"), F.col("_semantic")) + F.col("_extra"), digits))
    rows = rows.withColumn("_first", F.row_number().over(own.orderBy(F.desc("preliminary"), key))).withColumn("_short", F.col("_first") <= max(shortlist, limit))
    rows = rows.withColumn("_pool", F.count_if("_short").over(own)).withColumn("_crossed", F.count_if(F.col("_short") & F.col("cross").isNull()).over(own) == 0)
    rows = rows.withColumn("_second", F.row_number().over(own.orderBy(F.desc("_short"), F.desc_nulls_last("cross"), key)))
    mixed = (1 - F.col("_blend")) * F.col("preliminary") + F.col("_blend") * cross_rank_score(F.col("_second"), F.col("_pool"))
    rows = rows.withColumn("blended", F.when(F.col("_crossed") & F.col("_short"), F.round(mixed, digits)).when(~F.col("_crossed"), F.col("preliminary")))
    order = [F.desc_nulls_last("blended"), F.when(F.col("_crossed"), F.col("_second")).otherwise(F.col("_first"))]
    rows = rows.withColumn("_place", F.row_number().over(own.orderBy(*order))).withColumn("_in", F.col("_place") <= limit)

    leader = F.max(F.when(F.col("_lexical") == 1, F.col(document))).over(own)
    rows = rows.withColumn("_leader", leader).withColumn("_held", F.count_if(F.col("_in") & F.col(document).eqNullSafe(F.col("_leader"))).over(own) > 0)
    rows = rows.withColumn("_twice", F.col("_in") & (F.count_if("_in").over(Window.partitionBy(query, document)) > 1))
    rows = rows.withColumn("_victim", F.coalesce(F.max(F.when(F.col("_twice"), F.col("_place"))).over(own), F.lit(limit)))
    moved = F.when((F.col("_lexical") == 1), F.col("_victim").cast("double")).when(F.col("_place") == F.col("_victim"), F.lit(limit + 0.5)).otherwise(F.col("_place").cast("double"))
    rows = rows.withColumn("_order", F.when(F.col("_held"), F.col("_place").cast("double")).otherwise(moved))
    rows = rows.filter(F.col("blended").isNotNull() | ((F.col("_lexical") == 1) & ~F.col("_held"))).drop("rank").withColumn("rank", F.row_number().over(own.orderBy("_order")))
    return diverse_window(rows, limit, query, document).filter(F.col("position") <= limit).select(query, key, document, "preliminary", "blended", "position")


def placed(rows: DataFrame, order: Sequence, by: Sequence[str], limit: int | None = None) -> DataFrame:
    """``rows`` with ``position`` from 1 within ``by``, in the given order of priority; a limit is pushed below the sort."""
    out = rows.withColumn("position", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return out if limit is None else out.filter(F.col("position") <= limit)


def within_documents(seeds: DataFrame, chunks: DataFrame, score: str = "score", query: str = "query_id", document: str = "doc_id", chunk: str = "chunk_id", most: int = 1) -> DataFrame:
    """(query, document, chunk, position): each seed's document keeps its place with its best chunks instead of the seed.

    ``seeds`` is (query, document, position), bounded a query by its search limit. A document's best chunks are found once,
    whatever the number of queries that it is a seed of.
    """
    order = first_by(seeds, [query, document], ["position"]).select(query, document, F.col("position").alias("_seed"))
    wanted = chunks.join(order.select(document).distinct(), document, "left_semi")
    best = placed(wanted, [F.desc(score), chunk], [document], most).select(document, chunk, F.col("position").alias("_nth"))
    rows = best.join(order, document)
    return placed(rows, ["_seed", "_nth"], [query]).select(query, document, chunk, "position")
