"""Cover-density ranking: shortest windows of a text that hold all query terms, and what they score.

Positions of the queries' terms come from one pass over the texts, gathered for each document, term and weight, and only those
of documents that hold all of a query's terms meet it. A cover ends at an occurrence and begins at the least of the other
terms' last places before it; it counts if no cover that begins there or later ends earlier. So covers come from running
maxima over a document's matched positions, in one pass over them, never from pairs of positions.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lantern.functions.text import tokens
from lantern.operators.lineage import small, stored

BROADCAST_ROWS = 500_000
# What a term weighs by the class of the field it stands in.
CLASS_WEIGHTS = {"A": 1.0, "B": 0.4, "C": 0.2, "D": 0.1}


def positions(documents: DataFrame, fields: Mapping[str, str], key: str = "doc_id", least: int = 2) -> DataFrame:
    """(key, position, term, weight): the tokens of the fields (column: class), one field after the other, places from 1."""
    own = [tokens(F.coalesce(F.col(c).cast("string"), F.lit("")), least).alias(f"_own{i}") for i, c in enumerate(fields)]
    rows = documents.select(F.col(key), *own)
    weight, upto = None, F.lit(0)
    bounds = []
    for i, kind in enumerate(fields.values()):
        upto = upto + F.size(f"_own{i}")
        bounds.append(upto.alias(f"_upto{i}"))
        fits, w = F.col("_p") < F.col(f"_upto{i}"), F.lit(CLASS_WEIGHTS[kind])
        weight = F.when(fits, w) if weight is None else weight.when(fits, w)
    rows = rows.select(key, *bounds, F.posexplode(F.concat(*[F.col(f"_own{i}") for i in range(len(own))])).alias("_p", "term"))
    return rows.select(key, (F.col("_p") + 1).alias("position"), "term", weight.alias("weight"))


def covers(documents: DataFrame, queries: DataFrame, fields: Mapping[str, str], key: str = "doc_id", query: str = "query_id", column: str = "text", most: int = 5, least: int = 2) -> DataFrame:
    """(query, key, start, end, matched, weights): the shortest windows of a document that hold all of a query's terms.

    A query's terms are its first ``most`` distinct tokens. ``matched`` counts the positions of the window that hold one, and
    ``weights`` sums the reciprocals of their weights. Queries without tokens have none. A window's rows are those of one document and query
    that match; they are sorted and spilled, not collected. ``most`` is at most 62.
    """
    wanted = queries.select(query, F.slice(F.array_distinct(tokens(F.col(column), least)), 1, most).alias("_terms")).filter(F.size("_terms") > 0)
    wanted = stored(wanted.select(query, F.size("_terms").alias("_n"), F.posexplode("_terms").alias("_i", "term")), "cover-terms")
    met = small(wanted, BROADCAST_ROWS)
    found = positions(documents, fields, key, least).join(small(wanted.select("term").distinct(), BROADCAST_ROWS), "term")
    places = stored(found.groupBy(key, "term", "weight").agg(F.collect_list("position").alias("_at")), "cover-places")
    # A query whose terms a document hasn't all is done: a bit for each term.
    have = F.bit_or(F.expr("shiftleft(1L, _i)"))
    full = places.select(key, "term").join(met, "term").groupBy(query, key, "_n").agg(have.alias("_have")).filter("_have = shiftleft(1L, _n) - 1").select(query, key)
    # Dealt out while a term's positions are one row, so that they are exchanged packed.
    rows = full.join(met, query).join(places, [key, "term"]).select(query, key, "_n", "_i", (1 / F.col("weight")).alias("_inverse"), "_at").repartition(query, key)
    rows = rows.select(query, key, "_n", "_i", "_inverse", F.explode("_at").alias("position"))
    by = Window.partitionBy(query, key).orderBy("position")
    upto, before = by.rowsBetween(Window.unboundedPreceding, 0), by.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_sum", F.sum("_inverse").over(upto)).withColumn("_count", F.row_number().over(by))
    rows = rows.withColumn("_before", F.col("_sum") - F.col("_inverse")).withColumn("_earlier", F.col("_count") - 1)

    def least_last(value: str, frame) -> Column:
        """Least of the terms' last values up to a row, 0 until all have occurred; what runs along grows with the position."""
        lasts = [F.max(F.when(F.col("_i") == i, F.col(value))).over(frame) for i in range(most)]
        known = [F.when(F.lit(i) < F.col("_n"), F.coalesce(x, F.lit(0))) for i, x in enumerate(lasts)]
        return F.least(*known, known[0])

    begins = rows.select("*", least_last("position", upto).alias("start"), least_last("position", before).alias("_prior"), least_last("_before", upto).alias("_from_sum"), least_last("_earlier", upto).alias("_from_count"))
    # Beginnings never go back, so of windows with one beginning the first to end, which is the shortest, is where it changes.
    first = begins.filter("start > _prior or start > 0 and _prior is null")
    matched, weights = F.col("_count") - F.col("_from_count"), F.round(F.col("_sum") - F.col("_from_sum"), 9)
    return first.select(query, key, "start", F.col("position").alias("end"), matched.alias("matched"), weights.alias("weights"))


def ranked(found: DataFrame, limit: int, query: str = "query_id", key: str = "doc_id", digits: int = 6) -> DataFrame:
    """(query, key, n_covers, score, rank): documents by the sum over their covers, best first, ties by key.

    A cover counts its matched positions over the sum of their reciprocal weights, over one more than the words in it that
    match nothing: short windows in weighty fields count most.
    """
    noise = F.col("end") - F.col("start") + 1 - F.col("matched")
    part = F.col("matched") / F.col("weights") / (noise + 1)
    scores = found.groupBy(query, key).agg(F.count("*").alias("n_covers"), F.round(F.sum(part), digits).alias("score"))
    w = Window.partitionBy(query).orderBy(F.desc("score"), key)
    return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)
