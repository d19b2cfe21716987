"""Exact top-k search by tiled matrix products, partial selection in each tile, and tree merging."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of queries and of candidates that meet in one task; both sides of a task are bounded by these.
QUERY_TILE = 16_384
SHARD_ROWS = 65_536
#: Candidate columns of one matrix product.
COLUMNS = 8_192
FAN_IN = 32
LARGEST = 2**63 - 1


def scaled(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", scale: float = 256.0) -> DataFrame:
    """(vec_id, v): every component x as floor(scale * x), double; exact repeats of a row count once.

    Rows with a null key, a null vector, or a null, NaN or infinite component take no part, nor do those with a
    component that the scale takes beyond the largest double. Search reads the result several times: write it first.
    """
    v = F.col("v")

    def component(x: Column) -> Column:
        y = x * scale
        # From 2**53 on a double has no fraction, and ``floor`` would end at the largest long.
        whole = F.when(F.abs(y) < float(2**53), F.floor(y).cast("double")).otherwise(y)
        return F.when((y < float("inf")) & (y > float("-inf")), whole)

    return (
        vectors.select(vectors[key].cast("long").alias("vec_id"), F.transform(vectors[column].cast("array<double>"), component).alias("v"))
        .filter(F.col("vec_id").isNotNull() & v.isNotNull() & ~F.exists(v, lambda x: x.isNull()))
        .dropDuplicates(["vec_id", "v"])
    )


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> list[np.ndarray]:
    """For each row the columns of the k highest scores, ties to the smaller id; ``ids`` ascend."""
    n = scores.shape[1]
    if n > 4 * k:
        floor = np.partition(scores, n - k, axis=1)[:, n - k]
    else:
        floor = scores.min(axis=1)
    rows, columns = np.nonzero(scores >= floor[:, None])  # everything that ties with the k-th
    order = np.lexsort((columns, ~scores[rows, columns] if scores.dtype == np.int64 else -scores[rows, columns], rows))
    rows, columns = rows[order], columns[order]
    first = np.searchsorted(rows, np.arange(len(scores) + 1))
    return [columns[a : min(a + k, b)] for a, b in zip(first[:-1], first[1:])]


def _tile(k: int):
    def run(queries: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        found = {"query_id": [], "vec_id": [], "score": [], "g": []}
        if len(queries) and len(shard):
            g = int(shard["g"].iat[0])
            shard = shard.sort_values("c_id", kind="stable")
            ids = shard["c_id"].to_numpy(np.int64)
            matrix = np.stack(shard["c_v"].to_list())
            most = float(np.abs(matrix).max(initial=0))
            q_ids = queries["q_id"].to_numpy(np.int64)
            q_all = np.stack(queries["q_v"].to_list())
            exact = matrix.shape[1] * most * float(np.abs(q_all).max(initial=0)) < 2**53
            for lo in range(0, len(ids), COLUMNS):
                part, part_ids = matrix[lo : lo + COLUMNS], ids[lo : lo + COLUMNS]
                for at in range(0, len(q_ids), 256):
                    own = q_ids[at : at + 256]
                    # Sums under 2**53 are exact in any order; beyond it Python's integers are.
                    if exact:
                        scores = q_all[at : at + 256] @ part.T
                    else:
                        scores = np.frompyfunc(int, 1, 1)(q_all[at : at + 256]).dot(np.frompyfunc(int, 1, 1)(part).T)
                        scores = np.clip(scores, -LARGEST - 1, LARGEST).astype(np.int64)
                    # A query's own rows stand in at most a few columns: take that many more and drop them.
                    a, b = np.searchsorted(part_ids, own, "left"), np.searchsorted(part_ids, own, "right")
                    for i, columns in enumerate(best(scores, part_ids, k + int((b - a).max(initial=0)))):
                        columns = columns[part_ids[columns] != own[i]][:k]
                        found["query_id"].append(np.full(len(columns), own[i]))
                        found["vec_id"].append(part_ids[columns])
                        found["score"].append(scores[i, columns].astype(np.int64))
                        found["g"].append(np.full(len(columns), g))
        return pd.DataFrame({c: np.concatenate(x) if x else np.zeros(0, np.int64) for c, x in found.items()})

    return run


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest integer inner products among the candidates.

    Both inputs are (vec_id, v) as from ``scaled``. Candidates with the query's own id are left out; ties go to the
    smaller vec_id; a query with fewer candidates gets all. Vectors meet only those of their own dimension. An id that
    occurs with two different vectors gives each candidate its best score. Empty inputs give no rows. A score beyond
    a long counts as the largest or smallest long, ties among those again by vec_id.

    A task multiplies one tile of queries by one shard of candidates; tiles are copied to the shards and shards to
    the tiles, so neither side is ever whole in a task. Each shard passes on k rows a query, merged FAN_IN at a time.
    """
    n_q, n_c = queries.count(), candidates.count()
    spark = queries.sparkSession
    tiles = max(1, -(-n_q // QUERY_TILE))
    shards = max(1, -(-n_c // SHARD_ROWS), min(int(spark.conf.get("spark.sql.shuffle.partitions")), n_c // 2_000))
    place = lambda salt, n: F.pmod(F.xxhash64("vec_id", F.hash("v"), F.lit(salt)), F.lit(n)).cast("int")
    q = queries.select(F.col("vec_id").alias("q_id"), F.col("v").alias("q_v"), F.size("v").alias("dim"), place(1, tiles).alias("t"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("g"))
    c = candidates.select(F.col("vec_id").alias("c_id"), F.col("v").alias("c_v"), F.size("v").alias("dim"), place(2, shards).alias("g"), F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("t"))
    keys = ("dim", "g", "t")
    found = q.groupBy(*keys).cogroup(c.groupBy(*keys)).applyInPandas(_tile(k), "query_id long, vec_id long, score long, g long")

    def merged(df: DataFrame, *by: str) -> DataFrame:
        df = df.groupBy(*by, "vec_id").agg(F.max("score").alias("score"))
        w = Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id")
        return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)

    while shards > FAN_IN:
        shards = -(-shards // FAN_IN)
        found = merged(found.withColumn("g", F.floor(F.col("g") / FAN_IN)), "query_id", "g").drop("rank")
    return merged(found.drop("g"), "query_id").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
