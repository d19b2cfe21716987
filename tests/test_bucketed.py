"""Bucketed tables: what an upsert writes, and what it leaves alone."""

import os
import random

import pytest
from pyspark.sql import functions as F

from lantern.sources import bucketed
from lantern.streaming import ingest

COLUMNS = "k long, day int, v string"


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(f"{path}/data") for f in names if f.endswith(".parquet")}


def rows_of(spark, path, version=None):
    return sorted(map(tuple, bucketed.read(spark, path, version).collect()))


def test_only_touched_buckets_are_written(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(k, 1, f"v{k}") for k in range(400)], COLUMNS)
    first = bucketed.upsert(df, path, ["k"], buckets=16)
    assert first["touched"] == list(range(16)) and first["rows_after"] == 400
    before = files(path)
    done = bucketed.upsert(spark.createDataFrame([(7, 2, "new"), (1000, 1, "more")], COLUMNS), path, ["k"])
    fresh = files(path) - before
    assert before <= files(path) and len(done["touched"]) <= 2 and {f.split("bucket=")[1].split("/")[0] for f in fresh} == {str(b) for b in done["touched"]}
    assert rows_of(spark, path) == sorted([(k, 1, f"v{k}") for k in range(400) if k != 7] + [(7, 2, "new"), (1000, 1, "more")])
    assert rows_of(spark, path, 1) == sorted((k, 1, f"v{k}") for k in range(400))
    # The same batch again changes nothing and writes nothing.
    now = files(path)
    assert bucketed.upsert(spark.createDataFrame([(7, 2, "new"), (1000, 1, "more")], COLUMNS), path, ["k"])["touched"] == [] and files(path) == now
    assert bucketed.upsert(df.limit(0), path, ["k"])["touched"] == []
    found = bucketed.lookup(spark, path, spark.createDataFrame([(7, 0), (5000, 0)], "k long, other int"), ["k"])
    assert [tuple(r) for r in found.collect()] == [(7, 2, "new")] and len(found.inputFiles()) < len(bucketed.read(spark, path).inputFiles())


@pytest.mark.parametrize("seed", range(2))
def test_batches_in_any_order(spark, tmp_path, seed):
    r = random.Random(seed)
    rows = [(r.choice([None, *range(30)]), r.randint(0, 9), r.choice("abc")) for _ in range(300)]
    truth = {}
    path, batches = str(tmp_path / "t"), [rows[:100], rows[100:200], rows[50:150], rows[200:]]
    for batch in batches:
        bucketed.upsert(spark.createDataFrame(batch, COLUMNS), path, ["k"], ["day", "v"], buckets=4)
        for k, day, v in batch:
            truth[k] = max(truth.get(k, (day, v)), (day, v))
    assert sorted(map(str, rows_of(spark, path) if None not in truth else [tuple(x) for x in bucketed.read(spark, path).collect()])) == sorted(str((k, *x)) for k, x in truth.items())


def test_deletes_and_missing(spark, tmp_path):
    path = str(tmp_path / "t")
    assert bucketed.read(spark, path) is None
    bucketed.add_missing(spark.createDataFrame([(1, 1, "a"), (2, 1, "b"), (2, 1, "b")], COLUMNS), path, ["k"], buckets=4)
    bucketed.add_missing(spark.createDataFrame([(2, 9, "z"), (3, 1, "c")], COLUMNS), path, ["k"])
    assert rows_of(spark, path) == [(1, 1, "a"), (2, 1, "b"), (3, 1, "c")]
    bucketed.upsert(spark.createDataFrame([(1, 2, "x"), (3, 2, "y")], COLUMNS), path, ["k"], deleted=F.col("k") == 1)
    assert rows_of(spark, path) == [(2, 1, "b"), (3, 2, "y")]
    bucketed.upsert(spark.createDataFrame([(2, 0, ""), (3, 0, "")], COLUMNS), path, ["k"], deleted=F.lit(True))
    assert rows_of(spark, path) == []
    with pytest.raises(ValueError):
        bucketed.lookup(spark, str(tmp_path / "none"), spark.createDataFrame([(1,)], "k long"), ["k"])


def test_stream_into_buckets(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([(1, 1, "a"), (2, 5, "b")], COLUMNS).write.parquet(source)

    def run():
        stream = spark.readStream.schema(COLUMNS).parquet(source)
        ingest.upsert_buckets(stream, str(tmp_path / "t"), ["k"], ["day"], str(tmp_path / "c")).awaitTermination()

    run()
    spark.createDataFrame([(1, 3, "later"), (2, 1, "late")], COLUMNS).write.mode("append").parquet(source)
    run()
    assert rows_of(spark, str(tmp_path / "t")) == [(1, 3, "later"), (2, 5, "b")]
