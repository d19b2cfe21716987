"""Dated closures, interval joins and exact order statistics against plain loops."""

import datetime
import random

import pytest

from lantern.operators import dated, evaluation, order_stats
from lantern.operators.temporal import effective_on

D = datetime.date


def versions(spark, rows):
    return spark.createDataFrame(rows, "provision string, version string, document string, article string, paragraph string, status string, start date, end date")


VERSIONS = [
    ("a", "a1", "pit", "21", "25", "active", D(2020, 1, 1), D(2022, 12, 31)), ("a", "a2", "pit", "21", "25", "active", D(2023, 1, 1), None),
    ("b", "b1", "pit", "21", "25a", "active", D(2021, 1, 1), None), ("c", "c1", "pit", "21", "25b", "active", D(2024, 1, 1), None),
    ("d", "d1", "pit", "22", "1", "active", D(2020, 1, 1), None), ("d", "d2", "pit", "22", "1", "active", D(2022, 1, 1), None),
    ("e", "e1", "vat", "5", None, "active", D(2020, 1, 1), None), ("f", "f1", "vat", "6", "x", "repealed", D(2020, 1, 1), None), ("g", "g1", "vat", "7", "25z", "active", D(2019, 1, 1), None),
    ("h", "h1", "vat", "7", "26", "active", D(2019, 1, 1), None), ("i", "i1", "vat", "7", "27", "active", None, None),
]
LINKS = [("a", "a1", "e", "related"), ("a", "a2", "d", "exception"), ("e", None, "a", "general_rule"), ("e", None, "g", "special_rule"), ("e", None, "f", "related"), ("d", None, "h", "related"), ("h", None, "i", "related"), ("e", None, "c", "cites")]


def closure(spark, seeds, **kw):
    rows = dated.applicable(spark.createDataFrame(seeds, "seed string, target date"), versions(spark, VERSIONS), spark.createDataFrame(LINKS, "source string, source_version string, target string, type string"), **kw)
    return {(r["seed"], str(r["target"]), r["provision"]): (r["version"], r["depth"], r["conflict"]) for r in rows.collect()}


def test_the_version_of_the_date_is_followed(spark):
    found = closure(spark, [("a", D(2021, 6, 1)), ("a", D(2024, 6, 1)), ("a", D(2000, 1, 1)), ("zz", D(2021, 6, 1))])
    assert {k[2]: v for k, v in found.items() if k[:2] == ("a", "2021-06-01")} == {"a": ("a1", 0, False), "b": ("b1", 1, False), "e": ("e1", 1, False), "g": ("g1", 2, False), "h": ("h1", 3, False)}
    assert {k[2]: v for k, v in found.items() if k[:2] == ("a", "2024-06-01")} == {"a": ("a2", 0, False), "b": ("b1", 1, False), "d": (None, 1, True), "c": ("c1", 2, False)}
    assert not [k for k in found if k[0] == "zz" or k[1] == "2000-01-01"]


def test_types_and_neighbours(spark):
    assert {k[2] for k in closure(spark, [("a", D(2021, 6, 1))], neighbours=False)} == {"a", "e", "g"}
    assert {k[2] for k in closure(spark, [("a", D(2021, 6, 1))], types=["related"])} == {"a", "b", "e"}
    assert {k[2] for k in closure(spark, [("g", D(2021, 6, 1))], types=["exception"])} == {"g", "h"}
    assert closure(spark, []) == {}


def test_long_cycles_end(spark):
    n = 20
    rows = [(f"n{i}", "1", "d", "1", None, "active", D(2020, 1, 1), None) for i in range(n)]
    links = [(f"n{i}", None, f"n{(i + 1) % n}", "related") for i in range(n)]
    found = dated.applicable(spark.createDataFrame([("n3", D(2021, 1, 1))], "seed string, target date"), versions(spark, rows), spark.createDataFrame(links, "source string, source_version string, target string, type string"))
    assert sorted((r["provision"], r["depth"]) for r in found.collect()) == sorted((f"n{(3 + k) % n}", k) for k in range(n))


def test_registry(spark):
    counts = dated.registry_counts(versions(spark, [*VERSIONS, ("j", " ", "x", "1", None, "active", D(2020, 1, 1), None)])).collect()
    assert [tuple(r) for r in counts] == [(12, 1, 1)]
    assert [tuple(r) for r in dated.overlapping(versions(spark, VERSIONS)).collect()] == [("d", "d1", "d2")]


def day(r):
    return D(2020, 1, 1) + datetime.timedelta(days=r.randint(0, 900))


def test_valid_on_by_force(spark):
    r = random.Random(8)
    units = [(i, r.choice("xyz"), day(r) if r.random() < 0.7 else None, day(r) if r.random() < 0.7 else None, day(r) if r.random() < 0.5 else None) for i in range(150)]
    dates = [(k, r.choice(["x", "y", None]), day(r) if r.random() < 0.9 else None) for k in range(60)]
    left = spark.createDataFrame(units, "id int, act string, start date, end date, state date")
    right = spark.createDataFrame(dates, "day_id int, act string, target date")

    def holds(u, t):
        _, _, start, end, state = u
        if t is None:
            return False
        if start or end:
            return (not start or start <= t) and (not end or t <= end)
        return state is None or state <= t

    truth = {(u[0], d[0]) for u in units for d in dates if holds(u, d[2])}
    keyed = {(a, b) for a, b in truth if units[a][1] == dates[b][1]}
    found = dated.valid_on(left, right.drop("act"), legal_state="state")
    assert {(x["id"], x["day_id"]) for x in found.collect()} == truth
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    assert {(x["id"], x["day_id"]) for x in dated.valid_on(left, right, ["act"], legal_state="state").collect()} == keyed
    # A clashing column of the dates gives way to that of the units.
    assert {(x["id"], x["day_id"]) for x in dated.valid_on(left, right.withColumn("state", right["target"]), ["act"], legal_state="state").collect()} == keyed
    assert dated.valid_on(left, right.limit(0)).count() == 0 and dated.valid_on(left.limit(0), right.drop("act")).count() == 0
    assert effective_on is not None


def test_ends_by_rules(spark):
    rows = spark.createDataFrame([("a", D(2030, 1, 1)), ("b", None), ("c", D(2021, 1, 1))], "act string, end date")
    ends = spark.createDataFrame([("a", D(2024, 12, 31)), ("b", D(2023, 12, 31)), ("b", D(2022, 12, 31))], "act string, end date")
    assert sorted(map(tuple, dated.with_ends(rows, ends, "act").collect())) == [("a", D(2024, 12, 31)), ("b", D(2022, 12, 31)), ("c", D(2021, 1, 1))]


@pytest.mark.parametrize("seed", range(3))
def test_nearest_ranks_by_force(spark, seed):
    r = random.Random(seed)
    rows = [(r.choice(["a", "b", None]) if r.random() < 0.4 else "hot", r.choice([None, 0, 1, 1, 2, r.randint(0, 400)])) for _ in range(700)] + [("none", None), ("one", 5)]
    df = spark.createDataFrame(rows, "variant string, latency int")
    shares = [0.0, 0.25, 0.5, 0.95, 1.0]
    groups = {}
    for g, v in rows:
        if v is not None:
            groups.setdefault(g, []).append(v)
    truth = {(g, s): sorted(v)[round((len(v) - 1) * s)] for g, v in groups.items() for s in shares}
    found = order_stats.nearest_ranks(df, "variant", "latency", shares)
    assert {(x["variant"], x["share"]): x["latency"] for x in found.collect()} == truth
    ranked = order_stats.ranked_values(df, "variant", "latency")
    assert {(x["variant"], x["latency"]): (x["n"], x["upto"]) for x in ranked.collect()} == {(g, x): (v.count(x), sum(y <= x for y in v)) for g, v in groups.items() for x in v}
    assert {(x["variant"], x["bound"]): x["n_to"] for x in order_stats.histogram(df, "variant", "latency", [1, 50.5]).collect()} == {(g, float(b)): sum(y <= b for y in v) for g, v in groups.items() for b in (1, 50.5)}


def test_by_variant_collects_no_group(spark):
    df = spark.createDataFrame([("a", 1.0, 5), ("a", None, 7), ("a", 3.0, None), ("b", None, None)], "variant string, score double, ms int")
    out = evaluation.by_variant(df, ["score"], "ms")
    assert {r["variant"]: (r["mean_score"], r["p50"], r["p95"]) for r in out.collect()} == {"a": (2.0, 5, 7), "b": (None, None, None)}
    assert "collect_list" not in out._jdf.queryExecution().executedPlan().toString()
