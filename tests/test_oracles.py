"""Each query of the engine against its SQL over the same tables."""

import os
from collections import Counter
from decimal import Decimal

import duckdb
import pytest

from lantern import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return c


def plain(v):
    if isinstance(v, (float, Decimal)):
        return float(f"{float(v):.9g}")
    return tuple(plain(x) for x in v) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    result = duck.execute(catalog.ORACLE_SQL[name])
    columns = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(columns)
    theirs = Counter(tuple(plain(v) for v in row) for row in result.fetchall())
    ours = Counter(tuple(plain(row[c]) for c in columns) for row in df.collect())
    assert ours == theirs


def test_pinned_targets_with_nulls_match_sql(spark, tmp_path):
    # Each order has at most one part without a rank, so the SQL leaves no order open.
    rows = """(1, 151, 7, 'R'), (1, null, 3, 'R'), (1, 66, 3, 'N'), (1, 559, 5, null), (2, -60, null, 'R'), (2, 636, 2, 'R'), (2, 589, 1, null),
        (3, null, 1, 'N'), (3, 7, 5, 'A'), (4, 402, null, 'R'), (4, 7, 5, 'N'), (4, 7, null, 'R'), (5, null, 2, 'R'), (null, 9, 1, 'N'), (null, 8, 2, 'R'), (null, null, 3, 'R')"""
    c = duckdb.connect()
    c.execute(f"copy (select * from (values {rows}) t(l_orderkey, l_partkey, l_linenumber, l_returnflag)) to '{tmp_path}/lineitem.parquet' (format parquet)")
    c.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet'")
    theirs = c.execute(catalog.ORACLE_SQL["pinned_targets"]).fetchall()
    ours = catalog.QUERIES["pinned_targets"](spark, str(tmp_path)).select("query_id", "doc_id", "position").collect()
    assert Counter(tuple(x) for x in ours) == Counter(theirs)
