"""Each query with SQL against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
NAMES = [q for q in entry.queries() if not q.startswith("op") and q != "pipeline"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    return c


def norm(v):
    return round(v, 9) if isinstance(v, float) and math.isfinite(v) else v


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    df = entry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    rows = sorted(repr(tuple(norm(r[c]) for c in columns)) for r in df.collect())
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    want = con.sql(sql)
    at = [want.columns.index(c) for c in columns]
    assert rows == sorted(repr(tuple(norm(r[i]) for i in at)) for r in want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
