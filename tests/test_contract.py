"""Driver contract: entry() runs; every SQL-checked query equals its DuckDB
oracle (rows, column names, values bit for bit) on the smallest test data."""

import datetime as dt
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from panelcast.plans import catalog, oracle
from panelcast.sources.testdata import TABLES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else repr(v)
    if isinstance(v, (dt.date, dt.datetime)):
        return v.isoformat()
    return None if v is None else repr(v)


def _canon(cols, records):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in records]
    return sorted(out, key=lambda t: tuple("" if x is None else x for x in t))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "close_ma12" in df.columns


def test_every_sql_key_is_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_query_matches_oracle(spark, con, name):
    df = entry.queries()[name](spark, SF)
    got = _canon(df.columns, [tuple(r) for r in df.collect()])
    con.execute(f"CREATE OR REPLACE VIEW o0 AS {entry.oracle_sql()[name]}")
    res = con.execute("SELECT * FROM o0")
    cols = [d[0] for d in res.description]
    want = _canon(cols, res.fetchall())
    assert sorted(df.columns) == sorted(cols)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(oracle.SQL)))
def test_rows_only_queries_run(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0
