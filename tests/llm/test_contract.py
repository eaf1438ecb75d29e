"""Every query runs, and equals its SQL where it has one, on the smallest data."""

import duckdb
import pytest

import __spark_entry__ as entry
from panelcast.llm import queries

from .conftest import SF

TABLES = ("documents", "pages", "benchmark", "labels", "embeddings", "conversations")


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_runs_and_equals_its_sql(spark, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)
    assert got
    if name not in queries.SQL:
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    con.execute(f"CREATE VIEW o0 AS {entry.oracle_sql()[name]}")
    res = con.execute("SELECT * FROM o0")
    names = [x[0] for x in res.description]
    assert sorted(names) == cols
    order = [names.index(c) for c in cols]
    assert got == sorted((tuple(r[k] for k in order) for r in res.fetchall()), key=str)


def test_every_operator_is_registered_once():
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES} == set(range(1, 14))
    assert set(queries.SQL) <= set(queries.QUERIES) and "pipeline" in entry.queries()
