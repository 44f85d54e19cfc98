"""Every registered query against its SQL in DuckDB; those without SQL run, and give the rows they should."""

import os

import duckdb
import pytest

from panelight.plans.registry import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{sf}/{f}')")
    return con


def shown(rows):
    cell = lambda v: "null" if v is None or v != v else f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(map(cell, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_is_its_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    names = sorted(df.columns)
    answer = duck.execute(ORACLES[name])
    theirs = [c[0] for c in answer.description]
    assert sorted(theirs) == names
    want = [[r[theirs.index(c)] for c in names] for r in answer.fetchall()]
    got = df.select(*names).collect()
    assert shown(got) == shown(want)
    assert got or name in ("audit_issues",)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_has_rows(spark, sf, name):
    assert not QUERIES[name](spark, sf).isEmpty()
