"""Every registered query of the engine against DuckDB, on the smallest tables."""

import datetime
import decimal
import glob
import os

import duckdb
import pytest

from orrery.plans import catalogue

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float | decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, name):
    got = QUERIES[name](spark, FOLDER)
    names = sorted(got.columns)
    expected = duck.execute(SQL[name])
    theirs = [d[0] for d in expected.description]
    assert sorted(theirs) == names
    order = [theirs.index(n) for n in names]
    assert sorted(([plain(r[n]) for n in names] for r in got.collect()), key=repr) == sorted(([plain(r[i]) for i in order] for r in expected.fetchall()), key=repr)
