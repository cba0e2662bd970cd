"""Every query that SQL can say, against DuckDB on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_points

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, float):
        return f"{v:.9g}"
    if hasattr(v, "isoformat"):
        return v.isoformat().removesuffix("T00:00:00")
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return str(v)


def ordered(rows, names):
    at = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple(plain(r[i]) for i in at) for r in rows)


@pytest.mark.parametrize("name", sorted(entry_points.oracle_sql()))
def test_same_as_sql(spark, db, name):
    df = entry_points.queries()[name](spark, DATA)
    got = db.execute(entry_points.oracle_sql()[name])
    names = [c[0] for c in got.description]
    assert sorted(df.columns) == sorted(names)
    assert ordered(df.collect(), df.columns) == ordered(got.fetchall(), names)


@pytest.mark.parametrize("name", sorted(set(entry_points.queries()) - set(entry_points.oracle_sql())))
def test_runs_without_sql(spark, name):
    """Results that SQL can't give are there, the same on a second run, and have a value in their first column."""
    query = entry_points.queries()[name]
    first = query(spark, DATA)
    rows = ordered(first.collect(), first.columns)
    assert rows and all(r[sorted(first.columns).index(first.columns[0])] != "null" for r in rows)
    assert rows == ordered(query(spark, DATA).collect(), first.columns)


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
