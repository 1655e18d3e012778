"""Each query with SQL against DuckDB on the smallest tables, and what must hold between queries."""

import glob
import os

import duckdb
import pytest

import __spark_entry__

D = "/root/testdata/sf0.001"
SQL = __spark_entry__.oracle_sql()


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{D}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(k for k in SQL if not k.startswith("op")))
def test_same_as_sql(spark, duck, name):
    df = __spark_entry__.queries()[name](spark, D)
    cols = sorted(df.columns)
    mine = sorted((plain(list(r)) for r in df.select(*[f"`{c}`" for c in cols]).collect()), key=str)
    rel = duck.sql(SQL[name])
    at = [rel.columns.index(c) for c in cols]
    theirs = sorted((plain([r[i] for i in at]) for r in rel.fetchall()), key=str)
    assert mine == theirs


def test_every_query_of_both_kinds_is_registered():
    q = __spark_entry__.queries()
    assert set(SQL) <= set(q) and len(q) > 100


def test_and_is_within_or(spark):
    q = __spark_entry__.queries()
    assert q["search_exclusive_and"](spark, D).join(q["search_and"](spark, D), "url", "left_anti").count() == 0


def test_closure_is_closed(spark):
    c = __spark_entry__.queries()["closure"](spark, D)
    step = c.selectExpr("src", "dst AS m").join(c.selectExpr("src AS m", "dst"), "m").where("src <> dst").select("src", "dst")
    assert step.join(c, ["src", "dst"], "left_anti").count() == 0
