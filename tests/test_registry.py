"""Every registered query against its SQL at the smallest scale."""

import datetime
import decimal
import math
import os

import pytest

import __spark_entry__ as registry
import catalog

FOLDER = "/root/testdata/sf0.001"
SLOW = {"role_classifier", "domain_classifier", "chart_recommender", "full_run"}


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.execute(f"create view {f[:-8]} as select * from '{FOLDER}/{f}'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, (int, float, decimal.Decimal)):
        return None if math.isnan(v) else round(float(v), 6) + 0.0
    return str(v)[:19] if isinstance(v, (datetime.date, datetime.datetime)) else v


def test_names():
    queries, oracles = registry.queries(), registry.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 90
    assert not [q for q in catalog.QUERIES if "pipeline" in q or q.startswith("op")]
    assert set(catalog.QUERIES) <= set(queries)


def test_entry(spark):
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables")
    assert registry.entry(spark).columns == ["x", "value"]


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_sql(spark, duck, name):
    df = registry.queries()[name](spark, FOLDER)
    cursor = duck.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    order = sorted(columns)
    mine = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=repr)
    theirs = sorted((tuple(plain(r[columns.index(c)]) for c in order) for r in cursor.fetchall()), key=repr)
    assert mine == theirs


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES) - SLOW))
def test_query_runs(spark, name):
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables")
    assert registry.queries()[name](spark, FOLDER).count() > 0
