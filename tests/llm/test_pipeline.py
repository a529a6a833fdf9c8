import os

import pytest

import corpus_pipeline
from limpid.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_queries_match_sql(spark):
    import duckdb
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.execute(f"create view {f[:-8]} as select * from '{FOLDER}/{f}'")
    for name, sql in ORACLES.items():
        df = QUERIES[name](spark, FOLDER)
        cursor = con.execute(sql)
        columns = sorted(c[0] for c in cursor.description)
        at = [[c[0] for c in cursor.description].index(c) for c in columns]
        assert sorted(df.columns) == columns
        assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in cursor.fetchall()), key=repr), name


def test_pipeline_on_odd_documents(spark, odd, none):
    """Every stage against a plain statement of what it keeps."""
    from test_near_dup import brute_force
    from test_words import lower
    steps = dict(corpus_pipeline.STAGES)
    first = steps["language ID"](spark, odd, "")
    assert first.columns == odd.columns
    assert all(any(c.isalpha() for c in r["text"]) for r in first.collect())
    second = steps["exact dedup"](spark, odd, "")
    left = [r for r in second.collect() if r["doc_id"] is not None]
    assert {lower(r["text"]) for r in left} == {lower(r["text"]) for r in odd.collect()}
    third = steps["n-gram Jaccard join"](spark, odd, "")
    keyed = {r["doc_id"]: r["text"] for r in odd.collect() if r["doc_id"] is not None}
    assert {r["doc_id"] for r in third.collect() if r["doc_id"] is not None} == {c for _, c in brute_force(list(keyed.items())).values()}
    docs = none
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert docs.collect() == []


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_pipeline_runs(spark):
    from pyspark.sql import functions as F
    out = corpus_pipeline.run(spark, FOLDER)
    kept = {r["doc_id"] for r in out.select("doc_id").distinct().collect()}
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    groups = docs.groupBy(F.lower("text")).count().count()
    assert 0.7 * groups < len(kept) <= groups
    assert out.groupBy("bin_id").agg(F.sum("n_tokens").alias("n")).filter("n > 1024").count() == 0
