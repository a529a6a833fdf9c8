import random

from pyspark.sql import functions as F

from limpid.operators import ranking
from limpid.operators.cells import free_names


def test_row_numbers_of_a_hot_value(spark, monkeypatch):
    monkeypatch.setattr(ranking, "RANGE_ROWS", 100)
    r = random.Random(4)
    values = [5 if r.random() < 0.4 else r.choice([None, *range(50)]) for _ in range(3000)]
    table = spark.createDataFrame([(v, i, "x") for i, v in enumerate(values)], "v int, _tie int, _part string").repartition(4)
    got = ranking.with_row_number(table, [F.desc_nulls_last("v")], "n")
    assert got.columns == ["v", "_tie", "_part", "n"]
    rows = sorted((x["n"], x["v"]) for x in got.collect())
    assert [n for n, _ in rows] == list(range(3000))
    assert [v for _, v in rows] == sorted(values, key=lambda v: (v is None, -(v or 0)))
    assert sorted(x["_tie"] for x in got.collect()) == list(range(3000))
    assert ranking.with_row_number(table.limit(0), [F.col("v")]).collect() == []


def test_sums_before_within_groups(spark, monkeypatch):
    monkeypatch.setattr(ranking, "BLOCK", 4)
    rows = [(g, p, (p * 7) % 5) for g in ("a", "b", None) for p in range(30) if (p + len(g or "")) % 3]
    got = ranking.sums_before(spark.createDataFrame(rows, "g string, p long, n long"), "p", "n", ["g"]).collect()
    for r in got:
        assert r["before"] == sum(n for g, p, n in rows if g == r["g"] and p < r["p"])
    assert len(got) == len(rows)


def test_free_names():
    assert free_names(["_A", "__a", "b"], "a", "a", "c") == ["___a", "____a", "_c"]
