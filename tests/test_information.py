import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from limpid.operators import information, ranking


def psi(n):
    return -0.5772156649015329 + math.fsum(1 / i for i in range(1, n))


def plain(rows, k=3):
    """Every row against every other row."""
    rows = [(c, float(x)) for c, x in rows if x is not None and math.isfinite(x)]
    sizes = Counter(c for c, _ in rows)
    rows = [(c, x) for c, x in rows if sizes[c] > 1]
    if not rows:
        return 0, 0.0
    total = 0.0
    for i, (c, x) in enumerate(rows):
        near = min(k, sizes[c] - 1)
        radius = sorted(abs(y - x) for j, (d, y) in enumerate(rows) if d == c and j != i)[near - 1]
        within = sum(x - radius < y < x + radius or y == x for _, y in rows)
        total += psi(near) - psi(sizes[c]) - psi(within)
    return len(rows), max(0.0, psi(len(rows)) + total / len(rows))


def tables():
    draw = random.Random(5)
    smooth = [(draw.choice("abc"), draw.gauss(0, 1)) for _ in range(160)]
    apart = [(c, draw.gauss("abc".index(c) * 6, 1)) for c, _ in smooth]
    ties = [(draw.choice("aab"), float(draw.randint(1, 6))) for _ in range(150)]
    hot = [("big" if draw.random() < .9 else None, draw.choice([2.0, draw.uniform(0, 9)])) for _ in range(140)]
    gaps = [("a", None), ("a", float("nan")), ("a", float("inf")), ("once", 1.0), ("b", 2.0), ("b", 2.0), (None, 5.0), (None, 7.0), ("a", 3.0), ("a", -0.0), ("a", 0.0)]
    return {"smooth": smooth, "apart": apart, "ties": ties, "hot": hot, "gaps": gaps}


@pytest.mark.parametrize("name", list(tables()))
@pytest.mark.parametrize("block", [4, 4096])
def test_like_plain_search(spark, monkeypatch, name, block):
    monkeypatch.setattr(ranking, "BLOCK", block)
    rows = tables()[name]
    found = information.mutual_information(spark.createDataFrame(rows, "c string, x double").repartition(5), ["c"], "x").first()
    n, value = plain(rows)
    assert found["rows"] == n and found["information"] == pytest.approx(value, abs=1e-8)


def test_many_columns_at_once_and_odd_names(spark):
    draw = random.Random(9)
    rows = [(draw.choice("ab"), draw.randint(0, 3), draw.choice(["p", None]), draw.randint(0, 40)) for _ in range(120)]
    df = spark.createDataFrame(rows, "`a.b` string, place int, class string, n int")
    found = {r["column"]: r for r in information.mutual_information(df, ["a.b", "place", "class"], "n", neighbours=2).collect()}
    for i, c in enumerate(["a.b", "place", "class"]):
        n, value = plain([(r[i], r[3]) for r in rows], k=2)
        assert found[c]["rows"] == n and found[c]["information"] == pytest.approx(value, abs=1e-8)


def test_nothing_to_compare(spark):
    for rows in ([], [("a", 1.0), ("b", 2.0)], [("a", None)]):
        found = information.mutual_information(spark.createDataFrame(rows, "c string, x double"), ["c"], "x").collect()
        assert [tuple(r) for r in found] == [("c", 0, 0.0)]
    with pytest.raises(ValueError):
        information.mutual_information(spark.createDataFrame([], "c string, x double"), ["c"], "x", neighbours=0)


def test_digamma(spark):
    found = spark.range(1, 40).select("id", information.digamma(F.col("id")).alias("v")).collect()
    assert all(abs(r["v"] - psi(r["id"])) < 1e-9 for r in found)


def test_running_sums(spark, monkeypatch):
    monkeypatch.setattr(ranking, "BLOCK", 3)
    rows = [(i * 7 % 50, i % 4) for i in range(50)]
    found = ranking.running_sums(spark.createDataFrame(rows, "k int, v int").repartition(4), [F.col("k")], "v").collect()
    assert len(found) == 50 and all(r["sum"] == sum(v for k, v in rows if k <= r["k"]) for r in found)
