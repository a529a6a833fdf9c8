import math

import pytest

from limpid.operators.charts import run_chart
from limpid.plans.together import charts_together

CHARTS = [
    {"id": "m", "type": "line", "encoding": {"x": {"field": "d", "timeUnit": "month"}, "y": {"field": "v", "aggregate": "sum"}}},
    {"id": "n", "type": "line", "encoding": {"x": {"field": "d", "timeUnit": "month"}, "y": {"aggregate": "count"}}},
    {"id": "a", "type": "bar", "encoding": {"x": {"field": "n"}, "y": {"field": "v"}}, "limit": 4},
    {"id": "b", "type": "bar", "encoding": {"x": {"field": "k"}, "y": {"aggregate": "count"}}},
    {"id": "c", "type": "pie", "encoding": {"category": {"field": "n"}, "value": {"field": "money", "aggregate": "sum"}}, "limit": 3},
    {"id": "f", "type": "pie", "encoding": {"category": {"field": "f"}, "value": {"aggregate": "count"}}, "limit": 4},
    {"id": "h", "type": "histogram", "encoding": {"x": {"field": "v"}}, "bins": 7},
    {"id": "e", "type": "histogram", "encoding": {"x": {"field": "empty"}}},
    {"id": "x", "type": "heatmap", "encoding": {"x": {"field": "d", "timeUnit": "month"}, "y": {"field": "k"}, "value": {"field": "v", "aggregate": "mean"}}},
    {"id": "y", "type": "heatmap", "encoding": {"x": {"field": "n"}, "y": {"field": "k"}, "value": {"field": "v"}}},
    {"id": "z", "type": "bar", "encoding": {"x": {"field": "__column__"}, "y": {"field": "__null_pct__"}}, "limit": 3},
    {"id": "g", "type": "heatmap", "encoding": {"x": {"field": "f"}, "y": {"field": "k"}}, "grid": 50},
    {"id": "w", "type": "bar", "encoding": {"x": {"field": "absent"}, "y": {"aggregate": "count"}}},
    {"id": "i", "type": "bar", "data_inline": [{"col": "a", "nulos": 1}]},
]


@pytest.fixture(scope="module")
def table(spark):
    rows = [(f"2024-{1 + i % 5 * 2:02d}-0{1 + i % 9}" if i % 7 else None, None if i % 6 == 0 else i * 0.25, f"k{i % 3}" if i % 5 else None,
             (i * 13) % 11, float(i % 4) if i % 9 else None, f"$ {i}.000,5", None) for i in range(200)]
    return spark.createDataFrame(rows, "d string, v double, k string, n long, f double, money string, empty double").selectExpr(
        "cast(d as date) as d", "v", "k", "n", "f", "money", "empty")


def found(df):
    def plain(v):
        return round(v, 6) if isinstance(v, float) and not math.isnan(v) else v
    return sorted((tuple(plain(v) for v in r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("chart", CHARTS, ids=lambda c: c["id"])
def test_each_chart_is_as_by_itself(table, chart):
    assert found(charts_together(table, [chart])) == found(run_chart(table, chart))


def test_all_charts_from_one_scan(table, tmp_path, spark):
    table.write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    got = charts_together(stored, CHARTS[:11])
    assert found(got) == sorted((r for c in CHARTS[:11] for r in found(run_chart(table, c))), key=repr)
    assert str(tmp_path) not in got._jdf.queryExecution().executedPlan().toString()
    assert [c["chart_id"] for c in charts_together(stored.limit(0), CHARTS[:10]).collect()] == []
