"""Roles, semantics, specs and the full run on small tables."""

import math
import re
from collections import Counter

import pytest

from limpid import vocab
from limpid.ml import features
from limpid.operators.guard import validate_dashboard
from limpid.plans import objectives, roles, semantics, spec
from limpid.plans.dashboard import dashboard_data, used_columns
from limpid.plans.run import run

DAYS = [f"2024-{m:02d}-{d:02d}" for m in (1, 2, 3) for d in range(1, 11)]


@pytest.fixture(scope="module")
def sales(spark):
    rows = [(d, f"T-{i:04d}", f"cli_{i % 4}", ("Ropa", "Hogar", "Belleza")[i % 3], f"${1 + i % 9}.{i % 3:03d},50", 1 + i % 2, ("sí", "no")[i % 2], "CLP")
            for i, d in enumerate(DAYS * 2)]
    return spark.createDataFrame(rows, "fecha string, id_transaccion string, cliente string, categoria string, monto string, cantidad long, "
                                       "activo string, moneda string").coalesce(1)


def test_infer_types(spark, sales):
    assert roles.infer_types(sales) == {"fecha": "fecha", "id_transaccion": "texto", "cliente": "texto", "categoria": "texto", "monto": "moneda",
                                        "cantidad": "numérico", "activo": "bool", "moneda": "texto"}
    odd = spark.createDataFrame([(None, 1, 1.0, "1.5"), (None, 0, 0.0, "1.234,5")], "a string, b int, c double, d string")
    assert roles.infer_types(odd) == {"a": "texto", "b": "bool", "c": "numérico", "d": "numérico"}


def test_profile_roles(sales):
    found = roles.profile_roles(sales, roles.infer_types(sales))
    assert found == {"fecha": "fecha", "id_transaccion": "id", "cliente": "texto", "categoria": "categoría", "monto": "monto", "cantidad": "numérico",
                     "activo": "bool", "moneda": "moneda"}
    assert roles.profile_roles(sales)["cantidad"] == "numérico"


def brute_similarity(name):
    """TF-IDF cosine the long way: one corpus per name."""
    def grams(text):
        words = re.findall(r"\b\w\w+\b", text.lower())
        return Counter(words + [f"{a} {b}" for a, b in zip(words, words[1:])])
    docs = [grams(name)] + [grams(" ".join(t)) for t in vocab.ROLE_TERMS.values()]
    df = Counter(g for d in docs for g in d)
    vectors = [{g: n * (math.log((1 + len(docs)) / (1 + df[g])) + 1) for g, n in d.items()} for d in docs]

    def norm(v):
        return math.sqrt(sum(x * x for x in v.values()))
    head = vectors[0]
    return {role: (sum(w * v.get(g, 0) for g, w in head.items()) / norm(head) / norm(v) if head else 0.0)
            for role, v in zip(vocab.ROLE_TERMS, vectors[1:])}


def test_name_similarity(spark):
    names = ["fecha", "order_id", "unit-price total", "región", "zzz", "x", "fecha date day", "sí no"]
    found = {}
    for r in semantics.name_similarity(spark.createDataFrame([(n,) for n in names], "column string")).collect():
        found.setdefault(r["column"], {})[r["role"]] = r["similarity"]
    for n in names:
        assert found[n] == pytest.approx(brute_similarity(n), abs=1e-9)


def test_semantics_and_objective_spec(sales):
    table = sales.drop("moneda")
    schema = semantics.infer_semantics(table)
    assert schema.roles["fecha"] == "fecha" and schema.roles["id_transaccion"] == "id" and schema.roles["monto"] == "métrica_monetaria"
    assert (schema.primary_date, schema.primary_metric, schema.domain) == ("fecha", "monto", "sales")
    assert all(0.1 <= c <= 1 for c in schema.confidence.values())
    found = spec.objective_spec(table, schema.roles, "sales.csv")
    health = validate_dashboard(table, found, schema.roles)
    assert health["score"] >= 70 and not health["blocking"]


def test_half_a_coordinate_is_no_place(spark):
    df = spark.createDataFrame([(float(i) + 0.5, f"n{i % 3}") for i in range(30)], "lat double, grupo string")
    assert semantics.infer_semantics(df).roles["lat"] in (vocab.NUMBER_METRIC, vocab.ID)


def test_auto_spec(sales):
    found = roles.infer_types(sales)
    _, built = spec.auto_spec(sales, found, "x.csv")
    assert [c["id"] for c in built["charts"]] == ["ts_month", "nulls_by_col", "top_dim", "heatmap_month_dim"]
    assert built["schema"]["primary_date"] == "fecha" and built["schema"]["primary_metric"] == "monto"
    assert built["schema"]["dims"][:2] == ["cliente", "categoria"] and "fecha" not in built["schema"]["dims"]
    assert [k["op"] for k in built["kpis"]] == ["count_rows", "sum", "mean"]
    assert {f["field"] for f in built["filters"]} >= {"fecha", "moneda"}


def test_auto_spec_derives_an_amount(spark):
    df = spark.createDataFrame([("1,5", 2), ("2", 3)], "price string, qty long")
    table, built = spec.auto_spec(df, {})
    assert built["schema"]["primary_metric"] == "_importe_calc"
    assert [r[0] for r in table.select("_importe_calc").collect()] == [3.0, 6.0]


def test_business_spec(sales):
    _, built = spec.business_spec(sales)
    assert built["dashboards"][0]["charts"] == ["trend_revenue", "top_cat", "hist_amount"]
    assert built["schema"]["domain"] == "sales" and built["kpis"][-1]["op"] == "nunique"


def test_amount_discovery(spark):
    df = spark.createDataFrame([(str(i), "2,5") for i in range(20)], "qty string, tasa string")
    table, name, derived = objectives.discover_amount(df, {})
    assert name == "qty" and derived == {}
    named = df.withColumnRenamed("tasa", "unit_price")
    table, name, derived = objectives.discover_amount(named, {})
    assert name == "__importe_total__" and derived == {name: "qty * unit_price"} and table.agg({name: "sum"}).first()[0] == 475.0


def test_metric_aggregate_and_chart_types():
    assert [objectives.metric_aggregate(n) for n in ("unit_price", "ventas", "ratio")] == ["mean", "sum", "mean"]
    assert spec.chart_types("d", "m") == ["line_time", "bar_top"] and spec.chart_types(None, None) == ["bar_top", "hist"]


def test_used_columns(sales):
    built = spec.objective_spec(sales, {"fecha": "fecha", "monto": "métrica_monetaria", "categoria": "categórica"})
    assert used_columns(sales, built) == ["fecha", "categoria", "monto"]
    drawn = {r["chart_id"] for r in dashboard_data(sales, built).select("chart_id").distinct().collect()}
    assert drawn == {"ts", "top_dim", "share_dim"}  # a histogram reads plain numbers only, and money text has none


def test_full_run(spark, sales, tmp_path):
    doubled = sales.unionByName(sales.limit(5))
    result = run(doubled, {"impute": {"default": {"numeric": "mean"}}}, "ventas.csv")
    assert result.cleaned.count() == 60 and result.clean_summary["dropped_duplicates"] == 5
    assert set(vocab.OUTLIER_COLUMNS) <= set(result.cleaned.columns)
    assert result.profile.count() == 8 and not result.health["blocking"]
    assert {r["chart_id"] for r in result.charts.select("chart_id").distinct().collect()} == {c["id"] for c in result.spec["charts"]}
    assert result.quality.first()["rows"] == 60
    result.write(str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out" / "cleaned")).count() == 60


def test_strict_run_falls_back(spark):
    df = spark.createDataFrame([(f"k{i}", 5.0) for i in range(40)], "clave string, monto double")
    result = run(df, source_name="x", strict=True)
    assert result.health["blocking"] and [c["id"] for c in result.spec["charts"]] == ["safe_count", "safe_nulls"]


def test_features(spark):
    df = spark.createDataFrame([("a", 1), ("b", 0), (None, 1)], "total_pct string, order_id long")
    rows = {r["column"]: r for r in features.column_features(df, "d").collect()}
    assert (rows["total_pct"]["has_pct"], rows["total_pct"]["has_amt"], rows["order_id"]["has_id"]) == (1, 1, 1)
    assert rows["order_id"]["is_num_ratio"] == rows["order_id"]["bool_ratio"] == 1.0 and rows["total_pct"]["nunique_ratio"] == 1.0
