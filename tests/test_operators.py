"""Table operators on small fixtures, against brute force where the answer is not obvious."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from limpid.operators import charts, clean, columns, filters, frequency, guard, kpi, outliers, profile, quantiles, steps
from limpid.operators.dedup import distinct_rows, keep_first
from limpid.operators.sampling import sample_values

SALES = [("2024-01-05", "Acme", "$1.000,50", "CLP", True), ("2024-01-20", "Beta", "$2.000", "CLP", False),
         ("2024-03-01", None, "$500", "CLP", True), ("x", "Acme", "n/d", "CLP", None)]


@pytest.fixture(scope="module")
def sales(spark):
    return spark.createDataFrame(SALES, "fecha string, cliente string, monto string, moneda string, ok boolean")


def points(df):
    return [(r["x"], r["value"]) for r in df.collect()]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# ---- quantiles --------------------------------------------------------------------------------

@pytest.mark.parametrize("shape", ["spread", "hot", "two", "constant", "empty"])
def test_quantiles_narrowing_is_exact(spark, shape):
    dice = random.Random(7)
    values = {
        "spread": [dice.gauss(0, 10) for _ in range(3000)],
        "hot": [5.0] * 1500 + [dice.random() * 10 for _ in range(1500)],
        "two": [1.0] * 500 + [2.0] * 500,
        "constant": [3.0] * 1000,
        "empty": [],
    }[shape]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    probs = [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0]
    small = quantiles.exact_quantiles(df, {"v": F.col("v")}, probs)["v"]
    narrowed = quantiles.exact_quantiles(df, {"v": F.col("v")}, probs, cell_limit=20, accuracy=50)["v"]
    if not values:
        assert small == narrowed == [None] * len(probs)
        return
    ordered = sorted(values)
    for p, a, b in zip(probs, small, narrowed):
        at = p * (len(ordered) - 1)
        low, high = ordered[math.floor(at)], ordered[math.ceil(at)]
        truth = low + (high - low) * (at - math.floor(at))
        assert a == pytest.approx(truth, abs=1e-9)
        assert b == pytest.approx(truth, abs=1e-9)


# ---- frequency and columns --------------------------------------------------------------------

def test_value_tables(spark):
    df = spark.createDataFrame([(1, "a", 2.0), (2, "a", None), (3, None, 1.0), (4, None, 1.0), (5, "b", 2.0)], "k int, s string, x double")
    freq = frequency.value_counts(df, ["s", "x"], "k")
    assert {(r["column"], r["uniques"]) for r in frequency.distinct_counts(freq).collect()} == {("s", 2), ("x", 2)}
    assert {(r["column"], r["duplicates"]) for r in frequency.duplicate_members(freq).collect()} == {("s", 4), ("x", 4)}
    assert frequency.modes(df, ["s", "x", "k"]) == {"s": "a", "x": 1.0, "k": 1}
    first = frequency.first_values(freq.where("value is not null"), 2).orderBy("column", "rank").collect()
    assert [r["value"] for r in first] == ["a", "b", "2.0", "1.0"]


def test_top_values_limits_before_the_shuffle(spark):
    freq = frequency.value_counts(spark.range(100).selectExpr("id % 7 as a", "id as b"))
    assert plan(frequency.top_values(freq, 3)).count("WindowGroupLimit") == 2


def test_cardinality_is_exact_where_it_matters(spark):
    df = spark.range(2000).selectExpr("id % 50 as low", "id % 51 as over", "id as key", "id % 300 as middle", "cast(null as string) as none")
    found = columns.cardinalities(df)
    assert (found["low"], found["over"], found["key"], found["none"]) == (50, 51, 2000, 0)
    assert 250 < found["middle"] < 350


def test_column_table_handles_nan_names_and_empty(spark):
    df = spark.createDataFrame([(1.0, "x"), (float("nan"), None)], "`a.b` double, `it's` string")
    assert {r["column"]: r["null_pct"] for r in columns.null_percent(df).collect()} == {"a.b": 50.0, "it's": 50.0}
    assert columns.column_dict(df.limit(0), {"n": columns.rows}) == {
        "a.b": {"ordinal": None, "column": "a.b", "n": 0}, "it's": {"ordinal": None, "column": "it's", "n": 0}}


def test_scan_reads_only_the_columns_in_use(spark, tmp_path):
    spark.range(10).selectExpr("id as a", "id as b", "id as c").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    assert "ReadSchema: struct<a:bigint>" in plan(columns.null_percent(df, ["a"]))


# ---- cleaning ---------------------------------------------------------------------------------

def test_bool_coercion(spark):
    df = spark.createDataFrame([("sí", "sí", 1, None, 1.0), ("no", "quizá", 0, None, 0.0), ("TRUE", None, 1, None, 1.0), (None, None, 0, None, 1.0)],
                               "a string, b string, c int, d string, e double")
    out = clean.coerce_bools(df)
    assert dict(out.dtypes) == {"a": "boolean", "b": "string", "c": "boolean", "d": "string", "e": "double"}
    assert [r["a"] for r in out.collect()] == [True, False, True, None]


def test_iso_dates_need_a_majority(spark):
    df = spark.createDataFrame([("2024-01-01", "2024-01-01"), ("2024-01-02", "x"), ("bad", "y")], "a string, b string")
    out = clean.coerce_iso_dates(df)
    assert dict(out.dtypes) == {"a": "date", "b": "string"}


def test_normalize_dates_ratio_counts_blanks(spark):
    df = spark.createDataFrame([("1/2/2024", "1/2/2024"), ("x", "x"), (None, " ")], "a string, b string")
    out, found = clean.normalize_dates(df)
    assert found == {"a": "date"}
    assert [r["a"] for r in out.collect()] == ["2024-02-01", None, None]


def test_tolerant_date_prefers_month_first_only_when_needed(spark):
    df = spark.createDataFrame([("01/13/2024", "02/01/2024"), ("01/14/2024", "2024-02-01"), ("02/15/2024", "13/02/2024")], "us string, eu string")
    rows = df.select(clean.tolerant_date(df, "us").cast("string").alias("us"), clean.tolerant_date(df, "eu").cast("string").alias("eu")).collect()
    assert [r["us"] for r in rows] == ["2024-01-13", "2024-01-14", "2024-02-15"]
    assert [r["eu"] for r in rows] == ["2024-01-02", "2024-02-01", "2024-02-13"]


def test_impute(spark):
    df = spark.createDataFrame([(1, 1.0, "b"), (None, None, "a"), (2, 4.0, None)], "i int, x double, s string")
    out, filled = clean.impute(df, {"impute": {"by_column": {"i": {"strategy": "mean"}, "s": {"strategy": "mode"}},
                                               "default": {"numeric": "value", "value": 9.0}}})
    assert [tuple(r) for r in out.collect()] == [(1.0, 1.0, "b"), (1.5, 9.0, "a"), (2.0, 4.0, "a")]
    assert filled == {"i": 1, "x": 1, "s": 1}
    assert clean.impute(df, {"impute": {"by_column": {"i": {"strategy": "median"}}}})[1] == {}
    assert clean.impute(df, None) == (df, {})


def test_dedup(spark):
    df = spark.createDataFrame([(3, "a", 1), (1, "a", 2), (2, None, 3), (0, None, 4)], "p int, k string, v int")
    first = keep_first(df, ["k"], "p")
    assert plan(first).count("WindowGroupLimit") == 2
    assert sorted(r["v"] for r in first.collect()) == [2, 4]
    same = spark.createDataFrame([(1, "a", None), (2, "a", None), (3, "b", None)], "_pos long, k string, v string")
    assert sorted(r["_pos"] for r in distinct_rows(same).collect()) == [1, 3]
    assert clean.dedup(df, {"dedup": {"keys": ["nope"]}}).count() == 4


def test_clean_end_to_end(spark):
    df = spark.createDataFrame([(" a ", "sí", "2024-01-01"), ("a", "sí", "2024-01-01"), ("  ", "no", "bad"), ("b", None, "2024-01-03"),
                                ("c", "no", "2024-01-04")], "t string, f string, d string")
    out, summary = clean.clean(df, {"impute": {"by_column": {"t": {"strategy": "value", "value": "?"}}}})
    assert dict(out.dtypes) == {"t": "string", "f": "boolean", "d": "date"}
    assert sorted(r["t"] for r in out.collect()) == ["?", "a", "b", "c"]
    assert summary["bool_cols"] == ["f"] and summary["date_cols"] == ["d"] and summary["imputed"] == {"t": 1}


def test_describe_rules():
    rules = {"impute": {"by_column": {"b": {}, "a": {}}}, "dedup": {"keys": ["k"]}, "format": {"dates": {"columns": ["d"]}}}
    assert clean.describe_rules(rules) == {"has_rules": True, "impute_columns": ["a", "b"], "dedup_keys": ["k"], "date_columns": ["d"]}
    assert clean.describe_rules(None) == {"has_rules": False, "impute_columns": [], "dedup_keys": [], "date_columns": []}


# ---- charts, KPIs, filters --------------------------------------------------------------------

def test_month_charts(sales):
    assert points(charts.by_month(sales, "fecha")) == [("2024-01", 2.0), ("2024-02", 0.0), ("2024-03", 1.0)]
    assert points(charts.by_month(sales, "fecha", "monto", "sum")) == [("2024-01", 3000.5), ("2024-03", 500.0)]


def test_top_and_parts(spark, sales):
    assert points(charts.top(sales, "cliente", "monto", "sum")) == [("Beta", 2000.0), ("Acme", 1000.5)]
    assert points(charts.top(sales, "cliente")) == [("Acme", 2.0), ("Beta", 1.0), (None, 1.0)]
    df = spark.createDataFrame([("a", 3.0), ("b", 2.0), ("c", 1.0)], "d string, v double")
    assert points(charts.parts(df, "d", "v", "sum", 2)) == [("a", 3.0), ("Otros", 3.0)]
    assert points(charts.parts(df, "d", "v", "sum", 3)) == [("a", 3.0), ("b", 2.0), ("c", 1.0)]
    assert points(charts.parts(df, "d", "v", "sum", 0)) == [("a", 3.0), ("b", 2.0), ("c", 1.0)]


def test_heatmap_null_rules(spark):
    df = spark.createDataFrame([("a", "p", 1.0), ("b", "p", None), ("a", None, 2.0)], "x string, y string, v double")
    assert sorted(tuple(r) for r in charts.heatmap(df, "x", "y", "v", "mean").collect()) == [("a", "p", 1.0)]
    assert sorted(tuple(r) for r in charts.heatmap(df, "x", "y", "v", "sum").collect()) == [("a", "p", 1.0), ("b", "p", 0.0)]


def test_histogram_edges(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (10.0,), (None,)], "v double")
    assert [r["n"] for r in charts.histogram(df, "v", 5).collect()] == [2, 0, 0, 0, 1]
    assert [r["n"] for r in charts.histogram(df.where("v = 1"), "v", 5).collect()] == [1]
    assert charts.histogram(df.where("v > 99"), "v", 5).count() == 0


def test_chart_without_columns_is_empty(sales):
    assert charts.run_chart(sales, {"id": "x", "type": "bar", "encoding": {"x": {"field": "nope"}}}).count() == 0
    assert charts.run_chart(sales, {"id": "x", "type": "radar"}).count() == 0
    inline = charts.run_chart(sales, {"id": "x", "data_inline": [{"col": "a", "nulos": 2}]})
    assert points(inline) == [("a", 2.0)]


def test_kpis(sales):
    rows = kpi.kpi_values(sales, [{"title": "n", "op": "count_rows"}, {"op": "sum", "col": "monto"}, {"op": "mean", "col": "cliente"},
                                  {"op": "nunique", "col": "cliente"}, {"op": "ratio_true", "col": "ok"}, {"op": "sum", "col": "nope"}]).collect()
    assert [r["text"] for r in rows] == ["4", "3.500,50", "0,00", "2", "50.00%", "—"]
    assert tuple(kpi.single_currency(sales).first()) == ("CLP", "$")


def test_filters(spark, sales):
    kept = filters.apply_filters(sales, {"fecha": ("2024-01-01", "2024-01-31"), "cliente": ["Acme"]})
    assert kept.count() == 1
    found = filters.filter_domain(sales, [{"field": "fecha", "type": "date_range"}, {"field": "cliente", "type": "categorical", "max_values": 1}])
    assert {(r["field"], r["low"], r["value"]) for r in found.collect()} == {("fecha", "2024-01-05", None), ("cliente", None, "Acme")}


def test_sample(spark):
    df = spark.range(1000).selectExpr("id as a", "cast(id % 3 as string) as b")
    counts = {r["column"]: r["count"] for r in sample_values(df, ["a", "b"], 20).groupBy("column").count().collect()}
    assert counts == {"a": 20, "b": 20}


# ---- profile ----------------------------------------------------------------------------------

def test_numeric_profile(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4)], "v double")
    row = profile.numeric_summary(df, {"v": F.col("v")}).first()
    assert (row["q1"], row["q3"], row["outliers"]) == (1.75, 3.25, 0)
    assert row["p5"] == pytest.approx(1.15) and row["std"] == pytest.approx(statistics.stdev([1, 2, 3, 4]))
    assert profile.numeric_summary(df.limit(1), {"v": F.col("v")}).first()["std"] is None


def test_profile_table(spark, sales):
    table = profile.profile(sales.withColumn("id", F.lit("7")), {"fecha": "fecha", "monto": "monto", "cliente": "texto", "moneda": "moneda", "ok": "bool",
                                                                "id": "id"})
    rows = {r["column"]: r for r in table.collect()}
    assert rows["fecha"]["details"] == "parseadas=75.00%, min=2024-01-05, max=2024-03-01"
    assert rows["monto"]["details"].startswith("min=500, p5=")
    assert rows["moneda"]["details"] == "top3=CLP(4)"
    assert rows["ok"]["details"] == "true(2) · false(1)"
    assert rows["id"]["alerts"] == ["duplicados=4"]
    assert (rows["cliente"]["uniques"], rows["cliente"]["nulls_pct"]) == (2, "25.00%")


# ---- outliers ---------------------------------------------------------------------------------

def test_isolation_forest_finds_the_planted_row(spark):
    df = spark.createDataFrame([(1000, "a"), (2000, "b"), (2100, "b"), (120000, "a")], "monto long, c string")
    flagged, summary = outliers.isolation_forest(df)
    rows = flagged.orderBy(F.desc("outlier_score")).collect()
    assert rows[0]["monto"] == 120000 and rows[0]["is_outlier"]
    assert {r["outlier_method"] for r in rows} == {"isolation_forest"} and 0 < summary["contamination"] <= 0.5


def test_isolation_forest_share_and_repeatability(spark):
    df = spark.range(3000).selectExpr("case when id = 17 then 99999 else id end as id", "case when id = 17 then 1e6 else (id * 7919) % 1000 / 10.0 end as a",
                                      "case when id = 17 then 1e6 else (id * 104729) % 997 end as b")
    once, summary = outliers.isolation_forest(df, 0.05, order_by="id", n_trees=40)
    again, _ = outliers.isolation_forest(df, 0.05, order_by="id", n_trees=40)
    first = {r["id"]: (r["is_outlier"], r["outlier_score"]) for r in once.collect()}
    assert first == {r["id"]: (r["is_outlier"], r["outlier_score"]) for r in again.collect()}
    assert sum(f for f, _ in first.values()) == pytest.approx(150, abs=15)
    assert first[99999][1] >= sorted(s for _, s in first.values())[-10]


def test_tree_samples_are_bounded_under_duplicates(spark):
    df = spark.range(5000).selectExpr("id", "case when id % 3 = 0 then 1.0 else id end as a")
    sample = outliers.sample_for_trees(df, {"a": F.col("a")}, F.lit(1), 5000, 5, 256, 42)
    assert all(r["count"] <= 256 for r in sample.groupBy("tree").count().collect())
    spread = outliers.sample_for_trees(df, {"a": F.col("a")}, F.col("id"), 5000, 5, 256, 42)
    assert [r["count"] for r in spread.groupBy("tree").count().collect()] == [256] * 5


def test_isolation_forest_skips_and_ignores_old_scores(spark):
    df = spark.createDataFrame([(1, "a", 0.5, True), (1, "b", 0.7, False)], "x int, s string, outlier_score double, is_outlier boolean")
    flagged, summary = outliers.isolation_forest(df)
    assert summary["skipped"] and [r["outlier_score"] for r in flagged.collect()] == [None, None]


def test_tukey_rows_push_down(spark, tmp_path):
    spark.range(100).selectExpr("case when id = 5 then 1000.0D else id end as v").write.parquet(str(tmp_path / "v"))
    rows = outliers.tukey_rows(spark.read.parquet(str(tmp_path / "v")), "v")
    assert [r["v"] for r in rows.collect()] == [1000.0]
    assert "PushedFilters: [Or(" in plan(rows)


# ---- checks -----------------------------------------------------------------------------------

def test_guard(spark):
    df = spark.range(200).selectExpr("cast(id as string) as key", "case when id % 2 = 0 then 'y' else 'n' end as flag", "1.0D as same",
                                     "case when id % 4 < 3 then null else 'c' end as rare", "cast(id as double) as v")

    def check(**chart):
        health = guard.validate_charts(df, [chart], {"day": "fecha"})
        return {(r["code"], r["severity"]) for r in health.collect()}, health.first()["score"]

    def enc(**fields):
        return {k: {"field": f} for k, f in fields.items()}

    assert check(id="a", type="bar", encoding=enc(x="key", y="v")) == ({("too_many_categories", "warn"), ("id_dim", "error")}, 70.0)
    assert check(id="b", type="pie", encoding=enc(category="flag", value="same")) == ({("bool_dim", "warn"), ("constant_metric", "error")}, 70.0)
    assert check(id="c", type="bar", encoding=enc(x="rare", y="v")) == ({("low_coverage", "warn"), ("sum_mismatch", "warn")}, 80.0)
    assert check(id="d", type="bar", encoding=enc(x="__column__", y="__null_pct__")) == ({(None, None)}, 100.0)
    assert check(id="e", type="line", encoding=enc(x="flag", y="v"))[1] == 70.0


# ---- run status -------------------------------------------------------------------------------

def test_status(spark):
    df = spark.createDataFrame([(1, [("ingesta", "done"), ("Perfilado", "processing")], "limpieza", None), (2, None, "report", 150),
                                (3, [("upload", "ok"), ("upload", "error")], None, -3)],
                               "i int, steps array<struct<name string, status string>>, current string, given int")
    up = df.withColumn("up", steps.upgrade_steps(F.col("steps"), F.col("current")))
    rows = up.select("i", F.col("up.status").alias("s"), steps.progress(F.col("up")).alias("p"),
                     steps.clamp_progress(F.col("given"), F.col("up")).alias("c")).orderBy("i").collect()
    assert rows[0]["s"] == ["ok", "running", "running", "pending", "pending"] and rows[0]["p"] == 40
    assert rows[1]["s"] == ["pending"] * 4 + ["running"] and rows[1]["c"] == 100
    assert rows[2]["s"] == ["failed"] + ["pending"] * 4 and rows[2]["c"] == 0
