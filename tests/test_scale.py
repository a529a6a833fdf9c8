"""Cases that need no limit on size, mixed inputs, and models from folders."""

import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from limpid.ml import features, models, training
from limpid.operators import charts, clean, columns, frequency, outliers, quantiles, steps
from limpid.operators.dedup import keep_first
from limpid.operators.filters import filter_domain
from limpid.plans import semantics, spec
from limpid.sources import delimited, runlog, tables


def test_heatmap_of_many_labels(spark):
    df = spark.range(24_000).select((F.col("id") % 12_000).cast("string").alias("x"), (F.col("id") % 2).cast("string").alias("y"), F.lit(1.5).alias("v"))
    out = charts.heatmap(df, "x", "y", "v", "sum")
    assert out.count() == 12_000 and out.agg(F.sum("value")).first()[0] == 36_000.0
    with pytest.raises(ValueError):
        charts.heatmap(df, "x", "y", "v", "sum", grid=100)


def test_full_heatmap_has_all_pairs(spark):
    df = spark.createDataFrame([("a", "p", 1.0), ("b", "q", 2.0), (None, "q", 9.0)], "x string, y string, v double")
    out = sorted(tuple(r) for r in charts.heatmap(df, "x", "y", "v", "sum", grid=5).collect())
    assert out == [("a", "p", 1.0), ("a", "q", 0.0), ("b", "p", 0.0), ("b", "q", 2.0)]
    assert charts.heatmap(df.limit(0), "x", "y", grid=5).collect() == []


def test_count_of_a_field_counts(spark):
    df = spark.createDataFrame([(datetime.date(2024, 1, 5), "a"), (datetime.date(2024, 3, 5), "b")], "d date, k string")
    month = {"id": "m", "type": "line", "encoding": {"x": {"field": "d", "timeUnit": "month"}, "y": {"field": "d", "aggregate": "count"}}}
    assert [(r["x"], r["value"]) for r in charts.run_chart(df, month).collect()] == [("2024-01", 1.0), ("2024-02", 0.0), ("2024-03", 1.0)]
    bars = {"id": "b", "type": "bar", "encoding": {"x": {"field": "k"}, "y": {"field": "d", "aggregate": "count"}}}
    assert sorted(r["value"] for r in charts.run_chart(df, bars).collect()) == [1.0, 1.0]


def test_values_beyond_a_thousand_are_ranked(spark):
    df = spark.range(30_000).select((F.sqrt("id") * 10).cast("int").cast("string").alias("v"))
    want = df.groupBy("v").count().orderBy(F.desc("count"), "v").limit(1500).collect()
    got = filter_domain(df, [{"field": "v", "type": "categorical", "max_values": 1500}]).orderBy("rank").collect()
    assert [(r["value"], r["n"]) for r in got] == [tuple(r) for r in want]


def test_cardinalities_are_exact(spark):
    df = spark.range(20_000).select((F.col("id") % 7_001).alias("a"), F.lit(None).cast("string").alias("b"), F.col("id").alias("c"))
    assert columns.cardinalities(df) == {"a": 7_001, "b": 0, "c": 20_000}
    assert columns.cardinalities(df.limit(0)) == {"a": 0, "b": 0, "c": 0}


@pytest.mark.parametrize("limit", [1, 50, 200_000])
def test_quantiles_are_values_at_ranks(spark, limit):
    values = [((i * 7919) % 1000) / 7 for i in range(3000)] + [1e6] * 700
    df = spark.createDataFrame([(v,) for v in values], "v double")
    probs = [0.0, 0.05, 0.25, 0.5, 0.77, 0.95, 1.0]
    ordered = sorted(values)
    want = []
    for p in probs:
        at = p * (len(values) - 1)
        low, high = ordered[int(at)], ordered[min(int(at) + 1, len(values) - 1)]
        want.append(low + (high - low) * (at - int(at)))
    assert quantiles.exact_quantiles(df, {"v": F.col("v")}, probs, cell_limit=limit, accuracy=50)["v"] == want


def test_text_fills_of_other_types(spark):
    df = spark.createDataFrame([(True, datetime.date(2024, 1, 1)), (None, None)], "b boolean, d date")
    out, filled = clean.impute(df, {"impute": {"default": {"text": "value", "value": "N/D"}}})
    assert sorted(map(tuple, out.collect())) == [("N/D", "N/D"), ("true", "2024-01-01")] and filled == {"b": 1, "d": 1}
    out, _ = clean.impute(df, {"impute": {"by_column": {"b": {"strategy": "value", "value": "false"}, "d": {"strategy": "value", "value": "2024-02-03"}}}})
    assert out.dtypes == df.dtypes and (False, datetime.date(2024, 2, 3)) in map(tuple, out.collect())


def test_decimals_keep_their_type(spark):
    rows = [(Decimal("9.50"),), (Decimal("10.00"),), (Decimal("10.00"),), (Decimal("9.50"),), (None,)]
    df = spark.createDataFrame(rows, "v decimal(10,2)")
    assert frequency.modes(df, ["v"]) == {"v": Decimal("9.50")}
    out, _ = clean.impute(df, {"impute": {"default": {"numeric": "mode"}}})
    assert out.dtypes == [("v", "decimal(10,2)")] and out.where("v is null").count() == 0


def test_headers_in_different_order(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\nx,1\n")
    (tmp_path / "b.csv").write_text("b,a,c\n2,y,k\n")
    (tmp_path / "c.csv").write_bytes("a,ñ\nz,ü\n".encode("latin-1"))
    got = delimited.read_csv(spark, str(tmp_path), position=True)
    rows = [tuple(r)[:-1] for r in got.orderBy("_pos").collect()]
    assert got.columns == ["a", "b", "c", "col_1", "_pos"] and rows == [("x", 1, None, None), ("y", 2, "k", None), ("z", None, None, "ü")]


def test_long_numbers_keep_their_digits(spark, tmp_path):
    (tmp_path / "a.csv").write_text("n,m\n12345678901234567890,1\n-5,2\n")
    got = delimited.read_csv(spark, str(tmp_path / "a.csv"))
    assert got.dtypes == [("n", "decimal(38,0)"), ("m", "bigint")]
    assert sorted(r["n"] for r in got.collect()) == [Decimal(-5), Decimal("12345678901234567890")]


def test_positions_of_parquet_and_many_files(spark, tmp_path):
    spark.range(50).selectExpr("id", "id % 3 as k").coalesce(1).write.parquet(str(tmp_path / "t.parquet"))
    table = tables.load_table(spark, str(tmp_path / "t.parquet"), position=True)
    assert [r["id"] for r in table.orderBy("_pos").collect()] == list(range(50))
    assert sorted(r["id"] for r in keep_first(table, ["k"]).collect()) == [0, 1, 2]
    folder = tmp_path / "many"
    folder.mkdir()
    for i in range(60):
        (folder / f"f{i:03d}.csv").write_text(f"n\n{2 * i}\n{2 * i + 1}\n")
    found = delimited.read_csv(spark, str(folder), position=True)
    assert [r["n"] for r in found.orderBy("_pos").collect()] == list(range(120))


def test_step_entries_under_other_names(spark):
    stage = steps.vocab.STAGES[0]
    for key in ("name", "step", "title"):
        df = spark.createDataFrame([([(stage, "done")],)], f"s array<struct<{key}: string, status: string>>")
        assert df.select(steps.upgrade_steps(F.col("s")).alias("u")).first()["u"][0]["status"] == "ok"


def test_run_log_keeps_every_field(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"type": "x", "roles": {"a": "id"}, "contamination": 0.05}\n')
    log = runlog.read_log(spark, str(tmp_path))
    assert log.select(F.variant_get("fields", "$.roles.a", "string")).first()[0] == "id"


def test_lone_coordinate_is_no_metric(spark):
    df = spark.createDataFrame([(float(i % 80) + 0.5, f"k{i % 4}") for i in range(60)], "plataforma_lat double, grupo string")
    found = semantics.infer_semantics(df)
    assert "plataforma_lat" not in (found.dims + [found.primary_metric])


def test_headers_are_normalised_first(spark):
    df = spark.createDataFrame([(i, float(i) * 1.5) for i in range(40)], "`Cantidad ` int, `Unit Price` double")
    assert set(semantics.infer_semantics(df).roles) == {"cantidad", "unit_price"}


def test_currency_named_late(spark):
    rows = [(str(i),) for i in range(400)] + [("US$ 5",)]
    assert semantics.currency_of(spark.createDataFrame(rows, "v string"), "v") == "USD"


def test_forest_scores_planted_row_highest(spark):
    rows = [(float(i % 10), float(i % 7)) for i in range(600)] + [(900.0, -700.0)]
    df = spark.createDataFrame(rows, "a double, b double").coalesce(2)
    out, summary = outliers.isolation_forest(df, 0.05, n_trees=40)
    best = out.orderBy(F.desc("outlier_score")).first()
    assert best["a"] == 900.0 and best["is_outlier"] and out.columns == ["a", "b", "is_outlier", "outlier_score", "outlier_method"]
    assert summary["total"] == 601 == out.count() and out.where("is_outlier <> (outlier_score > 0)").count() == 0
    assert out.where("is_outlier").count() <= 0.05 * 601 + 1


def test_models_from_a_folder(spark, tmp_path):
    for i in range(2):
        (tmp_path / f"sales__{i}.csv").write_text("fecha,cliente,monto\n" + "".join(f"2024-0{1 + k % 9}-01,c{k % 3},{k * 10}\n" for k in range(30)))
        (tmp_path / f"hr__{i}.csv").write_text("empleado,cargo,salario\n" + "".join(f"e{k},p{k % 3},{k * 7}\n" for k in range(30)))
    (tmp_path / "plain.csv").write_text("a\n1\n")
    table = training.training_table(spark, str(tmp_path))
    assert table.select("label").distinct().count() == 2 and table.count() == 12
    model = training.train_domain(spark, str(tmp_path))
    one = tables.load_table(spark, str(tmp_path / "hr__0.csv"))
    assert semantics.infer_semantics(one, model).domain == "hr"
    data = features.schema_table(spark, {n: semantics.infer_semantics(tables.load_table(spark, str(tmp_path / f"{n}__0.csv"))) for n in ("sales", "hr")})
    ranked = spec.chart_types(None, None, models.train_charts(data, trees=5), data.where("dataset = 'hr'"))
    assert ranked and all(ranked)


def test_staged_tables_are_released(spark, tmp_path, monkeypatch):
    from limpid import storage
    monkeypatch.setattr(storage, "scratch_root", lambda _: str(tmp_path / "scratch"))
    assert storage.materialize(spark.range(5)).count() == 5 and list((tmp_path / "scratch").iterdir())
    storage.release(spark)
    assert not (tmp_path / "scratch").exists()


def test_workbooks_with_other_headers(spark, tmp_path):
    from test_sources import STRINGS, write_xlsx
    from limpid.sources import workbook
    write_xlsx(tmp_path / "a.xlsx", [STRINGS[:4], [45292, "Acme", 1000, "CLP"]])
    write_xlsx(tmp_path / "b.xlsx", [["Monto", "Fecha "], [2000, 45293]])
    got = workbook.read_workbooks(spark, str(tmp_path))
    assert sorted(map(tuple, got.select("fecha", "monto", "moneda").collect())) == [("2024-01-01", 1000, "CLP"), ("2024-01-02", 2000, None)]


def test_first_listed_sheet(spark, tmp_path):
    import zipfile
    from test_sources import sheet
    from limpid.sources import workbook
    ns = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="b" r:id="r2"/><sheet name="a" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<R><R1 Id="r1" Target="worksheets/sheet1.xml"/><R1 Id="r2" Target="worksheets/sheet2.xml"/></R>')
        z.writestr("xl/worksheets/sheet1.xml", sheet([[1], [2]]))
        z.writestr("xl/worksheets/sheet2.xml", sheet([[7], [8]]))
    assert [r[0] for r in workbook.read_workbooks(spark, str(tmp_path)).collect()] == [8]
