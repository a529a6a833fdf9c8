"""Files written and read back."""

import zipfile

import pytest

from limpid.plans.spec import safe_spec
from limpid.sources import delimited, runlog, tables, workbook

MINI = "fecha,cliente,monto,moneda\n2024-01-01,Acme,1000,CLP\n2024-01-02,Beta,2000,CLP\n"


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_csv_types_and_tokens(spark, tmp_path):
    (tmp_path / "a.csv").write_text('\ufeffAño ,monto,MONTO,ok,nota,\n1,1.5,x,True,"a ""b"", c",\n2,NA,#N/A,false,n/a,\n', encoding="utf-8")
    df = delimited.read_csv(spark, str(tmp_path / "a.csv"))
    assert df.dtypes == [("a_o", "bigint"), ("monto", "double"), ("monto_2", "string"), ("ok", "boolean"), ("nota", "string"), ("col_1", "string")]
    assert rows(df) == [(1, 1.5, "x", True, 'a "b", c', None), (2, None, None, False, None, None)]


def test_csv_mixed_encodings(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("c,n\nañil,1\n".encode("utf-8"))
    (tmp_path / "b.csv").write_bytes("c,n\nniño,2\n".encode("latin-1"))
    assert sorted(rows(delimited.read_csv(spark, str(tmp_path)))) == [("añil", 1), ("niño", 2)]


def test_row_position_over_splits(spark, tmp_path):
    folder = tmp_path / "with space"
    folder.mkdir()
    for f in range(3):
        (folder / f"part{f}.csv").write_text("n\n" + "".join(f"{f * 1000 + i}\n" for i in range(1000)))
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    try:
        df = delimited.read_csv(spark, str(folder), encoding="UTF-8", position=True)
        assert df.rdd.getNumPartitions() > 6
        found = df.orderBy("_pos").select("n", "_pos").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept[0])
        spark.conf.set("spark.sql.files.openCostInBytes", kept[1])
    assert [r["n"] for r in found] == list(range(3000)) and len({r["_pos"] for r in found}) == 3000


def sheet(rows):
    def cell(v):
        return f"<c><v>{v}</v></c>" if isinstance(v, (int, float)) else f'<c t="s"><v>{STRINGS.index(v)}</v></c>'
    return "<worksheet><sheetData>" + "".join("<row>" + "".join(map(cell, r)) + "</row>" for r in rows) + "</sheetData></worksheet>"


STRINGS = ["Fecha ", " Cliente", "Monto", "Moneda", "Acme", "Beta", "CLP"]


def write_xlsx(path, rows):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/sharedStrings.xml", "<sst>" + "".join(f"<si><t>{s}</t></si>" for s in STRINGS) + "</sst>")
        z.writestr("xl/styles.xml", '<styleSheet><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", sheet(rows).replace("<c><v>45292</v>", '<c s="1"><v>45292</v>').replace("<c><v>45293</v>", '<c s="1"><v>45293</v>'))


def test_xlsx(spark, tmp_path):
    for name in "ab":
        write_xlsx(tmp_path / f"{name}.xlsx", [STRINGS[:4], [45292, "Acme", 1000, "CLP"], [45293, "Beta", 2000.5, "CLP"]])
    df = workbook.read_workbooks(spark, str(tmp_path))
    assert df.dtypes == [("fecha", "string"), ("cliente", "string"), ("monto", "double"), ("moneda", "string")]
    assert sorted(rows(df)) == [("2024-01-01", "Acme", 1000.0, "CLP")] * 2 + [("2024-01-02", "Beta", 2000.5, "CLP")] * 2
    assert tables.load_table(spark, str(tmp_path / "a.xlsx")).count() == 2


def test_ods(spark, tmp_path):
    def cell(v):
        if isinstance(v, int):
            return f'<c:table-cell o:value-type="float" o:value="{v}"><t:p>{v}</t:p></c:table-cell>'
        if v.startswith("2024"):
            return f'<c:table-cell o:value-type="date" o:date-value="{v}"><t:p>x</t:p></c:table-cell>'
        return f'<c:table-cell o:value-type="string"><t:p>{v}</t:p></c:table-cell>'
    lines = [["Fecha", "Cliente", "Monto"], ["2024-01-01", "Acme", 1000], ["2024-01-02", "Beta", 2000]]
    body = "".join("<c:table-row>" + "".join(map(cell, r)) + '<c:table-cell c:number-columns-repeated="1020"/></c:table-row>' for r in lines)
    with zipfile.ZipFile(tmp_path / "a.ods", "w") as z:
        z.writestr("content.xml", f'<d xmlns:c="c" xmlns:o="o" xmlns:t="t"><c:table>{body}<c:table-row c:number-rows-repeated="1048000"><c:table-cell/>'
                                  "</c:table-row></c:table><c:table><c:table-row><c:table-cell/></c:table-row></c:table></d>")
    df = tables.load_table(spark, str(tmp_path / "a.ods"))
    assert rows(df) == [("2024-01-01", "Acme", 1000), ("2024-01-02", "Beta", 2000)]


def test_load_table_dispatch(spark, tmp_path):
    (tmp_path / "mini.csv").write_text(MINI)
    df = tables.load_table(spark, str(tmp_path / "mini.csv"), position=True)
    assert (df.count(), df.columns) == (2, ["fecha", "cliente", "monto", "moneda", "_pos"])
    with pytest.raises(ValueError):
        tables.load_table(spark, str(tmp_path / "nota.txt"))


def test_training_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name in ("sales__a.csv", "sub/HR__b.csv", "plain.csv"):
        (tmp_path / name).write_text(MINI)
    found = tables.training_files(spark, str(tmp_path)).collect()
    assert sorted(r["label"] for r in found) == ["hr", "sales"]


def test_run_log(spark, tmp_path):
    path = str(tmp_path / "log")
    events = spark.createDataFrame([("stage_end", "Limpieza", "ok", 5), ("stage_end", "Limpieza", "failed", 7)],
                                   "type string, stage string, status string, duration_ms long").coalesce(1)
    runlog.append_log(events, path)
    (tmp_path / "log" / "zz.json").write_text('{"type": "x", "ts": "t"}\n{"type": "cor\n\nnot json\n')
    found = runlog.read_log(spark, path)
    assert found.count() == 3 and found.where("ts is null").count() == 0
    assert [r["type"] for r in runlog.read_log(spark, path, 1).collect()] == ["x"]
    from limpid.operators.steps import stage_durations
    assert tuple(stage_durations(found).first()) == ("Limpieza", 2, 1, 12, 7)


def test_spec_keeps_accents(spark, tmp_path):
    spec = safe_spec(spark.createDataFrame([("a",)], "`región` string"), {}, "Categoría")
    tables.write_spec(spark, spec, str(tmp_path / "s"))
    assert tables.read_spec(spark, str(tmp_path / "s")) == spec
    assert "región" in next((tmp_path / "s").glob("*.txt")).read_text(encoding="utf-8")
