"""Sources, sinks and run logs: tables written to the shared scratch folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import Tables, query
from limpid import vocab
from limpid.operators import profile, steps
from limpid.plans import roles, spec
from limpid.sources import delimited, runlog, tables, workbook
from limpid.storage import scratch_path


#: Rows of one written file, at most about; what a task sorts does not grow with the table.
FILE_ROWS = 500_000


def files_of(table, least):
    """How many files a table is written to, ``least`` or more."""
    return max(least, -(-table.count() // FILE_ROWS))


@query("csv_roundtrip", """
    select o_orderkey as clave, fecha, monto, precio, nullif(prioridad, '') as prioridad, pagado, nullif(relleno, '') as relleno from dirty_orders""")
def _(t: Tables):
    folder = scratch_path(t.spark, "csv")
    out = t.dirty_orders.selectExpr("o_orderkey as `Clave `", "fecha as ` Fecha`", "monto as MONTO", "precio", "prioridad", "pagado", "relleno")
    tables.write_csv(out, folder)
    return delimited.read_csv(t.spark, folder, encoding="UTF-8")


@query("csv_quotes_and_lines", "select doc_id, text, n_chars from documents")
def _(t: Tables):
    folder = scratch_path(t.spark, "csv")
    tables.write_csv(t.documents.select("doc_id", "text", "n_chars"), folder)
    return delimited.read_csv(t.spark, folder)


@query("csv_latin1", "select c_custkey as clave, 'año ' || c_mktsegment as segmento from customer")
def _(t: Tables):
    folder = scratch_path(t.spark, "csv")
    rows = t.customer.selectExpr("c_custkey as clave", "'año ' || c_mktsegment as segmento")
    rows.write.option("header", True).option("encoding", "ISO-8859-1").csv(folder)
    return delimited.read_csv(t.spark, folder)


@query("csv_mixed_headers", """
    select o_orderkey as clave, o_custkey as cliente, case when o_orderkey % 2 = 0 then o_orderstatus end as estado from orders""")
def _(t: Tables):
    # files of one folder with other columns in another order
    folder = scratch_path(t.spark, "csv")
    named = t.orders.selectExpr("o_orderkey as clave", "o_custkey as cliente", "o_orderstatus as estado")
    tables.write_csv(named.where("clave % 2 = 0"), folder)
    tables.write_csv(named.where("clave % 2 = 1").select("cliente", "clave"), folder, "append")
    return delimited.read_csv(t.spark, folder, encoding="UTF-8")


@query("load_parquet", """
    select o_orderstatus as estado_final, min(o_orderkey) as clave, count(*) as filas from orders group by 1""")
def _(t: Tables):
    # a parquet folder by its suffix, with clean names and row positions: the first row of each status by position
    folder = scratch_path(t.spark, "tabla") + ".parquet"
    named = t.orders.selectExpr("o_orderkey as Clave", "o_orderstatus as `Estado Final`")
    named.repartitionByRange(files_of(t.orders, 4), "Clave").sortWithinPartitions("Clave").write.parquet(folder)
    table = tables.load_table(t.spark, folder, position=True)
    # first in each file, by whole numbers alone: places with a name would have every task sort its rows by status
    firsts = table.groupBy("estado_final", "_pos.file").agg(F.min_by("clave", "_pos.row").alias("clave"), F.count(F.lit(1)).alias("filas"))
    return firsts.groupBy("estado_final").agg(F.min_by("clave", "file").alias("clave"), F.sum("filas").alias("filas"))


@query("csv_row_order", "select o_orderkey, row_number() over (order by o_orderkey) - 1 as place from orders")
def _(t: Tables):
    folder = scratch_path(t.spark, "csv")
    named = t.orders.select("o_orderkey", "o_orderpriority")
    tables.write_csv(named.repartitionByRange(files_of(t.orders, 6), "o_orderkey").sortWithinPartitions("o_orderkey"), folder)
    table = delimited.read_csv(t.spark, folder, encoding="UTF-8", position=True)
    return delimited.number_rows(table, "place").select("o_orderkey", "place")


def workbook_writer():
    """Function for ``applyInPandas``: the rows of a group as one minimal ``.xlsx`` file."""
    def write(rows):
        import io
        import zipfile
        import pandas as pd
        from xml.sax.saxutils import escape

        def cell(v):
            if v is None or v != v:
                return "<c/>"
            if isinstance(v, str):
                return f'<c t="inlineStr"><is><t>{escape(v)}</t></is></c>'
            return f"<c><v>{v}</v></c>"

        names = [c for c in rows.columns if c != "book"]
        lines = [names] + rows[names].values.tolist()
        body = "".join("<row>" + "".join(cell(v) for v in line) + "</row>" for line in lines)
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w") as z:
            z.writestr("xl/worksheets/sheet1.xml", "<worksheet xmlns='http://schemas.openxmlformats.org/spreadsheetml/2006/main'>"
                       f"<sheetData>{body}</sheetData></worksheet>")
        return pd.DataFrame({"path": [f"book-{int(rows['book'].iloc[0]):09d}.xlsx"], "content": [data.getvalue()]})
    return write


@query("workbook_scan", "select c_custkey as clave, c_name as nombre, c_acctbal as saldo, c_mktsegment as segmento from customer")
def _(t: Tables):
    # at most 500 customers per book, however large the table
    rows = t.customer.selectExpr("cast(floor(c_custkey / 500) as bigint) as book", "c_custkey as `Clave `", "c_name as Nombre",
                                 "c_acctbal as Saldo", "c_mktsegment as Segmento")
    books = rows.groupBy("book").applyInPandas(workbook_writer(), "path string, content binary")
    return workbook.workbook_table(books)


@query("training_scan", """
    select lower(o_orderpriority) as label, count(*) as rows from orders group by 1""")
def _(t: Tables):
    folder = scratch_path(t.spark, "training")
    labelled = t.orders.select("o_orderkey", "o_totalprice", F.concat("o_orderpriority", F.lit("__orders")).alias("part"))
    labelled.write.option("header", True).partitionBy("part").csv(folder)
    rows = t.spark.read.option("header", True).option("recursiveFileLookup", True).csv(folder)
    sizes = rows.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count(F.lit(1)).alias("n"))
    plain = F.regexp_replace(F.url_decode("path"), "^file:/+", "file:/")
    files = tables.training_files(t.spark, folder).select("label", plain.alias("path"))
    met = sizes.withColumn("path", plain).join(files, "path")
    return met.groupBy(F.url_decode("label").alias("label")).agg(F.sum("n").alias("rows"))


@query("profile_csv", """
    select 'o_orderkey' as "column", 'id' as role, count(distinct o_orderkey) || ' (100.00%)' as uniques, '0 (0.00%)' as nulls from orders
    union all select 'o_orderstatus', 'texto', count(distinct o_orderstatus) || ' (' || format('{:.2f}%', count(distinct o_orderstatus) * 100.0 / count(*)) || ')', '0 (0.00%)' from orders""")
def _(t: Tables):
    folder = scratch_path(t.spark, "profile")
    table = profile.profile(t.orders.select("o_orderkey", "o_orderstatus"), {"o_orderkey": "id", "o_orderstatus": "texto"}, "o_orderkey")
    tables.write_profile(table, folder)
    return t.spark.read.option("header", True).csv(folder).select("column", "role", "uniques", "nulls")


@query("spec_json")
def _(t: Tables):
    # the spec that the statistics of the table lead to, written and read back
    folder = scratch_path(t.spark, "spec")
    df = t.orders.drop("o_comment")
    _, found = spec.auto_spec(df, roles.infer_types(df), "Órdenes")
    tables.write_spec(t.spark, found, folder)
    back = tables.read_spec(t.spark, folder)
    assert back == found
    return t.spark.createDataFrame([(c["id"], c["type"], c["title"]) for c in back["charts"]], "id string, type string, title string")


@query("chart_json", "select 'top' as chart_id, o_orderstatus as x, cast(count(*) as double) as value from orders group by 2")
def _(t: Tables):
    from limpid.operators.charts import run_chart
    folder = scratch_path(t.spark, "charts")
    chart = {"id": "top", "type": "bar", "encoding": {"x": {"field": "o_orderstatus"}, "y": {"aggregate": "count"}}}
    tables.write_charts(run_chart(t.orders, chart), folder)
    return t.spark.read.schema("chart_id string, x string, value double").json(folder)


# ---- run log and run status -------------------------------------------------------------------

def _log(t: Tables, corrupt: bool = True) -> str:
    """The events as a JSON-lines log, one line in six cut short."""
    folder = scratch_path(t.spark, "log")
    line = F.to_json(F.struct("type", "stage", "status", "duration_ms", F.col("event_id").alias("rows")))
    lines = t.run_events.select(F.when((F.col("event_id") % 6 == 0) & F.lit(corrupt), F.substring(line, 1, 20)).otherwise(line).alias("value"))
    lines.write.text(folder)
    return folder


@query("runlog_scan", """
    select type, stage, status, duration_ms, event_id as rows from run_events where event_id % 6 <> 0""")
def _(t: Tables):
    return runlog.read_log(t.spark, _log(t)).select("type", "stage", "status", "duration_ms", "rows")


@query("runlog_last", """
    select type, stage, status, duration_ms, event_id as rows from run_events where event_id % 6 <> 0 order by event_id desc limit 50""")
def _(t: Tables):
    folder = scratch_path(t.spark, "log")
    line = F.to_json(F.struct("type", "stage", "status", "duration_ms", F.col("event_id").alias("rows")))
    lines = t.run_events.select("event_id", F.when(F.col("event_id") % 6 == 0, F.substring(line, 1, 20)).otherwise(line).alias("value"))
    lines.repartitionByRange(files_of(lines, 4), "event_id").sortWithinPartitions("event_id").select("value").write.text(folder)
    return runlog.read_log(t.spark, folder, 50).select("type", "stage", "status", "duration_ms", "rows")


@query("runlog_fields", """
    select event_id as rows, case when event_id % 2 = 0 then 'c' || (event_id % 5) end as col, event_id % 7 as n from run_events""")
def _(t: Tables):
    # fields of single events that no schema names
    folder = scratch_path(t.spark, "log")
    extra = F.struct(F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("c"), (F.col("event_id") % 5).cast("string"))).alias("col"),
                     (F.col("event_id") % 7).alias("n"))
    t.run_events.select(F.to_json(F.struct("type", F.col("event_id").alias("rows"), extra.alias("columns_used"))).alias("value")).write.text(folder)
    log = runlog.read_log(t.spark, folder)
    return log.select("rows", F.try_variant_get("fields", "$.columns_used.col", "string").alias("col"),
                      F.try_variant_get("fields", "$.columns_used.n", "long").alias("n"))


@query("runlog_append", """
    select type, count(*) * 2 as n, count(*) * 2 as stamped from run_events group by 1""")
def _(t: Tables):
    folder = scratch_path(t.spark, "log")
    for _ in range(2):
        runlog.append_log(t.run_events.select("type", "stage"), folder)
    return runlog.read_log(t.spark, folder).groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.count("ts").alias("stamped"))


@query("runlog_appends", """
    select type, stage, status, duration_ms, event_id as rows from run_events order by event_id desc limit 70""")
def _(t: Tables):
    # the last events of a log that six jobs have appended to
    folder = scratch_path(t.spark, "log")
    events = t.run_events.select("type", "stage", "status", "duration_ms", F.col("event_id").alias("rows"))
    sixth = events.agg(F.ceil((F.max("rows") + 1) / 6)).first()[0]
    for i in range(6):
        part = events.where(f"rows >= {i * sixth} and rows < {(i + 1) * sixth}")
        runlog.append_log(part.repartitionByRange(files_of(part, 3), "rows").sortWithinPartitions("rows"), folder)
    return runlog.read_log(t.spark, folder, 70).select("type", "stage", "status", "duration_ms", "rows")


@query("stage_durations", """
    with e as (select *, event_id // 40 as run from run_events),
    w as (select *, lead(type) over s as next_type, lead(status) over s as next_status, lead(duration_ms) over s as next_ms,
        lag(type) over s as before, max(event_id) over (partition by run) as last from e window s as (partition by run, stage order by event_id)),
    x as (select stage, case when type = 'stage_end' then status when next_type = 'stage_end' then next_status when event_id < last then 'crashed' else 'open' end as state,
        case when type = 'stage_end' then duration_ms when next_type = 'stage_end' then next_ms end as ms
      from w where type = 'stage_start' or before is null or before = 'stage_end')
    select stage, count(*) as runs, count(*) filter (state = 'failed') as failed, count(*) filter (state = 'crashed') as crashed,
      count(*) filter (state = 'open') as open, cast(coalesce(sum(ms), 0) as bigint) as total_ms, max(ms) as max_ms from x group by 1""")
def _(t: Tables):
    log = runlog.read_log(t.spark, _log(t, corrupt=False)).withColumn("run", F.floor(F.col("rows") / 40))
    return steps.stage_durations(log, "rows", "run")


def _status_sql(c):
    w = f"lower(trim(coalesce({c}, '')))"
    return (f"case when {w} in ('ok','done','success','completed','finished') then 'ok' when {w} in ('running','in_progress','processing') then 'running' "
            f"when {w} in ('failed','error') then 'failed' when {w} in ('pending','queued','waiting','') then 'pending' else {w} end")


def _title_sql(c):
    arms = " ".join(f"when '{slug}' then '{title}'" for slug, title in vocab.STAGE_TITLES.items())
    return f"case lower(trim(coalesce({c}, ''))) {arms} else trim(coalesce({c}, '')) end"


@query("status_normalize", f"select run_id, {_status_sql('status')} as status, {_title_sql('current')} as current from runs")
def _(t: Tables):
    return t.runs.select("run_id", steps.normalize_status(F.col("status")).alias("status"), steps.stage_title(F.col("current")).alias("current"))


def _stage_sql(stage):
    first, second, now = _title_sql("first_step"), _title_sql("second_step"), f"(current is not null and {_title_sql('current')} = '{stage}')"
    raw = (f"case when {second} = '{stage}' then {_status_sql('status')} when {first} = '{stage}' then {_status_sql('first_status')} else 'pending' end")
    return f"case when {raw} = 'pending' and {now} then 'running' else {raw} end"


STAGE_COLUMNS = {f"s{i}": _stage_sql(s) for i, s in enumerate(vocab.STAGES)}


def _upgraded(t: Tables):
    listed = F.array(F.struct(F.col("first_step").alias("name"), F.col("first_status").alias("status")),
                     F.struct(F.col("second_step").alias("name"), F.col("status").alias("status")))
    return t.runs.select("run_id", "given", steps.upgrade_steps(listed, F.col("current")).alias("steps"))


@query("steps_upgrade", "select run_id, " + " || ',' || ".join(STAGE_COLUMNS.values()) + " as steps from runs")
def _(t: Tables):
    return _upgraded(t).select("run_id", F.array_join(F.col("steps.status"), ",").alias("steps"))


def _done_sql(stage):
    names = f"({_title_sql('first_step')} = '{stage}' or {_title_sql('second_step')} = '{stage}')"
    return f"case when {names} then 'ok' when current is not null and {_title_sql('current')} = '{stage}' then 'running' else 'pending' end"


@query("steps_finished", "select run_id, " + " || ',' || ".join(_done_sql(s) for s in vocab.STAGES) + " as steps from runs")
def _(t: Tables):
    done = steps.upgrade_finished(F.array("first_step", "second_step"), F.col("current"))
    return t.runs.select("run_id", F.array_join(done["status"], ",").alias("steps"))


POINTS = " + ".join(f"(case {c} when 'ok' then 1.0 when 'running' then 0.5 else 0.0 end)" for c in STAGE_COLUMNS)


@query("progress", "with s as (select run_id, given, " + ", ".join(f"{sql} as {c}" for c, sql in STAGE_COLUMNS.items()) + f""" from runs)
    select run_id, cast(round(({POINTS}) * 20) as int) as implied,
    cast(coalesce(least(greatest(given, 0), 100), round(({POINTS}) * 20)) as int) as progress from s""")
def _(t: Tables):
    up = _upgraded(t)
    return up.select("run_id", steps.progress(F.col("steps")).alias("implied"),
                     steps.clamp_progress(F.col("given"), F.col("steps")).alias("progress"))
