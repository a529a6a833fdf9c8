"""Evaluation of a dashboard spec: KPI rows and the data of its charts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from limpid import vocab
from limpid.operators.charts import CHART_SCHEMA, chart_fields
from limpid.operators.guard import dashboard_charts
from limpid.operators.kpi import kpi_values, single_currency
from limpid.plans.together import charts_together


def used_columns(df: DataFrame, spec: dict) -> list[str]:
    """Columns that the KPIs and charts of a spec read; all of them when a chart is about missing values."""
    charts = dashboard_charts(spec)
    fields = {f for c in charts for f in chart_fields(c)} | {k.get("col") for k in spec.get("kpis", [])}
    if fields & {vocab.COLUMN_FIELD, vocab.NULL_PCT_FIELD}:
        return list(df.columns)
    return [c for c in df.columns if c in fields]


def dashboard_kpis(df: DataFrame, spec: dict) -> DataFrame:
    return kpi_values(df, spec.get("kpis", [])[:3])


def chart_prefixes(df: DataFrame, spec: dict, field: str = "moneda") -> DataFrame:
    """``(chart_id, prefix)``: the axis prefix of every chart of the dashboard that shows a metric.

    It is that of the only currency code in ``field``, empty where there are several or no such column.
    """
    shown = [str(c.get("id", "?")) for c in dashboard_charts(spec) if _metric_field(c)]
    ids = df.sparkSession.createDataFrame([(i,) for i in shown], "chart_id string")
    if field not in df.columns:
        return ids.withColumn("prefix", F.lit(""))
    prefix = single_currency(df, field).first()["prefix"]
    return ids.withColumn("prefix", F.lit(prefix))


def _metric_field(chart: dict) -> bool:
    encoding = chart.get("encoding") or {}
    channel = encoding.get("value" if chart.get("type") == "pie" else "y") or {}
    return chart.get("type") in ("line", "bar", "pie") and (channel.get("field") or vocab.ROW_FIELD) != vocab.ROW_FIELD


def dashboard_data(df: DataFrame, spec: dict) -> DataFrame:
    """Rows of the first four charts of the first dashboard, told apart by ``chart_id``, from one scan of the table."""
    charts = dashboard_charts(spec)
    return charts_together(df, charts) if charts else df.sparkSession.createDataFrame([], CHART_SCHEMA)
