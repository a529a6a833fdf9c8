"""Headline numbers of a dashboard, all from one aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from limpid import vocab
from limpid.functions import numbers
from limpid.operators.charts import metric
from limpid.operators.cells import col
from limpid.operators.sketches import distinct_sketch

UNKNOWN = "—"


def _plain(df: DataFrame, name: str) -> Column:
    return numbers.as_number(col(name), df.schema[name].dataType, "plain")


def _thousands(value: Column) -> Column:
    return numbers.spanish_number(value, 0)


# op -> (aggregate, number format)
OPS = {
    "sum": (lambda df, c: F.coalesce(F.sum(metric(df, c)), F.lit(0.0)), numbers.spanish_number),
    "mean": (lambda df, c: F.coalesce(F.avg(metric(df, c)), F.lit(0.0)), numbers.spanish_number),
    "nunique": (lambda df, c: F.count_distinct(col(c)), _thousands),
    "nunique_sketch": (lambda df, c: F.hll_sketch_estimate(distinct_sketch(col(c))), _thousands),
    "ratio_gt_zero": (lambda df, c: F.avg((F.coalesce(_plain(df, c), F.lit(0.0)) > 0).cast("double")) * 100,
                      numbers.percent_label),
    "ratio_true": (lambda df, c: F.avg(F.coalesce(F.lower(col(c).cast("string")).isin(*vocab.KPI_TRUE),
                                                  F.lit(False)).cast("double")) * 100,
                   numbers.percent_label),
}


def kpi_values(df: DataFrame, kpis: list[dict]) -> DataFrame:
    """``(ordinal, title, op, value, text)``: one row per KPI, ``—`` for one that cannot be computed."""
    measures, rows = [], []
    for i, kpi in enumerate(kpis):
        op, field = (kpi.get("op") or "").lower(), kpi.get("col")
        if op == "count_rows":
            aggregate, fmt = F.count(F.lit(1)), _thousands
        elif op in OPS and field in df.columns:
            aggregate, fmt = OPS[op][0](df, field), OPS[op][1]
        else:
            aggregate, fmt = F.max(F.lit(None).cast("double")), lambda v: F.lit(None).cast("string")
        measures.append(aggregate.cast("double").alias(f"k{i}"))
        rows.append(F.struct(
            F.lit(i).alias("ordinal"), F.lit(kpi.get("title", "KPI")).alias("title"), F.lit(op).alias("op"),
            F.col(f"k{i}").alias("value"), F.coalesce(fmt(F.col(f"k{i}")), F.lit(UNKNOWN)).alias("text")))
    if not rows:
        return df.sparkSession.createDataFrame([], "ordinal int, title string, op string, value double, text string")
    return df.agg(*measures).select(F.inline(F.array(*rows)))


def single_currency(df: DataFrame, field: str = "moneda") -> DataFrame:
    """One row ``(currency, prefix)``: filled only when the column holds exactly one code."""
    code = F.upper(col(field).cast("string"))
    seen = df.agg(F.min(code).alias("first"), F.max(code).alias("last"))
    one = F.when(F.col("first") == F.col("last"), F.col("first"))
    return seen.select(one.alias("currency"),
                       F.coalesce(numbers.currency_prefix(one), F.lit("")).alias("prefix"))
