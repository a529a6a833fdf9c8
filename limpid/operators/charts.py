"""The data behind each chart, one aggregate per chart.

Every function returns plain columns; ``as_chart`` gives them the common shape
``(chart_id, x, y, low, high, value)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from limpid import vocab
from limpid.functions import dates, numbers
from limpid.operators.clean import tolerant_date
from limpid.operators.cells import col
from limpid.operators.columns import null_percent

CHART_SCHEMA = "chart_id string, x string, y string, low double, high double, value double"


def metric(df: DataFrame, field: str) -> Column:
    """Chart value of a column: numeric as is, text read as money."""
    return numbers.as_number(col(field), df.schema[field].dataType, "money")


def is_metric(df: DataFrame, field: str | None, aggregate: str) -> bool:
    """Whether a chart aggregates values of a column; a count is of rows, whatever field it names."""
    return bool(field) and field != vocab.ROW_FIELD and field in df.columns and aggregate != "count"


def aggregate_of(name: str, value: Column) -> Column:
    """``sum`` adds up, zero over no values; every other name is the mean."""
    return F.coalesce(F.sum(value), F.lit(0.0)) if name == "sum" else F.avg(value)


#: Of the rows of a group: their sum, values and number. What each aggregate of a chart is made from.
GROUPED = {"total": lambda v: F.sum(v), "values": lambda v: F.count(v), "rows": lambda v: F.count(F.lit(1))}


def from_grouped(has_metric: bool, aggregate: str) -> Column:
    """A chart's value from the ``GROUPED`` measures: rows where it has no metric, a sum (null over no values), else the mean."""
    if not has_metric:
        return F.col("rows").cast("double")
    return F.col("total") if aggregate == "sum" else F.col("total") / F.nullif(F.col("values"), F.lit(0))


def by_month(df: DataFrame, date_field: str, value_field: str | None = None, aggregate: str = "count") -> DataFrame:
    """``(x, value)`` per month, x as ``yyyy-MM``.

    A metric leaves out months without a value; counting rows fills the months in between with zero.
    """
    has_metric = is_metric(df, value_field, aggregate)
    value = metric(df, value_field) if has_metric else F.lit(None).cast("double")
    grouped = (df.select(dates.month_start(tolerant_date(df, date_field)).alias("month"), value.alias("v")).where("month is not null")
               .groupBy("month").agg(*[m(F.col("v")).alias(n) for n, m in GROUPED.items()]))
    return months(grouped, has_metric, aggregate)


def months(grouped: DataFrame, has_metric: bool, aggregate: str) -> DataFrame:
    """``by_month`` from the measures of each ``month``."""
    seen = grouped.select("month", from_grouped(has_metric, aggregate).alias("value"))
    if has_metric:
        per_month = seen.where("value is not null")
    else:
        # the spine comes from the few monthly rows, not from another pass over the table
        spine = (seen.agg(F.min("month").alias("first"), F.max("month").alias("last"))
                 .where("first is not null")
                 .select(F.explode(F.sequence("first", "last", F.expr("interval 1 month"))).alias("month")))
        per_month = spine.join(seen, "month", "left").select("month", F.coalesce("value", F.lit(0.0)).alias("value"))
    return per_month.orderBy("month").select(dates.month_label(F.col("month")).alias("x"), "value")


def by_dimension(df: DataFrame, dim: str, value_field: str | None, aggregate: str) -> DataFrame:
    """``(x, value)`` per value of ``dim``. Null is a group only when rows are counted."""
    if is_metric(df, value_field, aggregate):
        return (df.select(col(dim).alias("x"), metric(df, value_field).alias("v")).where("x is not null")
                .groupBy("x").agg(aggregate_of(aggregate, F.col("v")).alias("value")))
    return df.select(col(dim).alias("x")).groupBy("x").agg(F.count(F.lit(1)).cast("double").alias("value"))


def _largest_first():
    return F.desc_nulls_last("value"), F.asc_nulls_last("x")


def top(df: DataFrame, dim: str, value_field: str | None = None, aggregate: str = "count",
        limit: int = 10) -> DataFrame:
    """The ``limit`` largest groups, ties by label."""
    return largest(by_dimension(df, dim, value_field, aggregate), limit)


def largest(grouped: DataFrame, limit: int) -> DataFrame:
    return grouped.orderBy(*_largest_first()).limit(limit).select(F.col("x").cast("string").alias("x"), "value")


def parts(df: DataFrame, category: str, value_field: str | None = None, aggregate: str = "count",
          limit: int = 8) -> DataFrame:
    """Groups for a share chart: past ``limit`` groups, all but the first ``limit - 1`` are summed as one.

    Only the ``limit - 1`` head rows are broadcast; the tail is summed by an ordinary aggregate.
    """
    return shares(by_dimension(df, category, value_field, aggregate), limit)


def shares(grouped: DataFrame, limit: int) -> DataFrame:
    """``parts`` from ``(x, value)`` of every group."""
    if not limit:
        return grouped.orderBy(*_largest_first()).select(F.col("x").cast("string").alias("x"), "value")
    head = grouped.orderBy(*_largest_first()).limit(limit - 1)
    named = head.select(F.col("x").alias("head_x"))
    rest = (grouped.join(F.broadcast(named), F.col("x").eqNullSafe(F.col("head_x")), "left_anti")
            .agg(F.count(F.lit(1)).alias("groups"), F.min(F.col("x").cast("string")).alias("only"),
                 F.coalesce(F.sum("value"), F.lit(0.0)).alias("value"))
            .where("groups > 0")
            .select(F.when(F.col("groups") > 1, F.lit(vocab.REST_LABEL)).otherwise(F.col("only")).alias("x"), "value"))
    return head.select(F.col("x").cast("string").alias("x"), "value").unionByName(rest)


def histogram(df: DataFrame, field: str, bins: int = 20) -> DataFrame:
    """``(bin, low, high, n)`` over equal-width bins between the smallest and largest value, empty bins too."""
    value = plain_value(df, field)
    data = df.select(value.alias("v")).where("v is not null")
    ends = data.agg(F.min("v").alias("low"), F.max("v").alias("high")).first()
    if ends["low"] is None:
        return df.sparkSession.createDataFrame([], "bin long, low double, high double, n long")
    counted = data.groupBy(bin_of(F.col("v"), ends["low"], ends["high"], bins).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return all_bins(counted, ends["low"], ends["high"], bins)


def plain_value(df: DataFrame, field: str) -> Column:
    return numbers.as_number(col(field), df.schema[field].dataType, "plain")


def bin_of(value: Column, low: float, high: float, bins: int) -> Column:
    width = (high - low) / bins
    place = F.floor((value - low) / width) if width > 0 else F.lit(0)
    return F.when(value.isNotNull(), F.least(place, F.lit(bins - 1)).cast("long"))


def all_bins(counted: DataFrame, low: float, high: float, bins: int) -> DataFrame:
    """``histogram`` from ``(bin, n)`` of the bins that occur."""
    width = (high - low) / bins
    spine = counted.sparkSession.range(bins if width > 0 else 1).withColumnRenamed("id", "bin")
    return (spine.join(counted, "bin", "left").orderBy("bin")
            .select("bin", (F.lit(low) + F.col("bin") * width).alias("low"),
                    (F.lit(low) + (F.col("bin") + 1) * width).alias("high"),
                    F.coalesce("n", F.lit(0)).alias("n")))


def heatmap(df: DataFrame, dim_x: str, dim_y: str, value_field: str | None = None, aggregate: str = "count",
            x_month: bool = False, grid: int | None = None) -> DataFrame:
    """``(x, y, value)`` per pair of labels that some row has; a pair that is absent stands for zero.

    ``grid`` asks for all pairs, made from the grouped result, and is the most labels an axis may have then.
    """
    x = dates.month_label(tolerant_date(df, dim_x)) if x_month else col(dim_x).cast("string")
    y = col(dim_y).cast("string")
    if is_metric(df, value_field, aggregate):
        data = df.select(x.alias("x"), y.alias("y"), metric(df, value_field).alias("v"))
        data = data.where("x is not null and y is not null")
        if aggregate == "sum":
            cell = F.sum("v")
        else:
            data, cell = data.where("v is not null"), F.avg("v")
    else:
        data = df.select(x.alias("x"), y.alias("y")).where("x is not null and y is not null")
        cell = F.count(F.lit(1))
    cells = data.groupBy("y", "x").agg(F.coalesce(cell.cast("double"), F.lit(0.0)).alias("value"))
    return _full_grid(cells, grid) if grid else cells.select("x", "y", "value")


def _full_grid(cells: DataFrame, limit: int) -> DataFrame:
    """All pairs of the labels in ``cells``; more than ``limit`` labels on an axis are an error."""
    xs, ys = (cells.select(axis).distinct().limit(limit + 1) for axis in ("x", "y"))
    labels = [r["x"] for r in xs.collect()]
    if max(len(labels), ys.count()) > limit:
        raise ValueError(f"more than {limit} labels on an axis of a full heatmap")
    pairs = ys.select("y", F.explode(F.lit(labels) if labels else F.array().cast("array<string>")).alias("x"))
    return pairs.join(cells, ["x", "y"], "left").select("x", "y", F.coalesce("value", F.lit(0.0)).alias("value"))


def null_meta(df: DataFrame) -> DataFrame:
    """The table that charts of missing values are drawn from."""
    return null_percent(df).toDF(vocab.COLUMN_FIELD, vocab.NULL_PCT_FIELD)


def inline_rows(spark, rows, x_key: str = "col", y_key: str = "nulos") -> DataFrame:
    """Bars given as literal rows in the chart itself."""
    data = [(str(r.get(x_key, "")), float(r.get(y_key, 0))) for r in rows]
    return spark.createDataFrame(data, "x string, value double")


# ---- chart specs ------------------------------------------------------------------------------

def _channel(chart: dict, name: str) -> dict:
    return (chart.get("encoding") or {}).get(name) or {}


def chart_fields(chart: dict) -> list[str]:
    """Fields a chart names in its encoding, meta fields included."""
    found = [_channel(chart, k).get("field") for k in ("x", "y", "category", "value")]
    return [f for f in found if isinstance(f, str) and f]


def _aggregate(channel: dict, default: str | None = None) -> str:
    """The aggregate a channel names; without one, the mean of its field, or a count where it has none."""
    return (channel.get("aggregate") or default or ("mean" if channel.get("field") else "count")).lower()


def _line(df, chart):
    x, y = _channel(chart, "x"), _channel(chart, "y")
    if (x.get("timeUnit") or "").lower() in ("month", "ms") and x.get("field") in df.columns:
        return by_month(df, x["field"], y.get("field"), _aggregate(y))


def _bar(df, chart):
    x, y = _channel(chart, "x"), _channel(chart, "y")
    if x.get("field") in df.columns:
        return top(df, x["field"], y.get("field"), _aggregate(y), int(chart.get("limit", 10)))


def _pie(df, chart):
    category, value = _channel(chart, "category"), _channel(chart, "value")
    if category.get("field") in df.columns:
        return parts(df, category["field"], value.get("field"), _aggregate(value), int(chart.get("limit", 8)))


def _histogram(df, chart):
    field = _channel(chart, "x").get("field")
    if field in df.columns:
        bars = histogram(df, field, int(chart.get("bins", 20)))
        return bars.select(F.col("bin").cast("string").alias("x"), "low", "high", F.col("n").alias("value"))


def _heatmap(df, chart):
    x, y, value = (_channel(chart, k) for k in ("x", "y", "value"))
    if x.get("field") in df.columns and y.get("field") in df.columns:
        months = (x.get("timeUnit") or "").lower() in ("month", "ms")
        return heatmap(df, x["field"], y["field"], value.get("field"), _aggregate(value, "sum"), months, chart.get("grid"))


BUILDERS = {"line": _line, "bar": _bar, "pie": _pie, "histogram": _histogram, "heatmap": _heatmap}


def as_chart(data: DataFrame, chart_id: str) -> DataFrame:
    have = set(data.columns)
    given = {"chart_id": F.lit(chart_id)}
    return data.select(*[
        (given.get(n) if n in given else F.col(n) if n in have else F.lit(None)).cast(t).alias(n)
        for n, t in (field.split() for field in CHART_SCHEMA.split(", "))
    ])


def about_nulls(chart: dict) -> bool:
    return bool({vocab.COLUMN_FIELD, vocab.NULL_PCT_FIELD} & set(chart_fields(chart))) and chart.get("type") != "heatmap"


def run_chart(df: DataFrame, chart: dict, meta: DataFrame | None = None) -> DataFrame:
    """Data of one chart spec in the common shape; no rows for a chart that names missing columns.

    ``meta`` is the table of missing values, if it is known.
    """
    source = (meta if meta is not None else null_meta(df)) if about_nulls(chart) else df
    build = BUILDERS.get(chart.get("type"))
    if build:
        data = build(source, chart)
    elif chart.get("data_inline"):
        data = inline_rows(df.sparkSession, chart["data_inline"])
    else:
        data = None
    chart_id = str(chart.get("id", "?"))
    if data is None:
        return df.sparkSession.createDataFrame([], CHART_SCHEMA)
    return as_chart(data, chart_id)
