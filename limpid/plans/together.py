"""The data of several charts from one scan of the table.

Every row gives one cell to each chart: the chart's number, its axes as text and the value. One aggregate over the cells, as
grouping sets would be, adds them up per chart and axes; it is staged, and each chart is finished from its own few rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from limpid import vocab
from limpid.functions import dates
from limpid.operators import charts
from limpid.operators.cells import cell, col
from limpid.operators.clean import tolerant_date
from limpid.storage import materialize

NULLS = -1  # chart number of the cells about missing values
#: Text of these types is read back as the same value.
EXACT = (T.StringType, T.BooleanType, T.DateType, T.IntegralType, T.FloatType, T.DoubleType, T.DecimalType)


class Shared:
    """One chart that takes part: its cell, and its data from the cells added up."""

    def __init__(self, df: DataFrame, chart: dict, ends: dict[str, tuple[float, float] | None]):
        self.df, self.chart, self.kind = df, chart, chart.get("type")
        x, value = ("category", "value") if self.kind == "pie" else ("x", "value" if self.kind == "heatmap" else "y")
        self.x, self.y = charts._channel(chart, x).get("field"), charts._channel(chart, "y").get("field")
        channel = charts._channel(chart, value)
        self.aggregate = charts._aggregate(channel, "sum" if self.kind == "heatmap" else None)
        self.field = channel.get("field")
        self.has_metric = self.kind != "histogram" and charts.is_metric(df, self.field, self.aggregate)
        self.months = (charts._channel(chart, "x").get("timeUnit") or "").lower() in ("month", "ms")
        self.bins = int(chart.get("bins", 20))
        self.ends = ends.get(self.x) if self.kind == "histogram" else None

    @staticmethod
    def fits(df: DataFrame, chart: dict) -> bool:
        """Whether the chart can be drawn from cells: it names columns of the table whose text is exact, and asks for no grid."""
        kind = chart.get("type")
        if kind not in charts.BUILDERS or charts.about_nulls(chart):
            return False
        names = [charts._channel(chart, c).get("field") for c in {"pie": ["category"], "heatmap": ["x", "y"]}.get(kind, ["x"])]
        if not all(n in df.columns for n in names) or kind == "heatmap" and chart.get("grid"):
            return False
        by_month = (charts._channel(chart, "x").get("timeUnit") or "").lower() in ("month", "ms")
        return by_month if kind == "line" else kind in ("heatmap", "histogram") or isinstance(df.schema[names[0]].dataType, EXACT)

    def cell(self, number: int) -> Column:
        """Struct of chart number, axes as text and value; null where the chart leaves the row out."""
        df, y = self.df, F.lit(None).cast("string")
        keep = F.lit(True)
        if self.kind == "histogram":
            x = charts.bin_of(charts.plain_value(df, self.x), *(self.ends or (0.0, 0.0)), self.bins)
            keep = x.isNotNull()
        elif self.kind == "line":
            x = dates.month_start(tolerant_date(df, self.x))
            keep = x.isNotNull()
        elif self.kind == "heatmap":
            x = dates.month_label(tolerant_date(df, self.x)) if self.months else col(self.x)
            y = col(self.y).cast("string")
            keep = x.isNotNull() & y.isNotNull()
        else:
            x = col(self.x)
            keep = x.isNotNull() if self.has_metric else keep
        v = charts.metric(df, self.field) if self.has_metric else F.lit(None).cast("double")
        return F.when(keep, F.struct(F.lit(number).alias("chart"), x.cast("string").alias("x"), y.alias("y"), v.cast("double").alias("v")))

    def data(self, cells: DataFrame) -> DataFrame:
        """The chart's rows from the cells of its number."""
        if self.kind == "histogram":
            if not self.ends:
                return charts.as_chart(self.df.sparkSession.createDataFrame([], "x string, low double, high double, value double"), self._id)
            bars = charts.all_bins(cells.select(F.col("x").cast("long").alias("bin"), F.col("rows").alias("n")), *self.ends, self.bins)
            return charts.as_chart(bars.select(F.col("bin").cast("string").alias("x"), "low", "high", F.col("n").alias("value")), self._id)
        value = charts.from_grouped(self.has_metric, self.aggregate)
        if self.kind == "line":
            found = charts.months(cells.withColumn("month", F.col("x").cast("date")), self.has_metric, self.aggregate)
        elif self.kind == "heatmap":
            dropped = self.has_metric and self.aggregate != "sum"
            found = (cells.where("values > 0") if dropped else cells).select("x", "y", F.coalesce(value, F.lit(0.0)).alias("value"))
        else:
            added = F.coalesce(value, F.lit(0.0)) if self.has_metric and self.aggregate == "sum" else value
            grouped = cells.select(F.col("x").cast(self.df.schema[self.x].dataType).alias("x"), added.alias("value"))
            limit = int(self.chart.get("limit", 8 if self.kind == "pie" else 10))
            found = charts.shares(grouped, limit) if self.kind == "pie" else charts.largest(grouped, limit)
        return charts.as_chart(found, self._id)

    @property
    def _id(self) -> str:
        return str(self.chart.get("id", "?"))


def histogram_ends(df: DataFrame, chosen: list[dict]) -> dict[str, tuple[float, float] | None]:
    """Smallest and largest value of the fields of all histograms, from one aggregate."""
    fields = list(dict.fromkeys(charts._channel(c, "x").get("field") for c in chosen if c.get("type") == "histogram"))
    if not fields:
        return {}
    found = df.agg(*[a(charts.plain_value(df, f)).alias(f"{n}{i}") for i, f in enumerate(fields) for n, a in (("low", F.min), ("high", F.max))]).first()
    return {f: None if found[f"low{i}"] is None else (found[f"low{i}"], found[f"high{i}"]) for i, f in enumerate(fields)}


def charts_together(df: DataFrame, chosen: list[dict]) -> DataFrame:
    """Rows of all charts in the common shape, in the order of the charts.

    The table is read once, and once before for the ends of histograms if there are any. Charts that cannot be made from cells
    (a line without months, a full grid, columns whose text is not exact) are run each by itself.
    """
    shared = {i: Shared(df, c, {}) for i, c in enumerate(chosen) if Shared.fits(df, c)}
    ends = histogram_ends(df, [s.chart for s in shared.values()])
    shared = {i: Shared(df, s.chart, ends) for i, s in shared.items()}
    each = [s.cell(i) for i, s in shared.items() if s.kind != "histogram" or s.ends]
    if any(charts.about_nulls(c) for c in chosen):
        each += [F.struct(F.lit(NULLS).alias("chart"), F.lit(c).alias("x"), F.lit(None).cast("string").alias("y"),
                          cell(df, c).isNull().cast("double").alias("v")) for c in df.columns]
    cells = None
    if each:
        rows = df.select(F.explode(F.array(*each)).alias("cell")).where("cell is not null").select("cell.*")
        cells = materialize(rows.groupBy("chart", "x", "y").agg(*[m(F.col("v")).alias(n) for n, m in charts.GROUPED.items()]), "cells")
    meta = None
    if cells is not None and any(charts.about_nulls(c) for c in chosen):
        meta = cells.where(F.col("chart") == NULLS).select(F.col("x").alias(vocab.COLUMN_FIELD), (F.col("total") / F.col("rows") * 100).alias(vocab.NULL_PCT_FIELD))
    done = []
    for i, chart in enumerate(chosen):
        if i in shared:
            done.append(shared[i].data(cells.where(F.col("chart") == i) if cells is not None else None))
        else:
            done.append(charts.run_chart(df, chart, meta))
    return reduce(DataFrame.unionByName, done)
