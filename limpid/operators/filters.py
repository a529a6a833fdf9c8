"""Dashboard filters: what a filter can offer, and a table with filters applied."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from limpid.functions import dates
from limpid.operators.clean import tolerant_date
from limpid.operators.cells import col
from limpid.operators.frequency import top_values, value_counts

DOMAIN_SCHEMA = "field string, type string, low string, high string, value string, n long, rank int"


def filter_domain(df: DataFrame, filters: list[dict]) -> DataFrame:
    """``(field, type, low, high, value, n, rank)``: the range of each date filter, the most frequent values
    of each categorical filter up to its ``max_values``."""
    known = [f for f in filters if f.get("field") in df.columns]
    ranges = [f["field"] for f in known if f.get("type") == "date_range"]
    choices = {f["field"]: int(f.get("max_values", 50)) for f in known if f.get("type") == "categorical"}
    parts = []
    if ranges:
        days = [tolerant_date(df, c) for c in ranges]
        ends = df.agg(*[fn(day).alias(f"{tag}{i}") for i, day in enumerate(days) for tag, fn in (("a", F.min), ("b", F.max))])
        rows = [F.struct(F.lit(c).alias("field"), F.lit("date_range").alias("type"),
                         dates.iso_text(F.col(f"a{i}")).alias("low"), dates.iso_text(F.col(f"b{i}")).alias("high"))
                for i, c in enumerate(ranges)]
        parts.append(ends.select(F.inline(F.array(*rows))).select(
            "*", F.lit(None).cast("string").alias("value"), F.lit(None).cast("long").alias("n"),
            F.lit(None).cast("int").alias("rank")))
    if choices:
        limit = reduce(lambda e, c: e.when(F.col("column") == c, choices[c]), list(choices)[1:],
                       F.when(F.col("column") == list(choices)[0], choices[list(choices)[0]]))
        freq = value_counts(df, list(choices)).where("value is not null")
        parts.append(top_values(freq, max(choices.values())).where(F.col("rank") <= limit).select(
            F.col("column").alias("field"), F.lit("categorical").alias("type"),
            F.lit(None).cast("string").alias("low"), F.lit(None).cast("string").alias("high"),
            "value", "n", F.col("rank").cast("int").alias("rank")))
    if not parts:
        return df.sparkSession.createDataFrame([], DOMAIN_SCHEMA)
    return reduce(DataFrame.unionByName, parts)


def apply_filters(df: DataFrame, chosen: dict) -> DataFrame:
    """Rows inside every chosen filter: ``{field: (low, high)}`` for dates, ``{field: [values]}`` for choices.

    On a date-typed column both become plain comparisons that reach the scan.
    """
    for field, pick in chosen.items():
        if isinstance(pick, tuple):
            kind = df.schema[field].dataType
            low, high = (F.lit(v).cast("date") for v in pick)
            if dates.is_temporal(kind):
                df = df.where((col(field) >= low.cast(kind)) & (col(field) < F.date_add(high, 1).cast(kind)))
            else:
                df = df.where(tolerant_date(df, field).between(low, high))
        else:
            df = df.where(col(field).isin(*pick))
    return df
