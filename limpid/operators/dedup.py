"""Duplicate rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from limpid.operators.cells import col

POSITION = "_pos"


def keep_first(df: DataFrame, keys, order_by=None) -> DataFrame:
    """The first row of every key combination, nulls equal to each other.

    Rows are ordered by ``order_by``, else by the scan position when the table carries one, else by all
    columns. ``row_number() = 1`` is a rank filter, so each task drops all but its own first row per key
    before the shuffle and a hot key sends one row per task.
    """
    order = _order(df, order_by)
    by_key = Window.partitionBy(*map(col, keys)).orderBy(*map(col, order))
    return df.withColumn("_first", F.row_number().over(by_key)).where(F.col("_first") == 1).drop("_first")


def distinct_rows(df: DataFrame) -> DataFrame:
    """Whole-row duplicates removed; the smallest scan position survives."""
    if POSITION not in df.columns:
        return df.dropDuplicates()
    keys = [c for c in df.columns if c != POSITION]
    return df.groupBy(*map(col, keys)).agg(F.min(POSITION).alias(POSITION)).select(*map(col, df.columns))


def _order(df: DataFrame, order_by):
    if order_by:
        return [order_by] if isinstance(order_by, str) else list(order_by)
    return [POSITION] if POSITION in df.columns else df.columns
