"""Mergeable sketches of distinct values: kept per file, day or the like, united later without a look at the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from limpid.operators.cells import cell_sql, col, sql_text

#: Binary logarithm of the registers of a sketch, and the relative error that an estimate stays within but for one case in 300.
LOG_REGISTERS = 14
ERROR = 3 * 1.04 / 2 ** (LOG_REGISTERS / 2)


def distinct_sketch(value: Column) -> Column:
    """Aggregate: the sketch of the non-null values, as text."""
    return F.hll_sketch_agg(value.cast("string"), F.lit(LOG_REGISTERS))


def distinct_sketches(df: DataFrame, columns, by=()) -> DataFrame:
    """``(*by, column, sketch)``: one row per column, or per column and value of ``by``. NaN is read as missing.

    A column without values has an empty sketch; no rows give none. ``by`` columns are not to be named ``column`` or ``value``.
    """
    cells = ", ".join(f"{sql_text(c)}, string({cell_sql(df, c)})" for c in columns)
    stacked = df.selectExpr(*[f"`{b}`" for b in by], f"stack({len(columns)}, {cells}) as (column, value)")
    return stacked.groupBy(*map(col, by), "column").agg(distinct_sketch(F.col("value")).alias("sketch"))


def united(sketches: DataFrame, by=()) -> DataFrame:
    """The sketches of all parts of a column as one, kept apart by ``by``."""
    return sketches.groupBy(*map(col, by), "column").agg(F.hll_union_agg("sketch").alias("sketch"))


def distinct_estimates(sketches: DataFrame) -> DataFrame:
    """The same rows with ``estimate``, the number of distinct values, in place of the sketch."""
    return sketches.withColumn("estimate", F.hll_sketch_estimate("sketch")).drop("sketch")
