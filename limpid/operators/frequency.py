"""The value-frequency table: every value of every column with its count, in one shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from limpid.functions.text import strip
from limpid.operators.cells import FLOATS, WHOLES, cell_sql, kind_of, quoted, sql_text


BUCKETS = 64  # parts of a column that are ranked apart first
PUSHED_RANK = 1000  # Spark's default for rank filters before a shuffle


def melt(df: DataFrame, columns=None, order_by: str | None = None) -> DataFrame:
    """``(column, value[, pos])``: all columns as text, one row per cell."""
    columns = list(columns if columns is not None else df.columns)
    cells = ", ".join(f"{sql_text(c)}, string({cell_sql(df, c)})" for c in columns)
    keep = [f"{quoted(order_by)} as pos"] if order_by else []
    return df.selectExpr(f"stack({len(columns)}, {cells}) as (column, value)", *keep)


def value_counts(df: DataFrame, columns=None, order_by: str | None = None) -> DataFrame:
    """``(column, value, n[, first_pos])`` with null as a value.

    Partial aggregation turns a hot value into one row per task before the shuffle.
    """
    measures = [F.count(F.lit(1)).alias("n")]
    if order_by:
        measures.append(F.min("pos").alias("first_pos"))
    return melt(df, columns, order_by).groupBy("column", "value").agg(*measures)


def stripped(freq: DataFrame) -> DataFrame:
    """The same table over stripped values, nulls left out."""
    measures = [F.sum("n").alias("n")]
    if "first_pos" in freq.columns:
        measures.append(F.min("first_pos").alias("first_pos"))
    return (freq.where(F.col("value").isNotNull())
            .groupBy("column", strip(F.col("value")).alias("value")).agg(*measures))


def top_values(freq: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` most frequent values of each column, ties by value.

    Spark applies the rank filter before the shuffle too, so each task sends at most ``k`` rows per column, but only
    up to ``PUSHED_RANK``. For a larger ``k`` a first rank within hash buckets leaves ``BUCKETS * k`` rows at most, so
    no task sorts all values of a column.
    """
    best_first = F.col("n").desc(), F.col("value")
    if k > PUSHED_RANK:
        bucket = F.pmod(F.xxhash64("value"), F.lit(BUCKETS))
        freq = (freq.withColumn("rank", F.row_number().over(Window.partitionBy("column", bucket).orderBy(*best_first)))
                .where(F.col("rank") <= k))
    by_count = Window.partitionBy("column").orderBy(*best_first)
    return freq.withColumn("rank", F.row_number().over(by_count)).where(F.col("rank") <= k)


def first_values(freq: DataFrame, k: int = 5) -> DataFrame:
    """The first ``k`` distinct values of each column in row order."""
    by_position = Window.partitionBy("column").orderBy(F.col("first_pos"), F.col("value"))
    return freq.withColumn("rank", F.row_number().over(by_position)).where(F.col("rank") <= k)


def distinct_counts(freq: DataFrame) -> DataFrame:
    """``(column, uniques)``, nulls not counted."""
    return freq.groupBy("column").agg(F.count("value").alias("uniques"))


def duplicate_members(freq: DataFrame) -> DataFrame:
    """``(column, duplicates)``: rows whose value occurs more than once, nulls equal to each other."""
    return freq.groupBy("column").agg(
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("duplicates"))


def entropy(freq: DataFrame) -> DataFrame:
    """``(column, entropy)``: Shannon entropy in bits of the value shares, null as a value.

    Written as ``log2(N) - sum(n log2 n) / N`` so that one aggregate suffices.
    """
    n = F.col("n").cast("double")
    return freq.groupBy("column").agg(
        (F.log2(F.sum(n)) - F.sum(n * F.log2(n)) / F.sum(n)).alias("entropy"))


def modes(df: DataFrame, columns) -> dict:
    """Most frequent non-null value per column, the smallest on ties, in the column's own type.

    Text, whole numbers, fractions and decimals travel in separate key fields, so that each is compared as itself.
    """
    columns = list(columns)
    if not columns:
        return {}
    scale = max((df.schema[c].dataType.scale for c in columns if kind_of(df, c) == "decimal"), default=0)
    slots = ("text", "string"), ("whole", "long"), ("fraction", "double"), ("exact", f"decimal(38,{scale})")
    names = [slot for slot, _ in slots]
    cells = []
    for c in columns:
        kind = kind_of(df, c)
        mine = "whole" if kind in WHOLES else "fraction" if kind in FLOATS else "exact" if kind == "decimal" else "text"
        cells.append(sql_text(c))
        cells += [f"cast({cell_sql(df, c) if slot == mine else 'null'} as {kind})" for slot, kind in slots]
    counted = (df.selectExpr(f"stack({len(columns)}, {', '.join(cells)}) as (column, {', '.join(names)})")
               .where(" or ".join(f"{n} is not null" for n in names))
               .groupBy("column", *names).agg(F.count(F.lit(1)).alias("n")))
    best_first = Window.partitionBy("column").orderBy(F.col("n").desc(), *names)
    best = counted.withColumn("rank", F.row_number().over(best_first)).where("rank = 1").collect()
    found = {}
    for row in best:
        values = [row[n] for n in names]
        found[row["column"]] = next(v for v in values if v is not None)
    return found
