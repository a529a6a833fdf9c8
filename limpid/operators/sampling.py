"""Samples of column values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from limpid.operators.cells import col, free_names
from limpid.operators.dedup import POSITION
from limpid.operators.frequency import melt


def sample_values(df: DataFrame, columns, k: int = 200, seed: int = 1, position: str | None = None) -> DataFrame:
    """``(column, value)``: ``k`` non-null values per column, or all of fewer, drawn at random.

    A draw is the MD5 of seed, column, ``position`` and value, so the same rows are drawn on any cluster and when a task runs again.
    ``position`` names a column that tells rows apart; without it that is ``_pos``, else a hash of all columns, with which
    equal rows are drawn together. Each task keeps its own ``k`` smallest draws per column, so no more than that is shuffled.
    """
    position = position or (POSITION if POSITION in df.columns else None)
    row, = free_names(df.columns, "row")
    given = col(position) if position else F.xxhash64(*map(col, df.columns))
    keyed = df.withColumn(row, given if position != POSITION else F.to_json(F.struct(given)))
    melted = melt(keyed, columns, row).where("value is not null")
    drawn = melted.withColumn("draw", F.md5(F.concat_ws("|", F.lit(str(seed)), "column", F.col("pos").cast("string"), "value")))
    rank = F.row_number().over(Window.partitionBy("column").orderBy("draw", "value"))
    return drawn.withColumn("rank", rank).where(F.col("rank") <= k).select("column", "value")
