"""Row numbers over a whole table, without a window that one task would have to sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from limpid.operators.cells import col, free_names
from limpid.storage import materialize

#: Rows of one range; with more rows there are more ranges, not longer ones.
RANGE_ROWS = 2_000_000
#: Places that are summed together; two levels reach ``BLOCK`` squared places.
BLOCK = 4096
ROW_BITS = 33


def row_in_task() -> Column:
    """Number of the row in its task, from 0; Spark keeps it in the low bits of its row ids."""
    return F.monotonically_increasing_id().bitwiseAND((1 << ROW_BITS) - 1)


def sums_before(counts: DataFrame, place: str, value: str, within: list[str] = (), name: str = "before") -> DataFrame:
    """``counts`` with the sum of ``value`` over the rows of smaller ``place`` (distinct whole numbers from 0).

    ``within`` keeps groups apart, nulls being a group. Sums are taken in a tree: inside blocks of ``BLOCK`` places, then
    over one row per block, so no task sorts all places of a group.
    """
    block, low, size = free_names(counts.columns, "block", "low", "size")
    keys = [col(c) for c in within]
    inside = Window.partitionBy(*keys, col(block)).orderBy(col(place)).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(*keys).orderBy(col(block)).rowsBetween(Window.unboundedPreceding, -1)
    cut = counts.withColumn(block, F.floor(col(place) / BLOCK))
    blocks = cut.groupBy(*keys, col(block)).agg(F.sum(col(value)).alias(size))
    blocks = blocks.withColumn(low, F.coalesce(F.sum(col(size)).over(across), F.lit(0))).drop(size)
    a, b = cut.withColumn(name, F.coalesce(F.sum(col(value)).over(inside), F.lit(0))).alias("a"), blocks.alias("b")
    met = F.lit(True)
    for c in [*within, block]:
        met &= F.col(f"a.`{c}`").eqNullSafe(F.col(f"b.`{c}`"))
    kept = [F.col(f"a.`{c}`") for c in counts.columns if c != name]
    return a.join(b, met).select(*kept, (F.col(f"a.`{name}`") + F.col(f"b.`{low}`")).alias(name))


def with_row_number(df: DataFrame, order: list[Column], name: str = "row") -> DataFrame:
    """``df``, staged, with the place of every row in ``order``, from 0 and without gaps.

    Rows are dealt by range, so equal ones may be told apart by their place in ``df`` only; rows are counted per range and
    the counts of earlier ranges are added. ``df`` is read three times (count, range limits, rows): hand in a staged table
    of few columns. An empty table stays empty; a column of that name is replaced.
    """
    tie, part, at, before = free_names([*df.columns, name], "tie", "part", "at", "before")
    spark = df.sparkSession
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // RANGE_ROWS))
    keyed = df.withColumn(tie, F.monotonically_increasing_id())
    dealt = keyed.repartitionByRange(ranges, *order, F.col(tie)).sortWithinPartitions(*order, F.col(tie)).drop(tie)
    staged = materialize(dealt.withColumns({part: F.spark_partition_id(), at: row_in_task()}), "ranges")
    sizes = staged.groupBy(part).agg(F.count(F.lit(1)).alias("n"))
    # one row for every RANGE_ROWS rows of the table, or per shuffle partition
    offsets = F.broadcast(sums_before(sizes, part, "n", name=before).drop("n"))
    kept = [col(c) for c in df.columns if c != name]
    return staged.join(offsets, part).select(*kept, (F.col(before) + F.col(at)).alias(name))


def running_sums(df: DataFrame, order: list[Column], value: str, name: str = "sum") -> DataFrame:
    """``df``, staged, with the sum of ``value``, a column without nulls, over all rows up to and with its own in ``order``.

    Sums run inside blocks of ``BLOCK`` rows, and what earlier blocks hold is added. Equal rows may come in any order.
    """
    place, block, size, before = free_names([*df.columns, name], "place", "block", "size", "before")
    placed = with_row_number(df, order, place).withColumn(block, F.floor(col(place) / BLOCK))
    inside = Window.partitionBy(col(block)).orderBy(col(place)).rowsBetween(Window.unboundedPreceding, 0)
    earlier = sums_before(placed.groupBy(block).agg(F.sum(col(value)).alias(size)), block, size, name=before).drop(size)
    kept = [col(c) for c in df.columns if c != name]
    summed = placed.withColumn(size, F.sum(col(value)).over(inside))
    return summed.join(earlier, block).select(*kept, (col(size) + col(before)).alias(name))
