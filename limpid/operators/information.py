"""Mutual information of columns of classes and one column of numbers, by nearest neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from limpid.functions import numbers
from limpid.operators import ranking
from limpid.operators.cells import cell
from limpid.storage import materialize

NEIGHBOURS = 3


def digamma(n: Column) -> Column:
    """Logarithmic derivative of the gamma function for n >= 1: its series at n + 6, led back by the recurrence."""
    z = n + 6.0
    series = F.log(z) - 1 / (2 * z) - 1 / (12 * z**2) + 1 / (120 * z**4) - 1 / (252 * z**6)
    return series - sum((1.0 / (n + float(i)) for i in range(1, 6)), 1.0 / n)


def _values(df: DataFrame, dims, metric: str) -> DataFrame:
    """``(column, class, x, n)``: how often a number occurs in a class. Missing and infinite numbers are left out."""
    x = numbers.as_number(cell(df, metric), df.schema[metric].dataType, "plain").cast("double")
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), cell(df, c).cast("string").alias("class")) for c in dims])
    found = df.select((x + F.lit(0.0)).alias("x"), F.inline(pairs)).where(F.abs("x") < float("inf"))
    return found.groupBy("column", "class", "x").agg(F.count(F.lit(1)).alias("n"))


def _with_class_sizes(rows: DataFrame) -> DataFrame:
    """``rows``, which have ``block``, with the number of all rows of their class as ``size``; classes of one row go.

    Sizes are brought to the blocks of a class first and from there to the rows, so the rows of a large class never share a key.
    """
    parts = rows.groupBy("block", "column", "class").agg(F.sum("n").alias("size"))
    whole = parts.groupBy("column", "class").agg(F.sum("size").alias("size")).where("size > 1").alias("w")
    parts = parts.alias("p")
    sized = parts.join(whole, (F.col("p.column") == F.col("w.column")) & F.col("p.class").eqNullSafe(F.col("w.class"))) \
        .select("p.block", "p.column", "p.class", "w.size").alias("s")
    rows = rows.alias("r")
    met = (F.col("r.block") == F.col("s.block")) & (F.col("r.column") == F.col("s.column")) & F.col("r.class").eqNullSafe(F.col("s.class"))
    return rows.join(sized, met).select("r.*", "s.size")


def _with_radius(placed: DataFrame, k: int) -> DataFrame:
    """Every value with ``radius``, the distance to the nearest row but ``near`` - 1 of its class, itself left out.

    ``placed`` is in order of class and number; blocks of places also get the ``k`` rows on either side of them.
    """
    at = F.col("place") % ranking.BLOCK
    block = F.floor(F.col("place") / ranking.BLOCK)
    beside = F.array_compact(F.array(block, F.when(at < k, block - 1), F.when(at >= ranking.BLOCK - k, block + 1)))
    dealt = placed.select("*", block.alias("block"), F.explode(beside).alias("seen_in"))
    order = Window.partitionBy("seen_in").orderBy("place")
    this = F.struct("column", "class", "x", "n")
    shifted = {f"at{i}": F.lag(this, i).over(order) for i in [*range(-k, 0), *range(1, k + 1)]}
    seen = dealt.withColumns(shifted).where("seen_in = block")
    distances = [F.array_repeat(F.lit(0.0), F.least(F.col("n") - 1, F.lit(k)).cast("int"))]
    for name in shifted:
        same = (F.col(f"{name}.column") == F.col("column")) & F.col(f"{name}.class").eqNullSafe(F.col("class"))
        repeated = F.array_repeat(F.abs(F.col(f"{name}.x") - F.col("x")), F.least(F.col(f"{name}.n"), F.lit(k)).cast("int"))
        distances.append(F.when(same, repeated).otherwise(F.array().cast("array<double>")))
    known = seen.withColumn("near_by", F.array_sort(F.concat(*distances)))
    sized = _with_class_sizes(known.select("column", "class", "x", "n", "place", "block", "near_by"))
    near = F.least(F.col("size") - 1, F.lit(k)).cast("int")
    return sized.select("column", "x", "n", "place", "size", near.alias("near"), F.element_at("near_by", near).alias("radius"))


def _with_neighbours(rows: DataFrame) -> DataFrame:
    """``(column, place, n, size, near, within)``: rows of all classes that are closer than the radius, itself included.

    The ends of every interval and the numbers themselves are put in one order; a running count of the rows tells how many
    lie before either end, and the difference of the two is what lies between. With radius 0 it counts equal numbers.
    """
    ends = F.array(F.struct((F.col("x") + F.col("radius")).alias("end"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("rows"), F.lit(1).alias("sign")),
                   F.struct(F.col("x").alias("end"), F.lit(1).alias("kind"), F.col("n").alias("rows"), F.lit(0).alias("sign")),
                   F.struct((F.col("x") - F.col("radius")).alias("end"), F.lit(2).alias("kind"), F.lit(0).cast("long").alias("rows"), F.lit(-1).alias("sign")))
    events = materialize(rows.select("column", "place", "n", "size", "near", F.inline(ends)), "ends")
    summed = ranking.running_sums(events, [F.col("column"), F.col("end"), F.col("kind")], "rows", "before")
    between = F.abs(F.sum(F.col("sign") * F.col("before")))
    return (summed.where("sign <> 0").groupBy("column", "place")
            .agg(F.max("n").alias("n"), F.max("size").alias("size"), F.max("near").alias("near"), between.alias("between"))
            .withColumn("within", F.greatest("between", "n")).drop("between"))


def mutual_information(df: DataFrame, dims, metric: str, neighbours: int = NEIGHBOURS) -> DataFrame:
    """``(column, rows, information)``: mutual information, in nats, of each column of classes and a column of numbers.

    The estimate of Ross (2014): ``psi(N) + mean psi(k) - mean psi(N_c) - mean psi(m)``, where ``m`` counts the rows of any class
    that are closer than the ``k``-th neighbour of the same class, or equal; below zero it is zero. A class of fewer than ``k`` + 1
    rows takes what it has, and classes of a single row are left out, as are rows without a finite number. Null is a class.
    Ends of intervals are sums in double precision. A column with no class of two rows has zero rows and zero information.

    Equal numbers of a class are one row from the start. Neighbours come from blocks of a global order with a margin of ``neighbours`` rows,
    counts from running sums over a second order; nothing is paired, and no task holds a class or a column.
    """
    if not 1 <= neighbours < ranking.BLOCK:
        raise ValueError(f"neighbours must be from 1 to {ranking.BLOCK - 1}")
    spark = df.sparkSession
    values = materialize(_values(df, dims, metric), "values")
    placed = ranking.with_row_number(values, [F.col("column"), F.col("class"), F.col("x")], "place")
    counted = _with_neighbours(_with_radius(placed, neighbours))
    n = F.col("n")
    terms = digamma(F.col("near")) - digamma(F.col("size")) - digamma(F.col("within"))
    found = counted.groupBy("column").agg(F.sum(n).alias("rows"), (F.sum(n * terms) / F.sum(n)).alias("mean"))
    found = found.select("column", "rows", F.greatest(F.lit(0.0), digamma(F.col("rows")) + F.col("mean")).alias("information"))
    listed = spark.range(1).select(F.explode(F.array(*map(F.lit, dims))).alias("column"))
    return listed.join(found, "column", "left").fillna(0, ["rows"]).fillna(0.0, ["information"])
