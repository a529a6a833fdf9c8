"""Per-column measures of a table in one aggregation pass."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from limpid.operators.cells import FLOATS, cell, cell_sql, col, sql_text, sql_value
from limpid.operators.frequency import value_counts
from limpid.storage import materialize

# a measure turns the values of a column, and their type, into an aggregate; over a tally it gets the number of rows too
Measure = Callable[..., Column]
#: Types whose equal values look the same, so that one row can stand for all of them. Times are counted by their text.
TALLIED = (T.NumericType, T.BooleanType, T.DateType, T.TimestampNTZType, T.BinaryType)


class PerValue:
    """A measure in two steps: ``of`` a value and its type, and the ``total`` of that, the value and the number of rows.

    Over a tally the first step is a column, so its patterns are matched once a value, however often the second names it.
    """

    def __init__(self, of: Callable[[Column, T.DataType], Column], total: Callable[[Column, Column, Column | None], Column]):
        self.of, self.total = of, total

    def __call__(self, v: Column, kind: T.DataType, n: Column | None = None) -> Column:
        return self.total(self.of(v, kind), v, n)


class Tally:
    """The distinct values of every column with their numbers of rows: ``(ordinal, value, n)`` for each type."""

    def __init__(self, columns: list[str], parts: list[tuple[T.DataType, list[int], DataFrame]]):
        self.columns, self.parts = columns, parts

    def named(self, columns) -> "Tally":
        """The same values under other names, given in the same order."""
        return Tally(list(columns), self.parts)

    def values(self, name: str) -> DataFrame:
        """The values of one column under its name."""
        at = self.columns.index(name)
        return next(part.where(F.col("ordinal") == at).select(col("value").alias(name)) for _, members, part in self.parts if at in members)


def tally(df: DataFrame, columns=None, staged: bool = False) -> Tally:
    """What measures of values need of a table, from one shuffle: a value is looked at once, however often it occurs.

    Each task sends one row per distinct value of its own; values of types that cannot be compared stay one row each.
    ``staged`` writes the values once, for several uses. NaN is read as missing, and a negative zero is a value of its own.
    """
    columns = list(columns if columns is not None else df.columns)
    by_type: dict[T.DataType, list] = {}
    for ordinal, name in enumerate(columns):
        by_type.setdefault(df.schema[name].dataType, []).append((ordinal, name))
    parts = []
    for kind, members in by_type.items():
        cells = ", ".join(f"{i}, {cell_sql(df, c)}" for i, c in members)
        rows = df.selectExpr(f"stack({len(members)}, {cells}) as (ordinal, value)")
        if not _comparable(kind):
            rows = rows.withColumn("n", F.lit(1).cast("long"))
        elif kind.typeName() in FLOATS:  # grouping takes both zeros for one
            minus = (F.col("value") == 0) & (F.col("value").cast("string") == "-0.0")
            rows = rows.groupBy("ordinal", "value", minus.alias("minus")).agg(F.count(F.lit(1)).alias("n"))
            rows = rows.select("ordinal", F.when(F.col("minus"), -F.col("value")).otherwise(F.col("value")).alias("value"), "n")
        else:
            rows = rows.groupBy("ordinal", "value").agg(F.count(F.lit(1)).alias("n"))
        parts.append((kind, [i for i, _ in members], materialize(rows, "tally") if staged else rows))
    return Tally(columns, parts)


def _comparable(kind: T.DataType) -> bool:
    return kind in (T.StringType(), T.TimestampType()) or isinstance(kind, TALLIED)


def column_table(df: DataFrame | Tally, measures: dict[str, Measure], columns=None, constants=None) -> DataFrame:
    """One row ``(ordinal, column, *measures)`` per column of ``df``.

    Columns of one type are stacked into cells and aggregated by column name, so the size of the generated
    code depends on the measures and not on the width of the table. Each task sends one row per column to the
    shuffle. Every type is its own scan of just its columns, so a columnar source is read once in total.

    ``constants`` gives further cell fields, ``{field: {column: value}}``. NaN is read as missing. An empty
    table has no cells and so gives no rows. Of a tally, which takes no constants, each distinct value is measured once and
    counts as often as it occurs.
    """
    columns = list(columns if columns is not None else df.columns)
    constants = constants or {}
    if isinstance(df, Tally):
        if constants:
            raise ValueError("a tally has no further cell fields")
        name = F.element_at(F.array(*map(F.lit, df.columns)), F.col("ordinal") + 1)
        v, n, parts = F.col("value"), F.col("n"), []
        for kind, part in _parts_of(df, columns):
            found = part.withColumns({f"of_{key}": m.of(v, kind) for key, m in measures.items() if isinstance(m, PerValue)})
            totals = [(m.total(F.col(f"of_{key}"), v, n) if isinstance(m, PerValue) else m(v, kind, n)).alias(key) for key, m in measures.items()]
            parts.append(found.groupBy("ordinal").agg(*totals).select("ordinal", name.alias("column"), *measures))
        return reduce(DataFrame.unionByName, parts)
    by_type: dict[T.DataType, list] = {}
    for ordinal, name in enumerate(columns):
        by_type.setdefault(df.schema[name].dataType, []).append((ordinal, name))
    fields = ", ".join(["ordinal", "column", "value", *constants])
    parts = []
    for kind, members in by_type.items():
        cells = ", ".join(
            ", ".join([str(i), sql_text(c), cell_sql(df, c), *(sql_value(v.get(c)) for v in constants.values())])
            for i, c in members)
        stacked = df.selectExpr(f"stack({len(members)}, {cells}) as ({fields})")
        parts.append(stacked.groupBy("ordinal", "column").agg(
            *[measure(F.col("value"), kind).alias(key) for key, measure in measures.items()]))
    return reduce(DataFrame.unionByName, parts)


def _parts_of(tallied: Tally, columns) -> list[tuple[T.DataType, DataFrame]]:
    """The tables of a tally that hold these columns, without the others."""
    wanted = {tallied.columns.index(c) for c in columns}
    return [(kind, part if wanted.issuperset(members) else part.where(F.col("ordinal").isin([i for i in members if i in wanted])))
            for kind, members, part in tallied.parts if wanted.intersection(members)]


def column_dict(df: DataFrame | Tally, measures: dict[str, Measure], columns=None, constants=None) -> dict[str, dict]:
    """``column_table`` as a driver dict: one small entry per column, counts zero over an empty table."""
    columns = list(columns if columns is not None else df.columns)
    if not columns:
        return {}
    table = column_table(df, measures, columns, constants)
    nothing = {f.name: 0 if isinstance(f.dataType, T.LongType) else None for f in table.schema}
    found = {row["column"]: row.asDict() for row in table.collect()}
    return {c: found.get(c, {**nothing, "column": c}) for c in columns}


def counted(v: Column, n: Column | None = None) -> Column:
    """Rows whose value is there, each counted ``n`` times."""
    return F.count(v) if n is None else F.coalesce(F.sum(F.when(v.isNotNull(), n)), F.lit(0).cast("long"))


def rows(v: Column, kind: T.DataType, n: Column | None = None) -> Column:
    return F.count(F.lit(1)) if n is None else F.sum(n)


def non_null(v: Column, kind: T.DataType, n: Column | None = None) -> Column:
    return counted(v, n)


def estimate(v: Column, kind: T.DataType, n: Column | None = None) -> Column:
    return F.approx_count_distinct(v)


def mean(v: Column, n: Column | None = None) -> Column:
    """Mean of whole numbers, null ones left out, each counted ``n`` times."""
    return F.avg(v) if n is None else F.sum(v * n) / F.sum(F.when(v.isNotNull(), n))


def share(flag: Column, n: Column | None = None) -> Column:
    """Share of rows where ``flag`` holds, null rows left out of both sides."""
    return F.avg(flag.cast("double")) if n is None else mean(flag.cast("int"), n)


def share_of(predicate: Callable[[Column, T.DataType], Column]) -> PerValue:
    return PerValue(predicate, lambda found, v, n: share(found, n))


def is_missing(df: DataFrame, name: str) -> Column:
    return cell(df, name).isNull()


def null_percent(df: DataFrame, columns=None) -> DataFrame:
    """``(column, null_pct)``: percent of missing values, 0 to 100."""
    return column_table(df, {"null_pct": lambda v, kind: share(v.isNull()) * 100}, columns).drop("ordinal")


def basic_stats(df: DataFrame, columns=None) -> dict[str, dict]:
    """Rows, non-nulls and estimated distinct values per column."""
    return column_dict(df, {"rows": rows, "non_null": non_null, "estimate": estimate}, columns)


def coverage(stats: dict) -> float:
    return stats["non_null"] / stats["rows"] if stats["rows"] else 0.0


def cardinalities(df: DataFrame | Tally, columns=None) -> dict[str, int]:
    """Distinct non-null values per column, exact."""
    columns = list(columns if columns is not None else df.columns)
    if not columns:
        return {}
    if isinstance(df, Tally):
        found = {}
        for kind, part in _parts_of(df, columns):
            texts = part.select("ordinal", F.col("value").cast("string").alias("value")).distinct()
            by_value = kind == T.StringType() or isinstance(kind, TALLIED)
            found |= dict((part if by_value else texts).groupBy("ordinal").agg(F.count("value")).collect())
        return {c: found.get(df.columns.index(c), 0) for c in columns}
    counted = value_counts(df, columns).where(F.col("value").isNotNull()).groupBy("column").count()
    return {**{c: 0 for c in columns}, **{r["column"]: r["count"] for r in counted.collect()}}


def screened_cardinalities(df: DataFrame | Tally, columns=None, low: int = 50, near_unique: float = 0.5, stats=None) -> dict[str, int]:
    """Distinct non-null values per column, for rules that only compare: exact wherever a small-domain or near-unique
    rule looks, elsewhere an estimate that lies on the same side of both limits.

    The estimate is a screen. With at most ``low`` distinct values it cannot exceed ``low`` plus rounding:
    no more than ``low`` registers are set, which is the sketch's linear-counting range. So a column whose
    estimate is well above ``low`` has more than ``low`` values, and is counted exactly only when it comes
    near the row count.
    """
    stats = stats or basic_stats(df, columns)
    exact = [
        c for c, s in stats.items()
        if s["estimate"] <= low * 1.25 + 2 or s["estimate"] >= near_unique * s["rows"]
    ]
    return {**{c: s["estimate"] for c, s in stats.items()}, **cardinalities(df, exact)}
