"""Column profile: types, roles, distinct and missing values, details by role, examples, alerts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from limpid import vocab
from limpid.functions import dates, numbers
from limpid.functions.text import example_text, percent_text, strip
from limpid.operators import frequency
from limpid.operators.cells import col
from limpid.operators.columns import column_table, is_missing, non_null, rows, share
from limpid.operators.quantiles import exact_quantiles
from limpid.storage import materialize

NO_VALUE = "—"
LOW_PARSE_SHARE = 0.7
QUANTILES = [0.05, 0.25, 0.75, 0.95]

NUMERIC_ROLES = (vocab.PROFILE_AMOUNT, vocab.NUMBER)
TEXT_ROLES = (vocab.TEXT, vocab.PROFILE_CATEGORY, vocab.ID)


def numeric_expr(df: DataFrame, name: str, role: str = vocab.NUMBER) -> Column:
    parse = "money" if role == vocab.PROFILE_AMOUNT else "plain"
    return numbers.as_number(col(name), df.schema[name].dataType, parse)


# ---- summaries by kind of column: one row per column ------------------------------------------

def numeric_summary(df: DataFrame, exprs: dict[str, Column]) -> DataFrame:
    """``(column, n, min, p5, q1, mean, q3, p95, max, std, outliers)`` with Tukey outlier counts.

    Quantiles are exact; the rest is one aggregate with the fences as constants.
    """
    cuts = exact_quantiles(df, exprs, QUANTILES)
    data = df.select(*[e.cast("double").alias(n) for n, e in exprs.items()])

    marks = ("at5", "at25", "at75", "at95")
    constants = {mark: {c: cuts[c][i] for c in exprs} for i, mark in enumerate(marks)}
    measures = {
        "n": non_null,
        "min": lambda v, kind: F.min(v),
        "p5": lambda v, kind: F.max("at5"),
        "q1": lambda v, kind: F.max("at25"),
        "mean": lambda v, kind: F.avg(v),
        "q3": lambda v, kind: F.max("at75"),
        "p95": lambda v, kind: F.max("at95"),
        "max": lambda v, kind: F.max(v),
        "std": lambda v, kind: F.stddev_samp(v),
        "outliers": lambda v, kind: F.count_if(numbers.outside_fences(v, F.col("at25"), F.col("at75"))),
    }
    return column_table(data, measures, list(exprs), constants).drop("ordinal")


def date_summary(freq: DataFrame) -> DataFrame:
    """``(column, rows, parsed, parsed_pct, min, max)`` over tolerant, day-first dates of a frequency table."""
    parsed = freq.withColumn("day", dates.parse_date(F.col("value"), dates.DAY_FIRST))
    seen = parsed.groupBy("column").agg(
        F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(F.col("day").isNotNull(), F.col("n"))), F.lit(0)).alias("parsed"),
        F.min("day").alias("first"), F.max("day").alias("last"))
    return seen.select("column", "rows", "parsed", percent_text(F.col("parsed"), F.col("rows")).alias("parsed_pct"),
                       dates.iso_text(F.col("first")).alias("min"), dates.iso_text(F.col("last")).alias("max"))


def bool_summary(freq: DataFrame) -> DataFrame:
    """``(column, true_count, false_count)`` by boolean word of a frequency table."""
    word = F.lower(strip(F.col("value")))

    def rows_with(words):
        return F.coalesce(F.sum(F.when(word.isin(*words), F.col("n"))), F.lit(0))

    return freq.groupBy("column").agg(rows_with(vocab.COUNT_TRUE).alias("true_count"),
                                      rows_with(vocab.COUNT_FALSE).alias("false_count"))


def top3_text(freq: DataFrame) -> DataFrame:
    """``(column, top3)`` as ``value(count)`` pairs, most frequent first."""
    best = frequency.top_values(freq, 3)
    pair = F.concat(F.col("value"), F.lit("("), F.col("n").cast("string"), F.lit(")"))
    ranked = F.array_sort(F.collect_list(F.struct("rank", pair.alias("pair"))))
    return best.groupBy("column").agg(F.array_join(ranked["pair"], ", ").alias("top3"))


def length_summary(freq: DataFrame) -> DataFrame:
    """``(column, min_len, median_len, max_len)`` of stripped values, from the counts per length."""
    lengths = freq.groupBy("column", F.length("value").alias("len")).agg(F.sum("n").alias("n"))
    return lengths.groupBy("column").agg(
        F.min("len").alias("min_len"),
        F.floor(F.percentile("len", 0.5, F.col("n"))).cast("int").alias("median_len"),
        F.max("len").alias("max_len"))


def text_summary(df: DataFrame, columns) -> DataFrame:
    """``(column, top3, min_len, median_len, max_len)`` of stripped text."""
    freq = frequency.stripped(frequency.value_counts(df, columns))
    return top3_text(freq).join(length_summary(freq), "column")


def examples(freq: DataFrame, k: int = 5) -> DataFrame:
    """``(column, examples)``: the first ``k`` distinct non-blank values, each cut to 80 characters."""
    first = frequency.first_values(freq.where("value <> ''"), k)
    ordered = F.array_sort(F.collect_list(F.struct("rank", example_text(F.col("value")).alias("value"))))
    return first.groupBy("column").agg(ordered["value"].alias("examples"))


# ---- the profile table ------------------------------------------------------------------------

PROFILE_SCHEMA = T.StructType([
    T.StructField("column", T.StringType()), T.StructField("dtype", T.StringType()),
    T.StructField("role", T.StringType()), T.StructField("uniques", T.LongType()),
    T.StructField("uniques_pct", T.StringType()), T.StructField("nulls", T.LongType()),
    T.StructField("nulls_pct", T.StringType()), T.StructField("details", T.StringType()),
    T.StructField("examples", T.ArrayType(T.StringType())), T.StructField("alerts", T.ArrayType(T.StringType())),
])


def _by_column(table: DataFrame) -> dict[str, dict]:
    return {r["column"]: r.asDict() for r in table.collect()}


def _percent(part: int, total: int) -> str:
    return f"{part / total * 100:.2f}%" if total > 0 else "0.00%"


def profile(df: DataFrame, roles: dict[str, str], order_by: str | None = None) -> DataFrame:
    """One row per column of ``df``, in column order; ``roles`` uses the profile role names.

    The table is read for one frequency table, which is written once and serves everything but the numeric
    details, and for the quantiles and moments of the numeric columns. Only per-column results reach the driver.
    """
    columns = [c for c in df.columns if c != order_by or order_by in roles]
    of = {kind: [c for c in columns if roles.get(c) in kinds] for kind, kinds in (
        ("numeric", NUMERIC_ROLES), ("date", (vocab.DATE,)), ("bool", (vocab.BOOL,)))}
    numeric = _by_column(numeric_summary(df, {c: numeric_expr(df, c, roles[c]) for c in of["numeric"]})) \
        if of["numeric"] else {}
    raw = materialize(frequency.value_counts(df, columns, order_by), "frequency")

    def only(kind):
        return raw.where(F.col("column").isin(*of[kind]))

    counts = _by_column(raw.groupBy("column").agg(
        F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("nulls"),
        F.count("value").alias("uniques"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("repeated")))
    dated = _by_column(date_summary(only("date"))) if of["date"] else {}
    bools = _by_column(bool_summary(only("bool"))) if of["bool"] else {}
    shown = materialize(frequency.stripped(raw), "values")
    tops = {r["column"]: r["top3"] for r in top3_text(shown).collect()}
    lengths = _by_column(length_summary(shown))
    if not order_by:
        shown = shown.withColumn("first_pos", -F.col("n"))
    samples = {r["column"]: r["examples"] for r in examples(shown).collect()}

    lines = []
    for c in columns:
        seen = counts.get(c, {"rows": 0, "nulls": 0, "uniques": 0, "repeated": 0})
        n, nulls, uniques, role = seen["rows"], seen["nulls"], seen["uniques"], roles.get(c, vocab.TEXT)
        details, alerts = NO_VALUE, []
        if n and nulls == n:
            alerts.append("100% nulos")
        if role == vocab.ID and seen["repeated"]:
            alerts.append(f"duplicados={seen['repeated']}")
        if role in NUMERIC_ROLES:
            s = numeric.get(c)
            if s and s["n"]:
                std = float("nan") if s["std"] is None else s["std"]
                details = (f"min={s['min']:g}, p5={s['p5']:g}, media={s['mean']:g}, p95={s['p95']:g}, "
                           f"max={s['max']:g}, std={std:g}, outliers_Tukey={s['outliers']}")
                if s["outliers"]:
                    alerts.append(f"outliers_Tukey={s['outliers']}")
        elif role == vocab.DATE:
            s = dated.get(c, {"parsed": 0})
            details = (f"parseadas={s['parsed_pct']}, min={s['min']}, max={s['max']}"
                       if s["parsed"] else "parseadas=0%")
            if s["parsed"] < LOW_PARSE_SHARE * max(1, n):
                alerts.append("baja_lectura_fechas")
        elif role == vocab.BOOL:
            pairs = [(bools.get(c, {}).get(f"{w}_count", 0), w) for w in ("true", "false")]
            details = " · ".join(f"{w}({k})" for k, w in sorted(pairs, key=lambda p: -p[0]) if k) or NO_VALUE
        elif c in tops:
            details = f"top3={tops[c]}"
            if role != vocab.MONEY:
                s = lengths[c]
                details += f" · len(min/med/max)={s['min_len']}/{s['median_len']}/{s['max_len']}"
        lines.append((c, df.schema[c].dataType.simpleString(), role, uniques,
                     _percent(uniques, n), nulls, _percent(nulls, n), details,
                     samples.get(c, []), alerts))
    return df.sparkSession.createDataFrame(lines, PROFILE_SCHEMA)


def profile_text(table: DataFrame) -> DataFrame:
    """The profile with its lists as text, ready for a delimited file."""
    return table.select("column", "dtype", "role",
                        F.format_string("%d (%s)", "uniques", "uniques_pct").alias("uniques"),
                        F.format_string("%d (%s)", "nulls", "nulls_pct").alias("nulls"),
                        "details", F.array_join("examples", ", ").alias("examples"),
                        F.array_join("alerts", ", ").alias("alerts"))


# ---- compact profile --------------------------------------------------------------------------

def compact_profile(df: DataFrame, order_by: str | None = None, k: int = 5) -> DataFrame:
    """``(column, dtype, rows, non_null, null_pct, nunique, sample, min, max)``.

    ``min`` and ``max`` are filled for numeric columns and for text that reads as numbers in over 80 %.
    Missing values count as one distinct value.
    """
    columns = [c for c in df.columns if c != order_by]

    def ends(fn):
        return lambda v, kind: F.when(
            F.lit(numbers.is_numeric(kind)) | (F.count(numbers.number_or_null(v, kind, "auto")) > 0.8 * F.count(v)),
            fn(numbers.number_or_null(v, kind)))

    table = column_table(df, {
        "dtype": lambda v, kind: F.max(F.lit(kind.simpleString())),
        "rows": rows,
        "non_null": non_null,
        "null_pct": lambda v, kind: share(v.isNull()) * 100,
        "min": ends(F.min),
        "max": ends(F.max),
    }, columns)
    counts = frequency.value_counts(df, columns).groupBy("column").agg(F.count(F.lit(1)).alias("nunique"))
    table = table.join(counts, "column", "left")
    if order_by:
        table = table.join(first_rows(df, columns, order_by, k), "column", "left")
    return table.drop("ordinal")


def first_rows(df: DataFrame, columns, order_by: str, k: int = 5) -> DataFrame:
    """``(column, sample)``: the first ``k`` non-null values of each column in row order, repeats included."""
    cells = frequency.melt(df, columns, order_by).where("value is not null")
    ranked = cells.withColumn("rank", F.row_number().over(Window.partitionBy("column").orderBy("pos", "value")))
    ordered = F.array_sort(F.collect_list(F.struct("rank", "value")))
    return ranked.where(F.col("rank") <= k).groupBy("column").agg(ordered["value"].alias("sample"))


# ---- quality ----------------------------------------------------------------------------------

def quality_summary(df: DataFrame, rows_before: int | None = None) -> DataFrame:
    """One row: rows, columns, missing percent, duplicates dropped, and outliers when they are flagged."""
    flagged = "is_outlier" in df.columns and isinstance(df.schema["is_outlier"].dataType, T.BooleanType)
    shares = [share(is_missing(df, c)) for c in df.columns]
    after = F.count(F.lit(1))
    before = F.lit(rows_before).cast("long") if rows_before is not None else after
    return df.agg(
        after.alias("rows"),
        F.max(F.lit(len(df.columns))).alias("cols"),
        (reduce(Column.__add__, shares) / len(shares) * 100).alias("missing_overall_pct"),
        (before - after).alias("dropped_duplicates"),
        (F.count_if(col("is_outlier")) if flagged else F.lit(0).cast("long")).alias("outliers_count"),
        (F.coalesce(F.avg(col("is_outlier").cast("double")), F.lit(0.0)) if flagged
         else F.lit(0.0)).alias("outliers_ratio"))


def missing_by_column(df: DataFrame, k: int | None = None) -> DataFrame:
    """``(column, null_pct)`` rounded to two places, most missing first, ties in column order."""
    table = column_table(df, {"null_pct": lambda v, kind: F.round(share(v.isNull()) * 100, 2)})
    ranked = table.orderBy(F.desc("null_pct"), "ordinal")
    return (ranked.limit(k) if k else ranked).select("column", "null_pct")
