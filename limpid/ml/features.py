"""Features of column names, column values and whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from limpid import vocab
from limpid.functions import dates, numbers
from limpid.functions.text import is_bool_token
from limpid.operators.columns import PerValue, Tally, cardinalities, column_dict, counted, mean, non_null, rows, share, tally

NAME_FEATURES = ("name_len", "has_id", "has_pct", "has_amt", "digits_ratio", "underscores")
VALUE_FEATURES = ("nunique_ratio", "is_num_ratio", "money_ratio", "bool_ratio", "date_ratio", "mean_len")


def _has(name: Column, words) -> Column:
    return reduce(Column.__or__, [name.contains(w) for w in words]).cast("int")


def name_features(name: Column) -> dict[str, Column]:
    low = F.lower(name)
    digits = F.length(F.regexp_replace(low, r"(?U)[^\p{Nd}]", ""))
    return {
        "name_len": F.length(low),
        "has_id": _has(low, ("id",)),
        "has_pct": _has(low, vocab.FEATURE_PERCENT_WORDS),
        "has_amt": _has(low, vocab.FEATURE_AMOUNT_WORDS),
        "digits_ratio": digits / F.greatest(F.length(low), F.lit(1)),
        "underscores": F.length(low) - F.length(F.translate(low, "_", "")),
    }


def _number(v: Column, kind: T.DataType) -> Column:
    return v if numbers.is_numeric(kind) else numbers.relaxed_number(v.cast("string"))


def _ratio(part: Column, v: Column, n: Column | None) -> Column:
    return F.coalesce(counted(part, n) / F.nullif(counted(v, n), F.lit(0)), F.lit(0.0))


def _share(flag: Column, v: Column, n: Column | None) -> Column:
    return F.coalesce(share(flag, n), F.lit(0.0))


VALUE_MEASURES = {
    "rows": rows,
    "non_null": non_null,
    "is_num_ratio": PerValue(_number, _ratio),
    "money_ratio": PerValue(lambda v, kind: v.cast("string").rlike(vocab.MONEY_FEATURE_PATTERN), _share),
    "bool_ratio": PerValue(lambda v, kind: is_bool_token(v.cast("string"), vocab.BOOL_WIDE), _share),
    "date_ratio": PerValue(lambda v, kind: F.struct(dates.date_or_null(v, kind, dates.MONTH_FIRST).alias("month"), dates.date_or_null(v, kind, dates.DAY_FIRST).alias("day")),
                           lambda found, v, n: F.greatest(_ratio(found["month"], v, n), _ratio(found["day"], v, n))),
    "mean_len": PerValue(lambda v, kind: F.length(v.cast("string")), lambda found, v, n: F.coalesce(mean(found, n), F.lit(0.0))),
}


def column_features(df: DataFrame, dataset: str = "", tallied: Tally | None = None) -> DataFrame:
    """``(dataset, column, *name features, *value features)`` over all values of every column.

    ``tallied``: a tally of the columns of ``df`` in their order, where there is one already.
    """
    tallied = tallied.named(df.columns) if tallied else tally(df, staged=True)
    facts = column_dict(tallied, VALUE_MEASURES)
    distinct = cardinalities(tallied, list(facts))
    spark = df.sparkSession
    values = [(dataset, c, distinct[c] / max(1, s["non_null"]), *(float(s[k]) for k in VALUE_FEATURES[1:]))
            for c, s in facts.items()]
    fields = ", ".join(f"{k} double" for k in VALUE_FEATURES)
    table = spark.createDataFrame(values, f"dataset string, column string, {fields}")
    return table.withColumns(name_features(F.col("column")))


def header_text(names: DataFrame, key: str = "dataset", column: str = "column", order: str = "ordinal") -> DataFrame:
    """``(key, header)``: the lower-case column names of each table joined by `` | ``."""
    ordered = F.array_sort(F.collect_list(F.struct(order, F.lower(column).alias("name"))))
    return names.groupBy(key).agg(F.array_join(ordered["name"], " | ").alias("header"))


def role_histogram(roles: DataFrame, key: str = "dataset", column: str = "role") -> DataFrame:
    """``(key, role_count_*)``: how often each of the eight roles occurs per table."""
    return roles.groupBy(key).agg(*[
        F.count_if(F.col(column) == r).alias(f"role_count_{r}") for r in vocab.ROLE_LABELS])


def weak_label(date: Column, metric: Column, dims: Column) -> Column:
    """Chart type by rule: a time line, a ranking, or a distribution when there is no metric."""
    return (F.when(date.isNotNull() & metric.isNotNull(), "line_time")
            .when(metric.isNotNull() & (F.coalesce(dims, F.lit(0)) > 0), "bar_top")
            .when(metric.isNull(), "hist").otherwise("bar_top"))


def schema_table(spark, schemas: dict) -> DataFrame:
    """``(dataset, has_primary_date, has_metric, label, role_count_*)`` of inferred table schemas."""
    rows = [(name, s.primary_date, s.primary_metric, len(s.dims), role)
            for name, s in schemas.items() for role in s.roles.values()]
    flat = spark.createDataFrame(rows, "dataset string, date string, metric string, dims int, role string")
    flags = flat.groupBy("dataset").agg(F.first("date").alias("date"), F.first("metric").alias("metric"),
                                        F.first("dims").alias("dims"))
    return (role_histogram(flat).join(flags, "dataset")
            .withColumn("label", weak_label(F.col("date"), F.col("metric"), F.col("dims")))
            .withColumn("has_primary_date", F.col("date").isNotNull().cast("int"))
            .withColumn("has_metric", F.col("metric").isNotNull().cast("int"))
            .drop("date", "metric", "dims"))
