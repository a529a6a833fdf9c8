"""Measures over the distinct values of a table."""

import datetime
import math

from pyspark.sql import functions as F

from limpid.ml import features
from limpid.operators import columns
from limpid.plans import semantics


def odd(spark):
    rows = [("a", 1, 1.5, -0.0, datetime.datetime(2024, 1, 5), [1]), ("$ 5", 1, math.nan, 0.0, None, [1]), (None, 2, None, -0.0, None, None),
            ("a", None, 1.5, 2.0, datetime.datetime(2024, 1, 5), [2]), ("2024-01-05", 2, 7.0, 2.0, datetime.datetime(2024, 2, 5), None), ("", 1, 7.0, None, None, [1])] * 3
    df = spark.createDataFrame(rows, "t string, i int, x double, z double, d timestamp, l array<int>").withColumn("none", F.lit(None).cast("string"))
    return df.withColumn("price", F.col("x").cast("decimal(10,2)"))


def test_tally_measures_like_rows(spark):
    df = odd(spark)
    for measures in (semantics.VALUE_EVIDENCE, features.VALUE_MEASURES):
        names = [c for c in df.columns if c != "l"] if "estimate" in measures else df.columns
        want = columns.column_dict(df, measures, names)
        for staged in (False, True):
            assert columns.column_dict(columns.tally(df, names, staged), measures) == want
        assert columns.column_dict(columns.tally(df), measures, ["z", "t"]) == {c: {**want[c], "ordinal": df.columns.index(c)} for c in ("z", "t")}
    assert columns.cardinalities(columns.tally(df)) == columns.cardinalities(df) == {"t": 4, "i": 2, "x": 2, "z": 3, "d": 2, "l": 2, "none": 0, "price": 2}
    assert columns.column_dict(columns.tally(df.limit(0)), features.VALUE_MEASURES) == columns.column_dict(df.limit(0), features.VALUE_MEASURES)


def test_a_value_is_looked_at_once(spark):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("boolean")
    def long_word(v):
        calls.add(1)
        return None if v is None else len(v) > 1

    df = spark.range(3000).select(F.concat(F.lit("w"), F.col("id") % 7).alias("w"))
    table = columns.column_table(columns.tally(df), {"long": columns.share_of(lambda v, kind: long_word(v))})
    assert table.first()["long"] == 1.0 and calls.value <= 7


def test_schema_and_features_share_a_tally(spark):
    df = odd(spark).drop("l")
    tallied = columns.tally(df, staged=True)
    assert semantics.infer_semantics(df, tallied=tallied) == semantics.infer_semantics(df)
    assert sorted(features.column_features(df, "d", tallied).collect()) == sorted(features.column_features(df, "d").collect())
