from pyspark.sql import functions as F

from limpid.operators import sketches


def test_sketches_of_parts_and_of_the_whole(spark):
    df = spark.range(30_000).selectExpr("id % 7000 as a", "concat('k', id % 3) as b", "cast(null as double) as c", "id % 5 as day")
    parts = sketches.distinct_sketches(df, ["a", "b", "c"], ["day"])
    got = {r["column"]: r["estimate"] for r in sketches.distinct_estimates(sketches.united(parts)).collect()}
    whole = {r["column"]: r["estimate"] for r in sketches.distinct_estimates(sketches.distinct_sketches(df, ["a", "b", "c"])).collect()}
    for found in (got, whole):  # a united sketch estimates by another formula than one that has seen the rows
        assert abs(found["a"] - 7000) <= 7000 * sketches.ERROR and (found["b"], found["c"]) == (3, 0)
    assert parts.count() == 15 and sketches.united(parts, ["day"]).where(F.col("day") == 1).count() == 3
    assert sketches.united(sketches.distinct_sketches(df.limit(0), ["a"])).collect() == []
