"""Queries over the test tables, one per operator, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The parquet tables of one folder by name, and the untidy views derived from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        from catalog.dirt import VIEWS
        if name in VIEWS:
            source, columns = VIEWS[name]
            return getattr(self, source).selectExpr(*[f"{expr} as {alias}" for alias, expr in columns.items()])
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is its twin, absent where SQL cannot express the operator."""
    def register(build: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: build(Tables(spark, folder))
        if sql is not None:
            from catalog.dirt import with_views
            ORACLES[name] = with_views(sql)
        return build
    return register
