"""From a folder of labelled files to training rows and fitted models."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from limpid.ml import features, models
from limpid.operators.columns import tally
from limpid.plans.semantics import infer_semantics
from limpid.sources.headers import normalize_headers
from limpid.sources.tables import load_table, training_files


def training_table(spark: SparkSession, folder: str) -> DataFrame:
    """``(dataset, label, ordinal, column, role, *features)``: one row per column of every labelled file.

    The label is that of the file name, roles are inferred. Every file is a table of its own, so they are read one
    after another; each is as distributed as it is large.
    """
    parts = []
    for found in sorted(training_files(spark, folder).collect()):
        table = normalize_headers(load_table(spark, found["path"]), "semantic")
        tallied = tally(table, staged=True)
        roles = infer_semantics(table, tallied=tallied).roles
        listed = [(found["path"], found["label"], i, c, roles[c]) for i, c in enumerate(table.columns)]
        listed = spark.createDataFrame(listed, "dataset string, label string, ordinal int, column string, role string")
        parts.append(listed.join(features.column_features(table, found["path"], tallied).drop("dataset"), "column"))
    if not parts:
        raise ValueError(f"no labelled files in {folder}")
    return reduce(DataFrame.unionByName, parts)


def domain_rows(table: DataFrame) -> DataFrame:
    """``(dataset, text, domain)`` of a training table."""
    text = models.domain_text(features.header_text(table), features.role_histogram(table))
    return text.join(table.select("dataset", table["label"].alias("domain")).distinct(), "dataset")


def train_domain(spark: SparkSession, folder: str) -> PipelineModel:
    """Domain classifier from a folder of labelled files."""
    return models.train_domain(domain_rows(training_table(spark, folder)))
