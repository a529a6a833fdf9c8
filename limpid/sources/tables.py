"""One entry point for every readable format, labelled training folders, and the sinks."""

from __future__ import annotations

import json
import posixpath

from pyspark.sql import DataFrame, SparkSession, functions as F

from limpid.operators.cells import col
from limpid.operators.dedup import POSITION
from limpid.operators.profile import profile_text
from limpid.sources.delimited import read_csv
from limpid.sources.headers import header_names, normalize_headers
from limpid.sources.workbook import read_workbooks

# ---- fixed values: file suffixes --------------------------------------------------------------
WORKBOOKS = (".xlsx", ".xlsm", ".xltx", ".xltm", ".ods")
SUFFIXES = (".csv", ".parquet", ".xlsx", ".ods")


def load_table(spark: SparkSession, path: str, position: bool = False) -> DataFrame:
    """A table by file suffix; an unknown suffix is a ``ValueError``, a missing file Spark's own error."""
    suffix = posixpath.splitext(path.rstrip("/"))[1].lower()
    if suffix == ".csv":
        return read_csv(spark, path, position=position)
    if suffix in WORKBOOKS:
        return read_workbooks(spark, path, position=position)
    if suffix == ".parquet":
        table = spark.read.parquet(path)
        if position:
            place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
            return table.select(*[col(c).alias(n) for c, n in zip(table.columns, header_names(table.columns))], place.alias(POSITION))
        return normalize_headers(table)
    raise ValueError(f"unsupported suffix {suffix!r}; expected one of {', '.join(SUFFIXES)}")


def training_files(spark: SparkSession, folder: str) -> DataFrame:
    """``(path, label)`` of the files under a folder that are named ``label__rest``, or stand in a folder named so.

    Other files are left out. What precedes an equals sign in the name of a partition folder is no part of the label.
    """
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
             .select("path"))
    named = F.filter(F.split("path", "/"), lambda part: part.contains("__"))
    name = F.regexp_replace(F.lower(F.try_element_at(named, F.lit(-1))), "^[^=]*=", "")
    return files.withColumn("label", F.split(name, "__")[0]).where("label is not null")


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Header and UTF-8; one file per task, never gathered into one."""
    df.write.mode(mode).options(header=True, escape='"', encoding="UTF-8", ignoreLeadingWhiteSpace=False,
                                ignoreTrailingWhiteSpace=False).csv(path)


def write_profile(profile: DataFrame, path: str, mode: str = "errorifexists") -> None:
    write_csv(profile_text(profile).coalesce(1), path, mode)


def write_spec(spark: SparkSession, spec: dict, path: str, mode: str = "errorifexists") -> None:
    """The spec as one line of JSON, accents kept."""
    text = json.dumps(spec, ensure_ascii=False)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode(mode).text(path)


def read_spec(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()["value"])


def write_charts(charts: DataFrame, path: str, mode: str = "errorifexists") -> None:
    charts.write.mode(mode).json(path)
