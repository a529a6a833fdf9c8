"""The run log: one JSON object per line, appended by jobs and read as a table."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from limpid.operators.dedup import POSITION

LOG_SCHEMA = ("type string, ts string, stage string, status string, duration_ms long, error string, "
              "rows long, cols long, file string")


def parse_log(lines: Column, schema: str = LOG_SCHEMA) -> Column:
    """Struct of the fields of one line and the whole of it as ``fields``; null for a blank or corrupt line."""
    whole = F.try_parse_json(lines)
    known = F.from_json(lines, schema)
    return F.when(whole.isNotNull() & lines.rlike(r"^\s*\{"), known.withField("fields", whole))


def read_log(spark: SparkSession, path, limit: int | None = None, schema: str = LOG_SCHEMA, position: bool = False) -> DataFrame:
    """Events of a run log, corrupt lines left out; ``limit`` keeps the last ones, in the order they were appended.

    Besides the typed columns, ``fields`` is the event as it was written, a variant. ``position`` adds the place in the log
    as ``_pos``: by path, in which appends carry their time, then by line.
    """
    lines = spark.read.option("recursiveFileLookup", True).text(path)
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                     F.monotonically_increasing_id().alias("line"))
    events = lines.select(parse_log(F.col("value"), schema).alias("event"), place.alias(POSITION)).where("event is not null")
    if limit and limit > 0:
        events = events.orderBy(F.desc(POSITION)).limit(limit).orderBy(POSITION)
    return events.select("event.*", *([POSITION] if position else []))


def append_log(events: DataFrame, path: str) -> None:
    """Events appended to the log, in a folder of their own that is named by the time; a missing ``ts`` is that of writing."""
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    stamped = (events.withColumn("ts", F.coalesce(F.col("ts"), now)) if "ts" in events.columns
               else events.withColumn("ts", now))
    stamped.write.json(f"{path.rstrip('/')}/append-{time.time_ns():020d}-{uuid.uuid4().hex[:8]}")
