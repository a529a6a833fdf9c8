"""Delimited text files: encoding, headers, missing-value tokens, column types, row positions."""

from __future__ import annotations

import csv
import io
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from limpid.functions.numbers import plain_number
from limpid.functions.text import na_to_null
from limpid.operators.cells import col, free_names
from limpid.operators.columns import column_dict, non_null
from limpid.operators.dedup import POSITION
from limpid.operators.ranking import sums_before, with_row_number
from limpid.sources.headers import header_names
from limpid.sources.quoted import Grammar, records, scan_paths
from limpid.storage import materialize

WHOLE = r"^\s*[+-]?\d{1,18}\s*$"
LONG_WHOLE = r"^\s*[+-]?\d{1,38}\s*$"


def read_csv(spark: SparkSession, path, encoding: str = "auto", sep: str = ",", infer: bool = True,
             position: bool = False) -> DataFrame:
    """A delimited file or folder, every file with a header line, as a typed table with clean column names.

    Columns of different files are matched by name; a file that lacks a column has nulls there. ``encoding="auto"``
    reads UTF-8 and falls back to ISO-8859-1 for the files in which bytes do not decode. ``position`` adds the row
    order of the files as ``_pos``. Quoted fields may hold line breaks; files that have some go through ``quoted.records``
    and are staged, the others are read as they are. Both are read by many tasks a file.
    """
    options = {"sep": sep, "quote": '"', "escape": '"', "mode": "PERMISSIVE",
               "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    kinds, broken = file_kinds(spark, path, encoding, sep)
    if not kinds and not broken:
        raise ValueError(f"no rows in {path}")

    def scan(names, enc, files):
        schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
        whole = len(kinds) == 1 and not broken
        table = spark.read.options(**options, encoding=enc, header=True, enforceSchema=True).schema(schema).csv(path if whole else scan_paths(files))
        return table.select(*map(col, names), *([row_position().alias(POSITION)] if position else []))

    scans = [scan(names, enc, files) for (names, enc), files in kinds.items()]
    if broken:
        scans += _parsed_records(spark, broken, sep, position)
    table = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), scans)
    names = [c for c in table.columns if c != POSITION]
    table = table.select(*map(col, names), *([POSITION] if position else []))
    table = table.withColumns({n: na_to_null(col(n)) for n in names})
    return infer_types(table, names) if infer else table


def file_kinds(spark: SparkSession, path, encoding: str, sep: str) -> tuple[dict[tuple, list[str]], dict[str, str]]:
    """``{(column names, encoding): files}``, and ``{file: encoding}`` of the files with line breaks inside quotes.

    One pass gives each file's first line, whether it decodes and whether a line ends inside quotes. One row per file
    reaches the driver, as many as Spark's own file listing has.
    """
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("line"))
    # no line opens a quoted field that it does not close: then every line is a record
    opens = F.contains("value", F.lit('"')) & F.col("value").rlike(Grammar(sep).opens)
    found = lines.groupBy("file").agg(F.min_by(F.col("value").cast("binary"), F.struct("start", "line")).alias("header"),
                                      F.bool_and(F.is_valid_utf8("value")).alias("decodes"), F.bool_or(opens).alias("broken"))
    kinds: dict[tuple, list[str]] = {}
    broken: dict[str, str] = {}
    for row in found.orderBy("file").collect():
        enc = encoding if encoding != "auto" else "UTF-8" if row["decodes"] else "ISO-8859-1"
        if row["broken"]:
            broken[row["file"]] = enc
        else:
            kinds.setdefault((tuple(_names(row["header"], enc, sep)), enc), []).append(row["file"])
    return kinds, broken


def _names(header: bytes, enc: str, sep: str) -> list[str]:
    text = bytes(header).decode(enc, errors="replace").lstrip("\ufeff")
    return header_names(next(csv.reader(io.StringIO(text, newline=""), delimiter=sep), []))


def _parsed_records(spark: SparkSession, files: dict[str, str], sep: str, position: bool) -> list[DataFrame]:
    """Tables of the files with line breaks inside quotes, one for each list of column names and encoding."""
    rows = records(spark, list(files), sep).where(F.col("value").cast("string").rlike(r"\S"))
    heads = rows.groupBy("file").agg(F.min("row").alias("head"), F.min_by("value", "row").alias("header")).collect()
    kinds: dict[tuple, list[tuple[str, int]]] = {}
    for r in heads:
        enc = files[r["file"]]
        kinds.setdefault((tuple(_names(r["header"], enc, sep)), enc), []).append((r["file"], r["head"]))
    tables = []
    for (names, enc), members in sorted(kinds.items()):
        known = F.broadcast(spark.createDataFrame(members, "file string, head long"))  # one row per file
        text = F.regexp_replace(F.decode("value", enc), "\r\\z", "")
        table = rows.join(known, "file").where("row > head").select("file", "row", Grammar(sep).cells(text).alias("cells"))
        place = [F.struct("file", "row").alias(POSITION)] if position else []
        tables.append(table.select(*[F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(names)], *place))
    return tables


def row_position() -> Column:
    """File, then the place of the row in it.

    A row starts at or after its split's first byte plus the rows before it in the split, so split offset
    plus row number never reaches the next split; a task's row number is the low part of the row id.
    """
    row = F.col("_metadata.file_block_start") + F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    return F.struct(F.col("_metadata.file_path").alias("file"), row.alias("row"))


#: Positions that are ranked together; a file has at most so many rows among them.
POSITIONS = 1 << 20


def number_rows(table: DataFrame, name: str = "row") -> DataFrame:
    """``table`` with the number of every row in file order, from 0 and without gaps, in place of ``_pos``.

    Rows are ranked within (file, range of positions); to that come the rows of the file's earlier ranges and of earlier files,
    both summed in a tree. No task sorts a whole file.
    """
    file, bucket, rank, before, earlier, place = free_names([*table.columns, name], "file", "bucket", "rank", "before", "earlier", "place")
    first, second = (f.name for f in table.schema[POSITION].dataType.fields)
    cut = table.withColumns({file: F.col(POSITION)[first], bucket: F.floor(F.col(POSITION)[second] / POSITIONS)})
    counts = materialize(cut.groupBy(file, bucket).agg(F.count(F.lit(1)).alias("n")), "ranges")
    files = with_row_number(counts.groupBy(file).agg(F.sum("n").alias("n")), [F.asc_nulls_first(file)], place)
    files = sums_before(files, place, "n", name=earlier).select(file, earlier)
    offsets = sums_before(counts, bucket, "n", [file], before).join(files, file).select(file, bucket, (F.col(before) + F.col(earlier)).alias(before))
    here = Window.partitionBy(file, bucket).orderBy(F.col(POSITION)[second])
    ranked = cut.withColumn(rank, F.row_number().over(here) - 1).join(offsets, [file, bucket])
    kept = [col(c) for c in table.columns if c not in (POSITION, name)]
    return ranked.select(*kept, (F.col(rank) + F.col(before)).cast("long").alias(name))


def infer_types(table: DataFrame, columns=None) -> DataFrame:
    """Text columns typed from their values: boolean words, whole numbers, numbers, else text. One pass."""
    columns = [c for c in (columns or table.columns) if isinstance(table.schema[c].dataType, T.StringType)]
    seen = column_dict(table, {
        "non_null": non_null,
        "bools": lambda v, kind: F.count_if(F.lower(v).isin("true", "false")),
        "wholes": lambda v, kind: F.count_if(v.rlike(WHOLE)),
        "long_wholes": lambda v, kind: F.count_if(v.rlike(LONG_WHOLE)),
        "numbers": lambda v, kind: F.count(plain_number(v)),
    }, columns)
    typed = {}
    for c, s in seen.items():
        if not s["non_null"]:
            continue
        if s["bools"] == s["non_null"]:
            typed[c] = F.lower(col(c)).cast("boolean")
        elif s["wholes"] == s["non_null"]:
            typed[c] = F.trim(col(c)).try_cast("long")
        elif s["long_wholes"] == s["non_null"]:  # more digits than a long or a double keeps
            typed[c] = F.trim(col(c)).try_cast("decimal(38,0)")
        elif s["numbers"] == s["non_null"]:
            typed[c] = plain_number(col(c))
    return table.withColumns(typed) if typed else table
