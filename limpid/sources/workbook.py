"""Spreadsheets: many ``.xlsx`` and ``.ods`` files as one Spark job, one task per group of files.

A workbook is a zip of XML, so a small parser inside ``mapInPandas`` suffices. It yields rows in batches and
never holds more than one file; a sheet has at most about a million rows by format.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from limpid.functions.text import na_to_null
from limpid.operators.cells import col
from limpid.operators.dedup import POSITION
from limpid.sources.delimited import infer_types
from limpid.sources.headers import header_names

ROWS_SCHEMA = "path string, row long, cells array<string>"


def sheet_reader(batch: int = 5000):
    """Function for ``mapInPandas``: ``(path, content)`` to the rows of each workbook's first sheet.

    Self-contained, so that workers need only the standard library and pandas.
    """

    def cell_column(ref, fallback):
        n = 0
        for ch in ref or "":
            if ch.isalpha():
                n = n * 26 + ord(ch.upper()) - 64
        return n - 1 if n else fallback

    def local(tag):
        return tag.rsplit("}", 1)[-1]

    def number_text(text):
        try:
            value = float(text)
        except ValueError:
            return text
        return str(int(value)) if value.is_integer() and abs(value) < 1e15 else repr(value)

    def xlsx_rows(book):
        import re
        import datetime
        from xml.etree import ElementTree as ET

        shared, dated = [], set()
        if "xl/sharedStrings.xml" in book.namelist():
            for item in ET.fromstring(book.read("xl/sharedStrings.xml")):
                shared.append("".join(t.text or "" for t in item.iter() if local(t.tag) == "t"))
        if "xl/styles.xml" in book.namelist():
            styles = ET.fromstring(book.read("xl/styles.xml"))
            custom = {f.get("numFmtId") for f in styles.iter() if local(f.tag) == "numFmt"
                      and re.search(r"[dy]", f.get("formatCode", ""), re.I)}
            cells = next((e for e in styles if local(e.tag) == "cellXfs"), [])
            dated = {i for i, x in enumerate(cells)
                     if x.get("numFmtId") in custom or x.get("numFmtId") in {"14", "15", "16", "17", "22"}}
        names = sorted(n for n in book.namelist() if re.match(r"xl/worksheets/sheet\d+\.xml$", n))
        first = min(names, key=lambda n: int(re.search(r"\d+", n.rsplit("/", 1)[-1]).group()))
        if {"xl/workbook.xml", "xl/_rels/workbook.xml.rels"} <= set(book.namelist()):  # the sheet that is listed first
            sheet = next((e for e in ET.fromstring(book.read("xl/workbook.xml")).iter() if local(e.tag) == "sheet"), None)
            key = next((v for k, v in (sheet.attrib if sheet is not None else {}).items() if local(k) == "id"), None)
            target = {e.get("Id"): e.get("Target") for e in ET.fromstring(book.read("xl/_rels/workbook.xml.rels"))}.get(key)
            listed = f"xl/{target}" if target and not target.startswith("/") else (target or "")[1:]
            first = listed if listed in book.namelist() else first
        with book.open(first) as stream:
            for _, row in ET.iterparse(stream):
                if local(row.tag) != "row":
                    continue
                values = []
                for c in row:
                    at = cell_column(c.get("r"), len(values))
                    values.extend([None] * (at + 1 - len(values)))
                    kind = c.get("t")
                    if kind == "inlineStr":
                        values[at] = "".join(t.text or "" for t in c.iter() if local(t.tag) == "t")
                        continue
                    raw = next((v.text for v in c if local(v.tag) == "v"), None)
                    if raw is None:
                        continue
                    if kind == "s":
                        values[at] = shared[int(raw)]
                    elif kind == "b":
                        values[at] = "true" if raw == "1" else "false"
                    elif kind in ("str", "e"):
                        values[at] = raw
                    elif int(c.get("s", -1)) in dated:
                        day = datetime.datetime(1899, 12, 30) + datetime.timedelta(days=float(raw))
                        values[at] = day.date().isoformat() if float(raw).is_integer() else day.isoformat(" ")
                    else:
                        values[at] = number_text(raw)
                yield values
                row.clear()

    def ods_rows(book):
        from xml.etree import ElementTree as ET

        inside = False
        with book.open("content.xml") as stream:
            for event, node in ET.iterparse(stream, ("start", "end")):
                tag = local(node.tag)
                if tag == "table":
                    if event == "end":
                        return
                    inside = True
                if event != "end" or tag != "table-row" or not inside:
                    continue
                values, attr = [], lambda n, name: next((v for k, v in n.attrib.items() if local(k) == name), None)
                for c in node:
                    if local(c.tag) not in ("table-cell", "covered-table-cell"):
                        continue
                    kind = attr(c, "value-type")
                    text = "\n".join("".join(p.itertext()) for p in c if local(p.tag) == "p")
                    value = {"date": attr(c, "date-value"), "boolean": attr(c, "boolean-value")}.get(kind)
                    if kind in ("float", "currency", "percentage"):
                        value = number_text(attr(c, "value"))
                    elif value is None:
                        value = text or None
                    repeat = int(attr(c, "number-columns-repeated") or 1)
                    values.extend([value] * (repeat if value is not None or repeat < 1000 else 0))
                if any(v is not None for v in values):
                    for _ in range(int(attr(node, "number-rows-repeated") or 1)):
                        yield values
                node.clear()

    def read(batches):
        import io
        import zipfile
        import pandas as pd

        for files in batches:
            for path, content in zip(files["path"], files["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as book:
                    rows = ods_rows(book) if "content.xml" in book.namelist() else xlsx_rows(book)
                    out = []
                    for i, cells in enumerate(rows):
                        out.append((path, i, cells))
                        if len(out) == batch:
                            yield pd.DataFrame(out, columns=["path", "row", "cells"])
                            out = []
                    if out:
                        yield pd.DataFrame(out, columns=["path", "row", "cells"])

    return read


def workbook_rows(files: DataFrame) -> DataFrame:
    """``(path, row, cells)`` of every workbook in ``(path, content)``."""
    return files.select("path", "content").mapInPandas(sheet_reader(), ROWS_SCHEMA)


def workbook_table(files: DataFrame, names=None, infer: bool = True, position: bool = False) -> DataFrame:
    """The workbooks as one table, columns matched by the names in each file's own header.

    ``names`` replaces the headers by one list for all files. Distinct headers, not files, reach the driver.
    """
    rows = workbook_rows(files)
    place = [F.struct("path", "row").alias(POSITION)] if position else []
    if names is not None:
        table = rows.where("row > 0").select(*[F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(names)], *place)
    else:
        headers = rows.where("row = 0").groupBy("cells").agg(F.min("path").alias("path")).orderBy("path").collect()
        if not headers:
            raise ValueError("no workbook rows")
        named = [(r["cells"], header_names(["" if h is None else h for h in r["cells"]])) for r in headers]
        names = list(dict.fromkeys(n for _, found in named for n in found))
        if len(named) == 1:
            table = rows.where("row > 0").select(*[F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(names)], *place)
            table = table.withColumns({n: na_to_null(col(n)) for n in names})
            return infer_types(table, names) if infer else table
        known = files.sparkSession.createDataFrame(named, "header array<string>, names array<string>")
        heads = rows.where("row = 0").select("path", F.col("cells").alias("header"))
        heads = heads.join(known, heads["header"].eqNullSafe(known["header"])).select("path", "names")
        table = rows.where("row > 0").join(heads, "path").select(
            *[F.get("cells", (F.array_position("names", n) - 1).cast("int")).alias(n) for n in names], *place)
    table = table.withColumns({n: na_to_null(col(n)) for n in names})
    return infer_types(table, names) if infer else table


def read_workbooks(spark: SparkSession, path, position: bool = False) -> DataFrame:
    """First sheet of one workbook, or of all workbooks under a folder or pattern."""
    return workbook_table(spark.read.format("binaryFile").load(path), position=position)
