"""Records of delimited files whose quoted fields hold line breaks, read by many tasks a file.

Whether a line begins inside quotes depends on all text before it. So each line is judged under both assumptions; what a
whole split makes of either is known after one pass, and a prefix scan over the splits of a file tells how each really
begins. Then every split puts its own records together, and the few that cross a border are joined afterwards.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from limpid.storage import materialize

# What becomes of a record in a split.
WHOLE, BEGUN, CARRIED = 0, 1, 2


class Grammar:
    """Regular expressions over one line: does it end inside quotes?

    A field is quoted when its first character is a quote; two quotes inside stand for one, and whatever follows the closing quote
    up to the separator is literal, quotes included. Quantifiers are possessive, so matching is linear.
    """

    def __init__(self, sep: str):
        self.sep = sep
        s = re.escape(sep) if sep != "\t" else "\\t"
        inner = '[^"]*+(?:""[^"]*+)*+'
        tail = f'(?:[^{s}"][^{s}]*+)?+'
        field = f'(?:"{inner}"{tail}|[^{s}"][^{s}]*+|)'
        fields = f'(?:{field}{s})*+'
        self.field = f'{s}({field})'
        self.quoted = f'\\A"({inner})"({tail})\\z'
        #: A line that begins outside quotes and ends inside.
        self.opens = f'\\A\\x{{FEFF}}?{fields}"{inner}\\z'
        #: A line that begins inside quotes and ends inside.
        self.stays = f'\\A{inner}(?:\\z|"{tail}{s}{fields}"{inner}\\z)'

    def code(self, line: Column) -> Column:
        """1 if a line that begins outside ends inside, plus 2 if one that begins inside does."""
        judged = F.when(line.rlike(self.opens), 1).otherwise(0) + F.when(line.rlike(self.stays), 2).otherwise(0)
        return F.when(F.contains(line, F.lit('"')), judged).otherwise(2).cast("byte")


    def cells(self, record: Column) -> Column:
        """The fields of a whole record, unquoted. A separator before it keeps the first field from being an empty match."""
        def plain(field: Column) -> Column:
            body, tail = (F.regexp_extract(field, self.quoted, i) for i in (1, 2))
            return F.when(F.startswith(field, F.lit('"')), F.concat(F.replace(body, F.lit('""'), F.lit('"')), tail)).otherwise(field)
        return F.transform(F.regexp_extract_all(F.concat(F.lit(self.sep), record), F.lit(self.field), F.lit(1)), plain)


def states(codes: np.ndarray, inside: int) -> np.ndarray:
    """Before each line, and after the last one: 1 inside quotes, 0 outside.

    A line keeps the state, turns it round, or sets it. So it is that of the last line that set it, turned round as often as
    lines after that say.
    """
    after = np.empty(len(codes) + 1, np.int8)
    after[0] = inside
    if len(codes):
        sets = (codes == 0) | (codes == 3)
        turns = np.cumsum(codes == 1)
        last = np.maximum.accumulate(np.where(sets, np.arange(len(codes)), -1))
        base = np.where(last >= 0, codes[last] & 1, inside)
        after[1:] = (base + turns - np.where(last >= 0, turns[last], 0)) & 1
    return after


def scan_paths(files: list[str]) -> list[str]:
    """Paths for a reader from the addresses that ``_metadata.file_path`` gives; characters of patterns are taken literally."""
    return [re.sub(r"([\[\]{}*?\\])", r"\\\1", unquote(f)) for f in files]


def raw_lines(spark: SparkSession, files: list[str], grammar: Grammar) -> DataFrame:
    """``(id, start, code, value)``: lines of the files in file order within a split; ``id`` is the file's place in the list."""
    ids = spark.createDataFrame([(f, i) for i, f in enumerate(files)], "file string, id int")
    lines = spark.read.option("lineSep", "\n").text(scan_paths(files)).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")
    # one row per file, as many as the driver lists anyway
    return lines.join(F.broadcast(ids), "file").select("id", "start", grammar.code(F.col("value")).alias("code"), F.col("value").cast("binary").alias("value"))


def split_effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per split: what it makes of a begin outside and of one inside quotes."""
    current, effect, done = None, [0, 1], []
    for batch in batches:
        codes = batch.column("code").to_numpy()
        for key, a, b in segments(batch):
            if key != current:
                if current is not None:
                    done.append((*current, *effect))
                current, effect = key, [0, 1]
            effect = [int(states(codes[a:b], e)[-1]) for e in effect]
    if current is not None:
        done.append((*current, *effect))
    columns = list(zip(*done)) if done else [[], [], [], []]
    yield pa.RecordBatch.from_pydict({n: pa.array(c, t) for n, c, t in zip(
        ("id", "start", "outside", "inside"), columns, (pa.int32(), pa.int64(), pa.int8(), pa.int8()))})


def segments(batch: pa.RecordBatch) -> Iterator[tuple[tuple[int, int], int, int]]:
    """((file, split), first row, end) of the runs of rows of one split."""
    ids, starts = batch.column("id").to_numpy(), batch.column("start").to_numpy()
    if len(ids):
        cuts = np.flatnonzero((np.diff(ids) != 0) | (np.diff(starts) != 0)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(ids)]):
            yield (int(ids[a]), int(starts[a])), a, b


def split_states(effects: DataFrame) -> DataFrame:
    """``(id, start, begins, ends)`` of every split: the effects of the splits before it, one after the other."""
    turn = F.when((F.col("outside") == 1) & (F.col("inside") == 0), 1).otherwise(0)
    w = Window.partitionBy("id").orderBy("start")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    counted = effects.withColumn("turns", F.sum(turn).over(w))
    sets = F.when(F.col("outside") == F.col("inside"), F.struct(F.col("outside").alias("to"), F.col("turns").alias("at")))
    seen = counted.withColumns({"set": F.last(sets, True).over(before), "earlier": F.coalesce(F.sum(turn).over(before), F.lit(0))})
    begins = (F.coalesce(F.col("set.to"), F.lit(0)) + F.col("earlier") - F.coalesce(F.col("set.at"), F.lit(0))) % 2
    return seen.withColumn("begins", begins.cast("byte")).select(
        "id", "start", "begins", F.when(F.col("begins") == 1, F.col("inside")).otherwise(F.col("outside")).alias("ends"))


class _Split:
    """Puts the lines of one split together; ``open`` holds those of the record that is not complete yet."""

    def __init__(self, begins: int):
        self.inside, self.seen, self.open, self.row, self.kind = begins, 0, [], 0, CARRIED

    def take(self, codes: np.ndarray, values: pa.Array, out: list[tuple[int, int, pa.Array]]) -> None:
        state = states(codes, self.inside)
        firsts = np.flatnonzero(state[:-1] == 0)
        self.inside = int(state[-1])
        head = int(firsts[0]) if len(firsts) else len(codes)
        if head:
            self.open.extend(values.slice(0, head).to_pylist())
        if len(firsts):
            self.close(out)
            whole = firsts if not self.inside else firsts[:-1]  # the last one goes on beyond this batch
            ends = np.append(firsts[1:], len(codes))[:len(whole)]
            if len(whole):
                stop = int(ends[-1])
                offsets = np.append(whole, stop) - head
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values.slice(head, stop - head))
                out.append((self.seen + whole, WHOLE, pc.binary_join(lists, b"\n")))
            if self.inside:
                self.row, self.kind = self.seen + int(firsts[-1]), BEGUN
                self.open = values.slice(int(firsts[-1])).to_pylist()
        self.seen += len(codes)

    def close(self, out: list) -> None:
        """The open record as it is, complete if it began here and ends here."""
        if self.open:
            kind = WHOLE if self.kind == BEGUN and not self._unfinished else self.kind
            out.append((np.array([self.row]), kind, pa.array([b"\n".join(self.open)], pa.binary())))
        self.open, self.kind, self.row = [], BEGUN, 0

    _unfinished = False

    def finish(self, out: list) -> None:
        self._unfinished = bool(self.inside)
        self.close(out)


RECORD_SCHEMA = "id int, row long, kind byte, value binary"


def glue(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of the splits of a task, and what is cut off at their borders."""
    current, split = None, None

    def rows(key, out):
        for at, kind, values in out:
            n = len(values)
            yield pa.RecordBatch.from_pydict({"id": pa.array(np.full(n, key[0], np.int32)), "row": pa.array(np.asarray(at, np.int64) + key[1]),
                                              "kind": pa.array(np.full(n, kind, np.int8)), "value": values.cast(pa.binary())})

    for batch in batches:
        codes, begins = batch.column("code").to_numpy(), batch.column("begins").to_numpy()
        for key, a, b in segments(batch):
            out: list = []
            if key != current:
                if split:
                    split.finish(out)
                    yield from rows(current, out)
                    out = []
                current, split = key, _Split(int(begins[a]))
            split.take(codes[a:b], batch.column("value").slice(a, b - a), out)
            yield from rows(key, out)
    if split:
        out = []
        split.finish(out)
        yield from rows(current, out)


def records(spark: SparkSession, files: list[str], sep: str = ",") -> DataFrame:
    """``(file, row, value)``: every record of the files with its line breaks, ``row`` ascending in the file; staged.

    A quote that is never closed is an error, as the rest of the file would be one field.
    """
    grammar = Grammar(sep)
    lines = raw_lines(spark, files, grammar)
    effects = lines.select("id", "start", "code").mapInArrow(split_effects, "id int, start long, outside byte, inside byte")
    begins = materialize(split_states(effects), "splits")
    torn = begins.groupBy("id").agg(F.max_by("ends", "start").alias("ends")).where("ends = 1").first()
    if torn:
        raise ValueError(f"a quote is never closed in {files[torn['id']]}")
    # one row per split: 128 MB of text by default
    known = lines.join(F.broadcast(begins.select("id", "start", "begins")), ["id", "start"])
    parts = materialize(known.mapInArrow(glue, RECORD_SCHEMA), "records")
    order = Window.partitionBy("id").orderBy("row", F.desc("kind"))
    cut = parts.where(F.col("kind") != WHOLE).withColumn("first", F.max(F.when(F.col("kind") == BEGUN, F.col("row"))).over(order))
    # at most two pieces per split
    joined = cut.groupBy("id", F.col("first").alias("row")).agg(F.sort_array(F.collect_list(F.struct("row", "value"))).alias("pieces"))
    text = F.array_join(F.transform("pieces", lambda p: F.hex(p["value"])), "0A")
    found = parts.where(F.col("kind") == WHOLE).select("id", "row", "value").unionByName(joined.select("id", "row", F.unhex(text).alias("value")))
    names = spark.createDataFrame([(i, f) for i, f in enumerate(files)], "id int, file string")
    return found.join(F.broadcast(names), "id").select("file", "row", "value")
