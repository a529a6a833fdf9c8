r"""Lines that many documents share, dropped everywhere; DataFrame functions only.

Line hashes live in levelled sorted runs. A batch of documents is aggregated to one row per line hash and merge-joined with
the runs of repeated hashes: those it finds are only counted on, the rest, the anti join, is the batch's own run. When a
level is full, its runs are merged into one of the next level: counts are added, and hashes that reach the threshold leave
for a sorted run of repeated hashes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from limpid.llm.dedup import normalized
from limpid.llm.skew import FEW_KEYS, HOT_SHARE
from limpid.operators.cells import free_names
from limpid.storage import materialize, scratch_path

#: Characters that are stripped at both ends of a line before it is compared.
BLANKS = " \t\n\x0b\x0c\r"
#: Runs of a level that are merged into one of the next level.
FANOUT = 3
#: Batches that a table is dealt into.
BATCHES = 4


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """What is compared: the line without blanks at both ends, A-Z as a-z."""
    return normalized(F.btrim(line, F.lit(BLANKS)))


def digest(value: Column) -> Column:
    """128 bits of SHA-256."""
    return F.unhex(F.substring(F.sha2(value, 256), 1, 32))


def line_hashes(text: Column, min_chars: int) -> Column:
    """The hash of every line in order, null for a key of fewer than ``min_chars`` characters."""
    return F.transform(F.transform(split_lines(text), line_key), lambda k: F.when(F.char_length(k) >= min_chars, digest(k)))


class LineRuns:
    """Levelled sorted runs of ``(hash, docs, known)``; all of them together count the documents of every line hash.

    A run is a table dealt and sorted by hash. ``known`` marks counts of hashes that were repeated before, in at least
    ``min_docs`` documents; only their runs, a small part of all hashes, meet each batch.
    """

    def __init__(self, spark: SparkSession, min_docs: int, fanout: int = FANOUT):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.levels: list[list[DataFrame]] = [[]]
        self.known_runs: list[DataFrame] = []

    @staticmethod
    def _run(rows: DataFrame) -> DataFrame:
        return materialize(rows.select("hash", "docs", "known").sortWithinPartitions("hash"), "line-run")

    def _all(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level] + self.known_runs

    def unseen(self, batch: DataFrame) -> DataFrame:
        """Distinct hashes of ``batch(hash)`` that no run holds, for those who keep the first of equal lines only."""
        hashes = batch.select("hash").where("hash is not null").distinct()
        for run in self._all():
            hashes = hashes.join(run.select("hash").hint("merge"), "hash", "left_anti")
        return hashes

    def add(self, batch: DataFrame) -> None:
        """``batch(hash)``, a row per document and line hash, as a run of its own; full levels are merged."""
        fresh = batch.groupBy("hash").agg(F.count(F.lit(1)).alias("docs")).withColumn("known", F.lit(False))
        for run in self.known_runs:
            met = run.select("hash", F.lit(True).alias("found")).hint("merge")
            fresh = fresh.join(met, "hash", "left").select("hash", "docs", (F.col("known") | F.col("found").isNotNull()).alias("known"))
        self.levels[0].append(self._run(fresh))
        level = 0
        while len(self.levels[level]) >= self.fanout:
            self._merge(level)
            level += 1

    def _merge(self, level: int) -> None:
        """The runs of a level as one of the next; repeated hashes leave for a run of their own."""
        known = F.bool_or("known") | (F.sum("docs") >= self.min_docs)
        merged = self._run(reduce(DataFrame.unionByName, self.levels[level]).groupBy("hash").agg(F.sum("docs").alias("docs"), known.alias("known")))
        self.known_runs.append(self._run(merged.filter("known")))
        if level + 1 == len(self.levels):
            self.levels.append([])
        self.levels[level + 1].append(merged.filter("not known"))
        self.levels[level] = []

    def repeated(self) -> DataFrame:
        """``(hash, docs)`` of all hashes of at least ``min_docs`` documents; counts are complete."""
        runs = self._all()
        if not runs:
            return self.spark.createDataFrame([], "hash binary, docs long")
        summed = reduce(DataFrame.unionByName, runs).groupBy("hash").agg(F.sum("docs").alias("docs"))
        return summed.filter(F.col("docs") >= self.min_docs)


def distinct_hashes(lines: DataFrame) -> DataFrame:
    """``hash``: each one once for every row of ``lines(hashes)``, nulls left out. Sorting keeps long texts from being quadratic."""
    ordered = lines.select(F.sort_array("hashes").alias("h"))
    once = F.filter("h", lambda x, i: x.isNotNull() & ((i == 0) | ~x.eqNullSafe(F.get("h", i - 1))))
    return ordered.select(F.explode(once).alias("hash"))


def places(lines: DataFrame, repeated: DataFrame) -> DataFrame:
    """``(digest, places)``: where the repeated lines of every text stand; texts without any are left out.

    ``repeated(hash, docs)`` is broadcast if it is small. Else only hashes of more than one in ``HOT_SHARE`` of all lines
    are, fewer than ``HOT_SHARE`` by arithmetic, and the other lines meet theirs in a shuffle that has no hot key.
    """
    each = lines.select("digest", F.posexplode("hashes").alias("place", "hash")).where("hash is not null")
    if repeated.count() <= FEW_KEYS:
        met = each.join(F.broadcast(repeated.select("hash")), "hash", "left_semi")
    else:
        total = lines.agg(F.coalesce(F.sum(F.size("hashes")), F.lit(0))).first()[0]
        is_hot = F.col("docs") * HOT_SHARE > F.lit(total)
        hot, cold = (F.broadcast(repeated.filter(is_hot).select("hash")), repeated.filter(~is_hot).select("hash"))
        met = each.join(hot, "hash", "left_semi").unionByName(each.join(hot, "hash", "left_anti").join(cold, "hash", "left_semi"))
    return met.groupBy("digest").agg(F.sort_array(F.collect_set("place")).alias("places"))


def without_places(lines: str, places: str) -> Column:
    """The lines that stand at none of the sorted places: the slices between them, so the work is linear."""
    last = F.size(places)
    before = lambda i: F.when(i == 0, F.lit(-1)).otherwise(F.get(places, i - 1))
    after = lambda i: F.when(i == last, F.size(lines)).otherwise(F.get(places, i))
    return F.flatten(F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(lines, before(i) + 2, after(i) - before(i) - 1)))


def drop_repeated_lines(docs: DataFrame, text: str = "text", min_docs: int = 10, min_chars: int = 1, batches: int = BATCHES,
                        fanout: int = FANOUT) -> DataFrame:
    r"""``docs`` without the lines whose key is found in at least ``min_docs`` documents, with ``n_lines`` and ``n_dropped``.

    Texts are split at ``\n``; a null or empty text is one empty line. The key of a line is the line without blanks at both ends, A-Z
    as a-z; keys of fewer than ``min_chars`` characters are never dropped. A row counts once for a key, however often it has the
    line, and repeated rows count each. Lines that stay are joined by ``\n``; a null text becomes the empty text. An empty
    table stays empty. Columns named ``n_lines`` or ``n_dropped`` are replaced, all others are kept.

    ``docs`` is read twice; a text is met again by its digest, so its row needs no key.
    """
    spark = docs.sparkSession
    plain = F.coalesce(F.col(text), F.lit(""))
    path = scratch_path(spark, "lines")
    (docs.select(digest(plain).alias("digest"), line_hashes(F.col(text), min_chars).alias("hashes"),
                 (F.monotonically_increasing_id() % batches).alias("batch")).write.partitionBy("batch").parquet(path))
    lines = spark.read.schema("digest binary, hashes array<binary>, batch int").parquet(path)
    runs = LineRuns(spark, min_docs, fanout)
    for batch in range(batches):
        runs.add(distinct_hashes(lines.filter(F.col("batch") == batch)))
    repeated = materialize(runs.repeated(), "repeated")
    found = materialize(places(lines, repeated), "places")
    return _apply(docs, text, plain, found, lines)


def _apply(docs: DataFrame, text: str, plain: Column, found: DataFrame, lines: DataFrame) -> DataFrame:
    """``docs`` with their lines taken out. Texts with very many copies are met by broadcast, the others in a shuffle."""
    total = lines.count()
    copies = lines.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") * HOT_SHARE > F.lit(total)).select("digest")
    hot = materialize(copies.join(found, "digest", "left"), "hot")  # fewer than HOT_SHARE rows
    d, h, c, key, all_lines = free_names([*docs.columns, "n_lines", "n_dropped"], "digest", "hot", "cold", "key", "lines")
    rows = docs.withColumn(d, digest(plain))
    rows = rows.join(F.broadcast(hot.select(F.col("digest").alias(d), F.struct("places").alias(h))), d, "left")
    # a row that was met already gets a key that nothing has, one of its own
    rows = rows.withColumn(key, F.when(F.col(h).isNull(), F.col(d)).otherwise(F.encode(F.monotonically_increasing_id().cast("string"), "utf-8")))
    rows = rows.join(found.select(F.col("digest").alias(key), F.col("places").alias(c)), key, "left")
    at = F.coalesce(F.col(h)["places"], F.col(c), F.array().cast("array<int>"))
    rows = rows.withColumn(c, at).withColumn(all_lines, split_lines(F.col(text)))
    kept = F.when(F.size(c) == 0, plain).otherwise(F.array_join(without_places(all_lines, c), "\n"))
    counts = {"n_lines": F.size(all_lines).cast("long"), "n_dropped": F.size(c).cast("long")}
    names = [n for n in docs.columns if n not in counts]
    return rows.select(*[kept.alias(text) if n == text else F.col(f"`{n}`") for n in names], *[v.alias(n) for n, v in counts.items()])
