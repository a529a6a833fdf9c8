"""Bottom-k fingerprints: the smallest hashes of a text's word shingles.

A fingerprint is the ascending list of the ``SIZE`` smallest 32-bit hashes of the distinct five-word shingles, as hex
text. One that is shorter holds all of them and is exact. Fingerprints of parts merge into that of the whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from limpid.llm.words import SLICE_BYTES, Words, parts

SIZE = 128
WIDTH = 5
RANGE = 2.0 ** 32


def sketches(texts: pa.Array) -> list[np.ndarray]:
    """The fingerprint of each text; null and wordless texts have an empty one."""
    hashes, of = Words(texts).shingles(WIDTH)
    top = (hashes >> np.uint64(32)).astype(np.uint32)
    return [np.unique(top[a:b])[:SIZE] for a, b in zip(of[:-1].tolist(), of[1:].tolist())]


def to_text(sketch: np.ndarray) -> str:
    return sketch.astype(">u4").tobytes().hex()


def from_text(text: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(text), ">u4").astype(np.uint32)


def merge(*sketches: np.ndarray) -> np.ndarray:
    """The fingerprint of the union."""
    return np.unique(np.concatenate(sketches))[:SIZE]


def distinct(sketch: np.ndarray) -> float:
    """Estimated number of distinct shingles; exact below ``SIZE``."""
    return float(len(sketch)) if len(sketch) < SIZE else (SIZE - 1) * RANGE / (float(sketch[-1]) + 1)


def resemblance(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated shared part of the union, 0 to 1; 1 for two empty fingerprints."""
    both = merge(a, b)
    if not len(both):
        return 1.0
    shared = np.intersect1d(a, b, assume_unique=True)
    return float(np.isin(both, shared, assume_unique=True).sum()) / len(both)


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated part of ``a`` that ``b`` has, 0 to 1; 1 where ``a`` is empty."""
    if not len(a):
        return 1.0
    r = resemblance(a, b)
    return min(1.0, r / (1 + r) * (distinct(a) + distinct(b)) / distinct(a))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``fingerprint`` and ``n_distinct`` of every row, repeats and null keys included."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches):
            found = sketches(part.column("text"))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([to_text(x) for x in found]), pa.array([distinct(x) for x in found], pa.float64())],
                                             ["doc_id", "fingerprint", "n_distinct"])
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, fingerprint string, n_distinct double")


def merged(rows: DataFrame, by: str, fingerprint: str = "fingerprint") -> DataFrame:
    """One fingerprint per value of ``by``: that of all its parts. A group sends at most ``SIZE`` hashes per task."""
    step = SIZE * 8
    hashes = rows.select(by, F.explode(F.sequence(F.lit(0), F.lit(step - 8), F.lit(8))).alias("at"), F.col(fingerprint).alias("all"))
    hashes = hashes.select(by, F.expr("substring(all, at + 1, 8)").alias("h")).filter("h <> ''").distinct()
    low = hashes.withColumn("n", F.row_number().over(Window.partitionBy(by).orderBy("h"))).filter(F.col("n") <= SIZE)
    return low.groupBy(by).agg(F.concat_ws("", F.sort_array(F.collect_list("h"))).alias("fingerprint"))


def with_neighbours(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every text beside an edited one: its last third replaced by as many first characters of the next document.

    Documents follow each other in descending key order, the first after the last; null keys come last and rows with
    equal keys are ordered by a hash of the text. Result: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited and near_next (resemblance of the text to the edited text and to the next document). A null text is empty.

    Keys are cut into ranges. Each range goes to one task in order, with one further row, the first of the range that
    follows; texts are shuffled once. Range limits are one number per shuffle partition.
    """
    spark = docs.sparkSession
    lowest = -(1 << 63)
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(lowest)).alias("id"), F.coalesce(text, F.lit("")).alias("text"))
    ranges = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = rows.agg(F.percentile_approx("id", [i / ranges for i in range(1, ranges)], 100 * ranges)).first()[0]
    limits = np.unique(np.array(cuts or [], np.int64))

    @F.pandas_udf("int")
    def own(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(limits, ids.to_numpy(np.int64), "right").astype(np.int32))

    # At most one row per range: where each range begins, and which range needs that row besides.
    tops = sorted((r["range"], r["top"]) for r in rows.select("id", own("id").alias("range")).groupBy("range").agg(F.max("id").alias("top")).collect())
    lent = {top: tops[(i + 1) % len(tops)][0] for i, (_, top) in enumerate(tops)}
    lent_ids = np.array(sorted(lent), np.int64)
    lent_to = np.array([lent[x] for x in lent_ids.tolist()], np.int64)

    @F.pandas_udf("array<int>")
    def all_ranges(ids: pd.Series) -> pd.Series:
        values = ids.to_numpy(np.int64)
        mine = np.searchsorted(limits, values, "right")
        at = np.minimum(np.searchsorted(lent_ids, values), len(lent_ids) - 1)
        is_lent = lent_ids[at] == values
        return pd.Series([[a, b] if c else [a] for a, b, c in zip(mine.tolist(), lent_to[at].tolist(), is_lent.tolist())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk: list[tuple[int, str]] = []
        size, current, done = 0, None, False

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            """All rows but the last, which only follows; of the last chunk of a range it is the lent row."""
            nonlocal chunk, size
            if len(chunk) > 1:
                yield compared(chunk)
            chunk = [] if last else chunk[-1:]
            size = sum(len(t) for _, t in chunk)

        for batch in batches:
            for rng, guest, i, t in zip(*(batch.column(c).to_pylist() for c in ("range", "guest", "id")), batch.column("text")):
                if rng != current:
                    yield from flush(True)
                    current, done = rng, False
                if done:
                    continue
                done = bool(guest)  # of rows with the same key, the first follows
                text = t.as_py()
                chunk.append((i, text))
                size += len(text)
                if size > SLICE_BYTES // 2 or done:
                    yield from flush(done)
        yield from flush(True)

    dealt = (rows.select("id", "text", F.posexplode(all_ranges("id")).alias("guest", "range")).withColumn("tie", F.xxhash64("text"))
             .repartition("range").sortWithinPartitions("range", "guest", F.col("id").desc(), "tie").select("range", "guest", "id", "text"))
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.mapInArrow(run, schema).withColumn("doc_id", F.when(F.col("doc_id") != lowest, F.col("doc_id")))


def compared(chunk: list[tuple[int, str]]) -> pa.RecordBatch:
    """Rows of ``with_neighbours`` for all of a run of (key, text) but its last."""
    texts = [t for _, t in chunk]
    edited = [(a[:len(a) - len(a) // 3] + b[:len(a) // 3]).encode() for a, b in zip(texts, texts[1:])]
    plain, changed = sketches(pa.array(texts)), sketches(pa.array(edited, pa.binary()).cast(pa.string()))
    return pa.RecordBatch.from_pydict({
        "doc_id": pa.array([i for i, _ in chunk[:-1]], pa.int64()), "n_chars": [len(t) for t in texts[:-1]],
        "edited_sha256": [hashlib.sha256(x).hexdigest() for x in edited],
        "fingerprint": [to_text(x) for x in plain[:-1]], "edited_fingerprint": [to_text(x) for x in changed],
        "near_edited": [resemblance(a, b) for a, b in zip(plain, changed)],
        "near_next": [resemblance(a, b) for a, b in zip(plain, plain[1:])]})
