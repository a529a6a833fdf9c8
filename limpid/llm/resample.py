r"""Importance resampling towards a target distribution, on hashed n-grams.

Texts are lower-cased (A-Z), every run of separators becomes one space, and an overlapped regular expression with
boundary lookarounds gives the span of every n-gram; the CRC-32 of its bytes is its bucket. The gain of a bucket is the log
ratio of its share in the target to its share in the corpus; documents with the largest sums of gains plus Gumbel noise
are drawn, which is a draw without replacement by importance.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F

from limpid.llm.words import parts
from limpid.operators.ranking import with_row_number
from limpid.storage import materialize

#: Bytes that part words: all of ASCII but digits and letters. Bytes of other characters are parts of words.
SPACED = bytes(c if c >= 0x80 or chr(c).isalnum() else 32 for c in range(256))


def collapsed(text: str | None) -> bytes:
    """The text in UTF-8 with A-Z as a-z, its words parted, begun and ended by one space each."""
    return b" " + b" ".join((text or "").encode().lower().translate(SPACED).split()) + b" "


def ngram_pattern(n: int) -> regex.Pattern:
    """A space and ``n`` words as group 1, up to where a space follows.

    The space before is matched as a character, as the search for it is twice as fast as a lookbehind; the one behind is
    looked at only. Overlapped matches begin at every word.
    """
    return regex.compile(rb" ([^ ]++" + rb" [^ ]++" * (n - 1) + rb")(?= )")


def spans(text: str | None, sizes: tuple[int, int] = (1, 1)) -> tuple[bytes, list[tuple[int, int]]]:
    """The collapsed text and the spans of all n-grams in it, sizes from the first to the second."""
    plain = collapsed(text)
    return plain, [m.span(1) for n in range(sizes[0], sizes[1] + 1) for m in ngram_pattern(n).finditer(plain, overlapped=True)]


def features(docs: DataFrame, key: str | None, text: str = "text", sizes: tuple[int, int] = (1, 1), buckets: int = 10_000) -> DataFrame:
    """``key``, ``n_words``, ``n_features`` and ``ids``, the buckets of all n-grams as little-endian unsigned integers.

    Every text is scanned once. A null text has no words; a word list shorter than n has no n-gram of that size.
    """
    patterns = [ngram_pattern(n) for n in range(sizes[0], sizes[1] + 1)]
    width = id_type(buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crc = zlib.crc32
        for batch in parts(batches):
            words, counts, ids = [], [], []
            for value in batch.column("text"):
                plain = collapsed(value.as_py())
                found = [crc(m.group(1)) for p in patterns for m in p.finditer(plain, overlapped=True)]
                words.append(max(plain.count(b" ") - 1, 0))
                counts.append(len(found))
                ids.append((np.array(found, np.int64) % buckets).astype(width).tobytes())
            yield pa.RecordBatch.from_pydict({"key": batch.column("key"), "n_words": pa.array(words, pa.int64()),
                                              "n_features": pa.array(counts, pa.int64()), "ids": pa.array(ids, pa.binary())})

    keys = F.lit(None).cast("long") if key is None else F.col(key)
    rows = docs.select(keys.alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, n_words long, n_features long, ids binary")


def id_type(buckets: int) -> str:
    if not 0 < buckets <= 1 << 24:
        raise ValueError("between 1 and 2**24 buckets, of which every task holds one count each")
    return "<u2" if buckets <= 1 << 16 else "<u4"


def bucket_counts(found: DataFrame, buckets: int = 10_000) -> DataFrame:
    """``(bucket, n)`` of all features; each task sends one row per bucket that it met."""
    width = id_type(buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch.column("ids").to_pylist()), width), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(at, pa.int64()), "n": pa.array(total[at], pa.int64())})

    return found.select("ids").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = 10_000) -> DataFrame:
    """``(bucket, gain)`` of every bucket: floor(1000 ln) of the ratio of its smoothed shares in target and corpus."""
    s, t = (c.withColumnRenamed("n", n) for c, n in ((corpus, "s"), (target, "t")))
    all_s, all_t = ((c.agg(F.sum(n)).first()[0] or 0) for c, n in ((s, "s"), (t, "t")))
    real = {c: F.coalesce(F.col(c), F.lit(0)).cast("double") for c in ("s", "t")}
    ratio = ((real["t"] + 1.0) * F.lit(float(all_s + buckets))) / ((real["s"] + 1.0) * F.lit(float(all_t + buckets)))
    every = corpus.sparkSession.range(buckets).withColumnRenamed("id", "bucket")
    return every.join(s, "bucket", "left").join(t, "bucket", "left").select("bucket", F.floor(F.lit(1000.0) * F.ln(ratio)).alias("gain"))


def weights(found: DataFrame, gain: np.ndarray, buckets: int = 10_000) -> DataFrame:
    """``key``, ``n_words``, ``n_features`` and ``weight``, the sum of the gains of all features of a document."""
    width = id_type(buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [int(gain[np.frombuffer(ids, width)].sum()) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in ("key", "n_words", "n_features")} | {"weight": pa.array(sums, pa.int64())})

    kind = found.schema["key"].dataType.simpleString()
    return found.mapInArrow(run, f"key {kind}, n_words long, n_features long, weight long")


def gumbel(key: str | Column, seed: str = "2024") -> Column:
    """floor(1000 x) of a Gumbel draw x that depends on seed and key only; a null key counts as the empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 10, min_words: int = 20,
             sizes: tuple[int, int] = (1, 1), buckets: int = 10_000, seed: str = "2024") -> DataFrame:
    """One row per row of ``docs``: key, n_features, weight, score and rank.

    ``target`` is a table with the same text column. Of the N documents of at least ``min_words`` words the
    floor(``percent`` N / 100) largest scores are drawn; ``rank`` counts them from 1, ties to the smaller key and null keys last,
    and is null for the others. Repeated rows are drawn or left each for itself. A null or empty text has no features,
    weight 0 and is never drawn; no documents give no rows, and an empty target gives every bucket its smoothed share.
    Other columns are left out, whatever their names.
    """
    found = materialize(features(docs, key, text, sizes, buckets), "features")
    wanted = features(target, None, text, sizes, buckets)
    counted = [materialize(bucket_counts(x, buckets), "buckets") for x in (found, wanted)]
    table = gains(*counted, buckets)
    gain = np.zeros(buckets, np.int64)
    for row in table.collect():  # one row per bucket, which is a parameter
        gain[row["bucket"]] = row["gain"]
    scored = weights(found, gain, buckets).withColumn("score", F.col("weight") + gumbel("key", seed)).withColumn("fits", F.col("n_words") >= min_words)
    scored = materialize(scored, "scores")
    drawn = percent * scored.filter("fits").count() // 100
    order = [F.desc("fits"), F.desc("score"), F.asc_nulls_last("key")]
    placed = with_row_number(scored, order)
    return placed.select(F.col("key").alias(key), "n_features", "weight", "score", F.when(F.col("row") < drawn, F.col("row") + 1).alias("rank"))


def drawn(docs: DataFrame, ranked: DataFrame, key: str = "doc_id") -> DataFrame:
    """The documents whose key was drawn, with all their columns; rows that share a key share its fate."""
    return docs.join(ranked.filter("rank is not null").select(key).distinct(), key, "left_semi").select(*docs.columns)
