"""Exact duplicates by content-defined chunk recipes, with DataFrame functions only.

A text is cut where its own content says so, each chunk gets a strong digest as its identifier, and the ordered list of
identifiers, the recipe, stands for the text from then on. Texts move neither for grouping nor for choosing; a long
document costs 32 bytes per chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from limpid.llm.skew import join_groups, without
from limpid.operators.cells import free_names
from limpid.storage import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A chunk ends at the first sentence or line end after 256 characters, at 2048 at the latest.
CHUNK = r"(?s).{256,2048}?(?:[.!?]\s|\n|\z)|.{1,2048}"


def normalized(text: str | Column) -> Column:
    """A-Z as a-z and nothing else changed; null as the empty text."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def chunks(text: Column) -> Column:
    """The chunks of a text in order; joined they give the text again. The empty text has none."""
    return F.regexp_extract_all(text, F.lit(CHUNK), F.lit(0))


def recipes(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the text, with ``text_sha256`` and ``chunks``, a list of (id, size, check)."""
    staged = docs.withColumn("_n", normalized(text))
    parts = F.transform(chunks(F.col("_n")), lambda c: F.struct(
        F.unhex(F.sha2(c, 256)).alias("id"), F.octet_length(c).alias("size"), F.xxhash64(c).alias("check")))
    kept = [c for c in docs.columns if c not in (text, "text_sha256", "chunks")]
    return staged.select(*kept, F.sha2("_n", 256).alias("text_sha256"), parts.alias("chunks"))


def verify(rows: DataFrame) -> None:
    """Raises if two different chunks, by size or by a second hash, share an identifier."""
    seen = (rows.select(F.explode("chunks").alias("c")).select("c.*").groupBy("id")
            .agg(F.min("size").alias("a"), F.max("size").alias("b"), F.min("check").alias("c"), F.max("check").alias("d")))
    if seen.filter("a <> b or c <> d").limit(1).count():
        raise ValueError("two chunks share a SHA-256 digest")


def chunk_store(docs: DataFrame, text: str = "text") -> DataFrame:
    """Each distinct chunk once: ``id``, ``chunk`` and ``n``, its number of occurrences."""
    cut = docs.select(F.explode(chunks(normalized(text))).alias("chunk"))
    return cut.groupBy(F.unhex(F.sha2("chunk", 256)).alias("id"), "chunk").agg(F.count("*").alias("n"))


def exact_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, keep_id, group_size, kept and text_sha256.

    Texts are equal when they are identical after lower-casing A-Z; null counts as empty. Of equal texts the largest
    key stays; if a row repeats with its key, each repeat is marked as kept. Rows without a key are counted, but stay
    only where no row of the group has a key. An empty table gives an empty result; other columns are left out.
    """
    listed = materialize(recipes(docs.select(key, text), text), "recipes")
    verify(listed)
    rows = listed.select(F.col(key), "text_sha256", F.aggregate(
        F.transform("chunks", lambda c: c["id"]), F.unhex(F.lit("")), lambda a, b: F.concat(a, b)).alias("recipe"))
    groups = (rows.groupBy("recipe").agg(F.max(key).alias("keep_id"), F.count("*").alias("group_size"))
              .filter("group_size > 1"))
    met = join_groups(rows, materialize(groups, "groups"), "recipe", "group_size", listed.count())
    keep = F.when(F.col("group_size").isNull(), F.col(key)).otherwise(F.col("keep_id"))
    return met.select(key, keep.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
                      F.col(key).eqNullSafe(keep).alias("kept"), "text_sha256")


def drop_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows that are not kept; rows without a key stay."""
    lost_key, lost_sha = free_names(docs.columns, "key", "sha")
    lost = exact_duplicates(docs, key, text).filter("not kept").select(F.col(key).alias(lost_key), F.col("text_sha256").alias(lost_sha))
    match = (F.col(key) == F.col(lost_key)) & (F.sha2(normalized(text), 256) == F.col(lost_sha))
    return without(docs, materialize(lost, "lost"), match)
