"""Content-addressed web archive: each payload stored once by its digest, record headers kept as they are.

An archive is a folder with two tables: ``payloads`` (digest, payload) and ``headers`` (header, digest). A record is
its header followed by the payload; a revisit record has no block of its own, its full payload is the one it refers to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from limpid.llm.skew import join_groups
from limpid.storage import materialize

#: Equal payloads below this size are stored as responses each, since a revisit record would save nothing.
REVISIT_BYTES = 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _line(name: str, value: Column) -> Column:
    """A header line; nothing where the value is null. Line breaks in a value are escaped."""
    safe = F.replace(F.replace(value.cast("string"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), safe, F.lit("\r\n")), F.lit(""))


def _record_id(key: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(key.cast("string"), F.lit("")), F.lit(">"))


def header(key: Column, url: Column, sha1: Column, size: Column, refers_to: Column) -> Column:
    """The exact bytes before the payload, the empty line included."""
    revisit = refers_to.isNotNull()
    text = F.concat(
        F.lit("WARC/1.1\r\n"), _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", _record_id(key)), _line("WARC-Target-URI", url),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), sha1)),
        _line("WARC-Profile", F.when(revisit, PROFILE)), _line("WARC-Refers-To", F.when(revisit, _record_id(refers_to))),
        _line("Content-Type", F.lit("text/html")), _line("Content-Length", F.when(revisit, 0).otherwise(size)), F.lit("\r\n"))
    return F.encode(text, "UTF-8")


def write_archive(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html") -> None:
    """Writes one record per row. A null payload is empty, a null url leaves its line out.

    Of the rows with equal payloads of at least ``REVISIT_BYTES``, that with the largest key is the response and the
    others refer to it; a repeated row of that key is a response again. Raises if two payloads share a digest.
    """
    body = F.encode(F.coalesce(payload, F.lit("")), "UTF-8")
    source = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), body.alias("payload"))
    digest = F.unhex(F.sha2("payload", 256)).alias("digest")
    source.select(digest, "payload").distinct().write.option("compression", "zstd").parquet(f"{path}/payloads")
    store = pages.sparkSession.read.parquet(f"{path}/payloads")
    if store.groupBy("digest").count().filter("count > 1").limit(1).count():
        raise ValueError("two payloads share a SHA-256 digest")
    facts = materialize(source.select("key", "url", digest, F.sha1("payload").alias("sha1"), F.octet_length("payload").alias("size")), "facts")
    groups = (facts.filter(F.col("size") >= REVISIT_BYTES).groupBy("digest")
              .agg(F.max("key").alias("first"), F.count("*").alias("n")).filter("n > 1"))
    met = join_groups(facts, materialize(groups, "groups"), "digest", "n", facts.count())
    refers = F.when(~F.col("key").eqNullSafe(F.col("first")), F.col("first"))
    met.select(header(F.col("key"), F.col("url"), F.col("sha1"), F.col("size"), refers).alias("header"), "digest").write.parquet(f"{path}/headers")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """The original records: key, url, record_type, refers_to, declared digest, header and the full payload."""
    headers = spark.read.parquet(f"{path}/headers")
    text = F.decode("header", "UTF-8")

    def value(name: str) -> Column:
        found = F.regexp_extract(text, rf"\r\n{name}: ([^\r\n]*)\r\n", 1)
        return F.when(found != "", found)

    def page(name: str) -> Column:
        return F.regexp_extract(value(name), "<urn:page:(-?[0-9]+)>", 1).try_cast("long")

    parsed = headers.select(
        "digest", "header", page("WARC-Record-ID").alias("key"), value("WARC-Target-URI").alias("url"), value("WARC-Type").alias("record_type"),
        page("WARC-Refers-To").alias("refers_to"), F.substring_index(value("WARC-Payload-Digest"), ":", -1).alias("declared"))
    return parsed.join(spark.read.parquet(f"{path}/payloads"), "digest").drop("digest")


def record(header: str = "header", payload: str = "payload", kind: str = "record_type") -> Column:
    """The bytes of a record as they stand in an archive file."""
    block = F.when(F.col(kind) == "revisit", F.lit(b"")).otherwise(F.col(payload))
    return F.concat(F.col(header), block, F.lit(b"\r\n\r\n"))


def export_files(records: DataFrame, path: str) -> None:
    """Archive files, gzipped: every record ends with an empty line pair, which the text writer puts between rows."""
    line = F.concat(F.col("header"), F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.col("payload")))
    records.select(line.cast("string").alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)
