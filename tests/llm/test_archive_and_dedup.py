import gzip
import hashlib
import os
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F
from test_words import lower

from limpid.llm import dedup, token_ids, warc
from limpid.storage import scratch_path

BPE = public_tokenizers.path("word_bpe_49k.json")


# ---- exact duplicates

def expected_groups(rows):
    groups = {}
    for r in rows:
        groups.setdefault(lower(r["text"]), []).append(r["doc_id"])
    return groups


def check_groups(table):
    rows = table.select("doc_id", "text").collect()
    groups = expected_groups(rows)
    got = sorted((tuple(r) for r in dedup.exact_duplicates(table).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=repr)
    want = []
    for r in rows:
        ids = groups[lower(r["text"])]
        keep = max((i for i in ids if i is not None), default=None)
        want.append((r["doc_id"], keep, len(ids), r["doc_id"] == keep, hashlib.sha256(lower(r["text"]).encode()).hexdigest()))
    assert got == sorted(want, key=repr)


def test_exact_duplicates(docs, odd):
    check_groups(docs)
    check_groups(odd)


def test_one_large_group(spark):
    rows = [(i, "Same Text." if i % 3 else f"text {i // 6}") for i in range(3000)]
    check_groups(spark.createDataFrame(rows, "doc_id long, text string"))


def test_no_documents(none):
    assert dedup.exact_duplicates(none).collect() == [] and dedup.drop_duplicates(none).collect() == []


def test_dropping_keeps_all_columns(docs):
    left = dedup.drop_duplicates(docs)
    assert left.columns == docs.columns
    keep = {max(ids) for ids in expected_groups(docs.collect()).values()}
    assert sorted(r["doc_id"] for r in left.collect()) == sorted(keep)


def test_chunks_join_to_the_text(docs):
    n = dedup.normalized("text")
    parts = docs.select(n.alias("n"), dedup.chunks(n).alias("c")).collect()
    assert all("".join(r["c"]) == r["n"] and all(len(c) <= 2048 for c in r["c"]) for r in parts)
    store = {bytes(r["id"]): r["chunk"] for r in dedup.chunk_store(docs).collect()}
    recipes = dedup.recipes(docs.select("doc_id", "text")).collect()
    text = {r["doc_id"]: lower(r["text"]) for r in docs.collect()}
    assert all("".join(store[bytes(c["id"])] for c in r["chunks"]) == text[r["doc_id"]] for r in recipes)


def test_an_edit_changes_few_chunks(spark):
    import random
    r = random.Random(2)
    text = " ".join("".join(r.choice("abcdef") for _ in range(5)) + (". " if r.random() < 0.1 else "") for _ in range(4000))
    rows = spark.createDataFrame([(1, text), (2, text[:9000] + "X" + text[9000:])], "doc_id long, text string")
    a, b = ([bytes(c["id"]) for c in x["chunks"]] for x in dedup.recipes(rows).orderBy("doc_id").collect())
    assert len(set(a) ^ set(b)) <= 4 < len(a)


# ---- archive

def make_pages(spark):
    big = "<p>" + "é" * 600 + "</p>"
    rows = [(1, "http://a/1", big), (2, "http://a/2\r\nX: y", big), (3, None, big), (4, "http://b", "small"), (5, "http://c", "small"), (6, "http://d", None),
            (7, "http://e", ""), (8, "http://f", "x\r\n\r\nWARC/1.1\r\nWARC-Type: revisit\r\n\r\n" + "z" * 1000), (None, "http://g", "y" * 2000), (9, "", "y" * 2000)]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_archive_gives_records_back(spark):
    pages = make_pages(spark)
    path = scratch_path(spark, "archive")
    warc.write_archive(pages, path)
    got = {r["key"]: r for r in warc.read_archive(spark, path).collect()}
    assert len(got) == pages.count()
    for r in pages.collect():
        g, body = got[r["page_id"]], (r["html"] or "").encode()
        assert bytes(g["payload"]) == body and g["declared"] == hashlib.sha1(body).hexdigest()
    kinds = {k: (g["record_type"], g["refers_to"]) for k, g in got.items()}
    assert kinds[1] == kinds[2] == ("revisit", 3) and kinds[3] == ("response", None)
    assert kinds[4] == kinds[5] == kinds[6] == kinds[7] == kinds[8] == ("response", None)
    assert kinds[None] == ("revisit", 9) and kinds[9] == ("response", None)
    assert spark.read.parquet(f"{path}/payloads").count() == 5  # each payload once


def test_exported_files_are_archives(spark):
    path = scratch_path(spark, "archive")
    warc.write_archive(make_pages(spark), path)
    records = warc.read_archive(spark, path)
    out = scratch_path(spark, "files")
    warc.export_files(records, out)
    want = sorted(bytes(r["r"]) for r in records.select(warc.record().alias("r")).collect())
    found = []
    for name in os.listdir(out):
        if name.endswith(".gz"):
            data = gzip.open(f"{out}/{name}").read()
            while data:  # by the declared length of each record
                head = data.index(b"\r\n\r\n") + 4
                size = int(next(x for x in data[:head].split(b"\r\n") if x.startswith(b"Content-Length: "))[16:])
                found.append(data[:head + size + 4])
                data = data[head + size + 4:]
    assert sorted(found) == want


def test_empty_archive(spark):
    path = scratch_path(spark, "archive")
    warc.write_archive(make_pages(spark).limit(0), path)
    assert warc.read_archive(spark, path).collect() == []


# ---- token ids

def test_boundaries_give_every_value():
    r = np.random.default_rng(4)
    for values in ([], [0], [5], [0, 0, 0], np.cumsum(r.integers(0, 3000, 5000)), np.cumsum(r.integers(0, 2, 3000)), [0] * 10 + [1 << 33]):
        b, used = token_ids.Boundaries.from_bytes(memoryview(token_ids.Boundaries.build(np.array(values, np.int64)).to_bytes()))
        assert b.select(np.arange(len(values))).tolist() == list(values)
        some = r.integers(0, len(values), 20) if len(values) else []
        assert b.select(some).tolist() == [values[i] for i in some]
    dense = token_ids.Boundaries.build(np.cumsum(r.integers(200, 800, 20000)))
    assert len(dense.to_bytes()) * 8 / 20000 < 13  # near two bits and the logarithm of the mean gap


def test_ids_are_those_of_the_library(spark, docs, odd, none):
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(BPE)
    for table in (docs, odd):
        path = scratch_path(spark, "ids")
        token_ids.write_ids(table, path, BPE, 2)
        got = sorted(token_ids.read_ids(spark, path).collect(), key=lambda r: r["start"])
        assert [r["start"] for r in got] == [sum(x["n_tokens"] for x in got[:i]) for i in range(len(got))]
        keys = [-1 if r["doc_id"] is None else r["doc_id"] for r in got]
        assert keys == sorted(keys) and len(got) == table.count()
        want = sorted((str(r["doc_id"]), zlib.crc32(np.array(library.encode(r["text"] or "", add_special_tokens=False).ids + [2], "<u4"))) for r in table.collect())
        assert sorted((str(r["doc_id"]), r["ids_crc32"]) for r in got) == want
    path = scratch_path(spark, "ids")
    token_ids.write_ids(none, path, BPE, 2)
    assert token_ids.read_ids(spark, path).collect() == []


def test_memory_of_words_is_bounded(texts, monkeypatch):
    monkeypatch.setattr(token_ids, "MEMORY_WORDS", 5)
    encode = token_ids.WordEncoder(BPE)
    first = [x.tolist() for x in encode(pa.array(texts))]
    assert [x.tolist() for x in encode(pa.array(texts))] == first
