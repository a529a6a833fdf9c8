import collections
import hashlib
import math
import re
import zlib

import pytest
from pyspark.sql import functions as F
from test_words import lower

from limpid.llm import dedup, lines, manifest, resample

BLANKS = " \t\n\x0b\x0c\r"


def rows_of(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---- resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def grams(text, sizes):
    words = WORD.findall(lower(text))
    return words, [" ".join(words[i:i + n]) for n in range(sizes[0], sizes[1] + 1) for i in range(len(words) - n + 1)]


def expected_ranks(docs, target, sizes, buckets, min_words, percent):
    found = [(k, *grams(t, sizes)) for k, t in docs]
    ids = [[zlib.crc32(g.encode()) % buckets for g in gs] for _, _, gs in found]
    s = collections.Counter(i for x in ids for i in x)
    t = collections.Counter(zlib.crc32(g.encode()) % buckets for x in target for g in grams(x, sizes)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = {i: math.floor(1000 * math.log(((t[i] + 1) * (S + buckets)) / ((s[i] + 1) * (T + buckets)))) for i in s}
    out = []
    for (k, words, gs), x in zip(found, ids):
        h = int(sha(f"2024:{'' if k is None else k}")[:8], 16)
        weight = sum(gain[i] for i in x)
        out.append([k, len(gs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words) >= min_words])
    fit = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0]))
    ranks = {id(r): i + 1 for i, r in enumerate(fit[:percent * len(fit) // 100])}
    return sorted(((r[0], r[1], r[2], r[3], ranks.get(id(r))) for r in out), key=repr)


@pytest.mark.parametrize("sizes,buckets", [((1, 1), 10_000), ((1, 3), 97), ((2, 2), 70_000)])
def test_ranks_are_those_of_a_plain_computation(spark, odd, texts, sizes, buckets):
    target = spark.createDataFrame([(i, t) for i, t in enumerate(texts[5:30])], "item_id long, text string")
    got = resample.resample(odd, target, sizes=sizes, buckets=buckets, min_words=5, percent=40)
    want = expected_ranks([(r["doc_id"], r["text"]) for r in odd.collect()], texts[5:30], sizes, buckets, 5, 40)
    assert [(a[:4], a[4] is None) for a in rows_of(got, "doc_id", "n_features", "weight", "score", "rank")] == [(b[:4], b[4] is None) for b in want]
    assert sorted(r["rank"] for r in got.filter("rank is not null").collect()) == list(range(1, 1 + sum(b[4] is not None for b in want)))


def test_ties_go_to_the_smaller_key(spark):
    docs = spark.createDataFrame([(i, "a b c d") for i in range(50)], "doc_id long, text string")
    got = resample.resample(docs, docs.select("text"), min_words=1, percent=50).filter("rank is not null").orderBy("rank").collect()
    assert [(-r["score"], r["doc_id"]) for r in got] == sorted((-r["score"], r["doc_id"]) for r in got) and len(got) == 25


def test_resampling_of_nothing_and_towards_nothing(spark, docs, none):
    assert resample.resample(none, docs).collect() == []
    assert {r["rank"] for r in resample.resample(docs, none, min_words=10**9).collect()} == {None}
    left = resample.drawn(docs, resample.resample(docs, docs, min_words=1, percent=50))
    assert left.columns == docs.columns and 0 < left.count() < docs.count()


def test_spans_are_those_of_the_collapsed_text():
    plain, found = resample.spans("One-two  THREE\té4", (1, 2))
    assert [plain[a:b].decode() for a, b in found] == ["one", "two", "three", "é4", "one two", "two three", "three é4"]
    assert resample.spans(None)[1] == resample.spans(" .. ")[1] == []
    assert len(resample.spans("ab " * 200_000, (2, 2))[1]) == 199_999


# ---- repeated lines

def expected_lines(rows, min_docs, min_chars):
    key = lambda line: lower(line.strip(BLANKS))
    split = [(k, (t or "").split("\n")) for k, t in rows]
    n = collections.Counter(x for _, ls in split for x in {key(line) for line in ls} if len(x) >= min_chars)
    out = []
    for k, ls in split:
        kept = [line for line in ls if n[key(line)] < min_docs]
        out.append((k, len(ls), len(ls) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def pages(spark, texts):
    """Texts with lines of many degrees of repetition, in other case and with blanks around them; repeated rows and copies."""
    rows = []
    for i, t in enumerate(texts):
        extra = [f"  Line {j}\t" if i % 2 else f"LINE {j}" for j in range(14) if i % (j + 1) == 0]
        rows.append((i if i % 11 else None, "\n".join([*extra, t or "", *extra[:1], "", " "]) if t is not None else None, 1, "x"))
    rows += rows[:3] + [(1000 + i, "the same\nfor all", 2, "y") for i in range(40)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_lines long, digest string")


@pytest.mark.parametrize("min_docs,min_chars,batches,fanout", [(10, 1, 4, 3), (3, 1, 7, 2), (2, 6, 1, 3), (1, 1, 2, 2)])
def test_lines_that_many_documents_share(pages, min_docs, min_chars, batches, fanout):
    got = lines.drop_repeated_lines(pages, min_docs=min_docs, min_chars=min_chars, batches=batches, fanout=fanout)
    assert set(got.columns) == {"doc_id", "text", "digest", "n_lines", "n_dropped"}
    want = expected_lines([(r["doc_id"], r["text"]) for r in pages.collect()], min_docs, min_chars)
    assert rows_of(got, "doc_id", "n_lines", "n_dropped", "text") == want


def test_many_repeated_lines_are_met_in_a_shuffle(pages, monkeypatch):
    want = expected_lines([(r["doc_id"], r["text"]) for r in pages.collect()], 3, 1)
    monkeypatch.setattr(lines, "FEW_KEYS", 0)
    for share in (1000, 20):  # no hot line or text, and some
        monkeypatch.setattr(lines, "HOT_SHARE", share)
        assert rows_of(lines.drop_repeated_lines(pages, min_docs=3), "doc_id", "n_lines", "n_dropped", "text") == want


def test_runs_count_every_batch_and_know_what_they_have_seen(spark):
    runs, want = lines.LineRuns(spark, min_docs=4, fanout=2), collections.Counter()
    for batch in range(7):
        values = [f"{i % (batch + 2)}" for i in range(9)]
        want.update(values)
        runs.add(spark.createDataFrame([(v,) for v in values], "v string").select(F.encode("v", "utf-8").alias("hash")))
    assert {bytes(r["hash"]).decode(): r["docs"] for r in runs.repeated().collect()} == {k: n for k, n in want.items() if n >= 4}
    assert len(runs.levels) > 2 and runs.known_runs and all(len(level) < 2 for level in runs.levels)
    new = runs.unseen(spark.createDataFrame([("1",), ("99",), ("99",)], "v string").select(F.encode("v", "utf-8").alias("hash")))
    assert [bytes(r["hash"]) for r in new.collect()] == [b"99"]


def test_one_long_text_and_no_texts(spark, none):
    text = "\n".join(f"line {i % 40_000}" for i in range(200_000))
    docs = spark.createDataFrame([(1, text), (2, "line 7"), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"]) for r in lines.drop_repeated_lines(docs, min_docs=2).collect()}
    assert got == {1: (200_000, 5), 2: (1, 1), 3: (1, 0)}
    assert lines.drop_repeated_lines(none).collect() == []


def test_line_operator_uses_no_python_workers(pages):
    plan = lines.drop_repeated_lines(pages)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# ---- Merkle manifest

def expected_manifest(rows, fanout, changed=lambda r: r):
    def leaf(r):
        return sha("".join("-" if r[f] is None else f"{len(str(r[f]).encode())}:{r[f]}" for f in manifest.FIELDS))

    def climb(nodes, starts):
        """(top, per node: siblings left to right, folded digest)."""
        proofs, now, at = [""] * len(nodes), list(starts), list(range(len(nodes)))
        while len(nodes) > 1:
            for k, i in enumerate(at):
                a = i // fanout * fanout
                left, right = "".join(nodes[a:i]), "".join(nodes[i + 1:a + fanout])
                proofs[k] += left + right
                now[k] = sha(left + now[k] + right)
            nodes = [sha("".join(nodes[j:j + fanout])) for j in range(0, len(nodes), fanout)]
            at = [i // fanout for i in at]
        return nodes[0], proofs, now

    groups = {}
    for r in rows:
        groups.setdefault(b"" if r["source"] is None else b"=" + r["source"].encode(), []).append(r)
    found, subroots = [], []
    for g in sorted(groups):
        mine = sorted(groups[g], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        top, proofs, now = climb([leaf(r) for r in mine], [leaf(changed(r)) for r in mine])
        subroots.append(top)
        found.append((mine, top, proofs, now))
    out, (root, above, _) = [], climb(subroots, subroots)
    for j, (mine, top, proofs, now) in enumerate(found):
        for r, p, n in zip(mine, proofs, now):
            end = climb(subroots, [n if i == j else s for i, s in enumerate(subroots)])[2][j]
            out.append((r["doc_id"], leaf(r), top, root, sha(p + above[j]), end, end == root))
    return sorted(out, key=repr)


def check_manifest(df, fanout):
    tampered = F.when(F.col("doc_id") % 3 == 0, F.lower("text")).otherwise(F.col("text"))
    got = manifest.manifest(df, fanout=fanout, changed={"text": tampered})
    proof = F.sha2(F.array_join(F.transform("proof", lambda p: F.concat(p["left"], p["right"])), ""), 256)
    got = got.withColumn("p", proof)
    rows = [r.asDict() for r in df.collect()]
    change = lambda r: r | {"text": r["text"].lower()} if r["text"] is not None and r["doc_id"] is not None and r["doc_id"] % 3 == 0 else r
    assert rows_of(got, "doc_id", "leaf", "subroot", "root", "p", "folded_root", "verified") == expected_manifest(rows, fanout, change)


@pytest.mark.parametrize("fanout", [2, 3, 16])
def test_manifest_of_several_sources(docs, odd, fanout):
    check_manifest(docs.filter("source = 's1' or text is null or doc_id < 100"), fanout)
    if fanout == 3:
        check_manifest(odd, fanout)


def test_manifest_of_one_leaf_one_source_and_many_sources(spark, none):
    schema = "doc_id long, text string, lang string, source string, n_chars long, rank long, `group` string"
    check_manifest(spark.createDataFrame([(6, "Ab", None, "s", 2, 1, "g")], schema), 16)
    check_manifest(spark.createDataFrame([(i, f"T{i}", "en", "s", 2, 1, "g") for i in range(17)], schema), 16)
    check_manifest(spark.createDataFrame([(i, "T", "en", f"é{i}" if i else None, 2, 1, "g") for i in range(40)], schema), 4)
    assert manifest.manifest(none).collect() == []


def test_a_source_of_many_ranges(spark, monkeypatch):
    from limpid.operators import ranking
    monkeypatch.setattr(ranking, "RANGE_ROWS", 50)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    check_manifest(spark.createDataFrame([(i, f"T{i % 9}", "en", "big" if i % 5 else f"s{i % 4}", i) for i in range(900)], schema), 16)


# ---- columns with names that the exact stage uses itself

def test_dropping_copies_of_a_table_with_any_columns(spark):
    docs = spark.createDataFrame([(1, "a", 1, 1, 1), (2, "A", 2, 2, 2), (3, "b", 3, 3, 3)], "doc_id long, text string, _key long, _sha long, __key long")
    left = dedup.drop_duplicates(docs)
    assert left.columns == docs.columns and sorted(r["doc_id"] for r in left.collect()) == [2, 3]
