import re

import numpy as np
import pyarrow as pa
import pytest

from limpid.llm import fingerprint
from limpid.llm.words import SLICE_BYTES, Words, slices

WORD = re.compile("[^\x20\x09-\x0d]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def plain_words(text):
    return WORD.findall(lower(text))


def plain_shingles(text):
    w = plain_words(text)
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_words_are_those_of_the_pattern(texts):
    w = Words(pa.array(texts))
    found = w.strings(np.arange(len(w))).to_pylist()
    assert [found[a:b] for a, b in zip(w.of, w.of[1:])] == [plain_words(t) for t in texts]
    part = pa.array(["skipped here"] + texts).slice(1)
    assert len(Words(part)) == len(w) and (Words(part).hashes() == w.hashes()).all()


def test_equal_words_share_a_code(texts):
    w = Words(pa.array(texts))
    codes, at = w.distinct()
    words = [x for t in texts for x in plain_words(t)]
    assert len(set(words)) == len(at)
    assert [words[i] for i in at] == w.strings(at).to_pylist()
    assert all(words[at[c]] == x for c, x in zip(codes, words))


def test_shingles_are_distinct_like_those_of_words(texts):
    hashes, of = Words(pa.array(texts)).shingles()
    assert [len(set(hashes[a:b].tolist())) for a, b in zip(of, of[1:])] == [len(plain_shingles(t)) for t in texts]
    seen = {}
    for t, a, b in zip(texts, of, of[1:]):
        w = plain_words(t)
        runs = [tuple(w[i:i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else []
        for run, h in zip(runs, hashes[a:b].tolist()):
            assert seen.setdefault(h, run) == run


def test_slices_are_bounded():
    texts = pa.array(["a" * (SLICE_BYTES // 3)] * 7 + [None, "", "b" * (2 * SLICE_BYTES), "c"])
    cut = list(slices(texts))
    assert [a for a, _ in cut] == [0] + [b for _, b in cut[:-1]] and cut[-1][1] == len(texts)
    assert list(slices(pa.array([], pa.string()))) == [] and list(slices(pa.array([None, None], pa.string()))) == [(0, 2)]


@pytest.fixture(scope="module")
def followed(docs):
    return {r["doc_id"]: r for r in fingerprint.with_neighbours(docs).collect()}


def test_neighbours_match_brute_force(docs, followed):
    import hashlib
    rows = sorted(((r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()), reverse=True)
    assert len(followed) == len(rows)
    for (i, t), (_, after) in zip(rows, rows[1:] + rows[:1]):
        n = len(t) // 3
        edited = t[:len(t) - n] + after[:n]
        r = followed[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        for name, other in (("near_edited", edited), ("near_next", after)):
            a, b = plain_shingles(t), plain_shingles(other)
            exact = len(a & b) / len(a | b) if a | b else 1.0
            assert abs(r[name] - exact) < (1e-9 if len(a | b) < fingerprint.SIZE else 0.2), (i, name)


def test_equal_texts_have_equal_fingerprints(docs):
    got = {}
    for r in fingerprint.fingerprints(docs).join(docs.select("doc_id", "text"), "doc_id").collect():
        got.setdefault(lower(r["text"]), set()).add(r["fingerprint"])
    assert all(len(x) == 1 for x in got.values())


def test_neighbours_of_odd_tables(odd, none):
    assert fingerprint.with_neighbours(odd).count() == odd.count()
    assert fingerprint.with_neighbours(none).collect() == []
    alone = odd.filter("doc_id = 0").limit(1)
    assert alone.count() == 1 and fingerprint.with_neighbours(alone).first()["near_next"] == 1.0


def test_merged_fingerprint_is_that_of_the_union(spark):
    import random
    r = random.Random(1)
    lists = [[r.randrange(1 << 32) for _ in range(n)] for n in (300, 200, 5, 0)]
    sketches = [np.unique(np.array(x, np.uint32))[:fingerprint.SIZE] for x in lists]
    rows = spark.createDataFrame([(i % 2, fingerprint.to_text(s)) for i, s in enumerate(sketches)], "g int, fingerprint string")
    got = {x["g"]: x["fingerprint"] for x in fingerprint.merged(rows, "g").collect()}
    assert got[0] == fingerprint.to_text(fingerprint.merge(sketches[0], sketches[2]))
    assert got[1] == fingerprint.to_text(sketches[1])
    a, b = sketches[0], fingerprint.merge(sketches[0], sketches[1])
    assert fingerprint.containment(a, b) > 0.8 and fingerprint.containment(sketches[3], a) == 1.0
    assert abs(fingerprint.distinct(b) - 500) < 150 and fingerprint.distinct(sketches[2]) == 5
    assert fingerprint.resemblance(sketches[3], sketches[3]) == 1.0 and fingerprint.resemblance(sketches[3], a) == 0.0
