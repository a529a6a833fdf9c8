import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from test_words import plain_shingles

from limpid.llm import near_dup
from limpid.llm.graph import components
from limpid.llm.words import slices


def brute_force(rows):
    """{key: (size of the set, smallest key reachable)} by comparing all sets that share anything."""
    sets, where = [plain_shingles(t) for _, t in rows], defaultdict(list)
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, s in enumerate(sets):
        common = Counter(j for x in s for j in where[x])
        for j, n in common.items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n) and find(j) != find(k):
                up[find(k)] = find(j)
        for x in s:
            where[x].append(k)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), i), i)
    return {i: (len(sets[k]), least[find(k)]) for k, (i, _) in enumerate(rows)}


def brute_links(rows):
    """[number of other rows that link with each row]."""
    sets, where, out = [plain_shingles(t) for _, t in rows], defaultdict(list), [0] * len(rows)
    for k, s in enumerate(sets):
        for j, n in Counter(j for x in s for j in where[x]).items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                out[k] += 1
                out[j] += 1
        for x in s:
            where[x].append(k)
    return out


def counted(table):
    """As ``found``, and {key: number of links}."""
    rows = near_dup.jaccard_components(table, links=True).collect()
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows}, {r["doc_id"]: r["n_links"] for r in rows}


def found(table):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dup.jaccard_components(table).collect()}


def families(seed=1, n=40, members=14, words=260):
    """Families of copies with few and many changes, some of them only linked through others, and shared passages."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [r.choice(vocabulary) for _ in range(50)]
    texts = []
    for f in range(n):
        base = [r.choice(vocabulary) for _ in range(r.randint(4, words if f % 3 else 40))]
        if f % 4 == 0:
            base = base[:30] + passage
        for m in range(r.randint(1, members)):
            copy = list(base)
            for _ in range(r.randint(0, 5)):
                copy[r.randrange(len(copy))] = r.choice(vocabulary)
            texts.append(" ".join(copy if r.random() < 0.8 else copy[:-r.randint(1, 8)] or copy))
            base = copy if r.random() < 0.3 else base
    r.shuffle(texts)
    return [(i * 7 + 3, t) for i, t in enumerate(texts)]


def test_components_match_brute_force(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    want = brute_force(rows)
    assert found(docs) == want
    assert counted(docs) == (want, dict(zip([i for i, _ in rows], brute_links(rows))))


def test_families_match_brute_force(spark):
    rows = families()
    want = brute_force(rows)
    assert len({c for _, c in want.values()}) < len(rows) * 0.8
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert found(table) == want
    assert counted(table) == (want, dict(zip([i for i, _ in rows], brute_links(rows))))


@pytest.mark.parametrize("limit", [1, 200, 2000])
def test_large_families_match_brute_force(spark, monkeypatch, limit):
    """Every family above the limit is joined by centres and trees of bounded size."""
    monkeypatch.setattr(near_dup, "FAMILY_SHINGLES", limit)
    monkeypatch.setattr(near_dup, "RANGE_SHINGLES", 100)
    monkeypatch.setattr(near_dup.skew, "FEW_KEYS", 0)
    rows = families(seed=limit + 1, n=8, members=40)
    rows += [(10_000 + i, t) for i, (_, t) in enumerate(rows[::5])]  # equal texts count as links
    table, want = spark.createDataFrame(rows, "doc_id long, text string").repartition(4), brute_force(rows)
    assert found(table) == want
    assert counted(table) == (want, dict(zip([i for i, _ in rows], brute_links(rows))))


def test_links_of_trees(monkeypatch):
    """Counts of sets that come in any order, by runs passed in numpy and token by token."""
    r = random.Random(9)
    for short in (0, 3, 24):
        monkeypatch.setattr(near_dup.CountingTree, "SHORT", short)
        for _ in range(150):
            sets = [sorted(r.sample(range(30), r.randint(20, 28))) for _ in range(r.randint(1, 25))]
            rows, tree = [r.randint(1, 3) for _ in sets], near_dup.CountingTree(near_dup.Forest())
            for i, s in enumerate(sets):
                tokens = tree.numbered(pa.scalar(np.array(s, np.uint64).tobytes()))
                tree.insert(i, len(s), tokens, rows[i], tree.count(i, len(s), tokens, rows[i])[0])
            linked = [[9 * len(set(a) & set(b)) >= 4 * (len(a) + len(b)) and i != j for j, b in enumerate(sets)] for i, a in enumerate(sets)]
            assert tree.links() == [sum(w for x, w in zip(line, rows) if x) for line in linked]
            assert all(tree.forest.find(i) == tree.forest.find(j) for i, line in enumerate(linked) for j, x in enumerate(line) if x)


def test_threshold_is_exact(spark):
    """Sets of 9 shingles that share 8 of the 10 in their union link; those that share 7 of 11 do not."""
    words = [f"a{i}" for i in range(13)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:-1] + ["z"])), (3, " ".join(words[:-2] + ["y", "z"]))]
    got = found(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got == {1: (9, 1), 2: (9, 1), 3: (9, 3)} == brute_force(rows)


def test_odd_tables(odd, none):
    rows = near_dup.jaccard_components(odd).collect()
    assert len(rows) == odd.count()
    assert {r["component_id"] for r in rows if r["doc_id"] is None} == {None}
    keyed = {r["doc_id"]: r["text"] for r in odd.filter("doc_id is not null").collect()}
    assert {r["doc_id"]: r["component_id"] for r in rows if r["doc_id"] is not None} == {i: c for i, (_, c) in brute_force(list(keyed.items())).items()}
    again = near_dup.jaccard_components(odd, links=True).collect()
    assert sorted(map(str, (r[:3] for r in again))) == sorted(map(str, (r[:] for r in rows)))
    listed = [(r["doc_id"], r["text"]) for r in odd.filter("doc_id is not null").collect()]
    times, links = Counter(i for i, _ in listed), dict(zip([i for i, _ in listed], brute_links(listed)))
    assert {r["doc_id"]: r["n_links"] for r in again if times[r["doc_id"]] == 1} == {i: n for i, n in links.items() if times[i] == 1}
    assert {r["n_links"] for r in again if r["doc_id"] is None} == {0}
    assert near_dup.jaccard_components(none).collect() == []
    assert near_dup.jaccard_components(none, links=True).collect() == []
    assert near_dup.one_of_each(none).collect() == []


def test_one_of_each_keeps_columns(docs):
    left = near_dup.one_of_each(docs)
    assert left.columns == docs.columns
    want = brute_force([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert sorted(r["doc_id"] for r in left.collect()) == sorted({c for _, c in want.values()})


def test_components_of_links(spark):
    r = random.Random(3)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 200 + i) for i in range(50)] + [(r.randrange(1000, 1100), r.randrange(1000, 1100)) for _ in range(60)] + [(5, 5)]
    got = {x["id"]: x["component"] for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    up = {}
    def find(x):
        while up.get(x, x) != x:
            x = up[x]
        return x
    for a, b in links:
        if a != b:
            up.setdefault(a, a), up.setdefault(b, b)
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in up}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_slices_of_all_partitions_are_spread_over_ranges(spark):
    """The first slices of 64 partitions do not meet in one range."""
    rows = spark.range(640, numPartitions=64).selectExpr("id", "id as tag", "concat('a b c d e f', id) as text")
    blobs = rows.mapInArrow(near_dup._cut(6), near_dup.BLOBS_DDL).filter("kind <> 'first'")
    at = {k: Counter(r["range"] for r in blobs.filter(f"kind = '{k}'").collect()) for k in ("meta", "rest")}
    assert at["meta"] == at["rest"] and sum(at["meta"].values()) == 64 and max(at["meta"].values()) < 8


def test_set_sizes_are_of_whole_hashes():
    """Two hashes that differ in the low 16 bits only are two shingles; repeats are one."""
    hashes = np.array([1 << 20, (1 << 20) + 5, 1 << 20, 7 << 30, 7 << 30], np.uint64)
    for hashes, want in ((hashes, [2, 1, 0]), (hashes & ~near_dup.LOW, [1, 1, 0])):
        row = np.array([0, 0, 0, 1, 1], np.uint64)
        items = np.unique((hashes & ~near_dup.LOW) | row)
        assert near_dup.set_sizes(hashes, row, items, 3).tolist() == want


def test_slices_have_rows_of_16_bits():
    assert list(slices(pa.array([""] * 150_000))) == [(0, 65536), (65536, 131072), (131072, 150_000)]
