"""N-gram Jaccard join: documents whose sets of five-word shingles have a similarity of 0.8 or more.

1. Equal texts are one node. Every other shingle set is cut into ranges of the hash space, where shingles of one document
   alone are recognised and dropped: they cannot be shared, only the size of the set has to remember them. What is left,
   in order of rising frequency, is small, and a document that shares too little can have no partner at all.
2. Two sets of the wanted similarity share one of their rarest shingles. Documents that share any of those form a family,
   and no link leaves a family.
3. A family is joined in a prefix tree of the ordered sets. A search carries the overlap so far down the tree, so sets
   with a common beginning share the work; it leaves a branch when the lengths that remain cannot reach the bound, or
   when all sets in it are already connected with the one that is searched.
4. A family too large for a task is first joined with its most central sets; what those do not reach is put in trees of
   bounded size that all of the family search.

With ``links`` every link is seen: no branch is left because it is connected already, and a branch whose sets all link,
whatever follows, is counted as one. All of a large family goes into the trees of bounded size then.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from limpid.llm import skew
from limpid.llm.dedup import normalized
from limpid.llm.graph import components
from limpid.llm.words import Words, mix, parts
from limpid.storage import materialize

WIDTH = 5
#: Two sets link when NUMERATOR * size of the intersection >= (size of one + size of the other) * DENOMINATOR,
#: which is 100 * intersection >= 80 * union.
NUMERATOR, DENOMINATOR = 9, 4
#: Expected shingles of a range of the hash space.
RANGE_SHINGLES = 1 << 21
#: A family of more shared shingles than this is not joined in one task.
FAMILY_SHINGLES = 1 << 20
LOW = np.uint64(0xFFFF)


def planes(values: np.ndarray) -> bytes:
    """The values byte plane by byte plane: those of sorted values compress well."""
    return values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes()


def from_planes(data: memoryview | bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.frombuffer(data, np.uint8).reshape(width, -1).T.copy().view(kind).ravel()


BLOBS = pa.schema([("range", pa.int64()), ("block", pa.int64()), ("kind", pa.string()), ("data", pa.binary()), ("more", pa.binary())])
BLOBS_DDL = "range long, block long, kind string, data binary, more binary"


def _blobs(rows: list[tuple]) -> pa.Table:
    columns = zip(*rows) if rows else [()] * len(BLOBS)
    return pa.table([pa.array(list(c), t) for c, t in zip(columns, BLOBS.types)], schema=BLOBS)


def set_sizes(hashes: np.ndarray, row: np.ndarray, items: np.ndarray, rows: int) -> np.ndarray:
    """Distinct 64-bit hashes of each row. ``items`` are the distinct ones of 48 bits, which are as many but for rare rows."""
    if len(np.unique(mix(hashes) ^ mix(row + np.uint64(1)))) == len(items):
        return np.bincount((items & LOW).astype(np.int64), minlength=rows)
    order = np.lexsort((hashes, row))
    h, r = hashes[order], row[order]
    new = np.append(True, (h[1:] != h[:-1]) | (r[1:] != r[:-1]))
    return np.bincount(r[new].astype(np.int64), minlength=rows)


def _cut(bits: int):
    """Slices of documents to blobs. An item is a shingle hash of 48 bits and the row of its document in the slice.

    ``first`` blobs have one item of each hash of the slice and the number of its documents, for one range each. What
    further documents have of the same hash goes as ``rest``, and keys and set sizes as ``meta``, to a range by a hash of the
    slice's number: slices and ranges grow alike, so a range gets a few of them at any size.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for part in parts(batches):
            hashes, of = Words(part.column("text")).shingles(WIDTH)
            row = np.repeat(np.arange(len(part), dtype=np.uint64), np.diff(of))
            items = np.unique((hashes & ~LOW) | row)
            size = set_sizes(hashes, row, items, len(part))
            new = np.append(True, items[1:] >> np.uint64(16) != items[:-1] >> np.uint64(16)) if len(items) else np.zeros(0, bool)
            first = items[new]
            times = np.minimum(np.diff(np.append(np.flatnonzero(new), len(items))), 65535).astype(np.uint16)
            meta = pa.RecordBatch.from_arrays([part.column("id"), part.column("tag"), pa.array(size)], ["id", "tag", "n"])
            to = int(mix(np.array([block], np.uint64))[0] & np.uint64((1 << bits) - 1))
            out = [(to, block, "meta", meta.serialize().to_pybytes(), None), (to, block, "rest", planes(items[~new]), None)]
            edges = np.searchsorted(first, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else np.zeros(1, np.int64)
            for r, (a, b) in enumerate(zip(edges.tolist(), np.append(edges[1:], len(first)).tolist())):
                if b > a:
                    out.append((r, block, "first", planes(first[a:b]), planes(times[a:b])))
            yield from _blobs(out).to_batches()
            block += 1
    return run


def _count(group: pa.Table) -> pa.Table:
    """One range: of each slice the items whose hash several documents have, with a class of that number."""
    kind = group.column("kind").to_pylist()
    block, data, more = group.column("block").to_pylist(), group.column("data"), group.column("more")
    out = [(0, block[i], k, data[i].as_py(), None) for i, k in enumerate(kind) if k != "first"]
    mine = [i for i, k in enumerate(kind) if k == "first"]
    if mine:
        lists = [from_planes(data[i].as_buffer(), "u8") for i in mine]
        items = np.concatenate(lists)
        times = np.concatenate([from_planes(more[i].as_buffer(), "u2") for i in mine])
        order = np.argsort(items >> np.uint64(16), kind="stable")
        ordered = items[order] >> np.uint64(16)
        start = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
        total = np.add.reduceat(times[order].astype(np.int64), start)
        often = np.empty(len(items), np.int64)
        often[order] = np.repeat(total, np.diff(np.append(start, len(items))))
        rank = np.minimum(np.log2(often) * 4, 255).astype(np.uint8)
        ends = np.cumsum([len(x) for x in lists])
        for i, a, b in zip(mine, (ends - [len(x) for x in lists]).tolist(), ends.tolist()):
            keep = often[a:b] > 1
            if keep.any():
                out.append((0, block[i], "shared", planes(items[a:b][keep]), rank[a:b][keep].tobytes()))
    return _blobs(out)


NODES = pa.schema([("id", pa.int64()), ("tag", pa.int64()), ("n", pa.int64()), ("size", pa.int64()), ("weight", pa.float64()), ("shared", pa.binary())])
NODES_DDL = "id long, tag long, n long, size long, weight double, shared binary"


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blobs of each slice, which stand together, to its documents: size of the set and the ordered shared part.

    ``shared`` is null where it is too small for any partner. ``weight`` is the mean class of the shared shingles.
    """
    def nodes(rows: list[tuple[str, object, object]]) -> pa.RecordBatch:
        meta = next(pa.ipc.read_record_batch(pa.py_buffer(d.as_py()), pa.schema([("id", pa.int64()), ("tag", pa.int64()), ("n", pa.int64())])) for k, d, _ in rows if k == "meta")
        n = meta.column("n").to_numpy()
        firsts = [(from_planes(d.as_buffer(), "u8"), np.frombuffer(m.as_buffer(), np.uint8)) for k, d, m in rows if k == "shared"]
        rest = np.concatenate([from_planes(d.as_buffer(), "u8") for k, d, _ in rows if k == "rest"] + [np.zeros(0, np.uint64)])
        items = np.concatenate([x for x, _ in firsts] + [np.zeros(0, np.uint64)])
        rank = np.concatenate([x for _, x in firsts] + [np.zeros(0, np.uint8)])
        order = np.argsort(items)
        items, rank = items[order], rank[order]
        known = items >> np.uint64(16)
        rest_rank = rank[np.searchsorted(known, rest >> np.uint64(16))] if len(rest) else rank[:0]
        items, rank = np.concatenate([items, rest]), np.concatenate([rank, rest_rank])
        row = (items & LOW).astype(np.int64)
        size = np.bincount(row, minlength=len(n))
        can = (100 * size >= 80 * n) & (n > 0)
        keep = can[row]
        # Order of the join: rarest class first, then by hash; 8 and 48 bits.
        token = (rank[keep].astype(np.uint64) << np.uint64(48)) | (items[keep] >> np.uint64(16))
        row = row[keep]
        order = np.lexsort((token, row))
        token, row = token[order], row[order]
        at = np.searchsorted(row, np.arange(len(n) + 1))
        sums = np.bincount(row, (token >> np.uint64(48)).astype(float), minlength=len(n))
        lists = [token[at[i]:at[i + 1]].tobytes() if c else None for i, c in enumerate(can.tolist())]
        return pa.RecordBatch.from_arrays([meta.column("id"), meta.column("tag"), pa.array(n), pa.array(np.where(can, size, 0)),
                                           pa.array(sums / np.maximum(size, 1)), pa.array(lists, pa.binary())], schema=NODES)

    current, held = None, []
    for batch in batches:
        for block, kind, data, more in zip(batch.column("block").to_pylist(), batch.column("kind").to_pylist(), batch.column("data"), batch.column("more")):
            if block != current and held:
                yield nodes(held)
                held = []
            current = block
            held.append((kind, data, more))
    if held:
        yield nodes(held)


def shared_sets(docs: DataFrame, expected: int) -> DataFrame:
    """Nodes of rows (id, tag, text): NODES. ``expected``: about the number of shingles of all rows."""
    bits = max(0, (expected // RANGE_SHINGLES).bit_length())
    cut = docs.select("id", "tag", "text").mapInArrow(_cut(bits), BLOBS_DDL)
    counted = materialize(cut.groupBy("range").applyInArrow(_count, BLOBS_DDL).drop("range"), "shared")
    return materialize(counted.repartition("block").sortWithinPartitions("block").mapInArrow(_gather, NODES_DDL), "nodes")


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, id) for the rarest shingles of each node, one of which any partner must have."""
    for batch in batches:
        tokens, ids = [], []
        for i, n, data in zip(batch.column("id").to_pylist(), batch.column("n").to_pylist(), batch.column("shared")):
            mine = np.frombuffer(data.as_buffer(), np.uint64)
            count = n - -(-8 * n // 10) + 1 - (n - len(mine))
            tokens.append(mine[:count])
            ids.append(np.full(min(count, len(mine)), i, np.int64))
        if tokens:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(ids))], ["token", "id"])


class Forest:
    """Connected sets of numbers."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        root = x
        while up.get(root, root) != root:
            root = up[root]
        while up.get(x, x) != root:
            up[x], x = root, up[x]
        return root

    def union(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


class Node:
    """A run of tokens, the sets that end here, and the runs that follow."""

    __slots__ = ("tokens", "children", "ends", "least", "most", "longest", "one", "array", "rows", "extra")

    def __init__(self, tokens: list[int]):
        self.tokens, self.children, self.ends = tokens, {}, []
        self.array = None  # the tokens in numpy, made when a search first passes a long run
        self.rows = 0  # of all sets from here on
        self.extra = 0  # links that all sets from here on have, beside those counted further down
        self.least, self.most = 1 << 62, 0  # set sizes from here on
        self.longest = 0  # tokens from the start of this run to the farthest end
        self.one = None  # a number of the only component that all sets from here on are in, if that is known


class PrefixTree:
    """Ordered token lists in a tree of runs."""

    def __init__(self, forest: Forest):
        self.root, self.forest = Node([]), forest
        self.owed: list[int] = []  # links of each inserted set, without the ``extra`` of the nodes above it

    def insert(self, number: int, size: int, tokens: list[int], rows: int = 1, links: int = 0) -> None:
        """Adds a set that stands for some rows and has these links already; what nodes got before is not its own."""
        node, at, place = self.root, 0, len(self.owed)
        while True:
            run = node.tokens
            same = 0
            stop = min(len(run), len(tokens) - at)
            while same < stop and run[same] == tokens[at + same]:
                same += 1
            if same < len(run):  # the run parts here
                rest = Node(run[same:])
                rest.children, rest.ends, rest.least, rest.most, rest.one = node.children, node.ends, node.least, node.most, node.one
                rest.longest, rest.rows = node.longest - same, node.rows
                node.tokens, node.children, node.ends, node.array = run[:same], {rest.tokens[0]: rest}, [], None
            node.least, node.most, node.one = min(node.least, size), max(node.most, size), None
            node.rows += rows
            links -= node.extra
            node.longest = max(node.longest, len(tokens) - at)
            at += same
            if at == len(tokens):
                node.ends.append((number, size, place, rows))
                break
            if tokens[at] not in node.children:
                leaf = Node(tokens[at:])
                leaf.least = leaf.most = size
                leaf.longest, leaf.rows = len(tokens) - at, rows
                leaf.ends.append((number, size, place, rows))
                node.children[tokens[at]] = leaf
                break
            node = node.children[tokens[at]]
        self.owed.append(links)

    def _single(self, node: Node) -> int | None:
        """The only component from this node on, or None. A number that is kept stays right: components only grow."""
        if node.one is not None:
            return self.forest.find(node.one)
        seen = None
        for number, *_ in node.ends:
            c = self.forest.find(number)
            if seen is not None and c != seen:
                return None
            seen = c
        for child in node.children.values():
            if child.one is None:
                return None
            c = self.forest.find(child.one)
            if seen is not None and c != seen:
                return None
            seen = c
        node.one = seen
        return seen

    def link(self, number: int, size: int, tokens: list[int]) -> list[int]:
        """Connects a set with those in the tree that it links with, and returns them, one per component at least."""
        place = {t: i for i, t in enumerate(tokens)}
        length, forest, found = len(tokens), self.forest, []
        stack = [(self.root, 0, 0)]  # node, overlap so far, first token of the searched set not yet passed
        while stack:
            node, overlap, passed = stack.pop()
            if 5 * node.most < 4 * size or 4 * node.least > 5 * size:
                continue
            only = self._single(node)
            if only is not None and only == forest.find(number):
                continue
            need = -(-DENOMINATOR * (size + node.least) // NUMERATOR)
            left, dead = node.longest, False
            for t in node.tokens:
                i = place.get(t)
                left -= 1
                if i is not None:
                    overlap += 1
                    passed = i + 1
                if overlap + min(left, length - passed) < need:
                    dead = True
                    break
            if dead:
                continue
            for other, n, *_ in node.ends:
                if NUMERATOR * overlap >= DENOMINATOR * (size + n) and forest.find(other) != forest.find(number):
                    forest.union(other, number)
                    found.append(other)
            for child in node.children.values():
                stack.append((child, overlap, passed))
        return found


class CountingTree(PrefixTree):
    """A prefix tree that counts links. Tokens are numbered in the order of their arrival."""

    #: Longer runs are passed in numpy.
    SHORT = 24

    def __init__(self, forest: Forest):
        super().__init__(forest)
        self.numbers: dict[int, int] = {}
        self.mark = np.zeros(1024, np.int32)  # by token: one more than its place in the searched set, else 0

    def numbered(self, data: pa.Scalar) -> list[int]:
        numbers = self.numbers
        tokens = [numbers.setdefault(t, len(numbers)) for t in np.frombuffer(data.as_buffer(), np.uint64).tolist()]
        if len(numbers) > len(self.mark):
            self.mark = np.zeros(2 * len(numbers), np.int32)
        return tokens

    def _connect(self, node: Node, number: int) -> list[int]:
        """Connects all sets from a node on with a number; the components that were apart from it."""
        forest, stack, found = self.forest, [node], []
        while stack:
            node = stack.pop()
            only = self._single(node)
            apart = [only] if only is not None else [other for other, *_ in node.ends]
            for other in apart:
                if forest.find(other) != forest.find(number):
                    found.append(other)
                    forest.union(other, number)
            if only is None:
                stack.extend(node.children.values())
            node.one = number
        return found

    def count(self, number: int, size: int, tokens: list[int], rows: int = 0) -> tuple[int, list[int]]:
        """(rows of the tree that link with a set, components it was connected with by that). Every set found has ``rows``
        more links from now on."""
        length, links, found, mark = len(tokens), 0, [], self.mark
        place = {t: i for i, t in enumerate(tokens, 1)}
        mark[tokens] = np.arange(1, length + 1)
        stack = [(self.root, 0, 0)]  # node, overlap so far, tokens of the searched set that are passed
        while stack:
            node, overlap, passed = stack.pop()
            if 5 * node.most < 4 * size or 4 * node.least > 5 * size:
                continue
            need = -(-DENOMINATOR * (size + node.least) // NUMERATOR)
            if overlap + min(node.longest, length - passed) < need:
                continue
            run = node.tokens
            if len(run) <= self.SHORT:
                for t in run:
                    i = place.get(t)
                    if i is not None:
                        overlap += 1
                        passed = i
            else:
                if node.array is None:
                    node.array = np.array(run, np.int32)
                met = mark[node.array]
                both = int(np.count_nonzero(met))
                if both:
                    overlap += both
                    passed = int(met.max())
            if overlap + min(node.longest - len(run), length - passed) < need:
                continue
            if NUMERATOR * overlap >= DENOMINATOR * (size + node.most):  # whatever follows
                links += node.rows
                node.extra += rows
                found += self._connect(node, number)
                continue
            for other, n, at, more in node.ends:
                if NUMERATOR * overlap >= DENOMINATOR * (size + n):
                    links += more
                    self.owed[at] += rows
                    if self.forest.find(other) != self.forest.find(number):
                        self.forest.union(other, number)
                        found.append(other)
            for child in node.children.values():
                stack.append((child, overlap, passed))
        mark[tokens] = 0
        return links, found

    def links(self) -> list[int]:
        """Links of all inserted sets, in the order of their arrival."""
        out, stack = list(self.owed), [(self.root, 0)]
        while stack:
            node, extra = stack.pop()
            extra += node.extra
            for _, _, at, _ in node.ends:
                out[at] += extra
            stack.extend((child, extra) for child in node.children.values())
        return out


def _count_families(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (family, id, tag, n, rows, shared), families together: (id, component, links). A repeated node is one."""
    current, last, forest, tree, ids, links = None, None, Forest(), None, [], []

    def result() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([forest.find(i) for i in ids], pa.int64()), pa.array(links, pa.int64())],
                                          ["id", "component", "links"])

    for batch in batches:
        for family, i, tag, n, rows, data in zip(*(batch.column(c).to_pylist() for c in ("family", "id", "tag", "n", "rows")), batch.column("shared")):
            if family != current:
                links += tree.links() if tree else []
                if len(ids) > 5000:
                    yield result()
                    forest, ids, links = Forest(), [], []
                current, tree = family, CountingTree(forest)
            elif (i, tag) == last:
                continue
            last = (i, tag)
            tokens = tree.numbered(data)
            tree.insert(i, n, tokens, rows, tree.count(i, n, tokens, rows)[0])
            ids.append(i)
    if ids:
        links += tree.links()
        yield result()


def _search_counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (task, kind, id, tag, n, rows, inside, shared): sets of kind 0 make a tree, those of kind 1 search it, ``inside``
    when they are in it themselves: (a, b, links), with a link between two ids or, for each search, an id twice and its count."""
    current, last, tree = None, None, None
    for batch in batches:
        left, right, links = [], [], []
        for task, kind, i, tag, n, rows, inside, data in zip(*(batch.column(c).to_pylist() for c in ("task", "kind", "id", "tag", "n", "rows", "inside")), batch.column("shared")):
            if task != current:
                current, last, tree = task, None, CountingTree(Forest())
            if (kind, i, tag) == last:
                continue
            last = (kind, i, tag)
            tokens = tree.numbered(data)
            if not kind:
                tree.insert(i, n, tokens, rows)
                continue
            count, found = tree.count(i, n, tokens)
            if inside and NUMERATOR * len(tokens) >= DENOMINATOR * 2 * n:  # it has met itself
                count -= rows
            left += [i] * (len(found) + 1)
            right += [*found, i]
            links += [0] * len(found) + [count]
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64()), pa.array(links, pa.int64())], ["a", "b", "links"])


def _join_families(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (family, id, n, shared), families together: (id, component)."""
    current, forest, tree, ids = None, Forest(), None, []

    def result() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([forest.find(i) for i in ids], pa.int64())], ["id", "component"])

    for batch in batches:
        for family, i, n, data in zip(batch.column("family").to_pylist(), batch.column("id").to_pylist(), batch.column("n").to_pylist(), batch.column("shared")):
            if family != current:
                if len(ids) > 5000:
                    yield result()
                    forest, ids = Forest(), []
                current, tree = family, PrefixTree(forest)
            tokens = np.frombuffer(data.as_buffer(), np.uint64).tolist()
            tree.link(i, n, tokens)
            tree.insert(i, n, tokens)
            ids.append(i)
    if ids:
        yield result()


def _search_trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (task, kind, id, n, shared, star): sets of kind 0 make a tree, those of kind 1 search it: (a, b) links."""
    current, forest, tree = None, Forest(), None
    for batch in batches:
        left, right = [], []
        for task, kind, i, n, data, star in zip(*(batch.column(c).to_pylist() for c in ("task", "kind", "id", "n")), batch.column("shared"), batch.column("star").to_pylist()):
            if task != current:
                current, forest = task, Forest()
                tree = PrefixTree(forest)
            tokens = np.frombuffer(data.as_buffer(), np.uint64).tolist()
            if star is not None:
                forest.union(i, star)
            for other in tree.link(i, n, tokens):
                left.append(i)
                right.append(other)
            if not kind:
                tree.insert(i, n, tokens)
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])


def _linked(n: pd.Series, shared: pd.Series, m: pd.Series, other: pd.Series) -> pd.Series:
    out = []
    for a, x, b, y in zip(n, shared, m, other):
        both = len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
        out.append(NUMERATOR * both >= DENOMINATOR * (a + b))
    return pd.Series(out, dtype=bool)


def _hot_links(hot: DataFrame, rounds: int = 3) -> DataFrame:
    """Links (a, b) that connect all that is connected in families of rows (family, id, n, size, weight, shared)."""
    linked = F.pandas_udf(_linked, "boolean")
    links, left = [], hot
    for _ in range(rounds):
        # The most central set of each family; families of this size are few beside the rows.
        centre = left.groupBy("family").agg(F.max_by(F.struct("id", "n", "shared"), F.struct("weight", -F.col("id"))).alias("c"))
        tested = left.join(F.broadcast(materialize(centre, "centres")), "family").withColumn("on", linked("n", "shared", "c.n", "c.shared"))
        tested = materialize(tested.withColumn("star", F.when(F.col("on"), F.col("c.id"))).drop("c", "on"), "stars")
        links.append(tested.filter("star is not null and star <> id").select(F.col("id").alias("a"), F.col("star").alias("b")))
        left = tested.filter("star is null").drop("star")
    found = links[0]
    for more in links[1:]:
        found = found.unionByName(more)
    found = materialize(found, "star-links")
    star = components(found).select("id", F.col("component").alias("star"))
    whole = materialize(hot.join(star, "id", "left"), "starred")
    # What is not in the largest star of its family goes into trees; all of the family searches each of them.
    main = whole.filter("star is not null").groupBy("family", "star").agg(F.sum("size").alias("s")).groupBy("family").agg(F.max_by("star", F.struct("s", "star")).alias("main"))
    apart = whole.join(F.broadcast(main), "family", "left").withColumn("apart", ~F.col("star").eqNullSafe(F.col("main")) | F.col("main").isNull()).drop("main")
    apart = materialize(apart, "apart")
    trees = apart.groupBy("family").agg(F.sum(F.when(F.col("apart"), F.col("size")).otherwise(0)).alias("s"), F.sum("size").alias("all")).select(
        "family", F.ceil(F.col("s") / FAMILY_SHINGLES).cast("int").alias("trees"), F.ceil(F.col("all") / FAMILY_SHINGLES).cast("int").alias("shares")).filter("trees > 0")
    rows = apart.join(F.broadcast(trees), "family")
    own = F.pmod(F.xxhash64("id"), F.col("trees"))
    into = rows.filter("apart").select("*", own.alias("tree"), F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.lit(0).alias("kind"))
    search = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("trees") - 1)).alias("tree"), F.pmod(F.xxhash64("id", F.lit(1)), F.col("shares")).alias("share"), F.lit(1).alias("kind"))
    work = into.unionByName(search).select(F.concat_ws("/", "family", "tree", "share").alias("task"), "kind", "id", "n", "shared", "star")
    more = work.repartition("task").sortWithinPartitions("task", "kind", "id").mapInArrow(_search_trees, "a long, b long")
    return found.unionByName(more)


def _hot_counts(hot: DataFrame) -> DataFrame:
    """(id, component, links) of families of rows (family, id, tag, n, size, rows, shared) that are too large for a task.

    A family of k times ``FAMILY_SHINGLES`` makes k trees, and each is built in k tasks, for a k-th of the family to search.
    """
    trees = materialize(hot.groupBy("family").agg(F.ceil(F.sum("size") / FAMILY_SHINGLES).cast("int").alias("trees")), "trees")
    rows = hot.join(skew.few(trees), "family").withColumn("own", F.pmod(F.xxhash64("id", "tag"), F.col("trees")))
    each = F.explode(F.sequence(F.lit(0), F.col("trees") - 1))
    into = rows.select("*", F.col("own").alias("tree"), each.alias("share"), F.lit(0).alias("kind"))
    search = rows.select("*", each.alias("tree"), F.pmod(F.xxhash64("id", "tag", F.lit(1)), F.col("trees")).alias("share"), F.lit(1).alias("kind"))
    work = into.unionByName(search).select(F.concat_ws("/", "family", "tree", "share").alias("task"), "kind", "id", "tag", "n", "rows", (F.col("own") == F.col("tree")).alias("inside"), "shared")
    found = work.repartition("task").sortWithinPartitions("task", "kind", "id", "tag").mapInArrow(_search_counted, "a long, b long, links long")
    found = materialize(found, "hot-links")
    counts = found.groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("links"))
    return counts.join(components(found), "id", "left").select("id", F.coalesce("component", "id").alias("component"), "links")


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", links: bool = False) -> DataFrame:
    """Per row: key, n_shingles (size of the set) and component_id, the smallest key reachable by links; with ``links``
    n_links as well, the number of other rows that the row links with, equal texts among them.

    A null text, like one without words, has an empty set, n_shingles 0, and links with nothing. Rows of equal text, A-Z
    lower-cased, are linked if the set is not empty. Rows that repeat a key are one node of the graph, and each has the
    links of all their texts. Rows without a key link with nothing, have null in component_id and are counted nowhere.
    """
    rows = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("sha", F.unhex(F.sha2(normalized("text"), 256)))
    tag = F.xxhash64("sha")
    facts = materialize(rows.select("id", "sha", F.octet_length("text").alias("bytes")), "facts")
    total, bytes_ = facts.agg(F.count("*"), F.sum("bytes")).first()
    copies = materialize(facts.groupBy("sha").agg(F.min("id").alias("rep"), F.count("*").alias("rows"), F.count("id").alias("keyed")).filter("rows > 1"), "copies")
    members = materialize(skew.join_groups(facts.drop("bytes"), copies, "sha", "rows", total).withColumn("rep", F.coalesce("rep", "id")).drop("rows"), "members")
    spare = materialize(members.filter("id is not null and id <> rep").select("id", tag.alias("tag")).distinct(), "spare")
    single = skew.without(rows.withColumn("tag", tag), spare, ["id", "tag"])
    if spare.count() > skew.FEW_KEYS:  # rows were shuffled, and a task that runs again must see them in the same order
        single = single.sortWithinPartitions("id", "tag")
    nodes = shared_sets(single, (bytes_ or 0) // 6)
    sets = nodes.filter("shared is not null and id is not null")

    postings = materialize(sets.select("id", "n", "shared").mapInArrow(_postings, "token long, id long"), "postings")
    first = postings.groupBy("token").agg(F.min("id").alias("first"), F.count("*").alias("rows")).filter("rows > 1")
    edges = postings.join(first, "token").filter("id <> first").select(F.col("id").alias("a"), F.col("first").alias("b")).distinct()
    family = materialize(components(edges).withColumnRenamed("component", "family"), "families")
    sized = sets.select("id", "size").join(family, "id").groupBy("family").agg(F.sum("size").alias("total"))
    large = materialize(sized.filter(F.col("total") > FAMILY_SHINGLES).select("family"), "large")

    if links:
        classes = copies.filter("rep is not null").select(F.col("rep").alias("id"), tag.alias("tag"), F.col("keyed").alias("rows"))
        placed = sets.select("id", "tag").distinct().join(family, "id").join(classes, ["id", "tag"], "left").fillna(1, ["rows"])
        met = sets.join(materialize(placed, "placed"), ["id", "tag"])
        ordinary = skew.without(met, large, "family").select("family", "id", "tag", "n", "rows", "shared")
        joined = ordinary.repartition("family").sortWithinPartitions("family", "n", "id", "tag").mapInArrow(_count_families, "id long, component long, links long")
        if large.limit(1).count():
            joined = joined.unionByName(_hot_counts(materialize(met.join(skew.few(large), "family"), "hot")))
    else:
        met = sets.join(family, "id")
        ordinary = skew.without(met, large, "family").select("family", "id", "n", "shared")
        joined = ordinary.repartition("family").sortWithinPartitions("family", "n", "id").mapInArrow(_join_families, "id long, component long")
        if large.limit(1).count():
            hot = materialize(met.join(skew.few(large), "family"), "hot")
            joined = joined.unionByName(components(_hot_links(hot)))
        joined = joined.withColumn("links", F.lit(0))
    joined = materialize(joined.groupBy("id").agg(F.min("component").alias("component"), F.sum("links").alias("links")), "joined")

    # Back from nodes to rows. A node without links is its own component; so is each row with an empty set.
    size = nodes.select("id", "tag", "n").distinct()
    out = members.withColumn("tag", tag).join(size.withColumnRenamed("id", "rep"), ["rep", "tag"], "left")
    out = out.join(joined.withColumnRenamed("id", "rep"), "rep", "left")
    alone = F.coalesce(F.col("n"), F.lit(0)) == 0
    alone = alone | F.col("id").isNull()
    own = F.coalesce("links", F.lit(0)) + F.coalesce("keyed", F.lit(1)) - 1
    return out.select(F.col("id").alias(key), F.coalesce("n", F.lit(0)).cast("long").alias("n_shingles"),
                      F.when(alone, F.col("id")).otherwise(F.coalesce("component", "rep")).alias("component_id"),
                      *[F.when(alone, 0).otherwise(own).cast("long").alias("n_links")] * links)


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each component, that of the smallest key; rows without a key stay."""
    lost = jaccard_components(docs, key, text).filter(F.col(key) != F.col("component_id")).select(key).distinct()
    return skew.without(docs, materialize(lost, "lost"), key)
