"""Scoring texts with a gated recurrent language model whose output is factored into classes.

The vocabulary is that of all training texts, with exact counts, and is never in one place. Its most frequent words, the
head, have classes of a few words each, chosen by the network as word within class; every other word is in a class of
its ending, within which words are as likely as their counts say, one unseen word included. So the probabilities of all
words and of one unseen word per ending class sum to one at every position.

The network is fitted on all training texts, each of them once. They are dealt to shards, whose number grows with the tokens;
in each round every shard goes through its next part of its texts from the same weights, apart from the others, and the weights
are averaged after it.
"""

from __future__ import annotations

import heapq
import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from limpid.llm.words import Words, mix, parts
from limpid.storage import materialize

#: Words of the head, in classes of WITHIN; the last place is the end of a text. ENDINGS classes hold all other words.
HEAD, WITHIN, ENDINGS = 1024, 16, 64
CLASSES = HEAD // WITHIN + ENDINGS
TYPES = HEAD + ENDINGS
END = HEAD - 1
HIDDEN = 32
#: At most so many frequent words are sent to all tasks with their counts; counts of others are joined.
KNOWN = 100_000
#: Shards of the fit: at least, and so many where they have SHARD_LEAST tokens; from then on of SHARD_TOKENS. Rounds over all.
SHARDS, SHARDS_WIDE, SHARD_LEAST, SHARD_TOKENS, ROUNDS = 6, 48, 100_000, 2_000_000, 3
#: Lanes are LANES, or more in a shard that still has UPDATES windows then. Only longer texts than UNCUT tokens go on in another lane.
WINDOW, LANES, LANES_WIDE, UPDATES, UNCUT, RATE = 24, 16, 256, 400, 4096, 0.01
#: Lanes of documents that are scored side by side, at most and at least, positions between which only the state is carried, and tokens that a task
#: gathers first: long documents are few, so they are best scored together.
BESIDE, BESIDE_LEAST, STRIDE, GATHERED = 512, 384, 16, 4_000_000
#: Rows whose classes are worked on at once: few stay in a core's cache, many suit the products of a fit.
ROWS, ROWS_FIT = 1024, 2048


def held_out(key: str | Column) -> Column:
    column = F.col(key) if isinstance(key, str) else key
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def endings(words: Words, at: np.ndarray) -> np.ndarray:
    """The ending class of each of these words, by the last three bytes."""
    start, end = words.start[at], words.end[at]
    def back(k: int) -> np.ndarray:
        return np.where(end - k >= start, words.bytes[np.maximum(end - k, 0)], 0).astype(np.uint32)
    code = (back(1) << np.uint32(16)) | (back(2) << np.uint32(8)) | back(3)
    return ((code * np.uint32(2654435761)) >> np.uint32(26)).astype(np.int64) % ENDINGS


class Network:
    """Gated recurrent units over word types; parameters are plain arrays."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights

    @classmethod
    def fresh(cls, head: np.ndarray | None = None, rest: np.ndarray | None = None, seed: int = 1) -> "Network":
        """Weights to start from. ``head`` and ``rest`` are counts of the head words and of the ending classes: the
        biases then make a network that predicts by frequency alone, nearly, before it has learned."""
        head = np.ones((HEAD // WITHIN, WITHIN)) if head is None else np.maximum(head, 0.5).reshape(-1, WITHIN)
        rest = np.full(ENDINGS, float(WITHIN)) if rest is None else rest
        r = np.random.default_rng(seed)
        def a(*shape: int, scale: float) -> np.ndarray:
            return (r.standard_normal(shape) * scale).astype(np.float32)
        return cls({"x": a(TYPES, 3 * HIDDEN, scale=0.1), "u": a(HIDDEN, 3 * HIDDEN, scale=HIDDEN ** -0.5), "c": a(HIDDEN, CLASSES, scale=0.02),
                    "cb": np.log(np.append(head.sum(1), rest)).astype(np.float32), "i": a(HEAD // WITHIN, HIDDEN, WITHIN, scale=0.02), "ib": np.log(head).astype(np.float32)})

    def inputs(self, x: np.ndarray) -> np.ndarray:
        """What word types take from the two gates and add to the new state: three arrays of the shape of ``x``, HIDDEN wide."""
        a = self.w["x"].reshape(-1, HIDDEN).take(3 * x + np.arange(3).reshape(3, *[1] * x.ndim), 0)
        np.negative(a[:2], a[:2])
        return a

    def recurrence(self) -> np.ndarray:
        """The weights of the state in the two gates and in the new state, as three matrices; those of the gates negative."""
        return self.w["u"].reshape(HIDDEN, 3, HIDDEN).transpose(1, 0, 2) * np.array([-1, -1, 1], np.float32).reshape(3, 1, 1)

    def step(self, h: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, ...]:
        """(next state, and what its gradient needs) from states and word types."""
        a = self.inputs(x)
        u = np.matmul(h, self.recurrence())
        return self.advance(h, a, u, np.empty_like(u[2])), *a, u[2]

    @staticmethod
    def advance(h: np.ndarray, a: np.ndarray, u: np.ndarray, after: np.ndarray) -> np.ndarray:
        """The next state, from the inputs and the state times its weights; the inputs become the gates and the new state."""
        gates, n = a[:2], a[2]
        gates += u[:2]
        np.exp(gates, gates)
        gates += 1
        np.reciprocal(gates, gates)
        np.multiply(a[1], u[2], after)
        n += after
        np.tanh(n, n)
        np.subtract(h, n, after)
        after *= a[0]
        after += n
        return after

    def losses(self, h: np.ndarray, x: np.ndarray, grads: dict[str, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Log-probability of word types after states: of the class, and within it for head words.

        With ``grads``, gradients of the sum of their negatives are added there, and that of the states is returned.
        Classes are worked on in some rows at once, and products within a class by class; all else is done for all head words together.
        """
        w, dtype, n = self.w, np.result_type(h, self.w["c"]), len(x)
        kind = np.where(x < HEAD, x // WITHIN, x - HEAD + HEAD // WITHIN)
        # states lie between -1 and 1, so weights small enough need no shift before the exponential
        small = all(HIDDEN * np.abs(w[a]).max() + np.abs(w[b]).max() < 60 or (np.abs(w[a]).sum(-2).max() + np.abs(w[b]).max()) < 60 for a, b in (("c", "cb"), ("i", "ib")))
        out, dh = np.empty(n, dtype), None if grads is None else np.empty((n, HIDDEN), dtype)
        classes, ones = np.vstack([w["c"], w["cb"]]), np.ones(CLASSES, dtype)
        some = min(n, ROWS if grads is None else ROWS_FIT)
        with_one, room = np.ones((some, HIDDEN + 1), dtype), np.empty((some, CLASSES), dtype)
        for a in range(0, n, some):
            mine, p = with_one[:n - a], room[:n - a]
            mine[:, :HIDDEN] = h[a:a + some]
            np.matmul(mine, classes, p)
            if not small:
                p -= p.max(1, keepdims=True)
            at = np.arange(0, p.size, CLASSES) + kind[a:a + some]
            value = p.ravel().take(at)
            np.exp(p, p)
            total = p @ ones
            np.subtract(value, np.log(total), out[a:a + some])
            if grads is not None:
                # gradients of the rows without their division by the total, which the narrow side of each product has instead
                p.ravel()[at] -= total
                total = 1 / total[:, None]
                both = (mine * total).T @ p
                grads["c"] += both[:HIDDEN]
                grads["cb"] += both[HIDDEN]
                np.matmul(p, w["c"].T, dh[a:a + some])
                dh[a:a + some] *= total
        order = np.argsort(kind.astype(np.int16), kind="stable")
        edges = np.searchsorted(kind[order], np.arange(HEAD // WITHIN + 1))
        head = order[:edges[-1]]
        if not len(head):
            return out, dh
        hs, s = h.take(head, 0), np.empty((len(head), WITHIN), dtype)
        some = np.flatnonzero(np.diff(edges))
        ranges = list(zip(some.tolist(), edges[some].tolist(), edges[some + 1].tolist()))
        for k, a, b in ranges:
            np.dot(hs[a:b], w["i"][k], s[a:b])
        s += w["ib"].take(kind[head], 0)
        if not small:
            s -= s.max(1, keepdims=True)
        at = np.arange(0, s.size, WITHIN) + x.take(head) % WITHIN
        value = s.ravel().take(at)
        np.exp(s, s)
        total = s @ np.ones(WITHIN, dtype)
        out[head] += value - np.log(total)
        if grads is not None:
            s /= total[:, None]
            s.ravel()[at] -= 1
            back, products, turned = np.empty(hs.shape, dtype), np.empty((len(some), HIDDEN, WITHIN), dtype), w["i"].transpose(0, 2, 1)
            for (k, a, b), product in zip(ranges, products):
                mine = s[a:b]
                np.dot(hs[a:b].T, mine, product)
                np.dot(mine, turned[k], back[a:b])
            grads["i"][some] += products
            grads["ib"][some] += np.add.reduceat(s, edges[some])
            dh[head] += back
        return out, dh


def dealt(sizes: list[int], n: int) -> list[list[int]]:
    """Numbers of the texts of each lane: the longest first, each to the lane that is shortest then."""
    lanes, heap = [[] for _ in range(n)], [(0, i) for i in range(n)]
    for t in sorted(range(len(sizes)), key=sizes.__getitem__, reverse=True):
        size, i = heap[0]
        heapq.heapreplace(heap, (size + sizes[t], i))
        lanes[i].append(t)
    return lanes


def in_lanes(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(types, -1 behind the end of a lane; where a state starts anew) by position and lane. Every token is in one lane."""
    total = sum(map(len, texts))
    n = int(np.clip(total // (WINDOW * UPDATES), LANES, LANES_WIDE))
    most = max(-(-total // n), UNCUT)
    pieces = [t[a:a + most] for t in texts for a in range(0, len(t), most)]
    lanes = dealt(list(map(len, pieces)), n)
    length = max(sum(len(pieces[t]) for t in lane) for lane in lanes)
    x, fresh = np.full((length, n), -1, np.int16), np.zeros((length, n), bool)
    for i, lane in enumerate(lanes):
        at = 0
        for t in lane:
            x[at:at + len(pieces[t]), i] = pieces[t]
            fresh[at, i] = True
            at += len(pieces[t])
    return x, fresh


def train(network: Network, texts: list[np.ndarray], state: dict | None = None) -> dict:
    """One pass of truncated backpropagation over lists of word types, in lanes side by side, with Adam.

    A lane's state runs on from window to window and is cleared where a text begins. Returns the optimiser's state.
    """
    lanes, fresh = in_lanes(texts)
    n, dtype = lanes.shape[1], network.w["u"].dtype
    names, sizes = list(network.w), [v.size for v in network.w.values()]

    def parts_of(flat: np.ndarray) -> dict[str, np.ndarray]:
        return {k: v.reshape(network.w[k].shape) for k, v in zip(names, np.split(flat, np.cumsum(sizes)[:-1]))}

    # All weights are in one array, and so are their gradients and what the optimiser keeps of these.
    flat, slopes = np.concatenate([network.w[k].ravel() for k in names]), np.empty(sum(sizes), dtype)
    grads = parts_of(slopes)
    network.w = parts_of(flat)
    state = state or {"t": 0, "m": np.zeros_like(flat), "v": np.zeros_like(flat)}
    room = np.empty((2, len(flat)), dtype)
    # By position: states before and after, the state times its weights, and gradients of the new state, the gates and the new state's part that is reset.
    states, us, ds = np.zeros((WINDOW + 1, n, HIDDEN), dtype), np.empty((WINDOW, 3, n, HIDDEN), dtype), np.empty((4, WINDOW, n, HIDDEN), dtype)
    of_state, double, pairs = np.empty((3, n, HIDDEN), dtype), np.result_type(dtype, np.complex64), np.arange(TYPES * 3 * HIDDEN // 2).reshape(TYPES * 3, -1)
    for a in range(0, len(lanes), WINDOW):
        live, x = lanes[a:a + WINDOW] >= 0, np.maximum(lanes[a:a + WINDOW], 0).astype(np.int64)
        here = fresh[a:a + WINDOW]
        anew = here.any(1).tolist()
        length, u, w_u = len(x), network.recurrence(), network.w["u"].reshape(HIDDEN, 3, HIDDEN).transpose(1, 0, 2)
        slopes.fill(0)
        inputs, starts = network.inputs(x), states[:length]
        for t in range(length):
            if anew[t]:
                states[t][here[t]] = 0
            np.matmul(states[t], u, us[t])
            network.advance(states[t], inputs[:, t], us[t], states[t + 1])
        n_seen = int(live.sum())
        flat_starts = starts.reshape(-1, HIDDEN)
        if n_seen == live.size:
            dh = network.losses(flat_starts, x.ravel(), grads)[1].reshape(starts.shape)
        else:
            # Behind the end of a lane there is no loss, so nothing flows back from there.
            dh = np.zeros_like(starts)
            dh[live] = network.losses(starts[live], x[live], grads)[1]
        z, r, new = inputs
        # carry, the gradient of the state after a position, times by_carry gives those of the new state and of the first gate;
        # that of the new state times by_new gives those of the other gate and of what it resets
        by_carry, by_new = np.empty((2, 2, *starts.shape), dtype)
        np.subtract(1, z, by_carry[0])
        np.subtract(starts, new, by_carry[1])
        by_carry[1] *= z
        by_carry[1] *= by_carry[0]
        new *= new
        np.subtract(1, new, new)
        by_carry[0] *= new
        np.subtract(1, r, by_new[0])
        by_new[0] *= r
        by_new[0] *= us[:length, 2]
        by_new[1] = r
        carry, back = np.zeros_like(states[0]), w_u.transpose(0, 2, 1)
        for t in range(length - 1, -1, -1):
            mine = ds[:, t]
            np.multiply(carry, by_carry[:, t], mine[:2])
            np.multiply(mine[0], by_new[:, t], mine[2:])
            carry *= z[t]
            np.matmul(mine[1:], back, of_state)
            carry += of_state[0]
            carry += of_state[1]
            carry += of_state[2]
            carry += dh[t]
            if anew[t]:
                carry[here[t]] = 0
        by_kind = ds[:, :length].reshape(4, -1, HIDDEN)
        rows = 3 * x.ravel() + np.array([[2], [0], [1]])
        # two neighbours of a row are added as one complex number, which halves the additions
        np.add.at(grads["x"].ravel().view(double), pairs.take(rows.ravel(), 0).ravel(), by_kind[:3].ravel().view(double))
        grads["u"].reshape(HIDDEN, 3, HIDDEN)[:] += np.matmul(flat_starts.T, by_kind[1:]).transpose(1, 0, 2)
        states[0] = states[length]
        state["t"] += 1
        adam(flat, slopes, state, LANES / n_seen, room)
    return state


def adam(w: np.ndarray, g: np.ndarray, state: dict, scale: float, room: np.ndarray) -> None:
    """One update of the weights in place; ``g`` is scaled in place first. ``m`` and ``v`` are ten and a thousand times the usual means."""
    by_m, by_v = 0.1 / (1 - 0.9 ** state["t"]), math.sqrt(0.001 / (1 - 0.999 ** state["t"]))
    m, v, (square, step) = state["m"], state["v"], room
    g *= scale
    m *= 0.9
    m += g
    np.multiply(g, g, square)
    v *= 0.999
    v += square
    np.sqrt(v, step)
    step += 1e-8 / by_v
    np.divide(m, step, step)
    step *= RATE * by_m / by_v
    w -= step


def score_types(network: Network, texts: list[np.ndarray]) -> np.ndarray:
    """Log-probability of each list of word types; the state runs through whole texts.

    Texts follow each other in lanes, so that few lanes run on alone behind the end of others: not more lanes than the longest text fills.
    """
    out = np.zeros(len(texts))
    sizes = list(map(len, texts))
    if not sum(sizes):
        return out
    n = int(np.clip(sum(sizes) // max(sizes), BESIDE_LEAST, BESIDE))
    lanes = sorted(((sum(sizes[t] for t in lane), lane) for lane in dealt(sizes, n) if lane), reverse=True)  # longer ones come first
    size = np.array([s for s, _ in lanes])
    flat = np.concatenate([texts[t] for _, lane in lanes for t in lane])
    of = np.array([t for _, lane in lanes for t in lane])
    long = np.array(sizes)[of]
    begin, starts = np.cumsum(size) - size, np.cumsum(long) - long
    first = np.zeros(len(flat), bool)
    first[starts[long > 0]] = True
    of, u, inputs = np.repeat(of, long), network.recurrence(), network.inputs(np.arange(TYPES))
    # the states of all positions of a stride, one behind the other
    states = np.zeros(((STRIDE + 1) * len(lanes), HIDDEN), network.w["u"].dtype)
    h = states[:len(lanes)]
    for a in range(0, int(size[0]), STRIDE):
        states[:len(h)], at, rows = h, 0, []
        for t in range(a, min(a + STRIDE, int(size[0]))):
            live = int(np.searchsorted(-size, -t))
            here = begin[:live] + t
            h = states[at:at + live]
            h[first[here]] = 0
            rows.append(here)
            at += live
            h = network.advance(h, inputs.take(flat[here], 1), np.matmul(h, u), states[at:at + live])
        rows = np.concatenate(rows)
        value, _ = network.losses(states[:at], flat[rows])
        out += np.bincount(of[rows], value, len(out))
    return out


class Lexicon:
    """The frequent words with their counts, and what all counts sum to."""

    def __init__(self, words: list[str], counts: list[int], masses: np.ndarray, total: int, distinct: int):
        hashes = Words(pa.array(words, pa.string())).hashes() if words else np.zeros(0, np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.rank, self.counts = hashes[order], order, np.array(counts, np.float64)[order] if words else np.zeros(0)
        self.masses, self.total, self.distinct = masses, total, distinct

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank by count or -1, count) of each word."""
        if not len(self.hashes):
            return np.full(len(hashes), -1), np.zeros(len(hashes))
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        hit = self.hashes[at] == hashes
        return np.where(hit, self.rank[at], -1), np.where(hit, self.counts[at], 0.0)

    def types(self, words: Words) -> tuple[np.ndarray, ...]:
        """(codes, first index, type, rank, count) of the distinct words of some texts."""
        hashes = words.hashes()
        codes, at = words.distinct(hashes)
        rank, count = self.look_up(hashes[at])
        kind = np.where((rank >= 0) & (rank < END), rank, HEAD + endings(words, at))
        return codes, at, kind, rank, count


def with_ends(kinds: np.ndarray, of: np.ndarray) -> list[np.ndarray]:
    return [np.append(kinds[a:b], END) for a, b in zip(of[:-1].tolist(), of[1:].tolist())]


def count_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n) over all texts; each slice counts its own before anything is shuffled."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches):
            words = Words(part.column("text"))
            codes, at = words.distinct()
            yield pa.RecordBatch.from_arrays([words.strings(at), pa.array(np.bincount(codes, minlength=len(at)), pa.int64())], ["word", "n"])
    return docs.select(F.col(text).alias("text")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def ending_masses(vocabulary: DataFrame) -> DataFrame:
    """(ending, mass, words): the counts plus one of all words of an ending class."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = Words(batch.column("word"))
            kind = endings(words, np.arange(len(words)))
            mass = np.bincount(kind, batch.column("n").to_numpy() + 1, ENDINGS)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(ENDINGS)), pa.array(mass)], ["ending", "mass"])
    return vocabulary.mapInArrow(run, "ending long, mass double").groupBy("ending").agg(F.sum("mass").alias("mass"))


def frequent(vocabulary: DataFrame, limit: int) -> list:
    """The most frequent words, at most ``limit``, most frequent first.

    Counts are told apart in eighths of a power of two, so what a task sends to find the limit does not grow; words as
    frequent as that step are in together or not at all.
    """
    step = F.floor(F.log2("n") * 8)
    least, total = None, 0
    for r in sorted(vocabulary.groupBy(step.alias("step")).count().collect(), reverse=True):
        total += r["count"]
        if total > limit:
            break
        least = r["step"]
    if least is None:
        return []
    return sorted(vocabulary.filter(step >= least).collect(), key=lambda r: (-r["n"], r["word"]))


def shards_of(tokens: int) -> int:
    return max(SHARDS, min(SHARDS_WIDE, tokens // SHARD_LEAST), -(-tokens // SHARD_TOKENS))


def training_texts(learn: DataFrame, shared, shards: int) -> DataFrame:
    """(shard, types) of every text, staged with the texts of a shard together. ``shared``: a broadcast Lexicon.

    Texts are dealt by their place in the input, so no shard grows with the rows of a key.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 32
        for part in parts(batches):
            words = Words(part.column("text"))
            codes, _, kind, _, _ = shared.value.types(words)
            types = with_ends(kind[codes], words.of)
            shard = mix(np.arange(row, row + len(types), dtype=np.uint64)) % np.uint64(shards)
            row += len(types)
            yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int64)), pa.array([t.astype(np.int16).tobytes() for t in types], pa.binary())], ["shard", "types"])
    dealt = learn.select("text").mapInArrow(run, "shard long, types binary")
    return materialize(dealt.repartitionById(shards, F.col("shard").cast("int")).sortWithinPartitions("shard"), "lm-texts")


def _mean(group: pa.Table) -> pa.Table:
    """The mean of pickled weights, each counted as often as it has tokens."""
    total, out = sum(group.column("n").to_pylist()), None
    for n, data in zip(group.column("n").to_pylist(), group.column("weights")):
        mine = {k: n / total * v.astype(np.float64) for k, v in pickle.loads(data.as_buffer()).items()}
        out = mine if out is None else {k: v + mine[k] for k, v in out.items()}
    return pa.table({"n": [total], "weights": [pickle.dumps({k: v.astype(np.float32) for k, v in out.items()})]})


def fit_network(texts: DataFrame, shards: int, network: Network, rounds: int = ROUNDS) -> tuple[Network, int]:
    """Fits on rows of (shard, types), and returns the number of tokens that were passed too.

    Round k passes every text of a shard whose place in it is k modulo ``rounds``, so all texts are passed once. In each round
    every shard starts from the same weights, which are averaged after it, in groups before they are sent to the driver:
    about the square root of the number of shards.
    """
    total, groups = 0, math.isqrt(shards)
    for turn in range(rounds):
        start = network.w

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            current, held, place = None, [], 0

            def fitted() -> pa.RecordBatch:
                mine = Network({k: v.copy() for k, v in start.items()})
                train(mine, held)
                return pa.RecordBatch.from_arrays([pa.array([current % groups]), pa.array([sum(map(len, held))]), pa.array([pickle.dumps(mine.w)], pa.binary())], ["part", "n", "weights"])

            for batch in batches:
                for shard, types in zip(batch.column("shard").to_pylist(), batch.column("types")):
                    if shard != current:
                        if held:
                            yield fitted()
                        held, place = [], 0
                    current = shard
                    if place % rounds == turn:
                        held.append(np.frombuffer(types.as_py(), np.int16))
                    place += 1
            if held:
                yield fitted()

        means = texts.mapInArrow(run, "part long, n long, weights binary").groupBy("part").applyInArrow(_mean, "n long, weights binary").collect()
        if not means:
            continue
        found = _mean(pa.table({"n": [r["n"] for r in means], "weights": [bytes(r["weights"]) for r in means]}))
        total += found.column("n")[0].as_py()
        network = Network(pickle.loads(found.column("weights")[0].as_py()))
    return network, total


SCORED = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("word", pa.string()), ("n", pa.int64()), ("known", pa.int64()),
                    ("base", pa.float64()), ("score", pa.float64())])


def score(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10 probabilities).

    Learns from the rows that are not held out; a null text is empty and has the end of text as its only token. Without
    training rows every score is that of the only word there is, 0 for the base. Rows that repeat a key are scored apart.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    learn = rows.filter(~held_out("doc_id"))
    vocabulary = materialize(count_words(learn), "vocabulary")
    n_texts = learn.count()
    total, distinct = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    total, distinct = total + n_texts, distinct + (1 if n_texts else 0)
    top = frequent(vocabulary, KNOWN)
    masses = np.ones(ENDINGS)
    for r in ending_masses(vocabulary).collect():
        masses[r["ending"]] += r["mass"]
    head = Words(pa.array([r["word"] for r in top[:END]], pa.string()))
    np.subtract.at(masses, endings(head, np.arange(len(head))), np.array([r["n"] + 1 for r in top[:END]], float))
    counts = np.zeros(HEAD)
    counts[:len(head)] = [r["n"] for r in top[:END]]
    counts[END] = n_texts
    lexicon = Lexicon([r["word"] for r in top], [r["n"] for r in top], masses, total, distinct)
    spark = docs.sparkSession.sparkContext
    known_words, shards = spark.broadcast(lexicon), shards_of(total)  # of fixed size, like the weights
    network, _ = fit_network(training_texts(learn, known_words, shards), shards, Network.fresh(counts, masses), ROUNDS)
    shared = spark.broadcast(network.w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = known_words.value
        network, row = Network(shared.value), TaskContext.get().partitionId() << 32
        unit = np.log10(lexicon.masses)
        held, types, gathered = [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            value = score_types(network, types) / np.log(10)
            at = 0
            for rows, ids, n, known, base, counted in held:
                score = value[at:at + len(n)] + counted
                at += len(n)
                yield pa.RecordBatch.from_arrays([pa.array(rows), ids, pa.nulls(len(n), pa.string()), pa.array(n + 1), pa.array(known), pa.array(base), pa.array(score)], schema=SCORED)

        for part in parts(batches):
            words = Words(part.column("text"))
            codes, at, kind, rank, count = lexicon.types(words)
            n = words.counts()
            types += with_ends(kind[codes].astype(np.int16), words.of)
            text = np.repeat(np.arange(len(n)), n)
            is_known, tail = rank >= 0, kind >= HEAD
            value = np.log10(count + 1)
            base = np.bincount(text, value[codes], len(n)) + (np.log10(n_texts + 1) if n_texts else 0.0)
            cost = np.where(tail, np.where(is_known, value, 0) - unit[np.maximum(kind - HEAD, 0)], 0.0)
            counted = np.bincount(text, cost[codes], len(n))
            known = np.bincount(text, is_known[codes], len(n)).astype(np.int64) + (1 if n_texts else 0)
            ids = part.column("doc_id")
            rows = np.arange(row, row + len(n))
            row += len(n)
            held.append((rows, ids, n, known, base, counted))
            gathered += len(words)
            # Words that are not sent to all tasks: one row for each text and word, to meet its count.
            rare = ~is_known[codes]
            pair, times = np.unique(text[rare] * np.int64(len(at) + 1) + codes[rare], return_counts=True)
            if len(pair):
                which, code = pair // (len(at) + 1), pair % (len(at) + 1)
                names = words.strings(at)
                zero = np.zeros(len(pair))
                yield pa.RecordBatch.from_arrays([pa.array(rows[which]), pa.nulls(len(pair), pa.int64()), names.take(pa.array(code)), pa.array(times), pa.array(zero.astype(np.int64)), pa.array(zero), pa.array(zero)], schema=SCORED)
            if gathered > GATHERED:
                yield from flush()
                held, types, gathered = [], [], 0
        yield from flush()

    scored = materialize(rows.mapInArrow(run, "row long, doc_id long, word string, n long, known long, base double, score double"), "scored")
    texts = scored.filter("word is null").drop("word")
    met = scored.filter("word is not null").select("row", "word", F.col("n").alias("times")).join(vocabulary, "word")
    more = met.groupBy("row").agg(F.sum("times").alias("more_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("more"))
    out = texts.join(more, "row", "left")
    more = F.coalesce("more", F.lit(0.0))
    # A text of n tokens: n times the logarithm of N + V + 1 below the sum of those of the counts plus one.
    return out.select(
        "doc_id", held_out("doc_id").alias("held_out"), F.col("n").alias("n_tokens"), (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), (F.col("base") + more - F.col("n") * float(np.log10(total + distinct + 1))).alias("base_score"),
        (F.col("score") + more).alias("score"))
