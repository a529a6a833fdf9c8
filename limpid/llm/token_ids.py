"""Token ids of a corpus as one long array in files, with Elias-Fano encoded document boundaries.

Documents are laid out in ascending key order. A file row is a shard: the ids of some documents, end ids included, and
the boundaries between them. Boundaries take about ``2 + log2(mean length)`` bits each; ``Boundaries.select`` finds any
of them through sampled counts, without a table of 64-bit offsets.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from limpid.llm.words import Words, parts

MAGIC = b"IDEF0001"
HEAD = struct.Struct("<8sBIQQ")
BLOCK_BITS = 512
#: Distinct words whose ids a task remembers between slices; beyond it, it starts afresh.
MEMORY_WORDS = 1_000_000


class Boundaries:
    """A rising sequence of integers in Elias-Fano form: low bits packed, high bits in unary."""

    def __init__(self, low_bits: int, n: int, low: np.ndarray, high: np.ndarray, before: np.ndarray):
        self.low_bits, self.n, self.low, self.high, self.before = low_bits, n, low, high, before

    @classmethod
    def build(cls, values: np.ndarray) -> "Boundaries":
        values = np.asarray(values, np.uint64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        bits = max(0, (top // n).bit_length() - 1) if n else 0
        spread = ((values[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        flags = np.zeros(-(-(n + (top >> bits) + 1) // BLOCK_BITS) * BLOCK_BITS, np.uint8)
        flags[(values >> np.uint64(bits)).astype(np.int64) + np.arange(n)] = 1
        ones = flags.reshape(-1, BLOCK_BITS).sum(1, dtype=np.uint32)
        return cls(bits, n, np.packbits(spread.ravel(), bitorder="little"), np.packbits(flags, bitorder="little"),
                   np.concatenate([[0], np.cumsum(ones)[:-1]]).astype(np.uint32))

    def select(self, which: np.ndarray) -> np.ndarray:
        """The values at these indices: the block by the sampled counts, the bit by a count within the block."""
        which = np.asarray(which, np.int64)
        if not len(which):
            return np.zeros(0, np.int64)
        block = np.searchsorted(self.before, which, "right") - 1
        at = np.empty(len(which), np.int64)
        rows, back = np.unique(block, return_inverse=True)
        for a in range(0, len(rows), 4096):
            bits = np.unpackbits(self.high.reshape(-1, BLOCK_BITS // 8)[rows[a:a + 4096]], axis=1, bitorder="little")
            row, column = np.nonzero(bits)
            first = np.searchsorted(row, np.arange(len(bits)))
            mine = (back >= a) & (back < a + 4096)
            k = back[mine] - a
            at[mine] = block[mine] * BLOCK_BITS + column[first[k] + which[mine] - self.before[block[mine]]]
        value = (at - which) << self.low_bits
        for bit in range(self.low_bits):
            place = which * self.low_bits + bit
            value |= ((self.low[place >> 3] >> (place & 7).astype(np.uint8)) & 1).astype(np.int64) << bit
        return value

    def to_bytes(self) -> bytes:
        return struct.pack("<BIII", self.low_bits, self.n, len(self.low), len(self.high)) + self.low.tobytes() + self.high.tobytes() + self.before.astype("<u4").tobytes()

    @classmethod
    def from_bytes(cls, data: memoryview) -> tuple["Boundaries", int]:
        bits, n, low, high = struct.unpack_from("<BIII", data)
        at = 13
        blocks = high * 8 // BLOCK_BITS
        end = at + low + high + 4 * blocks
        return cls(bits, n, np.frombuffer(data, np.uint8, low, at), np.frombuffer(data, np.uint8, high, at + low),
                   np.frombuffer(data, "<u4", blocks, at + low + high)), end


def pack_shard(keys: list, ids: np.ndarray, ends: np.ndarray, start: int) -> bytes:
    """A shard: header, keys, boundaries, ids. ``start`` counts the ids of its task before it."""
    width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    null = np.array([k is None for k in keys], np.uint8)
    number = np.array([0 if k is None else k for k in keys], "<i8")
    return b"".join([HEAD.pack(MAGIC, width, len(keys), len(ids), start), null.tobytes(), number.tobytes(),
                     Boundaries.build(ends).to_bytes(), ids.astype(f"<u{width}").tobytes()])


def unpack_shard(data: bytes) -> tuple[list, Boundaries, np.ndarray, int]:
    """(keys, boundaries, ids, start) of a shard."""
    view = memoryview(data)
    magic, width, n, total, start = HEAD.unpack_from(view)
    if magic != MAGIC:
        raise ValueError("not a shard of token ids")
    at = HEAD.size
    null, number = np.frombuffer(view, np.uint8, n, at), np.frombuffer(view, "<i8", n, at + n)
    at += 9 * n
    bounds, used = Boundaries.from_bytes(view[at:])
    return [None if x else int(k) for x, k in zip(null, number)], bounds, np.frombuffer(view, f"<u{width}", total, at + used), start


class WordEncoder:
    """Encodes texts word by word with a tokenizer that drops white space, each distinct word once.

    Such a tokenizer never joins characters across ASCII white space, so the ids of a text are those of its words.
    """

    SEPARATOR, GROUP = "<|endoftext|>", 500

    def __init__(self, path: str):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.separator = self.tokenizer.token_to_id(self.SEPARATOR)
        self.forget()

    def forget(self) -> None:
        self.known, self.at, self.pool = np.zeros(0, np.uint64), np.zeros((0, 2), np.int64), np.zeros(0, np.uint32)

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of them for each word); plain words are joined by a special token, which costs less per word."""
        odd = [i for i, w in enumerate(words) if "<|" in w]
        plain = words if not odd else ["" if "<|" in w else w for w in words]
        joined = [self.SEPARATOR.join(plain[i:i + self.GROUP]) for i in range(0, len(plain), self.GROUP)]
        pieces = []
        for text in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False):
            pieces += [np.array(text.ids, np.uint32), np.array([self.separator], np.uint32)]
        ids = np.concatenate(pieces) if pieces else np.zeros(0, np.uint32)
        ends = np.flatnonzero(ids == self.separator)
        counts = np.diff(ends, prepend=-1) - 1
        ids = ids[ids != self.separator]
        if odd:
            split = np.split(ids, np.cumsum(counts)[:-1])
            for i in odd:
                split[i] = np.array(self.tokenizer.encode(words[i], add_special_tokens=False).ids, np.uint32)
            ids, counts = np.concatenate(split), np.array([len(x) for x in split])
        return ids, counts

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of them for each text)."""
        special = pa.compute.any(pa.compute.match_substring(texts, "<|")).as_py()
        words = Words(texts, lower=not special)
        hashes = words.hashes()
        codes, at = words.distinct(hashes)
        found = hashes[at]
        if special:  # case counts here, so these words are not remembered
            ids, n = self._encode(words.strings(at, raw=True).to_pylist())
            where = np.stack([np.cumsum(n) - n, n], 1)
        else:
            if len(self.known) > MEMORY_WORDS:
                self.forget()
            place = np.minimum(np.searchsorted(self.known, found), max(len(self.known) - 1, 0))
            new = self.known[place] != found if len(self.known) else np.ones(len(found), bool)
            if new.any():
                ids, n = self._encode(words.strings(at[new]).to_pylist())
                here = np.stack([np.cumsum(n) - n + len(self.pool), n], 1)
                self.pool = np.concatenate([self.pool, ids])
                known, where = np.concatenate([self.known, found[new]]), np.concatenate([self.at, here])
                order = np.argsort(known)
                self.known, self.at = known[order], where[order]
                place = np.searchsorted(self.known, found)
            where, ids = (self.at[place], self.pool) if len(self.known) else (np.zeros((0, 2), np.int64), self.pool)
        n = where[codes, 1] if len(codes) else np.zeros(0, np.int64)
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        flat = ids[np.repeat(where[codes, 0] - (ends - n), n) + np.arange(total)] if total else np.zeros(0, np.uint32)
        return flat, np.diff(np.concatenate([[0], ends])[words.of])


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The encoder of this worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text") -> None:
    """Encodes every text, adds ``end_id`` to each and writes the shards in ascending key order.

    Rows with equal keys are ordered by a hash of their text, null keys come first, null texts are empty.
    """
    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, start, number, task = encoder(tokenizer), 0, 0, TaskContext.get().partitionId()
        for part in parts(batches):
            ids, n = encode(part.column("text"))
            ends = np.cumsum(n + 1)
            full = np.full(int(ends[-1]), end_id, np.uint32)
            body = np.ones(len(full), bool)
            body[ends - 1] = False
            full[body] = ids
            shard = pack_shard(part.column("key").to_pylist(), full, ends, start)
            yield pa.RecordBatch.from_pydict({"task": [task], "number": [number], "n_ids": [len(full)], "shard": [shard]},
                                             pa.schema([("task", pa.int64()), ("number", pa.int64()), ("n_ids", pa.int64()), ("shard", pa.binary())]))
            start, number = start + len(full), number + 1

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).withColumn("tie", F.xxhash64("text"))
    dealt = rows.repartitionByRange("key", "tie").sortWithinPartitions("key", "tie").select("key", "text")
    dealt.mapInArrow(shards, "task long, number long, n_ids long, shard binary").write.parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Per document: doc_id, start (ids before it), n_tokens, ids_crc32 (of the ids as little-endian 32-bit integers)."""
    shards = spark.read.parquet(path)
    # One row per writing task: the ids before each task are sums over a list as short as the list of tasks.
    sums = shards.groupBy("task").agg(F.sum("n_ids").alias("n")).orderBy("task").collect()
    before, bases = 0, []
    for row in sums:
        bases.append((row["task"], before))
        before += row["n"]
    base = spark.createDataFrame(bases, "task long, base long")

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, shard in zip(batch.column("base").to_pylist(), batch.column("shard")):
                keys, bounds, ids, start = unpack_shard(shard.as_buffer())
                ends = bounds.select(np.arange(len(keys)))
                begin = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                wide = ids.astype("<u4")
                sums = [zlib.crc32(wide[a:b]) for a, b in zip(begin.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64()), pa.array(begin + start + base), pa.array(ends - begin), pa.array(sums, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"])

    met = shards.select("task", "shard").join(F.broadcast(base), "task").select("base", "shard")
    return met.mapInArrow(documents, "doc_id long, start long, n_tokens long, ids_crc32 long")
