r"""Words of whole texts, found and hashed in numpy over the bytes of an Arrow batch.

Words are the runs of ``[^\x20\x09-\x0D]``; A-Z count as a-z. A null text has no words.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute

#: Texts are worked on in slices of about so many bytes, which bounds the memory of a task. One longer text is one slice.
SLICE_BYTES = 2 << 20
#: A slice has no more rows, so that a row's place in it has 16 bits.
SLICE_ROWS = 1 << 16

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
PLAIN = np.arange(256, dtype=np.uint8)
MULTIPLIER = 0x9E3779B97F4A7C15
#: One fixed random value per byte.
BYTE_VALUES = np.random.Generator(np.random.PCG64(7)).integers(1, 2**63, 256, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every input bit over the 64 bits of the result; one to one."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    def row(base: int) -> np.ndarray:
        out = np.full(size, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)
    return row(MULTIPLIER), row(pow(MULTIPLIER, -1, 1 << 64))


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2**64."""
    room = SLICE_BYTES + 64
    while room < size:
        room *= 2
    up, down = _powers(room)
    return up[:size], down[:size]


def slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``SLICE_BYTES`` each, of ``SLICE_ROWS`` rows at most."""
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(texts), 0))
    begin, total = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if total and total + size > SLICE_BYTES or i - begin == SLICE_ROWS:
            yield begin, i
            begin, total = i, 0
        total += size
    if begin < len(texts):
        yield begin, len(texts)


class Words:
    """The words of a slice of texts: byte ranges, hashes, and the range of words of each text.

    ``space`` says which bytes part words.
    """

    def __init__(self, texts: pa.Array, lower: bool = True, space: np.ndarray = SPACE):
        texts = pa.compute.fill_null(texts, "")
        wide = pa.types.is_large_string(texts.type)
        _, ends, data = texts.buffers()
        offsets = np.frombuffer(ends, np.int64 if wide else np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
        raw = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None and len(offsets) else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0] if len(offsets) else np.zeros(1, np.int64)
        self.raw, self.offsets = raw, offsets
        self.bytes = (LOWER if lower else PLAIN)[raw]
        inside = np.zeros(len(raw) + 1, bool)
        np.logical_not(space[raw], out=inside[:-1])
        first = inside[:-1].copy()
        first[1:] &= ~inside[:-2]
        breaks = offsets[1:-1][offsets[1:-1] < len(raw)]
        first[breaks] |= inside[breaks]
        last = inside[:-1] & ~inside[1:]
        before = breaks[breaks > 0] - 1
        last[before] |= inside[before]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.of = np.searchsorted(self.start, offsets)

    def __len__(self) -> int:
        return len(self.start)

    def counts(self) -> np.ndarray:
        """Words of each text."""
        return np.diff(self.of)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        up, down = powers(len(self.bytes))
        sums = np.zeros(len(self.bytes) + 1, np.uint64)
        np.cumsum(BYTE_VALUES[self.bytes] * up, out=sums[1:])
        return mix((sums[self.end] - sums[self.start]) * down[self.start] + (self.end - self.start).astype(np.uint64))

    def distinct(self, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(code of each word, index of a word with that code): equal words share a code."""
        codes, found = pd.factorize(self.hashes() if hashes is None else hashes)
        at = np.empty(len(found), np.int64)
        at[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
        return codes, at

    def strings(self, at: np.ndarray, raw: bool = False) -> pa.Array:
        """The words at these indices."""
        sizes = self.end[at] - self.start[at]
        ends = np.zeros(len(at) + 1, np.int64)
        np.cumsum(sizes, out=ends[1:])
        take = np.repeat(self.start[at] - ends[:-1], sizes) + np.arange(ends[-1])
        data = (self.raw if raw else self.bytes)[take]
        return pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(data)]).cast(pa.string())

    def shingles(self, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
        """(hash of each run of ``width`` words, range of them of each text), repeats kept.

        A text of fewer words has one run of all its words; a text without words has none.
        """
        h, counts = self.hashes(), self.counts()
        n = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
        of = np.zeros(len(n) + 1, np.int64)
        np.cumsum(n, out=of[1:])
        out = np.empty(of[-1], np.uint64)
        full = np.zeros(max(len(h) - width + 1, 0), np.uint64)
        salt = mix(np.arange(1, 2 * width + 1, dtype=np.uint64))
        for k in range(width):
            full += h[k:k + len(full)] * (salt[k] | np.uint64(1))
        full = mix(full)
        inside = np.repeat(self.of[:-1] - of[:-1], n) + np.arange(of[-1])
        long = np.repeat(counts >= width, n)
        out[long] = full[inside[long]]
        for size in range(1, width):
            texts = np.flatnonzero(counts == size)
            if len(texts):
                s = np.full(len(texts), salt[width + size], np.uint64)
                for k in range(size):
                    s += h[self.of[texts] + k] * (salt[k] | np.uint64(1))
                out[of[texts]] = mix(s)
        return out, of


def parts(batches: Iterable[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """Batches cut into slices of bounded size."""
    for batch in batches:
        for a, b in slices(batch.column(column)):
            yield batch.slice(a, b - a)
