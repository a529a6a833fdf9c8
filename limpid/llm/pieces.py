"""Encoding with a SentencePiece vocabulary, many words at once in numpy, and decoding.

Texts are cut before every space that follows something else, where no piece reaches across, and each distinct word is
encoded once. Words of the same number of characters advance together. Candidate pieces are found by the hashes of
substrings among the sorted hashes of all pieces.

* Unigram vocabularies: Viterbi. At each position the best of all pieces that end there is kept with a backpointer.
* Merge vocabularies (BPE) have no probabilities, their scores only rank pieces by frequency. Zipf's law makes probabilities
  of ranks, and with them such a vocabulary is encoded by Viterbi as well: ``likely=True``.
* What the encoder of a merge vocabulary gives is not the best path of any such search. For its ids each word's best
  adjacent pair is merged in every round, until no pair is a piece: ``likely=False``.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from limpid.llm.words import Words, mix, parts, powers, BYTE_VALUES

# Fixed values of the model format: kinds of pieces, and of models.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: How far below the worst piece an unknown character scores.
UNKNOWN_PENALTY = 10.0
MARK = "▁"
#: Longer words are cut where no piece can reach across, so a round of merging works on short rows.
LONG = 48


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(tag & 7) or varint()
            yield tag >> 3, data[at:at + size]
            at += size


class Spans(Words):
    """Texts as runs of spaces, each with what follows up to the next space after something else."""

    def __init__(self, texts: pa.Array):
        super().__init__(texts, lower=False)
        gap = self.raw == 32
        first = gap.copy()
        first[1:] &= ~gap[:-1]
        begins = self.offsets[:-1][np.diff(self.offsets) > 0]
        first[begins] = True
        self.start = np.flatnonzero(first)
        self.end = np.append(self.start[1:], len(self.raw)) if len(self.start) else self.start
        self.of = np.searchsorted(self.start, self.offsets)


class Prefixes:
    """Hashes of any substrings of some bytes."""

    def __init__(self, data: np.ndarray):
        up, self.down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE_VALUES[data] * up[:-1], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


class Vocabulary:
    """The pieces of a model file.

    ``likely`` reads a merge vocabulary as a unigram one: the piece of rank r, counted from 0, has a probability in
    proportion to 1 / (r + 1). It changes nothing in a unigram vocabulary, whose scores are log probabilities.
    """

    def __init__(self, data: bytes, likely: bool = False):
        pieces, self.kind, self.byte_fallback, self.prefix, self.squeeze, charsmap, escape = [], UNIGRAM, False, True, True, b"", True
        for number, value in fields(data):
            if number == 1:
                text, score, kind = b"", 0.0, NORMAL
                for n, v in fields(value):
                    text, score, kind = (v, score, kind) if n == 1 else (text, struct.unpack("<f", v)[0], kind) if n == 2 else (text, score, v) if n == 3 else (text, score, kind)
                pieces.append((text.decode(), score, kind))
            elif number == 2:
                for n, v in fields(value):
                    self.kind = v if n == 3 else self.kind
                    self.byte_fallback = bool(v) if n == 35 else self.byte_fallback
            elif number == 3:
                for n, v in fields(value):
                    charsmap = v if n == 2 else charsmap
                    self.prefix = bool(v) if n == 3 else self.prefix
                    self.squeeze = bool(v) if n == 4 else self.squeeze
                    escape = bool(v) if n == 5 else escape
        if charsmap or not escape or self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and merge vocabularies that leave characters as they are")
        if likely and self.kind == BPE:
            self.kind = UNIGRAM
            total = np.log(sum(1 / (1 - s) for t, s, k in pieces if k in (NORMAL, USER) and t))
            pieces = [(t, float(-np.log(1 - s) - total) if k in (NORMAL, USER) else s, k) for t, s, k in pieces]
        self.size = len(pieces)
        usable = [(i, t.replace(MARK, " "), s) for i, (t, s, k) in enumerate(pieces) if k in (NORMAL, USER) and t]
        if any(" " in t.lstrip(" ") for _, t, _ in usable):
            raise ValueError("a piece reaches across words")
        self.unknown = next((i for i, (_, _, k) in enumerate(pieces) if k == UNKNOWN), 0)
        self.byte_ids = np.full(256, self.unknown, np.uint32)
        for i, (t, _, k) in enumerate(pieces):
            if k == BYTE:
                self.byte_ids[int(t[3:5], 16)] = i
        data = np.frombuffer("".join(t for _, t, _ in usable).encode(), np.uint8)
        ends = np.cumsum([len(t.encode()) for _, t, _ in usable])
        keys = Prefixes(data)(np.append(0, ends[:-1]).astype(np.int64), ends.astype(np.int64)) if usable else np.zeros(0, np.uint64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.leading = np.zeros(1 << 20, bool)  # what some key begins with, in its first 20 bits
        self.leading[self.keys >> np.uint64(44)] = True
        self.ids = np.array([i for i, _, _ in usable], np.uint32)[order]
        self.scores = np.array([s for _, _, s in usable], np.float32)[order]
        self.longest = max((len(t) for _, t, _ in usable), default=1)
        self.worst = float(self.scores.min()) - UNKNOWN_PENALTY if usable else -UNKNOWN_PENALTY
        self.pairs = {t[i:i + 2] for _, t, _ in usable for i in range(len(t) - 1)}
        # What each id stands for in a decoded text.
        out = [bytes([int(t[3:5], 16)]) if k == BYTE else b" \xe2\x81\x87 " if k == UNKNOWN else b"" if k == CONTROL else t.replace(MARK, " ").encode() for t, _, k in pieces]
        self.surface_ends = np.cumsum([len(x) for x in out])
        self.surface = np.frombuffer(b"".join(out), np.uint8)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Position of each hash among the keys, -1 where it is no piece."""
        out = np.full(hashes.shape, -1, np.int64)
        maybe = np.flatnonzero(self.leading[hashes >> np.uint64(44)])
        some = hashes[maybe]
        at = np.minimum(np.searchsorted(self.keys, some), len(self.keys) - 1)
        out[maybe] = np.where(self.keys[at] == some, at, -1)
        return out

    def _viterbi(self, hashes: Prefixes, edge: np.ndarray) -> np.ndarray:
        """Character boundaries (rows of equal length) to a mask of the boundaries that the best path uses."""
        rows, last = edge.shape[0], edge.shape[1] - 1
        edge = np.ascontiguousarray(edge.T)  # by boundary: what stands together is read together
        sums, down = hashes.sums[edge], hashes.down[edge]
        best = np.full((last + 1, rows), -np.inf, np.float64)
        best[0] = 0
        back = np.zeros((last + 1, rows), np.int32)
        for end in range(1, last + 1):
            for start in range(max(0, end - self.longest), end):
                at = self.find(mix((sums[end] - sums[start]) * down[start] + (edge[end] - edge[start]).astype(np.uint64)))
                row = np.flatnonzero(at >= 0) if end - start > 1 else np.arange(rows)
                total = best[start][row] + np.where(at[row] >= 0, self.scores[at[row]], self.worst)
                better = total > best[end][row]
                best[end][row[better]] = total[better]
                back[end][row[better]] = start
        used = np.zeros((rows, last + 1), bool)
        at, row = np.full(rows, last), np.arange(rows)
        used[:, 0] = True
        while (at > 0).any():
            used[row, at] = True
            at = back[at, row]
        return used

    def _merge(self, hashes: Prefixes, edge: np.ndarray) -> np.ndarray:
        """As ``_viterbi``, by merging the best pair of each row in turn, the first of equal ones."""
        rows, last = edge.shape[0], edge.shape[1] - 1
        used = np.ones((rows, last + 1), bool)
        if last < 2:
            return used
        edge, column = edge.copy(), np.tile(np.arange(last + 1), (rows, 1))
        live, n = np.arange(rows), np.full(rows, last)

        def value(start: np.ndarray, end: np.ndarray) -> np.ndarray:
            at = self.find(hashes(start, end))
            return np.where(at >= 0, self.scores[at], -np.inf)

        score = value(edge[:, :-2].ravel(), edge[:, 2:].ravel()).reshape(rows, last - 1)
        while len(live):
            k = score.argmax(1)
            found = score[np.arange(len(live)), k] > -np.inf
            live, n, k, edge, column, score = live[found], n[found], k[found], edge[found], column[found], score[found]
            if not len(live):
                break
            row = np.arange(len(live))
            used[live, column[row, k + 1]] = False
            # The boundary between the pair goes; pairs beside it get new scores.
            place = np.arange(edge.shape[1] - 1)[None, :]
            take = place + (place > k[:, None])
            edge, column = np.take_along_axis(edge, take, 1), np.take_along_axis(column, take, 1)
            n = n - 1
            if score.shape[1] == 1:
                break
            place = np.arange(score.shape[1] - 1)[None, :]
            score = np.take_along_axis(score, place + (place >= k[:, None]), 1)
            for side in (k - 1, k):
                ok = (side >= 0) & (side < n - 1)
                r, s = row[ok], side[ok]
                score[r, s] = value(edge[r, s], edge[r, s + 2])
        return used

    def words(self, spans: Spans, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of these words one after another, number of ids of each)."""
        if not len(at):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        raw, hashes = spans.raw, Prefixes(spans.raw)
        begins = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))  # of characters
        first, last = np.searchsorted(begins, spans.start[at]), np.searchsorted(begins, spans.end[at])
        # Long words fall into parts that no piece joins.
        cut_first, cut_last, owner = [first], [last], [np.arange(len(at))]
        long = np.flatnonzero(last - first > LONG)
        if len(long):
            cut_last[0] = last.copy()
            for w in long.tolist():
                text = raw[spans.start[at[w]]:spans.end[at[w]]].tobytes().decode()
                cuts = first[w] + np.flatnonzero([text[i:i + 2] not in self.pairs for i in range(len(text) - 1)]) + 1
                edges = np.concatenate([[first[w]], cuts, [last[w]]])
                cut_last[0][w] = edges[1]
                cut_first.append(edges[1:-1])
                cut_last.append(edges[2:])
                owner.append(np.full(len(edges) - 2, w))
        first, last, owner = np.concatenate(cut_first), np.concatenate(cut_last), np.concatenate(owner)
        size = last - first
        heads, tails, whose = [], [], []
        for length in np.unique(size).tolist():
            mine = np.flatnonzero(size == length)
            step = max(1, (1 << 18) // (length + 1))
            for a in range(0, len(mine), step):
                some = mine[a:a + step]
                edge = begins[first[some][:, None] + np.arange(length + 1)[None, :]]
                used = (self._merge if self.kind == BPE else self._viterbi)(hashes, edge)
                row, col = np.nonzero(used)
                follow = np.flatnonzero(row[1:] == row[:-1])
                heads.append(edge[row[follow], col[follow]])
                tails.append(edge[row[follow], col[follow + 1]])
                whose.append(owner[some][row[follow]])
        head, tail, whose = np.concatenate(heads), np.concatenate(tails), np.concatenate(whose)
        order = np.lexsort((head, whose))
        head, tail, whose = head[order], tail[order], whose[order]
        place = self.find(hashes(head, tail))
        n = np.where((place < 0) & self.byte_fallback, tail - head, 1)
        ends = np.cumsum(n)
        source = np.repeat(np.arange(len(n)), n)
        ids = np.where(place >= 0, self.ids[place], self.unknown)[source].astype(np.uint32)
        if self.byte_fallback:
            unknown = place[source] < 0
            byte = head[source] + np.arange(int(ends[-1])) - (ends - n)[source]
            ids[unknown] = self.byte_ids[raw[byte[unknown]]]
        return ids, np.bincount(whose, n, len(at)).astype(np.int64)

    def cut(self, texts: pa.Array) -> tuple[Spans, np.ndarray, np.ndarray]:
        """The words of the texts, for each the number of a distinct one, and where these stand."""
        pc = pa.compute
        texts = pc.replace_substring(pc.fill_null(texts, ""), MARK, " ")
        if self.squeeze:
            texts = pc.replace_substring_regex(pc.utf8_trim(texts, " "), " +", " ")
        if self.prefix:
            texts = pc.if_else(pc.equal(texts, ""), "", pc.binary_join_element_wise(" ", texts, ""))
        spans = Spans(texts)
        return spans, *spans.distinct()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of them for each). Null and empty texts have none."""
        return self.joined(*self.cut(texts))

    def joined(self, spans: Spans, codes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As ``encode``, of texts that are cut. Both readings of a model file cut alike."""
        ids, n = self.words(spans, at)
        begin = np.cumsum(n) - n
        count = n[codes] if len(codes) else np.zeros(0, np.int64)
        ends = np.cumsum(count)
        flat = ids[np.repeat(begin[codes] - (ends - count), count) + np.arange(int(ends[-1]))] if len(ends) else ids
        n = np.diff(np.append(0, ends)[spans.of])
        if not self.byte_fallback and len(flat):  # a run of unknown characters is one id
            text = np.repeat(np.arange(len(n)), n)
            again = np.append(False, (flat[1:] == self.unknown) & (flat[:-1] == self.unknown) & (text[1:] == text[:-1]))
            flat, n = flat[~again], np.bincount(text[~again], minlength=len(n))
        return flat, n

    def decode(self, ids: np.ndarray, n: np.ndarray) -> list[bytes]:
        """The bytes of each text; without the space that encoding put in front."""
        size = np.diff(self.surface_ends, prepend=0)[ids]
        ends = np.cumsum(size)
        data = self.surface[np.repeat((self.surface_ends[ids] - size) - (ends - size), size) + np.arange(int(ends[-1]))] if len(ids) else self.surface[:0]
        data, edges = data.tobytes(), np.append(0, ends)[np.append(0, np.cumsum(n))].tolist()
        out = [data[a:b] for a, b in zip(edges, edges[1:])]
        return [x[1:] if self.prefix and x[:1] == b" " else x for x in out]


_LOADED: dict[tuple[str, bool], Vocabulary] = {}


def vocabulary(path: str, likely: bool = False) -> Vocabulary:
    """The vocabulary of this worker process."""
    if (path, likely) not in _LOADED:
        with open(path, "rb") as f:
            _LOADED[path, likely] = Vocabulary(f.read(), likely)
    return _LOADED[path, likely]


def encoded(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", likely: bool = False) -> DataFrame:
    """doc_id and ids of every row; null and empty texts have no ids. ``likely``: by Viterbi whatever the vocabulary."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches):
            ids, n = vocabulary(path, likely).encode(part.column("text"))
            ends = pa.array(np.append(0, np.cumsum(n)), pa.int32())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(ends, pa.array(ids.astype(np.int32)))], ["doc_id", "ids"])
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decoded(rows: DataFrame, path: str) -> DataFrame:
    """doc_id and text of rows of (doc_id, ids); bytes that are no UTF-8 become replacement characters, null ids an empty text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            n = pa.compute.fill_null(pa.compute.list_value_length(ids), 0).to_numpy()
            texts = vocabulary(path).decode(ids.flatten().to_numpy().astype(np.int64), n)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x.decode(errors="replace") for x in texts], pa.string())], ["doc_id", "text"])
    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row, after encoding it by Viterbi and decoding the ids: doc_id, n_tokens, ids_crc32 (of the ids as little-endian
    32-bit integers), n_bytes of the decoded text, and whether it is the text again (same). The columns merge_tokens,
    merge_crc32 and merge_same tell the same of the ids that the vocabulary's own encoder gives.

    Null and empty texts have no tokens. Rows without a key and repeated rows are rows like any other.
    """
    def digest(ids: np.ndarray, n: np.ndarray) -> pa.Array:
        edges, wide = np.append(0, np.cumsum(n)).tolist(), ids.astype("<u4")
        return pa.array([zlib.crc32(wide[a:b]) for a, b in zip(edges, edges[1:])], pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches):
            best, merged = vocabulary(path, True), vocabulary(path)
            texts = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in part.column("text")]
            cut = best.cut(part.column("text"))
            out = [part.column("doc_id")]
            for words in (best, merged):
                ids, n = words.joined(*cut)
                back = words.decode(ids, n)
                out += [pa.array(n, pa.int64()), digest(ids, n)]
                out += [pa.array([len(x) for x in back], pa.int64())] if words is best else []
                out.append(pa.array([x == t for x, t in zip(back, texts)], pa.bool_()))
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "n_tokens", "ids_crc32", "n_bytes", "same", "merge_tokens", "merge_crc32", "merge_same"])
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long, n_bytes long, same boolean, merge_tokens long, merge_crc32 long, merge_same boolean")
