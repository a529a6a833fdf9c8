"""Languages of a document as a mixture.

Each learned language is a distribution over byte trigrams of words. The words of a document are drawn from a mixture of
languages whose shares are found by expectation-maximisation; a set of languages is chosen by likelihood less a penalty
for each language beyond the first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from limpid.llm.words import Words, parts

UNKNOWN = "und"
#: Trigrams are hashed to so many cells, so a model has a fixed size per language.
CELLS = 1 << 15
#: Bound of the training sample: the expected number of documents of each language, chosen by a hash of the key.
SAMPLE_PER_LANGUAGE = 2000
ROUNDS = 12
CLOSE = 1e-3
#: What each further language must gain, in units of half the logarithm of the number of words.
PENALTY = 4.0

#: Words here are runs of letters; all bytes beyond ASCII count as letters.
NOT_LETTER = np.ones(256, bool)
NOT_LETTER[65:91] = NOT_LETTER[97:123] = NOT_LETTER[128:] = False
EDGE = 32


def _cells(words: Words, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cell of each trigram of these words, first trigram of each); an edge mark stands on both sides of a word."""
    size = words.end[at] - words.start[at] + 2
    ends = np.cumsum(size)
    data = np.full(int(ends[-1]) if len(ends) else 0, EDGE, np.uint32)
    inner = np.ones(len(data), bool)
    inner[ends - 1] = inner[ends - size] = False
    take = np.repeat(words.start[at] - (ends - size) - 1, size) + np.arange(len(data))
    data[inner] = words.bytes[take[inner]]
    code = np.zeros(len(data), np.uint32)
    code[:-2] = data[:-2] << 16 | data[1:-1] << 8 | data[2:]
    keep = np.ones(len(data), bool)
    keep[ends - 1] = keep[ends - 2] = False
    cell = (code[keep] * np.uint32(0x9E3779B1)) >> np.uint32(32 - 15)
    grams = size - 2
    return cell.astype(np.int64), np.cumsum(grams) - grams


def held_out(key: str | Column, folds: int = 5) -> Column:
    """Whether the crc32 of the key as text leaves remainder 0; a null key counts as empty text."""
    column = F.col(key) if isinstance(key, str) else key
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % folds == 0


class Model:
    """Log-probabilities of trigram cells per language."""

    def __init__(self, languages: list[str], table: np.ndarray):
        self.languages, self.table = languages, table

    def words(self, words: Words, at: np.ndarray) -> np.ndarray:
        """Log-likelihood of each of these words in each language."""
        if not len(at):
            return np.zeros((0, len(self.languages)), np.float32)
        cell, first = _cells(words, at)
        return np.add.reduceat(self.table[cell], first, axis=0)


def fit(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Learns from labelled rows outside the held-out fold, about ``per_language`` documents of each language.

    Rows whose text or label is null are no labels. Without any labels the model knows no language.
    """
    labelled = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull() & ~held_out(key))
    sizes = {r[lang]: r["count"] for r in labelled.groupBy(lang).count().collect()}
    if not sizes:
        return Model([], np.zeros((CELLS, 0), np.float32))
    names = sorted(sizes)
    share = F.create_map(*[F.lit(x) for n in names for x in (n, min(1.0, per_language / sizes[n]))])
    draw = F.pmod(F.xxhash64(key), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = labelled.filter(draw < share[F.col(lang)]).select(F.col(lang).alias("lang"), F.col(text).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(names), CELLS))
        for part in parts(batches):
            words = Words(part.column("text"), space=NOT_LETTER)
            codes, at = words.distinct()
            if not len(at):
                continue
            cell, first = _cells(words, at)
            grams = np.diff(np.append(first, len(cell)))
            language = np.repeat([names.index(x) for x in part.column("lang").to_pylist()], words.counts())
            for i in np.unique(language):
                n = np.bincount(codes[language == i], minlength=len(at))
                total[i] += np.bincount(cell, np.repeat(n, grams), CELLS)
        language, cell = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(language), pa.array(cell), pa.array(total[language, cell])], ["language", "cell", "n"])

    counted = sample.mapInArrow(count, "language long, cell long, n double").groupBy("language", "cell").agg(F.sum("n").alias("n")).toPandas()
    table = np.full((CELLS, len(names)), 0.1)
    table[counted["cell"].to_numpy(np.int64), counted["language"].to_numpy(np.int64)] += counted["n"].to_numpy()
    return Model(names, np.log(table / table.sum(0)).astype(np.float32))


def _mixture(likelihood: np.ndarray, of: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shares of the allowed languages, log-likelihood) of each document; each has at least one word.

    likelihood: of each word, scaled to a largest value of 1; of: first word of each document, and the number of words.
    """
    n = np.diff(of)
    shares = allowed / allowed.sum(1, keepdims=True)
    active, fit = np.arange(len(n)), np.zeros(len(n))
    for _ in range(ROUNDS):
        if len(active) == len(n):
            part, first, size = likelihood, of[:-1], n
        else:
            size = n[active]
            first = np.cumsum(size) - size
            part = likelihood[np.repeat(of[active] - first, size) + np.arange(int(size.sum()))]
        weight = part * np.repeat(shares[active].astype(np.float32), size, axis=0)
        total = weight.sum(1) + np.float32(1e-30)
        fit[active] = np.add.reduceat(np.log(total), first)
        weight /= total[:, None]
        new = np.add.reduceat(weight, first, axis=0) / size[:, None]
        moved = np.abs(new - shares[active]).max(1) > CLOSE
        shares[active] = new
        active = active[moved]
        if not len(active):
            break
    return shares, fit


def mixtures(texts: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(share of each language, number of words) of each text, over the set of languages chosen for it."""
    words, L = Words(texts, space=NOT_LETTER), len(model.languages)
    n = words.counts()
    shares = np.zeros((len(n), L))
    full = np.flatnonzero(n)
    if not L or not len(full):
        return shares, n
    codes, at = words.distinct()
    score = model.words(words, at)
    scale = score.max(1)
    likelihood = np.exp(score - scale[:, None])[codes]
    of = np.append(words.of[:-1][full], words.of[-1])
    every = np.ones((len(full), L))
    found, _ = _mixture(likelihood, of, every)
    rank = np.argsort(-found, axis=1, kind="stable")
    best = np.full(len(full), -np.inf)
    size = np.diff(of)
    for k in range(1, L + 1):
        # A language that accounts for less than half a word gains less than its penalty: only others are tried.
        tried = np.arange(len(full)) if k == 1 else np.flatnonzero(found[np.arange(len(full)), rank[:, k - 1]] * size >= 0.5)
        if not len(tried):
            break
        allowed = np.zeros((len(tried), L))
        np.put_along_axis(allowed, rank[tried, :k], 1, 1)
        count = size[tried]
        begin = np.concatenate([[0], np.cumsum(count)])
        part = likelihood if len(tried) == len(full) else likelihood[np.repeat(of[:-1][tried] - begin[:-1], count) + np.arange(begin[-1])]
        if k == 1:
            chosen = np.repeat(rank[tried, 0], count)
            fit = np.add.reduceat(np.log(part[np.arange(len(part)), chosen] + np.float32(1e-30)), begin[:-1])
            proportion = allowed
        else:
            proportion, fit = _mixture(part, begin, allowed)
        value = fit - PENALTY * (k - 1) * 0.5 * np.log(count + 1)
        better = value > best[tried]
        best[tried[better]] = value[better]
        shares[full[tried[better]]] = proportion[better]
    return shares, n


def predict(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, lang_pred, score and languages.

    ``lang_pred`` is the language of the largest share (the first by name where two are equal) and ``score`` that share;
    ``languages`` lists the chosen set, largest share first. A text that is null or has no letter is ``und`` with score 0,
    and so is any text if the model knows no language.
    """
    names = model.languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches):
            texts = part.column("text")
            shares, n = mixtures(texts, model)
            best = shares.argmax(1) if names else np.zeros(len(n), int)
            plain = pa.compute.match_substring_regex(texts, "[A-Za-z]").fill_null(False).to_numpy(zero_copy_only=False)
            letters = plain.copy()
            for i in np.flatnonzero(~plain & (n > 0)):  # letters beyond ASCII, or only signs
                letters[i] = any(map(str.isalpha, texts[int(i)].as_py()))
            known = letters & (n > 0) & bool(names)
            order = np.argsort(-shares, axis=1, kind="stable")
            yield pa.RecordBatch.from_arrays([
                part.column("doc_id"), pa.array([names[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist())]),
                pa.array([min(1.0, float(shares[i, b])) if k else 0.0 for i, (b, k) in enumerate(zip(best.tolist(), known.tolist()))], pa.float64()),
                pa.array([",".join(names[j] for j in order[i] if shares[i, j] > 0) if k else "" for i, k in enumerate(known.tolist())])],
                ["doc_id", "lang_pred", "score", "languages"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, languages string")


def accept(docs: DataFrame, model: Model, least: float = 0.0, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text is in learned languages, the first of them with a share of at least
    ``least``. Texts that ``predict`` calls unknown go; a mixture of learned languages stays."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches, text):
            shares, _ = mixtures(part.column(text), model)
            top = shares.max(1) if model.languages else np.zeros(len(part))
            plain = pa.compute.match_substring_regex(part.column(text), "[A-Za-z]").fill_null(False).to_numpy(zero_copy_only=False)
            ok = (top > 0) & (top >= least)
            for i in np.flatnonzero(ok & ~plain):
                ok[i] = any(map(str.isalpha, part.column(text)[int(i)].as_py()))
            yield part.filter(pa.array(ok)).select(names)

    return docs.mapInArrow(run, docs.schema)
