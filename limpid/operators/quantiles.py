"""Exact, linearly interpolated quantiles with bounded memory.

Spark's ``percentile`` keeps every distinct value of a column in one aggregation buffer. Here a quantile sketch brackets
the wanted order statistic, one aggregate counts the rows below and inside the bracket, and the bracket shrinks by
three orders of magnitude per round until so few values are left in it that they can be sorted. Every table size takes
the same steps, and an answer is made of values at ranks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

CELL_LIMIT = 200_000  # values inside all brackets that are sorted in one buffer
ACCURACY = 10_000


def exact_quantiles(df: DataFrame, exprs: dict[str, Column], probs, cell_limit: int = CELL_LIMIT,
                    accuracy: int = ACCURACY) -> dict[str, list]:
    """``{name: [quantile per prob]}`` of numeric expressions; ``None`` where there is no value."""
    probs = list(probs)
    if not exprs:
        return {}
    names = list(exprs)
    data = df.select(*[exprs[n].cast("double").alias(f"x{i}") for i, n in enumerate(names)])
    # The shares do not depend on the number of rows, so the first sketch and the count are one pass.
    first = data.agg(*[F.count(c).alias(f"n_{c}") for c in data.columns],
                     *[F.approx_percentile(c, F.array(*_sides(probs, accuracy)), F.lit(accuracy)).alias(f"s_{c}") for c in data.columns]).first()
    counts = {c: first[f"n_{c}"] for c in data.columns}
    spots = {c: [p * (n - 1) for p in probs] for c, n in counts.items() if n}
    marks = {(c, r): tuple(first[f"s_{c}"][2 * k:2 * k + 2]) for c, ps in spots.items()
             for k, p in enumerate(ps) for r in (math.floor(p), math.ceil(p))}
    values = _order_statistics(data, marks, counts, cell_limit, accuracy)
    result = {}
    for i, n in enumerate(names):
        c = f"x{i}"
        if c not in spots:
            result[n] = [None] * len(probs)
            continue
        result[n] = []
        for p in spots[c]:
            low, high = values[c, math.floor(p)], values[c, math.ceil(p)]
            result[n].append(low + (high - low) * (p - math.floor(p)))
    return result


def _sides(shares, accuracy: int) -> list[Column]:
    """A share on either side of each, as far apart as the sketch may err."""
    slack = 2.0 / accuracy
    return [F.lit(min(1.0, max(0.0, a + side))) for a in shares for side in (-slack, slack)]


def _order_statistics(data: DataFrame, marks: dict, totals: dict, cell_limit: int, accuracy: int) -> dict:
    """Value at each zero-based ``(column, rank)`` of ``marks``, which has two sketched values around it.

    A bracket is an open interval ``(low, high)`` with the rows at or below ``low`` and the rows inside.
    Its ends are data values that were ruled out, so every round makes progress whatever the skew.
    """
    if not marks:
        return {}
    solved, brackets = _cut(data, {(c, r): (None, None, 0, totals[c]) for c, r in marks}, marks)
    while brackets:
        if sum({(k[0], b): b[3] for k, b in brackets.items()}.values()) <= cell_limit:
            return {**solved, **_finish(data, brackets)}
        found, brackets = _cut(data, brackets, _sketch(data, brackets, accuracy))
        solved.update(found)
    return solved


def _inside(c: str, low, high) -> Column:
    keep = F.col(c).isNotNull()
    if low is not None:
        keep &= F.col(c) > low
    if high is not None:
        keep &= F.col(c) < high
    return F.when(keep, F.col(c))


def _finish(data: DataFrame, brackets: dict) -> dict:
    """The wanted ranks, read off the few rows left in every bracket."""
    shared = _by_bracket(brackets)

    def at_ranks(values, below, ranks):
        return F.transform(F.lit([r - below for r in ranks]), lambda r: F.get(values, r.cast("int")))

    lists = data.agg(*[F.sort_array(F.collect_list(_inside(c, low, high))).alias(f"l{i}") for i, (c, low, high, _, _) in enumerate(shared)])
    row = lists.select(*[at_ranks(F.col(f"l{i}"), below, ranks).alias(f"v{i}")
                         for i, ((_, _, _, below, _), ranks) in enumerate(shared.items())]).first()
    return {(c, r): v for i, ((c, *_), ranks) in enumerate(shared.items()) for r, v in zip(ranks, row[f"v{i}"])}


def _by_bracket(brackets: dict) -> dict:
    """``{(column, low, high, below, inside): [ranks]}``: ranks that share a bracket share its sketch."""
    shared = {}
    for (c, r), bracket in brackets.items():
        shared.setdefault((c, *bracket), []).append(r)
    return shared


def _sketch(data: DataFrame, brackets: dict, accuracy: int) -> dict:
    """Two sketched values around every wanted rank, from the rows inside its bracket."""
    shared = _by_bracket(brackets)
    asks = []
    for i, ((c, low, high, below, inside), ranks) in enumerate(shared.items()):
        at = [(r - below) / max(1, inside - 1) for r in ranks]
        asks.append(F.approx_percentile(_inside(c, low, high), F.array(*_sides(at, accuracy)), F.lit(accuracy)).alias(f"s{i}"))
    sketch = data.agg(*asks).first()
    marks = {}  # (column, rank) -> the two sketched values around it
    for i, ((c, *_), ranks) in enumerate(shared.items()):
        values = sketch[f"s{i}"]
        marks.update({(c, r): (values[2 * k], values[2 * k + 1]) for k, r in enumerate(ranks)})
    return marks


def _cut(data: DataFrame, brackets: dict, marks: dict) -> tuple[dict, dict]:
    """Exact counts at the sketched values decide ranks, or leave smaller brackets."""
    places = sorted({(c, v) for (c, _), pair in marks.items() for v in pair})
    seen = data.agg(*[f(F.col(c), v).alias(f"{tag}{i}") for i, (c, v) in enumerate(places)
                      for tag, f in (("lt", lambda x, v: F.count_if(x < v)), ("le", lambda x, v: F.count_if(x <= v)))]).first()
    below_of = {place: seen[f"lt{i}"] for i, place in enumerate(places)}
    upto = {place: seen[f"le{i}"] for i, place in enumerate(places)}
    solved, left = {}, {}
    for (c, r), (a, b) in marks.items():
        low, high, below, inside = brackets[c, r]
        if below_of[c, a] <= r < upto[c, a]:
            solved[c, r] = a
        elif below_of[c, b] <= r < upto[c, b]:
            solved[c, r] = b
        elif r < below_of[c, a]:
            left[c, r] = (low, a, below, below_of[c, a] - below)
        elif r >= upto[c, b]:
            left[c, r] = (b, high, upto[c, b], below + inside - upto[c, b])
        else:
            left[c, r] = (a, b, upto[c, a], below_of[c, b] - upto[c, a])
    return solved, left


def tukey_fences(df: DataFrame, exprs: dict[str, Column]) -> dict[str, tuple]:
    """``{name: (low, high)}``; ``None`` bounds where the column has no value."""
    fences = {}
    for name, (q1, q3) in exact_quantiles(df, exprs, [0.25, 0.75]).items():
        if q1 is None:
            fences[name] = (None, None)
        else:
            fences[name] = (q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))
    return fences
