"""Outlier detection: Tukey fences per column, and an isolation forest over all numeric columns.

The forest follows the published algorithm (Liu, Ting and Zhou, 2008): every tree sees a small random
sample, so fitting cost does not depend on the table size. Spark draws the samples, fits the trees in
parallel groups of bounded size and scores the rows in Arrow batches.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from limpid import vocab
from limpid.functions import numbers
from limpid.operators.cells import cell, col
from limpid.operators.columns import column_dict
from limpid.operators.quantiles import exact_quantiles, tukey_fences
from limpid.storage import materialize

GRAIN = 1 << 20  # resolution of the sampling hash


def numeric_features(df: DataFrame, exclude=()) -> list[str]:
    """Numeric columns with at least two distinct values, without flags and scores of an earlier run."""
    reserved = set(vocab.OUTLIER_COLUMNS) | set(exclude) | {"_pos"}
    names = [f.name for f in df.schema if numbers.is_numeric(f.dataType) and f.name not in reserved]
    seen = column_dict(df, {"varies": lambda v, kind: F.min(v) < F.max(v)}, names)
    return [c for c in names if seen[c]["varies"]]


def standardized(df: DataFrame, features) -> dict[str, Column]:
    """Features with missing values at the median, then centred and scaled by the population deviation."""
    if not features:
        return {}
    medians = exact_quantiles(df, {c: cell(df, c) for c in features}, [0.5])
    full = {c: F.coalesce(cell(df, c).cast("double"), F.lit(medians[c][0])) for c in features}
    spread = df.agg(*[f(e).alias(f"{tag}{i}") for i, e in enumerate(full.values())
                      for tag, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    return {c: (e - F.lit(spread[f"m{i}"])) / F.lit(spread[f"s{i}"] or 1.0)
            for i, (c, e) in enumerate(full.items())}


def path_normalizer(n: int) -> float:
    """Mean depth of an unsuccessful search among ``n`` points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + vocab.EULER_GAMMA) - 2.0 * (n - 1) / n


def sample_for_trees(df: DataFrame, scaled: dict[str, Column], row_key: Column, n_rows: int, n_trees: int,
                     tree_rows: int, seed: int) -> DataFrame:
    """``(tree, mark, features)``: ``tree_rows`` rows per tree, drawn without replacement.

    A first hash keeps a pool of rows, a second one deals the pool out to the trees, so no row of the table
    meets all trees. Hashes of a row key make the draw repeatable when a task runs again.
    """
    features = F.array(*scaled.values())
    pool_share = min(1.0, 40.0 * tree_rows / max(1, n_rows))
    pool = (df.select(features.alias("features"), row_key.alias("key"))
            .where(F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(GRAIN)) < int(pool_share * GRAIN)
                   if pool_share < 1 else F.lit(True)))
    kept = n_rows * pool_share  # expected; the draw for each tree has slack for the difference
    deal = min(1.0, 1.5 * tree_rows / max(1, kept))
    trees = F.sequence(F.lit(0), F.lit(n_trees - 1))

    def mark(t):
        return F.pmod(F.xxhash64(F.col("key"), t, F.lit(seed + 1)), F.lit(GRAIN))

    drawn = F.filter(trees, lambda t: mark(t) < int(deal * GRAIN)) if deal < 1 else trees
    dealt = (pool.select("features", "key", F.explode(drawn).alias("tree"))
             .select("tree", F.xxhash64("key", "tree", F.lit(seed + 1)).alias("mark"), "features"))
    # the rank filter also runs before the shuffle: no tree ever receives more than tree_rows rows per task
    lowest = Window.partitionBy("tree").orderBy("mark")
    return dealt.withColumn("rank", F.row_number().over(lowest)).where(F.col("rank") <= tree_rows).drop("rank")


TREE_SCHEMA = ("tree int, feature array<int>, split array<double>, below array<int>, above array<int>, "
               "depth array<double>")


def tree_builder(seed: int):
    """Function for ``applyInPandas`` that grows one isolation tree from the sampled rows of its group.

    Self-contained, so that workers need nothing but numpy and pandas.
    """
    gamma = vocab.EULER_GAMMA

    def grow(key, rows):
        import numpy as np
        import pandas as pd

        rows = rows.sort_values("mark", kind="stable")
        points = np.stack(rows["features"].to_numpy())
        dice = np.random.default_rng([seed, int(key[0])])
        limit = int(np.ceil(np.log2(max(2, len(points)))))
        feature, split, below, above, depth = [], [], [], [], []
        todo = [(points, 0, None, None)]
        while todo:
            part, level, parent, side = todo.pop()
            node = len(feature)
            if parent is not None:
                side[parent] = node
            low, high = part.min(axis=0), part.max(axis=0)
            choices = np.flatnonzero(high > low)
            n = len(part)
            if level >= limit or n <= 1 or len(choices) == 0:
                rest = 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + gamma) - 2 * (n - 1) / n
                feature.append(-1), split.append(0.0), below.append(-1), above.append(-1)
                depth.append(float(level + rest))
                continue
            at = int(dice.choice(choices))
            cut = float(dice.uniform(low[at], high[at]))
            feature.append(at), split.append(cut), below.append(-1), above.append(-1), depth.append(0.0)
            left = part[:, at] <= cut
            todo.append((part[left], level + 1, node, below))
            todo.append((part[~left], level + 1, node, above))
        return pd.DataFrame({"tree": [int(key[0])], "feature": [feature], "split": [split], "below": [below],
                             "above": [above], "depth": [depth]})

    return grow


def fit_forest(df: DataFrame, scaled: dict[str, Column], row_key: Column, n_rows: int,
               n_trees: int = vocab.N_TREES, tree_rows: int = vocab.TREE_ROWS, seed: int = vocab.SEED) -> list:
    """The trees as rows: at most ``n_trees`` times twice ``tree_rows`` nodes, whatever the table size."""
    tree_rows = min(tree_rows, n_rows)
    samples = sample_for_trees(df, scaled, row_key, n_rows, n_trees, tree_rows, seed)
    trees = samples.groupBy("tree").applyInPandas(tree_builder(seed), TREE_SCHEMA)
    return sorted(trees.collect(), key=lambda t: t["tree"])


def forest_score(trees: list, tree_rows: int):
    """Arrow function: features of a row to the anomaly score ``2 ** (-mean depth / c)``.

    A leaf is its own child, so all rows of a batch take the same number of steps down every tree.
    """
    packed = []
    for t in trees:
        asked = np.asarray(t["feature"])
        leaf, itself = asked < 0, np.arange(len(asked))
        child = np.stack([np.where(leaf, itself, t["below"]), np.where(leaf, itself, t["above"])], axis=1).ravel()
        packed.append((np.where(leaf, 0, asked), np.asarray(t["split"]), child, np.asarray(t["depth"])))
    scale = max(path_normalizer(tree_rows), 1e-12)
    steps = math.ceil(math.log2(max(2, tree_rows)))

    @F.pandas_udf("double")
    def score(*features):
        n = len(features[0])
        points = np.concatenate([f.to_numpy() for f in features])  # feature f of row i at f * n + i
        rows = np.arange(n)
        total = np.zeros(n)
        for asked, split, child, depth in packed:
            start = asked * n
            at = np.zeros(n, dtype=np.int64)
            for _ in range(steps):
                right = points.take(rows + start.take(at)) > split.take(at)
                at = child.take(2 * at + right)
            total += depth.take(at)
        return pd.Series(np.power(2.0, -total / len(packed) / scale))

    return score


def isolation_forest(df: DataFrame, contamination: float = vocab.CONTAMINATION, seed: int = vocab.SEED,
                     order_by: str | None = None, n_trees: int = vocab.N_TREES) -> tuple[DataFrame, dict]:
    """``df`` with ``is_outlier``, ``outlier_score`` and ``outlier_method``, and a summary.

    ``order_by`` names a column that identifies rows and makes the draw repeatable; without it rows are told
    apart by their place in the scan. Rows are scored once and written with their score to the shared folder; the
    threshold, the contamination quantile of the scores, only shifts the stored score.
    """
    df = df.drop(*[c for c in vocab.OUTLIER_COLUMNS if c in df.columns])
    n_rows = df.count()
    features = numeric_features(df, [order_by] if order_by == "_pos" else [])
    method = F.lit(vocab.OUTLIER_METHOD)
    summary = {"used_columns": features, "contamination": float(contamination), "random_state": int(seed),
               "total": n_rows, "skipped": not (n_rows and features)}
    if summary["skipped"]:
        return df.withColumns({"is_outlier": F.lit(False), "outlier_score": F.lit(None).cast("double"),
                               "outlier_method": method}), summary
    scaled = standardized(df, features)
    key = col(order_by) if order_by else F.monotonically_increasing_id()
    tree_rows = min(vocab.TREE_ROWS, n_rows)
    trees = fit_forest(df, scaled, key, n_rows, n_trees, vocab.TREE_ROWS, seed)
    anomaly = forest_score(trees, tree_rows)(*scaled.values())
    scored = materialize(df.withColumn("outlier_score", anomaly), "scored")
    offset = exact_quantiles(scored, {"normality": -F.col("outlier_score")}, [contamination])["normality"][0]
    flagged = (scored.withColumn("outlier_score", F.col("outlier_score") + F.lit(offset))
               .withColumn("is_outlier", F.col("outlier_score") > 0)
               .withColumn("outlier_method", method))
    return flagged.select(*map(col, df.columns), *vocab.OUTLIER_COLUMNS), summary


def outlier_summary(df: DataFrame) -> DataFrame:
    """One row ``(outliers, total, ratio)`` of a flagged table."""
    return df.agg(F.count_if("is_outlier").alias("outliers"), F.count(F.lit(1)).alias("total"),
                  F.coalesce(F.avg(F.col("is_outlier").cast("double")), F.lit(0.0)).alias("ratio"))


def tukey_rows(df: DataFrame, field: str) -> DataFrame:
    """Rows outside the Tukey fences of a column. The fences are constants, so the filter reaches the scan."""
    number = numbers.as_number(col(field), df.schema[field].dataType, "plain")
    low, high = tukey_fences(df, {field: number})[field]
    if low is None:
        return df.where(F.lit(False))
    value = col(field) if isinstance(df.schema[field].dataType, T.DoubleType) else number
    return df.where((value < low) | (value > high))
