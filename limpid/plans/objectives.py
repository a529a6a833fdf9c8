"""What a dashboard should be about: its date, its metric, its dimensions."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F

from limpid import vocab
from limpid.functions import numbers
from limpid.operators import frequency
from limpid.operators.cells import cell
from limpid.operators.columns import basic_stats, screened_cardinalities, column_dict, coverage, non_null, rows
from limpid.plans.semantics import single_value


def best_covered(columns, stats) -> str | None:
    """The column with the largest share of values, the first one on ties."""
    return max(columns, key=lambda c: coverage(stats[c])) if columns else None


def metric_aggregate(name: str) -> str:
    """Prices, rates and shares are averaged, everything else is added up."""
    return "mean" if any(w in name.lower() for w in vocab.MEAN_WORDS) else "sum"


def named(columns, pattern: str) -> list[str]:
    return [c for c in columns if re.search(pattern, c)]


def dimension_scores(df: DataFrame, dims, metric: str | None = None) -> DataFrame:
    """``(column, entropy, relation, score)``: balance of a dimension plus how far group means of the metric
    differ, for several dimensions at once.

    One row per dimension value leaves the partial aggregate; null is a value of its own.
    """
    if metric is None:
        freq = frequency.value_counts(df, dims)
        return frequency.entropy(freq).select("column", "entropy", F.lit(0.0).alias("relation"),
                                              F.col("entropy").alias("score"))
    kind = df.schema[metric].dataType
    value = numbers.as_number(cell(df, metric), kind, "plain")
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), cell(df, c).cast("string").alias("value")) for c in dims])
    groups = (df.select(value.alias("m"), F.inline(pairs)).groupBy("column", "value")
              .agg(F.count(F.lit(1)).alias("n"), F.avg("m").alias("mean")))
    spread = df.agg(F.var_samp(value).alias("v")).first()["v"] or 0.0
    n = F.col("n").cast("double")
    scored = groups.groupBy("column").agg(
        (F.log2(F.sum(n)) - F.sum(n * F.log2(n)) / F.sum(n)).alias("entropy"),
        (F.coalesce(F.var_samp("mean"), F.lit(0.0)) / (1.0 + spread)).alias("relation"))
    return scored.withColumn("score", F.col("entropy") + F.col("relation"))


def choose_objectives(df: DataFrame, roles: dict[str, str]):
    """``(date, metric, dims, units)`` for the roles of the semantic vocabulary."""
    stats = basic_stats(df)
    counted = screened_cardinalities(df, stats=stats)
    n = max((s["rows"] for s in stats.values()), default=0)
    text_count = {c: counted[c] + (stats[c]["non_null"] < n) for c in df.columns}
    known = {c: r for c, r in roles.items() if c in stats}

    def is_id(c):
        return any(w in c.lower() for w in vocab.ID_WORDS) or (n >= 20 and text_count[c] >= 0.98 * n)

    def of(role):
        return [c for c, r in known.items() if r == role]

    date = best_covered(of(vocab.DATE), stats)
    money = [c for c in of(vocab.MONEY_METRIC) if not is_id(c)]
    counts = [c for c in of(vocab.NUMBER_METRIC) if not is_id(c)]
    metric = best_covered(money, stats)
    if metric is None and counts:
        metric = ([c for c in counts if text_count[c] < 0.9 * n] or counts)[0]
    most = min(50, max(2, n // 4))
    dims = [c for c in of(vocab.CATEGORY) if 2 <= text_count[c] <= most]
    dims = dims or of(vocab.BOOL)[:1] or of(vocab.CATEGORY)[:1]
    if len(dims) > 1:
        score = {r["column"]: r["score"] for r in dimension_scores(df, dims, metric).collect()}
        dims = sorted(dims, key=lambda c: (-score[c], df.columns.index(c)))[:2]
    currency = single_value(df) if "moneda" in df.columns else None
    return date, metric, dims, {"currency": currency} if currency else {}


def discover_amount(df: DataFrame, roles: dict[str, str]) -> tuple[DataFrame, str | None, dict[str, str]]:
    """The amount column of a table: a money column, quantity times price, or the first column of numbers.

    Returns the table (with the derived column when one was made), the column and how it was derived.
    """
    def number(c):
        return numbers.number_or_null(cell(df, c), df.schema[c].dataType, "auto")

    stats = column_dict(df, {
        "rows": rows,
        "non_null": non_null,
        "numbers": lambda v, kind: F.count(numbers.number_or_null(v, kind, "auto")),
    })
    money = [c for c, r in roles.items() if r == vocab.MONEY_METRIC and c in stats and stats[c]["non_null"]]
    if money:
        total = [c for c in money if re.search(vocab.BUSINESS_TOTAL_NAME, c.lower())]
        return df, (total or money)[0], {}
    quantity = next(iter(named([c.lower() for c in df.columns], vocab.BUSINESS_QUANTITY_NAME)), None)
    price = next(iter(named([c.lower() for c in df.columns], vocab.BUSINESS_UNIT_PRICE_NAME)), None)
    if quantity in df.columns and price in df.columns:
        product = number(quantity) * number(price)
        known = df.select(product.alias("p")).agg(F.count("p")).first()[0]
        if known >= max(10, stats[quantity]["rows"] // 10):
            name = "__importe_total__"
            return df.withColumn(name, product), name, {name: f"{quantity} * {price}"}
    strong = [c for c in df.columns if stats[c]["rows"] and stats[c]["numbers"] / stats[c]["rows"] > 0.8]
    return df, (strong[0] if strong else None), {}


def pick_dimension(columns, pattern: str, max_values: int, counted: dict[str, int]) -> str | None:
    """First column of that name with 2 to ``max_values`` distinct values, else the first of that name."""
    fitting = [c for c in columns if re.search(pattern, c.strip().lower())]
    return next((c for c in fitting if 2 <= counted[c] <= max_values), fitting[0] if fitting else None)


def amount_product(price, quantity):
    """Quantity times price, price in any decimal notation."""
    return numbers.auto_decimal(price) * numbers.plain_number(quantity)
