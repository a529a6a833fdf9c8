"""Semantic roles: names compared with term lists, values with predicates, both weighed into one score."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, functions as F, types as T

from limpid import vocab
from limpid.functions import dates, numbers
from limpid.functions.text import is_bool_token
from limpid.ml import features, models
from limpid.operators.cells import col
from limpid.operators.columns import PerValue, Tally, column_dict, counted, estimate, non_null, rows, screened_cardinalities, share_of, tally
from limpid.plans.roles import domain
from limpid.sources.headers import normalize_headers

W_NAME, W_VALUE, W_CONSISTENCY = 0.45, 0.45, 0.10
WORD = r"(?U)\b\w\w+\b"


@dataclass
class Schema:
    roles: dict[str, str]
    primary_date: str | None
    primary_metric: str | None
    dims: list[str]
    units: dict[str, str] = field(default_factory=dict)
    domain: str = "generic"
    confidence: dict[str, float] = field(default_factory=dict)
    derived: dict[str, str] = field(default_factory=dict)


# ---- name similarity --------------------------------------------------------------------------

def _term_table(spark) -> DataFrame:
    """``(gram, role, tf, docs)``: words and word pairs of every term list, with the lists that hold them."""
    counts = {}
    for role, terms in vocab.ROLE_TERMS.items():
        words = re.findall(r"\b\w\w+\b", " ".join(terms).lower())
        counts[role] = Counter(words + [f"{a} {b}" for a, b in zip(words, words[1:])])
    docs = Counter(g for grams in counts.values() for g in grams)
    listed = [(g, role, float(tf), docs[g]) for role, grams in counts.items() for g, tf in grams.items()]
    return spark.createDataFrame(listed, "gram string, role string, tf double, docs int")


def _idf(docs: Column) -> Column:
    """Smoothed inverse document frequency over the name and the term lists."""
    return F.log(F.lit(float(len(vocab.ROLE_TERMS) + 2)) / (docs + 1)) + 1


def name_similarity(names: DataFrame, column: str = "column") -> DataFrame:
    """``(column, role, similarity)``: TF-IDF cosine of every distinct name with every role's term list.

    The name counts as a document of its own, so a word it shares with a list weighs a little less in both.
    The term table is a constant of some hundred rows, so it is the broadcast side; names stay distributed.
    """
    terms = _term_table(names.sparkSession)
    base = terms.groupBy("role").agg(F.sum((F.col("tf") * _idf(F.col("docs"))) ** 2).alias("role_norm"))
    pairs = F.zip_with(F.slice("words", 1, F.greatest(F.size("words") - 1, F.lit(0))),
                       F.slice("words", 2, F.greatest(F.size("words") - 1, F.lit(0))),
                       lambda a, b: F.concat_ws(" ", a, b))
    grams = (names.select(F.col(column).alias("column")).distinct()
             .withColumn("words", F.regexp_extract_all(F.lower("column"), F.lit(WORD), F.lit(0)))
             .select("column", F.explode(F.concat("words", pairs)).alias("gram"))
             .groupBy("column", "gram").agg(F.count(F.lit(1)).cast("double").alias("name_tf")))
    docs = terms.select("gram", "docs").distinct()
    weighed = (grams.join(F.broadcast(docs), "gram", "left")
               .withColumn("idf", _idf(F.coalesce("docs", F.lit(0)) + 1)))
    norms = weighed.groupBy("column").agg(F.sum((F.col("name_tf") * F.col("idf")) ** 2).alias("name_norm"))
    shared = (weighed.join(F.broadcast(terms.select("gram", "role", "tf")), "gram")
              .groupBy("column", "role").agg(
                  F.sum(F.col("name_tf") * F.col("tf") * F.col("idf") ** 2).alias("dot"),
                  F.sum(F.col("tf") ** 2 * (F.col("idf") ** 2 - _idf(F.col("docs")) ** 2)).alias("shift")))
    scored = (shared.join(norms, "column").join(F.broadcast(base), "role")
              .select("column", "role", (F.col("dot") / F.sqrt(F.col("name_norm"))
                                         / F.sqrt(F.col("role_norm") + F.col("shift"))).alias("similarity")))
    roles = F.explode(F.array(*[F.lit(r) for r in vocab.ROLE_TERMS])).alias("role")
    every = names.select(F.col(column).alias("column")).distinct().select("column", roles)
    return (every.join(scored, ["column", "role"], "left")
            .select("column", "role", F.coalesce("similarity", F.lit(0.0)).alias("similarity")))


# ---- value evidence ---------------------------------------------------------------------------

def _number(v: Column, kind: T.DataType) -> Column:
    return v.cast("double") if numbers.is_numeric(kind) else numbers.auto_decimal(v.cast("string"))


VALUE_EVIDENCE = {
    "rows": rows,
    "non_null": non_null,
    "estimate": estimate,
    "days": PerValue(lambda v, kind: dates.date_or_null(v, kind, dates.DAY_FIRST), lambda found, v, n: counted(found, n)),
    "money": share_of(lambda v, kind: numbers.names_currency(v.cast("string"))),
    "bools": share_of(lambda v, kind: is_bool_token(v.cast("string"), vocab.BOOL_WIDE)),
    "numbers": PerValue(_number, lambda found, v, n: F.coalesce(counted(found, n) / F.nullif(counted(v, n), F.lit(0)), F.lit(0.0))),
    "percents": share_of(lambda v, kind: numbers.is_percent(v.cast("string"))),
    "latitudes": share_of(lambda v, kind: numbers.in_latitude(_number(v, kind))),
    "longitudes": share_of(lambda v, kind: numbers.in_longitude(_number(v, kind))),
    "codes": share_of(lambda v, kind: numbers.looks_code(v.cast("string"))),
}


def semantic_evidence(df: DataFrame, tallied: Tally | None = None) -> dict[str, dict]:
    """Per column: value shares, exact-where-it-matters cardinality, and name similarities."""
    tallied = tallied.named(df.columns) if tallied else tally(df, staged=True)
    facts = column_dict(tallied, VALUE_EVIDENCE)
    found = screened_cardinalities(tallied, stats=facts)
    names = df.sparkSession.createDataFrame([(c,) for c in df.columns], "column string")
    for c, s in facts.items():
        s["nunique"] = found[c] + (s["non_null"] < s["rows"])
        s["distinct"] = found[c]
        s["names"] = {}
    for r in name_similarity(names).collect():
        facts[r["column"]]["names"][r["role"]] = r["similarity"]
    return facts


def role_scores(name: str, s: dict) -> dict[str, float]:
    """Score of every semantic role for one column; ties go to the earlier role."""
    low, sim = name.lower(), s["names"]

    def gate(key, limit):
        return 1.0 if (s[key] or 0.0) > limit else 0.0

    def ratio(key):
        return s[key] or 0.0

    is_date = s["days"] >= max(4, -(-6 * s["non_null"] // 10)) if s["non_null"] else False
    consistency = min(1.0, ratio("numbers") + 0.25 * gate("percents", 0.5))
    return {
        vocab.DATE: W_NAME * sim[vocab.DATE] + W_VALUE * is_date,
        vocab.MONEY_METRIC: (W_NAME * sim[vocab.MONEY_METRIC] + W_VALUE * gate("money", 0.2)
                             + W_CONSISTENCY * consistency),
        vocab.NUMBER_METRIC: W_NAME * sim[vocab.NUMBER_METRIC] + W_VALUE * ratio("numbers"),
        vocab.BOOL: W_NAME * sim[vocab.BOOL] + W_VALUE * gate("bools", 0.9),
        vocab.ID: (0.25 * ("id" in low) + 0.6 * (s["nunique"] >= 0.98 * s["rows"]) + 0.2 * gate("codes", 0.6)),
        vocab.LAT: W_NAME * ("lat" in low) + W_VALUE * ratio("latitudes"),
        vocab.LON: W_NAME * any(w in low for w in ("lon", "lng", "long")) + W_VALUE * ratio("longitudes"),
        vocab.CATEGORY: W_NAME * sim[vocab.CATEGORY],
    }


def _decide(facts: dict[str, dict]) -> tuple[dict[str, str], dict[str, float], str | None]:
    """Roles, confidence, and the lone coordinate column that was given another role."""
    roles, confidence, lone = {}, {}, None
    for c, s in facts.items():
        scores = role_scores(c, s)
        best = max(scores, key=scores.get)
        confidence[c] = min(1.0, max(0.1, scores[best]))
        if best == vocab.ID and s["nunique"] < 0.8 * s["rows"]:
            best = max((vocab.CATEGORY, vocab.NUMBER_METRIC), key=scores.get)
        roles[c] = best
    places = {kind: [c for c, r in roles.items() if r == kind] for kind in (vocab.LAT, vocab.LON)}
    if bool(places[vocab.LAT]) != bool(places[vocab.LON]):  # half a coordinate is no place
        lone = c = (places[vocab.LAT] or places[vocab.LON])[-1]
        roles[c] = vocab.NUMBER_METRIC if facts[c]["numbers"] > 0.7 else vocab.CATEGORY
    return roles, confidence, lone


def _cover(s: dict) -> float:
    return s["non_null"] / s["rows"] if s["rows"] else 0.0


def single_value(df: DataFrame, name: str = "moneda") -> str | None:
    """The only code of a column in upper case, or none."""
    code = F.upper(col(name).cast("string"))
    ends = df.agg(F.min(code).alias("low"), F.max(code).alias("high")).first()
    return ends["low"] if ends["low"] == ends["high"] else None


def currency_of(df: DataFrame, money_column: str) -> str | None:
    """Currency that values of a money column name, by symbol or code, the first of the list where several are."""
    seen = df.select(col(money_column).cast("string").alias("v"))
    hits = seen.agg(*[F.bool_or(F.col("v").rlike(p)).alias(f"c{i}")
                      for i, (_, p) in enumerate(vocab.CURRENCY_IN_TEXT)]).first()
    return next((code for i, (code, _) in enumerate(vocab.CURRENCY_IN_TEXT) if hits[f"c{i}"]), None)


def infer_semantics(df: DataFrame, domain_model: PipelineModel | None = None, tallied: Tally | None = None) -> Schema:
    """Roles, confidence, main date and metric, dimensions, currency and domain of a table.

    Names are those of the normalised header. The domain is that of ``domain_model``, or of the name rules without one.
    ``tallied``: a tally of the columns of ``df`` in their order, where there is one already.
    """
    df = normalize_headers(df, "semantic")
    tallied = tallied.named(df.columns) if tallied else tally(df, staged=True)
    facts = semantic_evidence(df, tallied)
    roles, confidence, lone = _decide(facts)
    by_role = {}
    for c, r in roles.items():
        if c != lone:  # half a coordinate is neither a metric nor a dimension
            by_role.setdefault(r, []).append(c)
    money, counts = by_role.get(vocab.MONEY_METRIC, []), by_role.get(vocab.NUMBER_METRIC, [])
    categories, days = by_role.get(vocab.CATEGORY, []), by_role.get(vocab.DATE, [])

    derived = {}
    amounts = [c for c in df.columns if c in money or c in counts]
    quantity = next((c for c in counts if re.search(vocab.SEMANTIC_QUANTITY_NAME, c)), None)
    unit = next((c for c in amounts if re.search(vocab.SEMANTIC_UNIT_PRICE_NAME, c)), None)
    metric = None
    if quantity and unit:
        if "importe_total" not in df.columns:
            derived["importe_total"] = f"{quantity} * {unit}"
        metric = money[0] if money else "importe_total"
    elif money:
        metric = max(money, key=lambda c: _cover(facts[c]))
    elif counts:
        steady = [c for c in counts if facts[c]["distinct"] < 0.9 * facts[c]["rows"] and facts[c]["nunique"] > 5]
        metric = (steady or counts)[0]

    def useful(c):
        s = facts[c]
        most = min(50, max(2, s["rows"] // 4))
        return 2 <= s["nunique"] <= most and _cover(s) > 0.6 and not (s["codes"] or 0) > 0.6

    dims = [c for c in categories if useful(c)]
    if not dims:
        dims = (by_role.get(vocab.BOOL) or categories or by_role.get(vocab.ID) or [])[:1]
    units = {}
    currency = (single_value(df) if "moneda" in df.columns else currency_of(tallied.values(money[0]), money[0]) if money else None)
    if currency:
        units["currency"] = currency
    if domain_model is None:
        header = df.sparkSession.range(1).select(domain(F.lit(" ".join(df.columns))).alias("d")).first()["d"]
    else:
        listed = df.sparkSession.createDataFrame([("", i, c, roles[c]) for i, c in enumerate(df.columns)],
                                                 "dataset string, ordinal int, column string, role string")
        text = models.domain_text(features.header_text(listed), features.role_histogram(listed))
        header = models.predict_domain(domain_model, text).first()["predicted"]
    return Schema(roles, max(days, key=lambda c: _cover(facts[c])) if days else None, metric, dims[:3], units,
                  header, confidence, derived)
