"""Table cleaning: trim, booleans, ISO dates, imputation, duplicates.

Two statistics passes decide everything; the cleaning itself is one projection and one deduplication.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from limpid import vocab
from limpid.functions import dates, numbers, text
from limpid.operators import frequency
from limpid.operators.cells import cell, col
from limpid.operators.columns import column_dict, non_null
from limpid.operators.dedup import POSITION, distinct_rows, keep_first

ISO_SHARE = 0.6
PARSE_SHARE = 0.5


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def trim_blanks(df: DataFrame) -> DataFrame:
    """All text columns stripped, blank text as null."""
    return df.withColumns({c: text.blank_to_null(col(c)) for c in text_columns(df)})


def coerce_bools(df: DataFrame) -> DataFrame:
    """Columns whose every value is a boolean word become boolean; all-null columns are left alone."""
    return _retype(df, _shapes(df))[0]


def coerce_iso_dates(df: DataFrame) -> DataFrame:
    """Text columns with more than 60 % ISO dates become dates, other text in them null."""
    shapes = {c: {**s, "all_bool": False} for c, s in _shapes(df).items()}
    return _retype(df, shapes)[0]


def _shapes(df: DataFrame) -> dict[str, dict]:
    """What the values of each column look like, from one pass."""
    candidates = [f.name for f in df.schema if f.name != POSITION
                  and isinstance(f.dataType, (T.StringType, T.BooleanType, T.IntegralType))]
    stats = column_dict(df, {
        "non_null": non_null,
        "bools": lambda v, kind: F.count_if(text.is_bool_token(v.cast("string"))),
        "iso": lambda v, kind: F.count_if(dates.is_iso_date(v) if isinstance(kind, T.StringType) else F.lit(False)),
    }, candidates)
    for s in stats.values():
        s["all_bool"] = 0 < s["non_null"] == s["bools"]
        s["mostly_iso"] = s["iso"] > ISO_SHARE * s["non_null"]
    return stats


def _retype(df: DataFrame, shapes: dict) -> tuple[DataFrame, list[str], list[str]]:
    changes, bools, iso = {}, [], []
    for c, s in shapes.items():
        kind = df.schema[c].dataType
        if s["all_bool"]:
            if not isinstance(kind, T.BooleanType):
                changes[c] = text.to_bool(col(c).cast("string"))
                bools.append(c)
        elif s["mostly_iso"] and isinstance(kind, T.StringType):
            changes[c] = dates.parse_date(col(c))
            iso.append(c)
    return df.withColumns(changes) if changes else df, bools, iso


def normalize_dates(df: DataFrame, min_success_ratio: float = PARSE_SHARE, formats=None) -> tuple[DataFrame, dict]:
    """Text columns that parse as dates in at least ``min_success_ratio`` of their values, as ISO text.

    Returns the table and ``{column: "date"}``; values of a chosen column that do not parse become null.
    """
    formats = formats or vocab.DATE_FORMATS
    stats = column_dict(df, {
        "parsed": lambda v, kind: F.count(dates.parse_date(v, formats)),
        "non_null": non_null,
    }, text_columns(df))
    chosen = [c for c, s in stats.items() if s["non_null"] and s["parsed"] / s["non_null"] >= min_success_ratio]
    changes = {c: dates.iso_text(dates.parse_date(col(c), formats)) for c in chosen}
    return (df.withColumns(changes) if changes else df), {c: "date" for c in chosen}


def tolerant_date(df: DataFrame, name: str) -> Column:
    """Date of a column in mixed notation: day first, or month first when that reads more and day first fails.

    Year-first text always means year, month, day.
    """
    kind = df.schema[name].dataType
    if dates.is_temporal(kind):
        return col(name).cast("date")
    day_first, month_first = (dates.parse_date(col(name).cast("string"), f)
                              for f in (dates.DAY_FIRST, dates.MONTH_FIRST))
    seen = df.agg(F.count(F.lit(1)).alias("rows"), F.count(day_first).alias("day_first"),
                  F.count(month_first).alias("month_first")).first()
    if seen["day_first"] < 0.5 * seen["rows"] and seen["month_first"] > seen["day_first"]:
        return month_first
    return day_first


# ---- imputation -------------------------------------------------------------------------------

def _section(rules, *path) -> dict:
    for key in path:
        rules = rules.get(key) if isinstance(rules, dict) else None
    return rules if isinstance(rules, dict) else {}


def _word(value) -> str:
    return str(value or "").strip().lower()


def imputation_plan(df: DataFrame, rules: dict | None) -> dict[str, tuple[str, object]]:
    """``{column: (strategy, value)}`` after explicit rules and per-type defaults."""
    explicit = _section(rules, "impute", "by_column")
    default = _section(rules, "impute", "default")
    plan = {}
    for field in df.schema:
        if field.name == POSITION:
            continue
        if field.name in explicit:
            rule = explicit[field.name]
            if isinstance(rule, dict):
                plan[field.name] = (_word(rule.get("strategy")), rule.get("value"))
        else:
            side = "numeric" if numbers.is_numeric(field.dataType) else "text"
            plan[field.name] = (_word(default.get(side)), default.get("value"))
    return {c: p for c, p in plan.items() if p[0] in ("mean", "mode", "value")}


def impute(df: DataFrame, rules: dict | None) -> tuple[DataFrame, dict[str, int]]:
    """Missing values filled by rule; returns the table and the filled count per column."""
    plan = imputation_plan(df, rules)
    if not plan:
        return df, {}
    stats = column_dict(df, {
        "missing": lambda v, kind: F.count_if(v.isNull()),
        "mean": lambda v, kind: F.avg(numbers.number_or_null(v, kind)),
    }, plan)
    plan = {c: p for c, p in plan.items() if stats[c]["missing"]}
    modes = frequency.modes(df, [c for c, p in plan.items() if p[0] == "mode"])
    changes, filled = {}, {}
    for c, (strategy, value) in plan.items():
        fill = stats[c]["mean"] if strategy == "mean" else modes.get(c) if strategy == "mode" else value
        if fill is None:
            continue
        changes[c] = _filled(df, c, fill)
        filled[c] = stats[c]["missing"]
    return df.withColumns(changes) if changes else df, filled


def _filled(df: DataFrame, name: str, fill) -> Column:
    kind = df.schema[name].dataType
    value = cell(df, name)
    if isinstance(fill, float) and isinstance(kind, T.IntegralType):
        return F.coalesce(value.cast("double"), F.lit(fill))
    if isinstance(fill, str) and not isinstance(kind, T.StringType) and not _reads_as(df, fill, kind):
        return F.coalesce(value.cast("string"), F.lit(fill))  # such a fill turns the column into text
    return F.coalesce(value, F.lit(fill).cast(kind))


def _reads_as(df: DataFrame, fill: str, kind: T.DataType) -> bool:
    """Whether a text fill is a value of a boolean or temporal column; numbers given as text stay text."""
    if numbers.is_numeric(kind):
        return False
    return df.sparkSession.range(1).select(F.lit(fill).try_cast(kind).isNotNull()).first()[0]


# ---- duplicates and the whole clean -----------------------------------------------------------

def dedup_keys(df: DataFrame, rules: dict | None) -> list[str]:
    keys = _section(rules, "dedup").get("keys")
    return [k for k in keys if k in df.columns] if isinstance(keys, list) else []


def dedup(df: DataFrame, rules: dict | None = None, order_by=None) -> DataFrame:
    """One row per key combination of the rules, first kept; without usable keys, whole rows are distinct."""
    keys = dedup_keys(df, rules)
    return keep_first(df, keys, order_by) if keys else distinct_rows(df)


def clean(df: DataFrame, rules: dict | None = None, order_by=None) -> tuple[DataFrame, dict]:
    """Trim, booleans, ISO dates, imputation, duplicates, in that order.

    The returned table is lazy. The summary holds what the statistics passes already know; row counts after
    deduplication come from ``quality_summary`` on the written result.
    """
    trimmed = trim_blanks(df)
    shapes = _shapes(trimmed)
    typed, bools, iso = _retype(trimmed, shapes)
    filled, imputed = impute(typed, rules)
    summary = {
        "trimmed_cols": text_columns(df),
        "bool_cols": bools,
        "date_cols": iso,
        "numeric_cols": [f.name for f in filled.schema
                         if numbers.is_numeric(f.dataType) and f.name != POSITION],
        "dedup_keys_used": dedup_keys(df, rules),
    }
    if imputed:
        summary["imputed"] = imputed
    return dedup(filled, rules, order_by), summary


def describe_rules(rules: dict | None) -> dict:
    """What a rule set asks for, as the run log records it."""
    keys = _section(rules, "dedup").get("keys")
    columns = _section(rules, "format", "dates").get("columns")
    return {
        "has_rules": bool(rules),
        "impute_columns": sorted(_section(rules, "impute", "by_column")),
        "dedup_keys": keys if isinstance(keys, list) else [],
        "date_columns": columns if isinstance(columns, list) else [],
    }
