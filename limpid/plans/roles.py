"""Column roles from names and values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from limpid import vocab
from limpid.functions import dates, numbers
from limpid.functions.text import is_bool_token, strip
from limpid.operators.columns import column_dict, column_table, non_null, share


def _text(v: Column) -> Column:
    """Values as the text that role rules look at."""
    return strip(v.cast("string"))


def date_match(v: Column, kind: T.DataType) -> Column:
    return F.when(v.isNotNull(), dates.date_or_null(v, kind).isNotNull())


def number_match(v: Column, kind: T.DataType) -> Column:
    known = F.lit(True) if numbers.is_numeric(kind) else numbers.relaxed_number(_text(v)).isNotNull()
    return F.when(v.isNotNull(), known)


EVIDENCE = {
    "non_null": non_null,
    "bool_share": lambda v, kind: share(is_bool_token(_text(v))),
    "money_share": lambda v, kind: share(numbers.looks_money(_text(v))),
    "date_share": lambda v, kind: share(date_match(v, kind)),
    "number_share": lambda v, kind: share(number_match(v, kind)),
    "temporal": lambda v, kind: F.max(F.lit(dates.is_temporal(kind))),
}


def type_roles(df: DataFrame, columns=None) -> DataFrame:
    """``(ordinal, column, role, shares…)``: the role of every column from its values, in one pass."""
    role = (F.when(F.col("non_null") == 0, vocab.TEXT)
            .when(F.col("temporal"), vocab.DATE)
            .when(F.col("bool_share") == 1, vocab.BOOL)
            .when(F.col("money_share") > 0.5, vocab.MONEY)
            .when(F.col("date_share") > 0.8, vocab.DATE)
            .when(F.col("number_share") > 0.8, vocab.NUMBER)
            .otherwise(vocab.TEXT))
    return column_table(df, EVIDENCE, columns).withColumn("role", role)


def infer_types(df: DataFrame, date_columns=()) -> dict[str, str]:
    """Role per column; columns that were normalised as dates are dates whatever is left in them."""
    found = {r["column"]: r["role"] for r in type_roles(df).collect()}
    roles = {c: found.get(c, vocab.TEXT) for c in df.columns}
    return {**roles, **{c: vocab.DATE for c in date_columns if c in roles}}


# ---- roles from names, as columns over a table of names ---------------------------------------

def _first_rule(name: Column, rules) -> Column:
    """Role of the first rule of which the name contains a word; null when none applies."""
    out = None
    for role, words in rules:
        hit = reduce(Column.__or__, [name.contains(w) for w in words])
        out = (F if out is None else out).when(hit, F.lit(role))
    return out


def profile_name_role(name: Column) -> Column:
    """Profile role that the name alone gives; null when values have to decide."""
    low = F.lower(strip(name))
    before = vocab.PROFILE_NAME_RULES[:3]
    after = vocab.PROFILE_NAME_RULES[4:]
    _, id_words = vocab.PROFILE_NAME_RULES[3]
    is_id = low.startswith("id") | reduce(Column.__or__, [low.contains(w) for w in id_words])
    return F.coalesce(_first_rule(low, before), F.when(is_id, vocab.ID), _first_rule(low, after))


def business_name_role(name: Column) -> Column:
    return F.coalesce(_first_rule(F.lower(strip(name)), vocab.BUSINESS_NAME_RULES), F.lit(vocab.CATEGORY))


def domain(header: Column) -> Column:
    """Business domain of a table from its joined header names."""
    return F.coalesce(_first_rule(F.lower(header), vocab.DOMAIN_RULES), F.lit("generic"))


def business_domain(header: Column) -> Column:
    return F.coalesce(_first_rule(F.lower(header), vocab.BUSINESS_DOMAIN_RULES), F.lit("generic"))


def names_table(df: DataFrame) -> DataFrame:
    """The column names of a table as a table ``(column)``."""
    return df.sparkSession.createDataFrame([(c,) for c in df.columns], "column string")


def name_roles(df: DataFrame) -> dict[str, str]:
    """Role per column from names alone."""
    rows = names_table(df).select("column", business_name_role(F.col("column")).alias("role")).collect()
    found = {r["column"]: r["role"] for r in rows}
    return {c: found[c] for c in df.columns}


def profile_roles(df: DataFrame, type_roles: dict[str, str] | None = None) -> dict[str, str]:
    """Roles in the profile vocabulary.

    With ``type_roles`` the value-based roles stay, sharpened by the name: ids, currency codes, categories and
    amounts. Without, names decide first and values after, with the profile's own thresholds.
    """
    rows = names_table(df).select("column", profile_name_role(F.col("column")).alias("role")).collect()
    named = {r["column"]: r["role"] for r in rows}
    if type_roles is not None:
        return {c: _sharpen(named[c], type_roles.get(c, vocab.TEXT)) for c in df.columns}
    open_columns = [c for c in df.columns if named[c] is None]
    seen = column_dict(df, {
        "non_null": non_null,
        "dates": lambda v, kind: F.count(dates.date_or_null(v, kind, dates.DAY_FIRST)),
        "numbers": lambda v, kind: share(number_match(v, kind)),
        "bools": lambda v, kind: share(is_bool_token(_text(v))),
    }, open_columns)
    for c, s in seen.items():
        named[c] = (vocab.TEXT if not s["non_null"]
                    else vocab.DATE if s["dates"] >= 0.7 * s["non_null"]
                    else vocab.NUMBER if s["numbers"] >= 0.8
                    else vocab.BOOL if s["bools"] >= 0.9 else vocab.TEXT)
    return {c: named[c] for c in df.columns}


def _sharpen(by_name: str | None, by_value: str) -> str:
    if by_name == vocab.ID:
        return vocab.ID
    if by_value == vocab.MONEY:
        return vocab.PROFILE_AMOUNT
    if by_value == vocab.NUMBER and by_name == vocab.PROFILE_AMOUNT:
        return vocab.PROFILE_AMOUNT
    if by_value == vocab.TEXT and by_name in (vocab.MONEY, vocab.PROFILE_CATEGORY):
        return by_name
    return by_value
