"""Numbers written as text: money, locale-dependent decimals, percentages, and number formats."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

from limpid import vocab

NOT_AMOUNT = r"[^0-9\-,.]"


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def plain_number(c: Column) -> Column:
    """Text in plain decimal or scientific notation; anything else, also ``nan`` and ``1d``, is null."""
    return F.when(c.rlike(vocab.NUMBER_PATTERN), c).try_cast("double")


def money(c: Column) -> Column:
    """``$50.886,00`` style amounts: the dot always groups thousands, the comma is the decimal mark."""
    return plain_number(F.translate(F.regexp_replace(c, r"[^0-9\-,]", ""), ",", "."))


def auto_decimal(c: Column) -> Column:
    """Amount whose decimal mark is whichever of ``,`` and ``.`` comes last; a lone mark is decimal."""
    kept = F.regexp_replace(c, NOT_AMOUNT, "")
    comma_last = kept.rlike(r",[^,.]*$")
    return plain_number(
        F.when(comma_last, F.translate(kept, ",.", ".")).otherwise(F.translate(kept, ",", ""))
    )


def relaxed_number(c: Column) -> Column:
    """Dots and spaces dropped, comma as the decimal mark."""
    return plain_number(F.translate(F.regexp_replace(c, r"[.\s]", ""), ",", "."))


def percent(c: Column) -> Column:
    """``12,5%`` as 0.125; null without a percent sign."""
    return F.when(c.contains("%"), auto_decimal(c)) / 100


def no_nan(c: Column) -> Column:
    return F.nullif(c.cast("double"), F.lit(float("nan")))


PARSERS = {
    "money": money,
    "auto": auto_decimal,
    "relaxed": relaxed_number,
    "plain": plain_number,
}


def as_number(c: Column, dtype: T.DataType, parse: str = "money") -> Column:
    """A column as double: numeric types as they are, booleans as 0/1, text through the named parser."""
    if is_numeric(dtype):
        return no_nan(c) if isinstance(dtype, (T.DoubleType, T.FloatType)) else c.cast("double")
    if isinstance(dtype, T.BooleanType):
        return c.cast("double")
    return PARSERS[parse](c.cast("string"))


def number_or_null(c: Column, dtype: T.DataType, parse: str = "plain") -> Column:
    """``as_number`` for any type: what is neither number, boolean nor text has no number."""
    if is_numeric(dtype) or isinstance(dtype, (T.BooleanType, T.StringType)):
        return as_number(c, dtype, parse)
    return F.lit(None).cast("double")


def spanish_number(c: Column, decimals: int = 2) -> Column:
    """``1.234.567,89``: dots for thousands, comma for decimals."""
    return F.translate(F.format_number(c, decimals), ",.", ".,")


def percent_label(c: Column) -> Column:
    return F.format_string("%.2f%%", c.cast("double"))


def currency_prefix(code: Column) -> Column:
    """Axis prefix of a currency code; an unknown code is its own prefix followed by a space."""
    pairs = [F.lit(v) for kv in vocab.CURRENCY_PREFIX.items() for v in kv]
    upper = F.upper(code)
    return F.coalesce(F.try_element_at(F.create_map(*pairs), upper), F.concat(upper, F.lit(" ")))


def is_percent(c: Column) -> Column:
    return c.contains("%")


def in_latitude(x: Column) -> Column:
    return x.between(-90, 90)


def in_longitude(x: Column) -> Column:
    return x.between(-180, 180)


def looks_money(c: Column) -> Column:
    return c.rlike(vocab.MONEY_SYMBOL_PATTERN)


def names_currency(c: Column) -> Column:
    return c.rlike(vocab.MONEY_CODE_PATTERN)


def looks_code(c: Column) -> Column:
    return c.rlike(vocab.CODE_PATTERN)


def outside_fences(x: Column, q1, q3) -> Column:
    """Tukey fences: more than 1.5 interquartile ranges outside the quartiles."""
    reach = 1.5 * (q3 - q1)
    return (x < q1 - reach) | (x > q3 + reach)


