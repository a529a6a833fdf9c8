"""Dates written as text.

Each accepted format is a shape test plus a rewrite to ISO text, so a value costs one pattern match and
one cast; no formatter runs and no parse error is raised for text that is no date.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

from limpid import vocab
from limpid.functions.text import strip

DMY = r"^(\d{1,2})/(\d{1,2})/(\d{4})$"

# format -> (shape, rewrite to year-month-day)
FORMATS = {
    "%Y-%m-%d": (r"^\d{4}-\d{1,2}-\d{1,2}$", lambda c: c),
    "%d/%m/%Y": (DMY, lambda c: F.regexp_replace(c, DMY, "$3-$2-$1")),
    "%Y/%m/%d": (r"^\d{4}/\d{1,2}/\d{1,2}$", lambda c: F.translate(c, "/", "-")),
    "%m/%d/%Y": (DMY, lambda c: F.regexp_replace(c, DMY, "$3-$1-$2")),
    "%d-%m-%Y": (r"^(\d{1,2})-(\d{1,2})-(\d{4})$",
                 lambda c: F.regexp_replace(c, r"^(\d{1,2})-(\d{1,2})-(\d{4})$", "$3-$2-$1")),
    "%m-%d-%Y": (r"^(\d{1,2})-(\d{1,2})-(\d{4})$",
                 lambda c: F.regexp_replace(c, r"^(\d{1,2})-(\d{1,2})-(\d{4})$", "$3-$1-$2")),
    "%Y-%m-%d %H:%M:%S": (r"^\d{4}-\d{1,2}-\d{1,2}[ T]\d{2}:\d{2}(:\d{2}(\.\d+)?)?$",
                          lambda c: F.regexp_replace(c, r"[ T].*$", "")),
}

DAY_FIRST = ("%Y-%m-%d", "%Y-%m-%d %H:%M:%S", "%Y/%m/%d", "%d/%m/%Y", "%d-%m-%Y")
MONTH_FIRST = ("%Y-%m-%d", "%Y-%m-%d %H:%M:%S", "%Y/%m/%d", "%m/%d/%Y", "%m-%d-%Y")


def is_temporal(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType))


def in_range(d: Column) -> Column:
    """Null for dates that a 64-bit nanosecond clock cannot hold."""
    return F.when(d.between(F.lit(vocab.DATE_MIN).cast("date"), F.lit(vocab.DATE_MAX).cast("date")), d)


def parse_date(c: Column, formats=vocab.DATE_FORMATS) -> Column:
    """The date written in ``c`` in the first of ``formats`` whose shape fits; null when none does."""
    text = strip(c)
    first_is_digit = (text >= "0") & (text < ":")  # spares most text the pattern matches
    iso = None
    for name in formats:
        shape, rewrite = FORMATS[name]
        iso = (F if iso is None else iso).when(text.rlike(shape), rewrite(text))
    return in_range(F.when(first_is_digit, iso).try_cast("date"))


def as_date(c: Column, dtype: T.DataType, formats=vocab.DATE_FORMATS) -> Column:
    if is_temporal(dtype):
        return c.cast("date")
    return parse_date(c.cast("string"), formats)


def date_or_null(c: Column, dtype: T.DataType, formats=vocab.DATE_FORMATS) -> Column:
    """``as_date`` for any type: numbers and booleans are no dates."""
    if is_temporal(dtype) or isinstance(dtype, T.StringType):
        return as_date(c, dtype, formats)
    return F.lit(None).cast("date")


def is_iso_date(c: Column) -> Column:
    return c.rlike(vocab.ISO_DATE_PATTERN)


def month_label(d: Column) -> Column:
    return F.date_format(d, "yyyy-MM")


def month_start(d: Column) -> Column:
    return F.trunc(d, "month")


def iso_text(d: Column) -> Column:
    return F.date_format(d, "yyyy-MM-dd")
