"""Text columns: trimming, booleans, labels, header names."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from limpid import vocab

# the characters a Unicode-aware strip removes; F.trim alone removes only the plain space
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def blank_to_null(c: Column) -> Column:
    """Stripped text, with blank text as null."""
    return F.nullif(strip(c), F.lit(""))


def example_text(c: Column, width: int = 80) -> Column:
    return F.substring(strip(c), 1, width)


def na_to_null(c: Column) -> Column:
    """Null for the exact tokens that delimited files use for missing values."""
    return F.when(~c.isin(*vocab.NA_TOKENS), c)


def is_bool_token(c: Column, tokens=vocab.BOOL_STRICT) -> Column:
    return F.lower(c).isin(*tokens)


def to_bool(c: Column) -> Column:
    low = F.lower(c)
    return F.when(low.isin(*vocab.BOOL_TRUE), True).when(low.isin(*vocab.BOOL_FALSE), False)


def prettify(c: Column) -> Column:
    """Readable label: runs of ``_`` and ``-`` become one space, first letter upper case."""
    words = strip(F.regexp_replace(c, r"[_\-]+", " "))
    return F.concat(F.upper(F.substring(words, 1, 1)), F.substring(words, 2, 1 << 30))


def slug(c: Column) -> Column:
    """Header text as snake case over ``[a-z0-9_]``; empty text when nothing is left."""
    return F.btrim(F.regexp_replace(F.lower(strip(c)), "[^a-z0-9]+", "_"), F.lit("_"))


def semantic_slug(c: Column) -> Column:
    """Header text that keeps accents and ``- . % /``; at most 80 characters, never empty."""
    kept = F.regexp_replace(c, r"(?U)[^\w\s\-.%/]", " ")
    joined = F.regexp_replace(F.lower(strip(kept)), r"(?U)\s+", "_")
    return F.coalesce(F.nullif(F.substring(joined, 1, 80), F.lit("")), F.lit("col"))


def percent_text(part: Column, total: Column) -> Column:
    """``12.34%``; ``0.00%`` when there is no total."""
    share = F.when(total > 0, part / total * 100).otherwise(F.lit(0.0))
    return F.format_string("%.2f%%", share.cast("double"))
