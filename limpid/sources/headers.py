"""Column names from raw headers."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame


def slug_name(raw: str) -> str:
    """Snake case over ``[a-z0-9_]``; the per-row twin is ``functions.text.slug``."""
    return re.sub("[^a-z0-9]+", "_", str(raw or "").strip().lower()).strip("_")


def semantic_name(raw: str) -> str:
    """Lower case with accents and ``- . % /`` kept, at most 80 characters."""
    kept = re.sub(r"[^\w\s\-.%/]", " ", str(raw)).strip().lower()
    return re.sub(r"\s+", "_", kept)[:80] or "col"


def unique_names(names) -> list[str]:
    """Repeated names get ``_2``, ``_3``, …, never one that is already taken; empty names ``col_1``, …"""
    taken, result, empty = set(), [], 0
    for name in names:
        if not name:
            empty += 1
            name = f"col_{empty}"
        candidate, k = name, 2
        while candidate in taken:
            candidate, k = f"{name}_{k}", k + 1
        taken.add(candidate)
        result.append(candidate)
    return result


def header_names(raw, style: str = "slug") -> list[str]:
    clean = slug_name if style == "slug" else semantic_name
    return unique_names([clean(r) for r in raw])


def normalize_headers(df: DataFrame, style: str = "slug") -> DataFrame:
    """The table with clean, unique column names; ``style`` is ``slug`` or ``semantic``."""
    return df.toDF(*header_names(df.columns, style))
