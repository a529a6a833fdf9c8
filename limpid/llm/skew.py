"""Joining rows with a table of their groups when a few groups may hold a large part of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: A group is hot when it holds more than one in so many rows; so there are fewer hot groups than this.
HOT_SHARE = 1000
#: Up to so many keys of rows to leave out are broadcast; more are met by a shuffle of the rows.
FEW_KEYS = 500_000


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """``rows`` with the columns of ``groups`` (one row per non-null key); rows without a group get nulls there.

    ``size`` names the group's number of rows and ``total`` is that of all rows. Hot groups, fewer than ``HOT_SHARE``
    by arithmetic, are broadcast, so their rows stay where they are; in the shuffle of the others no key is hot.
    Both tables are read twice: hand in staged ones.
    """
    is_hot = F.col(size) * HOT_SHARE > F.lit(total)
    hot, cold = F.broadcast(groups.filter(is_hot)), groups.filter(~is_hot)
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(cold, key, "left"))


def few(table: DataFrame) -> DataFrame:
    """A staged table of short rows, to be broadcast if it has few of them."""
    return F.broadcast(table) if table.count() <= FEW_KEYS else table


def without(rows: DataFrame, lost: DataFrame, on: str | list[str] | Column) -> DataFrame:
    """``rows`` that match none of ``lost``, a staged table of keys, which is broadcast if it is small."""
    return rows.join(few(lost), on, "left_anti")
