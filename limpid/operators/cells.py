"""Columns addressed by exact name, and the stacking of columns into cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

FLOATS = ("float", "double")
WHOLES = ("byte", "short", "integer", "long")


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    """Column by exact name; dots and the like in the name are not taken as field access."""
    return F.col(quoted(name))


def free_names(taken, *names: str) -> list[str]:
    """The names, each with underscores before it until no column has it; names count as equal in any case."""
    used = {t.lower() for t in taken}
    found = []
    for name in names:
        name = f"_{name}"
        while name.lower() in used:
            name = f"_{name}"
        used.add(name.lower())
        found.append(name)
    return found


def sql_text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_value(value) -> str:
    if value is None:
        return "cast(null as double)"
    return f"double('{value!r}')" if isinstance(value, float) else sql_text(value)


def kind_of(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.typeName()


def cell_sql(df: DataFrame, name: str) -> str:
    """A column with NaN read as missing, as SQL text."""
    if kind_of(df, name) in FLOATS:
        return f"nullif({quoted(name)}, {kind_of(df, name)}('NaN'))"
    return quoted(name)


def cell(df: DataFrame, name: str) -> Column:
    return F.expr(cell_sql(df, name))
