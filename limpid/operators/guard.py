"""Checks of a dashboard spec against the data it would draw."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from limpid import vocab
from limpid.functions import numbers
from limpid.operators.cells import cell
from limpid.operators.columns import cardinalities, column_dict, estimate, non_null, rows

HEALTH_SCHEMA = "chart_id string, score double, code string, severity string, message string"

# ---- fixed values: penalties and limits -------------------------------------------------------
PENALTY = {"low_coverage": 10, "too_many_categories": 10, "id_dim": 20, "bool_dim": 5,
           "line_without_date": 25, "constant_metric": 25, "sum_mismatch": 10}
ERRORS = ("id_dim", "line_without_date", "constant_metric")
MAX_CATEGORIES, UNIQUE_SHARE, BOOL_SHARE, BLOCKING_SCORE = 50, 0.98, 0.9, 60.0


def _fields(chart: dict) -> dict[str, str | None]:
    enc = chart.get("encoding") or {}
    field = {k: (enc.get(k) or {}).get("field") for k in ("x", "y", "category", "value")}
    real = {k: None if f in vocab.META_FIELDS else f for k, f in field.items()}
    return {"x": real["x"], "y": real["y"] or real["value"], "category": real["category"],
            "dim": real["x"] or real["category"], "x_given": field["x"]}


def measure_charts(df: DataFrame, charts: list[dict]) -> dict:
    """All numbers the checks need, for all charts: one pass over the fields in use, one over small domains."""
    fields = [_fields(c) for c in charts]
    used = sorted({f for fs in fields for k in ("x", "y", "category") for f in [fs[k]] if f in df.columns})
    if not used:
        return {"columns": {}, "sums": {}, "cardinality": {}}

    columns = column_dict(df, {
        "rows": rows,
        "non_null": non_null,
        "estimate": estimate,
        "bools": lambda v, kind: F.count_if(F.lower(v.cast("string")).isin(*vocab.BOOL_WIDE)),
        "numbers": lambda v, kind: F.count(numbers.number_or_null(v, kind)),
        "low": lambda v, kind: F.min(numbers.number_or_null(v, kind)),
        "high": lambda v, kind: F.max(numbers.number_or_null(v, kind)),
        "total": lambda v, kind: F.coalesce(F.sum(numbers.number_or_null(v, kind)), F.lit(0.0)),
    }, used)
    # sum over the groups of a dimension = sum over the rows that have one
    pairs = sorted({(fs["dim"], fs["y"]) for c, fs in zip(charts, fields)
                    if c.get("type") == "bar" and fs["dim"] in columns and fs["y"] in columns})
    sums = {}
    if pairs:
        row = df.agg(*[F.coalesce(F.sum(F.when(cell(df, d).isNotNull(), numbers.number_or_null(cell(df, y), df.schema[y].dataType))), F.lit(0.0)).alias(f"s{i}")
                       for i, (d, y) in enumerate(pairs)]).first()
        sums = {p: row[f"s{i}"] for i, p in enumerate(pairs)}
    dims = {fs["dim"]: columns[fs["dim"]] for fs in fields if fs["dim"] in columns}
    counted = cardinalities(df, list(dims))
    for c, s in dims.items():
        if s["non_null"] < s["rows"]:
            counted[c] += 1  # missing counts as one more category
    return {"columns": columns, "sums": sums, "cardinality": counted}


def _issues(chart: dict, facts: dict, roles: dict, min_non_null: float, tol: float) -> list[tuple[str, str]]:
    fields, found = _fields(chart), []
    columns = facts["columns"]

    def cover(c):
        s = columns.get(c)
        return s["non_null"] / s["rows"] if s and s["rows"] else 0.0

    for c in filter(None, (fields["x"], fields["y"], fields["category"])):
        if cover(c) < min_non_null:
            found.append(("low_coverage", f"solo {cover(c):.0%} de '{c}' tiene valor"))
    dim, y, kind = fields["dim"], fields["y"], chart.get("type", "")
    if dim in columns:
        s, groups = columns[dim], facts["cardinality"][dim]
        if groups > MAX_CATEGORIES:
            found.append(("too_many_categories", f"{groups} grupos en '{dim}': conviene mostrar solo los mayores"))
        if s["rows"] and groups >= UNIQUE_SHARE * s["rows"]:
            found.append(("id_dim", f"'{dim}' casi no repite valores y no sirve para agrupar"))
        if s["non_null"] and s["bools"] > BOOL_SHARE * s["non_null"]:
            found.append(("bool_dim", f"'{dim}' solo distingue sí y no"))
    x = fields["x_given"]
    if kind == "line" and roles.get(x, "") != vocab.DATE:
        found.append(("line_without_date", f"el eje '{x}' de la línea no es temporal"))
    if kind in ("bar", "pie", "histogram") and y:
        s = columns.get(y)
        if s is None or (s["numbers"] and s["low"] == s["high"]):
            found.append(("constant_metric", f"'{y}' no varía"))
    if kind == "bar" and (dim, y) in facts["sums"]:
        part, total = facts["sums"][dim, y], columns[y]["total"]
        agree = math.isfinite(part) and math.isfinite(total) and total and abs(part - total) <= tol * abs(total)
        if total != 0 and not agree:
            found.append(("sum_mismatch", "los grupos no suman lo mismo que la tabla"))
    return found


def validate_charts(df: DataFrame, charts: list[dict], roles: dict[str, str], min_non_null: float = 0.6,
                    tol: float = 0.02) -> DataFrame:
    """``(chart_id, score, code, severity, message)``: one row per issue, or one without code per good chart."""
    found = []
    for chart_id, score, issues in _health(df, charts, roles, min_non_null, tol):
        for code, message in issues or [(None, None)]:
            severity = None if code is None else "error" if code in ERRORS else "warn"
            found.append((chart_id, score, code, severity, message))
    return df.sparkSession.createDataFrame(found, HEALTH_SCHEMA)


def _health(df, charts, roles, min_non_null, tol):
    facts = measure_charts(df, charts)
    for chart in charts:
        issues = _issues(chart, facts, roles, min_non_null, tol)
        score = max(0.0, min(100.0, 100.0 - sum(PENALTY[code] for code, _ in issues)))
        yield str(chart.get("id", "?")), score, issues


def dashboard_charts(spec: dict, limit: int = 4) -> list[dict]:
    """Charts of the first dashboard, in its order, ids that the spec does not define left out."""
    first = (spec.get("dashboards") or [{}])[0]
    by_id = {c["id"]: c for c in spec.get("charts", [])}
    return [by_id[i] for i in first.get("charts", [])[:limit] if i in by_id]


def validate_dashboard(df: DataFrame, spec: dict, roles: dict[str, str], min_non_null: float = 0.6,
                       tol: float = 0.02) -> dict:
    """Mean score of the first four charts; blocking when a chart has an error or the mean is under 60."""
    health = list(_health(df, dashboard_charts(spec), roles, min_non_null, tol))
    score = sum(s for _, s, _ in health) / len(health) if health else 0.0
    blocking = score < BLOCKING_SCORE or any(code in ERRORS for _, _, issues in health for code, _ in issues)
    return {"score": score, "blocking": blocking,
            "charts": {chart_id: {"score": s, "issues": issues} for chart_id, s, issues in health},
            "messages": ["hay gráficos poco fiables: mejor el diseño básico"] if blocking else []}
