"""Dashboard specs recommended from the statistics of a table.

A spec is a plain dict: KPIs, filters, charts in an encoding of fields and aggregates, and a first dashboard
that lists the chart ids to draw.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F

from limpid import vocab
from limpid.functions import numbers
from limpid.ml.models import rank_charts
from limpid.operators.cells import col
from limpid.operators.columns import basic_stats, cardinalities, screened_cardinalities
from limpid.plans.objectives import (best_covered, choose_objectives, discover_amount, metric_aggregate, named,
                                     pick_dimension)
from limpid.plans.roles import business_domain, name_roles

AMOUNT_COLUMN = "_importe_calc"
GRID_LABELS = 1000  # most labels on an axis of a heatmap that shows all pairs


# ---- building blocks --------------------------------------------------------------------------

def _value(metric: str | None, aggregate: str = "sum") -> dict:
    return {"field": metric, "aggregate": aggregate} if metric else {"field": vocab.ROW_FIELD, "aggregate": "count"}


def _chart(chart_id: str, kind: str, title: str, x_title=None, y_title=None, limit=None, **encoding) -> dict:
    chart = {"id": chart_id, "type": kind, "title": title, "encoding": encoding}
    for key, value in (("x_title", x_title), ("y_title", y_title), ("limit", limit)):
        if value is not None:
            chart[key] = value
    return chart


def _month(field: str) -> dict:
    return {"field": field, "timeUnit": "month"}


def _kpis(*entries) -> list[dict]:
    rows = [{"title": "Filas", "op": "count_rows"}]
    return rows + [{"title": t, "op": op, "col": c} for t, op, c in entries if c]


def _filters(date: str | None, choices) -> list[dict]:
    found = [{"field": date, "type": "date_range"}] if date else []
    return found + [{"field": c, "type": "categorical", "max_values": 50} for c in choices]


def _spec(title: str, kpis, filters, schema: dict, charts, shown=None) -> dict:
    ids = [c["id"] for c in charts] if shown is None else shown
    return {"title": title, "kpis": kpis, "filters": filters, "schema": schema, "charts": charts,
            "dashboards": [{"title": title, "charts": ids}]}


def prettify_name(name: str) -> str:
    words = re.sub(r"[_\-]+", " ", name).strip()
    return words[:1].upper() + words[1:]


# ---- auto spec: the one the full run draws ----------------------------------------------------

def _money_metric(df: DataFrame, roles) -> tuple[DataFrame, str | None]:
    columns = [c for c in df.columns if c != "_pos"]
    money = [c for c in columns if roles.get(c) == vocab.MONEY] + named(columns, vocab.MONEY_NAME)
    quantity = next(iter(named(columns, vocab.QUANTITY_NAME)), None)
    price = next(iter(named(columns, vocab.PRICE_NAME)), None)
    if money:
        return df, money[0]
    if price and quantity:
        amount = (numbers.as_number(col(price), df.schema[price].dataType, "money")
                  * numbers.as_number(col(quantity), df.schema[quantity].dataType, "plain"))
        return df.withColumn(AMOUNT_COLUMN, amount), AMOUNT_COLUMN
    if quantity:
        return df, quantity
    numeric = [c for c in columns if roles.get(c) == vocab.NUMBER]
    numeric += [c for c in columns if numbers.is_numeric(df.schema[c].dataType)]
    return df, (numeric[0] if numeric else None)


def auto_spec(df: DataFrame, roles: dict[str, str], source_name: str | None = None) -> tuple[DataFrame, dict]:
    """KPIs, four charts and filters for the main date, metric and dimensions.

    Returns the table too, because a derived amount becomes a column of it. The date is never a dimension.
    """
    columns = [c for c in df.columns if c != "_pos" and c not in vocab.OUTLIER_COLUMNS]
    stats = basic_stats(df, columns)
    dates = [c for c in columns if roles.get(c) == vocab.DATE] or named(columns, vocab.DATE_NAME)
    date = best_covered(dates, stats)
    df, metric = _money_metric(df, roles)

    worded = (vocab.TEXT, vocab.CATEGORY, vocab.BOOL)
    candidates = [c for c in columns if c not in dates and (
        roles.get(c) in worded or not numbers.is_numeric(df.schema[c].dataType))]
    counted = screened_cardinalities(df, stats={c: stats[c] for c in candidates}) if candidates else {}

    def rank(c):
        preferred = any(w in c.lower() for w in vocab.DIM_PRIORITY)
        return (0 if preferred else 1, -counted[c], columns.index(c))

    dims = sorted((c for c in candidates if 2 <= counted[c] <= 50), key=rank)[:6]
    if not dims:
        dims = [c for c in candidates if not numbers.is_numeric(df.schema[c].dataType)][:1]

    measured, label = metric or "Registros", metric or "Conteo"
    charts = []
    if date:
        charts.append(_chart("ts_month", "line", f"{measured.capitalize()} por mes", "Mes", label,
                             x=_month(date), y=_value(metric)))
    charts.append(_chart("nulls_by_col", "bar", "Porcentaje de nulos por columna", vocab.COLUMN_FIELD, "% nulos",
                         min(20, len(columns)), x={"field": vocab.COLUMN_FIELD},
                         y={"field": vocab.NULL_PCT_FIELD, "aggregate": "mean"}))
    if dims:
        charts.append(_chart("top_dim", "bar", f"Top {dims[0]} por {metric or 'conteo'}", dims[0], label, 12,
                             x={"field": dims[0]}, y=_value(metric)))
    if date and len(dims) >= 2:
        charts.append(_chart("heatmap_month_dim", "heatmap", f"Mes × {dims[1]}", "Mes", dims[1],
                             x=_month(date), y={"field": dims[1]}, value=_value(metric)))
        charts[-1]["grid"] = GRID_LABELS
    elif dims:
        charts.append(_chart("pie_dim", "pie", f"Participación por {dims[0]}", limit=9,
                             category={"field": dims[0]}, value=_value(metric)))
    elif metric:
        charts.append(_chart("hist_metric", "histogram", f"Distribución de {metric}", metric, "Frecuencia",
                             x={"field": metric}))
    choices = dims[:3] + (["moneda"] if "moneda" in columns else [])
    spec = _spec(f"Dashboard seguro · {source_name or 'Dataset'}",
                 _kpis((f"Suma de {metric}", "sum", metric), (f"Promedio de {metric}", "mean", metric)),
                 _filters(date, dict.fromkeys(choices)),
                 {"roles": roles, "primary_date": date, "primary_metric": metric, "dims": dims},
                 charts, [c["id"] for c in charts][:4])
    return df, spec


# ---- business spec ----------------------------------------------------------------------------

def business_spec(df: DataFrame, roles: dict[str, str] | None = None,
                  source_name: str | None = None) -> tuple[DataFrame, dict]:
    """Revenue trend, tops, share of payment methods, status, distribution and missing values."""
    roles = roles or name_roles(df)
    columns = list(df.columns)
    lowered = [c.strip().lower() for c in columns]

    def first(pattern):
        return next((c for c, low in zip(columns, lowered) if re.search(pattern, low)), None)

    date = next((c for c in columns if roles.get(c) == vocab.DATE), None) or first(vocab.BUSINESS_DATE_NAME)
    df, amount, derived = discover_amount(df, roles)
    fitting = [c for c in columns if any(re.search(p, c.strip().lower()) for p, _ in vocab.BUSINESS_DIMS.values())]
    counted = screened_cardinalities(df, fitting) if fitting else {}
    dim = {kind: pick_dimension(fitting, pattern, most, counted)
           for kind, (pattern, most) in vocab.BUSINESS_DIMS.items()}

    mean_title = "Promedio (AOV aprox.)" if first(vocab.BUSINESS_ORDER_NAME) else "Promedio (por fila)"
    charts = []
    if date:
        charts.append(_chart("trend_revenue", "line", "Ingresos por mes", "Mes", "Ingresos",
                             x=_month(date), y=_value(amount)) if amount else
                      _chart("trend_count", "line", "Conteo por mes", "Mes", "Filas", x=_month(date), y=_value(None)))
    by = "ingresos" if amount else "conteo"
    for chart_id, kind, title in (("top_cat", "categoria", "Top categorías"), ("top_prod", "producto", "Top productos"),
                                  ("top_city", "ciudad", "Top ciudades"), ("top_client", "cliente", "Top clientes")):
        if dim[kind]:
            charts.append(_chart(chart_id, "bar", f"{title} por {by}", dim[kind], by.capitalize(), 12,
                                 x={"field": dim[kind]}, y=_value(amount)))
    if dim["pago"]:
        charts.append(_chart("share_pago", "pie", "Participación por método de pago", limit=9,
                             category={"field": dim["pago"]}, value=_value(amount)))
    if dim["estado"]:
        charts.append(_chart("by_status", "bar", "Órdenes por estatus", dim["estado"], "Conteo", 12,
                             x={"field": dim["estado"]}, y=_value(None)))
    if amount:
        charts.append(_chart("hist_amount", "histogram", "Distribución de importes", amount, "Frecuencia",
                             x={"field": amount}))
    charts.append(_chart("nulls_pct", "bar", "Porcentaje de nulos por columna", vocab.COLUMN_FIELD, "% nulos", 40,
                         x={"field": vocab.COLUMN_FIELD}, y={"field": vocab.NULL_PCT_FIELD, "aggregate": "none"}))

    dims = [d for d in dim.values() if d]
    wanted = ("trend_revenue", "trend_count", "top_cat", "top_prod", "share_pago", "by_status", "hist_amount", "top_city")
    present = {c["id"] for c in charts}
    shown = [i for i in wanted if i in present][:4] or [charts[0]["id"]]
    header = df.sparkSession.range(1).select(business_domain(F.lit(" ".join(lowered))).alias("d")).first()["d"]
    spec = _spec(f"Dashboard seguro · {source_name or 'dataset'}",
                 _kpis(("Ingresos (suma)", "sum", amount), (mean_title, "mean", amount),
                       ("Clientes únicos", "nunique", dim["cliente"])),
                 _filters(date, dims),
                 {"roles": roles, "primary_date": date, "primary_metric": amount, "dims": dims,
                  "derived": derived, "domain": header},
                 charts, shown)
    return df, spec


# ---- objective spec ---------------------------------------------------------------------------

def objective_spec(df: DataFrame, roles: dict[str, str], source_name: str | None = None) -> dict:
    """A short dashboard about the chosen objectives, for roles of the semantic vocabulary."""
    date, metric, dims, units = choose_objectives(df, roles)
    measured = prettify_name(metric) if metric else None
    value = _value(metric, metric_aggregate(metric) if metric else "count")
    charts = []
    if date:
        charts.append(_chart("ts", "line", f"{measured} por mes", "Mes", measured, x=_month(date), y=value) if metric
                      else _chart("ts_count", "line", "Conteo por mes", "Mes", "Conteo", x=_month(date), y=value))
    if dims:
        top, label = dims[0], prettify_name(dims[0])
        charts.append(_chart("top_dim", "bar", f"Top {label} por {measured}", top, metric, 12,
                             x={"field": top}, y=value) if metric else
                      _chart("top_dim_count", "bar", f"Top {label} (conteo)", top, "Conteo", 12,
                             x={"field": top}, y=value))
        groups = cardinalities(df, [top])[top]
        holes = basic_stats(df, [top])[top]
        if groups + (holes["non_null"] < holes["rows"]) <= 8:
            charts.append(_chart("share_dim", "pie", f"Participación por {label}", limit=8,
                                 category={"field": top}, value=value))
    if metric:
        charts.append(_chart("hist", "histogram", f"Distribución de {measured}", metric, "Frecuencia",
                             x={"field": metric}))
    groupable = [c for c, r in roles.items() if r in (vocab.CATEGORY, vocab.BOOL)]
    if not charts and groupable:
        any_dim = groupable[0]
        charts.append(_chart("fallback_count", "bar", f"Conteo por {prettify_name(any_dim)}", any_dim, "Conteo", 12,
                             x={"field": any_dim}, y=_value(None)))
    kpis = _kpis((f"Suma de {measured}", "sum", metric), (f"Promedio de {measured}", "mean", metric))
    if not metric and dims:
        kpis = _kpis((f"Categorías en {prettify_name(dims[0])}", "nunique", dims[0]))
    return _spec(f"Dashboard · {source_name}" if source_name else "Dashboard", kpis, _filters(date, groupable),
                 {"roles": roles, "primary_date": date, "primary_metric": metric, "dims": dims, "units": units,
                  "domain": "auto"}, charts)


# ---- safe spec and chart types ----------------------------------------------------------------

def safe_spec(df: DataFrame, roles: dict[str, str], title: str = "Dashboard") -> dict:
    """Row counts of the first column and missing values: draws on any table."""
    first = next(c for c in df.columns if c != "_pos")
    charts = [
        _chart("safe_count", "bar", f"Conteo por {first}", limit=12, x={"field": first}, y={"aggregate": "count"}),
        _chart("safe_nulls", "bar", "Porcentaje de nulos por columna",
               x={"field": vocab.COLUMN_FIELD}, y={"field": vocab.NULL_PCT_FIELD}),
    ]
    return _spec(title, _kpis(), [], {"roles": roles, "primary_date": None, "primary_metric": None, "dims": []},
                 charts)


def chart_types(date: str | None, metric: str | None, model=None, table: DataFrame | None = None) -> list[str]:
    """Chart types: the likeliest ones of a trained recommender for the one row of a schema table, or by rule."""
    if model is not None:
        return list(rank_charts(model, table).first()["types"])
    types = ["line_time"] if date and metric else []
    return types + ["bar_top"] + ([] if metric else ["hist"])
