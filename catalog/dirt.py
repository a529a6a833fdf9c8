"""Untidy versions of the test tables, in SQL that both engines read the same way.

Every view is a projection of a whole table: nulls, mixed date text, money text, padding, boolean words.
"""

from __future__ import annotations

import re


def iso(c: str) -> str:
    return f"cast(cast({c} as date) as string)"


def dmy(c: str, first: int = 9, second: int = 6, sep: str = "/") -> str:
    d = iso(c)
    return f"substr({d}, {first}, 2) || '{sep}' || substr({d}, {second}, 2) || '{sep}' || substr({d}, 1, 4)"


def thousands(c: str) -> str:
    """Whole part of a positive amount with dots: 112946.26 as 112.946."""
    w = f"cast(floor({c}) as bigint)"
    high = f"cast(({w} - {w} % 1000) / 1000 as bigint)"
    return (f"case when {w} < 1000 then cast({w} as string) else cast({high} as string) || '.' || "
            f"lpad(cast({w} % 1000 as string), 3, '0') end")


def cents(c: str) -> str:
    return f"lpad(cast(cast(round({c} * 100) as bigint) % 100 as string), 2, '0')"


def money_text(c: str) -> str:
    return f"'$' || ({thousands(c)}) || ',' || {cents(c)}"


VIEWS = {
    "dirty_orders": ("orders", {
        "o_orderkey": "o_orderkey",
        "o_custkey": "o_custkey",
        "status": "o_orderstatus",
        "fecha": "case o_orderkey % 4 when 0 then " + iso("o_orderdate") + " when 1 then " + dmy("o_orderdate")
                 + " when 2 then replace(" + iso("o_orderdate") + ", '-', '/') else 'n/d' end",
        "fecha_iso": "case when o_orderkey % 5 = 0 then null when o_orderkey % 11 = 0 then 'x' else "
                     + iso("o_orderdate") + " end",
        "fecha_us": "case when o_orderkey % 9 = 0 then null else "
                    + dmy("o_orderdate", 6, 9) + " end",
        "fecha_gap": "case when o_custkey % 2 = 0 or substr(" + iso("o_orderdate")
                     + ", 6, 2) in ('03', '04', '09') then null else o_orderdate end",
        "monto": "case when o_orderkey % 13 = 0 then null when o_orderkey % 17 = 0 then 's/i' else "
                 + money_text("o_totalprice") + " end",
        "precio": "case when o_orderkey % 7 = 0 then null else o_totalprice end",
        "cliente": "case when o_orderkey % 6 = 0 then null else o_custkey end",
        "prioridad": "nullif(o_orderpriority, '5-LOW')",
        "pagado": "case o_orderkey % 3 when 0 then 'sí' when 1 then 'no' else 'TRUE' end",
        "activo": "case when o_orderkey % 4 = 0 then null when o_orderkey % 3 = 0 then 'Si' else 'false' end",
        "relleno": "case when o_orderkey % 8 = 0 then '   ' else '  ' || o_orderpriority || ' ' end",
    }),
    "dirty_lines": ("lineitem", {
        "l_orderkey": "l_orderkey",
        "l_linenumber": "l_linenumber",
        "l_returnflag": "l_returnflag",
        "l_linestatus": "l_linestatus",
        "mixto": "case l_linenumber % 5 when 0 then " + money_text("l_extendedprice")
                 + " when 1 then " + "replace(" + thousands("l_extendedprice") + ", '.', ',') || '.' || "
                 + cents("l_extendedprice")
                 + " when 2 then cast(cast(floor(l_extendedprice) as bigint) as string) || ',' || "
                 + cents("l_extendedprice")
                 + " when 3 then ' USD ' || cast(cast(floor(l_extendedprice) as bigint) as string) || '.' || "
                 + cents("l_extendedprice") + " else case when l_orderkey % 2 = 0 then '--3' else '1e5' end end",
        "descuento": "case when l_orderkey % 3 = 0 then cast(cast(round(l_discount * 100) as bigint) as string) || ',5%'"
                     " when l_orderkey % 3 = 1 then cast(cast(round(l_discount * 100) as bigint) as string) || ' %'"
                     " else cast(cast(round(l_discount * 100) as bigint) as string) end",
        "cantidad": "case when l_linenumber = 7 then 'n/a' else cast(cast(l_quantity as bigint) as string) end",
        "unit_price": "'$' || cast(cast(floor(l_extendedprice / l_quantity) as bigint) as string) || ',5'",
        "moneda": "case when l_orderkey % 3 = 0 then 'usd' when l_orderkey % 3 = 1 then 'CLP' else 'xyz' end",
    }),
    "headers": ("part", {
        "p_partkey": "p_partkey",
        "p_brand": "p_brand",
        "tabla": "cast(floor(p_partkey / 20) as bigint)",
        "header": "case p_partkey % 12 when 0 then ' Order ID ' when 1 then 'Fecha' when 2 then 'unit_price'"
                  " when 3 then 'Total  Monto' when 4 then 'is_active' when 5 then 'categoria-tipo'"
                  " when 6 then 'cantidad qty' when 7 then 'GEO lat' when 8 then 'salary (%)' when 9 then 'stock/bodega'"
                  " when 10 then 'Currency.moneda' else '###' end"
                  " || case when p_size % 3 = 0 then '' when p_size % 3 = 1 then ' ' || p_name"
                  " else '_' || p_type || '-' || cast(p_size as string) end",
    }),
    "runs": ("orders", {
        "run_id": "o_orderkey",
        "status": "case o_orderkey % 9 when 0 then ' Done ' when 1 then 'in_progress' when 2 then 'ERROR' when 3 then ''"
                  " when 4 then null when 5 then 'queued' when 6 then 'paused' when 7 then 'Finished' else 'processing' end",
        "first_step": "case o_custkey % 4 when 0 then 'ingesta' when 1 then 'Upload' when 2 then 'subir' else 'Otro' end",
        "second_step": "case o_custkey % 3 when 0 then 'profiling' when 1 then ' perfilado ' else 'Cleaning' end",
        "first_status": "case when o_orderkey % 5 = 0 then 'success' else 'processing' end",
        "current": "case o_orderkey % 6 when 0 then 'report' when 1 then 'limpieza' when 2 then null"
                   " when 3 then 'Dashboard' when 4 then 'upload' else 'x' end",
        "given": "case when o_orderkey % 4 = 0 then null else cast(o_custkey % 150 as int) - 20 end",
    }),
    "run_events": ("events", {
        "event_id": "event_id",
        "type": "case when event_type = 'view' then 'stage_start' else 'stage_end' end",
        "stage": "case user_id % 5 when 0 then 'Ingesta' when 1 then 'Fechas' when 2 then 'Perfilado'"
                 " when 3 then 'Limpieza' else 'Outliers' end",
        "status": "case when event_type = 'error' then 'failed' else 'ok' end",
        "duration_ms": "cast(round(value * 100) as bigint)",
    }),
}


def with_views(sql: str) -> str:
    """The SQL with a ``with`` clause for every view it names."""
    used = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    ctes = ", ".join(
        f"{v} as (select " + ", ".join(f"{expr} as {alias}" for alias, expr in VIEWS[v][1].items())
        + f" from {VIEWS[v][0]})" for v in used)
    if not ctes:
        return sql
    body = sql.strip()
    if body.lower().startswith("with "):
        return f"with {ctes}, {body[5:]}"
    return f"with {ctes} {body}"


# ---- the parsers in SQL -----------------------------------------------------------------------

NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def plain_sql(c: str) -> str:
    return f"case when regexp_matches({c}, '{NUMBER}') then try_cast(trim({c}) as double) end"


def money_sql(c: str) -> str:
    return plain_sql(f"replace(regexp_replace({c}, '[^0-9,-]', '', 'g'), ',', '.')")


def auto_sql(c: str) -> str:
    kept = f"regexp_replace({c}, '[^0-9,.-]', '', 'g')"
    return plain_sql(f"(case when regexp_matches({kept}, ',[^,.]*$') then replace(replace({kept}, '.', ''), ',', '.') "
                     f"else replace({kept}, ',', '') end)")


def relaxed_sql(c: str) -> str:
    return plain_sql(f"replace(regexp_replace({c}, '[.\\s]', '', 'g'), ',', '.')")


def date_sql(c: str, formats=("%Y-%m-%d", "%d/%m/%Y", "%Y/%m/%d")) -> str:
    shapes = {"%Y-%m-%d": r"^\d{4}-\d{1,2}-\d{1,2}$", "%d/%m/%Y": r"^\d{1,2}/\d{1,2}/\d{4}$",
              "%m/%d/%Y": r"^\d{1,2}/\d{1,2}/\d{4}$", "%Y/%m/%d": r"^\d{4}/\d{1,2}/\d{1,2}$"}
    arms = " ".join(f"when regexp_matches(trim({c}), '{shapes[f]}') then try_strptime(trim({c}), '{f}')" for f in formats)
    return f"cast(case {arms} end as date)"
