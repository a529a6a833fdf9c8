"""Typed parsing and text expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import Tables, query
from catalog.dirt import auto_sql, date_sql, money_sql, plain_sql, relaxed_sql
from limpid.functions import dates, numbers, text
from limpid.operators import clean
from limpid.operators.columns import PerValue, column_table, share, tally

LINE = ("l_orderkey", "l_linenumber")


@query("parse_dates", f"select o_orderkey, strftime({date_sql('fecha')}, '%Y-%m-%d') as day from dirty_orders")
def _(t: Tables):
    return t.dirty_orders.select("o_orderkey", dates.iso_text(dates.parse_date(F.col("fecha"))).alias("day"))


@query("normalize_dates", f"""
    select o_orderkey, strftime({date_sql('fecha')}, '%Y-%m-%d') as fecha,
    strftime({date_sql('fecha_iso')}, '%Y-%m-%d') as fecha_iso, monto, prioridad from dirty_orders""")
def _(t: Tables):
    table, _ = clean.normalize_dates(t.dirty_orders.select("o_orderkey", "fecha", "fecha_iso", "monto", "prioridad"))
    return table


@query("parse_dates_tolerant", f"""
    select o_orderkey, strftime({date_sql('fecha_us', ('%Y-%m-%d', '%Y/%m/%d', '%m/%d/%Y'))}, '%Y-%m-%d') as month_first,
    strftime({date_sql('fecha')}, '%Y-%m-%d') as day_first from dirty_orders""")
def _(t: Tables):
    df = t.dirty_orders
    return df.select("o_orderkey", dates.iso_text(clean.tolerant_date(df, "fecha_us")).alias("month_first"),
                     dates.iso_text(clean.tolerant_date(df, "fecha")).alias("day_first"))


@query("iso_date_coerce", f"""
    select o_orderkey, strftime({date_sql('fecha_iso')}, '%Y-%m-%d') as fecha_iso, fecha from dirty_orders""")
def _(t: Tables):
    table = clean.coerce_iso_dates(t.dirty_orders.select("o_orderkey", "fecha_iso", "fecha"))
    return table.withColumn("fecha_iso", dates.iso_text(F.col("fecha_iso")))


@query("month_label", "select o_orderkey, strftime(o_orderdate, '%Y-%m') as month from orders")
def _(t: Tables):
    return t.orders.select("o_orderkey", dates.month_label(F.col("o_orderdate")).alias("month"))


def _parser(name, column, parse, sql):
    @query(name, f"select l_orderkey, l_linenumber, {column} as raw, {sql} as value from dirty_lines")
    def _(t: Tables):
        return t.dirty_lines.select(*LINE, F.col(column).alias("raw"), parse(F.col(column)).alias("value"))


_parser("parse_money", "mixto", numbers.money, money_sql("mixto"))
_parser("parse_float_auto", "mixto", numbers.auto_decimal, auto_sql("mixto"))
_parser("parse_relaxed", "mixto", numbers.relaxed_number, relaxed_sql("mixto"))
_parser("parse_numeric", "cantidad", numbers.plain_number, plain_sql("cantidad"))
_parser("parse_numeric_mixed", "mixto", numbers.plain_number, plain_sql("mixto"))
_parser("parse_percent", "descuento", numbers.percent,
        f"case when contains(descuento, '%') then {auto_sql('descuento')} / 100 end")


@query("trim_blank", """
    select o_orderkey, nullif(trim(relleno), '') as relleno, nullif(trim(fecha), '') as fecha from dirty_orders""")
def _(t: Tables):
    return clean.trim_blanks(t.dirty_orders.select("o_orderkey", "relleno", "fecha"))


@query("bool_coerce", """
    select o_orderkey, lower(pagado) in ('sí', 'si', 'true', '1') as pagado, lower(activo) in ('sí', 'si', 'true', '1') as activo,
    prioridad from dirty_orders""")
def _(t: Tables):
    return clean.coerce_bools(t.dirty_orders.select("o_orderkey", "pagado", "activo", "prioridad"))


@query("bool_coerce_digits", "select doc_id, quality = 1 as quality, toxic = 1 as toxic from labels")
def _(t: Tables):
    return clean.coerce_bools(t.labels)


@query("derived_amount", f"""
    select l_orderkey, l_linenumber, {auto_sql('unit_price')} * {plain_sql('cantidad')} as amount from dirty_lines""")
def _(t: Tables):
    from limpid.plans.objectives import amount_product
    return t.dirty_lines.select(*LINE, amount_product(F.col("unit_price"), F.col("cantidad")).alias("amount"))


@query("prettify_label", r"""
    with w as (select p_partkey, trim(regexp_replace(header, '[_-]+', ' ', 'g')) as words from headers)
    select p_partkey, upper(substr(words, 1, 1)) || substr(words, 2) as label from w""")
def _(t: Tables):
    return t.headers.select("p_partkey", text.prettify(F.col("header")).alias("label"))


@query("pct_text", """
    select o_orderpriority, format('{:.2f}%', count(*) filter (o_orderstatus = 'O') * 100.0 / count(*)) as open_pct
    from orders group by 1""")
def _(t: Tables):
    return t.orders.groupBy("o_orderpriority").agg(
        text.percent_text(F.count_if(F.col("o_orderstatus") == "O"), F.count(F.lit(1))).alias("open_pct"))


@query("example_text", "select doc_id, substr(trim(text, chr(10) || chr(9) || chr(13) || ' ' || chr(160)), 1, 80) as example from documents")
def _(t: Tables):
    return t.documents.select("doc_id", text.example_text(F.col("text")).alias("example"))


# ---- predicates -------------------------------------------------------------------------------

PREDICATES = {
    "bool_strict": (lambda v: text.is_bool_token(v), "lower(v) in ('true','1','sí','si','false','0','no')"),
    "bool_wide": (lambda v: F.lower(v).isin(*"0 1 true false t f si sí no y n".split()),
                  "lower(v) in ('0','1','true','false','t','f','si','sí','no','y','n')"),
    "money_symbol": (numbers.looks_money, r"regexp_matches(v, '[$€£]|^\s*[A-Z]{2,3}\s*\d')"),
    "money_code": (numbers.names_currency, "regexp_matches(v, '(?i)[$€£]|CLP|USD|EUR|MXN|ARS|BRL|PEN|GBP|COP|UYU')"),
    "percent": (numbers.is_percent, "contains(v, '%')"),
    "code": (numbers.looks_code, r"regexp_matches(v, '^[A-Za-z0-9\-_\/\.]{4,}$')"),
    "latitude": (lambda v: numbers.in_latitude(numbers.auto_decimal(v)), f"({auto_sql('v')}) between -90 and 90"),
    "longitude": (lambda v: numbers.in_longitude(numbers.auto_decimal(v)), f"({auto_sql('v')}) between -180 and 180"),
    "date": (lambda v: dates.parse_date(v).isNotNull(), f"{date_sql('v')} is not null"),
    "number_auto": (lambda v: numbers.auto_decimal(v).isNotNull(), f"({auto_sql('v')}) is not null"),
    "number_relaxed": (lambda v: numbers.relaxed_number(v).isNotNull(), f"({relaxed_sql('v')}) is not null"),
}


def _shares(source, columns):
    picked = ", ".join(f"round(avg(case when {sql} then 1.0 when v is null or ({sql}) is null then null else 0.0 end), 6) as {name}"
                       for name, (_, sql) in PREDICATES.items())
    return " union all ".join(f"select '{c}' as \"column\", {picked} from (select {c} as v from {source})" for c in columns)


def _measured(df, columns):
    measures = {name: PerValue((lambda p: lambda v, kind: p(v))(p), lambda found, v, n: F.round(share(F.when(v.isNotNull(), found), n), 6))
                for name, (p, _) in PREDICATES.items()}
    return column_table(tally(df, columns), measures).drop("ordinal")


ORDER_TEXT = ("fecha", "fecha_iso", "monto", "prioridad", "pagado", "activo")


@query("value_predicates", _shares("dirty_orders", ORDER_TEXT))
def _(t: Tables):
    return _measured(t.dirty_orders, ORDER_TEXT)


@query("value_predicates_lines", _shares("dirty_lines", ("mixto", "descuento", "cantidad", "moneda")))
def _(t: Tables):
    return _measured(t.dirty_lines, ("mixto", "descuento", "cantidad", "moneda"))


@query("value_predicates_text", """
    select round(avg(case when contains(text, '%') then 1.0 else 0.0 end), 6) as percent,
    round(avg(case when regexp_matches(text, '[$€£]|^\\s*[A-Z]{2,3}\\s*\\d') then 1.0 else 0.0 end), 6) as money_symbol,
    round(avg(case when regexp_matches(text, '(?i)[$€£]|CLP|USD|EUR|MXN|ARS|BRL|PEN|GBP|COP|UYU') then 1.0 else 0.0 end), 6) as money_code
    from documents""")
def _(t: Tables):
    v = F.col("text")
    return t.documents.agg(*[F.round(share(p(v)), 6).alias(name) for name, p in (
        ("percent", numbers.is_percent), ("money_symbol", numbers.looks_money), ("money_code", numbers.names_currency))])
