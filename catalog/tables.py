"""Imputation, duplicates, the whole clean, value tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import Tables, query
from catalog.dirt import date_sql
from limpid.functions import dates
from limpid.operators import clean, frequency
from limpid.operators.dedup import distinct_rows, keep_first

IMPUTABLE = ("o_orderkey", "precio", "cliente", "prioridad", "activo")


def _imputed(t: Tables, rules):
    return clean.impute(t.dirty_orders.select(*IMPUTABLE), rules)[0]


def by_column(**rules):
    return {"impute": {"by_column": rules}}


@query("impute_mean", """
    select o_orderkey, round(coalesce(precio, (select avg(precio) from dirty_orders)), 4) as precio,
    round(coalesce(cast(cliente as double), (select avg(cliente) from dirty_orders)), 4) as cliente, prioridad, activo from dirty_orders""")
def _(t: Tables):
    out = _imputed(t, by_column(precio={"strategy": "mean"}, cliente={"strategy": "mean"}, prioridad={"strategy": "none"}))
    return out.withColumns({c: F.round(c, 4) for c in ("precio", "cliente")})


def _mode(c):
    return f"(select {c} from dirty_orders where {c} is not null group by 1 order by count(*) desc, 1 limit 1)"


@query("impute_mode", f"""
    select o_orderkey, coalesce(precio, {_mode('precio')}) as precio, coalesce(cliente, {_mode('cliente')}) as cliente,
    coalesce(prioridad, {_mode('prioridad')}) as prioridad, coalesce(activo, {_mode('activo')}) as activo from dirty_orders""")
def _(t: Tables):
    mode = {"strategy": "mode"}
    return _imputed(t, by_column(precio=mode, cliente=mode, prioridad=mode, activo=mode))


@query("impute_value", """
    select o_orderkey, coalesce(precio, -1) as precio, cliente, coalesce(prioridad, 'N/D') as prioridad, activo from dirty_orders""")
def _(t: Tables):
    return _imputed(t, by_column(precio={"strategy": "value", "value": -1.0}, prioridad={"strategy": "value", "value": "N/D"},
                                 activo={"strategy": "unknown"}))


@query("impute_text_fill", """
    select o_orderkey, case when o_orderkey % 4 = 0 then 'N/D' when o_orderkey % 3 = 0 then 'true' else 'false' end as par,
    coalesce(prioridad, 'N/D') as prioridad from dirty_orders""")
def _(t: Tables):
    # a text fill makes a boolean column text
    flag = F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderkey") % 3 == 0)
    df = t.dirty_orders.select("o_orderkey", flag.alias("par"), "prioridad")
    return clean.impute(df, {"impute": {"default": {"text": "value", "value": "N/D"}}})[0]


@query("impute_default", f"""
    select o_orderkey, round(coalesce(precio, (select avg(precio) from dirty_orders)), 4) as precio, cliente,
    coalesce(prioridad, {_mode('prioridad')}) as prioridad, coalesce(activo, {_mode('activo')}) as activo from dirty_orders""")
def _(t: Tables):
    rules = {"impute": {"by_column": {"cliente": {"strategy": "skip"}}, "default": {"numeric": "mean", "text": "mode"}}}
    return _imputed(t, rules).withColumn("precio", F.round("precio", 4))


@query("impute_counts", " union all ".join(
    f"select '{c}' as \"column\", count(*) filter ({c} is null) as filled from dirty_orders" for c in IMPUTABLE[1:]))
def _(t: Tables):
    rules = {"impute": {"default": {"numeric": "mean", "text": "mode"}}}
    _, filled = clean.impute(t.dirty_orders.select(*IMPUTABLE), rules)
    return t.spark.createDataFrame(list(filled.items()), "column string, filled long")


@query("value_mode", " union all ".join(
    f"select '{c}' as \"column\", cast({_mode(c)} as varchar) as mode" for c in ("cliente", "prioridad", "activo", "pagado")))
def _(t: Tables):
    found = frequency.modes(t.dirty_orders, ["cliente", "prioridad", "activo", "pagado"])
    return t.spark.createDataFrame([(c, str(v)) for c, v in found.items()], "column string, mode string")


@query("dedup_keys_first", """
    select o_custkey, o_orderpriority, o_orderkey, o_totalprice from (
      select *, row_number() over (partition by o_custkey, o_orderpriority order by o_orderkey) as rn from orders) where rn = 1""")
def _(t: Tables):
    return keep_first(t.orders, ["o_custkey", "o_orderpriority"], "o_orderkey").select(
        "o_custkey", "o_orderpriority", "o_orderkey", "o_totalprice")


@query("dedup_keys_hot", """
    select l_returnflag, l_linestatus, l_orderkey, l_linenumber, l_extendedprice from (
      select *, row_number() over (partition by l_returnflag, l_linestatus
        order by l_orderkey, l_linenumber, l_partkey, l_extendedprice) as rn from lineitem) where rn = 1""")
def _(t: Tables):
    first = keep_first(t.lineitem, ["l_returnflag", "l_linestatus"],
                       ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"])
    return first.select("l_returnflag", "l_linestatus", "l_orderkey", "l_linenumber", "l_extendedprice")


@query("dedup_all", "select distinct o_custkey, o_orderstatus, o_orderpriority from orders")
def _(t: Tables):
    return distinct_rows(t.orders.select("o_custkey", "o_orderstatus", "o_orderpriority"))


REPEATED = "(select * from dirty_orders union all select * from dirty_orders where o_orderkey % 10 = 0)"


@query("clean_full", f"""
    with base as (select distinct o_orderkey, status, {date_sql('fecha_iso')} as fecha_iso, nullif(trim(relleno), '') as relleno,
                         lower(pagado) in ('sí', 'si', 'true', '1') as pagado, precio, nullif(trim(prioridad), '') as prioridad
                  from {REPEATED})
    select o_orderkey, status, strftime(fecha_iso, '%Y-%m-%d') as fecha_iso, relleno, pagado,
    round(coalesce(precio, (select avg(precio) from {REPEATED})), 4) as precio, coalesce(prioridad, 'SIN') as prioridad from base""")
def _(t: Tables):
    # one order in ten comes twice
    df = t.dirty_orders.select("o_orderkey", "status", "fecha_iso", "relleno", "pagado", "precio", "prioridad")
    repeated = df.unionByName(df.where(F.col("o_orderkey") % 10 == 0))
    rules = by_column(precio={"strategy": "mean"}, prioridad={"strategy": "value", "value": "SIN"})
    out, _ = clean.clean(repeated, rules)
    return out.withColumns({"fecha_iso": dates.iso_text(F.col("fecha_iso")), "precio": F.round("precio", 4)})


@query("clean_keys", f"""
    select o_custkey, o_orderkey, fecha, nullif(trim(relleno), '') as relleno from (
      select *, row_number() over (partition by o_custkey order by o_orderkey) as rn from {REPEATED}) where rn = 1""")
def _(t: Tables):
    df = t.dirty_orders.select("o_custkey", "o_orderkey", "fecha", "relleno")
    repeated = df.unionByName(df.where(F.col("o_orderkey") % 10 == 0))
    return clean.clean(repeated, {"dedup": {"keys": ["o_custkey", "missing"]}}, "o_orderkey")[0]


# ---- value-frequency tables -------------------------------------------------------------------

COUNTED = ("o_orderstatus", "o_orderpriority", "o_custkey", "o_orderkey")
CELLS = " union all ".join(f"select '{c}' as \"column\", cast({c} as varchar) as v from orders" for c in COUNTED)


@query("distinct_counts", f"select \"column\", count(distinct v) as uniques from ({CELLS}) group by 1")
def _(t: Tables):
    return frequency.distinct_counts(frequency.value_counts(t.orders, COUNTED))


@query("cardinality", " union all ".join(
    f"select '{c}' as \"column\", count(distinct {c}) as uniques from orders" for c in COUNTED))
def _(t: Tables):
    from limpid.operators.columns import cardinalities
    found = cardinalities(t.orders, COUNTED)
    return t.spark.createDataFrame(list(found.items()), "column string, uniques long")


@query("dup_members", f"""
    with f as (select "column", v, count(*) as n from ({CELLS}) group by 1, 2)
    select "column", cast(coalesce(sum(n) filter (n > 1), 0) as bigint) as duplicates from f group by 1""")
def _(t: Tables):
    return frequency.duplicate_members(frequency.value_counts(t.orders, COUNTED))


@query("value_entropy", """
    select 'prioridad' as "column", round(entropy(coalesce(prioridad, '~')), 6) as entropy from dirty_orders union all
    select 'cliente', round(entropy(coalesce(cliente, -1)), 6) from dirty_orders union all
    select 'status', round(entropy(status), 6) from dirty_orders""")
def _(t: Tables):
    found = frequency.entropy(frequency.value_counts(t.dirty_orders, ["prioridad", "cliente", "status"]))
    return found.withColumn("entropy", F.round("entropy", 6))


@query("value_sample", " union all ".join(f"""
    select * from (select '{c}' as "column", cast({c} as varchar) as value from orders
      order by md5('1|{c}|' || o_orderkey || '|' || {c}) limit 200)""" for c in ("o_orderpriority", "o_custkey")))
def _(t: Tables):
    from limpid.operators.sampling import sample_values
    return sample_values(t.orders, ["o_orderpriority", "o_custkey"], 200, 1, "o_orderkey")


SKETCHED = ("o_custkey", "o_orderkey", "o_orderpriority")


@query("kpi_nunique_sketch", " union all ".join(f"""
    select '{c}' as "column", count(distinct {c}) as exact, true as merged_within, true as kpi_within from orders""" for c in SKETCHED))
def _(t: Tables):
    # sketches kept per year, united; and the estimate as a headline number
    from limpid.operators import columns, kpi, sketches
    from limpid.storage import materialize
    parts = materialize(sketches.distinct_sketches(t.orders.withColumn("year", F.year("o_orderdate")), SKETCHED, ["year"]), "sketches")
    merged = sketches.distinct_estimates(sketches.united(parts))
    shown = kpi.kpi_values(t.orders, [{"op": "nunique_sketch", "col": c, "title": c} for c in SKETCHED]).select(F.col("title").alias("column"), "value")
    exact = t.spark.createDataFrame(list(columns.cardinalities(t.orders, SKETCHED).items()), "column string, exact long")
    within = lambda n: F.abs(F.col(n) - F.col("exact")) <= F.col("exact") * sketches.ERROR
    return exact.join(merged, "column").join(shown, "column").select(
        "column", "exact", within("estimate").alias("merged_within"), within("value").alias("kpi_within"))
