"""Profiles and outliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import Tables, query
from catalog.dirt import date_sql, money_sql
from limpid import vocab
from limpid.operators import frequency, outliers, profile
from limpid.operators.quantiles import exact_quantiles

NUMERIC = ("o_totalprice", "o_custkey")


def _summary_sql(column, source, expr):
    return f"""select '{column}' as "column", count({expr}) as n, round(min({expr}), 4) as min,
        round(quantile_cont({expr}, 0.05), 4) as p5, round(quantile_cont({expr}, 0.25), 4) as q1, round(avg({expr}), 4) as mean,
        round(quantile_cont({expr}, 0.75), 4) as q3, round(quantile_cont({expr}, 0.95), 4) as p95, round(max({expr}), 4) as max,
        round(stddev_samp({expr}), 4) as std, (select count(*) from {source}, (select quantile_cont({expr}, 0.25) as a,
        quantile_cont({expr}, 0.75) as b from {source}) where {expr} < a - 1.5 * (b - a) or {expr} > b + 1.5 * (b - a)) as outliers
        from {source}"""


def _rounded(df):
    return df.select(*[F.round(c, 4).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


@query("profile_numeric", " union all ".join([
    _summary_sql("monto", "dirty_orders", f"({money_sql('monto')})"), _summary_sql("precio", "dirty_orders", "precio"),
    _summary_sql("cliente", "dirty_orders", "cast(cliente as double)")]))
def _(t: Tables):
    df = t.dirty_orders
    exprs = {"monto": profile.numeric_expr(df, "monto", "monto"), "precio": profile.numeric_expr(df, "precio"),
             "cliente": profile.numeric_expr(df, "cliente")}
    return _rounded(profile.numeric_summary(df, exprs))


@query("profile_numeric_lines", " union all ".join(
    _summary_sql(c, "lineitem", c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")))
def _(t: Tables):
    columns = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return _rounded(profile.numeric_summary(t.lineitem, {c: F.col(c) for c in columns}))


TEXT = ("relleno", "prioridad", "status")


@query("profile_text", " union all ".join(f"""
    select '{c}' as "column", (select string_agg(v || '(' || n || ')', ', ' order by n desc, v) from (
      select trim({c}) as v, count(*) as n from dirty_orders where {c} is not null group by 1 order by n desc, v limit 3)) as top3,
    cast(min(length(trim({c}))) as int) as min_len, cast(floor(quantile_cont(length(trim({c})), 0.5)) as int) as median_len,
    cast(max(length(trim({c}))) as int) as max_len from dirty_orders where {c} is not null""" for c in TEXT))
def _(t: Tables):
    return profile.text_summary(t.dirty_orders, TEXT)


@query("profile_text_documents", """
    select 'lang' as "column", (select string_agg(v || '(' || n || ')', ', ' order by n desc, v) from (
      select lang as v, count(*) as n from documents group by 1 order by n desc, v limit 3)) as top3,
    cast(min(length(lang)) as int) as min_len, cast(floor(quantile_cont(length(lang), 0.5)) as int) as median_len,
    cast(max(length(lang)) as int) as max_len from documents
    union all
    select 'source', (select string_agg(v || '(' || n || ')', ', ' order by n desc, v) from (
      select source as v, count(*) as n from documents group by 1 order by n desc, v limit 3)),
    cast(min(length(source)) as int), cast(floor(quantile_cont(length(source), 0.5)) as int), cast(max(length(source)) as int) from documents""")
def _(t: Tables):
    return profile.text_summary(t.documents, ("lang", "source"))


def _dates_sql(c):
    d = date_sql(c)
    return f"""select '{c}' as "column", count(*) as rows, count({d}) as parsed,
        format('{{:.2f}}%', count({d}) * 100.0 / count(*)) as parsed_pct, strftime(min({d}), '%Y-%m-%d') as min,
        strftime(max({d}), '%Y-%m-%d') as max from dirty_orders"""


@query("profile_date", _dates_sql("fecha") + " union all " + _dates_sql("fecha_iso"))
def _(t: Tables):
    return profile.date_summary(frequency.value_counts(t.dirty_orders, ("fecha", "fecha_iso")))


@query("profile_bool", " union all ".join(f"""select '{c}' as "column",
    count(*) filter (lower(cast({c} as varchar)) in ('sí', 'si', 'true', '1', 't', 'y')) as true_count,
    count(*) filter (lower(cast({c} as varchar)) in ('no', 'false', '0', 'f', 'n')) as false_count from {s}"""
                                          for c, s in (("pagado", "dirty_orders"), ("activo", "dirty_orders"))))
def _(t: Tables):
    return profile.bool_summary(frequency.value_counts(t.dirty_orders, ("pagado", "activo")))


@query("profile_bool_labels", " union all ".join(f"""select '{c}' as "column", count(*) filter ({c} = 1) as true_count,
    count(*) filter ({c} = 0) as false_count from labels""" for c in ("quality", "toxic")))
def _(t: Tables):
    return profile.bool_summary(frequency.value_counts(t.labels, ("quality", "toxic")))


@query("profile_currency", """
    select 'moneda' as "column", string_agg(moneda || '(' || n || ')', ', ' order by n desc, moneda) as top3 from (
      select moneda, count(*) as n from dirty_lines group by 1 order by n desc, moneda limit 3)""")
def _(t: Tables):
    return profile.top3_text(frequency.stripped(frequency.value_counts(t.dirty_lines, ["moneda"])))


@query("profile_examples", " union all ".join(f"""
    select '{c}' as "column", string_agg(v, '|' order by p, v) as examples from (select substr(trim({c}), 1, 80) as v, min(o_orderkey) as p
      from dirty_orders where trim({c}) <> '' group by 1 order by p, v limit 5)""" for c in ("relleno", "prioridad", "fecha", "monto")))
def _(t: Tables):
    freq = frequency.value_counts(t.dirty_orders, ["relleno", "prioridad", "fecha", "monto"], "o_orderkey")
    return profile.examples(frequency.stripped(freq)).select("column", F.array_join("examples", "|").alias("examples"))


PROFILE_ROLES = {"o_orderkey": "id", "cliente": "id", "precio": "numérico", "monto": "monto", "fecha": "fecha", "fecha_us": "fecha",
                 "pagado": "bool", "prioridad": "texto", "status": "categoría"}


@query("profile_alerts", f"""
    with q as (select quantile_cont(precio, 0.25) as a, quantile_cont(precio, 0.75) as b from dirty_orders),
    o as (select count(*) as n from dirty_orders, q where precio < a - 1.5 * (b - a) or precio > b + 1.5 * (b - a)),
    d as (select sum(n) as n from (select cliente, count(*) as n from dirty_orders group by 1) where n > 1),
    f as (select count({date_sql('fecha_us', ('%Y-%m-%d', '%Y/%m/%d', '%d/%m/%Y'))}) * 1.0 / count(*) as r from dirty_orders)
    select 'cliente' as "column", 'duplicados=' || n as alerts from d
    union all select 'precio', 'outliers_Tukey=' || n from o where n > 0
    union all select 'fecha_us', 'baja_lectura_fechas' from f where r < 0.7""")
def _(t: Tables):
    df = t.dirty_orders.select(*[c for c in PROFILE_ROLES if c not in ("monto", "fecha")])
    table = profile.profile(df, PROFILE_ROLES, "o_orderkey")
    return table.select("column", F.array_join("alerts", ", ").alias("alerts")).where("alerts <> ''")


@query("profile_table", " union all ".join(f"""
    select '{c}' as "column", '{r}' as role, count(distinct {c}) as uniques,
    format('{{:.2f}}%', count(distinct {c}) * 100.0 / count(*)) as uniques_pct, count(*) filter ({c} is null) as nulls,
    format('{{:.2f}}%', count(*) filter ({c} is null) * 100.0 / count(*)) as nulls_pct from dirty_orders""" for c, r in PROFILE_ROLES.items()))
def _(t: Tables):
    table = profile.profile(t.dirty_orders.select(*PROFILE_ROLES), PROFILE_ROLES, "o_orderkey")
    return table.select("column", "role", "uniques", "uniques_pct", "nulls", "nulls_pct")


@query("profile_compact", " union all ".join(f"""
    select '{c}' as "column", '{k}' as dtype, count(*) as rows, count({c}) as non_null,
    round(count(*) filter ({c} is null) * 100.0 / count(*), 4) as null_pct,
    count(distinct {c}) + max(case when {c} is null then 1 else 0 end) as nunique,
    {('round(min(cast(' + c + ' as double)), 4)') if k != 'string' else 'cast(null as double)'} as min,
    {('round(max(cast(' + c + ' as double)), 4)') if k != 'string' else 'cast(null as double)'} as max,
    (select string_agg(v, '|' order by k) from (select cast({c} as varchar) as v, o_orderkey as k from dirty_orders
      where {c} is not null order by k limit 5)) as sample from dirty_orders"""
                                             for c, k in (("cliente", "bigint"), ("prioridad", "string"), ("status", "string"))))
def _(t: Tables):
    df = t.dirty_orders.select("o_orderkey", "cliente", "prioridad", "status")
    table = profile.compact_profile(df, "o_orderkey")
    return table.select("column", "dtype", "rows", "non_null", F.round("null_pct", 4).alias("null_pct"), "nunique",
                        F.round("min", 4).alias("min"), F.round("max", 4).alias("max"), F.array_join("sample", "|").alias("sample"))


# ---- outliers ---------------------------------------------------------------------------------

@query("tukey_outliers", """
    with q as (select quantile_cont(l_extendedprice, 0.25) as a, quantile_cont(l_extendedprice, 0.75) as b from lineitem)
    select l_orderkey, l_linenumber, l_extendedprice from lineitem, q
    where l_extendedprice < a - 1.5 * (b - a) or l_extendedprice > b + 1.5 * (b - a)""")
def _(t: Tables):
    return outliers.tukey_rows(t.lineitem, "l_extendedprice").select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("tukey_outliers_unit_price", """
    with m as (select l_orderkey, l_linenumber, l_extendedprice / l_quantity as v from lineitem),
    q as (select quantile_cont(v, 0.25) as a, quantile_cont(v, 0.75) as b from m)
    select l_orderkey, l_linenumber, v from m, q where v < a - 1.5 * (b - a) or v > b + 1.5 * (b - a)""")
def _(t: Tables):
    unit = t.lineitem.select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") / F.col("l_quantity")).alias("v"))
    return outliers.tukey_rows(unit, "v")


@query("outlier_prep", """
    with m as (select quantile_cont(precio, 0.5) as p, quantile_cont(cast(cliente as double), 0.5) as c from dirty_orders),
    f as (select o_orderkey, coalesce(precio, p) as precio, coalesce(cast(cliente as double), c) as cliente from dirty_orders, m),
    s as (select avg(precio) as pm, stddev_pop(precio) as ps, avg(cliente) as cm, stddev_pop(cliente) as cs from f)
    select o_orderkey, round((precio - pm) / ps, 4) as precio, round((cliente - cm) / cs, 4) as cliente from f, s""")
def _(t: Tables):
    df = t.dirty_orders.select("o_orderkey", "precio", "cliente")
    scaled = outliers.standardized(df, ["precio", "cliente"])
    return df.select("o_orderkey", *[F.round(e, 4).alias(c) for c, e in scaled.items()])


@query("outlier_features", """
    select 'cliente' as feature union all select 'precio' union all select 'o_orderkey' union all select 'o_custkey'""")
def _(t: Tables):
    df = t.dirty_orders.withColumns({"constante": F.lit(1), "outlier_score": F.col("precio")})
    return t.spark.createDataFrame([(c,) for c in outliers.numeric_features(df)], "feature string")


@query("isolation_forest")
def _(t: Tables):
    df = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    flagged, _ = outliers.isolation_forest(df)
    return flagged


@query("isolation_forest_planted", """
    select count(*) + 1 as total, true as planted_flagged, cast(0 as bigint) as flags_off,
    cast(0 as double) as cut from orders""")
def _(t: Tables):
    """A row far from all others is flagged, and the rows flagged are those above the quantile of the scores.

    It need not have the top score: a tree that has not drawn it cannot tell it from the extreme rows it has drawn.
    """
    df = t.orders.select("o_orderkey", F.col("o_custkey").cast("double").alias("client"), F.col("o_totalprice").cast("double").alias("price"))
    far = df.agg(F.lit(-1).cast("long").alias("o_orderkey"), (F.max("client") * 20).alias("client"), (F.max("price") * 20).alias("price"))
    flagged, _ = outliers.isolation_forest(df.unionByName(far), order_by="o_orderkey")
    cut = exact_quantiles(flagged, {"normality": -F.col("outlier_score")}, [vocab.CONTAMINATION])["normality"][0]
    planted = F.col("o_orderkey") == -1
    score = F.col("outlier_score")
    return flagged.agg(F.count(F.lit(1)).alias("total"),
                       F.max(F.when(planted, F.col("is_outlier"))).alias("planted_flagged"),
                       F.count_if(F.col("is_outlier") != (score > -cut)).alias("flags_off"),
                       F.round(F.lit(abs(cut)), 9).alias("cut"))


@query("isolation_forest_summary", """
    select count(*) as total, cast(0.05 as double) as ratio from orders""")
def _(t: Tables):
    flagged, _ = outliers.isolation_forest(t.orders.select("o_orderkey", "o_custkey", "o_totalprice"), order_by="o_orderkey")
    return outliers.outlier_summary(flagged).select("total", F.round("ratio", 3).alias("ratio"))
