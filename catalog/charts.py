"""Charts, KPIs and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import Tables, query
from catalog.dirt import money_sql
from limpid.operators import charts, filters, kpi
from limpid.operators.profile import missing_by_column, quality_summary


def line(date, value=None, aggregate="count"):
    return {"id": "ts_month", "type": "line", "encoding": {
        "x": {"field": date, "timeUnit": "month"}, "y": {"field": value or "__row__", "aggregate": aggregate}}}


def bar(dim, value=None, aggregate="count", limit=10):
    return {"id": "top_dim", "type": "bar", "limit": limit, "encoding": {
        "x": {"field": dim}, "y": {"field": value or "__row__", "aggregate": aggregate}}}


def pie(dim, value=None, aggregate="count", limit=8):
    return {"id": "pie_dim", "type": "pie", "limit": limit, "encoding": {
        "category": {"field": dim}, "value": {"field": value or "__row__", "aggregate": aggregate}}}


def heat(x, y, value=None, aggregate="count", month=False):
    return {"id": "heat", "type": "heatmap", "grid": 1000, "encoding": {
        "x": {"field": x, **({"timeUnit": "month"} if month else {})}, "y": {"field": y},
        "value": {"field": value or "__row__", "aggregate": aggregate}}}


def drawn(df, chart, *columns):
    columns = columns or ("x", "value")
    return charts.run_chart(df, chart).select(*[F.round(c, 4).alias(c) if c == "value" else F.col(c) for c in columns])


@query("chart_line_month_sum", """
    select strftime(o_orderdate, '%Y-%m') as x, round(sum(o_totalprice), 4) as value from orders group by 1""")
def _(t: Tables):
    return drawn(t.orders, line("o_orderdate", "o_totalprice", "sum"))


@query("chart_line_month_mean", """
    select strftime(fecha_gap, '%Y-%m') as x, round(avg(precio), 6) as value from dirty_orders
    where fecha_gap is not null group by 1 having avg(precio) is not null""")
def _(t: Tables):
    # six places: a mean of eight amounts in cents ends in a five at the fifth, where engines round differently
    return charts.run_chart(t.dirty_orders, line("fecha_gap", "precio", "mean")).select("x", F.round("value", 6).alias("value"))


@query("chart_line_month_count", """
    with seen as (select date_trunc('month', fecha_gap) as m, count(*) as n from dirty_orders
                  where fecha_gap is not null group by 1),
    spine as (select unnest(generate_series(min(m), max(m), interval 1 month)) as m from seen)
    select strftime(spine.m, '%Y-%m') as x, cast(coalesce(n, 0) as double) as value
    from spine left join seen on cast(seen.m as timestamp) = cast(spine.m as timestamp)""")
def _(t: Tables):
    return drawn(t.dirty_orders, line("fecha_gap"))


@query("chart_bar_top_sum", f"""
    select prioridad as x, round(sum(coalesce({money_sql('monto')}, 0)), 2) as value from dirty_orders
    where prioridad is not null group by 1 order by 2 desc, 1 limit 3""")
def _(t: Tables):
    return charts.run_chart(t.dirty_orders, bar("prioridad", "monto", "sum", 3)).select("x", F.round("value", 2).alias("value"))


@query("chart_bar_top_mean", """
    select p_brand as x, round(avg(p_retailprice), 4) as value from part group by 1 order by avg(p_retailprice) desc, 1 limit 10""")
def _(t: Tables):
    return drawn(t.part, bar("p_brand", "p_retailprice", "mean"))


@query("chart_bar_top_count", """
    select prioridad as x, cast(count(*) as double) as value from dirty_orders group by 1 order by 2 desc, 1 limit 10""")
def _(t: Tables):
    return drawn(t.dirty_orders, bar("prioridad"))


@query("chart_pie_otros_sum", """
    with g as (select c_nationkey as x, sum(c_acctbal) as v from customer group by 1),
    r as (select *, row_number() over (order by v desc, x) as rn, count(*) over () as n from g)
    select case when n > 8 and rn >= 8 then 'Otros' else cast(x as varchar) end as x, round(sum(v), 2) as value
    from r group by 1""")
def _(t: Tables):
    return charts.run_chart(t.customer, pie("c_nationkey", "c_acctbal", "sum")).select("x", F.round("value", 2).alias("value"))


@query("chart_pie_mean", """
    with g as (select p_brand as x, avg(p_retailprice) as v from part group by 1),
    r as (select *, row_number() over (order by v desc, x) as rn, count(*) over () as n from g)
    select case when n > 9 and rn >= 9 then 'Otros' else x end as x, round(sum(v), 4) as value from r group by 1""")
def _(t: Tables):
    return drawn(t.part, pie("p_brand", "p_retailprice", "mean", 9))


@query("chart_pie_count", """
    with g as (select prioridad as x, count(*) as v from dirty_orders group by 1),
    r as (select *, row_number() over (order by v desc, x nulls last) as rn, count(*) over () as n from g)
    select case when n > 4 and rn >= 4 then 'Otros' else x end as x, cast(sum(v) as double) as value from r group by 1""")
def _(t: Tables):
    return drawn(t.dirty_orders, pie("prioridad", limit=4))


@query("chart_heatmap_month_sum", """
    with c as (select strftime(o_orderdate, '%Y-%m') as x, o_orderpriority as y, sum(o_totalprice) as v from orders group by 1, 2),
    xs as (select distinct x from c), ys as (select distinct y from c)
    select xs.x, ys.y, round(coalesce(v, 0), 2) as value from xs cross join ys left join c on c.x = xs.x and c.y = ys.y""")
def _(t: Tables):
    out = charts.run_chart(t.orders, heat("o_orderdate", "o_orderpriority", "o_totalprice", "sum", month=True))
    return out.select("x", "y", F.round("value", 2).alias("value"))


@query("chart_heatmap_count", """
    with c as (select prioridad as x, status as y, count(*) as v from dirty_orders
               where prioridad is not null and status is not null group by 1, 2),
    xs as (select distinct x from c), ys as (select distinct y from c)
    select xs.x, ys.y, cast(coalesce(v, 0) as double) as value from xs cross join ys left join c on c.x = xs.x and c.y = ys.y""")
def _(t: Tables):
    return drawn(t.dirty_orders, heat("prioridad", "status"), "x", "y", "value")


@query("chart_heatmap_mean", """
    with c as (select l_returnflag as x, cast(l_linenumber as varchar) as y, avg(l_discount) as v from lineitem group by 1, 2),
    xs as (select distinct x from c), ys as (select distinct y from c)
    select xs.x, ys.y, round(coalesce(v, 0), 4) as value from xs cross join ys left join c on c.x = xs.x and c.y = ys.y""")
def _(t: Tables):
    return drawn(t.lineitem, heat("l_returnflag", "l_linenumber", "l_discount", "mean"), "x", "y", "value")


@query("chart_heatmap_wide", """
    select cast(l_orderkey as varchar) as x, l_returnflag as y, round(sum(l_quantity), 2) as value from lineitem group by 1, 2""")
def _(t: Tables):
    # as many labels as orders, so only the pairs that occur
    wide = {**heat("l_orderkey", "l_returnflag", "l_quantity", "sum"), "grid": None}
    return charts.run_chart(t.lineitem, wide).select("x", "y", F.round("value", 2).alias("value"))


@query("chart_line_month_count_field", """
    with c as (select date_trunc('month', o_orderdate) as m, count(*) as n from orders group by 1),
    s as (select unnest(generate_series((select min(m) from c), (select max(m) from c), interval 1 month)) as m)
    select strftime(s.m, '%Y-%m') as x, cast(coalesce(n, 0) as double) as value from s left join c on c.m = s.m""")
def _(t: Tables):
    return drawn(t.orders, line("o_orderdate", "o_totalprice", "count"))


@query("filter_domain_wide", """
    with c as (select cast(o_custkey as varchar) as value, count(*) as n from orders group by 1),
    r as (select *, cast(row_number() over (order by n desc, value) as int) as rank from c)
    select 'o_custkey' as field, value, n, rank from r where rank <= 1200""")
def _(t: Tables):
    from limpid.operators.filters import filter_domain
    found = filter_domain(t.orders, [{"field": "o_custkey", "type": "categorical", "max_values": 1200}])
    return found.select("field", "value", "n", "rank")


@query("chart_histogram", """
    with e as (select min(o_totalprice) as low, max(o_totalprice) as high, (max(o_totalprice) - min(o_totalprice)) / 20 as w from orders),
    c as (select least(cast(floor((o_totalprice - low) / w) as bigint), 19) as bin, count(*) as n from orders, e group by 1),
    s as (select unnest(generate_series(0, 19)) as bin)
    select s.bin, round(low + s.bin * w, 4) as low, round(low + (s.bin + 1) * w, 4) as high, coalesce(n, 0) as n
    from s cross join e left join c on c.bin = s.bin""")
def _(t: Tables):
    bars = charts.histogram(t.orders, "o_totalprice", 20)
    return bars.select("bin", F.round("low", 4).alias("low"), F.round("high", 4).alias("high"), "n")


NULLABLE = ("fecha_iso", "monto", "precio", "cliente", "prioridad", "activo", "status")


@query("chart_null_pct", " union all ".join(
    f"select '{c}' as x, round(100.0 * count(*) filter ({c} is null) / count(*), 4) as value from dirty_orders" for c in NULLABLE))
def _(t: Tables):
    chart = {"id": "nulls_by_col", "type": "bar", "limit": 20, "encoding": {
        "x": {"field": "__column__"}, "y": {"field": "__null_pct__", "aggregate": "mean"}}}
    return drawn(t.dirty_orders.select(*NULLABLE), chart)


@query("null_pct_top5", "select \"column\", null_pct from (" + " union all ".join(
    f"select {i} as o, '{c}' as \"column\", round(100.0 * count(*) filter ({c} is null) / count(*), 2) as null_pct from dirty_orders"
    for i, c in enumerate(NULLABLE)) + ") order by null_pct desc, o limit 5")
def _(t: Tables):
    return missing_by_column(t.dirty_orders.select(*NULLABLE), 5).select("column", "null_pct")




@query("quality_summary", f"""
    select count(*) as rows, {len(NULLABLE)} as cols, round(({' + '.join(
        f'avg(case when {c} is null then 1.0 else 0.0 end)' for c in NULLABLE)}) / {len(NULLABLE)} * 100, 4) as missing_overall_pct,
    cast(0 as bigint) as dropped_duplicates, cast(0 as bigint) as outliers_count, cast(0 as double) as outliers_ratio
    from dirty_orders""")
def _(t: Tables):
    return quality_summary(t.dirty_orders.select(*NULLABLE)).withColumn(
        "missing_overall_pct", F.round("missing_overall_pct", 4))


KPIS = [{"title": "Filas", "op": "count_rows"}, {"title": "Suma", "op": "sum", "col": "monto"},
        {"title": "Promedio", "op": "mean", "col": "precio"}, {"title": "Clientes", "op": "nunique", "col": "cliente"},
        {"title": "Positivos", "op": "ratio_gt_zero", "col": "precio"}, {"title": "Pagados", "op": "ratio_true", "col": "pagado"},
        {"title": "Otro", "op": "median", "col": "precio"}]


KPI_SQL = f"""with k as (select count(*) as k0, sum({money_sql('monto')}) as k1, avg(precio) as k2, count(distinct cliente) as k3,
    100.0 * count(*) filter (precio > 0) / count(*) as k4,
    100.0 * count(*) filter (lower(pagado) in ('true', '1', 't', 'y', 'sí', 'si')) / count(*) as k5 from dirty_orders)"""


@query("kpi_all", KPI_SQL + " union all ".join(
    f" select {i} as ordinal, '{k['title']}' as title, round(cast(k{i} as double), 2) as value from k"
    for i, k in enumerate(KPIS[:6])))
def _(t: Tables):
    return kpi.kpi_values(t.dirty_orders, KPIS[:6]).select("ordinal", "title", F.round("value", 2).alias("value"))


def _es(sql, decimals):
    plain = f"format('{{:,.{decimals}f}}', cast({sql} as double))"
    return f"translate({plain}, ',.', '.,')"


@query("kpi_format", KPI_SQL + " union all ".join([
    f" select 0 as ordinal, {_es('k0', 0)} as text from k", f" select 1, {_es('k1', 2)} from k", f" select 2, {_es('k2', 2)} from k",
    f" select 3, {_es('k3', 0)} from k", " select 4, format('{:.2f}%', cast(k4 as double)) from k",
    " select 5, format('{:.2f}%', cast(k5 as double)) from k", " select 6, '—' from k"]))
def _(t: Tables):
    return kpi.kpi_values(t.dirty_orders, KPIS).select("ordinal", "text")


@query("filter_domain", """
    select 'o_orderdate' as field, 'date_range' as type, strftime(min(o_orderdate), '%Y-%m-%d') as low,
           strftime(max(o_orderdate), '%Y-%m-%d') as high, null as value, cast(null as bigint) as n from orders
    union all
    select 'o_custkey', 'categorical', null, null, cast(o_custkey as varchar), n from (
      select o_custkey, count(*) as n from orders group by 1 order by n desc, cast(o_custkey as varchar) limit 50)
    union all
    select 'o_orderstatus', 'categorical', null, null, o_orderstatus, count(*) from orders group by o_orderstatus""")
def _(t: Tables):
    asked = [{"field": "o_orderdate", "type": "date_range"}, {"field": "o_custkey", "type": "categorical", "max_values": 50},
             {"field": "o_orderstatus", "type": "categorical", "max_values": 50}]
    return filters.filter_domain(t.orders, asked).drop("rank")


@query("apply_filters", """
    select o_orderkey, o_orderstatus, o_totalprice from orders
    where o_orderdate >= timestamp '1996-01-01' and o_orderdate < timestamp '1998-07-01' and o_orderstatus in ('O', 'F')""")
def _(t: Tables):
    kept = filters.apply_filters(t.orders, {"o_orderdate": ("1996-01-01", "1998-06-30"), "o_orderstatus": ["O", "F"]})
    return kept.select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("currency_prefix", """
    select upper(moneda) as currency, case upper(moneda) when 'CLP' then '$' when 'USD' then 'USD ' else upper(moneda) || ' ' end
    as prefix, count(*) as n from dirty_lines group by 1, 2""")
def _(t: Tables):
    from limpid.functions import numbers
    code = F.col("moneda")
    return (t.dirty_lines.select(F.upper(code).alias("currency"), numbers.currency_prefix(code).alias("prefix"))
            .groupBy("currency", "prefix").agg(F.count(F.lit(1)).alias("n")))


@query("chart_prefix", """
    select 'mes' as chart_id, min(upper(c)) || ' ' as prefix from (select o_orderstatus as c from orders where o_orderstatus = 'O') having count(*) > 0
    union all select 'top', min(upper(c)) || ' ' from (select o_orderstatus as c from orders where o_orderstatus = 'O') having count(*) > 0""")
def _(t: Tables):
    from limpid.plans.dashboard import chart_prefixes
    open_orders = t.orders.where("o_orderstatus = 'O'").withColumnRenamed("o_orderstatus", "moneda")
    shown = [{**line("o_orderdate", "o_totalprice", "sum"), "id": "mes"},
             {"id": "top", "type": "bar", "encoding": {"x": {"field": "o_orderpriority"}, "y": {"field": "o_totalprice", "aggregate": "sum"}}},
             {"id": "n", "type": "bar", "encoding": {"x": {"field": "o_orderpriority"}, "y": {"field": "__row__", "aggregate": "count"}}}]
    spec = {"charts": shown, "dashboards": [{"charts": [c["id"] for c in shown]}]}
    return chart_prefixes(open_orders, spec)


@query("currency_single", """
    select case when count(distinct upper(o_orderstatus)) = 1 then max(upper(o_orderstatus)) end as currency,
    case when count(distinct upper(o_orderstatus)) = 1 then max(upper(o_orderstatus)) || ' ' else '' end as prefix from orders""")
def _(t: Tables):
    return kpi.single_currency(t.orders, "o_orderstatus")
