"""Roles, semantics, objectives, specs, checks, metadata features and models."""

from __future__ import annotations

import json
import re
from collections import Counter

from pyspark.sql import functions as F

from catalog import Tables, query
from catalog.dirt import VIEWS, auto_sql, date_sql, relaxed_sql
from limpid import vocab
from limpid.functions import text
from limpid.ml import features, models
from limpid.operators import guard, information
from limpid.operators.charts import run_chart
from limpid.operators.columns import tally
from limpid.plans import dashboard, objectives, roles, semantics, spec
from limpid.plans.run import run
from limpid.sources.headers import normalize_headers

TYPED = ("fecha", "fecha_iso", "monto", "prioridad", "pagado", "activo", "relleno", "status")
BOOLS = "('true','1','sí','si','false','0','no')"


def _type_sql(c, source="dirty_orders"):
    v = f"trim({c})"
    return f"""select '{c}' as "column", case when count({c}) = 0 then 'texto'
      when bool_and(lower({v}) in {BOOLS}) then 'bool'
      when avg(case when regexp_matches({v}, '[$€£]|^\\s*[A-Z]{{2,3}}\\s*\\d') then 1.0 when {c} is not null then 0.0 end) > 0.5 then 'moneda'
      when count({date_sql(c)}) > 0.8 * count({c}) then 'fecha'
      when count({relaxed_sql(v)}) > 0.8 * count({c}) then 'numérico' else 'texto' end as role from {source}"""


@query("infer_types", " union all ".join(_type_sql(c) for c in TYPED)
       + " union all select 'o_orderkey', 'numérico' union all select 'precio', 'numérico' union all select 'fecha_gap', 'fecha'")
def _(t: Tables):
    return roles.type_roles(t.dirty_orders.select(*TYPED, "o_orderkey", "precio", "fecha_gap")).select("column", "role")


@query("infer_types_lines", " union all ".join(_type_sql(c, "dirty_lines") for c in ("mixto", "descuento", "cantidad", "unit_price", "moneda")))
def _(t: Tables):
    return roles.type_roles(t.dirty_lines.select("mixto", "descuento", "cantidad", "unit_price", "moneda")).select("column", "role")


def _has(words, name="n"):
    return "(" + " or ".join(f"contains({name}, '{w}')" for w in words) + ")"


@query("infer_role_names", f"""
    with x as (select p_partkey, lower(trim(header)) as n from headers)
    select p_partkey, case when {_has(('fecha', 'date', 'fcha'))} then 'fecha' when {_has(('monto', 'importe', 'amount', 'total'))} then 'monto'
    when {_has(('moneda', 'currency'))} then 'moneda' when {_has(('id_', 'id-', 'id '))} or starts_with(n, 'id') then 'id'
    when {_has(('bool', 'flag', 'activo', 'enable'))} then 'bool'
    when {_has(('cat', 'tipo', 'segmento', 'grupo', 'clase'))} then 'categoría' end as role from x""")
def _(t: Tables):
    return t.headers.select("p_partkey", roles.profile_name_role(F.col("header")).alias("role"))


def _profile_role_sql(c):
    return f"""select '{c}' as "column", coalesce(
      case when {_has(('fecha', 'date', 'fcha'))} then 'fecha' when {_has(('monto', 'importe', 'amount', 'total'))} then 'monto'
        when {_has(('moneda', 'currency'))} then 'moneda' when {_has(('id_', 'id-', 'id '))} or starts_with(n, 'id') then 'id'
        when {_has(('bool', 'flag', 'activo', 'enable'))} then 'bool' when {_has(('cat', 'tipo', 'segmento', 'grupo', 'clase'))} then 'categoría' end,
      case when known = 0 then 'texto' when dates >= 0.7 * known then 'fecha' when numbers >= 0.8 * known then 'numérico'
        when bools >= 0.9 * known then 'bool' else 'texto' end) as role
      from (select '{c}' as n, count(v) as known, count({date_sql('v')}) as dates, count({relaxed_sql('trim(v)')}) as numbers,
        count(case when lower(trim(v)) in {BOOLS} then 1 end) as bools from (select {c}::varchar as v from dirty_orders))"""


@query("infer_role_values", " union all ".join(map(_profile_role_sql, VIEWS["dirty_orders"][1])))
def _(t: Tables):
    found = roles.profile_roles(t.dirty_orders)
    return t.spark.createDataFrame(list(found.items()), "column string, role string")


@query("name_roles", f"""
    with x as (select p_partkey, lower(trim(header)) as n from headers)
    select p_partkey, case when {_has(vocab.BUSINESS_NAME_RULES[0][1])} then 'fecha' when {_has(vocab.BUSINESS_NAME_RULES[1][1])} then 'métrica_monetaria'
    when {_has(vocab.BUSINESS_NAME_RULES[2][1] + vocab.BUSINESS_NAME_RULES[3][1])} then 'métrica_numérica'
    when {_has(vocab.BUSINESS_NAME_RULES[4][1])} then 'id' else 'categórica' end as role from x""")
def _(t: Tables):
    return t.headers.select("p_partkey", roles.business_name_role(F.col("header")).alias("role"))


def _domain(rules):
    return "case " + " ".join(f"when {_has(words, 'h')} then '{d}'" for d, words in rules) + " else 'generic' end"


@query("domain_rules", f"""
    with x as (select tabla, lower(string_agg(header, ' ' order by p_partkey)) as h from headers group by 1)
    select 'table ' || tabla as name, {_domain(vocab.DOMAIN_RULES)} as domain, {_domain(vocab.BUSINESS_DOMAIN_RULES)} as business_domain from x
    union all select 'column ' || p_partkey, {_domain(vocab.DOMAIN_RULES)}, {_domain(vocab.BUSINESS_DOMAIN_RULES)}
    from (select p_partkey, lower(header) as h from headers)""")
def _(t: Tables):
    names = F.array_sort(F.collect_list(F.struct("p_partkey", "header")))["header"]
    # a table has 20 column names here, so its list stays small however many tables there are
    tables = t.headers.groupBy("tabla").agg(F.array_join(names, " ").alias("h"))
    each = t.headers.select(F.concat(F.lit("column "), F.col("p_partkey")).alias("name"), F.col("header").alias("h"))
    named = tables.select(F.concat(F.lit("table "), F.col("tabla")).alias("name"), "h")
    return named.unionByName(each).select("name", roles.domain(F.col("h")).alias("domain"),
                                           roles.business_domain(F.col("h")).alias("business_domain"))


def _grams(words):
    return Counter(words + [f"{a} {b}" for a, b in zip(words, words[1:])])


TERMS = {r: _grams(re.findall(r"\b\w\w+\b", " ".join(w).lower())) for r, w in vocab.ROLE_TERMS.items()}
TERM_ROWS = ", ".join(f"('{r}', '{g}', {n}.0)" for r, grams in TERMS.items() for g, n in grams.items())


@query("name_similarity", rf"""
    with terms as (select * from (values {TERM_ROWS}) as v(role, gram, tf)),
    docs as (select gram, count(*) as n from terms group by 1),
    w as (select distinct header, regexp_extract_all(lower(header), '\b\w\w+\b') as words from headers),
    g as (select header, unnest(words) as gram from w union all
          select header, words[i] || ' ' || words[i + 1] from (select header, words, unnest(range(1, len(words))) as i from w)),
    tfs as (select header, gram, count(*) * 1.0 as ntf from g group by 1, 2),
    wn as (select tfs.*, ln(9.0 / (coalesce(docs.n, 0) + 2)) + 1 as idf from tfs left join docs using (gram)),
    names as (select header, sqrt(sum(power(ntf * idf, 2))) as norm from wn group by 1),
    cells as (select h.header, t.role, t.gram, t.tf, wn.ntf,
                coalesce(wn.idf, ln(9.0 / (docs.n + 1)) + 1) as idf from (select distinct header from headers) h cross join terms t
              join docs on docs.gram = t.gram left join wn on wn.header = h.header and wn.gram = t.gram),
    s as (select header, role, sum(coalesce(ntf, 0) * tf * idf * idf) as dot, sqrt(sum(power(tf * idf, 2))) as dnorm from cells group by 1, 2)
    select s.header as "column", s.role, round(coalesce(dot / dnorm / norm, 0), 6) as similarity from s left join names using (header)""")
def _(t: Tables):
    found = semantics.name_similarity(t.headers, "header")
    return found.withColumn("similarity", F.round("similarity", 6))


@query("infer_semantics")
def _(t: Tables):
    s = semantics.infer_semantics(t.dirty_orders)
    rows = [(c, r, s.confidence[c], c == s.primary_date, c == s.primary_metric, c in s.dims) for c, r in s.roles.items()]
    return t.spark.createDataFrame(rows, "column string, role string, confidence double, date boolean, metric boolean, dim boolean")


EVIDENCE = ("fecha", "monto", "pagado", "prioridad")


@query("semantic_evidence", " union all ".join(f"""
    select '{c}' as "column", count(*) as rows, count({c}) as non_null,
    count({date_sql(c, ('%Y-%m-%d', '%Y/%m/%d', '%d/%m/%Y'))}) as days, round(count({auto_sql(c)}) * 1.0 / count({c}), 6) as numbers,
    round(avg(case when regexp_matches({c}, '^[A-Za-z0-9\\-_\\/\\.]{{4,}}$') then 1.0 when {c} is not null then 0.0 end), 6) as codes
    from dirty_orders""" for c in EVIDENCE))
def _(t: Tables):
    from limpid.operators.columns import column_table
    table = column_table(t.dirty_orders, semantics.VALUE_EVIDENCE, EVIDENCE)
    return table.select("column", "rows", "non_null", "days", F.round("numbers", 6).alias("numbers"), F.round("codes", 6).alias("codes"))


# ---- objectives -------------------------------------------------------------------------------

SEMANTIC_ROLES = {"o_orderkey": "id", "o_custkey": "id", "o_orderstatus": "categórica", "o_totalprice": "métrica_monetaria",
                  "o_orderdate": "fecha", "o_orderpriority": "categórica"}


LINE_ROLES = {"l_orderkey": "id", "l_shipdate": "fecha", "l_extendedprice": "métrica_monetaria", "l_quantity": "métrica_numérica",
              "l_returnflag": "categórica", "l_linestatus": "categórica"}


@query("choose_objectives", """
    select 'date' as objective, 'l_shipdate' as "column" union all
    select 'metric', case when count(distinct l_extendedprice) < 0.98 * count(*) then 'l_extendedprice' else 'l_quantity' end from lineitem
    union all select 'dim', 'l_returnflag' from lineitem having count(distinct l_returnflag) between 2 and 50
    union all select 'dim', 'l_linestatus' from lineitem having count(distinct l_linestatus) between 2 and 50""")
def _(t: Tables):
    date, metric, dims, _ = objectives.choose_objectives(t.lineitem.select(*LINE_ROLES), LINE_ROLES)
    rows = [("date", date), ("metric", metric), *(("dim", d) for d in dims)]
    return t.spark.createDataFrame(rows, "objective string, column string")


@query("choose_objectives_orders", """
    select 'date' as objective, 'o_orderdate' as "column" union all
    select 'metric', case when count(distinct o_totalprice) < 0.98 * count(*) then 'o_totalprice' end from orders union all
    select 'dim', 'o_orderstatus' from orders having count(distinct o_orderstatus) between 2 and 50 union all
    select 'dim', 'o_orderpriority' from orders having count(distinct o_orderpriority) between 2 and 50""")
def _(t: Tables):
    date, metric, dims, _ = objectives.choose_objectives(t.orders, SEMANTIC_ROLES)
    rows = [("date", date), ("metric", metric), *(("dim", d) for d in dims)]
    return t.spark.createDataFrame(rows, "objective string, column string")


@query("dim_score", " union all ".join(f"""
    select '{c}' as "column", round(entropy({e}), 6) as entropy, round((select var_samp(m) from (select avg(precio) as m from dirty_orders group by {c}))
    / (1 + var_samp(precio)), 6) as relation from dirty_orders"""
                                for c, e in (("status", "status"), ("prioridad", "coalesce(prioridad, '~')"), ("cliente", "coalesce(cliente, -1)"))))
def _(t: Tables):
    found = objectives.dimension_scores(t.dirty_orders, ["status", "prioridad", "cliente"], "precio")
    return found.select("column", F.round("entropy", 6).alias("entropy"), F.round("relation", 6).alias("relation"))


def _psi(n):
    z = f"({n} + 6.0)"
    back = " + ".join(f"1.0 / ({n} + {i})" for i in range(6))
    return f"(ln({z}) - 1 / (2 * {z}) - 1 / (12 * {z}^2) + 1 / (120 * {z}^4) - 1 / (252 * {z}^6) - ({back}))"


def _information_sql(table, dims, metric):
    beside = ", ".join(f"abs(x - {f}(x, {i}) over w)" for f in ("lag", "lead") for i in (1, 2, 3))
    rows = " union all ".join(f"select '{d}' as c, {d}::varchar as d, {metric}::double as x from {table}" for d in dims)
    return f"""
    with r as (select row_number() over () as id, c, d, x, count(*) over (partition by c, d) as size from ({rows}) where x is not null),
    k as (select c, x, size, least(3, size - 1) as near, list_sort([{beside}], 'ASC', 'NULLS LAST') as far
      from r where size > 1 window w as (partition by c, d order by x, id)),
    t as (select c, x, size, near, x + far[near] as hi, x - far[near] as lo from k),
    v as (select c, x, sum(count(*)) over (partition by c order by x) as upto from t group by c, x),
    m as (select t.*, abs(coalesce(a.upto, 0) - coalesce(b.upto, 0)) as within
      from t asof left join v a on t.c = a.c and t.hi > a.x asof left join v b on t.c = b.c and t.lo >= b.x)
    select c as "column", count(*) as rows,
      round(greatest(0, {_psi('count(*)')} + avg({_psi('near')} - {_psi('size')} - {_psi('within')})), 6) as information from m group by c"""


def _information(df, dims, metric):
    found = information.mutual_information(df, dims, metric)
    return found.select("column", "rows", F.round("information", 6).alias("information"))


@query("mutual_info", _information_sql("orders", ("o_orderstatus", "o_orderpriority", "year(o_orderdate)"), "o_totalprice").replace("'year(o_orderdate)'", "'year'"))
def _(t: Tables):
    return _information(t.orders.withColumn("year", F.year("o_orderdate")), ["o_orderstatus", "o_orderpriority", "year"], "o_totalprice")


@query("mutual_info_ties", _information_sql("lineitem", ("l_returnflag", "l_linestatus", "l_discount"), "l_quantity"))
def _(t: Tables):
    return _information(t.lineitem, ["l_returnflag", "l_linestatus", "l_discount"], "l_quantity")


@query("mutual_info_gaps", _information_sql("dirty_orders", ("status", "prioridad", "cliente"), "precio"))
def _(t: Tables):
    return _information(t.dirty_orders, ["status", "prioridad", "cliente"], "precio")


@query("amount_discovery", f"""
    select l_orderkey, l_linenumber, round({auto_sql('unit_price')} * {auto_sql('cantidad')}, 4) as amount from dirty_lines""")
def _(t: Tables):
    df = t.dirty_lines.select("l_orderkey", "l_linenumber", "cantidad", "unit_price")
    table, name, _ = objectives.discover_amount(df, {})
    return table.select("l_orderkey", "l_linenumber", F.round(F.col(name), 4).alias("amount"))


@query("pick_dim", """
    with n as (select count(distinct o_orderstatus) as s, count(distinct o_custkey) as c, count(distinct o_orderpriority) as p from orders)
    select 'status' as kind, case when s between 2 and 20 then 'o_orderstatus' end as "column" from n union all
    select 'tight', case when p between 2 and 3 then 'o_orderpriority' when s between 2 and 3 then 'o_orderstatus' else 'o_orderkey' end from n""")
def _(t: Tables):
    from limpid.operators.columns import cardinalities
    counted = cardinalities(t.orders)
    rows = [("status", objectives.pick_dimension(t.orders.columns, "status", 20, counted)),
            ("tight", objectives.pick_dimension(["o_orderpriority", "o_orderstatus"], "^o_order", 3, counted))]
    return t.spark.createDataFrame(rows, "kind string, column string")


# ---- specs ------------------------------------------------------------------------------------

def _as_rows(t: Tables, found: dict):
    rows = [("kpi", k["title"], k["op"]) for k in found["kpis"]]
    rows += [("filter", f["field"], f["type"]) for f in found["filters"]]
    rows += [("chart", c["id"], json.dumps(c["encoding"], ensure_ascii=False)) for c in found["charts"]]
    return t.spark.createDataFrame(rows, "part string, name string, detail string")


def _orders_roles(t: Tables):
    return roles.infer_types(t.dirty_orders)


@query("spec_auto")
def _(t: Tables):
    return _as_rows(t, spec.auto_spec(t.dirty_orders, _orders_roles(t), "orders")[1])


@query("spec_business")
def _(t: Tables):
    return _as_rows(t, spec.business_spec(t.dirty_orders, None, "orders")[1])


@query("spec_objective")
def _(t: Tables):
    return _as_rows(t, spec.objective_spec(t.orders, SEMANTIC_ROLES, "orders"))


SAFE_NULLS = ("prioridad", "precio", "fecha_iso")


@query("spec_safe", """
    select 'safe_count' as chart_id, prioridad as x, cast(count(*) as double) as value from dirty_orders group by prioridad
    union all """ + " union all ".join(
        f"select 'safe_nulls', '{c}', round(count(*) filter ({c} is null) * 100.0 / count(*), 4) from dirty_orders" for c in SAFE_NULLS))
def _(t: Tables):
    df = t.dirty_orders.select(*SAFE_NULLS)
    found = dashboard.dashboard_data(df, spec.safe_spec(df, {}, "orders"))
    return found.select("chart_id", "x", F.round("value", 4).alias("value"))


@query("run_dashboard", """
    select 'ts_month' as chart_id, strftime(o_orderdate, '%Y-%m') as x, cast(null as varchar) as y, round(sum(o_totalprice), 2) as value
    from orders group by 2
    union all select 'nulls_by_col', c, null, 0.0 from (values ('o_orderkey'), ('o_custkey'), ('o_orderstatus'), ('o_totalprice'),
      ('o_orderdate'), ('o_orderpriority')) as v(c)
    union all select 'top_dim', o_orderstatus, null, round(sum(o_totalprice), 2) from orders group by o_orderstatus
    union all select 'heatmap_month_dim', x, y, round(coalesce(v, 0), 2) from (
      select xs.x, ys.y, v from (select distinct strftime(o_orderdate, '%Y-%m') as x from orders) xs
      cross join (select distinct o_orderpriority as y from orders) ys
      left join (select strftime(o_orderdate, '%Y-%m') as x, o_orderpriority as y, sum(o_totalprice) as v from orders group by 1, 2) c
      on c.x = xs.x and c.y = ys.y)""")
def _(t: Tables):
    found = {"o_orderdate": "fecha", "o_totalprice": "moneda", "o_orderstatus": "texto", "o_orderpriority": "texto"}
    table, chosen = spec.auto_spec(t.orders, found, "orders")
    return dashboard.dashboard_data(table, chosen).select("chart_id", "x", "y", F.round("value", 2).alias("value"))


@query("dashboard_kpis", """
    select 0 as ordinal, 'Filas' as title, cast(count(*) as double) as value from orders union all
    select 1, 'Suma de o_totalprice', round(sum(o_totalprice), 2) from orders union all
    select 2, 'Promedio de o_totalprice', round(avg(o_totalprice), 2) from orders""")
def _(t: Tables):
    table, chosen = spec.auto_spec(t.orders, {"o_orderdate": "fecha", "o_totalprice": "moneda"}, "orders")
    return dashboard.dashboard_kpis(table, chosen).select("ordinal", "title", F.round("value", 2).alias("value"))


@query("full_run")
def _(t: Tables):
    df = t.dirty_orders.select("o_orderkey", "fecha", "monto", "precio", "prioridad", "pagado", "status", "relleno")
    rules = {"impute": {"default": {"numeric": "mean", "text": "mode"}}, "dedup": {"keys": ["o_orderkey"]}}
    return run(df, rules, "orders", "o_orderkey").charts


# ---- checks -----------------------------------------------------------------------------------

CHECKED = [
    {"id": "keys", "type": "bar", "encoding": {"x": {"field": "o_orderkey"}, "y": {"field": "precio", "aggregate": "sum"}}},
    {"id": "flags", "type": "pie", "encoding": {"category": {"field": "activo"}, "value": {"field": "precio", "aggregate": "sum"}}},
    {"id": "line", "type": "line", "encoding": {"x": {"field": "status", "timeUnit": "month"}, "y": {"field": "precio"}}},
    {"id": "clients", "type": "bar", "encoding": {"x": {"field": "cliente"}, "y": {"field": "precio", "aggregate": "sum"}}},
    {"id": "good", "type": "bar", "encoding": {"x": {"field": "status"}, "y": {"field": "precio", "aggregate": "sum"}}},
    {"id": "nulls", "type": "bar", "encoding": {"x": {"field": "__column__"}, "y": {"field": "__null_pct__"}}},
]


@query("guard_chart", """
    with s as (select count(*) as n, count(distinct o_orderkey) as keys, count(distinct cliente) + max(case when cliente is null then 1 else 0 end) as clients,
      count(activo) * 1.0 / count(*) as cover, sum(precio) as total, sum(case when cliente is not null then precio else 0 end) as part from dirty_orders)
    select 'keys' as chart_id, cast(100 - case when keys > 50 then 10 else 0 end - case when keys >= 0.98 * n then 20 else 0 end as double) as score, 'too_many_categories' as code, 'warn' as severity from s where keys > 50
    union all select 'keys', cast(100 - case when keys > 50 then 10 else 0 end - case when keys >= 0.98 * n then 20 else 0 end as double), 'id_dim', 'error' from s where keys >= 0.98 * n
    union all select 'flags', cast(95 as double), 'bool_dim', 'warn' from s
    union all select 'line', cast(75 as double), 'line_without_date', 'error' from s
    union all select 'clients', cast(80 as double), 'too_many_categories', 'warn' from s where clients > 50
    union all select 'clients', cast(80 as double), 'sum_mismatch', 'warn' from s where abs(part - total) / total > 0.02
    union all select 'good', cast(100 as double), null, null from s union all select 'nulls', cast(100 as double), null, null from s""")
def _(t: Tables):
    return guard.validate_charts(t.dirty_orders, CHECKED, {"fecha": "fecha"}).select("chart_id", "score", "code", "severity")


@query("guard_dashboard", """
    with s as (select count(*) as n, count(distinct o_orderkey) as keys, count(distinct cliente) as clients, sum(precio) as total,
      sum(case when cliente is not null then precio else 0 end) as part from dirty_orders)
    select (100.0 - case when keys > 50 then 10 else 0 end - case when keys >= 0.98 * n then 20 else 0 end + 95 + 75
      + 100 - case when clients >= 50 then 10 else 0 end - case when abs(part - total) / total > 0.02 then 10 else 0 end) / 4.0 as score,
    true as blocking from s""")
def _(t: Tables):
    shown = {"charts": CHECKED, "dashboards": [{"charts": [c["id"] for c in CHECKED]}]}
    health = guard.validate_dashboard(t.dirty_orders, shown, {"fecha": "fecha"})
    return t.spark.createDataFrame([(health["score"], health["blocking"])], "score double, blocking boolean")


@query("guard_strict", """
    select 'safe_count' as chart_id, prioridad as x, cast(count(*) as double) as value from dirty_orders group by prioridad order by 3 desc limit 12""")
def _(t: Tables):
    df = t.dirty_orders.select("prioridad", "o_orderkey", "precio")
    bad = {"charts": [CHECKED[0]], "dashboards": [{"charts": ["keys"]}]}
    health = guard.validate_dashboard(df, bad, {})
    shown = spec.safe_spec(df, {}) if health["blocking"] else bad
    return run_chart(df, shown["charts"][0]).select("chart_id", "x", "value")


# ---- headers and metadata features ------------------------------------------------------------

@query("header_slug", r"""
    select p_partkey, trim(regexp_replace(lower(trim(header)), '[^a-z0-9]+', '_', 'g'), '_') as slug from headers""")
def _(t: Tables):
    return t.headers.select("p_partkey", text.slug(F.col("header")).alias("slug"))


@query("header_slug_semantic", r"""
    select p_partkey, coalesce(nullif(substr(regexp_replace(lower(trim(regexp_replace(header, '[^\w\s\-.%/]', ' ', 'g'))), '\s+', '_', 'g'), 1, 80), ''), 'col')
    as slug from headers""")
def _(t: Tables):
    return t.headers.select("p_partkey", text.semantic_slug(F.col("header")).alias("slug"))


@query("header_rename", "select c_custkey as customer_key, c_name as name, c_acctbal as saldo_total from customer")
def _(t: Tables):
    return normalize_headers(t.customer.selectExpr("c_custkey as `Customer  Key `", "c_name as `Name`", "c_acctbal as `Saldo (TOTAL)`"))


@query("name_features", r"""
    select p_partkey, length(header) as name_len, cast(contains(lower(header), 'id') as int) as has_id,
    cast(contains(lower(header), 'pct') or contains(header, '%') or contains(lower(header), 'porc') or contains(lower(header), 'percent') as int) as has_pct,
    round(length(regexp_replace(header, '[^0-9]', '', 'g')) * 1.0 / length(header), 6) as digits_ratio,
    length(regexp_replace(header, '[^_]', '', 'g')) as underscores from headers""")
def _(t: Tables):
    f = features.name_features(F.col("header"))
    return t.headers.select("p_partkey", f["name_len"].cast("long").alias("name_len"), f["has_id"].alias("has_id"), f["has_pct"].alias("has_pct"),
                            F.round(f["digits_ratio"], 6).alias("digits_ratio"), f["underscores"].cast("long").alias("underscores"))


CUSTOMER = (("c_custkey", 1), ("c_name", 0), ("c_mktsegment", 0))


@query("column_features", " union all ".join(f"""
    select '{c}' as "column", round(count(distinct {c}) * 1.0 / count({c}), 6) as nunique_ratio, cast({n} as double) as is_num_ratio,
    round(avg(length(cast({c} as varchar))), 6) as mean_len, {len(c)} as name_len from customer""" for c, n in CUSTOMER))
def _(t: Tables):
    found = features.column_features(t.customer.select(*[c for c, _ in CUSTOMER]), "customer")
    return found.select("column", F.round("nunique_ratio", 6).alias("nunique_ratio"), "is_num_ratio", F.round("mean_len", 6).alias("mean_len"), "name_len")


NAMED = f"""select p_brand, p_partkey, header, case when {_has(vocab.BUSINESS_NAME_RULES[0][1], 'lower(trim(header))')} then 'fecha'
    when {_has(vocab.BUSINESS_NAME_RULES[1][1], 'lower(trim(header))')} then 'métrica_monetaria'
    when {_has(vocab.BUSINESS_NAME_RULES[2][1] + vocab.BUSINESS_NAME_RULES[3][1], 'lower(trim(header))')} then 'métrica_numérica'
    when {_has(vocab.BUSINESS_NAME_RULES[4][1], 'lower(trim(header))')} then 'id' else 'categórica' end as role from headers"""


@query("role_histogram", "select p_brand, " + ", ".join(
    f"count(*) filter (role = '{r}') as \"role_count_{r}\"" for r in vocab.ROLE_LABELS) + f" from ({NAMED}) group by 1")
def _(t: Tables):
    found = t.headers.select("p_brand", roles.business_name_role(F.col("header")).alias("role"))
    return features.role_histogram(found, "p_brand")


@query("header_text", """
    select tabla, string_agg(lower(header), ' | ' order by p_partkey) as header from headers group by 1""")
def _(t: Tables):
    return features.header_text(t.headers, "tabla", "header", "p_partkey")


@query("weak_labels", f"""
    with x as ({NAMED}), s as (select p_brand, min(header) filter (role = 'fecha') as d, min(header) filter (role = 'métrica_monetaria') as m,
      count(*) filter (role = 'categórica') as k from x where p_partkey >= 0 group by 1)
    select p_brand, case when d is not null and m is not null then 'line_time' when m is not null and k > 0 then 'bar_top'
      when m is null then 'hist' else 'bar_top' end as label from s""")
def _(t: Tables):
    found = t.headers.select("p_brand", "header", roles.business_name_role(F.col("header")).alias("role"))
    chosen = found.groupBy("p_brand").agg(
        F.min(F.when(F.col("role") == "fecha", F.col("header"))).alias("d"),
        F.min(F.when(F.col("role") == "métrica_monetaria", F.col("header"))).alias("m"),
        F.count_if(F.col("role") == "categórica").alias("k"))
    return chosen.select("p_brand", features.weak_label(F.col("d"), F.col("m"), F.col("k")).alias("label"))


@query("chart_types", """
    select 0 as rank, 'line_time' as type from lineitem having count(l_shipdate) > 0 union all
    select 1, 'bar_top' from lineitem having count(*) > 0""")
def _(t: Tables):
    date, metric, _, _ = objectives.choose_objectives(t.lineitem.select(*LINE_ROLES), LINE_ROLES)
    return t.spark.createDataFrame(list(enumerate(spec.chart_types(date, metric))), "rank int, type string")


TRAINING = ("customer", "orders", "part", "lineitem", "events", "labels")


def _training(t: Tables):
    from functools import reduce
    parts = []
    for name in TRAINING:
        table = getattr(t, name)
        tallied = tally(table, staged=True)
        found = semantics.infer_semantics(table, tallied=tallied).roles
        labels = t.spark.createDataFrame(list(found.items()), "column string, role string")
        parts.append(features.column_features(table, name, tallied).join(labels, "column"))
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("role_classifier")
def _(t: Tables):
    data = _training(t).cache()
    model, _ = models.train_roles(data)
    return models.predict_roles(model, data).select("dataset", "column", "role", "predicted", "confidence")


@query("domain_classifier")
def _(t: Tables):
    found = t.headers.select(F.col("tabla").alias("dataset"), "p_partkey", "header", roles.business_name_role(F.col("header")).alias("role"))
    histogram = features.role_histogram(found)
    headers = features.header_text(found, "dataset", "header", "p_partkey")
    dated = F.col("role_count_fecha") - F.col("role_count_id")
    domains = histogram.select("dataset", F.when(dated > 0, "sales").when(dated < 0, "hr").otherwise("inventory").alias("domain"))
    data = models.domain_text(headers, histogram).join(domains, "dataset").cache()
    return models.predict_domain(models.train_domain(data), data).select("dataset", "domain", "predicted")


@query("chart_recommender")
def _(t: Tables):
    schemas = {name: semantics.infer_semantics(getattr(t, name)) for name in TRAINING}
    data = features.schema_table(t.spark, schemas).cache()
    return models.rank_charts(models.train_charts(data), data)
