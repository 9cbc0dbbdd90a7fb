"""Queries over proposals: budgets, money, heatmaps, schedules, templates, widths."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import color as C
from ..functions import money as M
from ..operators import proposals as P
from ..operators import widths as W
from .base import read

TEMPLATE = """{{?segment}}Segment {{segment}}: {{/?}}Offer for {{name}}{{^segment}} (no segment){{/^}}, balance {{money.balance}}

{{@budget}}

{{?missing}}never{{/?}}{{section:terms}}"""


def _team(spark, d):
    li = read(spark, d, "lineitem")
    return li.select(F.col("l_suppkey").alias("prop_id"), F.col("l_linenumber").alias("role_ix"), F.concat(F.lit("role "), F.col("l_linenumber").cast("string")).alias("role"), (F.col("l_linenumber") * 4550).cast("long").alias("rate_cents"), F.month("l_shipdate").alias("week_ix"), F.col("l_quantity").cast("long").alias("hours"))


def q04_budget(spark, d):
    return P.budget_table(_team(spark, d), ["prop_id"]).select("prop_id", "role_ix", "role", "hours", "rate_cents", "cents", "amount")


def q04b_covers(spark, d):
    claims = read(spark, d, "supplier").select(F.col("s_suppkey").alias("prop_id"), F.lit("all").alias("item"), F.lit("budget").alias("covers"), F.lit(100_000).cast("long").alias("price_cents"))
    return P.covers_check(claims, _team(spark, d), ["prop_id"])


def q05_money(spark, d):
    return read(spark, d, "orders").select("o_orderkey", M.format_money(M.to_cents("o_totalprice")).alias("amount"))


def q06_cents(spark, d):
    a = read(spark, d, "customer").select(F.lit("c").alias("src"), F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("v"))
    b = read(spark, d, "lineitem").select(F.lit("l").alias("src"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("key"), (F.col("l_extendedprice") * F.col("l_discount")).alias("v"))
    return a.unionByName(b).select("src", "key", M.to_cents("v").alias("cents"), M.cents_error("v").alias("why"))


def _matrix(spark, d):
    e = read(spark, d, "events")
    return e.select(F.year("ts").alias("year"), F.col("event_type").alias("label"), F.floor((F.dayofyear("ts") - 1) / 7).cast("int").alias("week_ix")).groupBy("year", "label", "week_ix").agg(F.count("*").alias("value"))


def q07_heatmap(spark, d):
    return P.heatmap(_matrix(spark, d), ["year"], "numbers").select("year", "label", "week", "mark")


def q08_steps(spark, d):
    return P.heatmap(_matrix(spark, d), ["year"], "scale").select("year", "label", "week", "value", "mark")


def q09_marks(spark, d):
    return P.heatmap(_matrix(spark, d), ["year"], "marks").select("year", "label", "week", "mark")


def q10_schedule(spark, d):
    e = read(spark, d, "events").select(F.col("event_id").alias("prop_id"), F.lit(0).alias("role_ix"), F.col("event_type").alias("role"), F.pmod("user_id", F.lit(120)).cast("int").alias("week_ix"), F.pmod("event_id", F.lit(41)).alias("hours"))
    return P.schedule(e, ["prop_id"]).select("prop_id", "role", "week", "label")


def _cells(spark, d):
    def cells(name, key, cols):
        t = read(spark, d, name)
        body = t.select(F.lit(name).alias("name"), F.col(key).cast("long").alias("row_ix"), F.posexplode(F.array(*[F.col(c).cast("string") for c in cols])).alias("col_ix", "text"))
        head = spark.createDataFrame([(name, -1, k, c if name == "part" else " ") for k, c in enumerate(cols)], "name string, row_ix long, col_ix int, text string")
        return body.unionByName(head)

    return cells("customer", "c_custkey", ["c_name", "c_mktsegment"]).unionByName(cells("part", "p_partkey", ["p_name", "p_brand", "p_type"]))


def q11_demand(spark, d):
    return W.demands(_cells(spark, d), ["name"]).select("name", "col_ix", "demand")


def q12_longest(spark, d):
    return W.demands(_cells(spark, d), ["name"]).select("name", "col_ix", F.col("longest").cast("long").alias("longest"), "blank_head")


def q13_widths(spark, d):
    return W.column_widths(_cells(spark, d), ["name"], 9978)


def q13b_table_widths(spark, d):
    """A table for each customer: their orders' keys, states, priorities and remarks of very different lengths."""
    o = read(spark, d, "orders").select(F.col("o_custkey").alias("name"), F.col("o_orderkey").alias("row_ix"), F.array(F.col("o_orderkey").cast("string"), F.col("o_orderstatus"), F.col("o_orderpriority"), F.repeat(F.lit("remark "), (F.col("o_orderkey") % 23).cast("int")), F.repeat(F.lit("x"), (F.col("o_custkey") % 31).cast("int"))).alias("texts"))
    head = o.select("name").distinct().select("name", F.lit(-1).cast("long").alias("row_ix"), F.array(*[F.when(F.col("name") % 4 > 0, x).otherwise("") for x in ("order", "s", "priority", "remarks", "note")]).alias("texts"))
    cells = o.withColumn("row_ix", F.col("row_ix").cast("long")).unionByName(head).select("name", "row_ix", F.posexplode("texts").alias("col_ix", "text"))
    return W.column_widths(cells, ["name"], 7200)


def q14_fits(spark, d):
    p = read(spark, d, "part").select("p_size").distinct()
    return p.select("p_size", W.column_width("p_size", 10.0).alias("width"), W.fits("p_size", F.lit(9978), 10.0).alias("fits"))


def q47_template(spark, d):
    c = read(spark, d, "customer")
    fields = {"name": F.col("c_name"), "segment": F.when(F.col("c_custkey") % 3 > 0, F.col("c_mktsegment")), "money.balance": M.format_money(F.floor(F.col("c_acctbal") * 100 + 0.5)), "sections.terms": F.lit("Terms.")}
    return c.select("c_custkey", P.fill_template(P.parse_template(TEMPLATE), fields).alias("md"))


def q51_colors(spark, d):
    p = read(spark, d, "part").select(F.concat(F.lit("#"), F.lpad(F.hex(F.pmod(F.col("p_partkey") * 7919, F.lit(16777216))), 6, "0")).alias("color")).distinct()
    steps = p.withColumn("t", F.explode(F.lit(list(C.SCALE_STEPS))))
    fill = C.mix_to_white("color", F.col("t"))
    return steps.select("color", "t", fill.alias("fill"), C.readable_on(fill, F.lit("#1A1A1A")).alias("ink"))


QUERIES = {f.__name__: f for f in (q04_budget, q04b_covers, q05_money, q06_cents, q07_heatmap, q08_steps, q09_marks, q10_schedule, q11_demand, q12_longest, q13_widths, q13b_table_widths, q14_fits, q47_template, q51_colors)}


def _money(c: str) -> str:
    g = f"replace(format('{{:,}}', CAST(floor(abs({c}) / 100.0) AS BIGINT)), ',', chr(160))"
    return f"(CASE WHEN {c} < 0 THEN '-' ELSE '' END || '€' || chr(160) || {g} || ',' || lpad(CAST(abs({c}) % 100 AS VARCHAR), 2, '0'))"


_TEAM = "team AS (SELECT l_suppkey AS prop_id, l_linenumber AS role_ix, 'role ' || l_linenumber AS role, CAST(l_linenumber * 4550 AS BIGINT) AS rate_cents, CAST(l_quantity AS BIGINT) AS hours FROM lineitem)"
_ROLES = f"{_TEAM}, roles AS (SELECT prop_id, role_ix, role, CAST(sum(hours) AS BIGINT) AS hours, rate_cents, CAST(sum(hours) * rate_cents AS BIGINT) AS cents FROM team GROUP BY prop_id, role_ix, role, rate_cents)"
_MATRIX = "m AS (SELECT CAST(year(ts) AS INTEGER) AS year, event_type AS label, CAST(floor((dayofyear(ts) - 1) / 7.0) AS INTEGER) AS w, count(*) AS value FROM events GROUP BY ALL), x AS (SELECT *, max(value) OVER (PARTITION BY year) AS most, 'W' || CASE WHEN w + 1 < 10 THEN '0' ELSE '' END || (w + 1) AS week FROM m)"
_WHY = "CASE WHEN v < 0 THEN 'negative' WHEN abs(v * 100 - floor(v * 100 + 0.5)) > 1e-6 THEN 'more than two decimals' END"
_CELLS = """cells AS (SELECT 'customer' AS name, c_custkey AS row_ix, unnest([0, 1]) AS col_ix, unnest([c_name, c_mktsegment]) AS text FROM customer
 UNION ALL SELECT 'part', p_partkey, unnest([0, 1, 2]), unnest([p_name, p_brand, p_type]) FROM part
 UNION ALL SELECT 'customer', -1, unnest([0, 1]), ' ' UNION ALL SELECT 'part', -1, unnest([0, 1, 2]), unnest(['p_name', 'p_brand', 'p_type']))"""
_WIDE = lambda chars: f"floor((12 + {chars} * 10.0::DOUBLE * 0.55::DOUBLE) * 20 + 0.5)"
_MIX = lambda k: f"lpad(upper(to_hex(CAST(floor(CAST(('0x' || substr(color, {2 + 2 * k}, 2)) AS INTEGER) * t + 255 * (1 - t) + 0.5) AS BIGINT))), 2, '0')"
_LIN = lambda e: f"(CASE WHEN {e} <= 0.03928 THEN {e} / 12.92 ELSE pow(({e} + 0.055) / 1.055, 2.4) END)"
_CH = lambda c, k: f"(CAST(('0x' || substr({c}, {2 + 2 * k}, 2)) AS INTEGER) / 255.0::DOUBLE)"
_LUM = lambda c: f"(0.2126::DOUBLE * {_LIN(_CH(c, 0))} + 0.7152::DOUBLE * {_LIN(_CH(c, 1))} + 0.0722::DOUBLE * {_LIN(_CH(c, 2))})"



def _widths(total: int) -> str:
    """Widths of cells: shares of what is left, the worst violator of a bound set to it, round by round."""
    return f"""q AS (SELECT name, col_ix, greatest(CAST(max(CASE WHEN row_ix = -1 THEN length(text) END) AS DOUBLE), quantile_cont(CASE WHEN row_ix >= 0 THEN length(text) END, 0.75)) AS d, max(length(text)) AS longest, NOT bool_or(row_ix = -1 AND trim(text) <> '') AS blank FROM cells GROUP BY name, col_ix),
k AS (SELECT *, bool_and(blank) OVER w AS kv, count(*) OVER w AS n, {_WIDE('greatest(4, least(longest, 12))')} AS floor_, {_WIDE('greatest(d, 4)')} AS hug FROM q WINDOW w AS (PARTITION BY name)),
l AS (SELECT *, CASE WHEN sum(floor_) OVER w <= {total} THEN floor_ ELSE 0 END AS lo, sum(hug) OVER w AS hugged FROM k WINDOW w AS (PARTITION BY name)),
b AS (SELECT *, CASE WHEN n * 0.45::DOUBLE * {total} < {total} THEN 'inf'::DOUBLE ELSE greatest(lo, least({total} * 0.45::DOUBLE, {total} - (sum(lo) OVER w - lo))) END AS hi FROM l WINDOW w AS (PARTITION BY name)),
st AS (SELECT name, col_ix, d, lo::DOUBLE AS lo, hi, CAST(NULL AS DOUBLE) AS fixed, {total}::DOUBLE AS rest, false AS done FROM b
 UNION ALL SELECT name, col_ix, d, lo, hi, f, rest - coalesce(sum(f) FILTER (fixed IS NULL) OVER (PARTITION BY name), 0), bool_and(f IS NOT NULL) OVER (PARTITION BY name)
  FROM (SELECT *, CASE WHEN fixed IS NOT NULL THEN fixed WHEN worst <= 1e-9 THEN p WHEN col_ix = min(col_ix) FILTER (x = worst) OVER (PARTITION BY name) THEN CASE WHEN p < lo THEN lo ELSE hi END END AS f
   FROM (SELECT *, max(x) OVER (PARTITION BY name) AS worst
    FROM (SELECT *, CASE WHEN fixed IS NULL AND m > 1 THEN CASE WHEN p < lo THEN lo - p WHEN p > hi THEN p - hi ELSE 0 END ELSE 0 END AS x
     FROM (SELECT *, CASE WHEN fixed IS NULL THEN CASE WHEN asked > 0 THEN rest * d / asked ELSE rest / m END END AS p
      FROM (SELECT *, count(*) FILTER (fixed IS NULL) OVER (PARTITION BY name) AS m, sum(d) FILTER (fixed IS NULL) OVER (PARTITION BY name) AS asked FROM st WHERE NOT done)))))),
f AS (SELECT b.*, st.fixed AS w FROM b JOIN st USING (name, col_ix) WHERE st.done),
r AS (SELECT *, floor(w) AS whole, row_number() OVER (PARTITION BY name ORDER BY floor(w) - w, col_ix) AS place, {total} - sum(floor(w)) OVER (PARTITION BY name) AS more FROM f)
SELECT name, col_ix, CAST(CASE WHEN kv AND hugged <= {total} THEN hug + CASE WHEN col_ix = n - 1 THEN {total} - hugged ELSE 0 END ELSE whole + CASE WHEN place <= more THEN 1 ELSE 0 END END AS BIGINT) AS width FROM r"""


ORACLE = {
    "q04_budget": f"""WITH {_ROLES} SELECT prop_id, role_ix, role, hours, rate_cents, cents, {_money('cents')} AS amount FROM roles
 UNION ALL SELECT prop_id, CAST(max(role_ix) + 1 AS INTEGER), 'TOTAL', NULL, NULL, CAST(sum(cents) AS BIGINT), {_money('CAST(sum(cents) AS BIGINT)')} FROM roles GROUP BY prop_id""",
    "q04b_covers": f"WITH {_ROLES} SELECT prop_id, 'all' AS item, CAST(100000 AS BIGINT) AS claimed_cents, CAST(sum(cents) AS BIGINT) AS computed_cents FROM roles JOIN supplier ON s_suppkey = prop_id GROUP BY prop_id HAVING sum(cents) <> 100000",
    "q05_money": f"SELECT o_orderkey, CASE WHEN ({_WHY}) IS NULL THEN {_money('c')} END AS amount FROM (SELECT o_orderkey, o_totalprice AS v, CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) AS c FROM orders)",
    "q06_cents": f"""WITH a AS (SELECT 'c' AS src, c_custkey AS key, c_acctbal AS v FROM customer UNION ALL SELECT 'l', l_orderkey * 10 + l_linenumber, l_extendedprice * l_discount FROM lineitem)
 SELECT src, key, CASE WHEN ({_WHY}) IS NULL THEN CAST(floor(v * 100 + 0.5) AS BIGINT) END AS cents, {_WHY} AS why FROM a""",
    "q07_heatmap": f"WITH {_MATRIX} SELECT year, label, week, CAST(value AS VARCHAR) AS mark FROM x",
    "q08_steps": f"WITH {_MATRIX} SELECT year, label, week, value, CAST(least(4, CAST(ceil(value / most * 4) AS INTEGER)) AS VARCHAR) AS mark FROM x",
    "q09_marks": f"WITH {_MATRIX} SELECT year, label, week, repeat('▪', least(3, CAST(ceil(value / most * 3) AS INTEGER))) AS mark FROM x",
    "q10_schedule": """WITH e AS (SELECT event_id AS prop_id, event_type AS role, user_id % 120 + 1 AS w, event_id % 41 AS h FROM events)
 SELECT prop_id, role, 'W' || CASE WHEN w < 10 THEN '0' ELSE '' END || w AS week,
 CASE WHEN h = 0 THEN '—' ELSE CASE WHEN h % 8 = 0 THEN CAST(h // 8 AS VARCHAR) ELSE CAST(h / 8.0::DOUBLE AS VARCHAR) END || CASE WHEN h <= 8 THEN ' day / week' ELSE ' days / week' END END AS label FROM e""",
    "q11_demand": f"WITH {_CELLS} SELECT name, col_ix, greatest(CAST(max(CASE WHEN row_ix = -1 THEN length(text) END) AS DOUBLE), quantile_cont(CASE WHEN row_ix >= 0 THEN length(text) END, 0.75)) AS demand FROM cells GROUP BY name, col_ix",
    "q12_longest": f"WITH {_CELLS} SELECT name, col_ix, max(length(text)) AS longest, NOT bool_or(row_ix = -1 AND trim(text) <> '') AS blank_head FROM cells GROUP BY name, col_ix",
    "q13_widths": f"WITH RECURSIVE {_CELLS}, {_widths(9978)}",
    "q13b_table_widths": f"""WITH RECURSIVE o AS (SELECT o_custkey AS name, o_orderkey AS row_ix, [o_orderkey::VARCHAR, o_orderstatus, o_orderpriority, repeat('remark ', (o_orderkey % 23)::INTEGER), repeat('x', (o_custkey % 31)::INTEGER)] AS texts FROM orders
 UNION ALL SELECT DISTINCT o_custkey, -1, CASE WHEN o_custkey % 4 > 0 THEN ['order', 's', 'priority', 'remarks', 'note'] ELSE ['', '', '', '', ''] END FROM orders),
cells AS (SELECT name, row_ix, unnest(texts) AS text, generate_subscripts(texts, 1)::INTEGER - 1 AS col_ix FROM o), {_widths(7200)}""",
    "q14_fits": "SELECT DISTINCT p_size, CAST(floor((12 + p_size * 10.0::DOUBLE * 0.55::DOUBLE) * 20 + 0.5) AS BIGINT) AS width, p_size * CAST(floor((12 + 4 * 10.0 * 0.55) * 20 + 0.5) AS BIGINT) <= 9978 AS fits FROM part",
    "q47_template": f"""SELECT c_custkey, CASE WHEN c_custkey % 3 > 0 THEN 'Segment ' || c_mktsegment || ': ' ELSE '' END || 'Offer for ' || c_name || CASE WHEN c_custkey % 3 > 0 THEN '' ELSE ' (no segment)' END
 || ', balance ' || {_money('CAST(floor(c_acctbal * 100 + 0.5) AS BIGINT)')} || chr(10) || chr(10) || '[[0:budget]]' || chr(10) || chr(10) || 'Terms.' AS md FROM customer""",
    "q51_colors": f"""WITH p AS (SELECT DISTINCT '#' || lpad(upper(to_hex(p_partkey * 7919 % 16777216)), 6, '0') AS color FROM part),
 s AS (SELECT color, unnest([0.18::DOUBLE, 0.32::DOUBLE, 0.6::DOUBLE, 1.0::DOUBLE]) AS t FROM p), f AS (SELECT color, t, '#' || {_MIX(0)} || {_MIX(1)} || {_MIX(2)} AS fill FROM s),
 l AS (SELECT *, {_LUM('fill')} AS a, {_LUM("'#1A1A1A'")} AS b FROM f)
 SELECT color, t, fill, CASE WHEN (greatest(a, b) + 0.05) / (least(a, b) + 0.05) >= (greatest(a, 1.0) + 0.05) / (least(a, 1.0) + 0.05) THEN '#1A1A1A' ELSE '#FFFFFF' END AS ink FROM l""",
}
