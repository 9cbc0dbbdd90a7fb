"""Queries over page geometry and list structure; tables of numbers stand for pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import assembly as A
from ..operators import numbering as N
from ..operators import pages as P
from .base import read


def _page_runs(spark, d):
    p = read(spark, d, "pages")
    text = F.concat(F.lit("<"), F.col("piece"))
    pieces = p.select(F.floor(F.col("page_id") / 5).alias("doc_id"), F.col("page_id").alias("page"), F.posexplode(F.slice(F.split("html", "<"), 2, 2147483647)).alias("run_ix", "piece"))
    return pieces.select("doc_id", "page", "run_ix", text.alias("text"), (F.col("run_ix") % 3 * 100).cast("double").alias("x"), (F.lit(5000.0) - F.col("run_ix") * 10).alias("y"))


def q23_repeated(spark, d):
    r = P.find_repeated(_page_runs(spark, d), ["doc_id"])
    return r.select("doc_id", F.array_join("texts", "¦").alias("texts"), "x", "y_top", "y_bottom", "pages")


def q24_chrome(spark, d):
    e = read(spark, d, "events").select(F.col("user_id").alias("doc_id"), F.col("event_type").alias("page"), F.col("value").alias("y"))
    above = F.when(F.col("doc_id") % 3 > 0, F.lit(90.0) + F.col("doc_id") % 50 * 10)
    below = F.when(F.col("doc_id") % 3 > 1, F.lit(5.0))
    return P.chrome_report(P.split_chrome(e, above, below), ["doc_id"], above, below).select("doc_id", "status", "n_removed", "n_pages", "y_min", "y_max")


def q25_clusters(spark, d):
    p = read(spark, d, "part").select("p_brand", F.col("p_retailprice").alias("value"), F.col("p_partkey").alias("rect_ix"))
    c = P.cluster_edges(p, ["p_brand"])
    return c.select("p_brand", "anchor", F.round("mean", 6).alias("mean"), "n_rects")


def q25b_cluster_means(spark, d):
    p = read(spark, d, "part").select("p_brand", F.col("p_retailprice").alias("value"))
    return P.cluster_means(p, ["p_brand"], "value").select("p_brand", "value", F.round("mean", 6).alias("mean"))


def q26_bands(spark, d):
    e = read(spark, d, "embeddings").select("vec_id", "label", F.get("embedding", F.lit(0)).cast("double").alias("x"), F.get("embedding", F.lit(1)).cast("double").alias("y"))
    lines = e.select("label").distinct().select("label", F.posexplode(F.lit([-1.0, -0.1, 0.0, 0.1, 1.0])).alias("ix", "value"))
    placed = P.assign_bands(P.assign_bands(e, lines, ["label"], "x", "col"), lines, ["label"], "y", "band")
    return placed.groupBy("label", "col", "band").agg(F.count("*").alias("n"))


def _rects(spark, d):
    li = read(spark, d, "lineitem")
    q, p = F.col("l_quantity"), F.col("l_linenumber")
    x, y = (p - 1) * 60.0, 700.0 - (q % 5) * 20
    return li.select(F.col("l_suppkey").alias("page"), (F.col("l_orderkey") * 10 + p).alias("rect_ix"), x.alias("x0"), y.alias("y0"), (x + 60).alias("x1"), (y + 20).alias("y1"))


def q26b_grid_lines(spark, d):
    """Horizontal and vertical lines of each supplier's boxes, the implied top one included."""
    r = P.without_page_frame(P.distinct_rects(_rects(spark, d), ["page"]), F.lit(600.0), F.lit(800.0))
    edge = lambda a, b: r.select("page", "rect_ix", F.explode(F.array(a, b)).alias("value"))
    xs, ys = P.boundaries(edge("x0", "x1"), ["page"]), P.boundaries(edge("y0", "y1"), ["page"])
    top = P.implied_top(ys, ["page"])
    return xs.select("page", F.lit("x").alias("axis"), "ix", "value").unionByName(top.select("page", F.lit("y").alias("axis"), "ix", "value"))


def _order_rects(spark, d):
    li = read(spark, d, "lineitem")
    x, y = F.col("l_quantity") * 3, F.floor(F.col("l_discount") * 100 + 0.5) * 6.0
    return li.select(F.col("l_orderkey").alias("page"), (F.col("l_linenumber").cast("long") * 10**9 + F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("rect_ix"), x.alias("x0"), y.alias("y0"), (x + 12).alias("x1"), (y + 12).alias("y1"))


def q27_components(spark, d):
    return P.components(_order_rects(spark, d), ["page"]).select("page", "rect_ix", "component")


def q27b_largest(spark, d):
    r = P.largest_component(P.components(_order_rects(spark, d), ["page"]), ["page"])
    return r.groupBy("page").agg(F.min("component").alias("component"), F.count("*").alias("n"))


def _sized(spark, d):
    return read(spark, d, "part").select(F.col("p_brand").alias("doc"), F.col("p_partkey").alias("run_ix"), F.col("p_name").alias("text"), F.col("p_retailprice").alias("x"), F.col("p_size").cast("double").alias("y"), F.col("p_size").cast("double").alias("size_pt"))


def q28_heading_levels(spark, d):
    return P.heading_levels(_sized(spark, d), ["doc"])


def q28b_prose(spark, d):
    r = _sized(spark, d)
    return P.prose_blocks(r, P.heading_levels(r, ["doc"]), ["doc"], ["doc"]).select("doc", "block_ix", "t", "level", "text")


def q29_reading_order(spark, d):
    e = read(spark, d, "embeddings").select("label", F.col("vec_id").alias("run_ix"), F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("text"), F.get("embedding", F.lit(0)).cast("double").alias("x"), (F.get("embedding", F.lit(1)).cast("double") * 50).alias("y"))
    return P.reading_text(e, ["label"])


def q30_table_continues(spark, d):
    o = read(spark, d, "orders")
    t = o.select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("page"), F.when(F.col("o_orderkey") % 7 > 0, F.array("o_orderpriority", F.lit("b"))).otherwise(F.array("o_orderpriority", F.lit("b"), F.lit("c"))).alias("head"), (F.col("o_orderkey") % 5 > 0).alias("free"), F.array(F.lit(0.0), F.lit(100.0) + (F.col("o_orderkey") % 3) * 2, F.lit(200.0)).alias("xs"))
    return P.continue_tables(t, ["doc_id"]).select("doc_id", "page", "table_no")


def q30c_over_pages(spark, d):
    """Customers' orders as pages: grids, pages of furniture only and pages with a text of their own between them."""
    o = read(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("page"), (F.col("o_orderkey") % 4 > 0).alias("has_grid"))
    run = lambda zone, repeated: F.struct(F.lit(zone).alias("zone"), repeated.alias("repeated"))
    of_grid = F.array(run(0, F.lit(True)), run(0, F.col("page") % 11 > 0), run(1, F.lit(False)), run(2, F.col("page") % 13 > 0))
    runs = F.when(F.col("has_grid"), of_grid).otherwise(F.array(run(0, F.lit(True)), run(0, F.col("page") % 3 > 0)))
    placed = o.select("doc_id", "page", "has_grid", F.explode(runs).alias("r")).select("doc_id", "page", "has_grid", "r.zone", "r.repeated")
    tables = A.free_tables(placed).withColumns({"head": F.array((F.col("page") % 17).cast("string"), F.lit("b")), "xs": F.array(F.lit(0.0), (F.col("page") % 3) * 2.0)})
    return P.continue_tables(tables, ["doc_id"]).join(tables, ["doc_id", "page"]).select("doc_id", "page", "free", "table_no")


def q30b_join_anchor(spark, d):
    e = read(spark, d, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("block_ix"), "event_type")
    return P.join_anchor(e, ["doc_id"], F.col("event_type") == "error").select("doc_id", "block_ix", "anchor_ix")


def _paras(spark, d):
    level = F.pmod("event_id", F.lit(3)).cast("int")
    rule = F.when(F.col("user_id") % 3 == 1, 0).when(F.col("user_id") % 3 == 2, 1)
    return read(spark, d, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("para_ix"), (F.col("event_id") % 2).cast("string").alias("num_id"), level.alias("ilvl"), (1 + level).alias("start"), F.when(level == 2, rule).alias("lvl_restart"))


def q31_numbering(spark, d):
    return N.item_numbers(_paras(spark, d)).select("doc_id", "para_ix", F.col("number").cast("long").alias("number"))


def q31b_levels(spark, d):
    """Numbers resolved through definitions, style links and overrides."""
    p = _paras(spark, d).select("doc_id", "para_ix", "num_id", "ilvl")
    docs = p.select("doc_id").distinct()
    nums = docs.select("doc_id", F.explode(F.lit(["0", "1"])).alias("num_id")).where("not (num_id = '1' and doc_id % 7 = 0)").withColumn("abstract_id", F.concat(F.lit("a"), "num_id"))
    levels = docs.select("doc_id", F.lit("a0").alias("abstract_id"), F.explode(F.lit([0, 1])).alias("ilvl")).unionByName(docs.select("doc_id", F.lit("s").alias("abstract_id"), F.lit(0).alias("ilvl")))
    levels = levels.select("*", F.when(F.col("abstract_id") == "s", "bullet").otherwise("decimal").alias("num_fmt"), (F.col("ilvl") + 1).alias("start"), F.lit(None).cast("int").alias("lvl_restart"))
    over = docs.where("doc_id % 2 = 0").select("doc_id", F.lit("0").alias("num_id"), F.lit(1).alias("ilvl"), F.lit(9).alias("start"))
    links = docs.select("doc_id", F.lit("st").alias("style"), F.lit("s").alias("abstract_id"), F.lit("styleLink").alias("kind")).unionByName(docs.select("doc_id", F.lit("st").alias("style"), F.lit("a1").alias("abstract_id"), F.lit("numStyleLink").alias("kind")))
    return N.resolve_levels(p, nums, levels, over, links).select("doc_id", "para_ix", "num_fmt", "start", "resolved")


def q32_islands(spark, d):
    e = read(spark, d, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("item_ix"), (F.col("event_type") == "click").alias("ordered"), F.lit(0).alias("depth"), F.col("event_type").alias("num_id"), F.col("event_id").alias("number"), F.col("event_type").alias("text"))
    return N.list_blocks(e).select("doc_id", F.col("island").cast("long").alias("island"), "ordered", "start", "n_items")


def q32b_sections(spark, d):
    e = read(spark, d, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("block_ix"), "event_type")
    return N.sections(e, F.col("event_type").isin("view", "click")).select("doc_id", F.col("section").cast("long").alias("section"), "wide", "from_ix", "to_ix", "first_page_header")


def q34_merge_adjacent(spark, d):
    e = read(spark, d, "events").select("user_id", "event_id", "event_type", F.substring("event_type", 1, 1).alias("text"))
    return N.merge_adjacent(e, ["user_id"], "event_id", F.col("event_type")).select("user_id", "event_id", "path", "text")


QUERIES = {f.__name__: f for f in (q23_repeated, q24_chrome, q25_clusters, q25b_cluster_means, q26_bands, q26b_grid_lines, q27_components, q27b_largest, q28_heading_levels, q28b_prose, q29_reading_order, q30_table_continues, q30b_join_anchor, q30c_over_pages, q31_numbering, q31b_levels, q32_islands, q32b_sections, q34_merge_adjacent)}

_ANCHORS = lambda src, key, tol: f"an AS (SELECT {key} AS k, min(v) AS a FROM {src} GROUP BY 1 UNION ALL SELECT an.k, (SELECT min(v) FROM {src} s WHERE s.{key} = an.k AND s.v - an.a > {tol}) FROM an WHERE an.a IS NOT NULL)"
_ORDER_RECTS = "r AS (SELECT l_orderkey AS page, CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey * 1000 + l_suppkey AS i, l_quantity * 3 AS x0, floor(l_discount * 100 + 0.5) * 6 AS y0 FROM lineitem)"
_NEAR = lambda p: " OR ".join(f"abs(a.{p} + {i} - b.{p} - {j}) <= 2" for i in (0, 12) for j in (0, 12))
_COMP = f"""{_ORDER_RECTS}, e AS (SELECT a.page, a.i AS u, b.i AS v FROM r a JOIN r b ON a.page = b.page AND (a.i <> b.i) AND
 ((({_NEAR('x0')}) AND greatest(a.y0, b.y0) - least(a.y0, b.y0) - 12 <= 0) OR (({_NEAR('y0')}) AND greatest(a.x0, b.x0) - least(a.x0, b.x0) - 12 <= 0))),
 c AS (SELECT page, i, i AS m FROM r UNION SELECT c.page, e.v, c.m FROM c JOIN e ON e.page = c.page AND e.u = c.i),
 comp AS (SELECT page, i AS rect_ix, min(m) AS component FROM c GROUP BY page, i)"""
_SIZES = "n AS (SELECT p_brand AS doc, p_size * 2 AS half_pt, count(*) AS n, min(p_partkey) AS seen FROM part GROUP BY ALL), b AS (SELECT doc, arg_max(half_pt, (n, -seen)) AS body FROM n GROUP BY doc), lv AS (SELECT n.doc, half_pt, least(3, dense_rank() OVER (PARTITION BY n.doc ORDER BY half_pt DESC)) AS level FROM n JOIN b ON n.doc = b.doc WHERE half_pt > body)"

ORACLE = {
    "q23_repeated": """
WITH f AS (SELECT page_id // 5 AS doc_id, page_id, unnest(string_split(html, '<')[2:]) AS piece, generate_subscripts(string_split(html, '<')[2:], 1) - 1 AS i FROM pages),
n AS (SELECT page_id // 5 AS doc_id, count(*) AS n FROM pages GROUP BY 1)
SELECT f.doc_id, string_agg(DISTINCT '<' || piece, '¦' ORDER BY '<' || piece) AS texts, CAST(i % 3 * 100 AS DOUBLE) AS x, CAST(5000 - i * 10 AS DOUBLE) AS y_top, CAST(5000 - i * 10 AS DOUBLE) AS y_bottom, count(DISTINCT page_id) AS pages
FROM f JOIN n ON f.doc_id = n.doc_id GROUP BY f.doc_id, i, n.n HAVING count(DISTINCT page_id) = n.n AND n.n >= 2 AND count(DISTINCT regexp_replace(piece, '[0-9]+', '', 'g')) = 1""",
    "q24_chrome": """
WITH e AS (SELECT user_id AS doc_id, event_type, value AS y, CASE WHEN user_id % 3 > 0 THEN 90.0 + user_id % 50 * 10 END AS a, CASE WHEN user_id % 3 > 1 THEN 5.0 END AS b FROM events),
s AS (SELECT *, coalesce(y > a, false) OR coalesce(y < b, false) AS removed FROM e)
SELECT doc_id, CASE WHEN count(*) FILTER (removed) > 0 THEN 'removed' WHEN max(a) IS NOT NULL THEN 'inert' WHEN count(DISTINCT event_type) < 2 THEN 'single page' ELSE 'advisory' END AS status,
 count(*) FILTER (removed) AS n_removed, count(DISTINCT event_type) AS n_pages, min(y) AS y_min, max(y) AS y_max FROM s GROUP BY doc_id""",
    "q25_clusters": f"""WITH RECURSIVE p AS (SELECT p_brand, p_retailprice AS v, p_partkey FROM part), {_ANCHORS('p', 'p_brand', 2)},
 m AS (SELECT p_brand, v, p_partkey, (SELECT max(a) FROM an WHERE an.k = p_brand AND a <= v) AS anchor FROM p)
 SELECT p_brand, anchor, round(avg(v), 6) AS mean, count(DISTINCT p_partkey) AS n_rects FROM m GROUP BY p_brand, anchor""",
    "q25b_cluster_means": f"""WITH RECURSIVE p AS (SELECT DISTINCT p_brand, p_retailprice AS v FROM part), {_ANCHORS('p', 'p_brand', 2)},
 m AS (SELECT p_brand, v, (SELECT max(a) FROM an WHERE an.k = p_brand AND a <= v) AS anchor FROM p)
 SELECT p_brand, v AS value, round(avg(v) OVER (PARTITION BY p_brand, anchor), 6) AS mean FROM m""",
    "q26_bands": """
WITH e AS (SELECT label, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings),
b AS (SELECT label, CASE WHEN x >= -1 AND x < -0.1::DOUBLE THEN 0 WHEN x >= -0.1::DOUBLE AND x < 0 THEN 1 WHEN x >= 0 AND x < 0.1::DOUBLE THEN 2 WHEN x >= 0.1::DOUBLE AND x < 1 THEN 3 END AS col,
 CASE WHEN y >= -1 AND y < -0.1::DOUBLE THEN 0 WHEN y >= -0.1::DOUBLE AND y < 0 THEN 1 WHEN y >= 0 AND y < 0.1::DOUBLE THEN 2 WHEN y >= 0.1::DOUBLE AND y < 1 THEN 3 END AS band FROM e)
SELECT label, col, band, count(*) AS n FROM b GROUP BY ALL""",
    "q26b_grid_lines": """
WITH r AS (SELECT DISTINCT l_suppkey AS page, (l_linenumber - 1) * 60.0 AS x0, 700.0 - (l_quantity % 5) * 20 AS y0 FROM lineitem),
e AS (SELECT page, 'x' AS axis, unnest([x0, x0 + 60])::DOUBLE AS v, x0, y0 FROM r UNION ALL SELECT page, 'y', unnest([y0, y0 + 20])::DOUBLE, x0, y0 FROM r),
c AS (SELECT page, axis, v, count(DISTINCT (x0, y0)) AS n FROM e GROUP BY ALL),
q AS (SELECT *, min(v) OVER w AS lo, max(v) OVER w AS hi, max(n) OVER w AS m FROM c WINDOW w AS (PARTITION BY page, axis)),
k AS (SELECT page, axis, v, row_number() OVER (PARTITION BY page, axis ORDER BY v) - 1 AS ix FROM q WHERE m >= 2 AND (n >= 2 OR v = lo OR v = hi)),
g AS (SELECT page, axis, v, ix, v - lag(v) OVER (PARTITION BY page, axis ORDER BY ix) AS gap FROM k),
t AS (SELECT page, axis, max(ix) + 1 AS ix, max(v) + median(gap) AS v FROM g WHERE axis = 'y' GROUP BY ALL HAVING median(gap) > 0)
SELECT page, axis, CAST(ix AS INTEGER) AS ix, v AS value FROM k UNION ALL SELECT page, axis, CAST(ix AS INTEGER), v FROM t""",
    "q27_components": f"WITH RECURSIVE {_COMP} SELECT page, rect_ix, component FROM comp",
    "q27b_largest": f"""WITH RECURSIVE {_COMP}, g AS (SELECT c.page, component, count(*) AS n, max(y0) AS top, min(x0) AS lft FROM comp c JOIN r ON r.page = c.page AND r.i = c.rect_ix GROUP BY ALL)
 SELECT page, component, n FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY n DESC, top DESC, lft, component) AS k FROM g) WHERE k = 1""",
    "q28_heading_levels": f"WITH {_SIZES} SELECT doc, half_pt, CAST(level AS INTEGER) AS level FROM lv",
    "q28b_prose": f"""WITH {_SIZES} SELECT p_brand AS doc, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_retailprice, p_partkey) - 1 AS INTEGER) AS block_ix,
 CASE WHEN level IS NULL THEN 'para' ELSE 'heading' END AS t, CAST(level AS INTEGER) AS level, p_name AS text FROM part LEFT JOIN lv ON lv.doc = p_brand AND lv.half_pt = p_size * 2""",
    "q29_reading_order": f"""WITH RECURSIVE p AS (SELECT label, vec_id, CAST(embedding[1] AS DOUBLE) AS x, -CAST(embedding[2] AS DOUBLE) * 50 AS v FROM embeddings), {_ANCHORS('p', 'label', 2)},
 m AS (SELECT label, vec_id, x, (SELECT max(a) FROM an WHERE an.k = label AND a <= v) AS anchor FROM p)
 SELECT label, string_agg('v' || vec_id, ' ' ORDER BY anchor, x, vec_id) AS text FROM m GROUP BY label""",
    "q30_table_continues": """
WITH RECURSIVE t AS (SELECT o_custkey AS doc_id, o_orderkey AS page, o_orderkey % 7 > 0 AS c, o_orderkey % 5 > 0 AS free, o_orderpriority AS h, (o_orderkey % 3) * 2 AS x, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders),
f AS (SELECT doc_id, page, r, c, h, x, 1 AS no FROM t WHERE r = 1
 UNION ALL SELECT t.doc_id, t.page, t.r, CASE WHEN g THEN f.c ELSE t.c END, CASE WHEN g THEN f.h ELSE t.h END, t.x, CASE WHEN g THEN f.no ELSE f.no + 1 END
 FROM f JOIN (SELECT * FROM t) t ON t.doc_id = f.doc_id AND t.r = f.r + 1, LATERAL (SELECT t.free AND f.c = t.c AND f.h <> t.h AND abs(f.x - t.x) <= 3 AS g))
SELECT doc_id, page, CAST(no AS BIGINT) AS table_no FROM f""",
    "q30c_over_pages": """
WITH RECURSIVE p AS (SELECT o_custkey AS doc_id, o_orderkey AS page, o_orderkey % 4 > 0 AS g, CASE WHEN o_orderkey % 4 > 0 THEN CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS above,
 CASE WHEN o_orderkey % 4 > 0 AND o_orderkey % 13 = 0 THEN 1 ELSE 0 END AS below FROM orders),
b AS (SELECT a.doc_id, a.page, max(b.page) AS prev FROM p a LEFT JOIN p b ON a.doc_id = b.doc_id AND b.page < a.page AND b.g WHERE a.g GROUP BY ALL),
fr AS (SELECT b.doc_id, b.page, b.prev IS NOT NULL AND NOT EXISTS (SELECT 1 FROM p x WHERE x.doc_id = b.doc_id AND (x.page > b.prev AND x.page <= b.page AND x.above > 0 OR x.page >= b.prev AND x.page < b.page AND x.below > 0)) AS free FROM b),
t AS (SELECT *, page % 17 AS h, (page % 3) * 2 AS x, row_number() OVER (PARTITION BY doc_id ORDER BY page) AS r FROM fr),
f AS (SELECT doc_id, page, free, r, h, x, 1 AS no FROM t WHERE r = 1
 UNION ALL SELECT t.doc_id, t.page, t.free, t.r, CASE WHEN g THEN f.h ELSE t.h END, t.x, CASE WHEN g THEN f.no ELSE f.no + 1 END
 FROM f JOIN (SELECT * FROM t) t ON t.doc_id = f.doc_id AND t.r = f.r + 1, LATERAL (SELECT t.free AND f.h <> t.h AND abs(f.x - t.x) <= 3 AS g))
SELECT doc_id, page, free, CAST(no AS BIGINT) AS table_no FROM f""",
    "q30b_join_anchor": """
SELECT user_id AS doc_id, event_id AS block_ix, max(CASE WHEN event_type <> 'error' THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id) AS anchor_ix FROM events""",
    "q31_numbering": """
WITH p AS (SELECT user_id AS doc_id, event_id, event_id % 2 AS num, event_id % 3 AS lvl, CASE WHEN event_id % 3 = 2 THEN CASE user_id % 3 WHEN 1 THEN 0 WHEN 2 THEN 1 ELSE 2 END ELSE event_id % 3 END AS reach FROM events),
e AS (SELECT a.doc_id, a.event_id, a.num, a.lvl, count(b.event_id) AS epoch FROM p a LEFT JOIN p b ON a.doc_id = b.doc_id AND a.num = b.num AND b.event_id <= a.event_id AND b.lvl < a.reach GROUP BY ALL)
SELECT doc_id, event_id AS para_ix, CAST(lvl + row_number() OVER (PARTITION BY doc_id, num, lvl, epoch ORDER BY event_id) AS BIGINT) AS number FROM e""",
    "q31b_levels": """
WITH p AS (SELECT user_id AS doc_id, event_id AS para_ix, event_id % 2 AS num, event_id % 3 AS lvl FROM events)
SELECT doc_id, para_ix, CASE WHEN num = 0 THEN 'decimal' WHEN doc_id % 7 <> 0 THEN 'bullet' END AS num_fmt,
 CAST(CASE WHEN num = 0 AND lvl = 1 AND doc_id % 2 = 0 THEN 9 WHEN num = 0 AND lvl = 1 THEN 2 ELSE 1 END AS INTEGER) AS start, num = 0 OR doc_id % 7 <> 0 AS resolved FROM p""",
    "q32_islands": """
WITH c AS (SELECT user_id, event_id, event_type, CASE WHEN lag(event_type) OVER w = event_type THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
i AS (SELECT *, CAST(sum(s) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS island FROM c)
SELECT user_id AS doc_id, island, event_type = 'click' AS ordered, min(event_id) AS start, count(*) AS n_items FROM i GROUP BY user_id, island, event_type""",
    "q32b_sections": """
WITH c AS (SELECT user_id, event_id, event_type IN ('view', 'click') AS wide, CASE WHEN lag(event_type IN ('view', 'click')) OVER w = (event_type IN ('view', 'click')) THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
i AS (SELECT *, CAST(sum(s) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS section FROM c)
SELECT user_id AS doc_id, section, wide, min(event_id) AS from_ix, max(event_id) AS to_ix, section = 1 AS first_page_header FROM i GROUP BY user_id, section, wide""",
    "q34_merge_adjacent": """
WITH c AS (SELECT user_id, event_id, event_type, CASE WHEN lag(event_type) OVER w = event_type THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
i AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM c)
SELECT user_id, min(event_id) AS event_id, event_type AS path, string_agg(left(event_type, 1), '' ORDER BY event_id) AS text FROM i GROUP BY user_id, island, event_type""",
}
