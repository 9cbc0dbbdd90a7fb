"""Queries over settings, batches, links, markup and images."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import images as I
from ..functions import links as L
from ..functions import text as T
from ..operators import config as C
from .base import read


def q35_precedence(spark, d):
    o = read(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    c = read(spark, d, "customer").select("c_custkey", "c_mktsegment", F.col("c_nationkey").alias("n_nationkey"))
    n = read(spark, d, "nation").select("n_nationkey", "n_name")
    j = o.join(c, "c_custkey", "left").join(n, "n_nationkey", "left")
    value = C.precedence(F.when(F.col("o_orderkey") % 5 == 0, F.col("o_orderpriority")), F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")), F.when(F.col("o_orderkey") % 2 == 0, F.col("n_name")), C.DEFAULT_THEME)
    return j.select("o_orderkey", value.alias("theme"))


def q36_unknown_keys(spark, d):
    e = read(spark, d, "events").select("event_id", F.when(F.col("event_id") % 4 == 0, F.concat(F.lit('{"title":"t","to":["pdf","svg"],"x":'), F.col("props"), F.lit("}"))).otherwise(F.col("props")).alias("raw"))
    formats = C.unknown_formats(F.from_json(F.get_json_object("raw", "$.to"), "array<string>"))
    return e.select("event_id", F.array_join(F.array_sort(C.unknown_keys("raw")), ",").alias("unknown"), F.array_join(formats, ",").alias("formats"))


def q36b_sidecar_violations(spark, d):
    e = read(spark, d, "events").select(F.col("event_id").cast("string").alias("path"), F.when(F.col("event_id") % 4 == 0, F.concat(F.lit('{"title":1,"to":["pdf","svg"],"plainNames":true,"x":'), F.col("props"), F.lit("}"))).when(F.col("event_id") % 4 == 1, F.lit("[1]")).otherwise(F.lit('{"title":"t","to":["md"]}')).alias("raw"))
    return C.sidecar_violations(e)


def _inputs(spark, d):
    p = read(spark, d, "pages")
    tail = F.element_at(F.lit([".md", ".DOCX", ".plain.pdf", ".xlsx", ".html", ""]), (F.col("page_id") % 6 + 1).cast("int"))
    number = F.regexp_extract("url", "^[^?#]*/([0-9]+)", 1)
    return p.where(number != "").select("page_id", F.concat(F.lit("in/"), number, tail).alias("path"))


def q37_discovered(spark, d):
    good, own = C.readable(_inputs(spark, d), "plain")
    return good.select("page_id", "path", F.lit(False).alias("own_output")).unionByName(own.select("page_id", "path", F.lit(True).alias("own_output")))


def q37b_own_outputs(spark, d):
    good, own = C.readable(_inputs(spark, d))
    rows = C.targets(good, F.array(F.lit("pdf"), F.lit("md")), F.lit("plain"), F.col("page_id") % 2 == 0)
    return C.own_outputs(good, rows.withColumn("target", F.concat(F.lit("in/"), "target"))).select("page_id", "path")


def _targets(spark, d):
    good, _ = C.readable(_inputs(spark, d), "plain")
    return C.targets(good.select("path"), F.array(F.lit("pdf"), F.lit("docx")), F.lit("plain"), F.endswith("path", F.lit(".md")))


def q38_collisions(spark, d):
    return C.all_others(_targets(spark, d))


def q38b_shared_targets(spark, d):
    """Orders as inputs named after their customer's segment and priority: few targets with very many sources."""
    o = read(spark, d, "orders").join(read(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")
    path = F.concat(F.lit("in/"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0"), F.lit("/"), F.translate("c_mktsegment", " ", "_"), F.lit("-"), F.substring("o_orderpriority", 1, 1), F.lit(".md"))
    rows = C.targets(o.select(path.alias("path")), F.array(F.lit("docx")), F.lit("plain"), F.lit(False))
    return C.collisions(rows)[0].select("target", "n_sources", F.array_join("first_sources", ",").alias("first_sources"))


def q39_messages(spark, d):
    e = read(spark, d, "events").select(T.truncate(F.concat(F.lit("lost  a very long explanation of "), F.col("event_type"), F.lit(" "), (F.col("user_id") % 7).cast("string"))).alias("message"), F.concat(F.lit("doc"), (F.col("event_id") % 500).cast("string")).alias("file"))
    return C.group_messages(e)


def q40_refused_links(spark, d):
    hrefs = read(spark, d, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'))).alias("k", "href"))
    dressed = F.when(F.col("k") % 4 == 0, F.col("href")).when(F.col("k") % 4 == 1, F.concat(F.lit("java\tscript:"), F.col("href"))).when(F.col("k") % 4 == 2, F.concat(F.lit(" DATA:"), F.col("href"))).otherwise(F.concat(F.lit("mailto:"), F.col("href")))
    return hrefs.select("page_id", "k", L.scheme_is_refused(dressed).alias("refused"), L.refused_target(dressed).alias("target"))


def q41_hosts(spark, d):
    return read(spark, d, "pages").select("page_id", L.refused_target("url").alias("target"), F.md5(L.image_markup("url", F.lit("a<b")).cast("binary")).alias("image_md5"))


def q42_plain_text(spark, d):
    return read(spark, d, "pages").select("page_id", F.md5(T.strip_tags("html").cast("binary")).alias("text_md5"))


def q43_entities(spark, d):
    return read(spark, d, "pages").select("page_id", F.md5(T.decode_entities(F.concat(F.col("html"), F.lit("&#65;&#x20AC;&amp;#66;&#38;lt;"))).cast("binary")).alias("text_md5"))


def q50_exit_codes(spark, d):
    o = read(spark, d, "orders").select("o_custkey", F.when((F.col("o_orderstatus") == "P") & (F.col("o_orderkey") % 3 == 0), "failed").when(F.col("o_orderstatus") == "O", "refused").otherwise("ok").alias("status"))
    return C.exit_code(o, ["o_custkey"])


def q52_images(spark, d):
    """Headers of images made from parts: kind, size and whether they can be embedded."""
    p = read(spark, d, "part").select("p_partkey", "p_size")
    be = lambda n: F.lpad(F.hex(n), 8, "0")
    le = lambda n: F.concat(F.lpad(F.hex(n % 256), 2, "0"), F.lpad(F.hex(F.floor(n / 256)), 2, "0"))
    w, h = F.col("p_partkey") % 4000 + 1, F.col("p_size")
    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), be(w), be(h), F.lit("0806000000"))
    gif = F.concat(F.lit("474946383961"), le(w), le(h), F.lit("000000"))
    jpeg = F.concat(F.lit("FFD8FFE000104A46494600010100000100010000FFC0001108"), F.substring(be(h), 5, 4), F.substring(be(w), 5, 4), F.lit("03"))
    bmp = F.concat(F.lit("424D00000000000000003600000028000000"), le(w), F.lit("0000"), le(h), F.lit("000001001800"))
    data = F.unhex(F.when(F.col("p_partkey") % 5 == 0, png).when(F.col("p_partkey") % 5 == 1, gif).when(F.col("p_partkey") % 5 == 2, jpeg).when(F.col("p_partkey") % 5 == 3, bmp).otherwise(F.lit("00")))
    rows = p.withColumn("size", I.raster_size(data))
    return rows.select("p_partkey", F.col("size.type").alias("type"), F.col("size.width").alias("width"), F.col("size.height").alias("height"))


QUERIES = {f.__name__: f for f in (q35_precedence, q36_unknown_keys, q36b_sidecar_violations, q37_discovered, q37b_own_outputs, q38_collisions, q38b_shared_targets, q39_messages, q40_refused_links, q41_hosts, q42_plain_text, q43_entities, q50_exit_codes, q52_images)}

_INPUTS = """i AS (SELECT page_id, 'in/' || regexp_extract(url, '^[^?#]*/([0-9]+)', 1) || ['.md', '.DOCX', '.plain.pdf', '.xlsx', '.html', ''][page_id % 6 + 1] AS path FROM pages WHERE regexp_extract(url, '^[^?#]*/([0-9]+)', 1) <> ''),
g AS (SELECT *, regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\\.[^.]+$', '') AS stem FROM i WHERE page_id % 6 < 4)"""
_CLEAN = lambda h: f"regexp_replace({h}, '[\\x00-\\x20\\x7f]', '', 'g')"
_SCHEME = lambda c: f"lower(regexp_extract({c}, '^([A-Za-z][A-Za-z0-9+.-]*:)', 1))"
_HOST = lambda c: f"lower(regexp_extract({c}, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?([^/?#]*)', 1))"
_TARGET = lambda c: f"CASE WHEN {_HOST(c)} <> '' THEN {_HOST(c)} WHEN {_SCHEME(c)} <> '' THEN {_SCHEME(c)} ELSE split_part({c}, ':', 1) END"
_DECODE = lambda h: f"replace(replace(replace(replace(replace({h}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&apos;', ''''), '&amp;', '&')"
_ESC = lambda h: f"replace(replace(replace(replace(replace({h}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')"
from .base import ORACLE_WS  # noqa: E402

ORACLE = {
    "q35_precedence": """
SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 5 = 0 THEN o_orderpriority END, CASE WHEN o_custkey % 3 = 0 THEN c_mktsegment END, CASE WHEN o_orderkey % 2 = 0 THEN n_name END, 'plain') AS theme
FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey""",
    "q36_unknown_keys": """
SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'x' ELSE array_to_string(list_sort(json_keys(props)), ',') END AS unknown, CASE WHEN event_id % 4 = 0 THEN 'svg' END AS formats FROM events""",
    "q36b_sidecar_violations": """
SELECT CAST(event_id AS VARCHAR) AS path, unnest(CASE event_id % 4 WHEN 0 THEN ['title: expected string', 'unknown key x', 'to: unknown format svg'] WHEN 1 THEN ['the settings file must hold one JSON object'] ELSE [] END) AS why FROM events""",
    "q37_discovered": f"WITH {_INPUTS} SELECT page_id, path, page_id % 6 = 2 AS own_output FROM g",
    "q37b_own_outputs": f"""WITH {_INPUTS}, t AS (SELECT path AS src, unnest(['pdf', 'md']) AS f, stem, page_id FROM g), n AS (SELECT src, stem || CASE WHEN page_id % 2 = 0 THEN '' ELSE '.plain' END || '.' || f AS target FROM t)
 SELECT page_id, path FROM g WHERE EXISTS (SELECT 1 FROM n WHERE 'in/' || n.target = g.path AND n.src <> g.path)""",
    "q38_collisions": f"""WITH {_INPUTS}, s AS (SELECT DISTINCT path, stem FROM g WHERE page_id % 6 <> 2), t AS (SELECT path, stem || CASE WHEN path LIKE '%.md' THEN '' ELSE '.plain' END || '.' || unnest(['pdf', 'docx']) AS target FROM s),
 o AS (SELECT a.path, a.target, list(DISTINCT b.path ORDER BY b.path) AS x FROM t a JOIN t b ON a.target = b.target AND a.path <> b.path GROUP BY a.path, a.target)
 SELECT path, target, len(x) + 1 AS n_sources, array_to_string(x, ', ') AS others FROM o""",
    "q38b_shared_targets": """
WITH s AS (SELECT replace(c_mktsegment, ' ', '_') || '-' || substr(o_orderpriority, 1, 1) AS stem, 'in/' || lpad(o_orderkey::VARCHAR, 12, '0') || '/' AS dir FROM orders JOIN customer ON c_custkey = o_custkey),
t AS (SELECT stem || '.plain.docx' AS target, dir || stem || '.md' AS path FROM s)
SELECT target, count(*) AS n_sources, array_to_string((list(path ORDER BY path))[1:21], ',') AS first_sources FROM t GROUP BY target HAVING count(*) > 1""",
    "q39_messages": """
WITH e AS (SELECT 'lost a very long explanation of ' || event_type || ' ' || (user_id % 7) AS m, 'doc' || (event_id % 500) AS f FROM events),
t AS (SELECT CASE WHEN length(m) > 40 THEN left(m, 40) || '…' ELSE m END AS message, f FROM e),
l AS (SELECT message, count(*) AS n, list(f ORDER BY f) AS fs FROM t GROUP BY message)
SELECT message, n, array_to_string(fs[1:20], ', ') || CASE WHEN n > 20 THEN ' …and ' || (n - 20) || ' more' ELSE '' END AS files FROM l""",
    "q40_refused_links": f"""
WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href, generate_subscripts(regexp_extract_all(html, 'href="([^"]*)"', 1), 1) - 1 AS k FROM pages),
x AS (SELECT page_id, k, {_CLEAN("CASE k % 4 WHEN 0 THEN href WHEN 1 THEN 'java' || chr(9) || 'script:' || href WHEN 2 THEN ' DATA:' || href ELSE 'mailto:' || href END")} AS c FROM h)
SELECT page_id, CAST(k AS INTEGER) AS k, regexp_matches(c, '(?i)^(javascript|vbscript|data):') AS refused, {_TARGET('c')} AS target FROM x""",
    "q41_hosts": f"""WITH x AS (SELECT page_id, url, {_CLEAN('url')} AS c FROM pages), t AS (SELECT page_id, {_TARGET('c')} AS target FROM x)
 SELECT page_id, target, md5('<span class="image-missing">a&lt;b (' || {_ESC('target')} || ')</span>') AS image_md5 FROM t""",
    "q42_plain_text": f"SELECT page_id, md5(trim(regexp_replace({_DECODE(chr(114) + 'egexp_replace(html, ' + chr(39) + '<[^>]*>' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')')}, '{ORACLE_WS}', ' ', 'g'))) AS text_md5 FROM pages",
    "q43_entities": f"SELECT page_id, md5({_DECODE('html')} || 'A€&#66;&lt;') AS text_md5 FROM pages",
    "q50_exit_codes": """
WITH s AS (SELECT o_custkey, CASE WHEN o_orderstatus = 'P' AND o_orderkey % 3 = 0 THEN 'failed' WHEN o_orderstatus = 'O' THEN 'refused' ELSE 'ok' END AS status FROM orders)
SELECT o_custkey, CASE WHEN bool_or(status = 'failed') THEN 1 WHEN bool_or(status = 'refused') THEN 3 ELSE 0 END AS exit_code, count(*) FILTER (status = 'ok') AS n_ok, count(*) FILTER (status = 'refused') AS n_refused, count(*) FILTER (status = 'failed') AS n_failed FROM s GROUP BY o_custkey""",
    "q52_images": """
SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/gif' WHEN 2 THEN 'image/jpeg' WHEN 3 THEN 'image/bmp' END AS type,
 CASE WHEN p_partkey % 5 < 4 THEN p_partkey % 4000 + 1 END AS width, CASE WHEN p_partkey % 5 < 4 THEN CAST(p_size AS BIGINT) END AS height FROM part""",
}
