"""Queries over documents as blocks: inventory, tokens, zones, rendering, validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import tokenise
from ..operators import blocks as B
from ..operators import render as R
from .base import ORACLE_BLOCKS, ORACLE_WS, oracle_tokens, read, synthesised

KINDS = B.KINDS


def _blocks(spark, d):
    return B.split_blocks(read(spark, d, "documents").select("doc_id", synthesised().alias("text")))


def q01_block_counts(spark, d):
    return B.inspect(_blocks(spark, d))


def q02_tokens(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "text")
    odd = spark.createDataFrame([(-1, "€ 4 500,00"), (-2, "soft­hyphen"), (-3, "ﬁgure ﬂow"), (-4, "a b　c")], "doc_id long, text string")
    words = docs.unionByName(odd).select("doc_id", tokenise("text").alias("w"))
    return words.select("doc_id", F.size("w").cast("long").alias("n_tokens"), F.size(F.array_distinct("w")).cast("long").alias("n_distinct"))


def q03_first_divergence(spark, d):
    docs = read(spark, d, "documents").select("doc_id", F.lit(0).alias("block_ix"), F.lit("para").alias("t"), "text")
    source = B.doc_tokens(docs)
    short = source.select("doc_id", F.filter("tokens", lambda x, i: i % 7 != 6).alias("tokens"))
    return B.first_divergence(source, short).select("doc_id", F.col("pos").cast("long").alias("pos"), "expected", "found")


def q33_heading_jumps(spark, d):
    e = read(spark, d, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("block_ix"), F.lit("heading").alias("t"), (F.pmod("event_id", F.lit(3)) + 1).cast("int").alias("level"), F.col("event_type").alias("text"))
    return B.heading_jumps(e).select("doc_id", F.col("ordinal").cast("long").alias("ordinal"), "from_level", "to_level", "text")


def q33b_warnings(spark, d):
    """Every kind of warning, on blocks made of events: headings that jump, tables too wide, images that can't be embedded, no title."""
    e = read(spark, d, "events")
    k = F.col("event_id") % 4
    t = F.when(k == 0, "table").when(k == 1, "image").otherwise("heading")
    level = F.when(F.col("user_id") % 5 == 0, 2 + F.col("event_id") % 2).otherwise(1 + (F.col("event_id") / 2).cast("long") % 3)
    src = F.when(F.col("event_id") % 8 == 1, "data:image/png;base64,iVBORw0KGgoAAAANSUhEUgAAAAEAAAABCAYAAAAfFcSJ").otherwise("data:image/svg+xml;base64,PHN2Zy8+")
    b = e.select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("block_ix"), t.alias("t"), F.when(t == "heading", level).cast("int").alias("level"), F.col("event_type").alias("text"), F.when(t == "table", (F.col("event_id") / 4).cast("long") % 14).cast("int").alias("n_cols"), F.when(t == "image", src).alias("src"))
    titles, rest = B.lift_title(b)
    return B.warnings(rest, titles).select("doc_id", "kind", F.col("ordinal").cast("long").alias("ordinal"), "message")


def q45_table_markdown(spark, d):
    rows = read(spark, d, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.array(F.concat(F.col("n_name"), F.lit("|x")), F.col("n_nationkey").cast("string")))).alias("rows"))
    head, align = F.array(F.lit("nation"), F.lit("key")), F.array(F.lit("l"), F.lit("r"))
    return rows.join(read(spark, d, "region"), rows["n_regionkey"] == F.col("r_regionkey")).select("r_name", R.table_markdown(head, align, F.col("rows")).alias("markdown"))


def q44_escaped_html(spark, d):
    from ..functions.text import escape_html

    return read(spark, d, "pages").select("page_id", F.md5(escape_html("html").cast("binary")).alias("escaped_md5"))


def q46_markdown_round_trip(spark, d):
    """Markdown read, written and read again: the second writing equals the first."""
    from ..sources import markdown as M

    docs = read(spark, d, "documents").select("doc_id", synthesised().alias("text"))
    once = M.normalise(docs)
    twice = M.normalise(once.select("doc_id", F.col("markdown").alias("text"), F.md5(F.col("markdown").cast("binary")).alias("markdown_md5")), "markdown_md5")
    return twice.select("doc_id", "markdown_md5", (F.md5(F.col("markdown").cast("binary")) == F.col("markdown_md5")).alias("fixed_point"))


def q48_cover_zones(spark, d):
    z = B.split_at_pagebreak(B.cover_zones(_blocks(spark, d)))
    return z.groupBy("doc_id").agg(*[F.count_if(F.col("zone") == x).alias(f"n_{x}") for x in ("panel", "flowing", "foot")], F.count_if(F.col("t") == "rule").alias("n_rules"), F.count_if(F.col("part") == "page").alias("n_page"))


def _spans():
    """Two texts in a link, one of them in an element within, and one of no element; every few lack something."""
    node = lambda t, n, href: F.struct(t.alias("t"), href.alias("href"), F.lit(n).alias("node"))
    link = node(F.lit("link"), 1, F.when(F.col("l_partkey") % 4 > 0, "http://x"))
    inner = node(F.when(F.col("l_partkey") % 6 > 0, "em").otherwise("blink"), 2, F.lit(None).cast("string"))
    text = lambda v, *path: F.struct(v.alias("v"), (F.array(*path) if path else F.array().cast(f"array<{B.NODE}>")).alias("path"))
    return F.array(text(F.lit("a"), link), text(F.lit("b"), link, inner), text(F.when(F.col("l_partkey") % 5 > 0, "c")))


def q49_violations(spark, d):
    """Blocks made of line items, with rules broken by position."""
    li = read(spark, d, "lineitem")
    k = F.col("l_orderkey") + F.col("l_linenumber")
    t = F.element_at(F.lit(["heading", "list", "table", "image", "chart"]), (k % 5 + 1).cast("int"))
    b = li.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("block_ix"), t.alias("t"), (F.col("l_linenumber") % 5).cast("int").alias("level"), (F.col("l_linenumber") - 2).cast("int").alias("depth"), (F.col("l_quantity") % 4).cast("int").alias("start"), (F.col("l_partkey") % 3).cast("int").alias("n_cols"), (F.col("l_suppkey") % 3).cast("int").alias("n_aligned"), F.when(F.col("l_tax") > 0.04, "x.png").otherwise("").alias("src"), _spans().alias("spans"))
    return B.violations(b).groupBy("why").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_docs"))


def q49b_ragged_rows(spark, d):
    li = read(spark, d, "lineitem")
    body = li.select(F.col("l_suppkey").alias("doc_id"), F.lit(0).alias("block_ix"), F.col("l_orderkey").alias("row_ix"))
    head = read(spark, d, "supplier").select(F.col("s_suppkey").alias("doc_id"), F.lit(0).alias("block_ix"), F.lit(-1).cast("long").alias("row_ix"))
    return B.ragged_rows(body.unionByName(head)).groupBy("doc_id").agg(F.count("*").alias("n_ragged"), F.max("n_cells").alias("most_cells"))


QUERIES = {f.__name__: f for f in (q01_block_counts, q02_tokens, q03_first_divergence, q33_heading_jumps, q33b_warnings, q44_escaped_html, q45_table_markdown, q46_markdown_round_trip, q48_cover_zones, q49_violations, q49b_ragged_rows)}

_COUNTS = ", ".join(f"CAST(count(*) FILTER (t = '{k}') AS BIGINT) AS n_{k}" for k in KINDS)
_ZERO = ", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in KINDS)
_JUMPS = "jumps AS (SELECT doc_id, level, lag(level) OVER (PARTITION BY doc_id ORDER BY block_ix) AS was, row_number() OVER (PARTITION BY doc_id ORDER BY block_ix) AS ordinal FROM rest WHERE t = 'heading')"

ORACLE = {
    # blocks have one form each, a blank line stands between them, and what is written is read as the same blocks
    "q46_markdown_round_trip": f"""
WITH {ORACLE_BLOCKS},
b AS (SELECT doc_id, block_ix, CASE t WHEN 'heading' THEN repeat('#', level::INTEGER) || ' ' || trim(text) WHEN 'rule' THEN '---' WHEN 'pagebreak' THEN '<!-- pagebreak -->' WHEN 'list' THEN '- ' || trim(text) ELSE trim(text) END AS md FROM rest),
titles AS (SELECT doc_id, coalesce(max(CASE WHEN block_ix = title_ix THEN trim(text) END), 'Untitled') AS title FROM lifted GROUP BY doc_id),
m AS (SELECT titles.doc_id, '# ' || title || coalesce(chr(10) || chr(10) || string_agg(md, chr(10) || chr(10) ORDER BY block_ix), '') || chr(10) AS markdown FROM titles LEFT JOIN b ON b.doc_id = titles.doc_id GROUP BY titles.doc_id, title)
SELECT doc_id, md5(markdown) AS markdown_md5, true AS fixed_point FROM m""",
    "q01_block_counts": f"""
WITH {ORACLE_BLOCKS}, {_JUMPS},
titles AS (SELECT doc_id, coalesce(max(CASE WHEN block_ix = title_ix THEN text END), 'Untitled') AS title FROM lifted GROUP BY doc_id),
counts AS (SELECT doc_id, {_COUNTS}, sum(CASE WHEN t IN ('para','heading','quote','list','table','code') THEN len({oracle_tokens('text')}) END) AS n_tokens FROM rest GROUP BY doc_id),
j AS (SELECT doc_id, count(*) AS n FROM jumps WHERE level > was + 1 GROUP BY doc_id)
SELECT doc_id, title, {_ZERO}, CAST(coalesce(n_tokens, 0) AS BIGINT) AS n_tokens, CAST(coalesce(j.n, 0) + CASE WHEN title = 'Untitled' THEN 1 ELSE 0 END AS BIGINT) AS n_warnings
FROM titles LEFT JOIN counts USING (doc_id) LEFT JOIN j USING (doc_id)""",
    "q02_tokens": f"""
WITH d AS (SELECT doc_id, text FROM documents UNION ALL SELECT -1, '€' || chr(160) || '4' || chr(160) || '500,00' UNION ALL SELECT -2, 'soft' || chr(173) || 'hyphen'
 UNION ALL SELECT -3, chr(64257) || 'gure ' || chr(64258) || 'ow' UNION ALL SELECT -4, 'a' || chr(8195) || 'b' || chr(12288) || 'c'),
w AS (SELECT doc_id, {oracle_tokens('text')} AS w FROM d)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_tokens, CAST(len(list_distinct(w)) AS BIGINT) AS n_distinct FROM w""",
    "q03_first_divergence": f"""
WITH w AS (SELECT doc_id, {oracle_tokens('text')} AS w FROM documents)
SELECT doc_id, CAST(6 AS BIGINT) AS pos, w[7] AS expected, w[8] AS found FROM w WHERE len(w) >= 7 AND (len(w) = 7 OR w[8] <> w[7])
UNION ALL
SELECT doc_id, p, expected, found FROM (
  SELECT doc_id, p, expected, found, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS r FROM (
    SELECT doc_id, CAST(p AS BIGINT) AS p, w[p + 1] AS expected, list_filter(w, lambda x, i: (i - 1) % 7 <> 6)[p + 1] AS found
    FROM w, range(0, 100000) t(p) WHERE len(w) >= 8 AND w[8] = w[7] AND p < len(w)) WHERE expected IS DISTINCT FROM found) WHERE r = 1""",
    "q33_heading_jumps": """
WITH h AS (SELECT user_id AS doc_id, event_id, CAST(event_id % 3 + 1 AS INTEGER) AS to_level, event_type AS text,
  lag(CAST(event_id % 3 + 1 AS INTEGER)) OVER w AS from_level, row_number() OVER w AS ordinal FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT doc_id, CAST(ordinal AS BIGINT) AS ordinal, from_level, to_level, text FROM h WHERE to_level > from_level + 1""",
    "q33b_warnings": """
WITH b AS (SELECT user_id AS doc_id, event_id AS ix, CASE event_id % 4 WHEN 0 THEN 'table' WHEN 1 THEN 'image' ELSE 'heading' END AS t, CASE WHEN user_id % 5 = 0 THEN 2 + event_id % 2 ELSE 1 + event_id // 2 % 3 END AS level, event_type AS text, event_id // 4 % 14 AS n_cols, event_id % 8 = 1 AS good FROM events),
l AS (SELECT *, min(CASE WHEN t = 'heading' AND level = 1 THEN ix END) OVER (PARTITION BY doc_id) AS title_ix FROM b),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, t ORDER BY ix) AS n, lag(level) OVER (PARTITION BY doc_id, t ORDER BY ix) AS was FROM l WHERE ix IS DISTINCT FROM title_ix)
SELECT DISTINCT doc_id, 'untitled' AS kind, CAST(0 AS BIGINT) AS ordinal, 'no title found' AS message FROM l WHERE title_ix IS NULL
UNION ALL SELECT doc_id, 'heading_jump', n, 'heading levels jump H' || was || '→H' || level || ' at heading ' || n || ' ("' || text || '")' FROM o WHERE t = 'heading' AND level > was + 1
UNION ALL SELECT doc_id, 'wide_table', n, 'table ' || n || ' has ' || n_cols || ' columns (will not fit A4 portrait)' FROM o WHERE t = 'table' AND n_cols > 10
UNION ALL SELECT doc_id, 'image', n, 'image ' || n || ' will not embed in Word' FROM o WHERE t = 'image' AND NOT good""",
    "q44_escaped_html": """
SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;')) AS escaped_md5 FROM pages""",
    "q45_table_markdown": r"""
SELECT r_name, '| nation | key |' || chr(10) || '| :-- | --: |' || chr(10) || string_agg('| ' || n_name || '\|x | ' || n_nationkey || ' |', chr(10) ORDER BY n_name || '|x') AS markdown
FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""",
    "q48_cover_zones": f"""
WITH {ORACLE_BLOCKS},
z AS (SELECT *, min(CASE WHEN t = 'rule' THEN block_ix END) OVER w AS a, max(CASE WHEN t = 'rule' THEN block_ix END) OVER w AS b, min(CASE WHEN t = 'pagebreak' THEN block_ix END) OVER w AS p FROM blocks WINDOW w AS (PARTITION BY doc_id))
SELECT doc_id, count(*) FILTER (t <> 'rule' AND block_ix < a) AS n_panel, count(*) FILTER (t <> 'rule' AND (a IS NULL OR (block_ix > a AND (block_ix < b OR a = b)))) AS n_flowing,
 count(*) FILTER (t <> 'rule' AND block_ix > b AND b > a) AS n_foot, count(*) FILTER (t = 'rule') AS n_rules, count(*) FILTER (p IS NULL OR block_ix < p) AS n_page FROM z GROUP BY doc_id""",
    "q49_violations": """
WITH b AS (SELECT l_orderkey AS doc_id, ['heading','list','table','image','chart'][(l_orderkey + l_linenumber) % 5 + 1] AS t, l_linenumber % 5 AS level, l_linenumber - 2 AS depth,
  CAST(l_quantity AS INTEGER) % 4 AS start, l_partkey % 3 AS n_cols, l_suppkey % 3 AS n_aligned, l_tax > 0.04 AS has_src, l_partkey AS p FROM lineitem),
v AS (SELECT doc_id, 'unknown block type' AS why FROM b WHERE t = 'chart'
 UNION ALL SELECT doc_id, 'a link needs a target' FROM b WHERE p % 4 = 0
 UNION ALL SELECT doc_id, 'unknown inline type blink' FROM b WHERE p % 6 = 0
 UNION ALL SELECT doc_id, 'a text needs a value' FROM b WHERE p % 5 = 0
 UNION ALL SELECT doc_id, 'level must be 1, 2 or 3' FROM b WHERE t = 'heading' AND level NOT BETWEEN 1 AND 3
 UNION ALL SELECT doc_id, 'list needs a non-negative depth' FROM b WHERE t = 'list' AND depth < 0
 UNION ALL SELECT doc_id, 'start must be a positive integer' FROM b WHERE t = 'list' AND start < 1
 UNION ALL SELECT doc_id, 'a table needs at least one column' FROM b WHERE t = 'table' AND n_cols = 0
 UNION ALL SELECT doc_id, 'align differs from the columns' FROM b WHERE t = 'table' AND n_aligned <> n_cols
 UNION ALL SELECT doc_id, 'image needs a non-empty src' FROM b WHERE t = 'image' AND NOT has_src)
SELECT why, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM v GROUP BY why""",
    "q49b_ragged_rows": """
WITH n AS (SELECT l_suppkey AS doc_id, l_orderkey, count(*) AS c FROM lineitem GROUP BY ALL)
SELECT doc_id, count(*) AS n_ragged, max(c) AS most_cells FROM n WHERE c <> 1 AND doc_id IN (SELECT s_suppkey FROM supplier) GROUP BY doc_id""",
}
