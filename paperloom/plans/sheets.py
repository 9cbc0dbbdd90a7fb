"""Queries over spreadsheets: cleaning, lookups, dates, references."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import letters_to_index
from ..operators import sheets as S
from .base import read

KEY = ["sheet"]


def _cells(spark, d):
    """Orders as the sheets of customers, one each: an empty column, blank rows and a caption above them. The
    orders of every fourth lie far apart, so that its sheet is too large."""
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    o = read(spark, d, "orders").withColumn("row", F.when(F.col("o_custkey") % 4 == 0, F.col("o_orderkey")).otherwise(place) + 10)
    body = o.select(F.col("o_custkey").alias("sheet"), "row", F.posexplode(F.array(F.col("o_orderstatus"), F.lit(""), F.col("o_orderpriority"), F.col("o_totalprice").cast("string"))).alias("col", "text"))
    heads = o.select(F.col("o_custkey").alias("sheet")).distinct()
    top = heads.select("sheet", F.explode(F.lit([0, 1, 2, 3])).alias("row"))
    caption = top.select("sheet", F.col("row").cast("long").alias("row"), F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.when((F.col("row") == 2) & F.lit(c == 0), "Register").when(F.col("row") == 3, F.lit(["status", "", "priority", "total"][c])).otherwise("").alias("text")) for c in range(4)])).alias("x")).select("sheet", "row", "x.col", "x.text")
    return body.unionByName(caption).withColumn("is_numeric", (F.col("col") == 3) & (F.col("row") > 3))


def q15_kept_columns(spark, d):
    return S.drop_empty_columns(_cells(spark, d), KEY).groupBy("sheet", "col").agg(F.count("*").alias("n"), F.max("text").alias("largest"))


def q15b_used_range(spark, d):
    return S.used_range(_cells(spark, d), KEY)


def q16_preamble(spark, d):
    c = S.lift_preamble(S.trim_leading_rows(_cells(spark, d), KEY), KEY)
    return c.groupBy("sheet", "part").agg(F.count_distinct("row").alias("n_rows"), F.min("row").alias("first_row"))


def q17_headers(spark, d):
    return S.header_rows(S.drop_empty_columns(_cells(spark, d), KEY), KEY).select("sheet", "row", "is_header")


def q18_trimmed(spark, d):
    return S.trim_leading_rows(_cells(spark, d), KEY).groupBy("sheet").agg(F.min("row").alias("first_row"), F.count("*").alias("n"))


def q18b_refusals(spark, d):
    return S.refusals(_cells(spark, d), KEY)


def q19_references(spark, d):
    p = read(spark, d, "part")
    letters = lambda n: F.concat(F.char(65 + n % 26), F.char(65 + (n * 7) % 26))
    ref = F.concat(letters(F.col("p_size")), F.col("p_size").cast("string"), F.lit(":"), letters(F.col("p_partkey")), F.when(F.col("p_partkey") % 10 > 0, F.col("p_partkey").cast("string")).otherwise(""))
    r = S.parse_range(ref)
    return p.select("p_partkey", letters_to_index(letters(F.col("p_partkey"))).alias("index"), *[r[k].alias(k) for k in ("r1", "c1", "r2", "c2")])


def q20_serial_dates(spark, d):
    o = read(spark, d, "orders")
    serial = F.datediff("o_orderdate", F.lit("1899-12-30").cast("date")) + (F.col("o_orderkey") % 24) / F.lit(24.0)
    return o.select("o_orderkey", S.serial_to_text(serial).alias("text1900"), S.serial_to_text(serial - 1462, F.lit(True)).alias("text1904"))


def q21_shared_strings(spark, d):
    e = read(spark, d, "events").select(F.col("user_id").alias("doc_id"), "event_id", F.pmod("event_id", F.lit(6)).cast("int").alias("ix"))
    strings = e.select("doc_id").distinct().select("doc_id", F.posexplode(F.lit(["signup", "error", "click", "view"])).alias("ix", "text"))
    return S.shared_strings(e, strings, ["doc_id"]).select("event_id", "text", "missed")


def q22_date_formats(spark, d):
    p = read(spark, d, "part").select("p_partkey", F.col("p_size").alias("s"))
    xfs = p.select("s").distinct().where("s % 11 <> 0").select("s", (F.col("s") + 10).alias("num_fmt_id"))
    code = F.when(F.col("num_fmt_id") % 3 == 0, '"day" 0.00').when(F.col("num_fmt_id") % 3 == 1, "[$-409]d\\-mmm;@").otherwise("[Red]0")
    formats = xfs.where("num_fmt_id > 40").select("num_fmt_id", code.alias("code"))
    out = p.join(xfs, "s", "left").join(formats, "num_fmt_id", "left")
    return out.select("p_partkey", "num_fmt_id", F.when(F.col("num_fmt_id").isNotNull(), S.is_date_format("num_fmt_id", "code")).alias("is_date"))


def q22b_merges(spark, d):
    """Ranges of two rows and two columns from each sheet's tenth row on."""
    c = _cells(spark, d)
    m = c.select("sheet").distinct().select("sheet", F.lit(2).cast("long").alias("r1"), F.lit(0).alias("c1"), F.lit(3).cast("long").alias("r2"), F.lit(2).alias("c2"))
    return S.flatten_merges(c, m, KEY).groupBy("sheet").agg(F.count_if(F.col("text") != "").alias("n_text"), F.count_if("is_numeric").alias("n_numeric"))


QUERIES = {f.__name__: f for f in (q15_kept_columns, q15b_used_range, q16_preamble, q17_headers, q18_trimmed, q18b_refusals, q19_references, q20_serial_dates, q21_shared_strings, q22_date_formats, q22b_merges)}

_C = """c AS (SELECT o_custkey AS sheet, CASE WHEN o_custkey % 4 = 0 THEN o_orderkey ELSE row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) END + 10 AS row, unnest([0, 1, 2, 3]) AS col, unnest([o_orderstatus, '', o_orderpriority, 'n']) AS text, unnest([false, false, false, true]) AS num FROM orders
 UNION ALL SELECT sheet, r, k, CASE WHEN r = 2 AND k = 0 THEN 'Register' WHEN r = 3 THEN ['status', '', 'priority', 'total'][k + 1] ELSE '' END, false FROM (SELECT DISTINCT o_custkey AS sheet FROM orders), range(0, 4) a(r), range(0, 4) b(k))"""
_IX = lambda n: f"((({n}) % 26 + 1) * 26 + (({n}) * 7) % 26)"
ORACLE = {
    "q15_kept_columns": """WITH o AS (SELECT o_custkey AS sheet, o_orderstatus, o_orderpriority, CAST(o_totalprice AS VARCHAR) AS v FROM orders)
 SELECT sheet, 0 AS col, count(*) + 4 AS n, greatest(max(o_orderstatus), 'status') AS largest FROM o GROUP BY sheet
 UNION ALL SELECT sheet, 1, count(*) + 4, greatest(max(o_orderpriority), 'priority') FROM o GROUP BY sheet UNION ALL SELECT sheet, 2, count(*) + 4, 'total' FROM o GROUP BY sheet""",
    "q15b_used_range": f"WITH {_C} SELECT sheet, min(row) AS r1, max(row) AS r2, min(CAST(col AS INTEGER)) AS c1, max(CAST(col AS INTEGER)) AS c2, count(*) AS n_cells FROM c GROUP BY sheet",
    "q16_preamble": f"WITH {_C} SELECT sheet, CASE WHEN row = 2 THEN 'preamble' ELSE 'table' END AS part, count(DISTINCT row) AS n_rows, min(row) AS first_row FROM c WHERE row >= 2 GROUP BY ALL",
    "q17_headers": f"WITH {_C} SELECT sheet, row, NOT bool_or(num) AND count(*) FILTER (trim(text) <> '') / 3.0 >= 0.6 AS is_header FROM c WHERE col <> 1 GROUP BY sheet, row",
    "q18_trimmed": f"WITH {_C} SELECT sheet, min(row) AS first_row, count(*) AS n FROM c WHERE row >= 2 GROUP BY sheet",
    "q18b_refusals": f"""WITH {_C}, r AS (SELECT sheet, max(row) - min(row) + 1 AS rows, 4 AS cols FROM c GROUP BY sheet)
 SELECT sheet, CASE WHEN rows * 4 > 1000000 OR rows > 200 THEN 'refused' ELSE 'ok' END AS status, CASE WHEN rows * 4 > 1000000 THEN (rows * 4) || ' cells' WHEN rows > 200 THEN rows || ' rows and 4 columns' END AS reason, rows, cols FROM r""",
    "q19_references": f"""SELECT p_partkey, CAST({_IX('p_partkey')} AS BIGINT) AS index, CASE WHEN p_partkey % 10 > 0 THEN CAST(p_size - 1 AS BIGINT) END AS r1, CASE WHEN p_partkey % 10 > 0 THEN CAST({_IX('p_size')} AS BIGINT) END AS c1,
 CASE WHEN p_partkey % 10 > 0 THEN p_partkey - 1 END AS r2, CASE WHEN p_partkey % 10 > 0 THEN CAST({_IX('p_partkey')} AS BIGINT) END AS c2 FROM part""",
    "q20_serial_dates": """WITH t AS (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') || CASE WHEN o_orderkey % 24 = 0 THEN '' ELSE ' ' || lpad(CAST(o_orderkey % 24 AS VARCHAR), 2, '0') || ':00' END AS x FROM orders)
 SELECT o_orderkey, x AS text1900, x AS text1904 FROM t""",
    "q21_shared_strings": "SELECT event_id, CASE WHEN event_id % 6 < 4 THEN ['signup', 'error', 'click', 'view'][event_id % 6 + 1] ELSE '' END AS text, event_id % 6 >= 4 AS missed FROM events",
    "q22_date_formats": """SELECT p_partkey, CASE WHEN p_size % 11 <> 0 THEN p_size + 10 END AS num_fmt_id, CASE WHEN p_size % 11 <> 0 THEN
 (p_size + 10 BETWEEN 14 AND 22 OR p_size + 10 BETWEEN 27 AND 36 OR p_size + 10 BETWEEN 45 AND 47 OR p_size + 10 BETWEEN 50 AND 58 OR (p_size + 10 > 40 AND (p_size + 10) % 3 = 1)) END AS is_date FROM part""",
    "q22b_merges": f"WITH {_C} SELECT sheet, count(*) FILTER (text <> '' AND NOT (row BETWEEN 2 AND 3 AND col <= 2 AND NOT (row = 2 AND col = 0))) AS n_text, count(*) FILTER (num) AS n_numeric FROM c GROUP BY sheet",
}
