"""Documents from pages: declared furniture, tables that go on over pages, and the gate that compares tokens.

``runs(doc_id, page, run_ix, text, x, y, size_pt)``; ``xs`` and ``ys`` are grid lines (doc_id, page, ix, value)
and ``cells(doc_id, page, row, col, text)`` what stands in the grid, as ``pages.find_grids`` and
``pages.table_cells`` give them. A document has sixty pages at most, so its rows are windowed together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokenise
from ..sources.base import kept
from . import blocks as B
from . import pages as P
from .config import listed

KEY = ["doc_id", "page"]


def page_tables(cells: DataFrame) -> DataFrame:
    """(doc_id, page, head, rows): the first row of each page's grid and the others."""
    texts = lambda name: F.transform(F.array_sort(F.collect_list(F.struct(name, "text"))), lambda x: x["text"])
    rows = cells.groupBy(*KEY, "row").agg(texts("col").alias("text"))
    return rows.groupBy(*KEY).agg(texts("row").alias("all")).select(*KEY, F.col("all")[0].alias("head"), F.slice("all", 2, 2**31 - 1).alias("rows"))


def zoned(runs: DataFrame, xs: DataFrame, ys: DataFrame) -> DataFrame:
    """runs with ``zone`` (0 above the grid or on a page without one, 1 in the grid, 2 below or beside it),
    ``line`` (its row from the grid's top, found from y alone) and ``has_grid``."""
    lines = lambda d, name: d.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.col("value").cast("double"))).alias(name))
    at = runs.join(lines(xs, "_xs").join(lines(ys, "_ys"), KEY), KEY, "left")
    inside = lambda v, name: (F.col(v) >= F.array_min(name)) & (F.col(v) < F.array_max(name))
    zone = F.when(F.col("_ys").isNull(), 0).when(inside("x", "_xs") & inside("y", "_ys"), 1).when(F.col("y") >= F.array_max("_ys"), 0).otherwise(2)
    line = F.when(zone == 1, F.size(F.filter("_ys", lambda v: v > F.col("y"))) - 1).otherwise(0)
    return at.select(*runs.columns, zone.alias("zone"), line.alias("line"), F.col("_ys").isNotNull().alias("has_grid"))


def free_tables(placed: DataFrame) -> DataFrame:
    """(doc_id, page, free): whether only repeated furniture lies between a page's grid and the grid before it,
    on pages without a grid between them too.

    placed(doc_id, page, zone, has_grid, repeated). What else stands on a page is counted, carried up to its
    grid and compared with the count behind the last grid.
    """
    other = lambda zone: F.count_if(F.col("has_grid") & (F.col("zone") == zone) & ~F.col("repeated"))
    bare = F.count_if(~F.col("has_grid") & ~F.col("repeated"))
    pages = placed.groupBy(*KEY).agg(F.max("has_grid").alias("has_grid"), other(0).alias("above"), other(2).alias("below"), bare.alias("bare"))
    up_to = Window.partitionBy("doc_id").orderBy("page")
    total = F.sum(F.col("above") + F.col("below") + F.col("bare")).over(up_to.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # as of the last page with a grid: what was counted before its own lower part
    passed = pages.withColumn("passed", F.when(F.col("has_grid"), total - F.col("below")))
    last = F.last("passed", ignorenulls=True).over(up_to.rowsBetween(Window.unboundedPreceding, -1))
    return passed.withColumn("last", last).where("has_grid").select(*KEY, F.coalesce(F.col("passed") == F.col("last"), F.lit(False)).alias("free"))


def chrome(runs: DataFrame, rules: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(runs that stay, messages (doc_id, kind, message)): what a document's declared lines (doc_id, above, below)
    remove, or, where they remove nothing, why, and what repeats on every page."""
    none = rules is None
    if none:
        rules = runs.select("doc_id").distinct().limit(0).select("doc_id", F.lit(None).cast("double").alias("above"), F.lit(None).cast("double").alias("below"))
    if none:  # without a join, which would go from the plan, but the hint of large runs with it
        ruled = runs.withColumns({"_a": F.lit(None).cast("double"), "_b": F.lit(None).cast("double")})
    else:
        good = rules.join(P.rule_violations(rules, "above", "below").select("doc_id"), "doc_id", "left_anti")
        ruled = runs.join(good.select("doc_id", F.col("above").alias("_a"), F.col("below").alias("_b")), "doc_id", "left")
    split = P.split_chrome(ruled, F.col("_a"), F.col("_b"))
    gone = split.where("removed").groupBy("doc_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("text")).alias("texts"))
    removed = gone.select("doc_id", F.lit("furniture").alias("kind"), F.concat(F.lit("page furniture: "), F.col("n").cast("string"), F.lit(" runs removed by the declared rule: "), listed(F.col("texts"))).alias("message"))
    report = P.chrome_report(split, ["doc_id"], F.col("_a"), F.col("_b"))
    why = F.when(F.col("has_rule"), F.format_string("the declared rule removed nothing: runs lie from y=%s to y=%s", F.col("y_min").cast("string"), F.col("y_max").cast("string"))).when(F.col("n_pages") < 2, "page furniture was not looked for: a single page has nothing to compare with")
    idle = report.where("n_removed = 0").select("doc_id", F.lit("advisory").alias("kind"), why.alias("message")).where("message is not null")
    body = split.where(~F.col("removed")).drop("removed", "_a", "_b")
    repeated = P.find_repeated(body.join(gone.select("doc_id"), "doc_id", "left_anti"), ["doc_id"])
    advisory = repeated.select("doc_id", F.lit("advisory").alias("kind"), F.concat(F.lit("repeats on every page: "), F.array_join("texts", " / ")).alias("message"))
    bad = P.rule_violations(rules, "above", "below").select("doc_id", F.lit("rule").alias("kind"), F.col("why").alias("message"))
    return body, removed.unionByName(idle).unionByName(advisory).unionByName(bad)


def assemble(runs: DataFrame, xs: DataFrame, ys: DataFrame, cells: DataFrame) -> dict[str, DataFrame]:
    """blocks (doc_id, block_ix, t, level, text, head, rows, page) in reading order, the furniture that joined tables
    leave out (dropped), and the documents whose blocks don't hold the source's tokens in the source's order (divergence)."""
    texts = P.find_repeated(runs, ["doc_id"]).select("doc_id", F.explode("texts").alias("text")).distinct().withColumn("repeated", F.lit(True))
    placed = kept(zoned(runs, xs, ys).join(texts, ["doc_id", "text"], "left").withColumn("repeated", F.coalesce("repeated", F.lit(False))))

    lines = xs.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.col("value").cast("double"))).alias("xs"))
    tables = page_tables(cells).join(lines, KEY).join(free_tables(placed), KEY, "left").withColumn("free", F.coalesce("free", F.lit(False)))
    tables = kept(tables)
    numbered = tables.join(P.continue_tables(tables, ["doc_id"]), KEY)
    ordered = Window.partitionBy("doc_id").orderBy("page")
    next_page = F.lead("page").over(ordered) == F.col("page") + 1
    numbered = numbered.withColumns({"joins": F.col("table_no").eqNullSafe(F.lag("table_no").over(ordered)), "goes_on": next_page & F.col("table_no").eqNullSafe(F.lead("table_no").over(ordered))})

    # between the halves of a joined table furniture is not printed again, on either page; that of pages without a grid
    # between them stays, and the gate then refuses the document, whose source has it in the midst of the table
    numbered = kept(numbered)
    marks = numbered.select(*KEY, "joins", "goes_on")
    out = (F.col("joins") & (F.col("zone") == 0)) | (F.col("goes_on") & (F.col("zone") == 2))
    marked = placed.join(marks, KEY, "left").withColumn("out", F.coalesce(out, F.lit(False))).drop("joins", "goes_on")
    dropped = marked.where("out").groupBy(*KEY, "zone").agg(F.array_sort(F.collect_set("text")).alias("texts"))
    dropped = dropped.select("doc_id", F.lit("furniture").alias("kind"), F.concat(F.lit("page "), (F.col("page") + 1).cast("string"), F.lit(": repeated furniture between two halves of a table is not repeated: "), listed(F.col("texts"))).alias("message"))
    stay = marked.where("not out").drop("out")

    order = [F.col("doc_id"), F.col("page"), F.col("zone")]
    levels = P.heading_levels(runs.withColumn("run_ix", F.col("page") * 1_000_000 + F.col("run_ix")), ["doc_id"])
    sized = stay.where("zone <> 1").withColumn("half_pt", F.floor(F.col("size_pt") * 2 + 0.5).cast("int")).join(levels, ["doc_id", "half_pt"], "left")
    nothing = {"head": F.lit(None).cast("array<string>"), "rows": F.lit(None).cast("array<array<string>>")}
    prose = sized.select(*order, (-F.col("y")).alias("k1"), F.col("x").alias("k2"), F.col("run_ix").cast("long").alias("k3"), F.when(F.col("level").isNull(), "para").otherwise("heading").alias("t"), "level", "text", *[v.alias(k) for k, v in nothing.items()])
    fragment = F.struct("page", "head", F.when(F.col("joins"), F.concat(F.array("head"), F.col("rows"))).otherwise(F.col("rows")).alias("rows"))
    whole = numbered.groupBy("doc_id", "table_no").agg(F.array_sort(F.collect_list(fragment)).alias("f"))
    whole = whole.select("doc_id", F.col("f")[0]["page"].alias("page"), F.col("f")[0]["head"].alias("head"), F.flatten(F.transform("f", lambda x: x["rows"])).alias("rows"))
    table_text = F.array_join(F.flatten(F.concat(F.array("head"), F.col("rows"))), " ")
    zero = F.lit(0.0)
    table = whole.select("doc_id", "page", F.lit(1).alias("zone"), zero.alias("k1"), zero.alias("k2"), F.lit(0).cast("long").alias("k3"), F.lit("table").alias("t"), F.lit(None).cast("int").alias("level"), table_text.alias("text"), "head", "rows")
    place = Window.partitionBy("doc_id").orderBy("page", "zone", "k1", "k2", "k3")
    blocks = prose.unionByName(table).select("doc_id", (F.row_number().over(place) - 1).cast("long").alias("block_ix"), "t", "level", "text", "head", "rows", "page")

    return {"blocks": blocks, "dropped": dropped, "divergence": B.first_divergence(source_tokens(stay), B.doc_tokens(blocks))}


def source_tokens(placed: DataFrame) -> DataFrame:
    """(doc_id, tokens) in the source's own order, which no cell decides: prose from the top, then from the left; a grid
    row by row, and within a row from the left, then from the top."""
    table = F.col("zone") == 1
    first, second = F.when(table, F.col("x")).otherwise(-F.col("y")), F.when(table, -F.col("y")).otherwise(F.col("x"))
    piece = F.struct("page", "zone", "line", first.alias("k1"), second.alias("k2"), "run_ix", tokenise("text").alias("words"))
    return placed.groupBy("doc_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(piece)), lambda p: p["words"])).alias("tokens"))
