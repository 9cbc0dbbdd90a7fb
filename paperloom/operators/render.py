"""Markdown and HTML of blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.links import image_markup
from ..functions.text import col, escape_html
from .blocks import cover_zones, split_at_pagebreak

ALIGN = {"l": ":--", "r": "--:", "c": ":-:"}


def cell(text) -> Column:
    """A table cell's text: pipes escaped, line breaks as blanks."""
    return F.replace(F.replace(col(text), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def fence(text) -> Column:
    """Back quotes that are longer than any run of them in the text, three at least."""
    runs = F.transform(F.regexp_extract_all(col(text), F.lit("(`+)")), F.length)
    return F.repeat(F.lit("`"), F.greatest(F.lit(3), F.coalesce(F.array_max(runs), F.lit(0)) + 1))


def separator_row(align: Column) -> Column:
    marks = F.transform(align, lambda a: F.when(a == "l", ALIGN["l"]).when(a == "r", ALIGN["r"]).otherwise(ALIGN["c"]))
    return F.concat(F.lit("| "), F.array_join(marks, " | "), F.lit(" |"))


def table_row(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(F.transform(cells, cell), " | "), F.lit(" |"))


def table_markdown(head: Column, align: Column, rows: Column) -> Column:
    return F.concat_ws("\n", table_row(head), separator_row(align), F.array_join(F.transform(rows, table_row), "\n"))


def heat_marks(style: Column, rows: Column) -> Column:
    """A heatmap's rows (label, then numbers as text) as cells: squares for 'marks', else the number if there is one."""
    value = lambda v: F.coalesce(F.try_to_number(v, F.lit("999999999.999999")).cast("double"), F.lit(0.0))
    numbers = lambda r: F.slice(r, 2, F.greatest(F.size(r) - 1, F.lit(0)))
    most = F.coalesce(F.array_max(F.flatten(F.transform(rows, lambda r: F.transform(numbers(r), value)))), F.lit(0.0))
    step = lambda v: F.when((value(v) <= 0) | (most <= 0), 0).otherwise(F.least(F.lit(3), F.ceil(value(v) / most * 3))).cast("int")
    mark = lambda v: F.when(style == "marks", F.repeat(F.lit("▪"), step(v))).otherwise(F.when(value(v) > 0, v).otherwise(""))
    return F.transform(rows, lambda r: F.concat(F.slice(r, 1, 1), F.transform(numbers(r), mark)))


def heat_markdown(style: Column, head: Column, rows: Column) -> Column:
    return table_markdown(head, F.transform(head, lambda _, i: F.when(i == 0, "l").otherwise("c")), heat_marks(style, rows))


def span_markup(spans: Column, open_, close_, leaf=lambda v: v) -> Column:
    """Markup of spans (v, path of t, href, node): what a span shares with its neighbours stays open."""
    step = lambda acc, s: F.struct(
        F.concat(acc["out"], close_(_beyond(acc["path"], s["path"])), open_(_beyond(s["path"], acc["path"])), leaf(F.coalesce(s["v"], F.lit("")))).alias("out"),
        s["path"].alias("path"),
    )
    path = "array<struct<t:string,href:string,node:int>>"
    start = F.struct(F.lit("").alias("out"), F.array().cast(path).alias("path"))
    return F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], close_(acc["path"])))


def _beyond(path: Column, other: Column) -> Column:
    """The part of a path from where it differs from another one."""
    same = F.size(F.filter(F.transform(path, lambda p, i: F.coalesce(F.forall(F.sequence(F.lit(0), i), lambda k: F.get(path, k).eqNullSafe(F.get(other, k))), F.lit(False))), lambda x: x))
    return F.slice(path, same + 1, F.greatest(F.size(path) - same, F.lit(0)))


def spans_markdown(spans: Column) -> Column:
    """Inline Markdown; a link whose scheme is refused becomes its text and where it pointed."""
    from ..functions.links import refused_target, scheme_is_refused

    start = lambda e: F.when(e["t"] == "strong", "**").when(e["t"] == "em", "*").when(e["t"] == "code", "`").when((e["t"] == "link") & ~scheme_is_refused(e["href"]), "[").otherwise("")
    end = lambda e: F.when(e["t"] == "strong", "**").when(e["t"] == "em", "*").when(e["t"] == "code", "`").when(e["t"] == "link", F.when(scheme_is_refused(e["href"]), F.concat(F.lit(" ("), refused_target(e["href"]), F.lit(")"))).otherwise(F.concat(F.lit("]("), e["href"], F.lit(")")))).otherwise("")
    return span_markup(spans, lambda p: F.array_join(F.transform(p, start), ""), lambda p: F.array_join(F.reverse(F.transform(p, end)), ""))


def spans_html(spans: Column) -> Column:
    from ..functions.links import refused_target, scheme_is_refused

    start = lambda e: F.when(e["t"] == "link", F.when(scheme_is_refused(e["href"]), "").otherwise(F.concat(F.lit('<a href="'), escape_html(e["href"]), F.lit('">')))).otherwise(F.concat(F.lit("<"), e["t"], F.lit(">")))
    end = lambda e: F.when(e["t"] == "link", F.when(scheme_is_refused(e["href"]), F.concat(F.lit(' <span class="muted">('), escape_html(refused_target(e["href"])), F.lit(")</span>"))).otherwise("</a>")).otherwise(F.concat(F.lit("</"), e["t"], F.lit(">")))
    return span_markup(spans, lambda p: F.array_join(F.transform(p, start), ""), lambda p: F.array_join(F.reverse(F.transform(p, end)), ""), escape_html)


def block_markdown() -> Column:
    """Markdown of a block row (t, level, text, ordered, depth, start, items, head, align, rows, src, alt, lang);
    a heatmap's style stands in lang, its weeks in head, its labels and numbers in rows."""
    t = F.col("t")
    pad = F.repeat(F.lit("  "), F.coalesce("depth", F.lit(0)))
    first = F.coalesce("start", F.lit(1))
    bullet = lambda i: F.when(F.col("ordered"), F.concat((first + i).cast("string"), F.lit("."))).otherwise("-")
    items = F.array_join(F.transform("items", lambda x, i: F.concat(pad, bullet(i), F.lit(" "), x)), "\n")
    code = F.concat(fence("text"), F.coalesce("lang", F.lit("")), F.lit("\n"), F.col("text"), F.lit("\n"), fence("text"))
    return (
        F.when(t == "heading", F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), F.col("text")))
        .when(t == "para", F.col("text"))
        .when(t == "list", items)
        .when(t == "table", table_markdown(F.col("head"), F.col("align"), F.col("rows")))
        .when(t == "heatmap", heat_markdown(F.col("lang"), F.col("head"), F.col("rows")))
        .when(t == "image", F.concat(F.lit("!["), F.coalesce("alt", F.lit("")), F.lit("]("), F.col("src"), F.lit(")")))
        .when(t == "code", code)
        .when(t == "quote", F.array_join(F.transform("items", lambda x: F.concat(F.lit("> "), x)), "\n>\n"))
        .when(t == "rule", "---")
        .when(t == "pagebreak", "<!-- pagebreak -->")
    )


def block_html() -> Column:
    """HTML of a block row, as for ``block_markdown``."""
    t, text = F.col("t"), escape_html("text")
    tag = lambda name, inner: F.concat(F.lit(f"<{name}>"), inner, F.lit(f"</{name}>"))
    level = F.col("level").cast("string")
    items = F.array_join(F.transform("items", lambda x: tag("li", escape_html(x))), "")
    row = lambda cells, name: F.concat(F.lit("<tr>"), F.array_join(F.transform(cells, lambda x: tag(name, escape_html(x))), ""), F.lit("</tr>"))
    start = F.when(F.coalesce("start", F.lit(1)) != 1, F.concat(F.lit(' start="'), F.col("start").cast("string"), F.lit('"'))).otherwise("")
    table = F.concat(F.lit("<table><thead>"), row(F.col("head"), "th"), F.lit("</thead><tbody>"), F.array_join(F.transform("rows", lambda r: row(r, "td")), ""), F.lit("</tbody></table>"))
    heat = F.concat(F.lit('<table class="heat '), F.col("lang"), F.lit('"><thead>'), row(F.col("head"), "th"), F.lit("</thead><tbody>"), F.array_join(F.transform(heat_marks(F.col("lang"), F.col("rows")), lambda r: row(r, "td")), ""), F.lit("</tbody></table>"))
    return (
        F.when(t == "heading", F.concat(F.lit("<h"), level, F.lit(">"), text, F.lit("</h"), level, F.lit(">")))
        .when(t == "para", tag("p", text))
        .when((t == "list") & F.col("ordered"), F.concat(F.lit("<ol"), start, F.lit(">"), items, F.lit("</ol>")))
        .when(t == "list", tag("ul", items))
        .when(t == "table", table)
        .when(t == "heatmap", heat)
        .when(t == "image", image_markup("src", F.coalesce("alt", F.lit(""))))
        .when(t == "code", F.concat(F.lit("<pre><code>"), text, F.lit("</code></pre>")))
        .when(t == "quote", tag("blockquote", F.array_join(F.transform("items", lambda x: tag("p", escape_html(x))), "")))
        .when(t == "rule", "<hr>")
        .when(t == "pagebreak", '<div class="pagebreak"></div>')
    )


def gap_after(follows: Column) -> Column:
    """What stands after a block: one line break between neighbouring lists and at the end, else a blank line."""
    return F.when(follows.isNull(), "\n").when((F.col("t") == "list") & (follows == "list"), "\n").otherwise("\n\n")


def render_markdown(docs: DataFrame, blocks: DataFrame) -> DataFrame:
    """(doc_id, markdown): title, subtitle, then blocks, with one line break between neighbouring lists, else a blank line."""
    nxt = F.lead("t").over(Window.partitionBy("doc_id").orderBy("block_ix"))
    rows = blocks.select("doc_id", "block_ix", F.concat(block_markdown(), gap_after(nxt)).alias("md"))
    body = rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_ix", "md"))), lambda x: x["md"]), "").alias("body"))
    head = F.concat(F.lit("# "), F.col("title"), F.when(F.coalesce("subtitle", F.lit("")) != "", F.concat(F.lit("\n\n*"), F.col("subtitle"), F.lit("*"))).otherwise(""))
    return docs.join(body, "doc_id", "left").select("doc_id", F.concat(head, F.when(F.col("body").isNull(), "\n").otherwise(F.concat(F.lit("\n\n"), "body"))).alias("markdown"))


def render_html(docs: DataFrame, blocks: DataFrame, css: str = "") -> DataFrame:
    """(doc_id, html): one self-contained page a document. Where docs has a true ``cover``, what stands before the first
    page break is laid out as a cover, if a rule marks its zones."""
    shown = cover_marked(blocks, docs) if "cover" in docs.columns else blocks.withColumn("zone", F.lit("rest"))
    rows = shown.select("doc_id", "block_ix", "zone", (F.col("t") == "quote").alias("quote"), block_html().alias("h"))
    zone = lambda z: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("zone") == z, F.struct("block_ix", "h")))), lambda x: x["h"]), "\n").alias(z)
    body = rows.groupBy("doc_id").agg(*[zone(z) for z in ("panel", "flowing", "foot", "rest")], F.bool_or(F.col("zone") != "rest").alias("zoned"), F.bool_or(F.col("quote") & (F.col("zone") == "flowing")).alias("stated"))
    title = escape_html("title")
    heading = F.concat(F.lit("<h1>"), title, F.lit("</h1>"))
    lang = F.coalesce("lang", F.lit("en"))
    div = lambda name, *parts: F.concat(F.lit('<div class="'), name, F.lit('">'), *parts, F.lit("</div>"))
    # a statement among what flows is centred, and so is the zone around it
    stated = F.when(F.col("stated"), " cover-statement").otherwise("")
    top = div(F.concat(F.lit("cover-top"), stated), div(F.lit("cover-panel"), heading, "panel"), div(F.concat(F.lit("cover-flow"), stated), "flowing"))
    cover = F.when(F.col("foot") == "", top).otherwise(div(F.lit("cover-frame"), top, div(F.lit("cover-foot"), "foot")))
    plain = F.concat(heading, F.lit("\n"), F.coalesce("rest", F.lit("")))
    main = F.when(F.coalesce("zoned", F.lit(False)), F.concat(cover, F.lit("\n"), "rest")).otherwise(plain)
    page = F.concat(F.lit('<!DOCTYPE html>\n<html lang="'), escape_html(lang), F.lit('"><head><meta charset="utf-8"><title>'), title, F.lit(f"</title><style>{css}</style></head><body>\n"), main, F.lit("\n</body></html>\n"))
    return docs.join(body, "doc_id", "left").select("doc_id", page.alias("html"))


def cover_marked(blocks: DataFrame, docs: DataFrame) -> DataFrame:
    """blocks with ``zone``: that of a cover (panel, flowing, foot) for blocks of a covered document's first page that holds
    a rule, its rules left out, and 'rest' for all others."""
    paged = split_at_pagebreak(blocks.join(docs.select("doc_id", F.coalesce("cover", F.lit(False)).alias("_cover")), "doc_id", "left"))
    whole = Window.partitionBy("doc_id")
    first = F.coalesce("_cover", F.lit(False)) & (F.col("part") == "page")
    ruled = F.max(first & (F.col("t") == "rule")).over(whole)
    zoned = cover_zones(paged.withColumns({"_on": first & ruled, "_t": F.col("t")}).withColumn("t", F.when(F.col("_on"), F.col("t"))))
    out = zoned.withColumns({"t": F.col("_t"), "zone": F.when(F.col("_on"), F.col("zone")).otherwise("rest")})
    return out.where("zone is not null").drop("_cover", "_on", "_t", "part")
