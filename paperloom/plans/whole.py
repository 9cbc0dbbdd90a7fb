"""Queries over whole operations: files read, documents assembled and written, batches planned, proposals filled."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import layout as Y
from ..functions import links as L
from ..functions.text import number_text, tokenise
from ..operators import assembly as A
from ..operators import blocks as B
from ..operators import config as C
from ..operators import offers as O
from ..operators import pages as P
from ..operators import proposals as PR
from ..operators import render as R
from ..sinks import writers as W
from ..sources import archive, discover, markdown, pdf
from ..sources.base import rows_by_document
from . import made
from .base import ORACLE_BLOCKS, ORACLE_WS, oracle_tokens, read, synthesised

TEXT_ROWS = 9  # customers on a page


# --- pages


def _grid(spark, d):
    """Customers as documents of four pages of a grid: three boxes a row; the second cell has two lines."""
    c = read(spark, d, "customer").select((F.floor(F.col("c_custkey") / 1600) * 40 + F.col("c_custkey") % 40).alias("doc_id"), (F.floor(F.col("c_custkey") / 400) % 4).alias("page"), F.floor(F.col("c_custkey") / 40).alias("k"), "c_custkey", "c_name", F.concat(F.lit("nation "), F.col("c_nationkey").cast("string")).alias("note"), "c_mktsegment")
    y = F.lit(700.0) - (F.col("k") % 10) * 30
    box = F.explode(F.array(*[F.struct(F.lit(50.0 + 100 * i).alias("x0"), F.lit(150.0 + 100 * i).alias("x1")) for i in range(3)])).alias("b")
    rects = c.select("doc_id", "page", "c_custkey", y.alias("y"), box).select("doc_id", "page", (F.col("c_custkey") * 10 + F.floor(F.col("b.x0") / 100)).alias("rect_ix"), "b.x0", F.col("y").alias("y0"), "b.x1", (F.col("y") + 30).alias("y1"))
    run = lambda k, text, x, dy: F.struct(F.lit(k).alias("n"), text.alias("text"), F.lit(x).alias("x"), (y + dy).alias("y"))
    texts = F.array(run(0, F.col("c_name"), 55.0, 10.0), run(1, F.col("note"), 155.0, 20.0), run(2, F.lit("second line"), 155.0, 5.0), run(3, F.col("c_mktsegment"), 255.0, 10.0))
    runs = c.select("doc_id", "page", "c_custkey", F.explode(texts).alias("r")).select("doc_id", "page", (F.col("c_custkey") * 10 + F.col("r.n")).alias("run_ix"), "r.text", "r.x", "r.y", F.lit(10.0).alias("size_pt"))
    other = c.select("doc_id", "page").distinct()
    head = other.select("doc_id", "page", F.lit(0).cast("long").alias("run_ix"), F.lit("Letterhead").alias("text"), F.lit(50.0).alias("x"), F.lit(770.0).alias("y"), F.lit(10.0).alias("size_pt"))
    note = other.where("doc_id % 4 = 0 and page > 0").select("doc_id", "page", F.lit(1).cast("long").alias("run_ix"), F.concat(F.lit("Part "), F.col("page").cast("string")).alias("text"), F.lit(50.0).alias("x"), F.lit(740.0).alias("y"), F.lit(14.0).alias("size_pt"))
    foot = other.select("doc_id", "page", F.lit(2).cast("long").alias("run_ix"), F.concat(F.lit("Page "), F.col("page").cast("string")).alias("text"), F.lit(500.0).alias("x"), F.lit(20.0).alias("y"), F.lit(10.0).alias("size_pt"))
    return rects, runs.unionByName(head).unionByName(foot).unionByName(note)


def q53_grid_cells(spark, d):
    """Grids found in boxes, and the text of every cell."""
    rects, runs = _grid(spark, d)
    key = ["doc_id", "page"]
    xs, ys = P.find_grids(rects, key)
    return P.table_cells(runs, xs, ys, key).select("doc_id", "page", F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), "text")


def _assembled(spark, d):
    rects, runs = _grid(spark, d)
    key = ["doc_id", "page"]
    xs, ys = P.find_grids(rects, key)
    return A.assemble(runs, xs, ys, P.table_cells(runs, xs, ys, key))


def q53b_assembled(spark, d):
    """Pages as one document: tables joined where only repeated furniture lies between, read in order."""
    b = _assembled(spark, d)["blocks"]
    return b.select("doc_id", F.col("block_ix").cast("long").alias("block_ix"), "t", "level", F.md5(F.col("text").cast("binary")).alias("text_md5"), F.size("rows").cast("long").alias("n_rows"))


def q53c_left_out(spark, d):
    """Pages on which repeated furniture was not printed again, and documents the token gate would refuse (none)."""
    got = _assembled(spark, d)
    out = got["dropped"].groupBy("doc_id").agg(F.count("*").alias("n_left_out"))
    gate = got["divergence"].groupBy("doc_id").agg(F.count("*").alias("n_apart"))
    return out.join(gate, "doc_id", "full_outer").select("doc_id", "n_left_out", F.coalesce("n_apart", F.lit(0)).cast("long").alias("n_apart"))


def q03b_gate(spark, d):
    """The gate on documents that lack their source's third token, have one more, or are equal."""
    docs = read(spark, d, "documents").select("doc_id", "text")
    source = A.source_tokens(docs.select("doc_id", F.lit(0).alias("page"), F.lit(0).alias("zone"), F.lit(0).alias("line"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0).alias("run_ix"), "text"))
    kind = F.col("doc_id") % 3
    said = F.when(kind == 0, F.filter("tokens", lambda x, i: i != 2)).when(kind == 1, F.concat("tokens", F.array(F.lit("more")))).otherwise(F.col("tokens"))
    got = B.first_divergence(source, source.select("doc_id", said.alias("tokens")))
    return got.select("doc_id", F.col("pos").cast("long").alias("pos"), "expected", "found")


def q70_closed_tops(spark, d):
    """Pages whose topmost band a box spans; the boxes of every third customer end below its line."""
    key = ["doc_id", "page"]
    rects, _ = _grid(spark, d)
    ys = rects.select(*key, F.explode(F.array("y0", "y1")).alias("value")).distinct().select(*key, (F.row_number().over(P.Window.partitionBy(*key).orderBy("value")) - 1).alias("ix"), "value")
    low = rects.withColumn("y1", F.col("y1") - F.when(F.floor(F.col("rect_ix") / 10) % 3 == 0, 5).otherwise(0))
    return P.closed_at_top(low, ys, key)


# --- files


def q59_workbooks(spark, d):
    """A workbook for each customer, made of orders and read back as blocks."""
    o = read(spark, d, "orders")
    day = F.datediff("o_orderdate", F.lit("1899-12-30").cast("date"))
    row = F.struct(F.col("o_orderkey").alias("number"), day.alias("day"), F.col("o_orderpriority").alias("shared"), F.col("o_orderstatus").alias("text"))
    books = o.groupBy(F.col("o_custkey").alias("doc_id")).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    make = lambda doc_id, rows: [{"doc_id": doc_id, "content": made.workbook(f"Customer {doc_id}", ["key", "day", "priority", "status"], [tuple(r.values()) for r in rows])}]
    got = archive.decoded_blocks(archive.decode_workbooks(rows_by_document(books, make, "doc_id long, content binary"), deal=False))
    body = F.array_join(F.transform(F.concat(F.array("head"), F.col("rows")), lambda r: F.array_join(r, "|")), "\n")
    table = got["blocks"].where("t = 'table'").select("doc_id", F.size("rows").cast("long").alias("n_rows"), F.md5(body.cast("binary")).alias("table_md5"))
    heads = got["blocks"].where("t = 'heading'").select("doc_id", F.col("text").alias("heading"))
    return table.join(heads, "doc_id").join(got["titles"], "doc_id").select("doc_id", "title", "heading", "n_rows", "table_md5")


def _made_documents(spark, d):
    """Documents as blocks of simple Markdown with what a writer needs, and their titles."""
    b = B.split_blocks(read(spark, d, "documents").select("doc_id", synthesised().alias("text")))
    titles, rest = B.lift_title(b)
    rest = rest.withColumns({"ordered": F.lit(False), "depth": F.lit(0), "start": F.lit(None).cast("int"), "items": F.when(F.col("t").isin("list", "quote"), F.array("text")), "src": F.when(F.col("t") == "image", F.lit("x.png"))})
    for name, kind in (("head", "array<string>"), ("align", "array<string>"), ("rows", "array<array<string>>"), ("alt", "string"), ("lang", "string")):
        rest = rest.withColumn(name, F.lit(None).cast(kind))
    return titles, rest


def q60_word_round_trip(spark, d):
    """Documents written as word-processing files and read back: kinds of blocks, and the tokens of headings and paragraphs."""
    titles, rest = _made_documents(spark, d)
    got = archive.word_blocks(W.render_docx(titles, rest), deal=False)["blocks"]
    plain = F.when(F.col("t").isin("heading", "para"), F.struct("block_ix", "text"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(plain)), lambda x: x["text"]), " ")
    return got.groupBy("doc_id").agg(*[F.count_if(F.col("t") == k).alias(f"n_{k}") for k in ("heading", "list", "pagebreak")], F.md5(F.array_join(tokenise(text), " ").cast("binary")).alias("tokens_md5"))


def q61_pdf_documents(spark, d):
    """A PDF file for each group of customers, made page by page and read back: its blocks in order."""
    c = read(spark, d, "customer").select(F.floor(F.col("c_custkey") / 100).alias("doc_id"), F.floor((F.col("c_custkey") % 100) / TEXT_ROWS).alias("page"), "c_custkey", F.array(F.col("c_name"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")), F.col("c_mktsegment")).alias("row"))
    pages = c.groupBy("doc_id", "page").agg(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", "row"))), lambda x: x["row"]).alias("rows"))
    files = pages.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("page", "rows"))), lambda x: x["rows"]).alias("pages"))
    got = pdf.read(rows_by_document(files, lambda doc_id, pages: [{"doc_id": doc_id, "content": made.pdf(pages)}], "doc_id long, content binary"))
    return got["blocks"].select("doc_id", "block_ix", "t", F.size("rows").cast("long").alias("n_rows"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


def q62_markdown_blocks(spark, d):
    """Markdown read by the lexer: kinds of blocks by document."""
    docs = read(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), F.col("c_name").alias("n_name"), (F.col("c_nationkey") % 5).cast("int").alias("n_regionkey"))
    text = F.concat_ws(
        "\n\n",
        F.concat(F.lit("# "), "n_name"),
        F.concat(F.lit("Some **"), "n_name", F.lit("** and `code`.")),
        F.concat(F.repeat(F.lit("#"), F.col("n_regionkey") + 2), F.lit(" Part")),
        F.array_join(F.transform(F.sequence(F.lit(1), F.col("n_regionkey") + 1), lambda k: F.concat(k.cast("string"), F.lit(". item"))), "\n"),
        F.concat(F.lit("| a | b |\n|:--|--:|\n| "), "n_name", F.lit(" | 1 |")),
        F.lit("```sql\nselect *\n```"),
        F.lit("> quoted\n>\n> twice"),
        F.lit("---"),
        F.lit("<!-- pagebreak -->"),
        F.lit("<div>raw</div>"),
    )
    blocks, lost = markdown.read(docs.select("doc_id", text.alias("text")))
    n = lost.groupBy("doc_id").agg(F.count("*").alias("n_lost"))
    row = F.concat_ws(":", "t", F.col("level").cast("string"), F.size("items").cast("string"), F.array_join("head", "+"), "lang", F.when(F.col("t") == "para", F.array_join(F.transform("spans", lambda s: F.concat(s["v"], F.array_join(F.transform(s["path"], lambda p: p["t"]), "/"))), ";")))
    shape = blocks.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_ix", row.alias("r")))), lambda x: x["r"]), " ").alias("shape"))
    return shape.join(n, "doc_id", "left").select("doc_id", "shape", F.coalesce("n_lost", F.lit(0)).alias("n_lost"))


# --- writing


def q57_markdown(spark, d):
    """Documents of blocks as Markdown."""
    titles, rest = _made_documents(spark, d)
    return R.render_markdown(titles.withColumn("subtitle", F.when(F.col("doc_id") % 2 == 0, "sub")), rest).select("doc_id", F.md5(F.col("markdown").cast("binary")).alias("markdown_md5"))


def q57b_html(spark, d):
    titles, rest = _made_documents(spark, d)
    page = R.render_html(titles.withColumn("lang", F.lit("en")), rest, "p{}")
    return page.select("doc_id", F.md5(F.col("html").cast("binary")).alias("html_md5"))


def q57d_covers(spark, d):
    """Every other document with a cover: zones between its rules."""
    titles, rest = _made_documents(spark, d)
    page = R.render_html(titles.withColumns({"lang": F.lit("en"), "cover": F.col("doc_id") % 2 == 0}), rest)
    return page.select("doc_id", F.md5(F.col("html").cast("binary")).alias("html_md5"))


def q57c_heatmaps(spark, d):
    """A heatmap block of each supplier's quantities by month, in three styles."""
    li = read(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("doc_id"), F.col("l_linenumber").alias("line")).agg(*[F.coalesce(F.sum(F.when(F.quarter("l_shipdate") == q, F.col("l_quantity"))), F.lit(0)).cast("long").alias(f"q{q}") for q in range(1, 5)])
    row = F.array(F.concat(F.lit("line|"), F.col("line").cast("string")), *[F.col(f"q{q}").cast("string") for q in range(1, 5)])
    b = li.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("line", row.alias("row")))), lambda x: x["row"]).alias("rows"))
    style = F.element_at(F.lit(list(PR.STYLES)), (F.col("doc_id") % 3 + 1).cast("int"))
    return b.select("doc_id", R.heat_markdown(style, F.lit(["", "Q1", "Q2", "Q3", "Q4"]), F.col("rows")).alias("markdown"))


def q69_spans(spark, d):
    """Inline markup of spans whose emphasis, code and links change from one to the next."""
    e = read(spark, d, "events").select("event_id", "event_type", (F.col("event_id") % 6).alias("k"))
    node = lambda t, n, href=None: F.struct(F.lit(t).alias("t"), F.lit(href).cast("string").alias("href"), F.lit(n).alias("node"))
    path = lambda *nodes: F.array(*nodes) if nodes else F.array().cast("array<struct<t:string,href:string,node:int>>")
    span = lambda v, p: F.struct(v.alias("v"), p.alias("path"))
    bold, em, code, link, bad = node("strong", 1), node("em", 2), node("code", 3), node("link", 4, "http://a/?b&c"), node("link", 5, "java script:x")
    middle = F.when(F.col("k") == 0, path(bold)).when(F.col("k") == 1, path(bold, em)).when(F.col("k") == 2, path(code)).when(F.col("k") == 3, path(link)).when(F.col("k") == 4, path(bad)).otherwise(path())
    spans = F.array(span(F.lit("a<"), path(bold)), span(F.col("event_type"), middle), span(F.lit("z"), path()))
    return e.select("event_id", R.spans_markdown(spans).alias("md"), R.spans_html(spans).alias("html"), L.refused_text(F.lit("https://Host:443/x"), F.col("event_type")).alias("named"), R.fence(F.concat(F.repeat(F.lit("`"), F.col("k").cast("int")), F.col("event_type"))).alias("fence"))


def q73_understood(spark, d):
    b = B.split_blocks(read(spark, d, "documents").select("doc_id", synthesised().alias("text")))
    return B.understood(B.count_blocks(b))


def q74_between_tables(spark, d):
    """Hairlines between neighbouring tables, and headings by the name of their style."""
    e = read(spark, d, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("block_ix"), F.when(F.col("event_type").isin("click", "view"), "table").otherwise("para").alias("t"))
    return B.separate_tables(e).groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(F.col("t") == "hairline").alias("n_hairlines"))


def q63_styles(spark, d):
    p = read(spark, d, "part").select("p_partkey", F.concat(F.element_at(F.lit(["Heading", "Heading ", "DocH", "Head"]), (F.col("p_partkey") % 4 + 1).cast("int")), (F.col("p_size") % 8).cast("string")).alias("style"))
    return p.select("p_partkey", archive.heading_level(F.col("style")).alias("level"))


# --- measures, themes, tokens


def q65_layout(spark, d):
    p = read(spark, d, "part").select("p_partkey", "p_size", F.when(F.col("p_partkey") % 2 == 0, "A4").otherwise("Letter").alias("size"), F.col("p_size").cast("double").alias("margin"), "p_brand", "p_type")
    svg = F.element_at(F.lit(["<svg/>", "<svg fill='red'/>", '<svg style="a:b; stroke:x"/>', "<svg><style>.a { fill: b }</style></svg>"]), (F.col("p_partkey") % 4 + 1).cast("int"))
    s = Y.sizing("size", "margin", F.col("margin") + 1)
    lines = Y.letterhead_lines(F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand")), F.when(F.col("p_partkey") % 5 > 0, F.col("p_type")).otherwise(""))
    return p.select("p_partkey", s["total"].alias("total"), s["landscape"].alias("landscape"), s["body_pt"].alias("body_pt"), Y.to_mm("margin").alias("mm"), Y.cover_statement_pt(F.col("margin"), F.lit(13.0)).alias("statement"), Y.units("margin", 2).alias("half_points"), Y.units("margin", 12_700).alias("emu"), F.array_join(lines, "|").alias("lines"), F.date_format(Y.date_of(F.col("p_partkey") * 86_400 - 86_400 * 5), "yyyy-MM-dd").alias("date"), Y.inline_paint(svg)["where"].alias("painted"))


def q64_themes(spark, d):
    s = read(spark, d, "supplier").select("s_suppkey")
    k = F.col("s_suppkey")
    raw = F.concat(F.lit('{"id":"t'), k.cast("string"), F.lit('"'), F.when(k % 2 == 0, ',"colors":{"ink":"#0000FF"}').when(k % 7 == 0, ',"colors":{"ink":"blue"}').otherwise(""), F.when(k % 3 == 0, F.concat(F.lit(',"type":{"h1Pt":'), (k % 30).cast("string"), F.lit("}"))).otherwise(""), F.when(k % 5 == 0, ',"page":{"size":"Letter","marginPt":280}').otherwise(""), F.lit("}"))
    t = discover.themes(s.select(raw.alias("raw")))
    return t.select("id", "ink", "title", "h1_pt", "title_pt", "page", "margin_pt", "body_pt", F.array_join("violations", ";").alias("violations"))


def q66_recoloured(spark, d):
    """Drawings of ten customers each, filled with the customers' colours; classes without one are missed."""
    c = read(spark, d, "customer").select(F.floor(F.col("c_custkey") / 10).alias("doc_id"), F.col("c_name").alias("name"), F.col("c_custkey").cast("int").alias("k"))
    raw = c.groupBy("doc_id").agg(F.concat(F.lit('{"color":{'), F.array_join(F.array_sort(F.collect_list(F.format_string('"%s":{"$value":["#%06d"]}', "name", "k"))), ","), F.lit("}}")).alias("raw"))
    tokens = discover.design_tokens(raw)
    names = c.where("k % 3 = 0").groupBy("doc_id").agg(F.array_sort(F.collect_list("name")).alias("names"))
    svgs = names.select("doc_id", F.concat(F.array_join(F.transform("names", lambda x: F.concat(F.lit('<a class="'), x, F.lit('"/>'))), ""), F.lit('<b class="none"/>')).alias("svg"))
    filled, missed = discover.recolour(svgs, tokens)
    return filled.join(missed.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list("name")), ",").alias("missed")), "doc_id").select("doc_id", "svg", "missed")


# --- batches and names


def _batch(spark, d):
    """Inputs of a batch: some share an output, some are another's output, some have settings files."""
    p = read(spark, d, "pages").select("page_id").distinct()
    k, n = F.col("page_id") % 10, F.col("page_id")
    path = F.when(k == 9, F.concat(F.lit("in/"), (n - 4).cast("string"), F.lit(".plain.pdf"))).when(k == 1, F.concat(F.lit("in/"), (n - 1).cast("string"), F.lit(".docx"))).otherwise(F.concat(F.lit("in/"), n.cast("string"), F.lit(".md")))
    raw = F.when(k == 2, '{"to":["md"]}').when(k == 3, '{"to":["pdf","svg"]}').when(k == 4, '{"theme":"other"}').when(k == 6, '{"titel":"x"}').when(k == 7, '{"plainNames":true,"to":["md"]}').when(k == 8, '{"title":"t"}')
    return p.select("page_id", path.alias("path")), p.select(F.concat(F.lit("in/"), n.cast("string"), F.lit(".settings.json")).alias("path"), raw.alias("raw")).where("raw is not null")


def q54_batch(spark, d):
    rows, _ = C.plan_build(*_batch(spark, d))
    return rows.select("page_id", "status", "reason", "has_sidecar", "title")


def q54c_flags(spark, d):
    """What a run's flags leave of the settings files: title and formats are the run's, dates and entities the files' own, or one named file's."""
    inputs, sidecars = _batch(spark, d)
    own = C.resolve(inputs, sidecars, {"title": "Given", "formats": ["md"]})
    one = C.resolve(inputs, sidecars, {"config": '{"title": "Named", "date": "May", "to": ["docx"], "plainNames": true}', "entity": "Firm"})
    bare = C.resolve(inputs, sidecars, {"no_config": True, "date": "June"})
    cut = lambda run, r: r.select(F.lit(run).alias("run"), "path", "has_sidecar", F.array_join("formats", ",").alias("formats"), "plain", "title", "date", "entity", F.col("failed").isNotNull().alias("failed"))
    return cut("flags", own).unionByName(cut("named file", one)).unionByName(cut("no file", bare))


def q54b_targets(spark, d):
    _, targets = C.plan_build(*_batch(spark, d))
    return targets


def q58_names(spark, d):
    p = read(spark, d, "pages").select("page_id", F.concat(F.lit("a.b/"), "page_id", F.element_at(F.lit([".proposal.json", ".PROPOSAL.json", ".json", ".tar.gz", ""]), (F.col("page_id") % 5 + 1).cast("int"))).alias("path"))
    return p.select("page_id", C.stem("path").alias("stem"), C.extension("path").alias("extension"), C.proposal_stem("path").alias("proposal"), C.sidecar_path("path").alias("sidecar"), O.beside(F.col("path"), F.element_at(F.lit(["./x.md", "y/z.md", "/abs.md"]), (F.col("page_id") % 3 + 1).cast("int"))).alias("beside"))


def q58b_numbers(spark, d):
    o = read(spark, d, "orders")
    return o.select("o_orderkey", number_text(F.col("o_orderkey") / 8).alias("eighths"), number_text(F.col("o_orderkey") * 1.0).alias("whole"))


# --- proposals


def _data(spark, d):
    """Customers as data files of proposals; every fifth breaks a rule."""
    c = read(spark, d, "customer")
    k = F.col("c_custkey")
    text = lambda name, v: F.concat(F.lit(f'"{name}":"'), v, F.lit('",'))
    hours = F.concat(F.lit("["), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda w: ((k + w) % 41).cast("string")), ","), F.lit("]"))
    rate = F.when(k % 15 == 5, "45.005").otherwise((F.lit(40) + k % 7).cast("string"))
    raw = F.concat(
        F.lit("{"),
        F.when(k % 10 != 0, text("template", F.lit("t.md"))).otherwise(""),
        text("kind", F.lit("k")),
        text("project", F.col("c_name")),
        F.lit('"date":"d","author":{"name":"n","email":"e"},'),
        F.when(k % 25 == 5, '"colour":"x",').otherwise(""),
        F.when(k % 4 == 0, text("stage", F.col("c_mktsegment"))).otherwise(""),
        F.lit('"team":[{"role":"lead","rate":'), rate, F.lit(',"hoursPerWeek":'), hours, F.lit('},{"role":"dev","rate":30,"hoursPerWeek":[8,0,16]}]}'),
    )
    return c.select(k.alias("prop_id"), F.lit("p/x.proposal.json").alias("path"), raw.alias("raw"))


def q55_data_violations(spark, d):
    return PR.data_violations(_data(spark, d).select("prop_id", "raw"))


def q55b_hours(spark, d):
    data = _data(spark, d)
    good = data.join(PR.data_violations(data.select("prop_id", "raw")).select("prop_id").distinct(), "prop_id", "left_anti")
    return PR.inspect(PR.team_hours(good), ["prop_id"]).select("prop_id", F.col("weeks").cast("long").alias("weeks"), "roles", "total_cents")


FILLED = "# {{project}}\n\n{{?stage}}In {{stage}}: {{/?}}an offer.\n\n{{@budget}}\n\n{{@schedule}}\n"


def q72_offers(spark, d):
    """Proposals filled from data files and a template, budget and schedule in their places."""
    files = spark.createDataFrame([("p/t.md", bytearray(FILLED.encode()))], "path string, content binary")
    got = O.assemble(_data(spark, d), files)
    row = F.concat_ws("~", "t", "text", F.array_join("head", "+"), F.array_join(F.transform("rows", lambda r: F.array_join(r, "+")), "/"))
    body = got["blocks"].groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_ix", row.alias("r")))), lambda x: x["r"]), "\n").alias("body"))
    return got["docs"].join(body, "doc_id").select("doc_id", "title", "body")


def q72b_refused(spark, d):
    files = spark.createDataFrame([("p/t.md", bytearray((FILLED + "\n{{stage}}\n").encode()))], "path string, content binary")
    return O.assemble(_data(spark, d), files)["violations"]


def q72c_losses(spark, d):
    """What proposals lose: their template's raw markup, and what their annex lost, marked as the annex's."""
    sheet = '<worksheet><sheetData><row r="1"><c r="A1" t="inlineStr"><is><t>item</t></is></c><c r="B1" t="inlineStr"><is><t>n</t></is></c></row><row r="2"><c r="A2" t="s"><v>7</v></c><c r="B2"><f>1+1</f><v>2</v></c></row></sheetData></worksheet>'
    book = made.zipped({"xl/workbook.xml": f'<workbook xmlns:r="{made.OFFICE}"><sheets><sheet name="Sheet1" r:id="r1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Type="x/worksheet" Target="worksheets/s.xml"/></Relationships>', "xl/worksheets/s.xml": sheet})
    template = FILLED + "\n<div>raw</div>\n\n{{?annex}}\n\n{{@annex}}\n\n{{/?}}\n"
    files = spark.createDataFrame([("p/t.md", bytearray(template.encode())), ("p/a.xlsx", bytearray(book))], "path string, content binary")
    named = F.when(F.col("prop_id") % 2 == 1, F.concat(F.lit('{"annex":"a.xlsx",'), F.substring("raw", 2, 2**31 - 1))).otherwise(F.col("raw"))
    got = O.assemble(_data(spark, d).withColumn("raw", named), files)
    return got["dropped"].join(got["docs"].select("doc_id"), "doc_id", "left_semi").select("doc_id", "kind", "message")


def q56_spliced(spark, d):
    """Paragraphs that are a directive's mark replaced by its blocks; marks elsewhere keep nothing."""
    e = read(spark, d, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("block_ix"), F.when(F.col("event_type") == "click", "para").otherwise("list").alias("t"), F.when(F.col("event_id") % 3 == 0, "[[0:budget]]").when(F.col("event_id") % 3 == 1, "see [[0:budget]]").otherwise("text").alias("text"))
    docs = e.select("doc_id").distinct()
    expanded = docs.select("doc_id", F.lit(0).alias("directive_ix"), F.explode(F.lit([0, 1])).alias("sub_ix"), F.lit("table").alias("t"), F.lit("T").alias("text"))
    whole, lost = PR.splice(e, expanded)
    n = whole.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(F.col("t") == "table").alias("n_tables"))
    return n.join(lost.select("doc_id", F.lit(True).alias("lost")), "doc_id", "left").select("doc_id", "n", "n_tables", F.coalesce("lost", F.lit(False)).alias("lost"))


QUERIES = {
    f.__name__: f
    for f in (q03b_gate, q53_grid_cells, q53b_assembled, q53c_left_out, q54_batch, q54b_targets, q54c_flags, q55_data_violations, q55b_hours, q56_spliced, q57_markdown, q57b_html, q57c_heatmaps, q57d_covers, q58_names, q58b_numbers, q59_workbooks, q60_word_round_trip, q61_pdf_documents, q62_markdown_blocks, q63_styles, q64_themes, q65_layout, q66_recoloured, q69_spans, q70_closed_tops, q72_offers, q72b_refused, q72c_losses, q73_understood, q74_between_tables)
}

_G = "g AS (SELECT c_custkey // 1600 * 40 + c_custkey % 40 AS doc_id, c_custkey // 400 % 4 AS page, c_custkey // 40 % 10 AS k, c_custkey, c_name, 'nation ' || c_nationkey AS note, c_mktsegment FROM customer)"
# a table's running number: pages of one document are joined unless a part's heading stands between
_ROWS = "r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY k) - 1 AS row FROM g)"
_TABLES = f"""{_G}, {_ROWS}, t AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN page ELSE min(page) OVER (PARTITION BY doc_id) END AS first, page, row, c_name || ' ' || note || ' second line ' || c_mktsegment AS text FROM r),
tables AS (SELECT doc_id, first AS page, 1 AS zone, 0 AS k, 'table' AS t, NULL AS level, string_agg(text, ' ' ORDER BY page, row) AS text, count(*) - 1 AS n_rows FROM t GROUP BY doc_id, first),
pages AS (SELECT DISTINCT doc_id, page, min(page) OVER (PARTITION BY doc_id) AS lo, max(page) OVER (PARTITION BY doc_id) AS hi FROM g)"""
_ESC = lambda x: f"replace(replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')"
_TITLES = "titles AS (SELECT doc_id, coalesce(max(CASE WHEN block_ix = title_ix THEN text END), 'Untitled') AS title FROM lifted GROUP BY doc_id)"
_HTML = f"m AS (SELECT doc_id, block_ix, t, CASE t WHEN 'heading' THEN '<h' || level || '>' || {_ESC('text')} || '</h' || level || '>' WHEN 'list' THEN '<ul><li>' || {_ESC('text')} || '</li></ul>' WHEN 'rule' THEN '<hr>' WHEN 'pagebreak' THEN '<div class=\"pagebreak\"></div>' WHEN 'quote' THEN '<blockquote><p>' || {_ESC('text')} || '</p></blockquote>' ELSE '<p>' || {_ESC('text')} || '</p>' END AS h FROM rest)"
_PAGE = lambda css, main: f"""'<!DOCTYPE html>' || chr(10) || '<html lang="en"><head><meta charset="utf-8"><title>' || {_ESC('title')} || '</title><style>{css}</style></head><body>' || chr(10) || {main} || chr(10) || '</body></html>' || chr(10)"""
_KINDS = ", ".join(f"CASE WHEN count(*) FILTER (t = '{k}') > 0 THEN count(*) FILTER (t = '{k}') || ' {k}' || CASE WHEN count(*) FILTER (t = '{k}') = 1 THEN '' ELSE 's' END END" for k in B.KINDS)
_MONEY = lambda c: f"('€' || chr(160) || replace(format('{{:,}}', CAST(floor({c} / 100.0) AS BIGINT)), ',', chr(160)) || ',' || lpad(CAST({c} % 100 AS VARCHAR), 2, '0'))"
_DAYS = lambda h: f"CASE WHEN {h} = 0 THEN '—' ELSE CASE WHEN {h} % 8 = 0 THEN CAST({h} // 8 AS VARCHAR) ELSE CAST({h} / 8.0::DOUBLE AS VARCHAR) END || CASE WHEN {h} <= 8 THEN ' day / week' ELSE ' days / week' END END"
_STEP = lambda q: f"least(3, CAST(ceil({q} / m * 3) AS INTEGER))"
_CELL = lambda q: f"CASE doc_id % 3 WHEN 2 THEN repeat('▪', CASE WHEN {q} > 0 THEN {_STEP(q + '::DOUBLE')} ELSE 0 END) ELSE CASE WHEN {q} > 0 THEN CAST({q} AS VARCHAR) ELSE '' END END"
_BATCH = """p AS (SELECT DISTINCT page_id, page_id % 10 AS k FROM pages),
i AS (SELECT page_id, k, CASE WHEN k = 9 THEN 'in/' || (page_id - 4) || '.plain.pdf' WHEN k = 1 THEN 'in/' || (page_id - 1) || '.docx' ELSE 'in/' || page_id || '.md' END AS path,
 CASE k WHEN 9 THEN (page_id - 4) || '.plain' WHEN 1 THEN CAST(page_id - 1 AS VARCHAR) ELSE CAST(page_id AS VARCHAR) END AS stem FROM p),
s AS (SELECT i.*, j.path AS other, o.page_id IS NOT NULL AS own FROM i LEFT JOIN i j ON i.stem = j.stem AND i.page_id <> j.page_id AND i.k IN (0, 1) AND j.k IN (0, 1) LEFT JOIN i o ON i.k = 9 AND o.k = 5 AND o.page_id = i.page_id - 4)"""

ORACLE = {
    "q03b_gate": f"""WITH w AS (SELECT doc_id, {oracle_tokens('text')} AS w FROM documents),
 z AS (SELECT doc_id, w, w[1:2] || w[4:] AS x FROM w WHERE doc_id % 3 = 0), p AS (SELECT doc_id, w, x, list_filter(range(2, len(w)), lambda i: w[i + 1] IS DISTINCT FROM x[i + 1]) AS d FROM z WHERE len(w) >= 3)
 SELECT doc_id, CAST(d[1] AS BIGINT) AS pos, w[d[1] + 1] AS expected, x[d[1] + 1] AS found FROM p WHERE len(d) > 0 UNION ALL SELECT doc_id, CAST(len(w) AS BIGINT), NULL, 'more' FROM w WHERE doc_id % 3 = 1""",
    "q53_grid_cells": f"WITH {_G}, {_ROWS} SELECT doc_id, page, CAST(row AS INTEGER) AS row, unnest([0, 1, 2]) AS col, unnest([c_name, note || ' second line', c_mktsegment]) AS text FROM r",
    "q53b_assembled": f"""WITH {_TABLES},
 prose AS (SELECT doc_id, page, 0 AS zone, 0 AS k, 'para' AS t, NULL AS level, 'Letterhead' AS text, NULL AS n_rows FROM pages WHERE doc_id % 4 = 0 OR page = lo
  UNION ALL SELECT doc_id, page, 0, 1, 'heading', 1, 'Part ' || page, NULL FROM pages WHERE doc_id % 4 = 0 AND page > 0
  UNION ALL SELECT doc_id, page, 2, 0, 'para', NULL, 'Page ' || page, NULL FROM pages WHERE doc_id % 4 = 0 OR page = hi),
 b AS (SELECT * FROM prose UNION ALL SELECT * FROM tables)
 SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN doc_id % 4 = 0 OR t <> 'table' THEN page ELSE page END, zone, k) - 1 AS block_ix, t, CAST(level AS INTEGER) AS level, md5(text) AS text_md5, CAST(n_rows AS BIGINT) AS n_rows FROM b""",
    "q53c_left_out": f"WITH {_G}, n AS (SELECT doc_id, count(DISTINCT page) AS n FROM g GROUP BY doc_id) SELECT doc_id, 2 * (n - 1) AS n_left_out, CAST(0 AS BIGINT) AS n_apart FROM n WHERE doc_id % 4 <> 0 AND n > 1",
    "q54_batch": f"""WITH {_BATCH}
 SELECT page_id, CASE WHEN k IN (3, 4, 6, 7) THEN 'failed' WHEN own THEN 'own output' WHEN other IS NOT NULL THEN 'refused' ELSE 'ok' END AS status,
 CASE k WHEN 3 THEN 'to: unknown format svg' WHEN 4 THEN 'unknown theme other' WHEN 6 THEN 'unknown key titel' WHEN 7 THEN 'plain names would write md or docx beside the sources, which a rerun would read' ELSE CASE WHEN own THEN 'is the output of another input' WHEN other IS NOT NULL THEN 'its output would also be that of ' || other END END AS reason,
 k IN (2, 3, 4, 6, 7, 8) AS has_sidecar, CASE WHEN k = 8 THEN 't' END AS title FROM s""",
    "q54b_targets": f"WITH {_BATCH} SELECT path, CASE WHEN k = 2 THEN 'md' ELSE 'pdf' END AS format, 'in/' || stem || '.plain.' || CASE WHEN k = 2 THEN 'md' ELSE 'pdf' END AS target FROM s WHERE k NOT IN (3, 4, 6, 7) AND NOT own AND other IS NULL",
    "q54c_flags": f"""WITH {_BATCH}
 SELECT 'flags' AS run, path, k IN (2, 3, 4, 6, 7, 8) AS has_sidecar, 'md' AS formats, k = 7 AS plain, 'Given' AS title, CAST(NULL AS VARCHAR) AS date, CAST(NULL AS VARCHAR) AS entity, k IN (3, 4, 6) AS failed FROM i
 UNION ALL SELECT 'named file', path, true, 'docx', true, 'Named', 'May', 'Firm', false FROM i UNION ALL SELECT 'no file', path, false, 'pdf', false, NULL, 'June', NULL, false FROM i""",
    "q55_data_violations": """SELECT c_custkey AS prop_id, unnest(list_filter([CASE WHEN c_custkey % 10 = 0 THEN 'template is required' END, CASE WHEN c_custkey % 25 = 5 THEN 'unknown key colour' END, CASE WHEN c_custkey % 15 = 5 THEN 'team[0].rate: more than two decimals' END], lambda x: x IS NOT NULL)) AS why FROM customer""",
    "q55b_hours": "SELECT c_custkey AS prop_id, CAST(3 AS BIGINT) AS weeks, CAST(2 AS BIGINT) AS roles, CAST((c_custkey % 41 + (c_custkey + 1) % 41 + (c_custkey + 2) % 41) * (40 + c_custkey % 7) * 100 + 24 * 3000 AS BIGINT) AS total_cents FROM customer WHERE c_custkey % 10 <> 0 AND c_custkey % 25 <> 5 AND c_custkey % 15 <> 5",
    "q56_spliced": """WITH e AS (SELECT user_id AS doc_id, event_type = 'click' AND event_id % 3 = 0 AS marked FROM events)
 SELECT doc_id, count(*) + count(*) FILTER (marked) AS n, 2 * count(*) FILTER (marked) AS n_tables, count(*) FILTER (marked) = 0 AS lost FROM e GROUP BY doc_id""",
    "q57_markdown": f"""WITH {ORACLE_BLOCKS}, {_TITLES},
 m AS (SELECT doc_id, block_ix, t, CASE t WHEN 'heading' THEN repeat('#', CAST(level AS INTEGER)) || ' ' || text WHEN 'list' THEN '- ' || text WHEN 'rule' THEN '---' WHEN 'pagebreak' THEN '<!-- pagebreak -->' WHEN 'quote' THEN '> ' || text WHEN 'image' THEN '![](x.png)' ELSE text END AS md, lead(t) OVER (PARTITION BY doc_id ORDER BY block_ix) AS nxt FROM rest),
 b AS (SELECT doc_id, string_agg(md || CASE WHEN nxt IS NULL OR (t = 'list' AND nxt = 'list') THEN chr(10) ELSE chr(10) || chr(10) END, '' ORDER BY block_ix) AS body FROM m GROUP BY doc_id)
 SELECT doc_id, md5('# ' || title || CASE WHEN doc_id % 2 = 0 THEN chr(10) || chr(10) || '*sub*' ELSE '' END || coalesce(chr(10) || chr(10) || body, chr(10))) AS markdown_md5 FROM titles LEFT JOIN b USING (doc_id)""",
    "q57b_html": f"""WITH {ORACLE_BLOCKS}, {_TITLES}, {_HTML}, b AS (SELECT doc_id, string_agg(h, chr(10) ORDER BY block_ix) AS body FROM m GROUP BY doc_id)
 SELECT doc_id, md5({_PAGE('p{}', "'<h1>' || " + _ESC('title') + " || '</h1>' || chr(10) || coalesce(body, '')")}) AS html_md5 FROM titles LEFT JOIN b USING (doc_id)""",
    "q57d_covers": f"""WITH {ORACLE_BLOCKS}, {_TITLES}, {_HTML},
p AS (SELECT *, block_ix < coalesce(min(CASE WHEN t = 'pagebreak' THEN block_ix END) OVER (PARTITION BY doc_id), 1e9) AND doc_id % 2 = 0 AS page FROM m),
r AS (SELECT *, min(CASE WHEN page AND t = 'rule' THEN block_ix END) OVER w AS a, max(CASE WHEN page AND t = 'rule' THEN block_ix END) OVER w AS z FROM p WINDOW w AS (PARTITION BY doc_id)),
q AS (SELECT doc_id, block_ix, t, h, CASE WHEN NOT page OR a IS NULL THEN 'rest' WHEN t = 'rule' THEN '' WHEN block_ix < a THEN 'panel' WHEN a < z AND block_ix > z THEN 'foot' ELSE 'flow' END AS zone FROM r),
g AS (SELECT doc_id, {', '.join(f"coalesce(string_agg(h, chr(10) ORDER BY block_ix) FILTER (zone = '{k}'), '') AS {k}" for k in ('panel', 'flow', 'foot', 'rest'))}, bool_or(zone <> 'rest' AND zone <> '') AS zoned FROM q GROUP BY doc_id),
f AS (SELECT titles.doc_id, title, '<h1>' || {_ESC('title')} || '</h1>' AS h1, rest, foot, zoned, '<div class="cover-top"><div class="cover-panel"><h1>' || {_ESC('title')} || '</h1>' || panel || '</div><div class="cover-flow">' || flow || '</div></div>' AS top FROM titles LEFT JOIN g USING (doc_id))
 SELECT doc_id, md5({_PAGE('', "CASE WHEN zoned THEN CASE WHEN foot = '' THEN top ELSE '<div class=\"cover-frame\">' || top || '<div class=\"cover-foot\">' || foot || '</div></div>' END || chr(10) || rest ELSE h1 || chr(10) || coalesce(rest, '') END")}) AS html_md5 FROM f""",
    "q57c_heatmaps": f"""WITH l AS (SELECT l_suppkey AS doc_id, l_linenumber AS line, {', '.join(f"CAST(coalesce(sum(CASE WHEN quarter(l_shipdate) = {q} THEN l_quantity END), 0) AS BIGINT) AS q{q}" for q in range(1, 5))} FROM lineitem GROUP BY ALL),
 x AS (SELECT *, greatest(max(q1) OVER w, max(q2) OVER w, max(q3) OVER w, max(q4) OVER w)::DOUBLE AS m FROM l WINDOW w AS (PARTITION BY doc_id))
 SELECT doc_id, '|  | Q1 | Q2 | Q3 | Q4 |' || chr(10) || '| :-- | :-: | :-: | :-: | :-: |' || chr(10) || string_agg('| line\\|' || line || ' | ' || {" || ' | ' || ".join(_CELL(f'q{q}') for q in range(1, 5))} || ' |', chr(10) ORDER BY line) AS markdown FROM x GROUP BY doc_id""",
    "q58_names": """WITH p AS (SELECT page_id, ['.proposal.json', '.PROPOSAL.json', '.json', '.tar.gz', ''][page_id % 5 + 1] AS e FROM pages)
 SELECT page_id, page_id || CASE e WHEN '.tar.gz' THEN '.tar' WHEN '.json' THEN '' ELSE replace(e, '.json', '') END AS stem, CASE e WHEN '' THEN '' WHEN '.tar.gz' THEN '.gz' ELSE '.json' END AS extension, page_id || CASE WHEN e = '.tar.gz' THEN '.tar' ELSE '' END AS proposal,
 'a.b/' || page_id || CASE e WHEN '.tar.gz' THEN '.tar' WHEN '.json' THEN '' ELSE replace(e, '.json', '') END || '.settings.json' AS sidecar, CASE page_id % 3 WHEN 0 THEN 'a.b/x.md' WHEN 1 THEN 'a.b/y/z.md' ELSE '/abs.md' END AS beside FROM p""",
    "q58b_numbers": "SELECT o_orderkey, CASE WHEN o_orderkey % 8 = 0 THEN CAST(o_orderkey // 8 AS VARCHAR) ELSE CAST(o_orderkey / 8.0::DOUBLE AS VARCHAR) END AS eighths, CAST(o_orderkey AS VARCHAR) AS whole FROM orders",
    "q59_workbooks": """WITH o AS (SELECT o_custkey, o_orderkey || '|' || CAST(o_orderdate AS DATE) || '|' || o_orderpriority || '|' || o_orderstatus AS line, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders)
 SELECT o_custkey AS doc_id, 'Customer ' || o_custkey AS title, 'Orders' AS heading, count(*) AS n_rows, md5('key|day|priority|status' || chr(10) || string_agg(line, chr(10) ORDER BY k)) AS table_md5 FROM o GROUP BY o_custkey HAVING count(*) + 3 <= 200""",
    "q60_word_round_trip": f"""WITH {ORACLE_BLOCKS}, {_TITLES}, x AS (SELECT doc_id, -1 AS block_ix, 'para' AS t, title AS text FROM titles UNION ALL SELECT doc_id, block_ix, t, text FROM rest)
 SELECT doc_id, count(*) FILTER (t = 'heading') AS n_heading, count(*) FILTER (t = 'list') AS n_list, count(*) FILTER (t = 'pagebreak') AS n_pagebreak, md5(array_to_string({oracle_tokens("coalesce(string_agg(CASE WHEN t IN ('heading', 'para') THEN text END, ' ' ORDER BY block_ix), '')")}, ' ')) AS tokens_md5 FROM x GROUP BY doc_id""",
    "q61_pdf_documents": f"""WITH c AS (SELECT c_custkey // 100 AS doc_id, c_custkey % 100 // {TEXT_ROWS} AS page, c_custkey, c_name || ' c' || c_custkey || ' ' || c_mktsegment AS text FROM customer),
 t AS (SELECT doc_id, count(*) - 1 AS n_rows, string_agg(text, ' ' ORDER BY c_custkey) AS text, count(DISTINCT page) AS n FROM c GROUP BY doc_id)
 SELECT doc_id, CAST(0 AS BIGINT) AS block_ix, 'para' AS t, CAST(NULL AS BIGINT) AS n_rows, md5('Register of customers') AS text_md5 FROM t UNION ALL SELECT doc_id, 1, 'table', n_rows, md5(text) FROM t UNION ALL SELECT doc_id, 2, 'para', NULL, md5('page ' || n) FROM t""",
    "q62_markdown_blocks": """SELECT c_custkey AS doc_id, concat_ws(' ', 'heading:1', 'para:Some ;' || c_name || 'strong; and ;codecode;.', 'heading:' || least(3, c_nationkey % 5 + 2), 'list:' || (c_nationkey % 5 + 1), 'table:a+b', 'code:sql', 'quote:2', 'rule', 'pagebreak') AS shape, CAST(1 + CASE WHEN c_nationkey % 5 + 2 > 3 THEN 1 ELSE 0 END AS BIGINT) AS n_lost FROM customer""",
    "q63_styles": "SELECT p_partkey, CAST(CASE WHEN p_partkey % 4 < 2 AND p_size % 8 BETWEEN 1 AND 6 THEN least(3, p_size % 8) WHEN p_partkey % 4 = 2 AND p_size % 8 BETWEEN 1 AND 3 THEN p_size % 8 END AS INTEGER) AS level FROM part",
    "q64_themes": """WITH s AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 2 = 0 THEN '#0000FF' WHEN s_suppkey % 7 = 0 THEN 'blue' ELSE '#1A1A1A' END AS ink, CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey % 30 ELSE 18 END::DOUBLE AS h1 FROM supplier)
 SELECT 't' || k AS id, ink, ink AS title, h1 AS h1_pt, h1 AS title_pt, CASE WHEN k % 5 = 0 THEN 'Letter' ELSE 'A4' END AS page, CASE WHEN k % 5 = 0 THEN 280.0 ELSE 48.0 END::DOUBLE AS margin_pt, 10.0::DOUBLE AS body_pt,
 concat_ws(';', CASE WHEN ink = 'blue' THEN 'colors.ink: expected a six-digit hex colour;colors.title: expected a six-digit hex colour' END, CASE WHEN h1 <= 0 THEN 'type.h1Pt: expected a positive number;type.titlePt: expected a positive number' END, CASE WHEN k % 5 = 0 THEN 'page.marginPt: leaves no usable column' END) AS violations FROM s""",
    "q65_layout": """WITH p AS (SELECT *, CASE WHEN p_partkey % 2 = 0 THEN 595.28::DOUBLE ELSE 612.0::DOUBLE END AS w, CASE WHEN p_partkey % 2 = 0 THEN 841.89::DOUBLE ELSE 792.0::DOUBLE END AS h FROM part)
 SELECT p_partkey, CAST(floor((w - p_size * 2) * 20 + 0.5) AS BIGINT) AS total, CAST(floor((h - p_size * 2) * 20 + 0.5) AS BIGINT) AS landscape, CAST(p_size + 1 AS DOUBLE) AS body_pt, format('{:.2f}mm', p_size * 0.352778::DOUBLE) AS mm, greatest(p_size * 0.5::DOUBLE, 13.0::DOUBLE) AS statement, CAST(p_size * 2 AS BIGINT) AS half_points, CAST(p_size * 12700 AS BIGINT) AS emu,
 concat_ws('|', CASE WHEN p_partkey % 3 = 0 THEN p_brand END, CASE WHEN p_partkey % 5 > 0 THEN p_type END) AS lines, CASE WHEN p_partkey >= 5 THEN strftime(DATE '1970-01-01' + CAST(p_partkey - 5 AS INTEGER), '%Y-%m-%d') END AS date,
 CASE p_partkey % 4 WHEN 1 THEN 'a "fill" attribute' WHEN 2 THEN '"stroke:" inside a style attribute' WHEN 3 THEN '"fill:" inside a <style> element' END AS painted FROM p""",
    "q66_recoloured": """SELECT c_custkey // 10 AS doc_id, string_agg('<a fill="#' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') || '"/>', '' ORDER BY c_name) || '<b class="none"/>' AS svg, 'none' AS missed FROM customer WHERE c_custkey % 3 = 0 GROUP BY c_custkey // 10""",
    "q69_spans": """SELECT event_id, CASE event_id % 6 WHEN 0 THEN '**a<' || event_type || '**z' WHEN 1 THEN '**a<*' || event_type || '***z' WHEN 2 THEN '**a<**`' || event_type || '`z' WHEN 3 THEN '**a<**[' || event_type || '](http://a/?b&c)z' WHEN 4 THEN '**a<**' || event_type || ' (javascript:)z' ELSE '**a<**' || event_type || 'z' END AS md,
 CASE event_id % 6 WHEN 0 THEN '<strong>a&lt;' || event_type || '</strong>z' WHEN 1 THEN '<strong>a&lt;<em>' || event_type || '</em></strong>z' WHEN 2 THEN '<strong>a&lt;</strong><code>' || event_type || '</code>z' WHEN 3 THEN '<strong>a&lt;</strong><a href="http://a/?b&amp;c">' || event_type || '</a>z' WHEN 4 THEN '<strong>a&lt;</strong>' || event_type || ' <span class="muted">(javascript:)</span>z' ELSE '<strong>a&lt;</strong>' || event_type || 'z' END AS html,
 event_type || ' (host)' AS named, repeat('`', greatest(3, CAST(event_id % 6 AS INTEGER) + 1)) AS fence FROM events""",
    "q70_closed_tops": f"WITH {_G}, y AS (SELECT doc_id, page, k, c_custkey, min(k) OVER (PARTITION BY doc_id, page) AS first FROM g) SELECT doc_id, page FROM y WHERE k = first AND c_custkey % 3 <> 0",
    "q72_offers": f"""WITH c AS (SELECT c_custkey AS k, c_name, CASE WHEN c_custkey % 4 = 0 THEN 'In ' || c_mktsegment || ': ' ELSE '' END AS stage, c_custkey % 41 AS a, (c_custkey + 1) % 41 AS b, (c_custkey + 2) % 41 AS c, CAST((40 + c_custkey % 7) * 100 AS BIGINT) AS rate FROM customer WHERE c_custkey % 10 <> 0 AND c_custkey % 25 <> 5 AND c_custkey % 15 <> 5),
 t AS (SELECT *, (a + b + c) * rate AS cents FROM c)
 SELECT k AS doc_id, c_name AS title, 'para~' || stage || 'an offer.' || chr(10) || 'table~DESCRIPTION+Hours+Rate+Budget~lead+' || (a + b + c) || '+' || {_MONEY('rate')} || '+' || {_MONEY('cents')} || '/dev+24+' || {_MONEY('3000')} || '+' || {_MONEY('72000')} || '/TOTAL+++' || {_MONEY('(cents + 72000)')} || chr(10)
 || 'table~Discipline+W01+W02+W03~lead+' || {_DAYS('a')} || '+' || {_DAYS('b')} || '+' || {_DAYS('c')} || '/dev+1 day / week+—+2 days / week' AS body FROM t""",
    "q72b_refused": """SELECT c_custkey AS prop_id, '{{stage}} has no value' AS why FROM customer WHERE c_custkey % 10 <> 0 AND c_custkey % 25 <> 5 AND c_custkey % 15 <> 5 AND c_custkey % 4 <> 0
 UNION ALL SELECT c_custkey, unnest(list_filter([CASE WHEN c_custkey % 10 = 0 THEN 'template is required' END, CASE WHEN c_custkey % 25 = 5 THEN 'unknown key colour' END, CASE WHEN c_custkey % 15 = 5 THEN 'team[0].rate: more than two decimals' END], lambda x: x IS NOT NULL)) FROM customer""",
    "q72c_losses": """WITH k AS (SELECT c_custkey AS k FROM customer WHERE c_custkey % 10 <> 0 AND c_custkey % 25 <> 5 AND c_custkey % 15 <> 5)
 SELECT k AS doc_id, 'html' AS kind, '<div>raw</div>' AS message FROM k UNION ALL SELECT k, 'lookup', 'annex: no shared string for cell A2' FROM k WHERE k % 2 = 1 UNION ALL SELECT k, 'formula', 'annex: 1 formulas: cached values are used' FROM k WHERE k % 2 = 1""",
    "q73_understood": f"WITH {ORACLE_BLOCKS} SELECT doc_id, concat_ws(', ', {_KINDS}) AS line FROM blocks GROUP BY doc_id",
    "q74_between_tables": """WITH e AS (SELECT user_id AS doc_id, event_type IN ('click', 'view') AS t, lag(event_type IN ('click', 'view')) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events)
 SELECT doc_id, count(*) + count(*) FILTER (t AND before) AS n, count(*) FILTER (t AND before) AS n_hairlines FROM e GROUP BY doc_id""",
}
