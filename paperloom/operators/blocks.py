"""Blocks of documents: splitting, inventory, warnings, zones, tokens, validation.

Tables: ``docs(doc_id, title, ...)``, ``blocks(doc_id, block_ix, t, level, text, ...)``. Every
window is partitioned by doc_id and totally ordered by block_ix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import col, tokenise

# fixed values: the block kinds of the model
KINDS = ("heading", "para", "list", "table", "heatmap", "image", "code", "quote", "rule", "pagebreak")
WITH_TEXT = ("para", "heading", "quote", "list", "table", "code")
MAX_LEVEL = 3
ELEMENTS = ("strong", "em", "code", "link")
NODE = "struct<t: string, href: string, node: int>"
LEGIBLE_PT = 48
PAGE_WIDTH_PT = {"A4": 595.28, "Letter": 612.0}


def kind_of(piece) -> Column:
    """The kind of a block by how its Markdown begins."""
    p = col(piece)
    return (
        F.when(F.rlike(p, F.lit("^#{1,6} ")), "heading")
        .when(F.rlike(p, F.lit("^(-{3,}|\\*{3,}|_{3,})$")), "rule")
        .when(p == "<!-- pagebreak -->", "pagebreak")
        .when(F.rlike(p, F.lit("^([-*+] |[0-9]+\\. )")), "list")
        .when(F.startswith(p, F.lit("```")), "code")
        .when(F.startswith(p, F.lit("> ")), "quote")
        .when(F.rlike(p, F.lit("^!\\[[^\\]]*\\]\\([^)]*\\)$")), "image")
        .when(F.rlike(p, F.lit("^\\|.*\\|\\n\\|[ :|-]+\\|")), "table")
        .otherwise("para")
    )


def split_blocks(docs: DataFrame, text: str = "text") -> DataFrame:
    """Blocks of simple Markdown, one row each, split at blank lines; deeper headings count as level 3.

    For full Markdown use ``sources.markdown``; this form stays in SQL functions.
    """
    pieces = docs.select("doc_id", F.posexplode(F.split(text, "\\n[ \\t]*\\n+")).alias("block_ix", "piece")).where(F.trim("piece") != "")
    t = kind_of("piece")
    level = F.when(t == "heading", F.least(F.lit(MAX_LEVEL), F.length(F.regexp_extract("piece", "^(#+) ", 1))))
    plain = F.regexp_replace("piece", "^(#{1,6} |[-*+] |[0-9]+\\. |> )", "")
    return pieces.select("doc_id", "block_ix", t.alias("t"), level.alias("level"), plain.alias("text"))


def lift_title(blocks: DataFrame, supplied: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(titles, rest): the first level-1 heading becomes the title, 'Untitled' without one. A
    supplied title leaves all blocks in place."""
    keep = supplied if supplied is not None else F.lit(None).cast("string")
    first = F.min(F.when((F.col("t") == "heading") & (F.col("level") == 1), F.col("block_ix"))).over(Window.partitionBy("doc_id"))
    tagged = blocks.withColumn("title_ix", F.when(keep.isNull(), first))
    titles = tagged.groupBy("doc_id").agg(F.coalesce(F.max(keep), F.max(F.when(F.col("block_ix") == F.col("title_ix"), F.col("text"))), F.lit("Untitled")).alias("title"))
    return titles, tagged.where(~F.col("block_ix").eqNullSafe(F.col("title_ix"))).drop("title_ix")


def count_blocks(blocks: DataFrame) -> DataFrame:
    """How many blocks of each kind a document has."""
    return blocks.groupBy("doc_id").agg(*[F.count_if(F.col("t") == k).alias(f"n_{k}") for k in KINDS])


def heading_jumps(blocks: DataFrame) -> DataFrame:
    """Headings that lie more than one level below the heading before: doc_id, ordinal, from_level, to_level, text."""
    w = Window.partitionBy("doc_id").orderBy("block_ix")
    h = blocks.where("t = 'heading'").select("doc_id", "block_ix", "text", F.col("level").alias("to_level"), F.lag("level").over(w).alias("from_level"), F.row_number().over(w).alias("ordinal"))
    return h.where("to_level > from_level + 1").select("doc_id", "ordinal", "from_level", "to_level", "text")


def warnings(blocks: DataFrame, titles: DataFrame, page: str = "A4", margin_pt: float = 48.0) -> DataFrame:
    """Rows (doc_id, kind, ordinal, message): no title, heading jumps, tables too wide for the page, images that can't be embedded."""
    from ..functions.images import can_embed

    most = int((PAGE_WIDTH_PT[page] - 2 * margin_pt) // LEGIBLE_PT)
    untitled = titles.where("title = 'Untitled'").select("doc_id", F.lit("untitled").alias("kind"), F.lit(0).alias("ordinal"), F.lit("no title found").alias("message"))
    jumps = heading_jumps(blocks).select("doc_id", F.lit("heading_jump").alias("kind"), "ordinal", F.format_string("heading levels jump H%d→H%d at heading %d (\"%s\")", "from_level", "to_level", "ordinal", "text").alias("message"))
    out = untitled.unionByName(jumps)
    ordinal = F.row_number().over(Window.partitionBy("doc_id", "t").orderBy("block_ix"))
    if "n_cols" in blocks.columns:
        wide = blocks.where("t = 'table'").withColumn("ordinal", ordinal).where(F.col("n_cols") > most)
        out = out.unionByName(wide.select("doc_id", F.lit("wide_table").alias("kind"), "ordinal", F.format_string(f"table %d has %d columns (will not fit {page} portrait)", "ordinal", "n_cols").alias("message")))
    if "src" in blocks.columns:
        bad = blocks.where("t = 'image'").withColumn("ordinal", ordinal).where(~can_embed("src"))
        out = out.unionByName(bad.select("doc_id", F.lit("image").alias("kind"), "ordinal", F.format_string("image %d will not embed in Word", "ordinal").alias("message")))
    return out


def inspect(blocks: DataFrame) -> DataFrame:
    """One row a document: counts by kind, tokens, whether it has a title, and warnings.

    One pass: what is needed of a text, its tokens' number and a title, is taken before blocks
    are dealt out, and windows and totals share that one exchange by document.
    """
    is_title = (F.col("t") == "heading") & (F.col("level") == 1)
    n_tokens = F.when(F.col("t").isin(*WITH_TEXT), F.size(tokenise("text"))).otherwise(0)
    rows = blocks.select("doc_id", "block_ix", "t", "level", n_tokens.alias("n_tokens"), F.when(is_title, F.col("text")).alias("title"))
    whole = Window.partitionBy("doc_id")
    rows = rows.withColumn("first", F.min(F.when(is_title, F.struct("block_ix", "title"))).over(whole))
    rest = ~F.col("block_ix").eqNullSafe(F.col("first.block_ix"))
    level = F.when(rest & (F.col("t") == "heading"), F.col("level"))
    past = whole.orderBy("block_ix").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("jump", F.coalesce(level > F.last(level, ignorenulls=True).over(past) + 1, F.lit(False)))
    title = F.coalesce(F.max("first.title"), F.lit("Untitled"))
    kinds = [F.count_if(rest & (F.col("t") == k)).alias(f"n_{k}") for k in KINDS]
    out = rows.groupBy("doc_id").agg(title.alias("title"), *kinds, F.sum(F.when(rest, F.col("n_tokens")).otherwise(0)).alias("n_tokens"), F.count_if("jump").alias("n_jumps"))
    return out.withColumn("n_warnings", F.col("n_jumps") + F.when(F.col("title") == "Untitled", 1).otherwise(0)).drop("n_jumps")


def understood(counts: DataFrame) -> DataFrame:
    """The counts as one line of words, kinds without a block left out."""
    word = lambda k: F.when(F.col(f"n_{k}") > 0, F.concat(F.col(f"n_{k}").cast("string"), F.lit(f" {k}"), F.when(F.col(f"n_{k}") == 1, "").otherwise("s")))
    return counts.select("doc_id", F.concat_ws(", ", *[word(k) for k in KINDS]).alias("line"))


def cover_zones(blocks: DataFrame) -> DataFrame:
    """Each block's zone on a cover: 'panel' before the first rule, 'foot' after the last, between them 'flowing'.

    With one rule there is no foot but what follows flows; without a rule everything flows. Rules themselves have no zone.
    """
    w = Window.partitionBy("doc_id")
    ix = lambda f: f(F.when(F.col("t") == "rule", F.col("block_ix"))).over(w)
    first, last = ix(F.min), ix(F.max)
    zone = F.when(F.col("t") == "rule", None).when(F.col("block_ix") < first, "panel").when((F.col("block_ix") > last) & (last > first), "foot").otherwise("flowing")
    return blocks.withColumn("zone", zone)


def separate_tables(blocks: DataFrame) -> DataFrame:
    """blocks(doc_id, block_ix, t) with ``sub_ix`` 1, and a row of kind 'hairline' (sub_ix 0) before a table that follows a table."""
    after = F.lag("t").over(Window.partitionBy("doc_id").orderBy("block_ix"))
    touching = (F.col("t") == "table") & (after == "table")
    parts = F.when(touching, F.array(F.struct(F.lit(0).alias("sub_ix"), F.lit("hairline").alias("t")), F.struct(F.lit(1).alias("sub_ix"), F.col("t").alias("t")))).otherwise(F.array(F.struct(F.lit(1).alias("sub_ix"), F.col("t").alias("t"))))
    return blocks.withColumn("_parts", parts).select("doc_id", "block_ix", F.explode("_parts").alias("p")).select("doc_id", "block_ix", "p.sub_ix", "p.t")


def split_at_pagebreak(blocks: DataFrame) -> DataFrame:
    """'page' up to the first page break, 'rest' from it on."""
    at = F.min(F.when(F.col("t") == "pagebreak", F.col("block_ix"))).over(Window.partitionBy("doc_id"))
    return blocks.withColumn("part", F.when(F.col("block_ix") < F.coalesce(at, F.lit(2**31 - 1)), "page").otherwise("rest"))


def doc_tokens(blocks: DataFrame) -> DataFrame:
    """(doc_id, tokens): a document's tokens as one list in block order; kinds without text give none."""
    words = F.struct("block_ix", F.when(F.col("t").isin(*WITH_TEXT), tokenise("text")).alias("words"))
    lists = F.transform(F.array_sort(F.collect_list(words)), lambda x: F.coalesce(x["words"], F.array().cast("array<string>")))
    return blocks.groupBy("doc_id").agg(F.flatten(lists).alias("tokens"))


def divergence(expected: Column, found: Column) -> Column:
    """(pos, expected, found) at the first position where two lists differ, their lengths included; null if they are equal."""
    differ = F.zip_with(expected, found, lambda a, b: ~a.eqNullSafe(b))
    at = (F.array_position(differ, F.lit(True)) - 1).cast("int")
    return F.when(at >= 0, F.struct(at.alias("pos"), F.get(expected, at).alias("expected"), F.get(found, at).alias("found")))


def first_divergence(source: DataFrame, assembled: DataFrame) -> DataFrame:
    """The first position, by document, where two token lists (doc_id, tokens) differ; a missing list is empty."""
    both = source.withColumnRenamed("tokens", "a").join(assembled.withColumnRenamed("tokens", "b"), "doc_id", "full_outer")
    none = F.array().cast("array<string>")
    x = divergence(F.coalesce("a", none), F.coalesce("b", none))
    return both.select("doc_id", x.alias("x")).where("x is not null").select("doc_id", "x.pos", "x.expected", "x.found")


def violations(blocks: DataFrame) -> DataFrame:
    """Broken rules as rows (doc_id, block_ix, why) over blocks with the columns level, depth, start, src, n_cols, n_aligned, spans."""
    have = set(blocks.columns)
    rules = [("unknown block type", ~F.col("t").isin(*KINDS), {"t"})]
    rules += [("level must be 1, 2 or 3", (F.col("t") == "heading") & ~F.coalesce(F.col("level").between(1, MAX_LEVEL), F.lit(False)), {"level"})]
    rules += [("list needs a non-negative depth", (F.col("t") == "list") & ~F.coalesce(F.col("depth") >= 0, F.lit(False)), {"depth"})]
    rules += [("start must be a positive integer", (F.col("t") == "list") & (F.col("start") < 1), {"start"})]
    rules += [("a table needs at least one column", (F.col("t") == "table") & ~F.coalesce(F.col("n_cols") > 0, F.lit(False)), {"n_cols"})]
    rules += [("align differs from the columns", (F.col("t") == "table") & (F.col("n_aligned") != F.col("n_cols")), {"n_cols", "n_aligned"})]
    rules += [("image needs a non-empty src", (F.col("t") == "image") & (F.coalesce("src", F.lit("")) == ""), {"src"})]
    found = F.array_compact(F.array(*[F.when(test, F.lit(why)) for why, test, needs in rules if needs <= have]))
    if "spans" in have:
        found = F.concat(found, F.coalesce(span_faults(F.col("spans")), F.array().cast("array<string>")))
    return blocks.select("doc_id", "block_ix", F.explode(found).alias("why"))


def span_faults(spans: Column) -> Column:
    """What is wrong with a block's spans (v, path of t, href, node): a reason for each element that is of no known
    kind or a link without a target, however many spans lie in it, and for each text of no element without a value.

    Paths are folded from the left: an element is new if its number stands in no earlier span's path.
    """
    none = F.array().cast("array<int>")
    fresh = lambda acc, path: F.filter(path, lambda n: ~F.array_contains(acc["seen"], n["node"]))
    fault = lambda n: F.when(~F.coalesce(n["t"].isin(*ELEMENTS), F.lit(False)), F.concat(F.lit("unknown inline type "), F.coalesce(n["t"], F.lit("null")))).when((n["t"] == "link") & n["href"].isNull(), "a link needs a target")
    bare = lambda s: F.when(s["v"].isNull() & (F.size(s["path"]) == 0), F.array(F.lit("a text needs a value"))).otherwise(F.array().cast("array<string>"))

    def step(acc, s):
        path = F.coalesce(s["path"], F.array().cast(f"array<{NODE}>"))
        whys = F.array_compact(F.transform(fresh(acc, path), fault))
        return F.struct(F.array_union(acc["seen"], F.transform(path, lambda n: n["node"])).alias("seen"), F.concat(acc["whys"], whys, bare(s)).alias("whys"))

    start = F.struct(none.alias("seen"), F.array().cast("array<string>").alias("whys"))
    return F.aggregate(spans, start, step, lambda acc: acc["whys"])


def ragged_rows(cells: DataFrame) -> DataFrame:
    """Rows of tables whose number of cells differs from the head's (row -1): doc_id, block_ix, row_ix, n_cells, n_cols."""
    n = cells.groupBy("doc_id", "block_ix", "row_ix").count()
    head = F.max(F.when(F.col("row_ix") == -1, F.col("count"))).over(Window.partitionBy("doc_id", "block_ix"))
    return n.withColumn("n_cols", head).where("row_ix >= 0 and count <> n_cols").select("doc_id", "block_ix", "row_ix", F.col("count").alias("n_cells"), "n_cols")
