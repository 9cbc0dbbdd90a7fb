"""Page geometry: rectangles, text runs, grids, tables, repeated furniture.

Tables: ``rects(key..., rect_ix, x0, y0, x1, y1)``, ``runs(key..., run_ix, text, x, y, size_pt)``, y
upward. What is sequential by page (union-find, anchored clusters) works inside one page's
group or stream of sorted rows; everything else is a plan over all pages.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import strip_digits
from ..sources.base import kept

# fixed values: tolerances in points, the frame's share of a page, the least repeats, caps
EDGE_TOL = LINE_TOL = CLOSE_TOL = POSITION_TOL = 2.0
COLUMN_TOL = 3.0
FRAME = 0.75
MIN_REPEAT = 2
MAX_PAGES, MAX_RECTS = 60, 5000
LISTED = 20
SHORT = 64  # values of a key that are taken a step at a time with those of others


def distinct_rects(rects: DataFrame, key: list[str]) -> DataFrame:
    return rects.dropDuplicates([*key, "x0", "y0", "x1", "y1"])


def without_page_frame(rects: DataFrame, width: Column, height: Column) -> DataFrame:
    """Without rectangles that take three quarters of the page both ways."""
    return rects.where((F.col("x1") - F.col("x0") < FRAME * width) | (F.col("y1") - F.col("y0") < FRAME * height))


def anchored(df: DataFrame, key: list[str], value: str, tol: float) -> DataFrame:
    """df with ``anchor``, the first value of each value's cluster within its key: a value more than tol beyond
    the last anchor opens a new cluster. Rows of a key come together and in order, and of those gone by only the
    last anchor is held, so a key may have any number of values. A null value has no anchor."""
    kind = T.StructType([*[f for f in df.schema.fields if f.name != "anchor"], T.StructField("anchor", T.DoubleType())])
    names = [f.name for f in kind.fields[:-1]]

    def run(batches):
        last, anchor = None, -np.inf
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            opens = np.zeros(n, bool)
            for k in key:
                code = pc.fill_null(pc.dictionary_encode(b.column(k), null_encoding="encode").indices, -1).to_numpy(zero_copy_only=False)
                opens[1:] |= code[1:] != code[:-1]
            ends = [tuple(b.column(k)[j].as_py() for k in key) for j in (0, n - 1)]
            opens[0] = ends[0] != last
            v = pc.cast(b.column(value), pa.float64()).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(opens)
            at, anchor = anchors(v, np.concatenate(([0], starts)) if not opens[0] else starts, tol, -np.inf if opens[0] else anchor)
            last = ends[1]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(at, mask=np.isnan(v))], names=[*names, "anchor"])

    return df.repartition(*key).sortWithinPartitions(*key, value).mapInArrow(run, kind)


def anchors(v: np.ndarray, starts: np.ndarray, tol: float, carried: float = -np.inf) -> tuple[np.ndarray, float]:
    """The anchor of each of v, sorted within the parts that begin at starts, and the last part's last one; the first part goes on from one carried over."""
    out = np.full(len(v), carried)
    first = starts + np.add.reduceat(np.isnan(v), starts)  # nulls come first
    end = np.append(starts[1:], len(v))
    now = np.full(len(starts), -np.inf)
    now[0] = carried
    # short parts all at once, a place a step
    at = np.flatnonzero((end - first <= SHORT) & (first < end))
    i = first[at]
    while len(at):
        now[at] = np.where(v[i] - now[at] > tol, v[i], now[at])
        out[i] = now[at]
        more = i + 1 < end[at]
        at, i = at[more], i[more] + 1
    # long ones from anchor to anchor
    for k in np.flatnonzero(end - first > SHORT):
        j, z, a = int(first[k]), int(end[k]), now[k]
        while j < z:
            if v[j] - a > tol:
                a = v[j]
            to = j + int(np.searchsorted(v[j:z], a + tol, "right"))
            while to < z and v[to] - a <= tol:  # the sum may round otherwise than the difference
                to += 1
            while to > j + 1 and v[to - 1] - a > tol:
                to -= 1
            to = max(to, j + 1)
            out[j:to] = a
            j = to
        now[k] = a
    return out, float(now[-1])


def cluster_means(df: DataFrame, key: list[str], value: str, tol: float = POSITION_TOL) -> DataFrame:
    """(key..., value, mean): the mean over the distinct values of each value's cluster."""
    v = anchored(df.select(*key, value).distinct(), key, value, tol)
    return v.select(*key, value, F.avg(value).over(Window.partitionBy(*key, "anchor")).alias("mean"))


def cluster_edges(edges: DataFrame, key: list[str], tol: float = EDGE_TOL) -> DataFrame:
    """Clusters of edges (key..., value, rect_ix): mean over all edges and how many rectangles take part."""
    return anchored(edges, key, "value", tol).groupBy(*key, "anchor").agg(F.avg("value").alias("mean"), F.count_distinct("rect_ix").alias("n_rects"))


def boundaries(edges: DataFrame, key: list[str]) -> DataFrame:
    """Grid lines: clusters with two rectangles or more, and the outermost ones if any qualifies."""
    c = cluster_edges(edges, key)
    w = Window.partitionBy(*key)
    c = c.withColumns({"first": F.min("anchor").over(w), "last": F.max("anchor").over(w), "most": F.max("n_rects").over(w)})
    c = c.where((F.col("most") >= MIN_REPEAT) & ((F.col("n_rects") >= MIN_REPEAT) | (F.col("anchor") == F.col("first")) | (F.col("anchor") == F.col("last"))))
    return c.select(*key, (F.row_number().over(Window.partitionBy(*key).orderBy("mean")) - 1).alias("ix"), F.col("mean").alias("value"))


def implied_top(ys: DataFrame, key: list[str]) -> DataFrame:
    """A further line above the last, by the median gap, where that is positive."""
    gap = F.col("value") - F.lag("value").over(Window.partitionBy(*key).orderBy("ix"))
    top = ys.withColumn("gap", gap).groupBy(*key).agg((F.max("ix") + 1).alias("ix"), F.max("value").alias("top"), F.percentile("gap", 0.5).alias("gap"))
    return ys.unionByName(top.where("gap > 0").select(*key, "ix", (F.col("top") + F.col("gap")).alias("value")))


def closed_at_top(rects: DataFrame, ys: DataFrame, key: list[str]) -> DataFrame:
    """Keys whose topmost band some rectangle already spans."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("ix")))
    two = ys.withColumn("r", rank).where("r <= 2").groupBy(*key).agg(F.max("value").alias("top"), F.min("value").alias("below"))
    near = (F.abs(F.col("y0") - F.col("below")) <= CLOSE_TOL) & (F.abs(F.col("y1") - F.col("top")) <= CLOSE_TOL)
    return rects.join(two, key).where(near).select(*key).distinct()


def components(rects: DataFrame, key: list[str]) -> DataFrame:
    """rects with ``component``, the least rect_ix that a chain of touching rectangles reaches.

    Two rectangles touch if an edge of each lies within 2 points along one axis and they
    overlap along the other. By page (at most a few thousand rectangles): a
    sweep along x and union-find, not all pairs.
    """
    kind = T.StructType([*rects.schema.fields, T.StructField("component", rects.schema["rect_ix"].dataType)])

    def run(batches):
        held = None
        for pdf in batches:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            last = np.ones(len(pdf), bool)
            for k in key:
                last &= (pdf[k] == pdf[k].iloc[-1]).to_numpy() if len(pdf) else last
            start = int(np.argmax(last)) if len(pdf) else 0
            held = pdf.iloc[start:]
            if start:
                yield label(pdf.iloc[:start], key)
        if held is not None and len(held):
            yield label(held, key)

    # whole pages come together, in order of x; many small pages are labelled at once
    return rects.repartition(*key).sortWithinPartitions(*key, "x0", "rect_ix").mapInPandas(run, kind)


def label(pdf: pd.DataFrame, key: list[str]) -> pd.DataFrame:
    """Components of whole pages in a frame sorted by page and x0."""
    a = pdf[["x0", "y0", "x1", "y1"]].to_numpy(float)
    page = pdf.groupby(key, sort=False, dropna=False).ngroup().to_numpy()
    n = len(a)
    pairs = []
    i, step = np.arange(n), 1
    while len(i := i[i + step < n]):
        j = i + step
        ok = (page[i] == page[j]) & (a[j, 0] <= a[i, 2] + EDGE_TOL)
        i, j = i[ok], j[ok]
        hit = touching(a[i], a[j])
        pairs.append(np.stack([i[hit], j[hit]]))
        step += 1
    u, v = np.concatenate(pairs, axis=1) if pairs else np.zeros((2, 0), int)
    root = np.arange(n)
    while True:
        before = root.copy()
        low = np.minimum(root[u], root[v])
        np.minimum.at(root, root[u], low)
        np.minimum.at(root, root[v], low)
        root = root[root]
        if (root == before).all():
            break
    least = pd.Series(pdf["rect_ix"].to_numpy()).groupby(root).transform("min")
    return pdf.assign(component=least.to_numpy())


def touching(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the rectangles of two lists touch, row by row."""
    close = lambda p, q: np.min(np.abs(np.stack([b[:, p] - a[:, p], b[:, p] - a[:, q], b[:, q] - a[:, p], b[:, q] - a[:, q]])), axis=0) <= EDGE_TOL
    over = lambda p, q: np.maximum(b[:, p], a[:, p]) <= np.minimum(b[:, q], a[:, q])
    return (close(0, 2) & over(1, 3)) | (close(1, 3) & over(0, 2))


def largest_component(rects: DataFrame, key: list[str]) -> DataFrame:
    """The rectangles of each page's largest component; ties to the topmost, then the leftmost."""
    c = rects.groupBy(*key, "component").agg(F.count("*").alias("n"), F.max("y1").alias("top"), F.min("x0").alias("left"))
    best = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("n"), F.desc("top"), "left", "component"))
    return rects.join(c.withColumn("r", best).where("r = 1").select(*key, "component"), [*key, "component"])


def find_grids(rects: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(xs, ys) of each page's grid: lines (key..., ix, value). A grid has two lines each way and isn't a lone box."""
    # what is read several times below is written once: a page's largest component and its few lines
    one = kept(largest_component(components(distinct_rects(rects, key), key), key))
    edge = lambda p, q: one.select(*key, "rect_ix", F.explode(F.array(p, q)).alias("value"))
    xs, ys = kept(boundaries(edge("x0", "x1"), key)), kept(boundaries(edge("y0", "y1"), key))
    closed = closed_at_top(one, ys, key)
    ys = kept(ys.join(closed, key, "left_semi").unionByName(implied_top(ys.join(closed, key, "left_anti"), key)))
    nx, ny = (d.groupBy(*key).count().withColumnRenamed("count", c) for d, c in ((xs, "nx"), (ys, "ny")))
    # a single line across has no implied second one
    real = nx.join(ny, key).where("nx >= 2 and ny >= 2 and not (nx = 2 and ny = 2)").select(*key)
    # Spark takes a semi join for as large as its left side's files, which say little of rows that repeat
    return kept(xs.join(real, key, "left_semi")), kept(ys.join(real, key, "left_semi"))


def bands(lines: DataFrame, key: list[str]) -> DataFrame:
    """Half-open bands [lo, hi) between neighbouring lines."""
    nxt = F.lead("value").over(Window.partitionBy(*key).orderBy("ix"))
    return lines.select(*key, "ix", F.col("value").alias("lo"), nxt.alias("hi")).where("hi is not null")


def assign_bands(points: DataFrame, lines: DataFrame, key: list[str], value: str, name: str) -> DataFrame:
    """points with the index of the band that holds a value, null outside: a join on the page with a range test."""
    b = bands(lines, key).select(*[F.col(k).alias(f"_{k}") for k in key], F.col("ix").alias(name), "lo", "hi")
    hit = (F.col(value) >= F.col("lo")) & (F.col(value) < F.col("hi"))
    return points.join(b, [*[F.col(k) == F.col(f"_{k}") for k in key], hit], "left").drop("lo", "hi", *[f"_{k}" for k in key])


def reading_text(runs: DataFrame, key: list[str], tol: float = LINE_TOL) -> DataFrame:
    """The text of each key in reading order: lines anchored at their topmost run, then by x, pieces that aren't blank."""
    down = runs.withColumn("depth", -F.col("y"))
    lined = anchored(down, key, "depth", tol)
    piece = F.struct("anchor", "x", "run_ix", F.trim("text").alias("v"))
    ordered = F.filter(F.transform(F.array_sort(F.collect_list(piece)), lambda p: p["v"]), lambda v: v != "")
    return lined.groupBy(*key).agg(F.array_join(ordered, " ").alias("text"))


def table_cells(runs: DataFrame, xs: DataFrame, ys: DataFrame, key: list[str]) -> DataFrame:
    """(key..., row, col, text) of all cells of a grid, blank ones too, row 0 on top."""
    placed = assign_bands(assign_bands(runs, xs, key, "x", "col"), ys, key, "y", "band").where("col is not null and band is not null")
    texts = reading_text(placed, [*key, "band", "col"])
    spine = bands(xs, key).select(*key, F.col("ix").alias("col")).join(bands(ys, key).select(*key, F.col("ix").alias("band")), key)
    top = F.max("band").over(Window.partitionBy(*key))
    return spine.join(texts, [*key, "band", "col"], "left").select(*key, (top - F.col("band")).alias("row"), "col", F.coalesce("text", F.lit("")).alias("text"))


def heading_levels(runs: DataFrame, key: list[str]) -> DataFrame:
    """(key..., half_pt, level): sizes above the most frequent one, largest first, at most three levels.

    Sizes are in half points; of equally frequent ones the one seen first is the body's.
    """
    size = runs.withColumn("half_pt", F.floor(F.col("size_pt") * 2 + 0.5).cast("int"))
    n = size.groupBy(*key, "half_pt").agg(F.count("*").alias("n"), F.min("run_ix").alias("seen"))
    body = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("n"), "seen"))
    b = n.withColumn("r", body).where("r = 1").select(*key, F.col("half_pt").alias("body"))
    larger = n.join(b, key).where("half_pt > body")
    return larger.select(*key, "half_pt", F.least(F.lit(3), F.dense_rank().over(Window.partitionBy(*key).orderBy(F.desc("half_pt")))).alias("level"))


def prose_blocks(runs: DataFrame, levels: DataFrame, key: list[str], doc: list[str]) -> DataFrame:
    """Each run as a heading or paragraph, in reading order (from the top, then from the left)."""
    sized = runs.withColumn("half_pt", F.floor(F.col("size_pt") * 2 + 0.5).cast("int")).join(levels, [*doc, "half_pt"], "left")
    order = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("y"), "x", "run_ix")) - 1
    return sized.select(*key, order.alias("block_ix"), F.when(F.col("level").isNull(), "para").otherwise("heading").alias("t"), "level", "text")


def _means(values: Column, tol: float) -> Column:
    """For each of sorted distinct values the mean of its anchored cluster."""
    start = F.struct(F.lit(None).cast("double").alias("anchor"), F.array().cast("array<array<double>>").alias("of"))
    opens = lambda acc, v: acc["anchor"].isNull() | (v - acc["anchor"] > tol)
    done = lambda acc: F.slice(acc["of"], 1, F.greatest(F.size(acc["of"]) - 1, F.lit(0)))
    step = lambda acc, v: F.when(opens(acc, v), F.struct(v.alias("anchor"), F.array_append(acc["of"], F.array(v)).alias("of"))).otherwise(F.struct(acc["anchor"].alias("anchor"), F.array_append(done(acc), F.array_append(F.element_at(acc["of"], -1), v)).alias("of")))
    clusters = F.aggregate(values, start, step, lambda acc: acc["of"])
    mean = lambda vs: F.aggregate(vs, F.lit(0.0), lambda s, v: s + v) / F.size(vs)
    return F.flatten(F.transform(clusters, lambda vs: F.array_repeat(mean(vs), F.size(vs))))


def find_repeated(runs: DataFrame, doc: list[str], page: str = "page", least_pages: int = 2) -> DataFrame:
    """Texts that stand at one place of every page and are equal but for digits: doc..., texts, x, y_top, y_bottom, pages.

    One aggregate finds a document's pages and the clusters of both axes; runs are read once more to meet them.
    """
    seen = lambda c: F.array_sort(F.collect_set(F.col(c).cast("double")))
    found = runs.groupBy(*doc).agg(F.count_distinct(page).alias("n_pages"), seen("x").alias("_x"), seen("y").alias("_y")).where(F.col("n_pages") >= least_pages)
    found = found.withColumns({"_x_mean": _means(F.col("_x"), POSITION_TOL), "_y_mean": _means(F.col("_y"), POSITION_TOL)})
    of = lambda c: F.get(f"_{c}_mean", (F.array_position(f"_{c}", F.col(c).cast("double")) - 1).cast("int"))
    placed = runs.join(found, doc).select(*doc, page, "text", "y", "n_pages", of("x").alias("x_mean"), of("y").alias("y_mean"))
    g = placed.groupBy(*doc, "x_mean", "y_mean").agg(F.first("n_pages").alias("n_pages"), F.count_distinct(page).alias("pages"), F.count_distinct(strip_digits("text")).alias("kinds"), F.array_sort(F.collect_set("text")).alias("texts"), F.max("y").alias("y_top"), F.min("y").alias("y_bottom"))
    return g.where("pages = n_pages and kinds = 1").select(*doc, "texts", F.col("x_mean").alias("x"), "y_top", "y_bottom", "pages")


def split_chrome(runs: DataFrame, above: Column, below: Column) -> DataFrame:
    """runs with ``removed``: strictly above or below a declared line; a line that isn't declared is null."""
    return runs.withColumn("removed", F.coalesce(F.col("y") > above, F.lit(False)) | F.coalesce(F.col("y") < below, F.lit(False)))


def chrome_report(split: DataFrame, doc: list[str], above: Column, below: Column, page: str = "page") -> DataFrame:
    """What a declared rule did, by document: removed, inert (with the range of y), advisory without a rule, or single page."""
    g = split.groupBy(*doc).agg(F.count_if("removed").alias("n_removed"), F.count_distinct(page).alias("n_pages"), F.max("y").alias("y_max"), F.min("y").alias("y_min"), F.max(above.isNotNull() | below.isNotNull()).alias("has_rule"))
    status = F.when(F.col("n_removed") > 0, "removed").when(F.col("has_rule"), "inert").when(F.col("n_pages") < 2, "single page").otherwise("advisory")
    return g.withColumn("status", status)


def rule_violations(rules: DataFrame, above: str, below: str) -> DataFrame:
    """Declared lines that aren't finite, or whose upper isn't above the lower."""
    bad = lambda c: F.isnan(c) | (F.abs(c) == float("inf"))
    why = F.when(bad(above) | bad(below), "not a finite number").when(F.col(above) <= F.col(below), "the upper line must lie above the lower")
    return rules.withColumn("why", why).where("why is not null")


def join_anchor(blocks: DataFrame, doc: list[str], repeated: Column) -> DataFrame:
    """blocks with ``anchor_ix``, the last block up to here that isn't repeated furniture."""
    w = Window.partitionBy(*doc).orderBy("block_ix").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return blocks.withColumn("anchor_ix", F.last(F.when(~repeated, F.col("block_ix")), ignorenulls=True).over(w))


def continue_tables(tables: DataFrame, doc: list[str]) -> DataFrame:
    """(doc..., page, table_no) of tables page by page (doc..., page, head, xs, free).

    A table goes on from the one before if nothing but repeated furniture lies between them
    (``free``), the columns agree in number with the running table's head and, within 3 points,
    in place with the page before, and its first row doesn't repeat the running table's head. That
    head is the first fragment's, so pages (sixty at most) are folded in order.
    """
    page = tables.schema["page"].dataType.simpleString()
    near = lambda a, b: (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, lambda p, q: F.abs(p - q) <= COLUMN_TOL), lambda x: F.coalesce(x, F.lit(False)))
    goes_on = lambda acc, t: F.coalesce(t["free"] & (acc["no"] > 0) & (F.size(acc["head"]) == F.size(t["head"])) & (acc["head"] != t["head"]) & near(acc["xs"], t["xs"]), F.lit(False))
    number = lambda acc, t: acc["no"] + F.when(goes_on(acc, t), 0).otherwise(1)

    def step(acc, t):
        head = F.when(goes_on(acc, t), acc["head"]).otherwise(t["head"])
        out = F.array_append(acc["out"], F.struct(t["page"].alias("page"), number(acc, t).alias("table_no")))
        return F.struct(number(acc, t).alias("no"), head.alias("head"), t["xs"].alias("xs"), out.alias("out"))

    start = F.struct(F.lit(0).cast("long").alias("no"), F.array().cast("array<string>").alias("head"), F.array().cast("array<double>").alias("xs"), F.array().cast(f"array<struct<page:{page},table_no:long>>").alias("out"))
    rows = F.array_sort(F.collect_list(F.struct("page", "head", "xs", "free")))
    folded = tables.groupBy(*doc).agg(F.aggregate(rows, start, lambda acc, t: step(acc, t), lambda acc: acc["out"]).alias("out"))
    return folded.select(*doc, F.explode("out").alias("o")).select(*doc, "o.page", "o.table_no")
