"""List numbering and other runs of neighbours (gaps and islands).

``paras(doc_id, para_ix, num_id, ilvl)``; numbering definitions as side tables: ``nums(doc_id,
num_id, abstract_id)``, ``levels(doc_id, abstract_id, ilvl, num_fmt, start, lvl_restart)``,
``overrides(doc_id, num_id, ilvl, start)``, ``style_links(doc_id, style, abstract_id, kind)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEPTH = 9  # fixed value: levels of a list definition


def resolve_levels(paras: DataFrame, nums: DataFrame, levels: DataFrame, overrides: DataFrame, style_links: DataFrame | None = None) -> DataFrame:
    """paras with num_fmt, start and lvl_restart; ``resolved`` is false where no definition answers.

    A definition without levels of its own is followed once through its style link. The
    level itself, else level 0, answers; a number's own override of the start wins.
    """
    n = nums.select("doc_id", "num_id", "abstract_id")
    if style_links is not None:
        own = levels.select("doc_id", "abstract_id").distinct().withColumn("own", F.lit(True))
        to = style_links.where("kind = 'styleLink'").select("doc_id", "style", F.col("abstract_id").alias("target"))
        by = style_links.where("kind = 'numStyleLink'").select("doc_id", "abstract_id", "style")
        n = n.join(own, ["doc_id", "abstract_id"], "left").join(by, ["doc_id", "abstract_id"], "left").join(to, ["doc_id", "style"], "left")
        n = n.select("doc_id", "num_id", F.when(F.col("own"), F.col("abstract_id")).otherwise(F.coalesce("target", "abstract_id")).alias("abstract_id"))
    exact = levels.select("doc_id", "abstract_id", "ilvl", F.struct("num_fmt", "start", "lvl_restart").alias("exact"))
    zero = levels.where("ilvl = 0").select("doc_id", "abstract_id", F.struct("num_fmt", "start", "lvl_restart").alias("zero"))
    over = overrides.select("doc_id", "num_id", "ilvl", F.col("start").alias("own_start"))
    out = paras.join(n, ["doc_id", "num_id"], "left").join(exact, ["doc_id", "abstract_id", "ilvl"], "left").join(zero, ["doc_id", "abstract_id"], "left").join(over, ["doc_id", "num_id", "ilvl"], "left")
    level = F.coalesce("exact", "zero")
    return out.select(*[F.col(c) for c in paras.columns], level["num_fmt"].alias("num_fmt"), F.coalesce("own_start", level["start"], F.lit(1)).alias("start"), level["lvl_restart"].alias("lvl_restart"), level.isNotNull().alias("resolved"))


def item_numbers(paras: DataFrame) -> DataFrame:
    """paras(doc_id, para_ix, num_id, ilvl, start, lvl_restart) with each item's ``number``.

    A counter runs by number and level from its start. By default any shallower item of the
    same number resets the deeper ones; lvl_restart = N lets only levels up to N - 1 do so,
    and 0 none. The reset epoch of a level is how many resetting items came before, so the
    number is a rank within (number, level, epoch).
    """
    number = Window.partitionBy("doc_id", "num_id")
    before = number.orderBy("para_ix").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # what resets level d is up to d's own rule, which every row of the number needs to know: one value a level
    rows = paras.withColumns({f"_rule{d}": F.max(F.when(F.col("ilvl") == d, F.col("lvl_restart"))).over(number) for d in range(DEPTH)})

    def resets(d: int) -> Column:
        reach = F.least(F.coalesce(F.col(f"_rule{d}"), F.lit(d)), F.lit(d))
        return F.sum(F.when(F.col("ilvl") < reach, 1).otherwise(0)).over(before)

    epoch = F.element_at(F.array(*[resets(d) for d in range(DEPTH)]), F.col("ilvl") + 1)
    rows = rows.withColumn("_epoch", epoch)
    rank = F.row_number().over(Window.partitionBy("doc_id", "num_id", "ilvl", "_epoch").orderBy("para_ix"))
    return rows.select(*paras.columns, (F.col("start") + rank - 1).alias("number"))


def islands(df: DataFrame, key: list[str], order: str, *same: Column, name: str = "island") -> DataFrame:
    """df with a number that changes wherever a row differs in ``same`` from the row before."""
    w = Window.partitionBy(*key).orderBy(order)
    now = F.struct(*[c.alias(f"c{k}") for k, c in enumerate(same)])
    change = F.when(F.row_number().over(w) == 1, 1).otherwise(F.when(now.eqNullSafe(F.lag(now).over(w)), 0).otherwise(1))
    return df.withColumn("_change", change).withColumn(name, F.sum("_change").over(w)).drop("_change")


def list_blocks(items: DataFrame) -> DataFrame:
    """Items (doc_id, item_ix, ordered, depth, num_id, number, text) joined to list blocks: consecutive items of one list and depth."""
    runs = islands(items, ["doc_id"], "item_ix", F.col("ordered"), F.col("depth"), F.col("num_id"))
    piece = F.struct("item_ix", "text")
    return runs.groupBy("doc_id", "island", "ordered", "depth").agg(F.min("number").alias("start"), F.count("*").alias("n_items"), F.transform(F.array_sort(F.collect_list(piece)), lambda x: x["text"]).alias("items"))


def merge_adjacent(nodes: DataFrame, key: list[str], order: str, path: Column, text: str = "text") -> DataFrame:
    """Neighbouring nodes of the same path folded into one, their texts joined."""
    runs = islands(nodes.withColumn("_path", path), key, order, F.col("_path"))
    return runs.groupBy(*key, "island").agg(F.min(order).alias(order), F.first("_path").alias("path"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), "").alias(text))


def sections(blocks: DataFrame, wide: Column) -> DataFrame:
    """Runs of blocks of one page orientation; the first section alone has the first page's header."""
    runs = islands(blocks.withColumn("wide", wide), ["doc_id"], "block_ix", F.col("wide"), name="section")
    return runs.groupBy("doc_id", "section", "wide").agg(F.min("block_ix").alias("from_ix"), F.max("block_ix").alias("to_ix")).withColumn("first_page_header", F.col("section") == 1)
