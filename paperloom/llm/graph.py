"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, remove, shared_dir

Keep = Callable[[DataFrame, str], DataFrame]


def _large_star(edges: DataFrame, keep: Keep) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = keep(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "large")
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame, keep: Keep) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = keep(down.groupBy("u").agg(F.min("v").alias("m")), "small")
    hung = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether every node hangs on one other, on which none hangs: then no step changes anything."""
    n, hanging = edges.agg(F.count("*"), F.count_distinct("u")).first()
    return n == hanging and not edges.join(edges.select(F.col("v").alias("u")).distinct(), "u", "left_semi").limit(1).count()


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Rows ``(node, component)`` for every node of ``links(u, v)``, a component being its smallest node.

    Nothing of the graph reaches the driver but two counts a round.
    Each step pre-aggregates a node's minimum and writes it before it is joined back: both
    sides of that join are then dealt out for it alone, and the rows of a node with very many
    neighbours can be split like any skewed join key. Each round is written to the shared
    folder and the round before it deleted. An empty link table gives an empty result; loops
    and repeated links change nothing; links with a null end are ignored.
    """
    spark = links.sparkSession
    folder = shared_dir(spark)
    edges = materialise(links.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges", folder)
    for _ in range(max_rounds):
        new = shared_dir(spark)
        keep = lambda df, name, new=new: materialise(df, name, new)
        edges = keep(_small_star(keep(_large_star(edges, keep), "hung"), keep), "edges")
        remove(spark, folder)
        folder = new
        if _stars(edges):
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
