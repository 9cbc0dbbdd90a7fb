"""Shards by a hierarchical weighted hash tree (operator 4); DataFrame functions only.

A key descends from the root to a region, a rack and a shard. At each level every child
draws ``ln(u) / weight`` with u in (0, 1) hashed from key and child, and the largest draw
wins (weighted rendezvous hashing), so a child's weight changes only what moves into or
out of that child, and below an unchanged subtree nothing moves. A planned grid of regions
and racks holds the first shards; each shard beyond it hangs in a region of its own, so
one more shard takes rows only into itself.

Slots are gapless numbers within a shard without sorting a shard in one task. Equal rows
(id, size, checksum) are counted first, and only the different ones, with their counts, are
shuffled, placed and numbered: those of a shard fall into hashed buckets of about
``PER_BUCKET`` rows, a prefix sum over the buckets' counts gives each its first slot, and
another one runs within a bucket. At the end a row is made again for each of its copies,
those of very many in parts of ``PART``.

Cases: a null text has size 8 and the checksum of an empty text; a null doc_id is a key of
its own; repeated rows get different slots in the same shard; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

PER_BUCKET, PART = 100_000, 1 << 16
BITS = 52  # 13 hexadecimal digits of an MD5


@dataclass(frozen=True)
class Topology:
    """regions[i][j] holds the weights of the shards in rack j of region i."""

    regions: tuple[tuple[tuple[float, ...], ...], ...]

    @classmethod
    def planned(cls, shards: int, regions: int = 2, racks: int = 3, per_rack: int = 4) -> Topology:
        """The grid's first shards of weight 1, and a region for each shard beyond it."""
        out, left = [], shards
        for _ in range(regions):
            region = []
            for _ in range(racks):
                if n := min(per_rack, left):
                    region.append((1.0,) * n)
                    left -= n
            if region:
                out.append(tuple(region))
        return cls(tuple(out) + (((1.0,),),) * left)


def draw(key: Column, node: str) -> Column:
    """A uniform number in (0, 1) from key and node."""
    x = F.conv(F.substring(F.md5(F.concat(key, F.lit("|" + node)).cast("binary")), 1, BITS // 4), 16, 10).cast("double")
    return (x + 0.5) / float(2**BITS)


def winner(key: Column, nodes: list[str], weights: list[float]) -> Column:
    """The index of the child with the largest draw; ties to the larger index."""
    if len(nodes) == 1:
        return F.lit(0)
    return F.array_max(F.array(*[F.struct((F.log(draw(key, n)) / w).alias("score"), F.lit(k).alias("at")) for k, (n, w) in enumerate(zip(nodes, weights, strict=True))]))["at"]


def pick(col: Column, options: list[Column]) -> Column:
    return reduce(lambda rest, kv: F.when(col == kv[0], kv[1]).otherwise(rest), list(enumerate(options))[:-1], options[-1])


def with_shard(df: DataFrame, key: Column, topology: Topology, name: str) -> DataFrame:
    """df and the shard's number, counted through regions and racks in order."""
    first, n = [], 0
    for region in topology.regions:
        first.append([])
        for rack in region:
            first[-1].append(n)
            n += len(rack)
    total = lambda x: float(sum(map(total, x))) if isinstance(x, tuple) else float(x)
    at = lambda *p: "/".join(map(str, p))
    region, rack = f"{name}_region", f"{name}_rack"
    shape = topology.regions
    df = df.withColumn(region, winner(key, [at(r) for r in range(len(shape))], [total(x) for x in shape]))
    df = df.withColumn(rack, pick(F.col(region), [winner(key, [at(r, k) for k in range(len(x))], [total(y) for y in x]) for r, x in enumerate(shape)]))
    leaf = [pick(F.col(rack), [winner(key, [at(r, k, s) for s in range(len(y))], list(y)) + first[r][k] for k, y in enumerate(x)]) for r, x in enumerate(shape)]
    return df.withColumn(name, pick(F.col(region), leaf).cast("int")).drop(region, rack)


def place(docs: DataFrame, shards: int = 24, per_bucket: int = PER_BUCKET) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of docs(doc_id, text)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    alike = materialise(rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("n")), "alike")
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    alike_placed = with_shard(with_shard(alike, key, Topology.planned(shards), "shard"), key, Topology.planned(shards + 1), "grown_shard")
    buckets = max(64, -(-alike.count() // (shards * per_bucket)))
    alike_placed = materialise(alike_placed.withColumn("bucket", F.floor(draw(F.concat_ws("|", key, "text_crc32"), "slot") * buckets)), "placed")
    counts = materialise(alike_placed.groupBy("shard", "bucket").agg(F.sum("n").alias("rows")), "buckets")
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("shard", "bucket", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    numbered = alike_placed.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(first, ["shard", "bucket"])
    numbered = numbered.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("first") + F.col("inside")).cast("long").alias("slot"), "grown_shard", "n")
    names = ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    copies = lambda df: df.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).withColumn("slot", F.col("slot") + F.col("k")).select(*names)
    # copies beyond a part are dealt out, a part a row
    many = numbered.where(F.col("n") > PART).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / PART))))
    many = many.withColumn("slot", F.col("slot") + F.col("part") * PART).withColumn("n", F.least(F.lit(PART).cast("long"), F.col("n") - F.col("part") * PART)).repartition("slot")
    return copies(numbered.where(F.col("n") <= PART)).unionByName(copies(many))
