import zlib
from collections import Counter, defaultdict

from paperloom.llm import sharding as S


def rows(n):
    return [(i, f"text {i % 50} ü") for i in range(n)] + [(5, "text 5 ü"), (None, None), (None, "x")]


def test_sizes_checksums_slots_and_growth(docs):
    data = rows(3000)
    got = S.place(docs(data), 24).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in data)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 24) and r.law == "key"
    assert set(slots) <= set(range(24))
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    moved = sum(r.grown_shard == 24 for r in got)
    assert 0.5 / 25 < moved / len(got) < 1.6 / 25
    assert max(map(len, slots.values())) < 2 * len(got) / 24
    by_id = defaultdict(set)
    for r in got:
        by_id[r.doc_id].add(r.shard)
    assert all(len(v) == 1 for v in by_id.values())


def test_very_many_equal_rows(spark):
    """Equal rows are shuffled as one row with their number, and numbered without a gap beside the others."""
    from pyspark.sql import functions as F

    same = spark.range(150_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"))
    other = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    got = S.place(same.unionByName(other), 4)
    assert got.count() == 155_000
    gaps = got.groupBy("shard").agg(F.count("*").alias("n"), F.count_distinct("slot").alias("slots"), F.max("slot").alias("last")).collect()
    assert len(gaps) == 4 and all(r.n == r.slots == r.last + 1 for r in gaps)
    null = got.where("doc_id is null").agg(F.count("*"), F.count_distinct("shard"), F.max("slot") - F.min("slot")).first()
    assert tuple(null) == (150_000, 1, 149_999)


def test_weights_and_confined_movement(spark):
    from pyspark.sql import functions as F

    df = spark.range(4000).select(F.col("id").cast("string").alias("key"))
    before = S.Topology((((1.0, 1.0), (2.0, 1.0)), ((3.0,),)))
    after = S.Topology((((1.0, 1.0), (1.0, 2.0)), ((3.0,),)))  # two shards of one rack exchange weights
    both = S.with_shard(S.with_shard(df, F.col("key"), before, "a"), F.col("key"), after, "b").groupBy("a", "b").count().collect()
    assert all(r.a == r.b or (r.a in (2, 3) and r.b in (2, 3)) for r in both)
    share = Counter()
    for r in both:
        share[r.a] += r["count"] / 4000
    assert all(abs(share[k] - w / 8) < 0.03 for k, w in enumerate((1, 1, 2, 1, 3)))


def test_every_shard_added_takes_rows_only_into_itself(spark):
    from pyspark.sql import functions as F

    df = spark.range(1000).select(F.col("id").cast("string").alias("key"))
    for n in (24, 25, 30):
        x = S.with_shard(S.with_shard(df, F.col("key"), S.Topology.planned(n), "a"), F.col("key"), S.Topology.planned(n + 1), "b")
        assert x.where(f"a <> b and b <> {n}").count() == 0


def test_empty(docs):
    assert S.place(docs([])).count() == 0
