import pyarrow as pa
import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from paperloom.llm import common as C


def tasks_of(df):
    """How many tasks a stage of Python over df has that get rows."""

    def run(batches):
        n = sum(b.num_rows for b in batches)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([n])], names=["task", "n"])

    return df.mapInArrow(run, "task long, n long").where("n > 0").count()


def test_small_rows_are_dealt_out_one_a_task(spark):
    rows = spark.range(40).withColumn("name", F.concat(F.lit("archive-"), "id")).coalesce(1)
    assert tasks_of(C.dealt_out(rows, 40, "name")) == 40


def test_reading_has_a_task_for_each_archive_and_block(spark, monkeypatch):
    from paperloom.llm import tokenscan, warc

    seen = []
    real = C.dealt_out

    def spy(rows, n, *key):
        seen.append((n, rows.count(), tasks_of(real(rows, n, *key))))
        return real(rows, n, *key)

    monkeypatch.setattr(warc, "dealt_out", spy)
    monkeypatch.setattr(tokenscan, "dealt_out", spy)
    pages = spark.range(60).repartition(6).select(F.col("id").alias("page_id"), F.concat(F.lit("http://a.b/"), "id").alias("url"), F.concat(F.lit("x"), "id").alias("html"))
    warc.capture_histories(pages).count()
    tokenscan.token_counts(spark.range(60).repartition(3).select(F.col("id").alias("doc_id"), F.lit("some words " * 40).alias("text")), block=500).count()
    assert len(seen) == 2
    for n, rows, tasks in seen:
        assert n == rows > 1 and tasks >= 0.7 * n


@pytest.mark.parametrize("claimed", (10_000, 1_500_000_000, 100_000_000_000))
def test_sample_is_exact_at_any_size(spark, claimed):
    """The size is only claimed: a hash bound that finds too little grows until it finds enough."""
    rows = spark.range(3000).select(F.lit("a").alias("s"), F.concat(F.lit("text "), "id").alias("text"))
    one, two = ({r.text for r in C.bounded_sample(rows, "s", {"a": n}, 50, "x").collect()} for n in (claimed, 3000))
    assert len(one) == 50 and one == two


def test_sample_of_repeated_rows_and_null_ids(spark):
    same = spark.range(5000).select(F.lit("a").alias("s"), F.lit("one text").alias("text"))
    assert [r.text for r in C.bounded_sample(same, "s", {"a": 5000}, 10, "x").collect()] == ["one text"]
    other = spark.range(500).select(F.lit("b").alias("s"), F.concat(F.lit("t"), "id").alias("text"))
    got = C.bounded_sample(same.unionByName(other), "s", {"a": 5000, "b": 500}, 10, "x").groupBy("s").count().collect()
    assert sorted(tuple(r) for r in got) == [("a", 1), ("b", 10)]
    null = spark.range(500).select(F.lit("b").alias("s"), F.lit(None).cast("string").alias("text"))
    assert C.bounded_sample(null, "s", {"b": 500}, 10, "x").count() == 1
    assert C.bounded_sample(same.where("false"), "s", {}, 10, "x").count() == 0


def test_batches_are_cut_and_settings_come_back(spark):
    b = pa.RecordBatch.from_arrays([pa.array(["x" * 1000] * 5000)], names=["t"])
    parts = list(C.slices(b))
    assert sum(p.num_rows for p in parts) == 5000 and max(p.num_rows for p in parts) <= C.BATCH_ROWS
    big = pa.RecordBatch.from_arrays([pa.array(["x" * 3_000_000] * 3)], names=["t"])
    assert [p.num_rows for p in C.slices(big)] == [1, 1, 1]
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    with C.small_batches(spark):
        assert int(spark.conf.get(name)) == C.BATCH_ROWS
    assert spark.conf.get(name) == before
