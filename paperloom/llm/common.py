"""Shared folder, materialised tables and input clean-up used by every operator here."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import shutil
import tempfile
import time
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BATCH_ROWS = 512
BATCH_BYTES = 2**20  # a batch's numpy arrays take some fifty times its bytes
MOST_TASKS = 20_000  # of a stage that takes an archive, a file's block or the like a task
MOST_STRATA = 100_000
SPARE = 4  # a sample is drawn from about so many times its rows


def shared_dir(spark: SparkSession) -> str:
    """A new, unique folder name under the cluster's shared checkpoint folder.

    The folder is the session's ``spark.checkpoint.dir``; only where that is unset and the
    whole session is one machine (tests) a temporary folder takes its place.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="paperloom-")
        spark.conf.set("spark.checkpoint.dir", root)
        atexit.register(shutil.rmtree, root.removeprefix("file://"), True)
    return f"{root.rstrip('/')}/paperloom-{uuid.uuid4().hex}"


def lasting_batches(spark: SparkSession) -> None:
    """Arrow batches that suit whole texts, for plans over texts that run after an operator has returned. The
    session keeps these two limits, if its own were larger: at the default of 64 MB a batch, the buffers of a
    batch on both sides cost an executor several hundred MB."""
    for k, most in {"spark.sql.execution.arrow.maxRecordsPerBatch": BATCH_ROWS, "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES}.items():
        if not 0 < int(spark.conf.get(k).rstrip("b")) <= most:
            spark.conf.set(k, str(most))


@contextlib.contextmanager
def small_batches(spark: SparkSession):
    """The same for the actions inside; the caller's settings come back."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")}
    lasting_batches(spark)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def materialise(df: DataFrame, name: str = "t", folder: str | None = None) -> DataFrame:
    """Write a table to the shared folder (or a folder in it) and read it back: lineage ends there,
    and the loss of an executor costs nothing that was already written."""
    path = f"{folder or shared_dir(df.sparkSession)}/{name}"
    with small_batches(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_sample(rows: DataFrame, stratum: str, sizes: dict[str, int], wanted: int, salt: str) -> DataFrame:
    """``wanted`` distinct rows of each stratum (all, where there are no more), the same in every run.

    Rows are ordered by a hash of all their columns. ``sizes`` says about how many rows the
    strata in question have, and so below which hash some ``SPARE`` times the rows wanted
    lie, whatever the size; only these move. Where repeated rows leave fewer than wanted, the
    bound of that stratum grows until there are enough or all were looked at. The bounds are a
    table of a row a stratum, which is broadcast up to ``MOST_STRATA`` rows (some 5 MB) and joined beyond.
    """
    names = rows.columns
    if not sizes:
        return rows.where("false")
    hashed = rows.withColumn("_hash", F.xxhash64(*[F.col(f"`{c}`") for c in names], F.lit(salt)))
    share = {s: SPARE * wanted / max(n, 1) for s, n in sizes.items()}
    while True:
        upto = rows.sparkSession.createDataFrame([(s, -(2**63) + min(int(part * 2**64), 2**64 - 1)) for s, part in sorted(share.items())], "_stratum string, _upto long")
        upto = F.broadcast(upto) if len(share) <= MOST_STRATA else upto
        near = hashed.join(upto, (F.col(stratum) == F.col("_stratum")) & (F.col("_hash") <= F.col("_upto"))).select(*names, "_hash")
        near = materialise(near.dropDuplicates([stratum, "_hash"]), "sample")
        got = {r[0]: r[1] for r in near.groupBy(stratum).count().collect()}
        short = [s for s in share if got.get(s, 0) < wanted and share[s] < 1]
        if not short:
            break
        share |= {s: 8 * share[s] for s in short}
    place = F.row_number().over(Window.partitionBy(stratum).orderBy("_hash"))
    return near.withColumn("_place", place).where(F.col("_place") <= wanted).select(*names)


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of tables that nothing reads any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def discard(spark: SparkSession, folder: str) -> None:
    """Delete a folder of tables that nothing reads any more, and let Spark drop the shuffles behind them."""
    jvm = spark.sparkContext._jvm
    remove(spark, folder)
    for _ in range(2):  # Python's references to plans are let go of first, in the background
        gc.collect()
        time.sleep(0.3)
        jvm.System.gc()


def release() -> None:
    """Give back what a finished task's arrays took: workers outlive their tasks, and their
    memory counts beside that of the JVM's next stages."""
    from .vecwords import POWERS

    POWERS.clear()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def slices(batch: pa.RecordBatch):
    """A batch in parts of at most BATCH_ROWS rows and about BATCH_BYTES bytes (a row is never cut)."""
    if batch.num_rows <= BATCH_ROWS and batch.nbytes <= BATCH_BYTES:
        yield batch
    elif batch.num_rows <= 1:
        yield batch
    else:
        half = batch.num_rows // 2
        yield from slices(batch.slice(0, half))
        yield from slices(batch.slice(half))


def tidily(run):
    """A function over Arrow batches that gets them in small parts, whatever the session's
    batches are, and gives its memory back at its end."""

    def tidy_run(batches):
        try:
            yield from run(part for b in batches for part in slices(b))
        finally:
            release()

    return tidy_run


def map_rows(docs: DataFrame, run, schema) -> DataFrame:
    """`mapInArrow` for a table whose columns may have any name: the rows travel as one struct column."""

    def unpacked(batches):
        yield from tidily(run)(pa.RecordBatch.from_arrays(b.column(0).flatten(), names=[f.name for f in b.column(0).type]) for b in batches)

    return docs.select(F.struct(*[quoted(c) for c in docs.columns]).alias("row")).mapInArrow(unpacked, schema)


def dealt_out(rows: DataFrame, n: int, *key: str) -> DataFrame:
    """n small rows that stand for independent work (archives, blocks), a task each up to MOST_TASKS.

    The number is given, for adaptive execution merges partitions that are small in bytes; and
    ranges of the rows' key are of even size, where hashing would leave some tasks without a row.
    """
    return rows.repartitionByRange(max(1, min(n, MOST_TASKS)), *key)


def fold_ascii(col):
    """Lower-case A-Z and nothing else."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(col, upper, upper.lower())


def quoted(name: str) -> Column:
    """The column of that very name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(taken: list[str], *wanted: str) -> dict[str, str]:
    """A name for each one wanted that no other column has (Spark compares names without case): itself or with ``_`` behind."""
    have, out = {c.lower() for c in taken}, {}
    for w in wanted:
        name = w
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out[w] = name
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
