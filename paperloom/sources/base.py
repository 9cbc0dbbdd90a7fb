"""What readers share: rows made by Python code from one document at a time, as Arrow batches."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


ROWS, BYTES = 2000, 1 << 22  # of made rows that are held before they go on
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 512, "spark.sql.execution.arrow.maxBytesPerBatch": 1 << 20}
SHARES = 4  # parts of the documents for each core
ITEM = 64  # bytes that a made value takes besides its text
BROADCAST = 10 << 20  # bytes of rows; a kept table with more is never broadcast


def weight(v) -> int:
    """About how many bytes a made value takes, nested ones with all that they hold."""
    if type(v) in (bytes, str):
        return ITEM + len(v)
    if type(v) is dict:
        return ITEM + sum(map(weight, v.values()))
    return ITEM + sum(map(weight, v)) if type(v) in (list, tuple) else ITEM


def dealt_out(df: DataFrame) -> DataFrame:
    """df's rows dealt out by their first column, some parts a core, however few files or small exchanges they come from:
    Spark splits by bytes, and what a document costs to read or make is far more than its bytes say."""
    return df.repartition(SHARES * df.sparkSession.sparkContext.defaultParallelism, df.columns[0])


def rows_by_document(df: DataFrame, make: Callable[..., Iterable[dict]], schema: str, deal: bool = True) -> DataFrame:
    """make(*values of a row) gives the rows of a document, best as a generator; the documents are dealt out over all cores
    (not again with ``deal`` false: the tasks that made them go on with them).

    One document of a batch at a time becomes Python values, and its rows go on in small batches while it is
    read, so what a task holds depends neither on how many rows a document gives nor on how many documents a batch has.
    The session keeps Arrow batches of `BATCH` at most, if its own were larger, as the plan runs after this has returned.
    """
    kind = T._parse_datatype_string(schema)
    arrow = to_arrow_schema(kind)
    conf = df.sparkSession.conf
    for k, most in BATCH.items():
        if not 0 < int(conf.get(k).rstrip("b")) <= most:
            conf.set(k, str(most))

    def run(batches):
        rows, size = [], 0
        for b in batches:
            for j in range(b.num_rows):
                for r in make(*(c[j].as_py() for c in b.columns)):
                    rows.append(r)
                    size += weight(r)
                    if len(rows) >= ROWS or size >= BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)
        pa.default_memory_pool().release_unused()

    return (dealt_out(df) if deal else df).mapInArrow(run, kind)


KEPT: list[str] = []  # folders that `kept` has written and nobody has removed


def forget(spark: SparkSession) -> None:
    """Delete every table that `kept` wrote so far; plans over them can't be run any more."""
    while KEPT:
        path = spark._jvm.org.apache.hadoop.fs.Path(KEPT.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def held(value: Column, kind: T.DataType) -> Column:
    """The bytes that a value takes in a row in memory, nested ones with all that they hold."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)).cast("long") + 8
    if isinstance(kind, T.StructType):
        return sum((held(value[f.name], f.dataType) for f in kind.fields), F.lit(16).cast("long"))
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.aggregate(value, F.lit(0).cast("long"), lambda n, x: n + held(x, kind.elementType)), F.lit(0)) + 16
    if isinstance(kind, T.MapType):
        return held(F.map_keys(value), T.ArrayType(kind.keyType)) + held(F.map_values(value), T.ArrayType(kind.valueType))
    return F.lit(8).cast("long")


def is_large(table: DataFrame, path: str) -> bool:
    """Whether the rows of a written table take more than `BROADCAST`. The files alone don't say: what repeats takes a few
    bits a row there, so a table of a hundred times that size looks small enough to be collected by the driver."""
    spark = table.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength() > BROADCAST:
        return True
    size = sum((held(F.col(f"`{f.name}`"), f.dataType) for f in table.schema.fields), F.lit(16).cast("long"))
    return (table.agg(F.sum(size)).head()[0] or 0) > BROADCAST


def kept(df: DataFrame) -> DataFrame:
    """df, written to the folder that ``spark.checkpoint.dir`` names and read again, for what is used
    several times: a lost executor then costs no finished work. Only a session on one machine may do without the setting.
    A large one, and what is left of it by filters or aggregates, is not broadcast in joins. The tables stay until `forget` is called."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="paperloom-")
        spark.conf.set("spark.checkpoint.dir", root)
        atexit.register(shutil.rmtree, root.removeprefix("file://"), True)
    path = f"{root.rstrip('/')}/paperloom-{uuid.uuid4().hex}"
    KEPT.append(path)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    return table.hint("merge") if is_large(table, path) else table
