"""A folder of documents as a stream: new files are read as they come.

The reference has no streams; this is what the same plans give on Spark's file source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokenise
from ..operators.blocks import KINDS
from ..sources.base import rows_by_document
from ..sources.markdown import BLOCK_SCHEMA, block_rows

FILES = "path string, modificationTime timestamp, length long, content binary"


def watch(spark: SparkSession, folder: str, per_trigger: int = 1000) -> DataFrame:
    """files(doc_id, path, arrived, text) of Markdown in a folder, as a stream; at most so many files a trigger."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", "*.{md,markdown}").option("maxFilesPerTrigger", per_trigger).load(folder)
    return files.select(F.xxhash64("path").alias("doc_id"), "path", F.col("modificationTime").alias("arrived"), F.decode("content", "UTF-8").alias("text"))


def stream_blocks(files: DataFrame) -> DataFrame:
    """Blocks of streamed documents: a stateless map, so it recovers from its checkpoint alone."""
    return rows_by_document(files.select("doc_id", "text"), block_rows, BLOCK_SCHEMA)


def counts_by_window(files: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Documents and tokens by window of arrival; state older than the watermark goes."""
    return files.withWatermark("arrived", late).groupBy(F.window("arrived", window)).agg(F.count("*").alias("n_docs"), F.sum(F.size(tokenise("text"))).alias("n_tokens"))


def block_totals(blocks: DataFrame) -> DataFrame:
    """Running totals of blocks by kind (a bounded state: one row for each of the kinds)."""
    return blocks.where(F.col("t").isin(*KINDS)).groupBy("t").count()
