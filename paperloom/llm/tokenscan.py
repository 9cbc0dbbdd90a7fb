"""Token counts of flat, unindexed token files by a separator scan (operator 10).

A token file is a plain run of little-endian 16-bit ids in which an end-of-document id
closes each document; nothing says where documents begin. Files are read in blocks, each
a task's unit; in a block all separators are found at once by a vectorised comparison.
What a block doesn't know, how many documents ended before it and where the open one
began, comes from a prefix scan over the blocks' summaries (count and last separator).

Cases: a document may span any number of blocks or be empty (its separator alone); tokens
after the last separator are a document that isn't closed; an empty file has none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import dealt_out, materialise, shared_dir, tidily
from .tokens import encode, largest_id, qualified, store, vocabulary_path

BLOCK = 1 << 22  # tokens
SEPARATOR = 65_535  # outside the vocabulary, which must be smaller


def write_files(docs: DataFrame, path: str | None = None, separator: int = SEPARATOR) -> tuple[str, DataFrame]:
    """Tokenise docs(doc_id, text) into a flat file for each task, in the shared folder.

    The folder, and rows (file, ordinal, doc_id, tokens_after) that say what was written
    where. A file counts only if the rows of its task were; files of lost or repeated
    attempts have other names and are never read.
    """
    spark = docs.sparkSession
    folder, path = qualified(spark, shared_dir(spark)), path or vocabulary_path()

    def run(batches):
        context = TaskContext.get()
        name = f"tokens-{context.partitionId():06d}-{context.taskAttemptId()}.bin"
        files, at = store(folder)
        files.create_dir(at, recursive=True)
        ordinal = total = 0
        if largest_id(path) >= separator:
            raise ValueError(f"the separator {separator} is an id of the vocabulary")
        with files.open_output_stream(f"{at}/{name}") as out:
            for b in batches:
                ends = []
                for text in b.column(1).to_pylist():
                    ids = np.append(encode(path, text), np.uint32(separator))
                    out.write(ids.astype("<u2").tobytes())
                    total += len(ids)
                    ends.append(total)
                n = b.num_rows
                yield pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), pa.array(np.arange(ordinal, ordinal + n)), b.column(0), pa.array(ends, pa.int64())], names=["file", "doc_no", "doc_id", "tokens_after"])
                ordinal += n

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidily(run), "file string, doc_no long, doc_id long, tokens_after long")
    return folder, materialise(rows, "manifest")


def scan(files: DataFrame, folder: str, separator: int = SEPARATOR, block: int = BLOCK) -> DataFrame:
    """file, doc_no, token_start, n_tokens, closed for every document of files(file, n_tokens) in a folder."""
    last = F.floor((F.col("n_tokens") - 1) / block).cast("long")
    filled = files.where("n_tokens > 0")
    n_blocks = filled.agg(F.coalesce(F.sum(last + 1), F.lit(0))).first()[0]
    blocks = dealt_out(filled.select("file", "n_tokens", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block")), n_blocks, "file", "block")

    def run(batches):
        store_, at = store(folder)
        for b in batches:
            for file, size, k in zip(*(b.column(j).to_pylist() for j in range(3)), strict=True):
                with store_.open_input_file(f"{at}/{file}") as f:
                    ids = np.frombuffer(f.read_at(2 * min(block, size - k * block), 2 * k * block), "<u2")
                ends = np.flatnonzero(ids == separator) + k * block
                n = len(ends)
                before = np.concatenate((np.full(min(n, 1), -1, np.int64), ends[:-1]))
                yield pa.RecordBatch.from_arrays([pa.array([file] * n, pa.string()), pa.array(np.full(n, k)), pa.array(np.arange(n)), pa.array(ends), pa.array(before)], names=["file", "block", "at", "end", "before"])

    found = materialise(blocks.mapInArrow(tidily(run), "file string, block long, at long, end long, before long"), "separators")
    summary = found.groupBy("file", "block").agg(F.count("*").alias("n"), F.max("end").alias("last"))
    past = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carry = summary.select("file", "block", F.coalesce(F.sum("n").over(past), F.lit(0)).alias("docs_before"), F.coalesce(F.max("last").over(past), F.lit(-1)).alias("end_before"))
    start = F.when(F.col("at") == 0, F.col("end_before")).otherwise(F.col("before")) + 1
    closed = found.join(carry, ["file", "block"]).select("file", (F.col("docs_before") + F.col("at")).alias("doc_no"), start.alias("token_start"), (F.col("end") - start).alias("n_tokens"), F.lit(True).alias("closed"))
    tails = files.select("file", F.col("n_tokens").alias("size")).join(summary.groupBy("file").agg(F.sum("n").alias("n"), F.max("last").alias("last")), "file", "left")
    begin = F.coalesce(F.col("last"), F.lit(-1)) + 1
    open_ = tails.where(F.col("size") > begin).select("file", F.coalesce("n", F.lit(0)).alias("doc_no"), begin.alias("token_start"), (F.col("size") - begin).alias("n_tokens"), F.lit(False).alias("closed"))
    return closed.unionByName(open_)


def token_counts(docs: DataFrame, path: str | None = None, block: int = BLOCK) -> DataFrame:
    """doc_id, file_no, doc_no, token_start, n_tokens (without the separator), closed for every
    row of docs(doc_id, text), as the scan of its token files finds them.

    A null or empty text has 0 tokens; repeated rows and null doc_ids have a row each; an
    empty table gives an empty result.
    """
    folder, manifest = write_files(docs, path)
    files = manifest.groupBy("file").agg(F.max("tokens_after").alias("n_tokens"))
    got = scan(files, folder, block=block)
    number = F.regexp_extract("file", r"^tokens-(\d+)-", 1).cast("int")
    return got.join(manifest.select("file", "doc_no", "doc_id"), ["file", "doc_no"]).select("doc_id", number.alias("file_no"), "doc_no", "token_start", "n_tokens", "closed")
