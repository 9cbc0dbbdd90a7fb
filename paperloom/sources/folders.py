"""Folders below a folder, found by tasks level by level; what can't be read is a row.

Spark's file sources list a tree on the driver and fail as a whole where one folder can't be read.
Here each folder of a level is listed by a task, and the level below it is the next job's input;
only the names of folders that can be read reach the driver, for the file source to load.
"""

from __future__ import annotations

import os

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import kept

FOUND = "folder string, sub string, reason string"
MOST_TASKS = 2000


def look(folder: str) -> tuple[list[str], str | None]:
    """(the folders in a folder, links to folders included; why it can't be read)."""
    if not folder.startswith("file:"):
        from pyarrow import fs

        try:
            files, at = fs.FileSystem.from_uri(folder)
            head = folder[: len(folder) - len(at)] if folder.endswith(at) else ""
            return sorted(head + x.path for x in files.get_file_info(fs.FileSelector(at)) if x.type == fs.FileType.Directory), None
        except (OSError, pa.ArrowException) as e:
            return [], str(e)
    path = "/" + folder.removeprefix("file:").lstrip("/")
    try:
        with os.scandir(path) as entries:
            subs = [e.path for e in entries if e.is_dir()]
    except OSError as e:
        return [], e.strerror or str(e)
    return sorted("file:" + s for s in subs), None


def above(folder: str) -> str | None:
    """Why a folder isn't entered: it is a link to one that it lies in, so that its tree would have no end."""
    path = "/" + folder.removeprefix("file:").lstrip("/")
    real = os.path.realpath(path)
    if os.path.islink(path) and (os.path.realpath(os.path.dirname(path)) + "/").startswith(real.rstrip("/") + "/"):
        return "a link to a folder above it"
    return None


def qualified(spark: SparkSession, folder: str) -> str:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def folders(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """(folder, reason) of a folder and, if recursive, those below it, by name; reason is null where a folder can be read.

    Files that aren't reached by a folder's own path (links) are Spark's file source's matter; links to folders
    are followed, but not to one above. A missing folder is a row with its reason.
    """

    def run(batches):
        for b in batches:
            rows = []
            for f in b.column(0).to_pylist():
                why = above(f) if f.startswith("file:") else None
                subs, reason = ([], why) if why else look(f)
                rows.append((f, None, reason))
                rows += [(f, s, None) for s in subs] if recursive else []
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(3)], names=["folder", "sub", "reason"])

    level, out = spark.createDataFrame([(qualified(spark, folder),)], "folder string"), None
    while True:
        seen = kept(level.mapInArrow(run, FOUND))
        here = seen.where("sub is null").select("folder", "reason")
        out = here if out is None else out.unionByName(here)
        n = seen.where("sub is not null").count()
        if not n:
            return out.orderBy("folder")
        level = seen.where("sub is not null").select(F.col("sub").alias("folder")).repartition(min(n, MOST_TASKS), "folder")


def readable_files(spark: SparkSession, folder: str, recursive: bool, pattern: str) -> DataFrame:
    """The file source's rows (path, modificationTime, length, content) of files that match a pattern, in all folders that can be read.
    Where Python knows no such file system Spark lists the tree itself. An unreadable or missing root raises."""
    source = spark.read.format("binaryFile").option("pathGlobFilter", pattern)
    if not recursive:
        return source.load(folder)
    if not known(qualified(spark, folder)):
        return source.option("recursiveFileLookup", "true").load(folder)
    good = [r["folder"] for r in folders(spark, folder, True).where("reason is null").collect()]
    return source.load(good) if good else source.load(folder)


def known(uri: str) -> bool:
    """Whether tasks can list a folder of this file system."""
    return uri.split(":", 1)[0] in ("file", "hdfs", "s3", "gs", "abfs", "abfss")


def any_case(endings) -> str:
    """A file pattern for endings in upper or lower case or both."""
    return "*.{" + ",".join("".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in x.lstrip(".")) for x in endings) + "}"
