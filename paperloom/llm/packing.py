"""Packing by non-negative least squares (operator 7).

A document's tokens (ids and one end id) are cut into full windows and a rest. The rests'
histogram over lengths, at most ``window`` numbers whatever the corpus, goes to the driver.
There, combinations of up to three lengths that fill a window exactly are enumerated,
their repeat counts are solved against the histogram by non-negative least squares,
rounded down to what is there, and what is left is packed greedily (largest first, then
the largest that fits). A pattern repeated n times takes n consecutive ranks of each of
its lengths, so a piece finds its place from its length and its rank among the pieces of
that length alone. Ranks come from counts by task and length and a prefix sum, of which a
file for each task is written to the shared folder; a reader fetches those of the few tasks
whose pieces it meets, so nothing that grows with the number of tasks is sent to all.

Cases: null and empty text is the end id alone; rows that share a doc_id, or repeat, are
packed each on its own; a null doc_id is kept; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, shared_dir, tidily
from .tokens import encode, qualified, store, vocabulary_path

WINDOW, END_ID = 1024, 0
FREQUENT = 48  # lengths of which triples are formed
SWEEPS = 100
KNOWN = 256  # tasks whose ranks a reader holds


def combinations(hist: np.ndarray, window: int) -> list[tuple[int, ...]]:
    """Combinations of one to three lengths in use that fill the window: all pairs, and
    triples of which two are among the most frequent lengths."""
    out = [(window,)] if hist[window] else []
    out += [(a, window - a) for a in range((window + 1) // 2, window) if hist[a] and hist[window - a]]
    top = sorted(np.argsort(-hist[1:window], kind="stable")[:FREQUENT] + 1)
    top = [int(x) for x in top if hist[x]]
    triples = {tuple(sorted((a, b, window - a - b), reverse=True)) for k, a in enumerate(top) for b in top[k:] if window - a - b > 0 and hist[window - a - b]}
    return out + sorted(triples)


def nnls(patterns: list[tuple[int, ...]], hist: np.ndarray, sweeps: int = SWEEPS) -> np.ndarray:
    """Repeat counts x >= 0 that minimise the squared error of the lengths used, by cyclic coordinate descent."""
    x = np.zeros(len(patterns))
    rest = hist.astype(float)
    uses = [[(length, p.count(length)) for length in set(p)] for p in patterns]
    norm = [float(sum(m * m for _, m in u)) for u in uses]
    for _ in range(sweeps):
        most = 0.0
        for k, u in enumerate(uses):
            step = sum(m * rest[length] for length, m in u) / norm[k]
            step = max(step, -x[k])
            if step:
                x[k] += step
                for length, m in u:
                    rest[length] -= m * step
                most = max(most, abs(step))
        if most < 0.01:
            break
    return x


def plan(hist: np.ndarray, window: int = WINDOW) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, times) that use every piece of the histogram once."""
    left = hist.astype(np.int64).copy()
    patterns = combinations(left, window)
    x = nnls(patterns, left)
    out = []
    for k in sorted(range(len(patterns)), key=lambda k: (-x[k], patterns[k])):
        p = patterns[k]
        n = min(int(x[k] + 1e-9), *(int(left[v]) // p.count(v) for v in p))
        if n > 0:
            out.append((p, n))
            for v in p:
                left[v] -= n
    while left.any():
        free = left.copy()
        p, gap = [], window
        while gap and (fits := np.flatnonzero(free[: gap + 1])).size:
            v = int(fits[-1])
            p.append(v)
            free[v] -= 1
            gap -= v
        n = min(int(left[v]) // p.count(v) for v in set(p))
        out.append((tuple(p), n))
        for v in p:
            left[v] -= n
    return out


def places(patterns: Iterable[tuple[tuple[int, ...], int]], window: int) -> dict[str, np.ndarray]:
    """For each use of a length in a pattern: the first rank, the first sequence and the offset, ordered by length and rank."""
    taken, rows, sequence = np.zeros(window + 1, np.int64), [], 0
    for p, n in patterns:
        at = 0
        for v in p:
            rows.append((v, int(taken[v]), sequence, at))
            taken[v] += n
            at += v
        sequence += n
    rows.sort()
    names = ("length", "rank", "sequence", "offset")
    return {name: np.array([r[k] for r in rows], np.int64) for k, name in enumerate(names)}


def pieces(docs: DataFrame, path: str, window: int) -> DataFrame:
    """A row for each piece with its task and its rank among the task's pieces of that length."""
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "task", "rank"]

    def run(batches):
        seen, task = np.zeros(window + 1, np.int64), TaskContext.get().partitionId()
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = np.append(encode(path, text), np.uint32(END_ID)).astype("<u4")
                for at in range(0, len(ids), window):
                    part = ids[at : at + window]
                    rows.append((doc_id, at, len(part), zlib.crc32(part.tobytes()), len(ids), task, int(seen[len(part)])))
                    seen[len(part)] += 1
            cols = list(zip(*rows, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidily(run), ", ".join(f"{n} long" for n in names))


def write_ranks(counts: DataFrame, window: int) -> str:
    """A folder with a file for each task of counts(length, task, count): by length, how many
    pieces earlier tasks have. A file is the same whoever writes it, and appears whole or not at all."""
    spark = counts.sparkSession
    folder = qualified(spark, shared_dir(spark))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("length", "task", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))

    def run(batches):
        files, at = store(folder)
        files.create_dir(at, recursive=True)
        for b in batches:
            for task, rows in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ranks = np.zeros(window + 1, "<i8")
                for r in rows:
                    ranks[r["length"]] = r["first"]
                own = f"{at}/{task}-{TaskContext.get().taskAttemptId()}.part"
                with files.open_output_stream(own) as out:
                    out.write(ranks.tobytes())
                files.move(own, f"{at}/{task}.ranks")
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64())], names=["done"])

    by_task = first.groupBy("task").agg(F.collect_list(F.struct("length", "first")).alias("rows"))
    by_task.mapInArrow(tidily(run), "done long").count()
    return folder


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset for every piece of docs(doc_id, text)."""
    cut = materialise(pieces(docs, path or vocabulary_path(), window), "pieces")
    counts = materialise(cut.groupBy("length", "task").count(), "counts")
    hist = np.zeros(window + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect():  # at most `window` rows
        hist[r["length"]] = r["n"]
    table = places(plan(hist, window), window)
    key = table["length"] * (1 << 44) + table["rank"]
    folder = write_ranks(counts, window)

    def run(batches):
        files, at = store(folder)
        known: dict[int, np.ndarray] = {}

        def ranks(task: int) -> np.ndarray:
            if task not in known:
                if len(known) >= KNOWN:
                    known.clear()
                with files.open_input_stream(f"{at}/{task}.ranks") as f:
                    known[task] = np.frombuffer(f.read(), "<i8")
            return known[task]

        for b in batches:
            length, task, rank = (b.column(k).to_numpy(zero_copy_only=False) for k in (2, 5, 6))
            rank = rank.copy()
            for t in np.unique(task):
                mine = task == t
                rank[mine] += ranks(int(t))[length[mine]]
            spot = np.searchsorted(key, length * (1 << 44) + rank, "right") - 1
            sequence = table["sequence"][spot] + rank - table["rank"][spot]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(table["offset"][spot])], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return cut.mapInArrow(tidily(run), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
