"""Quality classifier on supervised subword embeddings (operator 13).

A text is a bag of features: its words (runs of bytes that aren't blank, case kept), pairs of
neighbouring words (two equal words are one feature, whatever the word), and runs of 3 to 5
bytes of a word with the blank before and after it, all hashed to ``FEATURES`` numbers. Each
number has a learned vector of ``DIM`` components; a document is the mean of its features'
vectors, and a softmax over the two labels follows. Vectors and softmax are learned together
by stochastic gradient descent in numpy, a document a step, with a rate that falls to zero.

It is fitted on a bounded sample, ``SAMPLE`` different labelled texts of each label, the
least by a hash of the document's id; the loss weighs a label as its share of all labelled
documents asks, so the score is a probability under the corpus's own shares. As the softmax
is linear in the mean, tasks get one number a feature (the vector's part in the log-odds).

Cases: null and empty texts have no features and score what the softmax says of a zero
vector; without a labelled document of each label every score is the share of label 1 (0.5 if
nothing is labelled); a null doc_id has no label and counts as the text 'null' for the fold;
several labels of one document count once, as poor if any says so; repeated rows score alike;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, lasting_batches, materialise, tidily
from .vecwords import SPACE, U, Words, buffer, grams, mix

BITS, DIM, SAMPLE, EPOCHS, RATE = 15, 16, 2000, 8, 20.0
FEATURES = 1 << BITS
BYTE_GRAMS = (3, 4, 5)
THRESHOLD = 0.3
SLICE, TEXTS = 1 << 18, 16  # bytes whose runs are hashed at a time; texts whose features are counted at a time


@dataclass(frozen=True)
class Model:
    """Log-odds of label 1: ``bias`` plus the mean of ``odds`` over a text's features."""

    odds: np.ndarray
    bias: float


def held_out():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).cast("binary")) % 5 == 0


def features(column):
    """(text's index, feature) of a batch, in parts."""
    raw, offsets = buffer(column)
    w = Words(raw, offsets, SPACE)
    if not len(w.start):
        return
    shift = U(64 - BITS)
    yield w.owner(), (mix(w.hash) >> shift).astype(np.int64)
    pairs, at, first = grams(w.hash, w.first, 2)
    pairs = np.where(w.hash[at] == w.hash[at + 1], U(0), pairs)
    yield np.repeat(np.arange(len(first) - 1), np.diff(first)), (mix(pairs) >> shift).astype(np.int64)
    text = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    for a in range(0, len(raw), SLICE):
        b = raw[a : a + SLICE + max(BYTE_GRAMS) - 1]
        word, owner = w.word[a : a + len(b)], text[a : a + len(b)]
        code = np.where(word, b, 0x20).astype(U)
        for n in BYTE_GRAMS:
            m = min(SLICE, len(b) - n + 1)
            if m <= 0:
                continue
            inside = owner[:m] == owner[n - 1 : n - 1 + m]
            for k in range(1, n - 1):  # blanks only at the ends
                inside &= word[k : k + m]
            at = np.flatnonzero(inside)
            x = np.full(len(at), n, U)
            for k in range(n):
                x = (x << U(8)) | code[at + k]
            yield owner[at].astype(np.int64), ((x * U(0x9E3779B97F4A7C15)) >> shift).astype(np.int64)


def bags(column) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each text's different features and their shares of all its features."""
    out = []
    for k in range(0, len(column), TEXTS):
        some = column.slice(k, TEXTS)
        total = np.zeros(len(some) * FEATURES, np.int64)
        for owner, f in features(some):
            total += np.bincount(owner * FEATURES + f, minlength=len(total))
        for row in total.reshape(-1, FEATURES):
            at = np.flatnonzero(row)
            out.append((at.astype(np.uint16), (row[at] / max(1, row.sum())).astype(np.float32)))
    return out


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], weight: tuple[float, float], epochs: int = EPOCHS, rate: float = RATE, seed: int = 13) -> Model:
    """rows: label, features, shares. The order of a pass is drawn from the seed."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (FEATURES, DIM)).astype(np.float32)
    out = np.zeros((DIM, 2), np.float32)
    bias = np.log(np.maximum(weight * np.bincount([x for x, *_ in rows], minlength=2), 1e-6) / len(rows)).astype(np.float32)
    steps, done = epochs * len(rows), 0
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            label, at, share = rows[k]
            now = np.float32(rate * (1 - done / steps))
            done += 1
            v = vectors[at]
            mean = share @ v
            z = mean @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1
            g = np.float32(weight[label]) * p
            back = out @ g
            out -= np.float32(0.01) * now * np.outer(mean, g)
            bias -= np.float32(0.001) * now * g
            # a feature's step goes by its share, and the mean of many features moves little by each
            vectors[at] = v - now * share[:, None] * back
    w = (out[:, 1] - out[:, 0]).astype(np.float64)
    return Model((vectors @ w).astype(np.float64), float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from docs(doc_id, text) and labels(doc_id, quality) outside the held-out fold."""
    flat = Model(np.zeros(FEATURES), 0.0)
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality")).where(~held_out())
    ids = docs.select("doc_id").where(~held_out()).join(known, "doc_id", "left_semi").distinct()
    ids = materialise(ids.join(known, "doc_id").select(F.when(F.col("quality") > 0, "1").otherwise("0").alias("label"), "doc_id"), "labelled")
    sizes = {r[0]: r[1] for r in ids.groupBy("label").count().collect()}
    if len(sizes) < 2:
        return Model(flat.odds, {"0": -np.inf, "1": np.inf}[next(iter(sizes))] if sizes else 0.0)
    chosen = F.broadcast(bounded_sample(ids, "label", sizes, sample, "quality"))  # 2 * sample ids at most
    texts = materialise(docs.select("doc_id", F.col("text").cast("string").alias("text")).join(chosen, "doc_id").select("label", "text").where("text is not null"), "texts")
    have = {r[0]: r[1] for r in texts.groupBy("label").count().collect()}
    if len(have) < 2:
        return Model(flat.odds, float(np.log(sizes["1"] / sizes["0"])))
    # an id may stand for any number of rows
    texts = bounded_sample(texts, "label", have, sample, "texts").repartition(16)

    def emit(batches):
        for b in batches:
            got = bags(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([f.tobytes() for f, _ in got], pa.binary()), pa.array([s.tobytes() for _, s in got], pa.binary())], names=["label", "features", "shares"])

    rows = sorted((r["label"], bytes(r["features"]), bytes(r["shares"])) for r in texts.mapInArrow(tidily(emit), "label string, features binary, shares binary").collect())
    rows = [(int(x), np.frombuffer(f, np.uint16), np.frombuffer(s, np.float32)) for x, f, s in rows]
    used = np.bincount([x for x, *_ in rows], minlength=2)
    total = sizes["0"] + sizes["1"]
    return train(rows, tuple(float(sizes[str(k)] / total * len(rows) / used[k]) for k in (0, 1)))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted, n_features for every row of docs(doc_id, text)."""
    lasting_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            total, n = np.zeros(b.num_rows), np.zeros(b.num_rows, np.int64)
            for owner, f in features(b.column(2)):
                total += np.bincount(owner, model.odds[f], b.num_rows)
                n += np.bincount(owner, minlength=b.num_rows)
            with np.errstate(over="ignore"):
                p = 1 / (1 + np.exp(-(model.bias + total / np.maximum(n, 1))))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(p), pa.array((p >= threshold).astype(np.int32)), pa.array(n)], names=["doc_id", "held_out", "score", "predicted", "n_features"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidily(run), "doc_id long, held_out boolean, score double, predicted int, n_features long")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels))
