"""Language identification by nearest centroids (operator 9).

A text is a vector of its byte pairs and byte triples (A-Z lower-cased), hashed to
``FEATURES`` numbers: square roots of counts times the inverse document frequency over all
training documents, normalised. Every label is learned: from a bounded sample of labelled texts
(``SAMPLE`` different ones in all, as many of each language, but ``LEAST`` of each at least; the least by a
hash) each language gets up to ``CENTROIDS`` centroids by spherical k-means; a model has 16 KB a
centroid, however many documents there are. A text takes the language
of the centroid of the largest cosine (ties: the language first by name); where the cosine
lies below what nearly all of that centroid's own sample reach, it is marked ``rejected``.
The score is the cosine.

Cases: null text, or one without a letter, is ``und`` with score 0; if there is nothing to
learn from, every text is ``und``; a null lang teaches nothing; a null doc_id counts as the
text 'null' for the fold; repeated rows are predicted alike; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, lasting_batches, small_batches, tidily
from .vecwords import FOLD, U, buffer, sums

FEATURES, SAMPLE, LEAST, CENTROIDS, ROUNDS = 4096, 2000, 20, 3, 10
REJECT_BELOW = 0.005  # quantile of a centroid's own sample
ASCII_LETTER = np.zeros(256, bool)
ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True


def counts(column) -> np.ndarray:
    """Hashed counts of byte pairs and triples, a row for each text."""
    raw, offsets = buffer(column)
    n = len(offsets) - 1
    b = FOLD[raw].astype(np.int64)
    b[(b < 97) | ((b > 122) & (b < 128))] = 32  # digits, signs and blanks are all one blank
    owner = np.repeat(np.arange(n, dtype=np.int64) * FEATURES, np.diff(offsets))
    out = np.zeros(n * FEATURES, np.int64)
    for k, multiplier in ((2, 0x9E3779B1), (3, 0x85EBCA77)):
        if len(b) >= k:
            code = b[: len(b) - k + 1].copy()
            for j in range(1, k):
                code = code * 256 + b[j : len(b) - k + 1 + j]
            bucket = (((code.astype(U) + U(k << 28)) * U(multiplier)) & U(0xFFFFFFFF)).astype(np.int64) >> (32 - 12)
            inside = owner[: len(code)] == owner[k - 1 :]
            out += np.bincount((owner[: len(code)] + bucket)[inside], minlength=n * FEATURES)
    return out.reshape(n, FEATURES)


def vectors(column, idf: np.ndarray) -> np.ndarray:
    v = np.sqrt(counts(column).astype(np.float32)) * idf
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def has_letter(column) -> np.ndarray:
    raw, offsets = buffer(column)
    out = sums(ASCII_LETTER[raw], offsets) > 0
    for k in np.flatnonzero(~out):
        out[k] = any(c.isalpha() for c in raw[offsets[k] : offsets[k + 1]].tobytes().decode("utf-8", "replace") if ord(c) > 127)
    return out


def kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Spherical k-means from far-apart rows; fewer centroids if rows are fewer."""
    mean = x.mean(axis=0)
    c = [x[int(np.argmax(x @ mean))]]
    while len(c) < min(k, len(x)):
        c.append(x[int(np.argmin(np.max(x @ np.array(c).T, axis=1)))])
    c = np.array(c)
    for _ in range(rounds):
        near = np.argmax(x @ c.T, axis=1)
        c = np.array([x[near == j].mean(axis=0) if (near == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def held_out():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).cast("binary")) % 3 == 1


def fit(docs: DataFrame, sample: int = SAMPLE, centroids: int = CENTROIDS) -> dict | None:
    """A model from the rows of docs(doc_id, text, lang) outside the held-out fold."""
    train = docs.where(~held_out() & F.col("text").isNotNull() & F.col("lang").isNotNull()).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    sizes = {r["lang"]: r["count"] for r in train.groupBy("lang").count().collect()}  # a row a language
    if not sizes:
        return None

    def frequency(batches):
        total, n = np.zeros(FEATURES + 1, np.int64), 0
        for b in batches:
            total[:-1] += (counts(b.column(0)) > 0).sum(axis=0)
            n += b.num_rows
        total[-1] = n
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(FEATURES + 1)), pa.array(total)], names=["feature", "df"])

    df = np.zeros(FEATURES + 1)
    with small_batches(docs.sparkSession):
        for r in train.select("text").mapInArrow(tidily(frequency), "feature long, df long").groupBy("feature").agg(F.sum("df").alias("df")).collect():
            df[r["feature"]] = r["df"]
    idf = (np.log((1 + df[-1]) / (1 + df[:-1])) + 0.1).astype(np.float32)

    chosen = bounded_sample(train, "lang", sizes, max(LEAST, sample // len(sizes)), "languages")

    def embed(batches):
        for b in batches:
            v = vectors(b.column(1), idf).astype(np.float16)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tobytes() for x in v], pa.binary())], names=["lang", "v"])

    rows: dict[str, list] = {}
    for r in chosen.mapInArrow(tidily(embed), "lang string, v binary").collect():  # 8 KB a text of the sample
        rows.setdefault(r["lang"], []).append(bytes(r["v"]))
    langs, cs, least = [], [], []
    for lang in sorted(rows):
        x = np.stack([np.frombuffer(v, np.float16).astype(np.float32) for v in sorted(rows[lang])])
        c = kmeans(x, centroids)
        near, cos = np.argmax(x @ c.T, axis=1), np.max(x @ c.T, axis=1)
        for j in range(len(c)):
            langs.append(lang)
            cs.append(c[j])
            least.append(float(np.quantile(cos[near == j], REJECT_BELOW)) if (near == j).any() else 0.0)
    return {"langs": langs, "centroids": np.array(cs, np.float32), "least": np.array(least), "idf": idf} if langs else None


def predict(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for every row of docs(doc_id, text)."""
    lasting_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            n = b.num_rows
            letters = has_letter(b.column(2))
            best, score = np.zeros(n, np.int64), np.zeros(n)
            if model and n:
                cos = vectors(b.column(2), model["idf"]) @ model["centroids"].T
                best, score = np.argmax(cos, axis=1), np.clip(np.max(cos, axis=1).astype(float), 0, 1)
            known = letters & bool(model)
            far = ~known if not model else ~known | (score < model["least"][best])
            pred = [model["langs"][k] if ok else "und" for k, ok in zip(best, known, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(pred, pa.string()), pa.array(np.where(known, score, 0.0)), pa.array(far)], names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

    return docs.select(F.col("doc_id").cast("long"), held_out(), F.col("text").cast("string")).mapInArrow(tidily(run), "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def identify(docs: DataFrame) -> DataFrame:
    return predict(docs, fit(docs))
