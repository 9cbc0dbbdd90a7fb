"""Quality rules whose cutoffs are certified on labelled holdouts (operator 5).

A rule is a signal that is high in poor text. Labelled documents are halved by an MD5
of doc_id. From the first half each rule learns, in each stratum (length class of a document),
how many good and poor documents reach each of its ``GRID`` values; where poor ones are more
than twice as frequent, the value gets a level, which is the higher the fewer good documents
reach it. A document's level is the highest that any rule gives it. So all rules' cutoffs of
a stratum move together along one ladder of ``LEVELS`` steps, from the most lenient to the
strictest.

The second half, the holdout, then certifies: the ladder is descended as long as an exact
binomial test shows that at most ``alpha`` of the stratum's good documents are rejected, by
all rules together. Testing in a fixed order needs no correction between steps; between
strata the error ``delta`` is divided (Bonferroni). So with probability ``1 - delta`` no
stratum loses more than ``alpha`` of its good documents. A stratum needs
``ln(delta / strata) / ln(1 - alpha)`` good holdout documents (217 at 0.02 and 0.05) before
anything can be certified there; with fewer nothing is rejected by the rules.

Cases: null and empty text have no words (base_failed, rejected); a null doc_id has no
label but is judged like any row; repeated rows are judged alike; a labelled doc_id counts once
in the tests, however many rows have it, by the row of the least counts, and several labels of
one once, as poor if any says so; empty tables give empty results; input columns keep their
names and values, whatever they are called.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, lasting_batches, map_rows, materialise
from .vecwords import NEWLINE, SPACE, Words, buffer, grams, mix, sums

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
STRATA = (100, 300, 1000)  # upper bounds in words; the last stratum is open
GRID = 200  # cutoffs k / GRID for signals in 0..1
LEVELS = 48  # steps of the ladder; six of them halve the good documents that are rejected


def count_batch(column) -> dict[str, np.ndarray]:
    raw, offsets = buffer(column)
    words, lines = Words(raw, offsets, SPACE), Words(raw, offsets, NEWLINE)
    n = np.diff(words.first)
    lead = (raw & 0xC0) != 0x80
    # a line counts if some word starts in it
    starts = np.zeros(len(raw) + 1, np.int64)
    starts[words.start] = 1
    starts = np.concatenate((np.zeros(1, np.int64), np.cumsum(starts)))
    filled = starts[lines.end] > starts[lines.start]
    owner = lines.owner()[filled]
    key = mix(lines.hash[filled] ^ mix(owner.astype(np.uint64) + np.uint64(1)))
    _, first = np.unique(key, return_index=True)
    n_lines = np.bincount(owner, minlength=len(n))
    dup = n_lines - np.bincount(owner[first], minlength=len(n))
    tri, at, tri_first = grams(words.hash, words.first, 3)
    tri_owner = np.repeat(np.arange(len(n)), np.diff(tri_first))
    key = mix(tri ^ mix(tri_owner.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    again = np.zeros(len(key), bool)
    same = ranked[1:] == ranked[:-1]
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = np.zeros(len(words.start), bool)
    for k in range(3):
        covered[at[again] + k] = True
    return {
        "n_words": n,
        "word_chars": sums(lead & words.word, offsets),
        "n_symbols": sums(SYMBOL[raw], offsets),
        "n_dup_lines": dup,
        "n_repeat_words": sums(covered, words.first),
        "n_lines": n_lines,
    }


def with_counts(docs: DataFrame, text: str = "text", name: str = "_counts") -> DataFrame:
    """All columns of docs and a struct of the counts of its texts, in one pass without a shuffle."""
    lasting_batches(docs.sparkSession)
    kind = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS])
    schema = T.StructType([*docs.schema.fields, T.StructField(name, kind)])

    def run(batches):
        for b in batches:
            got = count_batch(b.column(b.schema.names.index(text)))
            column = pa.StructArray.from_arrays([pa.array(got[c].astype(np.int64)) for c in COUNTS], names=list(COUNTS))
            yield pa.RecordBatch.from_arrays([*b.columns, column], names=[*b.schema.names, name])

    return map_rows(docs, run, schema)


def signals(c) -> dict[str, Column]:
    """Signals in 0..1, high in poor text; c(name) gives a count's column."""
    words = F.greatest(c("n_words"), F.lit(1))
    mean = c("word_chars") / words
    unit = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    return {
        "symbols": unit(c("n_symbols") / words),
        "repeats": unit(c("n_repeat_words") / words),
        "dup_lines": unit(c("n_dup_lines") / F.greatest(c("n_lines"), F.lit(1))),
        "long_words": unit((mean - 5) / 15),
        "short_words": unit((5 - mean) / 5),
    }


def stratum(c) -> Column:
    out = F.lit(len(STRATA))
    for k in reversed(range(len(STRATA))):
        out = F.when(c("n_words") < STRATA[k], k).otherwise(out)
    return out


def _log_factorial_rest(n: float) -> float:
    """log(n!) less Stirling's main terms, without the loss of digits that large n would cost."""
    if n < 16:
        return math.lgamma(n + 1) - ((n + 0.5) * math.log(n) - n + 0.5 * math.log(2 * math.pi) if n else 0.0)
    return (1 / 12 - (1 / 360 - (1 / 1260 - 1 / (1680 * n * n)) / (n * n)) / (n * n)) / n


def _deviance(x: float, mean: float) -> float:
    """x log(x / mean) + mean - x, exact for x near the mean too."""
    if abs(x - mean) < 0.1 * (x + mean):
        v = (x - mean) / (x + mean)
        out, term, k = (x - mean) * v, 2 * x * v, 1
        while True:
            term *= v * v
            k += 2
            if out + term / k == out:
                return out
            out += term / k
    return x * math.log(x / mean) + mean - x if x else mean


def binomial_pmf(x: int, n: int, p: float) -> float:
    if x in (0, n):
        return math.exp(n * (math.log1p(-p) if x == 0 else math.log(p)))
    rest = _log_factorial_rest(n) - _log_factorial_rest(x) - _log_factorial_rest(n - x) - _deviance(x, n * p) - _deviance(n - x, n * (1 - p))
    return math.exp(rest) * math.sqrt(n / (2 * math.pi * x * (n - x)))


def binomial_cdf(x: int, n: int, p: float) -> float:
    """P(Binomial(n, p) <= x): the term of x, and those below it as long as they count."""
    if x >= n:
        return 1.0
    if x > n * p:
        return 1.0 - binomial_cdf(n - x - 1, n, 1 - p)
    total = term = 1.0
    k = x
    while k > 0 and term > total * 1e-17:
        term *= k * (1 - p) / ((n - k + 1) * p)
        total += term
        k -= 1
    return min(1.0, total * binomial_pmf(x, n, p))


def allowed(n: int, alpha: float, delta: float) -> int:
    """The most rejected of n good documents that still show a rate of at most alpha; -1 if none does.
    Some forty evaluations, however many documents there are."""
    lo, hi = -1, int(n * alpha)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if n and binomial_cdf(mid, n, alpha) <= delta:
            lo = mid
        else:
            hi = mid - 1
    return lo


def certify(rejected: list[int], n: int, alpha: float, delta: float) -> int | None:
    """rejected[k]: good documents beyond cutoff k, never growing with k. The smallest k
    that the fixed sequence from the most lenient cutoff down reaches, else None."""
    most, found = allowed(n, alpha, delta), None
    for k in range(len(rejected) - 1, -1, -1):
        if rejected[k] > most:
            break
        found = k
    return found


def ladder(good: np.ndarray, poor: np.ndarray, alpha: float) -> np.ndarray:
    """The level of each value of a rule, 0 for none, from the counts of good and poor documents by value."""
    reach = lambda h: h[::-1].cumsum()[::-1]
    share = (reach(good) + 0.5) / (good.sum() + 1)
    level = np.floor(np.log2(2 * alpha / share) * 6 + 1e-9).astype(np.int64)
    telling = reach(poor) / max(1, poor.sum()) > 2 * reach(good) / max(1, good.sum())
    level = np.where(telling, np.clip(level, 0, LEVELS), 0)
    level[0] = 0  # a value that every document reaches
    return np.maximum.accumulate(level)


def severity(c, ladders: dict[tuple[int, str], np.ndarray]) -> Column:
    """A document's level: the highest that a rule gives it in its stratum."""
    rules, s = signals(c), stratum(c)
    out = F.lit(0)
    for (k, rule), level in sorted(ladders.items()):
        steps = [b for b in range(1, GRID + 1) if level[b] > level[b - 1]]
        value = F.lit(0)
        for b in steps:  # rising, so the last that is reached counts
            value = F.when(rules[rule] * GRID >= b, int(level[b])).otherwise(value)
        if steps:
            out = F.greatest(out, F.when(s == k, value).otherwise(0))
    return out


def held_out() -> Column:
    """Whether a labelled document is of the holdout: by the first digit of an MD5 of its id."""
    return F.conv(F.substring(F.md5(F.concat(F.lit("holdout "), F.col("doc_id").cast("string")).cast("binary")), 1, 1), 16, 10).cast("int") < 8


def calibrate(counts: DataFrame, labels: DataFrame, alpha: float = 0.02, delta: float = 0.05) -> tuple[dict[tuple[int, str], np.ndarray], dict[int, int]]:
    """(levels by stratum and rule, the certified level by stratum). ``counts(doc_id, _counts)`` meets
    ``labels(doc_id, quality)`` by doc_id; what reaches the driver is two histograms of bounded size."""
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    c = lambda x: F.col(f"_counts.{x}")
    once = counts.join(known, "doc_id").groupBy("doc_id").agg(F.min("_counts").alias("_counts"), F.min("quality").alias("quality"))
    got = materialise(once.select("_counts", (F.col("quality") > 0).cast("int").alias("good"), held_out().alias("held")), "labelled")
    bins = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.floor(v * GRID).cast("int").alias("bin")) for r, v in signals(c).items()])).alias("x")
    table: dict[tuple[int, str], np.ndarray] = {}
    for r in got.where("not held").select(stratum(c).alias("s"), "good", bins).groupBy("s", "good", "x.rule", "x.bin").count().collect():
        table.setdefault((r["s"], r["rule"]), np.zeros((2, GRID + 1), np.int64))[r["good"], r["bin"]] += r["count"]
    ladders = {k: level for k, h in table.items() if (level := ladder(h[1], h[0], alpha)).any()}
    seen: dict[int, np.ndarray] = {}
    for r in got.where("held and good = 1").select(stratum(c).alias("s"), severity(c, ladders).alias("level")).groupBy("s", "level").count().collect():
        seen.setdefault(r["s"], np.zeros(LEVELS + 1, np.int64))[r["level"]] += r["count"]
    certified = {}
    for s, h in seen.items():
        beyond = h[::-1].cumsum()[::-1]
        k = certify([int(x) for x in beyond[1:]], int(h.sum()), alpha, delta / (len(STRATA) + 1))
        if k is not None:
            certified[s] = k + 1
    return ladders, certified


def base_failed(c) -> Column:
    return (c("n_words") < 50) | (100 * c("n_repeat_words") > 50 * c("n_words"))


def verdict(c, rules: tuple[dict[tuple[int, str], np.ndarray], dict[int, int]]) -> Column:
    """True if the document's level stays below the one certified for its stratum."""
    ladders, certified = rules
    s, bad = stratum(c), F.lit(False)
    for k, level in sorted(certified.items()):
        bad = bad | ((s == k) & (severity(c, {x: v for x, v in ladders.items() if x[0] == k}) >= level))
    return ~bad


def quality_rules(docs: DataFrame, labels: DataFrame, alpha: float = 0.02, delta: float = 0.05) -> DataFrame:
    """doc_id, the counts, base_failed and kept for every row of docs(doc_id, text)."""
    counted = materialise(with_counts(docs.select("doc_id", "text")).drop("text"), "counts")
    cutoffs = calibrate(counted, labels, alpha, delta)
    c = lambda x: F.col(f"_counts.{x}")
    fail = base_failed(c)
    return counted.select("doc_id", *[c(x).alias(x) for x in COUNTS[:5]], fail.alias("base_failed"), (~fail & verdict(c, cutoffs)).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, alpha: float = 0.02, delta: float = 0.05) -> DataFrame:
    """The rows of docs that pass; texts are read twice and never shuffled."""
    cutoffs = calibrate(with_counts(docs.select("doc_id", "text")).drop("text"), labels, alpha, delta)
    name = fresh(docs.columns, "_counts")["_counts"]
    c = lambda x: F.col(f"{name}.{x}")
    return with_counts(docs, name=name).where(~base_failed(c) & verdict(c, cutoffs)).drop(name)
