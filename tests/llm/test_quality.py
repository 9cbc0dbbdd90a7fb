import collections
import re

import pytest

from paperloom.llm import quality as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    c = collections.Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    cover = {k + j for k in range(len(w) - 2) if c[tuple(w[k : k + 3])] > 1 for j in range(3)}
    seen, dup = set(), 0
    for x in text.split("\n"):
        if WORD.search(x):
            dup += x in seen
            seen.add(x)
    return len(w), sum(map(len, w)), sum(ch in "#*$%&|<>" for ch in text), dup, len(cover)


CASES = [None, "", " \t\n", "a b c", "a b c a b c", "é ß x # é ß x # é ß x", "line one\nline one\n\n\nline one\n", "x " * 5000, "one two\r\nthree\x0bfour", "z" * 100_000]


def test_counts_agree_with_brute_force(spark, docs):
    rows = list(enumerate([*CASES, *CASES]))
    got = {r.doc_id: r for r in Q.quality_rules(docs(rows), spark.createDataFrame([], "doc_id long, quality int")).collect()}
    for i, t in rows:
        want = brute(t)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert r.kept == (not r.base_failed)


def test_binomial_bound_is_exact():
    from math import comb

    for n, x, p in ((10, 2, 0.3), (50, 0, 0.05), (200, 7, 0.02)):
        assert Q.binomial_cdf(x, n, p) == pytest.approx(sum(comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(x + 1)))


def test_certify_stops_at_the_first_failure():
    assert Q.certify([900, 100, 2, 0, 0], 1000, 0.02, 0.01) == 2
    assert Q.certify([5, 0, 0], 10, 0.02, 0.01) is None
    assert Q.certify([0], 0, 0.02, 0.01) is None


def test_the_bound_holds_its_digits_for_very_many_documents():
    from fractions import Fraction

    n, p = 400, Fraction(1, 50)
    exact, term = Fraction(0), (1 - p) ** n
    for x in range(0, 30):
        exact += term
        assert Q.binomial_cdf(x, n, 0.02) == pytest.approx(float(exact), rel=1e-9)
        term = term * (n - x) / (x + 1) * p / (1 - p)
    for n in (10**6, 10**9, 10**11):
        x = Q.allowed(n, 0.02, 0.0125)
        z = (0.02 * n - x) / (n * 0.02 * 0.98) ** 0.5
        assert 2.2 < z < 2.3  # the normal quantile of 0.0125 is 2.241
        assert Q.binomial_cdf(x, n, 0.02) <= 0.0125 < Q.binomial_cdf(x + 1, n, 0.02)
    assert Q.allowed(216, 0.02, 0.0125) == -1 and Q.allowed(217, 0.02, 0.0125) == 0


def labelled(rng, n):
    """Documents of every stratum, good and poor, with signals that overlap."""
    rows = []
    for i in range(n):
        good = rng.random() < 0.8
        words = int(rng.choice((60, 200, 600, 1500)))
        bad_share = rng.beta(1, 40) if good else rng.beta(3, 12)
        rows.append((i, good, words, int(words * bad_share)))
    return rows


def counted(spark, rows):
    fields = "n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines"
    kind = "struct<" + ", ".join(f"{f}: long" for f in fields.split(", ")) + ">"
    return spark.createDataFrame([(i, (w, 5 * w, sym, 0, 0, 10)) for i, _, w, sym in rows], f"doc_id long, _counts {kind}")


def test_kept_against_a_plain_computation(spark):
    """Levels, the certified step and the verdict, computed again row by row in Python."""
    import numpy as np
    from pyspark.sql import functions as F

    rows = labelled(np.random.default_rng(5), 12_000)
    counts = counted(spark, rows)
    labels = spark.createDataFrame([(i, int(g)) for i, g, _, _ in rows], "doc_id long, quality int")
    rules = Q.calibrate(counts, labels)
    held = {r.doc_id: r.h for r in counts.select("doc_id", Q.held_out().alias("h")).collect()}
    c = lambda x: F.col(f"_counts.{x}")
    got = {r.doc_id: r.k for r in counts.select("doc_id", Q.verdict(c, rules).alias("k")).collect()}
    want, n_rejected = {}, 0
    for s in range(4):
        mine = [r for r in rows if sum(r[2] >= u for u in Q.STRATA) == s]
        value = {i: int(min(1.0, sym / w) * Q.GRID) for i, _, w, sym in mine}
        good = [value[i] for i, g, _, _ in mine if g and not held[i]]
        poor = [value[i] for i, g, _, _ in mine if not g and not held[i]]
        level, last = [0], 0
        for b in range(1, Q.GRID + 1):
            share_good, share_poor = sum(v >= b for v in good), sum(v >= b for v in poor)
            if share_poor / len(poor) > 2 * share_good / len(good):
                last = max(last, min(Q.LEVELS, max(0, int(np.floor(np.log2(0.04 / ((share_good + 0.5) / (len(good) + 1))) * 6 + 1e-9)))))
            level.append(last)
        holdout = [level[value[i]] for i, g, _, _ in mine if g and held[i]]
        cut = None
        for k in range(Q.LEVELS, 0, -1):
            if Q.binomial_cdf(sum(x >= k for x in holdout), len(holdout), 0.02) > 0.05 / 4:
                break
            cut = k
        for i, *_ in mine:
            want[i] = cut is None or level[value[i]] < cut
            n_rejected += not want[i]
    assert got == want and n_rejected > 300


def test_good_documents_are_rejected_no_more_often_than_said():
    """Simulation: of many calibrations on fresh holdouts, at most about delta select a cutoff whose true
    false-rejection rate is above alpha."""
    import numpy as np

    rng = np.random.default_rng(9)
    alpha, delta, n, wrong = 0.05, 0.1, 2000, 0
    for _ in range(400):
        level = np.minimum(10, rng.geometric(0.35, n) - 1)  # P(level >= k) = 0.65 ** k
        k = Q.certify([int((level >= j).sum()) for j in range(1, 11)], n, alpha, delta)
        wrong += k is not None and 0.65 ** (k + 1) > alpha
    assert wrong <= 400 * delta


def test_production_parameters_certify_something(spark):
    import numpy as np

    rows = labelled(np.random.default_rng(2), 4000)
    _, certified = Q.calibrate(counted(spark, rows), spark.createDataFrame([(i, int(g)) for i, g, _, _ in rows], "doc_id long, quality int"))
    assert set(certified) == {0, 1, 2, 3}


def test_symbols_are_rejected_and_good_documents_kept(spark, docs):
    word = lambda i, k: f"w{(i * 7919 + k * 104729) % 99991}"
    good = [(i, " ".join(word(i, k) for k in range(150))) for i in range(3000)]
    bad = [(i, " ".join(word(i, k) + "###" for k in range(150))) for i in range(3000, 3300)]
    labels = spark.createDataFrame([(i, int(i < 3000)) for i in range(3300)] + [(None, 0), (3, None)], "doc_id long, quality int")
    got = Q.keep_good(docs(good + bad), labels, alpha=0.1)
    ids = {r.doc_id for r in got.collect()}
    assert got.columns == ["doc_id", "text", "rep"]
    assert len(ids & set(range(3000))) > 2700
    assert not ids & set(range(3000, 3300))


def test_a_doc_id_counts_once_in_the_holdout(spark):
    """Were its thousand rows counted, one document would speak for a thousand."""
    import numpy as np

    rows = labelled(np.random.default_rng(4), 4000)
    labels = spark.createDataFrame([(i, int(g)) for i, g, _, _ in rows], "doc_id long, quality int")
    once = counted(spark, rows)
    held = {r.doc_id: r.h for r in once.select("doc_id", Q.held_out().alias("h")).collect()}
    good = next(r for r in rows if r[1] and held[r[0]] and r[2] == 200)
    many = counted(spark, rows + [(good[0], True, 200, 190)] * 1000)
    one, two = Q.calibrate(once, labels), Q.calibrate(many, labels)
    assert one[1] == two[1] and all((one[0][k] == two[0][k]).all() for k in one[0])


def test_oracle_where_rules_reject(spark):
    """The contract's SQL on a table large enough that cutoffs are certified and reject documents."""
    import os

    import duckdb

    from paperloom.llm.oracles import ORACLE
    from paperloom.llm.queries import op5_quality_rules

    d = "/root/testdata/sf0.1"
    if not os.path.isdir(d):
        pytest.skip("no test data")
    db = duckdb.connect()
    for t in ("documents", "labels"):
        db.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    want = sorted(db.execute(f"select {', '.join(names)} from ({ORACLE['op5_quality_rules']})").fetchall())
    got = sorted(tuple(r) for r in op5_quality_rules(spark, d).select(*names).collect())
    assert got == want and sum(not r[6] and not r[7] for r in got) > 100


def test_empty_tables(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert Q.quality_rules(docs([]), none).count() == 0
    assert Q.keep_good(docs([]), none).count() == 0
