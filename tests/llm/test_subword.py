import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from paperloom.llm import subword as S

rnd = random.Random(3)
WORDS = ["".join(rnd.choice("abcdefghijklm") for _ in range(rnd.randrange(2, 9))) for _ in range(800)]


def good():
    return " ".join(rnd.choice(WORDS) for _ in range(rnd.randrange(20, 80)))


def poor():
    kind = rnd.randrange(3)
    if kind == 0:
        return " ".join(rnd.choice(WORDS) + rnd.choice(("###", "$$$", "%%%")) for _ in range(40))
    if kind == 1:
        return " ".join([rnd.choice(WORDS)] * 30 + [rnd.choice(WORDS)] * 30)
    return good().upper()


def corpus(n=700):
    rows = [(i, good() if i % 6 else poor()) for i in range(n)]
    return rows, [(i, int(i % 6 > 0)) for i, _ in rows]


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_held_out_accuracy_and_the_fold(spark, docs):
    rows, labels = corpus()
    rows += [(1000, None), (1001, ""), (None, good()), (1002, rows[1][1]), (1002, rows[1][1]), (1003, good() * 3000), (1004, " \n")]
    table = spark.createDataFrame([*labels, (5, 1), (6, 0), (9999, 0), (None, 1), (8, None)], "doc_id long, quality int")
    got = S.classify(docs(rows), table).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert all(r.held_out == (held("null") if r.doc_id is None else held(r.doc_id)) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    test = [(by[i].predicted, y) for i, y in labels if held(i)]
    assert sum(p == y for p, y in test) >= 0.97 * len(test)
    assert by[1000].score == by[1001].score == by[1004].score and by[1003].predicted == 1
    # labels of the held-out fold, and other columns, change nothing
    turned = spark.createDataFrame([(i, 1 - y if held(i) else y) for i, y in labels], "doc_id long, quality int")
    again = {r.doc_id: r.score for r in S.classify(docs(rows), turned).collect()}
    assert all(again[i] == by[i].score for i, _ in labels)


def test_features_agree_with_a_plain_count():
    """As many features as the definition says, equal for equal parts, whole texts, none across texts."""
    texts = ["ab abc ab ab", "", None, "\n", "x", "é ü", "ab abc ab ab"]

    def n(t):
        w = (t or "").split()
        padded = (t or "").encode()
        grams = 0
        for size in S.BYTE_GRAMS:
            for a in range(len(padded) - size + 1):
                grams += not any(c in b" \n" for c in padded[a + 1 : a + size - 1])
        return len(w) + max(0, len(w) - 1) + grams

    total = np.zeros(len(texts), int)
    for owner, f in S.features(pa.array(texts)):
        assert ((f >= 0) & (f < S.FEATURES)).all()
        total += np.bincount(owner, minlength=len(texts))
    assert total.tolist() == [n(t) for t in texts]
    bags = S.bags(pa.array(texts))
    assert np.array_equal(bags[0][0], bags[6][0]) and np.allclose(bags[0][1], bags[6][1]) and sum(bags[0][1]) == pytest.approx(1)
    assert not len(bags[1][0]) and not len(bags[2][0])


def test_runs_of_bytes_do_not_depend_on_parts(monkeypatch):
    column = pa.array(["some words of a text, and more of them", "é" * 50])
    count = lambda: np.sum([np.bincount(f, minlength=S.FEATURES) for _, f in S.features(column)], axis=0)
    whole = count()
    monkeypatch.setattr(S, "SLICE", 7)
    assert (count() == whole).all()


def test_a_step_follows_the_gradient():
    """The loss of a small set falls, and the folded score is the softmax of the mean vector."""
    rows = [(k % 2, np.array([k % 2, 5], np.uint16), np.array([0.5, 0.5], np.float32)) for k in range(40)]
    m = S.train(rows, (1.0, 1.0), epochs=30)
    assert m.odds[1] > 1 > -1 > m.odds[0]
    assert S.train(rows, (1.0, 1.0), epochs=3).bias == S.train(rows, (1.0, 1.0), epochs=3).bias


def test_too_little_to_learn_from(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    rows = [(i, good()) for i in range(10)]
    assert {r.score for r in S.classify(docs(rows), none).collect()} == {0.5}
    ones = spark.createDataFrame([(i, 1) for i in range(10)], "doc_id long, quality int")
    assert {r.score for r in S.classify(docs(rows), ones).collect()} == {1.0}
    zeros = spark.createDataFrame([(i, 0) for i in range(10)], "doc_id long, quality int")
    assert {r.predicted for r in S.classify(docs(rows), zeros).collect()} == {0}
    assert S.classify(docs([]), ones).count() == 0
    some = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    blank = [(i, None if i % 2 else good()) for i in range(20)]
    assert all(0 < r.score < 1 for r in S.classify(docs(blank), some).collect())


def test_columns_are_ignored(spark):
    df = spark.createDataFrame([(1, "a b", 0.5, 1)], "doc_id long, text string, score double, label int")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert S.classify(df, labels).columns == ["doc_id", "held_out", "score", "predicted", "n_features"]
