import random

import numpy as np
import pyarrow as pa

from paperloom.llm import langid as L

SYLLABLES = {"en": "the and ing tion er wh", "fr": "eau que ment é ou les", "de": "sch ung ä der ei ch", "es": "ción os ñ la que ar"}


def corpus(n=400):
    rnd = random.Random(2)
    out = []
    for i in range(n):
        lang = rnd.choice(list(SYLLABLES))
        parts = SYLLABLES[lang].split()
        out.append((i, " ".join("".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 4))) for _ in range(rnd.randrange(5, 80))), lang))
    return out


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_held_out_accuracy_and_folds(spark):
    import zlib

    rows = corpus()
    got = {r.doc_id: r for r in L.identify(table(spark, rows)).collect()}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, _, _ in rows)
    held = [(got[i].lang_pred, lang) for i, _, lang in rows if got[i].held_out]
    assert sum(a == b for a, b in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())


def test_held_out_labels_and_sources_are_not_read(spark):
    rows = corpus()
    base = {r.doc_id: (r.lang_pred, r.score) for r in L.identify(table(spark, rows)).collect()}
    held = {r.doc_id for r in L.identify(table(spark, rows)).where("held_out").collect()}
    other = {r.doc_id: (r.lang_pred, r.score) for r in L.identify(table(spark, [(i, t, "xx" if i in held else g) for i, t, g in rows])).collect()}
    assert base == other


def test_odd_rows(spark):
    rows = corpus(200) + [(1000, None, "en"), (1001, "", "en"), (1002, "123 !?", "fr"), (1003, "你好", None), (None, "the and", None), (1004, "the " * 50_000, "en"), (1005, "the", None), (1005, "the", None)]
    got = {}
    for r in L.identify(table(spark, rows)).collect():
        got.setdefault(r.doc_id, []).append(r.lang_pred)
    assert [got[k] for k in (1000, 1001, 1002)] == [["und"]] * 3
    assert got[1003] != ["und"] and got[1004] == ["en"] and len(got[1005]) == 2


def test_three_hundred_languages(spark):
    rnd = random.Random(7)
    parts = {f"l{k:03}": ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(3)) for _ in range(5)] for k in range(300)}
    rows = [(9 * k + j, " ".join("".join(rnd.choice(parts[lang]) for _ in range(rnd.randrange(1, 3))) for _ in range(60)), lang) for k, lang in enumerate(parts) for j in range(9)]
    got = {r.doc_id: (r.held_out, r.lang_pred) for r in L.identify(table(spark, rows)).collect()}
    held = [(got[i][1], lang) for i, _, lang in rows if got[i][0]]
    assert sum(a == b for a, b in held) > 0.95 * len(held)
    assert len({a for _, a in got.values()}) >= 295


def test_nothing_to_learn(spark):
    assert [r.lang_pred for r in L.identify(table(spark, [(1, "abc", None)])).collect()] == ["und"]
    assert L.identify(table(spark, [])).count() == 0


def test_vectors_ignore_neighbouring_texts():
    one = L.counts(pa.array(["abc def"]))
    two = L.counts(pa.array(["xyz", "abc def", None, ""]))
    assert (one[0] == two[1]).all() and not two[2].any() and not two[3].any()


def test_kmeans_finds_groups():
    rng = np.random.default_rng(1)
    x = np.vstack([np.eye(3)[k] + rng.normal(0, 0.05, (30, 3)) for k in range(3)])
    c = L.kmeans(x / np.linalg.norm(x, axis=1, keepdims=True), 3)
    assert sorted(np.argmax(c, axis=1)) == [0, 1, 2]


def plain_vector(text, idf):
    """Square roots of hashed pair and triple counts times idf, byte by byte."""
    b = [c + 32 if 65 <= c <= 90 else c for c in text.encode()]
    b = [32 if c < 97 or 123 <= c < 128 else c for c in b]
    v = [0.0] * L.FEATURES
    for k, multiplier in ((2, 0x9E3779B1), (3, 0x85EBCA77)):
        for at in range(len(b) - k + 1):
            code = 0
            for c in b[at : at + k]:
                code = code * 256 + c
            v[((code + (k << 28)) * multiplier & 0xFFFFFFFF) >> 20] += 1
    v = [x**0.5 * w for x, w in zip(v, idf, strict=True)]
    norm = sum(x * x for x in v) ** 0.5
    return [x / norm for x in v] if norm else v


def test_predictions_and_rejection_against_brute_force(spark):
    rows = corpus(300) + [(900 + k, "".join(random.Random(k).choice("qxzjw vkpy") for _ in range(80)), None) for k in range(40)] + [(990, None, None), (991, "12", None), (992, "Ж Ш", None)]
    docs = table(spark, rows)
    model = L.fit(docs)
    got = {r.doc_id: r for r in L.predict(docs, model).collect()}
    rejected = 0
    for i, text, _ in rows:
        if text is None or not any(c.isalpha() for c in text):
            assert (got[i].lang_pred, got[i].score, got[i].rejected) == ("und", 0.0, True)
            continue
        v = plain_vector(text, model["idf"].tolist())
        cos = [sum(a * b for a, b in zip(v, c, strict=True)) for c in model["centroids"].tolist()]
        best = max(range(len(cos)), key=lambda k: (cos[k], -k))
        assert abs(got[i].score - cos[best]) < 1e-4
        near = sorted(cos)[-2:]
        if near[1] - near[0] > 1e-4:
            assert got[i].lang_pred == model["langs"][best]
            if abs(cos[best] - model["least"][best]) > 1e-4:
                assert got[i].rejected == (cos[best] < model["least"][best])
        rejected += got[i].rejected
    noise = [got[900 + k].rejected for k in range(40)]
    assert sum(noise) > 30 and rejected < 40 + 3 + 0.05 * 300


def test_document_frequencies_and_the_learned_fold(spark):
    rows = corpus(200)
    model = L.fit(table(spark, rows))
    train = [t for i, t, _ in rows if __import__("zlib").crc32(str(i).encode()) % 3 != 1]
    df = (L.counts(pa.array(train)) > 0).sum(axis=0)
    assert np.allclose(model["idf"], np.log((1 + len(train)) / (1 + df)) + 0.1, atol=1e-5)


def test_many_dirty_labels(spark):
    rows = corpus(400)
    dirty = rows + [(10_000 + k, "the and ing", f"label {k}") for k in range(600)]
    model = L.fit(table(spark, dirty))
    assert len(set(model["langs"])) > 300 and set(SYLLABLES) <= set(model["langs"])
    got = L.predict(table(spark, rows), model).collect()
    truth = {i: g for i, _, g in rows}
    assert sum(r.lang_pred == truth[r.doc_id] for r in got) > 0.9 * len(rows)
