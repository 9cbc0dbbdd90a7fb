"""The pipeline against a plain computation of every stage from its description."""

import random
import re
import zlib

import numpy as np
from test_decontam import truth
from test_linededup import brute as cut_repeats
from test_quality import brute as counts

import corpus_pipeline as C
from paperloom.llm import packing, tokens

rnd = random.Random(77)
VOCABULARY = ["".join(rnd.choice("abcdefghijklmnopqrst") for _ in range(rnd.randrange(2, 8))) for _ in range(4000)]


def sentence():
    return " ".join(rnd.choice(VOCABULARY) for _ in range(rnd.randrange(5, 14))).capitalize() + "."


def text(n):
    return " ".join(sentence() for _ in range(n))


def changed(t, share):
    ws = t.split(" ")
    for k in range(len(ws)):
        if rnd.random() < share:
            ws[k] = rnd.choice(VOCABULARY)
    return " ".join(ws)


def corpus():
    items = [(k, " ".join(rnd.choice(VOCABULARY) for _ in range(rnd.randrange(20, 40)))) for k in range(8)]
    passages = [text(8) for _ in range(3)]
    docs = {i: text(rnd.randrange(8, 20)) for i in range(80)}
    for i in range(80, 100):  # copies, near copies
        docs[i] = docs[i - 80] if i % 2 else changed(docs[i - 80], 0.01)
    for i in range(100, 112):  # repeated passages
        docs[i] = text(6) + " " + passages[i % 3] + " " + text(6)
    for i in range(112, 120):  # benchmark items
        docs[i] = text(6) + " " + items[i - 112][1] + " " + text(6)
    docs |= {120: "too short", 121: "again and again " * 60, 122: "", 123: "###" * 400, 124: text(1500)}
    return docs, items


def near(docs, percent):
    """The smallest doc_id of each component of documents whose 5-word shingles are similar."""
    sets = {}
    for i, t in docs.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", t.translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    root = {i: i for i in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in docs:
        for j in docs:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: t for i, t in docs.items() if find(i) == i}


def test_every_stage_and_the_whole_run(spark, tmp_path):
    docs, items = corpus()
    rows = [(i, t, "en", "src", len(t)) for i, t in docs.items()] + [(500, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    # too few good documents to certify a cutoff: the base rules alone reject
    spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    def good(t):
        n, _, _, _, repeated = counts(t)
        return n >= 50 and 100 * repeated <= 50 * n

    def without_lines(now):
        left = cut_repeats(sorted(now.items()))
        return {i: t for i, t in left.items() if t == now[i] or re.search(r"[^\x20\x09-\x0D]", t)}

    steps = [
        lambda now: {i: t for i, t in now.items() if good(t)},
        without_lines,
        lambda now: near(now, C.SIMILAR),
        lambda now: {i: t for i, t in now.items() if i not in {d for d, _ in truth(sorted(now.items()), items)}},
    ]
    want, table, sizes = docs, spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for (name, stage), step in zip(C.STAGES, steps, strict=False):
        before, want = want, step(want)
        table = C.materialise(stage(spark, table, str(tmp_path)), name)
        assert {r.doc_id: r.text for r in table.collect()} == want, name
        sizes.append((len(before) - len(want), sum(before[i] != t for i, t in want.items())))
    assert [n for n, _ in sizes][0] == 4 and all(n > 0 for n, _ in (sizes[0], sizes[1], sizes[3])) and sizes[1][1] >= 9

    # near copies that line dedup hasn't taken apart go where the stage sees whole documents
    whole = {i: t for i, t in docs.items() if t}
    alone = C.near_stage(spark, spark.createDataFrame([(i, t) for i, t in whole.items()], "doc_id long, text string"), str(tmp_path))
    assert {r.doc_id: r.text for r in alone.collect()} == near(whole, C.SIMILAR) and len(whole) - alone.count() >= 18

    packed = C.run(spark, str(tmp_path)).collect()
    path = tokens.vocabulary_path()
    ids = {i: np.append(tokens.encode(path, t), np.uint32(packing.END_ID)).astype("<u4") for i, t in want.items()}
    held, filled = {i: 0 for i in want}, {}
    for r in sorted(packed, key=lambda r: (r.doc_id, r.start)):
        assert r.start == held[r.doc_id] and r.doc_tokens == len(ids[r.doc_id])
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32
        held[r.doc_id] += r.length
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert held == {i: len(x) for i, x in ids.items()}
    for parts in filled.values():
        ends = [0, *np.cumsum([n for _, n in sorted(parts)]).tolist()]
        assert [a for a, _ in sorted(parts)] == ends[:-1] and ends[-1] <= packing.WINDOW
    assert len(filled) <= 1.1 * sum(map(len, ids.values())) / packing.WINDOW + 1
