import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from paperloom.llm import graph
from paperloom.llm import minhash as M

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, percent):
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    sets = {}
    for i, t in rows:
        w = WORD.findall(low(t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            n = len(sets[a] & sets[b])
            if a < b and n and 100 * n >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def corpus():
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    rows, texts = [], []
    for _ in range(25):
        base = [word() for _ in range(rnd.choice((3, 8, 60, 200)))]
        texts.append(base)
        for _ in range(rnd.randrange(6)):
            edit = list(rnd.choice(texts))
            for _ in range(rnd.choice((0, 1, 1, 2, 3))):
                edit[rnd.randrange(len(edit))] = word()
            texts.append(edit)
    rows = [(i + 1, " ".join(t)) for i, t in enumerate(texts)]
    return rows + [(1000, None), (1001, ""), (1002, "  \n"), (1003, rows[0][1].upper()), (1004, "a b c"), (1005, "A\tB\nC"), (1006, "z " * 30_000)]


def test_components_agree_with_brute_force(docs):
    for percent in (85, 80):
        rows = corpus()
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in M.near_duplicates(docs(rows), percent).collect()}
        assert got == brute(rows, percent)


def test_null_and_repeated_ids(docs):
    text = " ".join(map(str, range(40)))
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in M.near_duplicates(docs([(None, text), (7, text), (7, text), (3, text)])).collect()), key=str)
    assert got == [(3, 3, True), (7, 3, False), (7, 3, False), (None, None, True)]


def test_keep_one_and_empty(docs):
    assert M.near_duplicates(docs([])).count() == 0
    assert M.keep_one(docs([(1, "a b c d e f"), (2, "a b c d e f"), (3, "x")])).orderBy("doc_id").select("doc_id", "rep").collect() == [(1, "x"), (3, "x")]


def test_long_chain_of_links(spark):
    n = 300
    chain = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(900, 900), (5, 4)], "u long, v long")
    assert {r.component for r in graph.components(chain).collect()} == {0}
    assert graph.components(chain).count() == n + 1


def test_one_id_with_two_texts_has_the_links_of_both(docs):
    a, b, near = " ".join(f"a{k}" for k in range(60)), " ".join(f"b{k}" for k in range(60)), " ".join(f"a{k}" for k in range(59))
    got = sorted((r.doc_id, r.component_id, r.kept) for r in M.near_duplicates(docs([(7, a), (7, b), (3, b), (2, near), (9, near + " z"), (9, "own " * 9)])).collect())
    assert got == [(2, 2, True), (3, 2, False), (7, 2, False), (7, 2, False), (9, 2, False), (9, 2, False)]


def test_repeated_rows_are_fetched_once(docs, monkeypatch):
    from paperloom.llm import common

    sizes = {}
    real = common.materialise

    def spy(df, name="t", folder=None):
        out = real(df, name, folder)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(M, "materialise", spy)
    text = " ".join(map(str, range(200)))
    rows = [(1, text)] * 100 + [(2, text + " and one")]
    got = {(r.doc_id, r.component_id) for r in M.near_duplicates(docs(rows)).collect()}
    assert got == {(1, 1), (2, 1)}
    assert sizes["texts"] == 101 and sizes["texts-once"] == 2


def test_links_between_members_of_a_family_that_no_center_has(docs):
    """Texts that share half of their words, in pairs of near copies: no center links the pairs, the prefixes do."""
    common = [f"c{k}" for k in range(300)]
    rows = []
    for i in range(60):
        own = [f"o{i}x{k}" for k in range(220)]
        rows += [(2 * i, " ".join(common + own)), (2 * i + 1, " ".join(common + own[:215]))]
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in M.near_duplicates(docs(rows)).collect()} == brute(rows, 85)


def test_prefixes_lose_no_similar_pair(docs):
    """Every pair of similar sets shares a shingle of its prefixes, and passes the tests there."""
    from pyspark.sql import functions as F

    rows = corpus()[:80]
    texts = docs(rows).select(F.col("doc_id").alias("h"), F.col("doc_id").alias("comp"), "text").where("text <> ''")
    low = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in ((i, (t or "").split()) for i, t in rows)}
    for percent in (80, 85):
        got = {(r.hu, r.hv) for r in M.prefix_pairs(texts, percent, lambda df, name: df).collect()}
        want = {(a, b) for a in low for b in low if a < b and 100 * len(low[a] & low[b]) >= percent * len(low[a] | low[b]) and low[a]}
        assert want and want <= got


def test_a_node_with_very_many_neighbours(spark):
    hub = spark.range(1, 3000).selectExpr("id as u", "0L as v")
    other = spark.range(5000, 5010).selectExpr("id as u", "4000L as v")
    got = {r.component: r["count"] for r in graph.components(hub.unionByName(other)).groupBy("component").count().collect()}
    assert got == {0: 3000, 4000: 11}


def test_counts_that_meet_in_a_group_are_small(spark, monkeypatch):
    """Texts dealt over 64 tasks: shingle counts are right, and no group of partial counts has more than 1 MB."""
    texts = spark.createDataFrame([(f"one two three four five w{k} w{k // 2} w{k // 3}",) for k in range(64)], "text string").repartition(64)
    grouped, group = [], type(texts).groupBy
    monkeypatch.setattr(type(texts), "groupBy", lambda self, *cols: grouped.append(self) or group(self, *cols))
    got = M.shingle_counts(texts)
    monkeypatch.undo()
    s, _ = M.shingle_sets(pa.array([r.text for r in texts.collect()]))
    assert (got == np.bincount(M.bucket(s), minlength=M.BUCKETS)).all()
    (counts,) = grouped
    assert counts.groupBy("part").agg(F.sum(F.length("n")).alias("n")).agg(F.max("n")).first()[0] < 2**20
