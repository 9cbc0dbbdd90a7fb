import random
import re

import corpus_pipeline as C
from paperloom.llm import linededup

rnd = random.Random(21)
LETTERS = "abcdefghijklmnop"


def word():
    return "".join(rnd.choice(LETTERS) for _ in range(rnd.randrange(2, 8)))


COMMON = ["the", "of", "and", "in"]


def sentence():
    return " ".join(rnd.choice(COMMON) if rnd.random() < 0.3 else word() for _ in range(rnd.randrange(6, 14))).capitalize() + "."


def text(n=12):
    return "\n".join(" ".join(sentence() for _ in range(3)) for _ in range(n // 3))


def write(spark, tmp_path):
    docs = {i: text() for i in range(60)}
    docs[100] = docs[3]  # an exact copy
    changed = docs[4].split(" ")
    changed[10] = "changed"
    docs[101] = " ".join(changed)  # a near copy
    docs[102] = "too short"
    docs[103] = " ".join(["again and again"] * 40)
    item = " ".join(word() for _ in range(30))
    docs[104] = text() + "\n" + item + ".\n" + text()
    passage = text(9)
    for i in (105, 106):
        docs[i] = text() + "\n" + passage + "\n" + text()
    rows = [(i, t, "en", "src", len(t)) for i, t in docs.items()] + [(200, None, None, None, None), (201, "", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(50)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return docs, passage


def test_stages_take_effect(spark, tmp_path):
    docs, passage = write(spark, tmp_path)
    d = str(tmp_path)
    table = spark.read.parquet(f"{d}/documents.parquet")
    names = [name for name, _ in C.STAGES]
    assert names == ["quality_rules", "line_dedup", "minhash_near_dedup", "decontamination", "packing"]
    seen = {}
    for name, stage in C.STAGES[:-1]:
        table = stage(spark, table, d)
        assert table.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        table = C.materialise(table, name)
        seen[name] = {r.doc_id: r.text for r in table.collect()}
        assert all(r.n_chars == len(r.text) for r in table.collect())
    assert set(docs) - set(seen["quality_rules"]) == {102, 103} and 200 not in seen["quality_rules"]
    lines = seen["line_dedup"]
    assert all(lines[i] == docs[i] for i in range(60))
    assert 100 not in lines and len(lines[101]) < len(docs[101]) and lines[105] == docs[105] and len(lines[106]) < len(docs[106])
    assert set(range(60)) <= set(seen["minhash_near_dedup"])
    assert set(seen["minhash_near_dedup"]) - set(seen["decontamination"]) == {104}
    packed = C.run(spark, d).collect()
    assert {r.doc_id for r in packed} == set(seen["decontamination"])


def test_near_stage_alone(spark, tmp_path):
    docs, _ = write(spark, tmp_path)
    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {r.doc_id for r in C.near_stage(spark, table, str(tmp_path)).collect()}
    assert not kept & {100, 101} and {3, 4, 200, 201} <= kept and set(range(60)) <= kept


def test_line_stage_drops_only_what_is_emptied(spark, tmp_path):
    docs, _ = write(spark, tmp_path)
    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.text for r in C.line_stage(spark, table, str(tmp_path)).collect()}
    want = {r.doc_id: (r.text, r.n_cut) for r in linededup.dedup_lines(table).collect()}
    assert got == {i: t for i, (t, n) in want.items() if not n or re.search(r"[^\x20\x09-\x0D]", t)}


def test_empty_corpus(spark, tmp_path):
    for name, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert C.run(spark, str(tmp_path)).count() == 0
