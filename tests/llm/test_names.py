"""Columns of the input whose names clash with an operator's own, differ from them in case only, or hold a dot."""

import pytest

import corpus_pipeline as C
from paperloom.llm import aligntok, decontam, fim, langid, license, linededup, minhash, packing, quality, sharding, subword, tokenscan, warc

NAMES = ["_COUNTS", "n_cut", "N_LINES", "a.b", "Rep", "Hash", "k1", "K2", "H", "row", "N", "form", "bucket", "shard_region", "Component", "_hash", "label", "block", "th", "at", "SIZE", "rank", "x`y"]
WORDS = [f"word{k}" for k in range(400)]


def text(i):
    return " ".join(WORDS[(i * 7 + k * (i % 5 + 1)) % 400] for k in range(120)) + ".\n"


@pytest.fixture(scope="module")
def tables(spark):
    rows = [(i, text(i % 20), "en", "s", 0, *range(len(NAMES))) for i in range(40)] + [(100, None, None, None, None, *range(len(NAMES)))]
    plain = spark.createDataFrame([r[:5] for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    odd = spark.createDataFrame(rows, [*plain.columns, *NAMES])
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(40)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, " ".join(WORDS[5:40]))], "item_id long, text string")
    return plain, odd, labels, bench


@pytest.mark.parametrize("name", ["license", "leaks", "shards", "quality", "near", "pack", "lines", "lang", "tokens", "align", "fim", "subword"])
def test_operators(tables, name):
    plain, odd, labels, bench = tables
    run = {
        "license": license.scan, "leaks": lambda d: decontam.leaks(d, bench), "shards": sharding.place, "quality": lambda d: quality.quality_rules(d, labels),
        "near": minhash.near_duplicates, "pack": packing.pack, "lines": linededup.digest, "lang": langid.identify, "tokens": tokenscan.token_counts,
        "align": aligntok.align, "fim": fim.digest, "subword": lambda d: subword.classify(d, labels),
    }[name]
    rows = lambda d: sorted(map(str, run(d).collect()))
    assert rows(odd) == rows(plain)


def test_captures(spark):
    rows = [(i, f"http://a.b/{i % 3}", f"x{i % 4}", *range(len(NAMES))) for i in range(12)]
    odd = spark.createDataFrame(rows, ["page_id", "url", "html", *NAMES])
    out = lambda d: sorted(map(str, warc.capture_histories(d).select("page_id", "record_type", "refers_to").collect()))
    assert out(odd) == out(odd.select("page_id", "url", "html"))


@pytest.mark.parametrize("k", range(5))
def test_stages(tables, spark, tmp_path, k):
    plain, odd, labels, bench = tables
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    stage = C.STAGES[k][1]
    one, two = stage(spark, plain, str(tmp_path)), stage(spark, odd, str(tmp_path))
    if k < 4:
        assert two.columns == odd.columns
        for r in two.collect():
            assert list(r)[5:] == list(range(len(NAMES)))
    assert sorted(map(str, two.select(*one.columns).collect())) == sorted(map(str, one.collect()))
