from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from paperloom.llm import tokenscan as K

END = "<|endoftext|>"
CASES = [None, "", "a", "Hello  world\n\n  x\tüßé 你好 😀 don't I'll", END, f"{END} text {END}{END}", "word " * 1023, "12345 67,890.12!!!???", " \n \n "]


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def corpus():
    return list(enumerate(CASES)) + [(100 + k, "word and more " * (1 + 37 * k % 200)) for k in range(40)] + [(3, CASES[3]), (None, "no id")]


def test_empty(docs):
    assert K.token_counts(docs([])).count() == 0


def test_a_separator_that_is_an_id_is_refused(docs):
    with pytest.raises(Exception, match="is an id of the vocabulary"):
        K.write_files(docs([(1, "a")]), separator=50_256)


@pytest.mark.parametrize("block", (7, 64, 1 << 20))
def test_separator_scan(docs, reference, block):
    rows = [r for r in corpus() if not r[1] or len(r[1]) < 40 * block][:60]
    got = K.token_counts(docs(rows), block=block).collect()
    assert sorted(((r.doc_id, r.n_tokens) for r in got), key=str) == sorted(((i, len(reference(t))) for i, t in rows), key=str)
    files = defaultdict(list)
    for r in got:
        assert r.closed
        files[r.file_no].append((r.doc_no, r.token_start, r.n_tokens))
    for v in files.values():
        at = 0
        for k, (doc_no, start, n) in enumerate(sorted(v)):
            assert (doc_no, start) == (k, at)
            at += n + 1


def test_scan_of_open_and_empty_files(spark, tmp_path):
    ids = {"a": [5, 6, 9, 7, 9, 9, 8], "b": [1, 2, 3], "c": [9], "d": []}
    for name, x in ids.items():
        (tmp_path / name).write_bytes(np.array(x, "<u2").tobytes())
    files = spark.createDataFrame([(k, len(v)) for k, v in ids.items()], "file string, n_tokens long")
    got = sorted(tuple(r) for r in K.scan(files, f"file://{tmp_path}", separator=9, block=2).select("file", "doc_no", "token_start", "n_tokens", "closed").collect())
    assert got == [("a", 0, 0, 2, True), ("a", 1, 3, 1, True), ("a", 2, 5, 0, True), ("a", 3, 6, 1, False), ("b", 0, 0, 3, False), ("c", 0, 0, 0, True)]
