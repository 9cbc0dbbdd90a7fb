import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from paperloom.llm import packing as P
from paperloom.llm import tokens

END = "<|endoftext|>"
CASES = [None, "", "a", "Hello  world\n\n  x\tüßé 你好 😀 don't I'll", END, f"{END} text", f"a {END} b", f"a{END}{END}  b\n{END}", f"<{END}|endoftext|", f"x  {END}\n\ny" * 300, "word " * 1023, "word " * 3000, "12345 67,890.12!!!???", "z" * 5000, " \n \n "]


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_ids_equal_the_tokenizers_library(reference):
    rnd = random.Random(1)
    texts = CASES + ["".join(rnd.choice("aeiou nst.,'\n\tÄß€—1234 THE#*") for _ in range(rnd.randrange(200))) for _ in range(300)]
    texts += [END.join(rnd.choice(("", " ", "a b", "\n x", "é ")) for _ in range(rnd.randrange(2, 5))) for _ in range(100)]
    for t in texts:
        assert tokens.encode(tokens.vocabulary_path(), t).tolist() == reference(t)


def corpus():
    rnd = random.Random(3)
    return list(enumerate(CASES)) + [(100 + k, "word and more " * rnd.randrange(1, 400)) for k in range(150)] + [(3, CASES[3]), (None, "no id")]


def test_every_id_lies_in_one_piece(docs, reference):
    rows = corpus()
    got = P.pack(docs(rows)).collect()
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id, r.doc_tokens].append((r.start, r.length, r.ids_crc32))
    want = defaultdict(list)
    for i, t in rows:
        ids = np.array([*reference(t), 0], "<u4")
        want[i, len(ids)] += [(a, len(ids[a : a + 1024]), zlib.crc32(ids[a : a + 1024].tobytes())) for a in range(0, len(ids), 1024)]
    assert {k: sorted(v) for k, v in pieces.items()} == {k: sorted(v) for k, v in want.items()}
    assert sorted(sequences) == list(range(len(sequences)))
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(r.length for r in got)
    assert len(sequences) <= total / 1024 * 1.05 + 2


@pytest.mark.parametrize("seed", range(5))
def test_plan_uses_every_piece_once(seed):
    rnd = np.random.default_rng(seed)
    hist = np.zeros(1025, np.int64)
    lengths = np.minimum(1024, rnd.lognormal(5, 1, 20_000).astype(int) + 1)
    np.add.at(hist, lengths, 1)
    plan = P.plan(hist)
    used = np.zeros(1025, np.int64)
    for p, n in plan:
        assert n > 0 and sum(p) <= 1024
        for v in p:
            used[v] += n
    assert (used == hist).all()
    assert sum(n for _, n in plan) <= lengths.sum() / 1024 * 1.02 + 1


def test_nnls_solves_an_exact_system():
    patterns = [(600, 424), (500, 524), (424, 300, 300)]
    hist = np.zeros(1025, np.int64)
    for p, n in zip(patterns, (30, 20, 10), strict=True):
        for v in p:
            hist[v] += n
    assert np.allclose(P.nnls(patterns, hist, 2000), (30, 20, 10), atol=0.1)


def test_empty(docs):
    assert P.pack(docs([])).count() == 0
