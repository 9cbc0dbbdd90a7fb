import collections
import hashlib
import random

import numpy as np
import pyarrow as pa

from paperloom.llm import aligntok as A
from paperloom.llm import tokens

rnd = random.Random(4)


def text():
    kinds = ("abc def", "  ", "\n\n", "naïve", "日本語", "😀", "<|endoftext|>", "<s>", "don't", "12345", "###", "é", "\t", "Über", "\x00", "the of and in")
    return " ".join(rnd.choice(kinds) for _ in range(rnd.randrange(0, 25)))


TEXTS = [None, "", "a", " ", " x", "▁", "a ▁ b", "<|endoftext|>", "</s> <unk> <0x41>", "\x01\x7f", "x" * 3000, "the cat " * 900, "é" * 50, *[text() for _ in range(60)]]


def brute(rows):
    """By the contract, token by token; A by the tokenizers library itself."""
    import public_tokenizers
    from tokenizers import Tokenizer

    a_tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a_tok.encode_special_tokens = True
    b_tok, _ = A.pieces(A.pieces_path())
    letters = tokens._byte_letters()
    found, holders = [], collections.Counter()
    for _, t in rows:
        a = a_tok.encode(" " + t, add_special_tokens=False).ids if t else []
        b = b_tok.encode(t) if t else []
        aw = [bytes(letters[c] for c in a_tok.id_to_token(i)) for i in a]
        bw = [bytes([int(p[3:5], 16)]) if b_tok.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [b_tok.id_to_piece(i)]]
        if not t or b"".join(aw) != (" " + t).encode() or b"".join(bw) != (" " + t).encode():
            a, b, aw, bw = [], [], [], []
        spans = []
        for words in (aw, bw):
            at, out = 0, []
            for w in words:
                out.append((at, at + len(w)))
                at += len(w)
            spans.append(out)
        links = [(i, j) for i, (x, y) in enumerate(spans[0]) for j, (u, v) in enumerate(spans[1]) if x < v and u < y] if len(a) * len(b) < 500_000 else None
        if links is None:  # two pointers where all pairs would be too many
            links, j = [], 0
            for i, (x, y) in enumerate(spans[0]):
                while spans[1][j][1] <= x:
                    j += 1
                k = j
                while k < len(b) and spans[1][k][0] < y:
                    links.append((i, k))
                    k += 1
        cuts = sorted({y for _, y in spans[0]} & {y for _, y in spans[1]})
        parts, lo = [], 0
        for c in cuts:
            side = [",".join(str(x) for x, (s, e) in zip(ids, sp, strict=True) if lo <= s and e <= c) for ids, sp in zip((a, b), spans, strict=True)]
            parts.append("|".join(side))
            lo = c
        found.append((a, b, links, parts))
        holders.update({(a[i], b[j]) for i, j in links})
    best = {}
    for (x, _), n in holders.items():
        best[x] = max(best.get(x, 0), n)
    out = []
    for a, b, links, parts in found:
        n = [holders[a[i], b[j]] for i, j in links]
        out.append((len(a), len(b), len(parts), len(links), sum(c == best[a[i]] for c, (i, _) in zip(n, links, strict=True)), sum(n), hashlib.sha256(";".join(parts).encode()).hexdigest() if parts else ""))
    return out


def values(r):
    return (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256)


def test_agrees_with_brute_force(spark, docs):
    rows = list(enumerate([*TEXTS, *TEXTS[:20]]))
    want = brute(rows)
    for size in (A.BLOCK_BYTES, 500):
        got = {r.doc_id: values(r) for r in A.align(docs(rows), block_bytes=size).collect()}
        assert [got[i] for i, _ in rows] == want
    assert got[5] == got[0] == (0, 0, 0, 0, 0, 0, "") and sum(w[0] for w in want) > 3000


def test_groups_cover_every_text(spark, docs):
    rows = list(enumerate(TEXTS))
    got = collections.defaultdict(list)
    for r in A.groups(docs(rows)).orderBy("doc_id", "group").collect():
        got[r.doc_id].append(r)
    digests = {r.doc_id: r.groups_sha256 for r in A.align(docs(rows)).collect()}
    _, a_words = A.byte_level(tokens.vocabulary_path())
    for i, t in rows:
        if not digests[i]:
            assert not got[i]
            continue
        raw = (" " + t).encode()
        assert [g.group for g in got[i]] == list(range(len(got[i]))) and got[i][-1].byte_to == len(raw)
        assert b"".join(raw[g.byte_from : g.byte_to] for g in got[i]) == raw
        assert all(a_words.spell(np.array(g.a_ids)).tobytes() == raw[g.byte_from : g.byte_to] for g in got[i])
        plain = ";".join(",".join(map(str, g.a_ids)) + "|" + ",".join(map(str, g.b_ids)) for g in got[i])
        assert hashlib.sha256(plain.encode()).hexdigest() == digests[i]


def test_rank_and_select():
    for n in (1, 63, 64, 65, 1000):
        places = np.sort(np.array(rnd.sample(range(n), max(1, n // 3))))
        bits = A.Bits.at(places, n)
        assert bits.select().tolist() == places.tolist()
        assert bits.rank(np.arange(n)).tolist() == [int((places < k).sum()) for k in range(n)]


def test_links_in_parts(monkeypatch):
    column = pa.array([t for t in TEXTS if t])
    whole = A.Aligned(column, tokens.vocabulary_path(), A.pieces_path())
    one = [np.concatenate(x).tolist() for x in zip(*whole.links(), strict=True)]
    monkeypatch.setattr(A, "LINKS", 7)
    assert [np.concatenate(x).tolist() for x in zip(*whole.links(), strict=True)] == one


def test_null_and_repeated_ids_and_empty_tables(spark, docs):
    rows = [(None, "some words"), (3, "some words"), (3, "some words"), (None, None)]
    got = sorted((r.doc_id is None, values(r)) for r in A.align(docs(rows)).collect())
    want = sorted((i is None, w) for (i, _), w in zip(rows, brute(rows), strict=True))
    assert got == want and got[0][1][5] == 3 * got[0][1][3]
    assert A.align(docs([])).count() == 0 and A.groups(docs([])).count() == 0
    df = spark.createDataFrame([(1, "x y", 2, 3)], "doc_id long, text string, block int, pair int")
    assert A.align(df).columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_a_block_is_many_small_rows(spark):
    """A row of a block's whole documents outgrows a reader's batch of thousands of rows."""
    docs = spark.createDataFrame([(k, f"the cat {k} sat") for k in range(300)], "doc_id long, text string").coalesce(1)
    rows = A._blocks(docs, A.vocabulary_path(), A.pieces_path(), A.BLOCK_BYTES).toArrow()
    docs_at, pairs_at = rows["doc"].is_valid().to_pylist(), rows["pair"].is_valid().to_pylist()
    assert sum(docs_at) == 300 and sum(pairs_at) == rows.num_rows - 300
    assert len(set(rows["block"].to_pylist())) == 1
    assert sorted(x for x in rows["at"].to_pylist() if x is not None) == list(range(sum(pairs_at)))
