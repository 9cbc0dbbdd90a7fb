import hashlib
import random
import re

import duckdb
import pytest

from paperloom.llm import fim as M

rnd = random.Random(12)
PIECES = ["a", "line one", "\n", "\n\n", "é", "日本", "😀", "\x01", "\x02", "\x01e", "\x01d", "\x02d", "<", ">", "<P", "S>", "$0", "\\n", "\r\n", "e", "d", " "]
TEXTS = [None, "", "\n", "\n\n\n", "x", "x\n", "a<P>b", "<S>", "c<M>", "<P", "P>", "<<P>", "\x01\x02\x01e\x02\n\x01d\n", "q" * 200_000 + "\n" + "r", "l\n" * 5000]
TEXTS += ["".join(rnd.choice(PIECES) for _ in range(rnd.randrange(40))) for _ in range(300)]


def brute(i, t, rate=100, spm=50, seed="7"):
    t = t or ""
    u = re.findall(r"[^\n]*\n|[^\n]+", t)
    h = hashlib.sha256(f"{seed}:{'null' if i is None else i}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(u), "plain", None, None, t
    if h[3] % 100 < spm:
        return len(u), "spm", p, m, f"<S>{s}<P>{p}<M>{m}"
    return len(u), "psm", p, m, f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize(("rate", "spm", "seed"), [(100, 50, "7"), (40, 10, "x")])
def test_agrees_with_brute_force(docs, rate, spm, seed):
    rows = [*enumerate(TEXTS), (None, "one\ntwo\nthree"), (7, TEXTS[14]), (7, TEXTS[14])]
    got = M.fill_in_middle(docs(rows), rate, spm, seed).withColumn("back", M.restore(M.F.col("output"), M.F.col("form"))).collect()
    found = sorted(((r.doc_id is None, r.doc_id, r.text, r.n, r.form, r.prefix, r.middle, r.output) for r in got), key=str)
    assert found == sorted(((i is None, i, t, *brute(i, t, rate, spm, seed)[:4], None if t is None else brute(i, t, rate, spm, seed)[4]) for i, t in rows), key=str)
    assert all(r.back == r.text for r in got)
    assert len({r.form for r in got}) == 3


def test_digest_and_oracle(docs, spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(TEXTS) if t is None or "\x00" not in t]
    got = sorted(map(tuple, M.digest(docs(rows)).collect()))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = []
    for i, t in rows:
        n, form, p, m, out = brute(i, t)
        want.append((i, n, form, None if p is None else len(p), None if m is None else len(m), sha(out), sha(t or "")))
    assert got == want
    docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(db.execute(M.ORACLE).fetchall()) == want


def test_columns_and_empty(spark, docs):
    df = spark.createDataFrame([(1, "a\nb", 2, 3, 4)], ["doc_id", "text", "N", "a.b", "Form"])
    out = M.fill_in_middle(df)
    assert out.columns == ["doc_id", "text", "N", "a.b", "Form", "n_", "form_", "prefix", "middle", "suffix", "output"]
    assert tuple(out.first())[2:6] == (2, 3, 4, 2)
    assert M.fill_in_middle(docs([])).count() == 0 and M.digest(docs([])).count() == 0
