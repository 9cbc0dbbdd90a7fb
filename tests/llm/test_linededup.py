import random
import re

import pyarrow as pa

from paperloom.llm import linededup as D

rnd = random.Random(9)
WORDS = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(2, 9))) for _ in range(500)]


def sentence():
    return " ".join(rnd.choice(WORDS) for _ in range(rnd.randrange(4, 14))) + "."


def text(n):
    return "".join(sentence() + rnd.choice((" ", "\n")) for _ in range(n))


M = 2**64


def mixed(x):
    for _ in range(2):
        x ^= x >> 32
        x = x * 0xD6E8FEB86659FD93 % M
    return x ^ x >> 32


def hashed(t):
    return mixed((sum((c + 1) * pow(0x9E3779B97F4A7C15, k, M) for k, c in enumerate(t.encode())) + len(t.encode()) * 0xA24BAED4963EE407) % M)


def least(values, n):
    """Places that are the least of n in a row, of equal ones the last."""
    return {max(range(k, k + n), key=lambda j: (-values[j], j)) for k in range(len(values) - n + 1)}


class Text:
    """Words and chunks of a text as the docstring says, word by word."""

    def __init__(self, t, min_words=D.MIN_WORDS):
        self.t = t
        lines, at = [], 0
        for m in re.finditer(r"[.!?](?= )|\n", t):
            lines.append((at, m.end()))
            at = m.end()
        lines.append((at, len(t)))
        self.words = words = [(m.start(), m.end()) for m in re.finditer(r"[^ \t\n\r\x0b\x0c]+", t)]
        self.lo, self.hi, folded = {}, {}, []
        for a, z in lines:
            mine = [k for k, w in enumerate(words) if a <= w[0] < z]  # a word belongs to the line it starts in
            if not mine:
                continue
            self.lo[mine[0]], self.hi[mine[-1]] = a, z
            cuts = {mine[-1]} | ({mine[k] for k in least([hashed(t[slice(*words[j])]) for j in mine], D.FOLD_WINDOW)} if len(mine) > D.FOLD else set())
            first = mine[0]
            for c in sorted(cuts):
                folded.append((first, c))
                first = c + 1
        for k, w in enumerate(words):
            self.lo.setdefault(k, w[0])
            if k not in self.hi:
                self.hi[k] = words[k + 1][0]
        h = [hashed(t[words[a][0] : words[z][1]]) for a, z in folded]
        roll = [mixed((h[k] * 0x9E3779B97F4A7C15 + h[k + 1]) % M) for k in range(len(h) - 1)]
        bounds = sorted(least(roll, D.WINDOW))
        starts, ends = [0, *bounds], [*(b + 1 for b in bounds), len(folded) - 1]
        self.chunks = []
        for s, e in zip(starts, ends, strict=True) if folded else ():
            while e < len(folded) and folded[e][1] - folded[s][0] + 1 < min_words:
                e += 1
            if e < len(folded) and (folded[s][0], folded[e][1]) not in self.chunks:
                self.chunks.append((folded[s][0], folded[e][1]))

    def body(self, k):
        return self.t[self.words[self.chunks[k][0]][0] : self.words[self.chunks[k][1]][1]]

    def left_of(self, k, other, f):
        """The first word of those before chunk k that stand before the other's chunk f too."""
        j, i, n = self.chunks[k][0], other.chunks[f][0], 0
        while j and i and n < D.CONTEXT and self.t[self.words[j - 1][0] : self.words[j][0]] == other.t[other.words[i - 1][0] : other.words[i][0]]:
            j, i, n = j - 1, i - 1, n + 1
        return j

    def right_of(self, k, other, f):
        j, i, n = self.chunks[k][1], other.chunks[f][1], 0
        while j + 1 < len(self.words) and i + 1 < len(other.words) and n < D.CONTEXT and self.t[self.words[j][1] : self.words[j + 1][1]] == other.t[other.words[i][1] : other.words[i + 1][1]]:
            j, i, n = j + 1, i + 1, n + 1
        return j


def brute(rows):
    """What is left of every text when each chunk that stands at an earlier place goes, and what is beside it, or all of an earlier text."""
    first, out, whole = {}, {}, set()
    for i, t in rows:
        x = Text(t or "")
        gone = bytearray(len(t or ""))

        def go(a, z, x=x, gone=gone):
            gone[x.lo[a] : x.hi[z]] = b"\1" * (x.hi[z] - x.lo[a])

        mine, later, again = {}, {}, {}
        for k in range(len(x.chunks)):
            if x.body(k) in mine:
                again[k] = mine[x.body(k)]
            else:
                mine[x.body(k)] = k
                if x.body(k) in first:
                    later[k] = first[x.body(k)]
        if t in whole and x.chunks:
            later, again = {}, {}
            go(0, len(x.words) - 1)
        whole.add(t)
        cut = {*later, *again}
        for k, (other, f) in later.items():
            go(*x.chunks[k])
            if k - 1 not in later:
                go(x.left_of(k, other, f), x.chunks[k][0])
            if k + 1 not in later:
                go(x.chunks[k][1], x.right_of(k, other, f))
        for k, f in again.items():
            go(*x.chunks[k])
            if k - 1 not in cut:
                go(x.left_of(k, x, f), x.chunks[k][0])
            if k + 1 not in cut:
                go(x.chunks[k][1], x.right_of(k, x, f))
        for b, k in mine.items():
            first.setdefault(b, (x, k))
        blank = " \t\n\r\x0b\x0c"
        for m in re.finditer(rb"\x01+", bytes(gone)):
            a, z = m.span()
            if a and z < len(t) and t[a] in blank and t[a - 1] not in blank and t[z] not in blank:
                gone[a] = 0  # two words would become one
        out[i] = "".join(c for c, g in zip(t or "", gone, strict=True) if not g)
    return out


def test_agrees_with_brute_force(docs):
    passages = [text(12) for _ in range(6)]
    rows = []
    for i in range(120):
        t = text(rnd.randrange(0, 15))
        for _ in range(rnd.randrange(3)):
            at = rnd.randrange(len(t) + 1)
            t = t[:at] + rnd.choice(passages) + t[at:]
        rows.append((i, t))
    rows += [(600, "\n" + rows[5][1] + "\n \n"), (601, "\n" + rows[5][1] + "\n \n"), (602, "a few words only"), (603, "a few words only"), (500, rows[3][1]), (501, ""), (502, None), (503, passages[0] * 3), (504, " \n \n"), (505, "é. " * 900), (506, "ü" * 3 + " \t" + passages[1].replace(" ", "\x0b\n")), (507, passages[2].replace(".", "!")), (508, " ".join(WORDS)), (509, "x " + " ".join(WORDS)), (510, "de " * 400)]
    rows += [(700 + k, rows[k][1]) for k in range(0, 60, 3)] + [(800, rows[9][1]), (801, rows[9][1])]
    rows.sort(key=lambda r: r[0])
    want = brute(rows)
    got = {r.doc_id: r.text for r in D.dedup_lines(docs(rows)).collect()}
    assert {i: t or "" for i, t in got.items()} == want
    assert got[502] is None and sum(len(w) for w in want.values()) < 0.9 * sum(len(t or "") for _, t in rows)


def test_chunks_agree_with_the_definition():
    for least_words in (D.MIN_WORDS, 3):
        for _ in range(60):
            t = rnd.choice(("", "x", " \n")) + text(rnd.randrange(0, 9)) + rnd.choice(("", " ".join(WORDS[: rnd.randrange(60)]), "\n"))
            c = D.Chunks(*D.buffer(pa.array([t])), least_words)
            x = Text(t, least_words)
            assert [(int(a), int(b)) for a, b in zip(c.first, c.last, strict=True)] == x.chunks
            assert [c.raw[a:b].tobytes().decode() for a, b in zip(c.x, c.y, strict=True)] == [x.body(k) for k in range(len(x.chunks))]
            assert c.lo.tolist() == [x.lo[k] for k in range(len(x.words))] and c.hi.tolist() == [x.hi[k] for k in range(len(x.words))]


def test_no_text_loses_to_itself(docs):
    rows = [(i, text(i % 12)) for i in range(200)]
    assert all(r.n_cut == 0 for r in D.dedup_lines(docs(rows)).collect())


def test_boundaries_resist_shifts():
    """Lines put before a text change chunks at the joint only; a chunk has two lines or more and each text is covered."""
    body = "\n".join(sentence() for _ in range(60)) + "\n"
    one, two = ({x.body(k) for k in range(len(x.chunks))} for lead in ("", "\n".join(sentence() for _ in range(5)) + "\n") for x in [Text(lead + body)])
    assert len(one & two) >= len(one) - 3
    x = Text(body)
    covered = {w for a, z in x.chunks for w in range(a, z + 1)}
    assert set(range(len(x.words))) - covered <= set(range(len(x.words) - D.MIN_WORDS, len(x.words)))


def test_equal_hashes_of_different_bytes_stay(docs, monkeypatch):
    monkeypatch.setattr(D, "MIN_WORDS", 2)
    a, b = text(9), text(9)
    out = {r.doc_id: r.text for r in D.dedup_lines(docs([(1, a), (2, b)]), 2).collect()}
    assert out == {1: a, 2: b}


def test_repeated_and_null_ids(docs):
    t = text(25)
    got = D.dedup_lines(docs([(7, t), (7, t), (None, t), (None, t)])).collect()
    kept = sorted((r.doc_id is None, r.n_cut > 0) for r in got)
    assert kept == [(False, True), (False, True), (True, False), (True, False)]


def test_columns_and_empty(docs, spark):
    assert D.dedup_lines(docs([])).count() == 0
    df = spark.createDataFrame([(1, "x y", 3, 4)], "doc_id long, text string, n_lines int, k1 int")
    assert D.dedup_lines(df).columns == ["doc_id", "text", "n_lines", "k1", "n_lines_", "n_cut"]


def test_passages_at_random_places(docs):
    """Passages of 50 to 60 words in one to seven sentences or none, pasted anywhere: every word of every later copy goes, and nothing else."""
    fresh = (f"w{k}x{rnd.randrange(10**6)}" for k in range(10**6))

    def passage(total, n):
        cuts = [0, *sorted(rnd.sample(range(1, total), n - 1)), total]
        return " ".join(" ".join(next(fresh) for _ in range(z - a)) + "." for a, z in zip(cuts, cuts[1:], strict=False))

    passages = [passage(rnd.randrange(51, 61), n) for n in (1, 1, 2, 3, 4, 5, 7)] + [passage(55, 1)[:-1]]
    rows, own = [], {}
    for i in range(200):
        host = [next(fresh) + rnd.choice((".", "", "", "", "\n")) for _ in range(rnd.randrange(100, 200))]
        at = rnd.randrange(len(host) + 1)
        own[i] = {w.rstrip("\n") for w in host}
        rows.append((i, " ".join([*host[:at], passages[i % len(passages)], *host[at:]])))
    got = {r.doc_id: set(r.text.split()) for r in D.dedup_lines(docs(rows)).collect()}
    assert all(got[i] == own[i] for i in range(len(passages), 200))
    assert all(got[i] == own[i] | set(passages[i].split()) for i in range(len(passages)))


def test_a_repeated_line_goes(docs):
    line = " ".join(f"v{k}" for k in range(30)) + "."
    rows = [(i, f"{text(3)}\n{line}\n{text(3)}") for i in range(3)]
    got = {r.doc_id: (r.text, r.n_cut) for r in D.dedup_lines(docs(rows)).collect()}
    assert got[0] == (rows[0][1], 0) and all(got[i] == (rows[i][1].replace(f"{line}\n", ""), 1) for i in (1, 2))
    kept = {r.doc_id for r in D.keep_filled(docs([*rows, (3, line), (4, " "), (5, None)])).collect()}
    assert kept == {0, 1, 2, 4, 5}
