"""Cross-tokenizer alignment by packed bitsets (operator 11).

Each text is encoded by a byte-level BPE vocabulary (A, given a leading space) and a piece
model (B, which adds one). A bit for each byte of a batch marks where a token ends, in one
packed bitset for A and one for B. Their AND marks the shared cuts; counting bits before a byte
(rank) gives the token that holds it, so cuts become ranges of tokens (groups), and a token's
first and last byte the range of the other side's tokens that it overlaps (links).

How many documents hold an id pair linked is counted over the whole corpus: a block of
documents (``BLOCK_BYTES`` of text, or one text, if longer) lists its different pairs once, with
the number of its documents that hold each; a common pair has a row a block. A
block's pairs and documents are rows of their own, and meet again block by block when pairs have been counted. An A id's highest count is found among at most as many pairs as B
has ids.

Cases: null and empty texts, and texts whose tokens' bytes on either side are not the text's own
with a space before it (a literal U+2581 does that), have no tokens: zeros and an empty digest;
special tokens' strings are plain text; a null doc_id keeps its row; repeated rows are documents
of their own and count as such; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lasting_batches, materialise, shared_dir, tidily
from .tokens import encoder, vocabulary_path
from .vecwords import U

PIECES = "piece_bpe_32k.model"
SHIFT = 20  # bits of a B id in a pair's number
BLOCK_BYTES = 1 << 22
LINKS = 1 << 18  # tokens whose links are expanded at a time


def pieces_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(PIECES)


class Vocabulary:
    """A tokenizer's ids, and the bytes of each: one after the other, with offsets."""

    def __init__(self, words: list[bytes]):
        self.offsets = np.concatenate((np.zeros(1, np.int64), np.cumsum([len(w) for w in words])))
        self.bytes = np.frombuffer(b"".join(words), np.uint8)
        self.length = np.diff(self.offsets)

    def spell(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of ids one after the other."""
        n = self.length[ids]
        ends = np.cumsum(n)
        return self.bytes[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.offsets[ids] - (ends - n), n)]


@functools.lru_cache(4)
def byte_level(path: str):
    code, _ = encoder(path)
    word = lambda k: code.decode_single_token_bytes(k)
    return code, Vocabulary([word(k) for k in range(code.max_token_value + 1)])


@functools.lru_cache(4)
def pieces(path: str):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    word = lambda k: bytes([int(model.id_to_piece(k)[1:-1], 16)]) if model.is_byte(k) else model.id_to_piece(k).replace("▁", " ").encode()
    return model, Vocabulary([word(k) for k in range(model.get_piece_size())])


class Bits:
    """A packed bitset with the number of bits before each of its words."""

    def __init__(self, words: np.ndarray):
        self.words = words
        count = np.bitwise_count(words).astype(np.int64)
        self.before = np.concatenate((np.zeros(1, np.int64), np.cumsum(count)))

    @classmethod
    def at(cls, places: np.ndarray, size: int) -> Bits:
        marks = np.zeros(-(-max(size, 1) // 64) * 64, bool)
        marks[places] = True
        return cls(np.packbits(marks, bitorder="little").view(U))

    def __and__(self, other: Bits) -> Bits:
        return Bits(self.words & other.words)

    def rank(self, places: np.ndarray) -> np.ndarray:
        """How many bits stand before each place."""
        below = (U(1) << (places & 63).astype(U)) - U(1)
        return self.before[places >> 6] + np.bitwise_count(self.words[places >> 6] & below)

    def select(self) -> np.ndarray:
        """The places of all bits in order."""
        return np.flatnonzero(np.unpackbits(self.words.view(np.uint8), bitorder="little"))


class Aligned:
    """A batch's tokens on both sides, their shared cuts and links.

    ``a``/``b`` are ids, ``a_first``/``b_first`` offsets of each text's tokens, ``a_cut``/``b_cut`` the
    first token of each group (and the end), ``group_first`` offsets of each text's groups, and
    ``lo``/``hi`` the first and last B token that each A token overlaps.
    """

    def __init__(self, column, a_path: str, b_path: str):
        code, a_words = byte_level(a_path)
        model, b_words = pieces(b_path)
        texts = [t or "" for t in column.to_pylist()]
        a = [np.array(code.encode_ordinary(" " + t), np.int64) if t else np.zeros(0, np.int64) for t in texts]
        b = [np.array(x, np.int64) for x in model.encode(texts, num_threads=1)] if texts else []
        # a text that either side doesn't spell has no tokens
        for k, t in enumerate(texts):
            whole = np.frombuffer(b" " + t.encode(), np.uint8) if t else np.zeros(0, np.uint8)
            if not t or not np.array_equal(a_words.spell(a[k]), whole) or not np.array_equal(b_words.spell(b[k]), whole):
                a[k] = b[k] = np.zeros(0, np.int64)
        first = lambda x: np.concatenate((np.zeros(1, np.int64), np.cumsum([len(y) for y in x], dtype=np.int64)))
        self.a_first, self.b_first = first(a), first(b)
        none = [np.zeros(0, np.int64)]
        self.a, self.b = np.concatenate(a or none), np.concatenate(b or none)
        a_end, b_end = np.cumsum(a_words.length[self.a]), np.cumsum(b_words.length[self.b])
        size = int(a_end[-1]) if len(a_end) else 0
        # a bit stands at the last byte of a token
        in_a, in_b = Bits.at(a_end - 1, size), Bits.at(b_end - 1, size)
        self.cuts = (in_a & in_b).select()
        zero = np.zeros(1, np.int64)
        self.a_cut = np.concatenate((zero, in_a.rank(self.cuts) + 1))
        self.b_cut = np.concatenate((zero, in_b.rank(self.cuts) + 1))
        self.group_first = np.searchsorted(self.a_cut, self.a_first)
        self.lo, self.hi = in_b.rank(a_end - a_words.length[self.a]), in_b.rank(a_end - 1)

    def links(self):
        """(A token, B token) of all links, in parts."""
        for k in range(0, len(self.a), LINKS):
            lo, n = self.lo[k : k + LINKS], (self.hi - self.lo)[k : k + LINKS] + 1
            ends = np.cumsum(n)
            yield np.repeat(np.arange(k, k + len(lo)), n), np.arange(ends[-1]) + np.repeat(lo - (ends - n), n)

    def written(self) -> list[str]:
        """Each text's groups as `a1,a2|b1;a3|b2,b3`."""
        g = len(self.cuts)
        of_a, of_b = np.repeat(np.arange(g), np.diff(self.a_cut)), np.repeat(np.arange(g), np.diff(self.b_cut))
        ids = np.empty(len(self.a) + len(self.b), np.int64)
        sign = np.zeros(len(ids), np.int64)  # what follows: 0 a comma, 1 a bar, 2 a semicolon
        at_a, at_b = np.arange(len(self.a)) + self.b_cut[of_a], np.arange(len(self.b)) + self.a_cut[of_b + 1]
        ids[at_a], ids[at_b] = self.a, self.b
        sign[at_a[self.a_cut[1:] - 1]], sign[at_b[self.b_cut[1:] - 1]] = 1, 2
        first = (self.a_first + self.b_first).tolist()
        number = _numbers(int(ids.max()).bit_length()) if len(ids) else []
        out = []
        for k, z in zip(first, first[1:], strict=False):
            out.append("".join([number[x] for x in (ids[k:z] * 3 + sign[k:z]).tolist()])[:-1])
        return out


@functools.lru_cache(2)
def _numbers(bits: int) -> list[str]:
    return [f"{k}{s}" for k in range(1 << bits) for s in ",|;"]


def groups(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """doc_id, group, byte_from, byte_to, a_ids, b_ids for every group of every row of docs(doc_id, text); bytes from the added space on."""
    a_path, b_path = a_path or vocabulary_path(), b_path or pieces_path()
    lasting_batches(docs.sparkSession)
    names = ["doc_id", "group", "byte_from", "byte_to", "a_ids", "b_ids"]

    def run(batches):
        for batch in batches:
            x = Aligned(batch.column(1), a_path, b_path)
            of = np.repeat(np.arange(batch.num_rows), np.diff(x.group_first))
            ends = x.cuts + 1
            starts = np.concatenate((np.zeros(1, np.int64), ends[:-1]))
            own = starts[np.minimum(x.group_first[:-1], max(0, len(starts) - 1))][of] if len(of) else ends
            lists = lambda ids, cut: pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), pa.array(np.arange(len(of)) - x.group_first[of]), pa.array(starts[: len(of)] - own), pa.array(ends - own), lists(x.a, x.a_cut), lists(x.b, x.b_cut)], names=names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidily(run), "doc_id long, group long, byte_from long, byte_to long, a_ids array<int>, b_ids array<int>")


DOC = "doc_id: long, n_a: long, n_b: long, n_groups: long, n_links: long, groups_sha256: string, pair: array<int>, times: array<int>"


def _blocks(docs: DataFrame, a_path: str, b_path: str, block_bytes: int) -> DataFrame:
    """Each block as small rows: one for each of its different pairs (its place ``at`` among them, and how many of the
    block's documents hold it), and one for each of its documents with the pairs' places and how often each is linked."""

    def pack(block, held):
        ids, numbers, digests, owner, pair, times, rows = [], [], [], [], [], [], 0
        for d, n, g, o, p, t in held:
            ids.append(d)
            numbers.append(n)
            digests += g
            owner.append(o + rows)
            pair.append(p)
            times.append(t)
            rows += len(g)
        owner, times = np.concatenate(owner), np.concatenate(times)
        known, at, held_by = np.unique(np.concatenate(pair), return_inverse=True, return_counts=True)
        cut = pa.array(np.searchsorted(owner, np.arange(rows + 1)), pa.int32())
        n = np.concatenate(numbers)
        doc = pa.StructArray.from_arrays(
            [pa.concat_arrays(ids), *[pa.array(n[:, k]) for k in range(4)], pa.array(digests, pa.string()), pa.ListArray.from_arrays(cut, pa.array(at, pa.int32())), pa.ListArray.from_arrays(cut, pa.array(times, pa.int32()))],
            names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pair", "times"],
        )
        names, same = ["block", "at", "pair", "holders", "doc"], lambda k: pa.array(np.full(k, block))
        yield pa.RecordBatch.from_arrays([same(len(known)), pa.array(np.arange(len(known)), pa.int32()), pa.array(known), pa.array(held_by, pa.int32()), pa.nulls(len(known), doc.type)], names=names)
        yield pa.RecordBatch.from_arrays([same(rows), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.int64()), pa.nulls(rows, pa.int32()), doc], names=names)

    def run(batches):
        held, size, block = [], 0, TaskContext.get().partitionId() << 33
        for batch in batches:
            x = Aligned(batch.column(1), a_path, b_path)
            digests = [hashlib.sha256(w.encode()).hexdigest() if w else "" for w in x.written()]
            text = np.repeat(np.arange(batch.num_rows), np.diff(x.a_first))
            n_links = np.bincount(text, weights=x.hi - x.lo + 1, minlength=batch.num_rows).astype(np.int64)
            found = []
            for i, j in x.links():  # a text's index and a pair's number side by side
                o, p = text[i], (x.a[i] << SHIFT) | x.b[j]
                order = np.lexsort((p, o))
                o, p = o[order], p[order]
                new = np.flatnonzero(np.concatenate((np.ones(1, bool), (o[1:] != o[:-1]) | (p[1:] != p[:-1]))))
                found.append((o[new], p[new], np.diff(np.append(new, len(o)))))
            o, p, t = (np.concatenate([f[k] for f in found] or [np.zeros(0, np.int64)]) for k in range(3))
            if len(found) > 1:  # a text whose links came in several parts
                order = np.lexsort((p, o))
                o, p, t = o[order], p[order], t[order]
                new = np.flatnonzero(np.concatenate((np.ones(1, bool), (o[1:] != o[:-1]) | (p[1:] != p[:-1]))))
                o, p, t = o[new], p[new], np.add.reduceat(t, new)
            numbers = np.stack([np.diff(x.a_first), np.diff(x.b_first), np.diff(x.group_first), n_links], axis=1)
            held.append((batch.column(0), numbers, digests, o, p, t))
            size += batch.nbytes
            if size >= block_bytes:
                yield from pack(block, held)
                held, size, block = [], 0, block + 1
        if held:
            yield from pack(block, held)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidily(run), f"block long, at int, pair long, holders int, doc struct<{DOC}>")


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for every row of docs(doc_id, text)."""
    spark = docs.sparkSession
    lasting_batches(spark)
    folder = shared_dir(spark)
    # written once, so that a block keeps its number; its rows are small, as a reader holds thousands of rows at a time
    blocks = materialise(_blocks(docs, a_path or vocabulary_path(), b_path or pieces_path(), block_bytes), "blocks", folder)
    pairs = blocks.where("pair is not null").select("block", "at", "pair", "holders")
    counts = materialise(pairs.groupBy("pair").agg(F.sum("holders").alias("n")), "counts", folder)
    highest = F.max("n").over(Window.partitionBy(F.shiftright("pair", SHIFT)))  # at most as many rows as B has ids
    counts = materialise(counts.withColumn("best", F.col("n") == highest), "best", folder)
    seen = pairs.select("block", "at", "pair").join(counts, "pair").select(F.col("block").alias("of_block"), "at", "n", "best")
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]

    def run(docs: pa.Table, counts: pa.Table) -> pa.Table:  # of one block
        at = counts["at"].to_numpy()
        n, best = np.zeros(len(at), np.int64), np.zeros(len(at), bool)
        n[at], best[at] = counts["n"].to_numpy(), counts["best"].to_numpy()
        pair, times = (docs[c].combine_chunks() for c in ("pair", "times"))
        first = np.concatenate((np.zeros(1, np.int64), np.cumsum(pair.value_lengths().to_numpy())))
        pair, times = pair.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
        total = lambda x: pa.array(np.diff(np.concatenate((np.zeros(1, np.int64), np.cumsum(x)))[first]))
        new = {"n_best": total(times * best[pair]), "count_sum": total(times * n[pair])}
        return pa.table([new[c] if c in new else docs[c] for c in names], names=names)

    kinds = ", ".join(f"{c} {'string' if c == 'groups_sha256' else 'long'}" for c in names)
    return blocks.where("doc is not null").select("block", "doc.*").groupBy("block").cogroup(seen.groupBy("of_block")).applyInArrow(run, kinds)
