"""Line dedup by content-defined chunks of lines (operator 8).

A line ends at a newline or after a sentence's end that a space follows; one of more than
``FOLD`` words is folded after every word whose hash is the least of ``FOLD_WINDOW`` words in a row,
so that a passage without line ends has lines of its own wherever it stands. A rolling hash is
taken over each two neighbouring lines. Boundaries are the rolling hashes that are the least of
``WINDOW`` in a row, so a boundary depends on a few lines around it only, inserted lines shift
nothing further on, and a passage of some 50 words shares two boundaries or more with its
other places. A chunk reaches from one boundary to the next, both lines of either included (at
least two lines, in all but a text's ends three), and on to ``min_words`` words.

A text that stands whole in a document of smaller doc_id goes from its first word to its last, if its
bytes are the same; of the others, chunks whose hash stands in several documents, or again in one, are removed if their bytes
equal those of the first occurrence, which stays unless another chunk of it goes; first is
the smallest doc_id, then the position. A second step takes what chunk edges miss: where a
chunk goes and its neighbour doesn't, the words beside it go as far as they are those beside the
first occurrence, byte by byte, up to ``CONTEXT`` words (more than lie between a passage's end and
its first boundary). So whatever is cut stands at an earlier place.

Cases: null and empty text have no line and pass unchanged; passages with fewer than
``min_words`` words never go; rows that share a doc_id (all null ones too) are one document,
and none of them loses a chunk to another; a chunk's hash that another chunk has by chance
fails the comparison and stays; of a passage that repeats itself without a break, the first
stays; empty tables give empty results; input columns keep their names, and the counts take a
trailing ``_`` where theirs (compared without case) is taken.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, fresh, lasting_batches, materialise, quoted, shared_dir, tidily
from .vecwords import SPACE, U, Words, buffer, mix

MIN_WORDS, FOLD, FOLD_WINDOW, WINDOW, CONTEXT = 10, 4, 4, 6, 48
WHOLE = -1  # in place of a chunk's number: the text
SLICE = 1 << 12  # chunks whose bytes are taken at a time
STOP = np.zeros(256, bool)
STOP[list(b".!?")] = True


def cut(raw: np.ndarray, offsets: np.ndarray):
    """Lines of a batch: where each starts and ends, and its text's index."""
    if not len(raw):
        e = np.zeros(0, np.int64)
        return e, e, e
    ends = raw == 0x0A
    ends[:-1] |= STOP[raw[:-1]] & (raw[1:] == 0x20)
    filled = np.diff(offsets) > 0
    ends[offsets[1:][filled] - 1] = True
    end = np.flatnonzero(ends) + 1
    start = np.concatenate((np.zeros(1, np.int64), end[:-1]))
    return start, end, np.searchsorted(offsets, start, "right") - 1


def least_of(h: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    """Marks of the hashes that are the least of n in a row of their group; of equal ones the last."""
    out = np.zeros(len(h), bool)
    m = len(h) - n + 1
    if m > 0:
        at = np.full(m, n - 1, np.int8)
        low = h[n - 1 :].copy()
        for k in reversed(range(n - 1)):
            np.putmask(at, h[k : k + m] < low, k)
            np.minimum(low, h[k : k + m], out=low)
        start = np.flatnonzero(group[:m] == group[n - 1 :])
        out[start + at[start]] = True
    return out


class Chunks:
    """Chunks of a batch: ``owner`` (text's index), ``key`` (hash), ``first`` and ``last`` word, ``x`` and ``y``
    (bytes from the first word to the last); and of every word the bytes ``lo`` to ``hi`` that go with it
    (blanks up to the next word or the line's ends included)."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, min_words: int = MIN_WORDS):
        lines, line_ends, texts = cut(raw, offsets)
        self.raw, self.words = raw, Words(raw, offsets, SPACE)
        words, n = self.words, len(self.words.start)
        none = np.zeros(0, np.int64)
        self.owner = self.first = self.last = self.x = self.y = self.lo = self.hi = none
        self.key = np.zeros(0, U)
        if not n:
            return
        line = np.searchsorted(lines, words.start, "right") - 1
        text = texts[line]
        opens = np.concatenate((np.ones(1, bool), line[1:] != line[:-1]))
        closes = np.concatenate((opens[1:], np.ones(1, bool)))
        self.lo = np.where(opens, lines[line], words.start)
        self.hi = np.where(closes, line_ends[line], np.concatenate((words.start[1:], np.zeros(1, np.int64))))

        # long lines are folded
        long = (np.diff(np.append(np.flatnonzero(opens), n)) > FOLD)[np.cumsum(opens) - 1]
        stops = np.flatnonzero(closes | (long & least_of(words.hash, line, FOLD_WINDOW)))
        a, z = np.concatenate((np.zeros(1, np.int64), stops[:-1] + 1)), stops + 1
        of = text[a]
        # the rolling hash of a line and the one before it
        h = words.span(words.start[a], words.end[stops])
        before = np.concatenate((np.zeros(1, U), h[:-1]))
        roll = mix(before * U(0x9E3779B97F4A7C15) + h)
        head = np.concatenate((np.ones(1, bool), of[1:] != of[:-1]))
        pair = np.flatnonzero(~head)
        bound = pair[least_of(roll[pair], of[pair], WINDOW)]
        # from a boundary's first line to the next one's second
        ends = np.flatnonzero(np.append(head[1:], True))
        start = np.concatenate((np.flatnonzero(head), bound - 1))
        stop = np.concatenate((bound, ends))
        # a text's chunks start with its first line or a boundary, and there are as many ends
        order, stop = np.lexsort((start, of[start])), np.sort(stop)
        start = start[order]
        wide = np.searchsorted(z, a[start] + min_words, "left")
        stop = np.maximum(stop, wide)
        ok = stop < len(z)
        ok[ok] &= of[stop[ok]] == of[start[ok]]
        start, stop = start[ok], stop[ok]
        # a text's first line may open its first boundary too
        new = np.ones(len(start), bool)
        new[1:] = (start[1:] != start[:-1]) | (stop[1:] != stop[:-1])
        start, stop = start[new], stop[new]
        self.owner, self.first, self.last = of[start], a[start], z[stop] - 1
        self.x, self.y = words.start[self.first], words.end[self.last]
        self.key = words.span(self.x, self.y)

    def __len__(self) -> int:
        return len(self.owner)

    def before(self, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes from the words before chunks, CONTEXT at most, to the chunk."""
        j = np.maximum(self.words.first[self.owner[k]], self.first[k] - CONTEXT)
        return self.words.start[j], self.x[k]

    def after(self, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes from chunks to the words after them, CONTEXT at most."""
        j = np.minimum(self.words.first[self.owner[k] + 1] - 1, self.last[k] + CONTEXT)
        return self.y[k], self.words.end[j]

    def reach_left(self, k: np.ndarray, other: np.ndarray, a: np.ndarray, z: np.ndarray) -> np.ndarray:
        """The first word of those before chunks that are the last words of other[a:z]."""
        lo, hi = self.before(k)
        n = np.minimum(hi - lo, z - a)
        same = n - last_difference(self.raw, hi - n, other, z - n, n)
        j = np.searchsorted(self.words.start, hi - same)
        # a word that is only the end of the other's word doesn't count
        part = (self.words.start[np.minimum(j, len(self.words.start) - 1)] == hi - same) & (z - same > a)
        part[part] &= ~SPACE[other[(z - same - 1)[part]]]
        return np.minimum(j + part, self.first[k])

    def reach_right(self, k: np.ndarray, other: np.ndarray, a: np.ndarray, z: np.ndarray) -> np.ndarray:
        """The last word of those after chunks that are the first words of other[a:z]."""
        lo, hi = self.after(k)
        n = np.minimum(hi - lo, z - a)
        same = first_difference(self.raw, lo, other, a, n)
        j = np.searchsorted(self.words.end, lo + same, "right") - 1
        part = (self.words.end[j] == lo + same) & (a + same < z)
        part[part] &= ~SPACE[other[(a + same)[part]]]
        return np.maximum(j - part, self.last[k])


def differences(raw: np.ndarray, a: np.ndarray, other: np.ndarray, b: np.ndarray, n: np.ndarray):
    """(range, place in it) of the bytes in which raw[a:a+n] and other[b:b+n] differ, range by range."""
    for k in range(0, len(a), SLICE):
        some = slice(k, k + SLICE)
        mine, offsets = gather(raw, a[some], (a + n)[some])
        theirs, _ = gather(other, b[some], (b + n)[some])
        at = np.flatnonzero(mine != theirs)
        of = np.searchsorted(offsets, at, "right") - 1
        yield of + k, at - offsets[of]


def first_difference(raw, a, other, b, n) -> np.ndarray:
    """How many bytes agree from the left."""
    out = n.copy()
    for of, at in differences(raw, a, other, b, n):
        out[of[::-1]] = at[::-1]
    return out


def last_difference(raw, a, other, b, n) -> np.ndarray:
    """After how many bytes the last one that differs stands."""
    out = np.zeros(len(n), np.int64)
    for of, at in differences(raw, a, other, b, n):
        out[of] = at + 1
    return out


def numbers(owner: np.ndarray, n: int) -> np.ndarray:
    """Where each text's chunks begin; owner is sorted."""
    return np.searchsorted(owner, np.arange(n))


def gather(raw: np.ndarray, a: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of ranges one after the other, and their offsets."""
    offsets = np.concatenate((np.zeros(1, np.int64), np.cumsum(z - a)))
    out = np.empty(offsets[-1], np.uint8)
    for k in range(0, len(a), SLICE):  # an index takes eight bytes a byte
        lo, hi = offsets[k], offsets[min(k + SLICE, len(a))]
        out[lo:hi] = raw[np.arange(lo, hi) + np.repeat(a[k : k + SLICE] - offsets[k : min(k + SLICE, len(a))], (z - a)[k : k + SLICE])]
    return out, offsets


def same_bytes(raw: np.ndarray, a: np.ndarray, z: np.ndarray, other: np.ndarray, b: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether raw[a:z] and other[b:y] are equal, range by range."""
    out = (z - a) == (y - b)
    at = np.flatnonzero(out)
    for k in range(0, len(at), SLICE):
        some = at[k : k + SLICE]
        mine, offsets = gather(raw, a[some], z[some])
        theirs, _ = gather(other, b[some], y[some])
        differ = np.concatenate((np.zeros(1, np.int64), np.cumsum(mine != theirs)))
        out[some] = differ[offsets[1:]] == differ[offsets[:-1]]
    return out


def binaries(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())]).cast(pa.binary())


def repeats(owner: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(chunks whose hash an earlier one of the same text has, that earlier one: the first)."""
    order = np.lexsort((np.arange(len(key)), key, owner))
    new = np.ones(len(key), bool)
    new[1:] = (owner[order][1:] != owner[order][:-1]) | (key[order][1:] != key[order][:-1])
    first = order[np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))]
    again = ~new
    return order[again], first[again]


def removed(texts, cuts, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Byte ranges (from, to) that go from texts. cuts: by text, chunks' numbers with the bytes of the first
    occurrence, and of what is before and after it where the neighbour isn't among them."""
    raw, offsets = buffer(texts)
    c = Chunks(raw, offsets, min_words)
    n = len(texts)
    # chunks that the first occurrence elsewhere has
    of = np.repeat(np.arange(n), np.diff(cuts.offsets.to_numpy()))
    given = cuts.flatten()
    number = given.field(0).to_numpy(zero_copy_only=False)
    theirs, ends = buffer(given.field(1))
    # texts that an earlier document is
    text = of[(number == WHOLE) & same_bytes(raw, offsets[of], offsets[of + 1], theirs, ends[:-1], np.where(number == WHOLE, ends[1:], ends[:-1]))]
    lo, hi = [c.lo[c.words.first[text]]], [c.hi[c.words.first[text + 1] - 1]]
    at = np.flatnonzero(number != WHOLE)
    of, given = of[at], given.take(pa.array(at))
    k = numbers(c.owner, n)[of] + number[at]
    ok = same_bytes(raw, c.x[k], c.y[k], theirs, ends[at], ends[at + 1])
    gone = np.zeros(len(c), bool)
    gone[k[ok]] = True
    # chunks that stand earlier in the same text
    again, first = repeats(c.owner, c.key)
    same = same_bytes(raw, c.x[again], c.y[again], raw, c.x[first], c.y[first])
    again, first = again[same], first[same]
    gone[again] = True
    lo.append(c.lo[c.first[gone]])
    hi.append(c.hi[c.last[gone]])
    # what is beside them
    for name, low in ((2, True), (3, False)):
        side = given.field(name)
        at = np.flatnonzero(side.is_valid().to_numpy(zero_copy_only=False) & ok)
        other, ends = buffer(side)
        if low:
            lo.append(c.lo[c.reach_left(k[at], other, ends[at], ends[at + 1])])
            hi.append(c.hi[c.first[k[at]]])
        else:
            lo.append(c.lo[c.last[k[at]]])
            hi.append(c.hi[c.reach_right(k[at], other, ends[at], ends[at + 1])])
    left, right = (np.append(gone, False)[again + step] & (np.append(c.owner, -1)[again + step] == c.owner[again]) for step in (-1, 1))
    lo.append(c.lo[c.reach_left(again[~left], raw, *c.before(first[~left]))])
    hi.append(c.hi[c.first[again[~left]]])
    lo.append(c.lo[c.last[again[~right]]])
    hi.append(c.hi[c.reach_right(again[~right], raw, *c.after(first[~right]))])
    return np.concatenate(lo), np.concatenate(hi)


def unglue(raw: np.ndarray, offsets: np.ndarray, out: np.ndarray) -> None:
    """Takes back the blank that a cut starts with, where the words on both sides of the cut would become one."""
    if not out.any():
        return
    opens = np.zeros(len(raw) + 1, bool)
    opens[offsets] = True
    more = np.concatenate((np.zeros(1, bool), out, np.zeros(1, bool)))
    start = np.flatnonzero(more[1:-1] & (~more[:-2] | opens[:-1]))
    end = np.flatnonzero(more[1:-1] & (~more[2:] | opens[1:])) + 1
    ok = ~opens[start] & ~opens[end]
    start, end = start[ok], end[ok]
    out[start[SPACE[raw[start]] & ~SPACE[raw[start - 1]] & ~SPACE[raw[end]]]] = False


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs(doc_id, text, ...) with repeated chunks cut from text, the number of lines, and of lines cut in whole or part."""
    names = fresh(docs.columns, "n_lines", "n_cut")
    return _cut(docs, min_words, names["n_lines"], names["n_cut"])


def keep_filled(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with repeated chunks cut from text, without the documents of which no word is left."""
    names = fresh(docs.columns, "n_lines", "n_cut")
    out = _cut(docs, min_words, names["n_lines"], names["n_cut"])
    left = out.where((quoted(names["n_cut"]) == 0) | F.rlike("text", F.lit(r"[^\x20\x09-\x0D]")))
    return left.select(*[quoted(c) for c in docs.columns])


def _cut(docs: DataFrame, min_words: int, n_lines: str, n_cut: str) -> DataFrame:
    """Small rows (hash, document, number) find what is repeated; texts are shuffled twice, once to
    fetch the first occurrences' bytes and once to compare and cut."""
    spark = docs.sparkSession
    lasting_batches(spark)
    names = docs.columns
    id_ = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    keyed = docs.select(F.struct(*[quoted(c) for c in names]).alias("row"), id_.alias("k1"), F.xxhash64(F.col("text")).alias("k2"))

    def emit(batches):
        for b in batches:
            c = Chunks(*buffer(b.column(2)), min_words)
            _, once = np.unique(c.key ^ mix(c.owner.astype(U)), return_index=True)
            once.sort()
            owner = c.owner[once]
            at = once - numbers(c.owner, b.num_rows)[owner]
            cut = pa.array(np.searchsorted(owner, np.arange(b.num_rows + 1)), pa.int32())
            twice = np.bincount(c.owner, minlength=b.num_rows) > np.diff(cut.to_numpy())
            lists = lambda x: pa.ListArray.from_arrays(cut, pa.array(x))  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists(c.key[once].view(np.int64)), lists(at.astype(np.int32)), pa.array(twice)], names=["k1", "k2", "hashes", "numbers", "twice"])

    folder, half = shared_dir(spark), shared_dir(spark)
    texts = keyed.select("k1", "k2", F.col("row.text").alias("text"))
    own = materialise(texts.mapInArrow(tidily(emit), "k1 long, k2 long, hashes array<long>, numbers array<int>, twice boolean").where("size(hashes) > 0"), "chunks", folder)
    # texts that stand whole in an earlier document give one row each from here on
    heads = own.groupBy("k2").agg(F.min("k1").alias("head"), F.max("k1").alias("tail")).where("head < tail").select("k2", "head")
    heads = materialise(heads, "heads", half)
    own = materialise(own.join(heads, "k2", "left").withColumn("copy", F.coalesce(F.col("k1") > F.col("head"), F.lit(False))), "flagged", folder)
    copies = materialise(own.where("copy").select("k1", "k2").distinct(), "copies")
    inside = materialise(own.where("twice and not copy").select("k1", "k2").distinct(), "inside")
    rows = own.where("not copy").select("k1", "k2", F.explode(F.arrays_zip("hashes", "numbers")).alias("c")).select("k1", "k2", F.col("c.hashes").alias("hash"), F.col("c.numbers").alias("number"))
    repeated = rows.groupBy("hash").agg(F.min("k1").alias("first"), F.max("k1").alias("last")).where("first < last").select("hash", "first")
    # written first, so that a very common chunk's rows can be split in the join; the hashes are a small part of the rows
    found = materialise(rows.join(materialise(repeated, "hashes", folder).hint("shuffle_hash"), "hash"), "found", half)
    del own, rows, repeated
    discard(spark, folder)
    # chunks whose neighbour stays
    beside = Window.partitionBy("k1", "k2").orderBy("number")
    later = found.where("k1 > first").select("hash", "k1", "k2", "number").distinct()
    later = later.withColumns({"left": F.coalesce(F.lag("number").over(beside) != F.col("number") - 1, F.lit(True)), "right": F.coalesce(F.lead("number").over(beside) != F.col("number") + 1, F.lit(True))})
    later = materialise(later, "later", folder)

    # bytes of the first occurrences, and of what is beside them where that is asked for
    firsts = found.where("k1 = first").groupBy("hash").agg(F.min(F.struct("k1", "k2", "number")).alias("f")).select("hash", "f.*")
    asked = later.groupBy("hash").agg(F.max("left").alias("left"), F.max("right").alias("right")).join(firsts, "hash")
    asked = asked.select("k1", "k2", "number", "left", "right").unionByName(heads.select(F.col("head").alias("k1"), "k2", F.lit(WHOLE).alias("number"), F.lit(False).alias("left"), F.lit(False).alias("right")))
    asked = asked.groupBy("k1", "k2").agg(F.collect_list(F.struct("number", "left", "right")).alias("asked"))

    def fetch(batches):
        names = ["hash", "whole", "bytes", "before", "after"]
        for b in batches:
            raw, offsets = buffer(b.column(0))
            c = Chunks(raw, offsets, min_words)
            asked = b.column(2)
            of = np.repeat(np.arange(b.num_rows), np.diff(asked.offsets.to_numpy()))
            given = asked.flatten()
            at, left, right = (given.field(k).to_numpy(zero_copy_only=False) for k in range(3))
            part = at != WHOLE
            k = numbers(c.owner, b.num_rows)[of[part]] + at[part]
            side = lambda want, a, z: binaries(*gather(raw, a, np.where(want, z, a)))  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([pa.array(c.key[k].view(np.int64)), pa.array(np.zeros(len(k), bool)), binaries(*gather(raw, c.x[k], c.y[k])), side(left[part], *c.before(k)), side(right[part], *c.after(k))], names=names)
            of = of[~part]
            none = pa.nulls(len(of), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(1).take(pa.array(of)), pa.array(np.ones(len(of), bool)), binaries(*gather(raw, offsets[of], offsets[of + 1])), none, none], names=names)

    # written, so that only one shuffle of the texts is on disk at a time; rows of one id and text give the same once
    kept = materialise(texts.join(asked, ["k1", "k2"]).select("text", "k2", "asked").mapInArrow(tidily(fetch), "hash long, whole boolean, bytes binary, before binary, after binary").distinct(), "firsts")
    del found, firsts, asked, heads
    discard(spark, half)
    given = later.join(kept.where("not whole"), "hash").select("k1", "k2", F.struct("number", "bytes", F.when(F.col("left"), F.col("before")).alias("before"), F.when(F.col("right"), F.col("after")).alias("after")).alias("cut"))
    none = F.lit(None).cast("binary")
    whole = copies.join(kept.where("whole").select(F.col("hash").alias("k2"), "bytes"), "k2").select("k1", "k2", F.struct(F.lit(WHOLE).alias("number"), "bytes", none.alias("before"), none.alias("after")).alias("cut"))
    # a list, empty if all that goes stands earlier in the text itself
    lists = given.unionByName(whole).unionByName(inside, allowMissingColumns=True).groupBy("k1", "k2").agg(F.collect_list("cut").alias("cuts"))

    full = [f for f in docs.schema.fields]
    text_at = names.index("text")
    schema = T.StructType([*full, T.StructField(n_lines, T.LongType()), T.StructField(n_cut, T.LongType())])

    def cut_batch(batches):
        for b in batches:
            row = b.column(0)
            fields = [row.field(k) for k in range(len(full))]
            text = fields[text_at]
            raw, offsets = buffer(text)
            edge = np.zeros(len(raw) + 1, np.int64)
            cuts = b.column(1)
            some = np.flatnonzero(cuts.is_valid().to_numpy(zero_copy_only=False))
            if len(some):
                lo, hi = removed(text.take(pa.array(some)), cuts.take(pa.array(some)), min_words)
                # places in the texts that something is cut from, as places in the batch
                base = np.concatenate((np.zeros(1, np.int64), np.cumsum(np.diff(offsets)[some])))
                of = np.searchsorted(base, lo, "right") - 1
                shift = offsets[some[of]] - base[of]
                np.add.at(edge, lo + shift, 1)
                np.add.at(edge, hi + shift, -1)
            out = np.cumsum(edge[:-1]) > 0
            unglue(raw, offsets, out)
            before = np.concatenate((np.zeros(1, np.int64), np.cumsum(out)))
            start, end, line_of = cut(raw, offsets)
            lines = np.bincount(line_of, minlength=b.num_rows)
            dropped = np.bincount(line_of[before[end] > before[start]], minlength=b.num_rows) if len(start) else lines
            left = binaries(raw[~out], offsets - before[offsets]).cast(pa.string())
            fields[text_at] = pc.if_else(text.is_valid(), left.cast(text.type), pa.scalar(None, text.type))
            yield pa.RecordBatch.from_arrays([*fields, pa.array(lines.astype(np.int64)), pa.array(dropped.astype(np.int64))], names=[*names, n_lines, n_cut])

    return keyed.join(lists, ["k1", "k2"], "left").select("row", "cuts").mapInArrow(tidily(cut_batch), schema)


def digest(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, n_lines, n_cut, and length and checksum of what is left, for every row."""
    out = dedup_lines(docs.select("doc_id", "text"), min_words)
    return out.select("doc_id", "n_lines", "n_cut", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("kept_chars"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("kept_crc32"))
