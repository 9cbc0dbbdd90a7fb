"""MinHash near-duplicates with tensored banding (operator 6).

Two collections of ``SIDE`` half-keys each, every half-key from ``ROWS`` minhashes, give
``SIDE * SIDE`` tables: table (i, j) has the key (left half i, right half j). So 64 tables
of four minhashes cost 32 minhashes in place of 256. A pair of similarity s shares a table
unless all left halves or all right halves differ: with probability at most
``2 * (1 - s**ROWS) ** SIDE``, 7e-5 at s = 0.85 and 6e-4 at s = 0.80. Nothing else is left to
chance.

Exact copies (equal shingle sets) are first reduced to one representative. In every table
each member is compared with one center, the member that is least by a hash, so the center
most likely comes from the table's largest family. These stars settle a table whose members
they put into one component. In the others, members are compared with a center of their
table's own, so a member of a loose family meets many centers (``AGAIN`` rounds of that).

The members of tables that are still not settled are joined exactly, by prefixes: two sets
that are ``percent`` similar share a shingle among the first ``n - ceil(n * percent / 100) + 1``
of each, in any common order. The order puts rare shingles first, by counts of ``BUCKETS``
hashed shingles, so what a whole family has in common stands in few prefixes. That join tests
sizes, components, places in the prefix, and bitmaps (``WORDS`` numbers in which every shingle
turns a bit: as many bits differ as the sets have shingles of their own, or fewer), and
emits only pairs that pass; the tests are exact bounds and lose no pair. A shingle that is among the rarest
of very many sets of like size and different components costs a test for each two of
them; its rows can be split.

Every link is confirmed on the full shingle sets.

Cases: null or wordless text has an empty set, is linked with nothing and kept; a text of
one to four words has its whole sequence as its one shingle; rows that share a doc_id are
one document, which has the links of all of them; a null doc_id is linked with nothing, has a
null component and is kept; ties take the smallest doc_id; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, quoted, remove, shared_dir, tidily
from .graph import components
from .vecwords import FOLD, SPACE, U, Words, buffer, grams, mix

SHINGLE, SIDE, ROWS = 5, 8, 2
BUCKETS, PARTS = 1 << 18, 256  # hashed shingles that are counted; parts in which the counts are added up, 8 KB a task each
AGAIN = 1  # rounds with centers of a table's own
WORDS = 8  # 64-bit numbers of a bitmap
N_HASH = 2 * SIDE * ROWS
_rng = np.random.default_rng(20240607)
MULTIPLIERS = _rng.integers(1, 2**63, N_HASH, dtype=np.uint64) * U(2) + U(1)
ADDENDS = _rng.integers(1, 2**63, N_HASH, dtype=np.uint64)


def shingle_sets(column) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, in one array with offsets."""
    raw, offsets = buffer(column)
    words = Words(FOLD[raw], offsets, SPACE)
    g, _, first = grams(words.hash, words.first, SHINGLE)
    out = []
    for k, n in enumerate(np.diff(words.first)):
        if n >= SHINGLE:
            out.append(np.unique(g[first[k] : first[k + 1]]))
        elif n:
            out.append(grams(words.hash[words.first[k] : words.first[k + 1]], np.array([0, n]), int(n))[0] ^ U(n))
        else:
            out.append(np.zeros(0, U))
    return (np.concatenate(out) if out else np.zeros(0, U)), np.concatenate((np.zeros(1, np.int64), np.cumsum([len(x) for x in out], dtype=np.int64)))


def signature_batch(column) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Set sizes, two digests of each set, and its minhashes (a row of N_HASH each)."""
    s, offsets = shingle_sets(column)
    n = np.diff(offsets)
    full = n > 0
    at = offsets[:-1][full]
    d1, d2, low = np.zeros(len(n), U), np.zeros(len(n), U), np.zeros((len(n), N_HASH), U)
    if len(at):
        d1[full] = np.add.reduceat(mix(s ^ U(0x1234567)), at)
        d2[full] = np.add.reduceat(mix(s + U(0x89ABCDEF)), at)
        t = np.empty_like(s)
        for k in range(N_HASH):
            np.multiply(s, MULTIPLIERS[k], out=t)
            t += ADDENDS[k]
            low[full, k] = np.minimum.reduceat(t, at)
    return n, d1, d2, low


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, th (which text), n_shingles, digests d1 and d2, and half-keys of docs(doc_id, th, text)."""
    def run(batches):
        for b in batches:
            n, d1, d2, low = signature_batch(b.column(2))
            half = np.zeros((len(n), 2 * SIDE), U)
            for k in range(2 * SIDE):
                for j in range(ROWS):
                    half[:, k] = mix(half[:, k] ^ low[:, k * ROWS + j] + U(k + 1))
            offsets = np.arange(0, len(n) * 2 * SIDE + 1, 2 * SIDE, dtype=np.int32)
            keys = pa.ListArray.from_arrays(offsets, pa.array(half.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), keys], names=["doc_id", "th", "n_shingles", "d1", "d2", "halves"])

    return docs.select("doc_id", "th", "text").mapInArrow(tidily(run), "doc_id long, th long, n_shingles long, d1 long, d2 long, halves array<long>")


def compare(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Links (u, v), the documents' ids, of those pairs (hu, hv) whose full sets are so similar; texts(h, id, n, text)."""
    near = F.expr(f"100 * least(nu, nv) >= {percent} * greatest(nu, nv)")
    side = lambda s: texts.select(F.col("h").alias(f"h{s}"), F.col("id").alias(s), F.col("n").alias(f"n{s}"), F.col("text").alias(f"t{s}"))

    def run(batches):
        for b in batches:
            a, fa = shingle_sets(b.column(2))
            c, fc = shingle_sets(b.column(3))
            ok = np.zeros(b.num_rows, bool)
            for k in range(b.num_rows):
                x, y = a[fa[k] : fa[k + 1]], c[fc[k] : fc[k + 1]]
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok[k] = both > 0 and 100 * both >= percent * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays(b.columns[:2], names=["u", "v"]).filter(pa.array(ok))

    return pairs.join(side("u"), "hu").join(side("v"), "hv").where(near).select("u", "v", "tu", "tv").mapInArrow(tidily(run), "u long, v long")


def bucket(shingles: np.ndarray) -> np.ndarray:
    return (mix(shingles ^ U(0x5DEECE66D)) >> U(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def shingle_counts(texts: DataFrame) -> np.ndarray:
    """How many sets of texts(text) hold a shingle of each bucket: BUCKETS numbers, whatever the size."""
    part = BUCKETS // PARTS

    def run(batches):
        total = np.zeros(BUCKETS, np.int64)
        for b in batches:
            np.add.at(total, bucket(shingle_sets(b.column(0))[0]), 1)
        yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array([total[k : k + part].tobytes() for k in range(0, BUCKETS, part)], pa.binary())], names=["part", "n"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": [pdf["part"].iloc[0]], "n": [sum(np.frombuffer(x, np.int64) for x in pdf["n"]).tobytes()]})

    out = np.zeros(BUCKETS, np.int64)
    for r in texts.select("text").mapInArrow(tidily(run), "part int, n binary").groupBy("part").applyInPandas(add, "part int, n binary").collect():
        out[r["part"] * part : (r["part"] + 1) * part] = np.frombuffer(r["n"], np.int64)
    return out


def bitmaps(s: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """For each of n sets WORDS numbers: a bit is on if an odd number of shingles falls on it."""
    spot = (mix(s + U(0x632BE59BD9B4E019)) >> U(64 - (64 * WORDS).bit_length() + 1)).astype(np.int64)
    odd = (np.bincount(owner * (64 * WORDS) + spot, minlength=n * 64 * WORDS) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view("<i8").reshape(n, WORDS)


def prefixes(texts: DataFrame, counts: np.ndarray, percent: int) -> DataFrame:
    """(shingle, at, h, comp, n, b0...): the rarest shingles of each set of texts(h, comp, text), as many as a
    similar set must share one of, with their place in the common order, and the set's bitmap."""
    names = ["shingle", "at", "h", "comp", "n", *[f"b{k}" for k in range(WORDS)]]

    def run(batches):
        for b in batches:
            s, offsets = shingle_sets(b.column(2))
            n = np.diff(offsets)
            owner = np.repeat(np.arange(len(n)), n)
            bits = bitmaps(s, owner, len(n))
            order = np.lexsort((s, counts[bucket(s)], owner))
            at = np.arange(len(s)) - offsets[owner]
            ok = at < (n - -(-n * percent // 100) + 1)[owner]
            s, at, owner = s[order][ok], at[ok], owner[ok]
            yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64)), pa.array(at), b.column(0).take(pa.array(owner)), b.column(1).take(pa.array(owner)), pa.array(n[owner]), *[pa.array(bits[owner, k]) for k in range(WORDS)]], names=names)

    return texts.select("h", "comp", "text").mapInArrow(tidily(run), ", ".join(f"{x} long" for x in names))


def prefix_pairs(texts: DataFrame, percent: int, keep) -> DataFrame:
    """Pairs (hu, hv) of texts(h, comp, text) of different components that can be similar; none that is gets lost."""
    rare = keep(prefixes(texts, shingle_counts(texts), percent), "prefixes")
    several = keep(rare.groupBy("shingle").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a < b").select("shingle"), "several")
    rare = keep(rare.join(several, "shingle", "left_semi"), "rare")
    side = lambda x: rare.select("shingle", *[F.col(c).alias(c + x) for c in rare.columns[1:]])
    # of nu + nv shingles so many must be common; at most what is left from the first common one on, and at most what differing bits leave
    needed = f"{percent} * (nu + nv)"
    rest = f"(100 + {percent}) * least(nu - atu, nv - atv) >= {needed}"
    differ = " + ".join(f"bit_count(b{k}u ^ b{k}v)" for k in range(WORDS))
    bits = f"(100 + {percent}) * (nu + nv - ({differ})) >= 2 * {needed}"
    test = F.expr(f"hu < hv and compu <> compv and 100 * least(nu, nv) >= {percent} * greatest(nu, nv) and {rest} and {bits}")
    return side("u").join(side("v"), "shingle").where(test).select("hu", "hv").distinct()


def unsettled(held: DataFrame, wanted: DataFrame, found: DataFrame, keep, name: str) -> DataFrame:
    """(key, h, comp) of tables whose members lie in several components."""
    comp = keep(wanted.join(found, F.col("id") == F.col("node"), "left").select("h", F.coalesce("component", "id").alias("comp")), f"comps{name}")
    tagged = keep(held.select("key", "h").join(comp, "h"), f"tagged{name}")
    mixed = keep(tagged.groupBy("key").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a < b").select("key"), f"mixed{name}")
    return keep(tagged.join(mixed, "key", "left_semi"), f"open{name}")


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs(doc_id, text); links are
    pairs with 100 * intersection >= percent * union."""
    spark = docs.sparkSession
    folder, last = shared_dir(spark), shared_dir(spark)
    keep = lambda df, name: materialise(df, name, folder)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("th", F.xxhash64("text"))
    sig = materialise(signatures(docs), "signatures", last)
    able = sig.where("n_shingles > 0 and doc_id is not null")
    # aggregates are written before they are joined: then both sides are dealt out for the join
    # alone, and the rows of a hot key (very many copies, a very common table) can be split
    rep = F.min(F.struct("doc_id", "th")).alias("rep")
    classes = able.groupBy("d1", "d2").agg(rep, F.first("n_shingles").alias("n"), F.first("halves").alias("halves"))
    classes = keep(classes.select("d1", "d2", F.xxhash64("d1", "d2").alias("h"), F.col("rep.doc_id").alias("id"), F.col("rep.th").alias("th"), "n", "halves"), "classes")
    member = materialise(able.join(classes.select("d1", "d2", F.col("id").alias("rep")), ["d1", "d2"]).select("doc_id", "n_shingles", "rep"), "members", last)
    several = keep(member.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a < b").select("doc_id"), "several-texts")
    same = member.join(several, "doc_id").select(F.col("doc_id").alias("u"), F.col("rep").alias("v")).where("u <> v").distinct()

    half = lambda k: F.slice("halves", 1 + k * SIDE, SIDE)
    tables = F.flatten(F.transform(half(0), lambda a, i: F.transform(half(1), lambda b, j: F.xxhash64(a, b, i, j))))
    keys = classes.select("h", F.explode(tables).alias("key"))
    shared = keys.groupBy("key").agg(F.min("h").alias("center"), F.max("h").alias("last")).where("center < last").select("key", "center")
    held = keep(keys.join(keep(shared, "shared"), "key"), "tables")  # rows of all tables with two members or more
    wanted = keep(classes.join(held.select("h").distinct(), "h", "left_semi").select("h", "id", F.col("th").alias("which"), "n"), "wanted")
    texts = keep(docs.join(wanted.hint("merge"), (F.col("doc_id") == F.col("id")) & (F.col("th") == F.col("which"))).select("h", "id", "n", "text"), "texts")
    if texts.count() != wanted.count():  # repeated rows
        texts = keep(texts.dropDuplicates(["h", "id"]), "texts-once")

    star = held.where("h <> center").select(F.col("h").alias("hu"), F.col("center").alias("hv")).distinct()
    found = components(compare(star, texts, percent).unionByName(same))
    grown = lambda pairs: components(found.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(compare(pairs, texts, percent)))

    for k in range(AGAIN):
        rows = unsettled(held, wanted, found, keep, f"-{k}")
        center = F.min(F.struct(F.xxhash64("h", "key", F.lit(k)).alias("by"), F.col("h").alias("hv"), F.col("comp").alias("compv"))).alias("c")
        centers = keep(rows.groupBy("key").agg(center).select("key", "c.hv", "c.compv"), f"centers-{k}")
        star = rows.join(centers, "key").where("comp <> compv").select(F.least("h", "hv").alias("hu"), F.greatest("h", "hv").alias("hv")).distinct()
        found = grown(star)
    left = keep(unsettled(held, wanted, found, keep, "").select("h", "comp").distinct(), "left")
    pairs = keep(prefix_pairs(texts.join(left.hint("merge"), "h"), percent, keep), "pairs")
    found = grown(pairs)
    remove(spark, folder)

    named = member.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    alone = sig.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return named.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, percent: int = 80) -> DataFrame:
    """docs without the documents whose group keeps another one."""
    gone = near_duplicates(docs, percent).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*[quoted(c) for c in docs.columns])
