"""WARC archives, and their index by an external merge (operator 1).

Writing: each task writes one archive of gzip members, a record each, into the shared
folder. Equal payloads are stored once: the capture with the smallest page_id is a
``response`` record, the others are ``revisit`` records that name it and carry no payload.
Reading: archives are read member by member, every payload's digest is checked, and each
archive gives a run of index entries, sorted by URL key and time.

Index merge: runs are dealt out by key ranges (of URL key, time and page_id, so that one
URL with very many captures is spread over several ranges); in a range the slices of all
runs meet, still sorted, and a loser tree merges them. Ranges in order, and positions in a
range, give the captures' global order.

Cases: null html is an empty payload; null URLs share the empty key; a null page_id comes
last and revisits if any equal payload has an id; repeated rows with the smallest page_id
are all responses; a null time is the epoch; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dealt_out, materialise, shared_dir, tidily
from .tokens import qualified, store

EPOCH = "2020-01-01T00:00:00Z"
ENTRIES_PER_RANGE = 50_000
ENTRY = "url_key string, ts string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long, length long"
FIELDS = [f.split(" ")[0] for f in ENTRY.split(", ")]


# --- records


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def record(page_id, url: str | None, ts: str, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC record; a revisit keeps the HTTP head, with the payload's length, and no payload."""
    revisit = refers_to is not None
    target = (url or "").replace("\r", "").replace("\n", "")
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>",
        f"WARC-Target-URI: {target}",
        f"WARC-Date: {ts}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
    ]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """The fields of one record; a response's payload is checked against its digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if len(block) != int(fields["Content-Length"]):
        raise ValueError("a record is cut short")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"(?i)content-length: (\d+)", http)[1])
    number = lambda x: None if x == "null" else int(x)
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (len(payload) != size or base32_sha1(payload) != digest):
        raise ValueError("a payload differs from its digest")
    refers = fields.get("WARC-Refers-To")
    return {
        "url": fields["WARC-Target-URI"],
        "ts": fields["WARC-Date"],
        "page_id": number(fields["WARC-Record-ID"][10:-1]),
        "payload_bytes": size,
        "payload_digest": digest,
        "record_type": fields["WARC-Type"],
        "refers_to": number(refers[10:-1]) if refers else None,
    }


def url_key(url: str) -> str:
    """The URL with its host's labels reversed, lower-cased, without scheme, fragment and port: sorts by site."""
    m = re.match(r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)(?::\d*)?([^#]*)", url)
    if not m:
        return url.partition("#")[0]
    return ",".join(reversed(m[1].lower().split("."))) + ")" + (m[2] or "/")


def members(stream, chunk: int = 1 << 20) -> Iterator[tuple[int, int, bytes]]:
    """Offset, length and content of every gzip member of a stream."""
    at, left = 0, b""
    while True:
        if not left:
            left = stream.read(chunk)
            if not left:
                return
        z, used, parts = zlib.decompressobj(31), 0, []
        while True:
            if not left:
                left = stream.read(chunk)
                if not left:
                    raise ValueError("an archive is cut short")
            parts.append(z.decompress(left))
            used += len(left) - len(z.unused_data)
            left = z.unused_data
            if z.eof:
                break
        yield at, used, b"".join(parts)
        at += used


# --- writing and reading


def write_archives(pages: DataFrame) -> tuple[str, DataFrame]:
    """Write a record for each row of pages(page_id, url, html, ts): the folder, and rows
    (archive, records). An archive counts only if its row was written; files of lost
    attempts have other names and are never read."""
    spark = pages.sparkSession
    folder = qualified(spark, shared_dir(spark))
    body = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", body.alias("html"), "ts", F.sha1(body.cast("binary")).alias("sha1"))
    # written, so that both sides of the join are dealt out for it alone and a hot payload can be split
    first = materialise(rows.groupBy("sha1").agg(F.min("page_id").alias("first")), "first")
    rows = rows.join(first, "sha1").select("page_id", "url", "html", F.coalesce("ts", F.lit(EPOCH)).alias("ts"), F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))

    def run(batches):
        context = TaskContext.get()
        name, n, out = f"pages-{context.partitionId():06d}-{context.taskAttemptId()}.warc.gz", 0, None
        files, at = store(folder)
        try:
            for b in batches:
                for page_id, url, html, ts, refers in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if out is None:
                        files.create_dir(at, recursive=True)
                        out = files.open_output_stream(f"{at}/{name}", compression=None)
                    payload = html.encode("utf-8", "surrogatepass")
                    z = zlib.compressobj(6, zlib.DEFLATED, 31)
                    out.write(z.compress(record(page_id, url, ts, payload, base32_sha1(payload), refers)) + z.flush())
                    n += 1
        finally:
            if out is not None:
                out.close()
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], names=["archive", "records"])

    return folder, materialise(rows.mapInArrow(tidily(run), "archive string, records long"), "archives")


def read_archives(archives: DataFrame, folder: str, n_archives: int) -> DataFrame:
    """Index entries of archives(archive), each archive a run sorted by URL key, time and page_id;
    a task reads one archive as long as there are no more than ``common.MOST_TASKS``."""
    def run(batches):
        files, at = store(folder)
        for b in batches:
            for name in b.column(0).to_pylist():
                rows = []
                with files.open_input_stream(f"{at}/{name}", compression=None) as f:
                    for offset, length, data in members(f):
                        x = parse(data)
                        rows.append((url_key(x["url"]), x["ts"], x["page_id"], x["payload_bytes"], x["payload_digest"], x["record_type"], x["refers_to"], name, offset, length))
                rows.sort(key=order)
                for k in range(0, len(rows), 10_000):
                    yield entries(rows[k : k + 10_000])

    return dealt_out(archives.select("archive"), n_archives, "archive").mapInArrow(tidily(run), ENTRY)


# --- the merge


def order(row: tuple) -> tuple:
    return row[0], row[1], row[2] is None, row[2] or 0, row[7], row[8]


def entries(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64() if k.split(" ")[1] == "long" else pa.string() for k in ENTRY.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=FIELDS)


def loser_tree(runs: list[list], key) -> Iterator:
    """Merge sorted runs. Inner nodes hold the losers of their matches, so an output costs
    one comparison a level; ties go to the earlier run."""
    k = len(runs)
    if not k:
        return
    heads = [iter(r) for r in runs]
    row: list = [next(h, None) for h in heads]
    keys: list = [None if r is None else key(r) for r in row]

    def wins(a: int, b: int) -> bool:
        if keys[a] is None or keys[b] is None:
            return keys[b] is None and (keys[a] is not None or a < b)
        return (keys[a], a) < (keys[b], b)

    tree = [-1] * k  # tree[1:] the losers, tree[0] the winner
    for leaf in range(k):
        at, mine = (leaf + k) // 2, leaf
        while at and tree[at] >= 0:
            if wins(tree[at], mine):
                tree[at], mine = mine, tree[at]
            at //= 2
        tree[at] = mine
    while keys[top := tree[0]] is not None:
        yield row[top]
        row[top] = next(heads[top], None)
        keys[top] = None if row[top] is None else key(row[top])
        at, mine = (top + k) // 2, top
        while at:
            if wins(tree[at], mine):
                tree[at], mine = mine, tree[at]
            at //= 2
        tree[0] = mine


def natural_runs(rows: list, key) -> list[list]:
    """Maximal sorted stretches: the slices of the runs as they arrived."""
    out, last = [], None
    for r in rows:
        k = key(r)
        if last is None or k < last:
            out.append([])
        out[-1].append(r)
        last = k
    return out


def merge_index(runs: DataFrame, n_entries: int, per_range: int = ENTRIES_PER_RANGE) -> DataFrame:
    """All entries with range_no and range_pos, which order them globally. A task holds the
    entries of one range, about ``per_range``."""
    ranges = max(1, -(-n_entries // per_range))
    dealt = runs.repartitionByRange(ranges, F.col("url_key").asc_nulls_first(), F.col("ts").asc_nulls_first(), F.col("page_id").asc_nulls_last(), F.col("archive"), F.col("offset"))

    def run(batches):
        number = TaskContext.get().partitionId()
        rows = [t for b in batches for t in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        out, at = [], 0
        for r in loser_tree(natural_runs(rows, order), order):
            out.append(r)
            if len(out) == 10_000:
                yield placed(out, number, at)
                at += len(out)
                out = []
        if out:
            yield placed(out, number, at)

    return dealt.mapInArrow(tidily(run), ENTRY + ", range_no long, range_pos long")


def placed(rows: list[tuple], number: int, at: int) -> pa.RecordBatch:
    b = entries(rows)
    return pa.RecordBatch.from_arrays([*b.columns, pa.array([number] * len(rows), pa.int64()), pa.array(range(at, at + len(rows)), pa.int64())], names=[*FIELDS, "range_no", "range_pos"])


def capture_histories(pages: DataFrame, ts: Column | None = None, per_range: int = ENTRIES_PER_RANGE) -> DataFrame:
    """Write pages(page_id, url, html) to archives, read them back and merge their index.

    ts: the capture time of a row, as text that sorts; without one, EPOCH and page_id seconds.
    """
    if ts is None:
        ts = F.date_format(F.timestamp_seconds(F.unix_timestamp(F.lit(EPOCH).cast("timestamp")) + F.pmod(F.col("page_id"), F.lit(10**9))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    folder, archives = write_archives(pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), ts.cast("string").alias("ts")))
    n, n_archives = archives.agg(F.coalesce(F.sum("records"), F.lit(0)), F.count("*")).first()
    return merge_index(materialise(read_archives(archives, folder, n_archives), "runs"), n, per_range)
