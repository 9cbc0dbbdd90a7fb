import base64
import gzip
import hashlib
import io
import random

import pytest

from paperloom.llm import warc as W


def test_loser_tree_merges():
    rnd = random.Random(6)
    for k in (0, 1, 2, 3, 7, 16):
        runs = [sorted(rnd.randrange(50) for _ in range(rnd.choice((0, 1, 20)))) for _ in range(k)]
        assert list(W.loser_tree(runs, lambda x: x)) == sorted(x for r in runs for x in r)


def test_ties_keep_the_order_of_runs():
    runs = [[(1, "a"), (2, "a")], [(1, "b"), (1, "c")], [(0, "d"), (1, "d")]]
    assert list(W.loser_tree(runs, lambda x: x[0])) == [(0, "d"), (1, "a"), (1, "b"), (1, "c"), (1, "d"), (2, "a")]


def test_natural_runs():
    assert W.natural_runs([1, 2, 2, 1, 5, 0], lambda x: x) == [[1, 2, 2], [1, 5], [0]]


@pytest.mark.parametrize("url, key", [("https://User@B.a.Example.com:8080/x?q=1#f", "com,example,a,b)/x?q=1"), ("http://h", "h)/"), ("", ""), ("no scheme#x", "no scheme")])
def test_url_keys(url, key):
    assert W.url_key(url) == key


def test_records_round_trip_and_digests_are_checked():
    payload = "ü\r\n\r\nWARC/1.1\r\n".encode() * 3
    digest = W.base32_sha1(payload)
    data = W.record(7, "http://x/\r\ny", "2020-01-01T00:00:00Z", payload, digest, None)
    got = W.parse(data)
    assert (got["page_id"], got["payload_bytes"], got["payload_digest"], got["record_type"], got["refers_to"], got["url"]) == (7, len(payload), digest, "response", None, "http://x/y")
    revisit = W.record(8, None, "t", payload, digest, 7)
    assert payload not in revisit
    assert {k: W.parse(revisit)[k] for k in ("payload_bytes", "record_type", "refers_to")} == {"payload_bytes": len(payload), "record_type": "revisit", "refers_to": 7}
    with pytest.raises(ValueError):
        W.parse(data.replace("ü".encode(), b"uu"))


def test_members_across_chunks():
    parts = [b"a" * 1000, b"", b"xyz" * 9]
    data = b"".join(gzip.compress(p) for p in parts)
    for chunk in (1, 7, 10_000):
        got = list(W.members(io.BytesIO(data), chunk))
        assert [x for _, _, x in got] == parts
        assert [data[a : a + n] for a, n, _ in got] == [data[a : a + n] for a, n, _ in W.members(io.BytesIO(data))]
    with pytest.raises(ValueError):
        list(W.members(io.BytesIO(data[:-3])))


def table(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, archive string")


def test_capture_histories(spark):
    rnd = random.Random(8)
    rows = [(i, f"http://h{rnd.randrange(4)}.org/{rnd.randrange(3)}", rnd.choice(["", "same", f"own {i}", "ü" * 300_000 if i == 5 else "b"])) for i in range(300)] + [(900, None, None), (901, "http://z", None)]
    got = {r.page_id: r for r in W.capture_histories(table(spark, rows).repartition(5), per_range=40).collect()}
    first = {}
    for i, _, h in rows:
        first[h or ""] = min(first.get(h or "", i), i)
    for i, u, h in rows:
        r, payload = got[i], (h or "").encode()
        own = first[h or ""] == i
        assert (r.payload_bytes, r.payload_digest) == (len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if own else ("revisit", first[h or ""]))
        assert r.url_key == W.url_key(u or "")
    ordered = sorted(got.values(), key=lambda r: (r.range_no, r.range_pos))
    assert [(r.url_key, r.ts, r.page_id) for r in ordered] == sorted((r.url_key, r.ts, r.page_id) for r in ordered)
    assert len({r.range_no for r in ordered}) > 3


def test_repeated_rows_and_null_ids(spark):
    rows = [(1, "u", "p"), (1, "u", "p"), (2, "u", "p"), (None, "u", "p"), (None, "u", "q")]
    got = sorted(((r.page_id, r.record_type, r.refers_to) for r in W.capture_histories(table(spark, rows)).collect()), key=str)
    assert got == sorted([(1, "response", None), (1, "response", None), (2, "revisit", 1), (None, "revisit", 1), (None, "response", None)], key=str)


def test_empty(spark):
    assert W.capture_histories(table(spark, [])).count() == 0


def test_revisits_against_the_oracle(spark, tmp_path):
    """The contract's SQL on pages many of which have equal payloads, null and empty ones among them."""
    import duckdb

    from paperloom.llm.oracles import ORACLE
    from paperloom.llm.queries import op1_warc_index_merge

    html = ["<p>one</p>", "<p>two</p>", "", None, "é" * 500, "<p>one</p> "]
    rows = [(i, f"http://host{i % 7}.example/{i % 11}/{i}", html[i * i % 6] if i % 5 else f"own {i}") for i in range(400)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    db = duckdb.connect()
    db.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    want = sorted(db.execute(f"select {', '.join(names)} from ({ORACLE['op1_warc_index_merge']})").fetchall())
    got = sorted(tuple(r) for r in op1_warc_index_merge(spark, str(tmp_path)).select(*names).collect())
    assert got == want and sum(r[3] == "revisit" for r in got) > 200
