import hashlib

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from entitrail.llm import warc


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=200), st.integers(1, 50))
def test_chunks(payload, size):
    assert warc.dechunked(warc.chunked(payload, size)) == payload


def test_broken_chunks():
    with pytest.raises(ValueError):
        warc.dechunked(b"5\r\nabc\r\n0\r\n\r\n")


def test_equals_sql(spark):
    d = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{d}/pages.parquet'")
    want = sorted(map(str, con.execute("SELECT page_id, payload_bytes, payload_digest, record_type, refers_to FROM (" + warc.OP9_SQL + ")").fetchall()))
    assert sorted(str(tuple(r)) for r in warc.op9_warc(spark, d).collect()) == want


LONG = "ü" * 50_000
PAGES = [
    (1, "http://a/ b\n", "x" * 1000), (2, None, "x" * 1000), (3, "u", "x" * 1000), (4, "u", "x" * 999), (5, "u", "x" * 999), (6, "u", None), (7, "u", ""), (8, "u", LONG),
    (9, "u", LONG), (None, "u", "x" * 1000), (None, "u", "z" * 2000), (None, "u", "z" * 2000), (3, "again", "x" * 1000), (10, "u", "WARC/1.1\r\n\r\n0\r\n\r\n" * 100),
]


def test_segments_and_edges(spark, tmp_path):
    pages = spark.createDataFrame([(*p, "x", 1) for p in PAGES], "page_id long, url string, html string, digest string, keep int")
    warc.write_archives(pages, f"file://{tmp_path}/a", segment=700, archive=3000)
    rows = warc.read_archives(spark, f"file://{tmp_path}/a").collect()
    assert len(rows) == len(PAGES)
    kinds = sorted((str(r.page_id), r.record_type, str(r.refers_to)) for r in rows)
    x = [("1", "revisit", "3"), ("2", "revisit", "3"), ("None", "revisit", "3"), ("3", "response", "None"), ("3", "response", "None"), ("8", "revisit", "9"), ("9", "response", "None")]
    assert kinds == sorted(x + [(n, "response", "None") for n in ("4", "5", "6", "7", "10", "None", "None")])
    payloads = {(p[2] or "").encode() for p in PAGES}
    for r in rows:
        if r.record_type == "response":
            assert bytes(r.payload) in payloads and hashlib.sha1(r.payload).hexdigest() == r.digest
        assert r.length in {len(p) for p in payloads}
    assert [r.url for r in rows if r.page_id == 1] == ["http://a/%20b%0A"]
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_archives(empty, f"file://{tmp_path}/b")
    assert warc.read_archives(spark, f"file://{tmp_path}/b").count() == 0


def test_lost_segment():
    import pyarrow as pa

    page = warc.records(1, "u", "y" * 5000, hashlib.sha1(b"y" * 5000).hexdigest(), None, "0/0", 1000)
    import gzip

    found = [r for r in warc._parsed(gzip.compress(b"".join(page)))]
    assert len(found) == 6 and warc._reassembled(pa.Table.from_pylist(found[::-1])).column("payload")[0].as_py() == b"y" * 5000
    for bad in (found[:-1], found[1:], found[:2] + found[3:]):
        with pytest.raises(ValueError):
            warc._reassembled(pa.Table.from_pylist(bad))


def page_records(n=4):
    body = lambda i: f"page {i} ".encode() * (300 * i + 1)
    return [x for i in range(n) for x in warc.records(i, f"http://x/{i}", body(i).decode(), hashlib.sha1(body(i)).hexdigest(), None, f"0/{i}", 1 << 20)]


@pytest.mark.parametrize("packing", ["members", "one", "plain", "padded"])
def test_archives_of_others(packing):
    import gzip

    records = page_records()
    data = {"members": b"".join(map(gzip.compress, records)), "one": gzip.compress(b"".join(records)), "plain": b"".join(records), "padded": b"".join(map(gzip.compress, records)) + b"\0" * 100}[packing]
    assert [r["page_id"] for r in warc._parsed(data)] == [0, 1, 2, 3]
    for size in (3, len(data) // 2, len(data) - 120 if packing == "padded" else len(data) - 5):
        with pytest.raises(ValueError):
            list(warc._parsed(data[:size]))


def test_large_records_over_parts_of_the_stream():
    import gzip
    import random

    body = random.Random(1).randbytes(3_000_000).hex()
    records = warc.records(7, "u", body, hashlib.sha1(body.encode()).hexdigest(), None, "0/7", 1 << 30) * 3
    found = list(warc._parsed(b"".join(map(gzip.compress, records))))
    assert len(found) == 3 and all(warc.payload_of(r["block"]) == body.encode() for r in found)


def test_headers_name_what_they_refer_to():
    import gzip

    revisit = warc.records(1, "u", "x", hashlib.sha1(b"x").hexdigest(), 9, "0/0", 1000)[0]
    assert f"WARC-Refers-To: <{warc.page_urn(9)}>".encode() in revisit
    parts = warc.records(1, "http://u", "y" * 3000, hashlib.sha1(b"y" * 3000).hexdigest(), None, "0/1", 1000)
    assert all(b"WARC-Target-URI: http://u" in x for x in parts) and len(list(warc._parsed(gzip.compress(b"".join(parts))))) == len(parts)
    lower = gzip.compress(b"WARC/1.0\r\nwarc-type: response\r\nwarc-record-id: <a>\r\nwarc-payload-digest: md5:abc\r\ncontent-length: 3\r\n\r\nabc\r\n\r\n")
    assert [(r["kind"], r["digest"], r["block"]) for r in warc._parsed(lower)] == [("response", None, b"abc")]
