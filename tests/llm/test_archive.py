import hashlib

import pytest

from lexmill.llm import archive as A
from lexmill.llm import common as C


@pytest.mark.parametrize("version", [1, 2])
def test_arc_round_trip(version):
    arc = A.arc_head(version, "x.arc")
    bodies = [b"", b"<p>\n\nhi</p>\n", "é".encode() * 700]
    for k, b in enumerate(bodies):
        arc += A.arc_record(version, f"http://a/{k}", b, len(arc), "x.arc", f"page:{k}")
    records = list(A.parse_arc(arc))
    assert [c.partition(b"\r\n\r\n")[2] for _, c in records[1:]] == bodies and records[0][0]["version"] == version
    out = [r for x in A.convert(arc) for r in A.parse_warc(x)]
    assert [h["warc-type"] for h, _ in out] == ["warcinfo", "response", "response", "response"]
    assert out[1][0]["warc-date"] == "2024-01-01T00:00:00Z" and len({h["warc-record-id"] for h, _ in out}) == 4
    assert out[3][0]["warc-payload-digest"] == A.b32(hashlib.sha1(bodies[2]).digest())


def test_bad_archives():
    arc = A.arc_head(1, "x") + A.arc_record(1, "http://a", b"abc", 0, "x")
    with pytest.raises(ValueError, match="doesn't fit"):
        list(A.parse_arc(arc[:-3]))
    with pytest.raises(ValueError, match="no header line"):
        list(A.parse_arc(arc + b"http://b 1 2\n"))
    with pytest.raises(ValueError, match="version 3"):
        list(A.parse_arc(b"filedesc://x 0.0.0.0 20240101 text/plain 4\n3 0 \n"))
    with pytest.raises(ValueError, match="date"):
        A.iso_date("20x")
    assert A.iso_date("2003") == "2003-01-01T00:00:00Z"


def test_legacy_header_lines():
    """Types and addresses with blanks, bytes that aren't UTF-8, blank lines and carriage returns between records."""
    body = b"HTTP/1.0 200 OK\r\n\r\nhello"
    one = A.arc_head(1, "old.arc")
    one += b"http://a/\xe9 b c 1.2.3.4 19970101 text/html; charset=x %d\n" % len(body) + body + b"\n\n\r\n"
    one += b"dns:a 2001:db8::1 19970101120000 text/dns 3\r\nabc"
    got = list(A.parse_arc(one))
    assert [f["type"] for f, _ in got] == ["text/plain", "text/html; charset=x", "text/dns"] and got[1][0]["url"] == "http://a/\udce9 b c" and got[2][1] == b"abc"
    out = [r for x in A.convert(one) for r in A.parse_warc(x)]
    assert [h["warc-type"] for h, _ in out] == ["warcinfo", "response", "resource"] and out[1][1] == body
    assert b"http://a/\xe9 b c" in b"".join(A.convert(one))
    two = A.arc_head(2, "n.arc") + b"http://a 1.2.3.4 20040101000000 text/html; charset=y 200 - - 77 n.arc %d\n" % len(body) + body + b"\n"
    f = list(A.parse_arc(two))[1][0]
    assert (f["type"], f["result"], f["offset"], f["filename"]) == ("text/html; charset=y", "200", "77", "n.arc")


def test_extra_columns_are_ignored(spark):
    df = spark.createDataFrame([(1, "u", "x" * 1200, 7, "k"), (2, "v", "x" * 1200, 8, "l")], "page_id long, url string, html string, n int, key string")
    got = A.read_archives(A.write_archives(A.with_originals(df), C.new_path(spark, "w")), 1).collect()
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in got) == [(1, "revisit", 2), (2, "response", None)]


def test_pages(spark):
    same = "x" * 1200
    rows = [(1, "http://a b/ü", same), (2, "u2", same), (9, None, same), (3, "u3", None), (4, "u4", ""), (5, "u5", "short"), (6, "u6", "short"), (None, "u7", same), (10, "u", "é" * 600), (11, "u", "é" * 600), (12, "u", "é\r\n\r\n" * 90_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    m = A.write_archives(A.with_originals(df), C.new_path(spark, "w"))
    got = A.read_archives(m, 2).collect()
    assert len(got) == len(rows) == sum(r.n_records for r in m.collect())
    for r in got:
        html = (next(h for i, _, h in rows if i == r.page_id) or "").encode()
        assert (r.payload_bytes, r.payload_digest) == (len(html), hashlib.sha1(html).hexdigest())
        to = {1: 9, 2: 9, None: 9, 10: 11}.get(r.page_id)
        assert (r.record_type, r.refers_to) == (("revisit", to) if to else ("response", None)) and (r.payload == html or to)
    assert A.read_archives(A.write_archives(A.with_originals(df.limit(0)), C.new_path(spark, "w")), 1).count() == 0


def test_rows_of_one_page_id_keep_their_own_payloads(spark):
    same, other, third = "x" * 1200, "y" * 1300, "z" * 1400
    rows = [(1, "u1", same), (1, "u1", other), (1, "u1", "short"), (9, "u9", same), (None, "n", same), (None, "n", third)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    got = A.read_archives(A.write_archives(A.with_originals(df), C.new_path(spark, "w")), 1).collect()
    want = [(i, hashlib.sha1(h.encode()).hexdigest(), *((9, None) if h == same and i != 9 else (None, h.encode()))) for i, _, h in rows]
    assert sorted(((r.page_id, r.payload_digest, r.refers_to, r.payload and bytes(r.payload)) for r in got), key=repr) == sorted(want, key=repr)


def test_very_long_and_very_many_payloads(spark):
    rows = [(1, "http://a/", "é" * 3_000_000), (2, "http://b/", "é" * 3_000_000)] + [(k, f"http://c/{k}", f"page {k}") for k in range(3, 400)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(2)
    manifest = A.write_archives(A.with_originals(pages), C.new_path(spark, "t"), nbytes=1000)
    got = {r.page_id: r for r in A.read_archives(manifest, 2).collect()}
    assert len(got) == 399 and (got[1].record_type, got[1].refers_to, got[2].record_type, got[1].payload_bytes) == ("revisit", 2, "response", 6_000_000)
    assert bytes(got[7].payload) == b"page 7"
