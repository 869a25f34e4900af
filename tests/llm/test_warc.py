"""Archives: round trips against a plain loop, and archives of others with links of every kind."""

import base64
import gzip
import hashlib

import pytest

from prismlake.llm import warc

PAGES = "page_id long, url string, html string"


def plain(pages, least=0):
    """Each page's row, told apart only by what the contract names."""
    out, order = [], sorted(range(len(pages)), key=lambda i: (pages[i][0] is None, pages[i][0] or 0, i))
    first = {}
    for i in order:
        page_id, _, html = pages[i]
        data = (html or "").encode()
        known = first.setdefault(data, page_id) if len(data) >= least and data in first else None
        again = len(data) >= least and data in first
        first.setdefault(data, page_id)
        out.append((page_id, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", known if again else None))
    return sorted(out, key=repr)


def rows(df):
    return sorted(map(tuple, df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr)


ODD = [
    (5, "http://a.example/x?y#z", "same"), (3, "http://b.example/", "same"), (4, None, "same"), (3, "http://b.example/", "same"),
    (7, "http://c.example\r\nWARC-Type: evil", "x\r\n\r\n\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello"), (8, "", None), (9, "é", ""), (None, "u", "ü" * 3), (None, "u", "same"),
    (10, "http://d.example", "ends\r\n"), (11, "http://d.example", "\r\n\r\n"), (12, "http://d.example", "long " * 300_000), (13, "q", "\n\r\r\n"), (-1, "q", "ü" * 3),
]


def test_pages_come_back_as_a_plain_loop_gives_them(spark):
    assert rows(warc.op12_warc_captures(spark.createDataFrame(ODD, PAGES))) == plain(ODD)


def test_a_hot_payload_and_small_ones_below_the_least_size(spark, tmp_path):
    pages = [(i, f"http://h{i}.example/", "hot" if i % 3 else f"p{i % 7}") for i in range(200)]
    assert rows(warc.op12_warc_captures(spark.createDataFrame(pages, PAGES))) == plain(pages)
    path = f"file://{tmp_path}/w"
    warc.write(spark.createDataFrame(pages, PAGES), path, least=3)
    got = rows(warc.pages_of(warc.read(spark, path)))
    assert [r[3] for r in got].count("response") == 68 == len({p[2] for p in pages if len(p[2]) >= 3}) + sum(len(p[2]) < 3 for p in pages)


def test_empty_table_and_extra_columns(spark):
    none = spark.createDataFrame([], PAGES + ", uid long, digest string, n int, `a.b` int")
    assert rows(warc.op12_warc_captures(none)) == []
    one = spark.createDataFrame([(1, "u", "h", 2, "d", 3, 4)], none.schema)
    assert rows(warc.op12_warc_captures(one)) == plain([(1, "u", "h")])


def record(kind, record_id, block=b"", **headers):
    lines = [b"WARC/1.0", b"WARC-Type: " + kind.encode()] + [f"{k.replace('_', '-')}: {x}".encode() for k, v in headers.items() for x in (v if isinstance(v, list) else [v])]
    lines += [b"WARC-Record-ID: " + record_id.encode()] if record_id else []
    return b"\r\n".join([*lines, b"Content-Length: %d" % len(block), b"", block, b"", b""])


@pytest.fixture
def archive(tmp_path):
    """A foreign archive, each record a member of its own, over two files."""
    http = {"content_type": "application/http"}
    one = [
        record("warcinfo", "<i>", b"software: x\r\n", content_type="application/warc-fields"),
        record("response", "<r1>", b"HTTP/1.1 200 OK\r\nContent-Length: 3\r\n\r\n\x00\xff\n", **http),
        record("request", "<q1>", b"GET / HTTP/1.1\r\n\r\n", WARC_Concurrent_To="<r1>", **http),
        record("metadata", "<m1>", b"via: a\r\nlong: b\r\n c\r\n", WARC_Concurrent_To="<q1>", content_type="application/warc-fields"),
        record("response", "<r2>", b"HTTP/1.1 404 No\r\n\r\nbody", WARC_Concurrent_To=["<q2>", "<m2>"], **http),
        record("request", "<q3>", b"GET /lost HTTP/1.1\r\n\r\n", WARC_Concurrent_To="<gone>", **http),
    ]
    two = [
        record("request", "<q2>", b"GET /2 HTTP/1.1\r\n\r\n", **http),
        record("metadata", "<m2>", b"plain", content_type="text/plain"),
        record("resource", "<r3>", b"data", content_type="text/plain"),
        record("revisit", "<r4>", b"HTTP/1.1 200 OK\r\nContent-Length: 77\r\n\r\n", WARC_Refers_To="<r1>", **http),
        b"garbage\r\n\r\n" + record("response", "<cut>", b"x" * 50)[:-30],
    ]
    for name, recs in (("a.warc.gz", one), ("b.warc.gz", two)):
        (tmp_path / name).write_bytes(b"".join(map(gzip.compress, recs)))
    (tmp_path / "c.warc.gz").write_bytes(gzip.compress(b""))
    return f"file://{tmp_path}"


def test_foreign_archives_are_read_and_put_together(spark, archive):
    found = warc.read(spark, archive).cache()
    by_id = {r["record_id"]: r for r in found.collect()}
    assert by_id["<r1>"]["payload"] == b"\x00\xff\n" and by_id["<r1>"]["digest"] == base64.b32encode(hashlib.sha1(b"\x00\xff\n").digest()).decode()
    assert [(f["name"], f["value"]) for f in by_id["<m1>"]["fields"]] == [("via", "a"), ("long", "b c")]
    assert by_id["<r4>"]["http_length"] == 77 and not by_id["<cut>"]["whole"] and all(r["whole"] for i, r in by_id.items() if i != "<cut>")
    got = {r["capture_id"]: (r["response"] and r["response"]["record_id"], [x["record_id"] for x in r["requests"]], [x["record_id"] for x in r["metadata"]]) for r in warc.captures(found).collect()}
    assert got == {
        "<r1>": ("<r1>", ["<q1>"], ["<m1>"]), "<r2>": ("<r2>", ["<q2>"], ["<m2>"]), "<r3>": ("<r3>", [], []), "<r4>": ("<r4>", [], []),
        "<q3>": (None, ["<q3>"], []), "<cut>": ("<cut>", [], []),
    }


def test_records_given_twice(spark, archive):
    found = warc.read(spark, archive)
    got = [r for r in warc.captures(found.union(found)).collect() if r["capture_id"] == "<r1>"]
    assert len(got) == 2 and all(len(r["requests"]) == len(r["metadata"]) == 1 for r in got)
