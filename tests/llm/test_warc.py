"""Archives as other writers make them, and record ids."""

import base64
import gzip
import hashlib
import io
import uuid

import pytest

from refloom.llm import warc
from refloom.llm.shared import new_place


def member(kind, block, *more, digest=None):
    head = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", "WARC-Date: 2020-01-01T00:00:00Z", *more, f"Content-Length: {len(block)}", "", ""]
    return gzip.compress("\r\n".join(head).encode() + block + b"\r\n\r\n")


BODY = b"<p>hello there</p>"
SENT = b"5\r\n<p>he\r\nd;x=1\r\nllo there</p>\r\n0\r\n\r\n"


def foreign():
    b32 = base64.b32encode(hashlib.sha1(BODY).digest()).decode()
    return b"".join([
        member("warcinfo", b"software: x\r\nformat: WARC File Format 1.0\r\n", "Content-Type: application/warc-fields"),
        member("request", b"GET / HTTP/1.1\r\nHost: x\r\n\r\n", "Content-Type: application/http; msgtype=request"),
        member("response", b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + SENT, "WARC-Target-URI: http://x/", f"WARC-Payload-Digest: sha1:{b32}"),
        member("response", b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + SENT, f"WARC-Payload-Digest: sha1:{hashlib.sha1(SENT).hexdigest()}"),
        member("response", b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + BODY),
        member("response", b"HTTP/1.0 200 OK\r\n\r\n" + BODY, "WARC-Payload-Digest: sha256:" + hashlib.sha256(BODY).hexdigest()),
        member("response", b"220 ftp greets\r\n"),
        member("metadata", b"a: b\r\n"),
        member("resource", BODY, "Content-Type: text/html"),
        member("revisit", b"HTTP/1.1 304 Not Modified\r\n\r\n", f"WARC-Payload-Digest: sha1:{b32}"),
        member("revisit", b""),
        member("continuation", b"rest"),
    ])


def test_records_of_other_writers():
    found = list(warc.records(io.BytesIO(foreign())))
    assert [r.headers["warc-type"] for r in found] == "warcinfo request response response response response response metadata resource revisit revisit continuation".split()
    assert [r.payload() for r in found] == [None, None, BODY, BODY, BODY, BODY, b"220 ftp greets\r\n", None, BODY, None, None, None]
    wrong = member("response", b"HTTP/1.0 200 OK\r\n\r\n" + BODY, "WARC-Payload-Digest: sha1:" + "A" * 32)
    with pytest.raises(warc.WarcError):
        list(warc.records(io.BytesIO(wrong)))


def test_table_of_records_of_other_writers(spark, tmp_path):
    (tmp_path / "x.warc.gz").write_bytes(foreign())
    rows = warc.read_archives(spark.createDataFrame([(f"file://{tmp_path}/x.warc.gz",)], "path string")).collect()
    n, b32 = len(BODY), base64.b32encode(hashlib.sha1(BODY).digest()).decode()
    assert [(r.record_type, r.payload_bytes) for r in rows] == [("warcinfo", None), ("request", None), *[("response", n)] * 4, ("response", 16), ("metadata", None), ("resource", n), ("revisit", None), ("revisit", None), ("continuation", None)]
    assert all(r.page_id is None and r.refers_to is None for r in rows)
    assert [r.payload_digest for r in rows if r.payload == BODY][::4] == [b32, b32] and rows[2].url == "http://x/" and rows[9].payload_digest == b32


def test_record_ids_differ(spark):
    pages = [(3, "http://a", "x"), (3, "http://a", "x"), (None, "http://b", "y"), (None, "http://b", "y"), (1, "http://c", "x"), (-5, None, "z")]
    table = spark.createDataFrame([(i, u, h, "k") for i, u, h in pages], "page_id int, url string, html string, payload string").coalesce(1)
    rows = warc.read_archives(warc.write_archives(table, new_place(spark, "w"))).collect()
    assert len({r.record_id for r in rows}) == len(rows) == 6 and all(uuid.UUID(r.record_id) for r in rows)
    assert sorted((r.page_id is None, r.page_id or 0, r.record_type, r.refers_to) for r in rows) == [(False, -5, "response", None), (False, 1, "revisit", 3), (False, 3, "response", None), (False, 3, "response", None), (True, 0, "response", None), (True, 0, "response", None)]


def test_ids_that_are_no_numbers_are_refused(spark):
    with pytest.raises(TypeError):
        warc.write_archives(spark.createDataFrame([("a", "u", "h")], "page_id string, url string, html string"), "x")
