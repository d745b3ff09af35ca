"""WARC archives: a writer with one gzip member per record, and a sequential reader.

The reader never holds more than one record and a piece of compressed input: it inflates a member piece by piece, takes
the header block, then as many bytes as Content-Length says, and checks the digests. It takes any records, those of
other writers too: warcinfo, request and metadata records have no payload here, an HTTP body may be chunked or have no
length, and page ids, which only this writer's own header fields carry, are null.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, NullType

from refloom.llm.files import read_stream, written
from refloom.llm.shared import materialize, new_place
from refloom.llm.text import rows_of

VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PIECE = 1 << 16
#: Header fields of this writer beside the standard's: the page's id, and that of the page that a revisit refers to.
PAGE_ID, REFERS_TO_PAGE = "X-Page-ID", "X-Refers-To-Page-ID"
#: An archive file is closed once it has this many compressed bytes.
FILE_BYTES = 32 << 20


class WarcError(ValueError):
    """An archive that breaks the format or a digest."""


def sha1_base32(data: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _value(text: str) -> str:
    """A header value on one line: control characters, spaces and non-ASCII ones are percent-encoded."""
    return "".join(c if "!" <= c <= "~" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in text)


def record(record_id: str, url: str, payload: bytes, date: str, refers_to: str | None = None, digest: str | None = None, pages: tuple[int | None, int | None] = (None, None)) -> bytes:
    """One gzip member: a response record with the payload or, with refers_to, a revisit record with HTTP headers only.

    Both have the digest of the full payload, and its length as the HTTP Content-Length. pages: ids of the page and of the page referred to, where there are any.
    """
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to else http + payload
    head = [VERSION, f"WARC-Type: {'revisit' if refers_to else 'response'}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}", f"WARC-Target-URI: {_value(url)}", f"WARC-Payload-Digest: sha1:{digest or sha1_base32(payload)}", f"WARC-Block-Digest: sha1:{sha1_base32(block)}"]
    if refers_to:
        head += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += [f"{name}: {i}" for name, i in zip((PAGE_ID, REFERS_TO_PAGE), pages, strict=True) if i is not None]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + block + b"\r\n\r\n") + packer.flush()


@dataclass(frozen=True)
class Record:
    headers: dict[str, str]
    block: bytes

    @property
    def record_id(self) -> str:
        return self.headers.get("warc-record-id", "").strip("<>")

    @property
    def refers_to(self) -> str | None:
        found = self.headers.get("warc-refers-to")
        return found.strip("<>") if found else None

    @property
    def has_http(self) -> bool:
        """Whether the block is an HTTP response, or the head of one."""
        return self.headers.get("warc-type") in ("response", "revisit") and self.block[:5] == b"HTTP/"

    def http(self) -> tuple[dict[str, str], bytes]:
        """HTTP headers and body of the block, the body as it was sent."""
        head, _, body = self.block.partition(b"\r\n\r\n")
        return _headers(head.split(b"\r\n")[1:]), body

    def payload(self) -> bytes | None:
        """The payload of a response or a resource, without transfer encoding; null for other records."""
        kind = self.headers.get("warc-type")
        if kind in ("response", "resource", "conversion") and not self.has_http:
            return self.block
        if kind != "response":
            return None
        headers, body = self.http()
        return _joined(body) if "chunked" in headers.get("transfer-encoding", "").lower() else body


def _joined(body: bytes) -> bytes:
    """A chunked body in one piece; one that isn't made of chunks, as some writers undo them and keep the header, stays as it is."""
    parts, at = [], 0
    while True:
        end = body.find(b"\r\n", at, at + 100)
        size = re.match(rb"\s*([0-9a-fA-F]+)\s*(?:;.*)?$", body[at:end]) if end >= 0 else None
        if not size:
            return body
        n = int(size[1], 16)
        if not n:
            return b"".join(parts)
        if end + 2 + n > len(body):
            return body
        parts.append(body[end + 2 : end + 2 + n])
        at = end + 2 + n + 2


def _same_digest(said: str, data: bytes) -> bool:
    """Whether a labelled digest is that of data; one of an unknown kind counts as right."""
    kind, _, value = said.partition(":")
    if kind.lower() not in ("sha1", "sha-1", "sha256", "sha-256", "md5"):
        return True
    digest = hashlib.new(kind.lower().replace("-", ""), data).digest()
    return value.rstrip("=").upper() == base64.b32encode(digest).decode().rstrip("=") or value.lower() == digest.hex()


def _headers(lines: list[bytes]) -> dict[str, str]:
    found: dict[str, str] = {}
    last = None
    for line in lines:
        if line[:1] in (b" ", b"\t") and last:
            found[last] += " " + line.decode("utf-8", "replace").strip()
            continue
        name, colon, value = line.partition(b":")
        if not colon:
            raise WarcError(f"header line without colon: {line[:80]!r}")
        found[last := name.strip().decode("latin-1").lower()] = value.strip().decode("utf-8", "replace")
    return found


class _Members:
    """The bytes of the gzip members of a stream, member by member."""

    def __init__(self, stream):
        self.stream, self.raw, self.ended = stream, b"", False

    def more(self) -> bool:
        """Whether another member starts here; reads a piece if none is at hand."""
        if not self.raw and not self.ended:
            self.raw = self.stream.read(PIECE)
            self.ended = not self.raw
        return bool(self.raw)

    def member(self) -> Iterator[bytes]:
        unpack = zlib.decompressobj(31)
        while not unpack.eof:
            if not self.more():
                raise WarcError("the archive ends within a gzip member")
            try:
                out = unpack.decompress(self.raw, PIECE)
            except zlib.error as bad:
                raise WarcError(f"bad gzip member: {bad}") from bad
            self.raw = unpack.unused_data if unpack.eof else unpack.unconsumed_tail
            if out:
                yield out


def records(stream) -> Iterator[Record]:
    """The records of an archive in order. Cut-off members, wrong lengths and wrong digests raise WarcError."""
    members = _Members(stream)
    while members.more():
        pieces = members.member()
        buffer = bytearray()
        cut = -1
        for piece in pieces:
            start = max(0, len(buffer) - 3)
            buffer += piece
            if (cut := buffer.find(b"\r\n\r\n", start)) >= 0:
                break
        if cut < 0:
            raise WarcError("a record without end of headers")
        lines = bytes(buffer[:cut]).split(b"\r\n")
        if not re.fullmatch(rb"WARC/\d+\.\d+", lines[0]):
            raise WarcError(f"not a WARC record: {lines[0][:40]!r}")
        headers = _headers(lines[1:])
        try:
            length = int(headers["content-length"])
        except (KeyError, ValueError) as bad:
            raise WarcError("a record without a valid Content-Length") from bad
        del buffer[: cut + 4]
        for piece in pieces:
            buffer += piece
            if len(buffer) > length + 4:
                raise WarcError("a record longer than its Content-Length")
        if bytes(buffer[length:]) != b"\r\n\r\n":
            raise WarcError("Content-Length doesn't fit the record")
        found = Record(headers, bytes(buffer[:length]))
        if not _same_digest(headers.get("warc-block-digest", ""), found.block):
            raise WarcError(f"warc-block-digest of {found.record_id} doesn't fit")
        said = headers.get("warc-payload-digest", "")
        if said and headers.get("warc-type") == "response" and not _same_digest(said, found.payload() or b""):
            # some writers take it from the body as it was sent
            if not found.has_http or not _same_digest(said, found.http()[1]):
                raise WarcError(f"warc-payload-digest of {found.record_id} doesn't fit")
        yield found


def _record_urn(page_id: int | None, mark: int) -> str:
    """The record id of a page's row; mark tells rows with the same page_id, or none, apart."""
    return uuid.uuid5(uuid.NAMESPACE_URL, f"page/{page_id}/{mark}").urn


def _number(text: str | None) -> int | None:
    return int(text) if text and re.fullmatch(r"-?\d+", text) else None


def payload(html: Column) -> Column:
    return F.encode(F.coalesce(html.cast("string"), F.lit("")), "UTF-8")


def with_roles(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, mark, refers_to and refers_to_mark of each row of pages; a row is told by page_id and mark.

    Of equal payloads of least_bytes or more, the row with the largest page_id is the response and the others refer to
    it. Rows that repeat that page_id are responses too, and null ids count as the least; a page_id that is no whole
    number is refused with TypeError. Only digests of payloads that occur twice are joined back: that table is written
    first, so it is broadcast if small, else AQE splits a hot one. mark is the row's place in the table, which a table
    that is read again keeps.
    """
    if not isinstance(pages.schema["page_id"].dataType, (IntegralType, NullType)):
        raise TypeError("page_id must be of a whole-number type")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), payload(F.col("html")).alias("payload"))
    rows = rows.withColumn("mark", F.monotonically_increasing_id()).withColumn("digest", F.sha1("payload"))
    long_enough = F.length("payload") >= least_bytes
    many = rows.where(long_enough).groupBy("digest").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("k"), F.max_by("mark", "page_id").alias("first_mark")).where("k > 1 and first is not null")
    many = materialize(many.select(F.col("digest").alias("d2"), "first", "first_mark"), "warc-repeats")
    again = long_enough & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    joined = rows.join(many, F.col("digest") == F.col("d2"), "left")
    return joined.select("page_id", "url", "payload", "mark", F.when(again, F.col("first")).alias("refers_to"), F.when(again, F.col("first_mark")).alias("refers_to_mark"))


def write_archives(pages: DataFrame, place: str, least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes a record for every row of pages to archives below place; one row per file: path, records.

    A task writes files of about file_bytes, each under its name only once whole, so lost and repeated tasks leave no
    half files. Null urls are empty ones; an empty table gives no files.
    """
    rows = with_roles(pages, least_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        rows_in = (row for batch in batches for row in rows_of(batch, "page_id", "url", "payload", "mark", "refers_to", "refers_to_mark"))
        members = (record(_record_urn(i, mark), url, body, date, None if first is None else _record_urn(first, first_mark), pages=(i, first)) for i, url, body, mark, first, first_mark in rows_in)
        head = next(members, None)
        while head is not None:
            path, size, n = f"{place}/part-{task:05d}-{number:04d}.warc.gz", 0, 0
            with written(path) as out:
                while head is not None and (not n or size + len(head) <= file_bytes):
                    out.write(head)
                    size, n, head = size + len(head), n + 1, next(members, None)
            number += 1
            yield pa.RecordBatch.from_pydict({"path": [path], "records": pa.array([n], pa.int64())})

    return materialize(rows.mapInArrow(run, "path string, records long"), "warc-files")


def read_archives(files: DataFrame, tasks: int | None = None) -> DataFrame:
    """One row per record of the archives in files (path): record_id, url, page_id, record_type, refers_to, payload, payload_bytes, payload_digest.

    payload: of responses and resources; its length and digest also of revisits that state them. They are null for
    other records; ids of pages are null in archives of other writers.
    """
    schema = "record_id string, url string, page_id long, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("record_id", pa.string()), ("url", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])
        for batch in batches:
            for (path,) in rows_of(batch, "path"):
                with read_stream(path) as stream:
                    rows, size = [], 0
                    for r in records(stream):
                        body = r.payload()
                        said = r.headers.get("warc-payload-digest", "").partition(":")[2] or None
                        n = len(body) if body is not None else _number(r.http()[0].get("content-length")) if r.has_http else None
                        rows.append((r.record_id, r.headers.get("warc-target-uri"), _number(r.headers.get(PAGE_ID.lower())), r.headers.get("warc-type", ""), _number(r.headers.get(REFERS_TO_PAGE.lower())), body, n, said or (sha1_base32(body) if body is not None else None)))
                        size += len(body or b"")
                        if size > 4 << 20 or len(rows) >= 2000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kinds)], schema=kinds)
                            rows, size = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kinds)], schema=kinds)

    many = tasks or max(1, files.count())
    return files.select("path").repartition(many).mapInArrow(run, schema)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    found = read_archives(write_archives(pages, new_place(spark, "warc")))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
