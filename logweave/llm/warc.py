"""WARC archives: one gzip member per record, written per partition and read back sequentially.

Writing: of records with equal payloads of at least `min_bytes` the one with the largest page_id is a response,
the others are revisits that refer to it; the largest page_id of each digest comes from a partially aggregated
group, and a digest that holds many rows is split by the adaptive skew join. Reading: compressed blocks are inflated
piece by piece, a record's block is as long as its Content-Length says and its gzip member must end with it, and the
payload's digest is computed while it is read and compared with the header.

A null html is an empty payload. A null page_id can only be a response if all rows of its payload have none. Repeated
rows of a response's page_id and payload are all responses. An empty table writes no archive. Extra columns are not
read; of several rows with a payload's largest page_id all are responses. A payload of any length is written and read in
memory proportional to it, or to a piece of it when reading.

Archives of others are read, too. A record whose block is no HTTP message (warcinfo, metadata, resource, conversion) has
its whole block as payload. Without a SHA-1 digest in its header a record gets the digest that was computed, and
digest_ok is null; a digest that does not agree gives digest_ok false, and the header's digest. A revisit without an
HTTP head has no payload size (null) and no digest but the header's. page_id and refers_to are null unless they are
this writer's. Archives that are cut off or malformed raise ValueError with the number and byte offset of the record.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm.files import opened, written
from logweave.llm.session import new_folder

MIN_BYTES, ARCHIVE_BYTES, LEVEL, PIECE = 0, 64 << 20, 4, 1 << 16
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, digest_ok boolean"


def digest32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def page_of(name: str) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", name)
    return int(found[1]) if found else None


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, revisit: bool = False) -> bytes:
    """One record: an HTTP response, or a revisit with the response's head only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        "WARC-Date: 2024-01-01T00:00:00Z",
        f"WARC-Target-URI: {quote(url or 'about:blank', safe=':/?#[]@!$&()*+,;=%~')}",
        f"WARC-Payload-Digest: sha1:{digest32(hashlib.sha1(payload).digest())}",
        f"Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


@dataclass
class Record:
    headers: dict[str, str]
    http: dict[str, str]
    payload_bytes: int
    sha1: bytes
    payload: bytes | None


class _Member:
    """The inflated bytes of one gzip member, a piece at a time."""

    def __init__(self, stream, rest: bytes):
        self.stream, self.raw, self.out, self.taken = stream, rest, b"", len(rest)
        self.inflate = zlib.decompressobj(31)

    def more(self) -> bool:
        while not self.inflate.eof:
            if not self.raw:
                self.raw = self.stream.read(PIECE)
                self.taken += len(self.raw)
                if not self.raw:
                    raise ValueError("the archive ends within a record")
            try:
                got = self.inflate.decompress(self.raw, PIECE)
            except zlib.error as e:
                raise ValueError(f"no gzip member: {e}") from None
            self.raw = self.inflate.unconsumed_tail or (self.inflate.unused_data if self.inflate.eof else b"")
            if got:
                self.out += got
                return True
        return False

    def until(self, mark: bytes) -> bytes:
        while mark not in self.out:
            if not self.more():
                raise ValueError("a header does not end")
        head, _, self.out = self.out.partition(mark)
        return head

    def pieces(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.out and not self.more():
                raise ValueError("a block is shorter than its Content-Length")
            got, self.out = self.out[:n], self.out[n:]
            n -= len(got)
            yield got


def _fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}


def records(stream, keep_payload: bool = False) -> Iterator[Record]:
    """All records of an archive, in order; memory holds a piece of one (or its payload, if it is to be kept)."""
    rest, number, offset = b"", 0, 0
    while True:
        rest = rest or stream.read(PIECE)
        if not rest:
            return
        m = _Member(stream, rest)
        try:
            head = m.until(b"\r\n\r\n")
            if not head.startswith(b"WARC/"):
                raise ValueError("no WARC header")
            headers = _fields(head)
            if not headers.get("content-length", "").isdecimal():
                raise ValueError("no Content-Length")
            left = int(headers["content-length"])
            is_http = headers.get("content-type", "").lower().startswith("application/http")
            http, sha1, size, kept, before = None if is_http else {}, hashlib.sha1(), 0, [], b""
            for piece in m.pieces(left):
                if http is None:
                    before += piece
                    if b"\r\n\r\n" not in before:
                        continue
                    first, _, piece = before.partition(b"\r\n\r\n")
                    http = _fields(first)
                sha1.update(piece)
                size += len(piece)
                if keep_payload:
                    kept.append(piece)
            if b"".join(m.pieces(4)) != b"\r\n\r\n" or m.out or m.more():
                raise ValueError("a record does not end with its gzip member")
        except ValueError as e:
            raise ValueError(f"record {number} at byte {offset}: {e}") from None
        rest, number, offset = m.raw, number + 1, offset + m.taken - len(m.raw)
        yield Record(headers, http or {}, size, sha1.digest(), b"".join(kept) if keep_payload else None)


def plan(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """pages with the page_id of the response of their payload."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.sha1(html.cast("binary")).alias("sha1"))
    first = pages.select("page_id", F.sha1(html.cast("binary")).alias("sha1")).groupBy("sha1").agg(F.max("page_id").alias("first"))
    joined = rows.join(first, "sha1")
    alone = (F.octet_length("html") < min_bytes) | F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select("page_id", "url", "html", "first", (~alone).alias("revisit"))


def write(pages: DataFrame, folder: str | None = None, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Write all pages to archives below folder; (path, records, bytes) of each."""
    spark = pages.sparkSession
    folder = folder or new_folder(spark, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(b[c].to_pylist() for c in ("page_id", "url", "html", "first", "revisit"))))
        row, number = next(rows, None), 0
        while row is not None:
            # only the archives of tasks that succeeded are in the list, so a repeated task takes a new name
            path = f"{folder}/part-{TaskContext.get().partitionId():06d}-{number:04d}-{uuid.uuid4().hex[:8]}.warc.gz"
            size = count = 0
            with written(path) as f:
                while row is not None and size < ARCHIVE_BYTES:
                    page, url, html, first, revisit = row
                    data = member(record(page, url, html.encode(), first, revisit))
                    f.write(data)
                    size, count = size + len(data), count + 1
                    row = next(rows, None)
            number += 1
            yield pa.record_batch([pa.array([path]), pa.array([count], pa.int64()), pa.array([size], pa.int64())], names=["path", "records", "bytes"])

    schema = "path string, records long, bytes long"
    plan(pages, min_bytes).mapInArrow(run, schema).write.parquet(f"{folder}/list")
    return spark.read.schema(schema).parquet(f"{folder}/list")


def described(r: Record) -> tuple[int | None, int | None, str | None, str | None, int | None, str | None, bool | None]:
    """The row of a record (see SCHEMA)."""
    name, _, given = r.headers.get("warc-payload-digest", "").partition(":")
    given = given.strip().upper() if name.strip().lower() == "sha1" else None
    kind, target = r.headers.get("warc-type"), None
    if kind == "revisit":
        length = r.http.get("content-length", "")
        size, digest, ok = int(length) if length.isdecimal() else None, given, True if given else None
        target = page_of(r.headers.get("warc-refers-to", ""))
    else:
        size, computed = r.payload_bytes, digest32(r.sha1)
        digest, ok = given or computed, given == computed if given else None
    return page_of(r.headers.get("warc-record-id", "")), size, digest, kind, target, r.headers.get("warc-target-uri"), ok


def read(archives: DataFrame) -> DataFrame:
    """One row per record of all archives; each archive is read by one task, in order."""

    def rows(path: str) -> Iterator[tuple]:
        with opened(path) as stream:
            for r in records(stream):
                yield described(r)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.bool_()]
        for batch in batches:
            for path in batch["path"].to_pylist():
                out = []
                for row in rows(path):
                    out.append(row)
                    if len(out) == 4096:
                        yield pa.record_batch([pa.array(v, k) for v, k in zip(zip(*out), kinds)], names=names)
                        out = []
                if out:
                    yield pa.record_batch([pa.array(v, k) for v, k in zip(zip(*out), kinds)], names=names)

    n = max(1, archives.count())
    return archives.select("path").repartition(n).mapInArrow(run, SCHEMA)
