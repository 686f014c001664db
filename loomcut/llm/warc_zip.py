"""WARC records inside ZIP packages, written and read by ranges.

``write`` packs records into archives in the shared folder: a ZIP whose members
are stored, not compressed: ``archive/data.warc.gz`` (one gzip member for each
record) and ``indexes/index.cdx`` (offset, length and id of each record).
``read`` finds a member through the end-of-central-directory record, its ZIP64
form if there, and the central directory, then fetches records by range; an
archive is never unpacked.  Both use ``pyarrow.fs``, so local, HDFS and object
stores work alike.

Records with equal payloads of at least ``LEAST_REVISIT`` bytes are written
once, as the response of the largest page_id; the others revisit it.  Which
row is which is decided on digests alone; payloads aren't shuffled, but for
those of the few rows whose key meets a bit of the revisits' filter.

Defined results: null html is an empty payload; a null page_id is below every
other and returned as null; rows that repeat the largest page_id and its payload
are all responses; an empty table gives no rows.  An archive is named by a
random id and only known through the written manifest, so those of lost or
repeated tasks are never read.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbuf as tb
from .runtime import cut, shared_dir
from .sieve import anti

LEAST_REVISIT = 1000
#: An archive is closed when its records reach this size.
ARCHIVE_BYTES = 64 << 20
#: Bytes of neighbouring records that are fetched at once.
RANGE_BYTES = 4 << 20
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdx"


@dataclass
class Member:
    """Where a stored member's bytes are."""

    name: str
    method: int
    size: int
    packed: int
    header: int


def _read(f: pa.NativeFile, at: int, n: int) -> bytes:
    f.seek(at)
    out = f.read(n)
    if len(out) != n:
        raise ValueError("the archive ends early")
    return out


def directory(f: pa.NativeFile) -> dict[str, Member]:
    """Members of a ZIP, from its central directory."""
    size = f.size()
    tail_at = max(0, size - 65577)  # the longest comment, the record, and the ZIP64 locator before it
    tail = _read(f, tail_at, size - tail_at)
    k = tail.rfind(b"PK\x05\x06")
    while k >= 0 and (k + 22 > len(tail) or k + 22 + struct.unpack_from("<H", tail, k + 20)[0] != len(tail)):
        k = tail.rfind(b"PK\x05\x06", 0, k)
    if k < 0:
        raise ValueError("no end of central directory")
    n, length, start = struct.unpack_from("<HII", tail, k + 10)
    if k >= 20 and tail[k - 20 : k - 16] == b"PK\x06\x07":
        (at,) = struct.unpack_from("<Q", tail, k - 20 + 8)
        end = _read(f, at, 56)
        if end[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end of central directory")
        n, length, start = struct.unpack_from("<QQQ", end, 32)
    raw = _read(f, start, length)
    out, p = {}, 0
    for _ in range(n):
        if raw[p : p + 4] != b"PK\x01\x02":
            raise ValueError("a broken central directory")
        flags, method = struct.unpack_from("<HH", raw, p + 8)
        packed, whole, names, extras, comments = struct.unpack_from("<IIHHH", raw, p + 20)
        (header,) = struct.unpack_from("<I", raw, p + 42)
        name = raw[p + 46 : p + 46 + names].decode("utf-8" if flags & 0x800 else "cp437")
        q, stop = p + 46 + names, p + 46 + names + extras
        while q + 4 <= stop:
            kind, n_extra = struct.unpack_from("<HH", raw, q)
            if kind == 1:  # ZIP64: only the fields that don't fit, in this order
                at = q + 4
                if whole == 0xFFFFFFFF:
                    (whole,), at = struct.unpack_from("<Q", raw, at), at + 8
                if packed == 0xFFFFFFFF:
                    (packed,), at = struct.unpack_from("<Q", raw, at), at + 8
                if header == 0xFFFFFFFF:
                    (header,) = struct.unpack_from("<Q", raw, at)
            q += 4 + n_extra
        out[name] = Member(name, method, whole, packed, header)
        p = stop + comments
    return out


def member_start(f: pa.NativeFile, m: Member) -> int:
    """Position of a stored member's first byte."""
    if m.method != 0:
        raise ValueError(f"{m.name} is compressed; only stored members can be read by ranges")
    head = _read(f, m.header, 30)
    if head[:4] != b"PK\x03\x04":
        raise ValueError("a broken local header")
    names, extras = struct.unpack_from("<HH", head, 26)
    return m.header + 30 + names + extras


def record(page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record as a gzip member."""
    body = b"" if revisit else b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (payload or b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {' '.join((url or '').split())}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {size}",
        f"X-Page-ID: {'' if page_id is None else page_id}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    if revisit:
        head[2:2] = ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-ID: {refers_to}"]
    raw = "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of a record."""
    raw = gzip.decompress(member)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    body = rest[: int(fields["Content-Length"])]
    return fields, body.partition(b"\r\n\r\n")[2]


class Writer:
    """Archives of one task."""

    def __init__(self, folder: str):
        self.fs, self.folder = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        self.scheme = folder.partition("://")[0] + "://" if "://" in folder else ""
        self.data, self.index, self.n = io.BytesIO(), [], 0

    def add(self, raw: bytes, page_id: int | None) -> None:
        self.index.append(f"{self.data.tell()} {len(raw)} {'' if page_id is None else page_id}")
        self.data.write(raw)

    def full(self) -> bool:
        return self.data.tell() >= ARCHIVE_BYTES

    def close(self) -> tuple[str, int]:
        """Write what was added; path and number of records."""
        self.fs.create_dir(self.folder, recursive=True)
        path = f"{self.folder}/{uuid.uuid4().hex}.wacz"
        with self.fs.open_output_stream(path, compression=None) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as z:
            z.writestr(INDEX, "\n".join(self.index))
            with z.open(zipfile.ZipInfo(DATA), "w", force_zip64=True) as m:
                m.write(self.data.getbuffer())
        n = len(self.index)
        self.data, self.index = io.BytesIO(), []
        return path, n


def write(rows: DataFrame, folder: str) -> DataFrame:
    """Archive ``rows`` (``page_id, url, html, size, digest, refers_to, revisit``); ``path, records`` of each archive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = Writer(folder)
        done = lambda x: pa.RecordBatch.from_arrays([pa.array([x[0]]), pa.array([x[1]])], ["path", "records"])
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                for r in batch.slice(i, 256).to_pylist():
                    w.add(record(r["page_id"], r["url"], r["html"], r["size"], r["digest"], r["refers_to"], r["revisit"]), r["page_id"])
                    if w.full():
                        yield done(w.close())
        if w.index:
            yield done(w.close())

    return rows.mapInArrow(tb.lean(run), "path string, records long")


def read(archives: DataFrame, folder: str, kind: str = "bigint") -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of every record of the archives in ``path``.

    A response's length and digest are taken from its payload as read, and must
    be those that its header states.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = fs.FileSystem.from_uri(folder)[0] if "://" in folder else fs.LocalFileSystem()
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with store.open_input_file(path) as f:
                    members = directory(f)
                    index = members[INDEX]
                    lines = _read(f, member_start(f, index), index.size).decode().split("\n")
                    base = member_start(f, members[DATA])
                    entries = [tuple(map(int, x.split(" ")[:2])) for x in lines]
                    i = 0
                    while i < len(entries):
                        j = i + 1
                        while j < len(entries) and entries[j][0] + entries[j][1] - entries[i][0] <= RANGE_BYTES:
                            j += 1
                        block = _read(f, base + entries[i][0], entries[j - 1][0] + entries[j - 1][1] - entries[i][0])
                        out: list[list] = [[], [], [], [], []]
                        for at, n in entries[i:j]:
                            h, payload = parse(block[at - entries[i][0] :][:n])
                            digest, size = h["WARC-Payload-Digest"].removeprefix("sha1:"), int(h["X-Payload-Length"])
                            if h["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
                                raise ValueError(f"{path}: a payload differs from its digest")
                            page, refers = h["X-Page-ID"], h.get("X-Refers-To-Page-ID")
                            for c, v in zip(out, (int(page) if page else None, size, digest, h["WARC-Type"], int(refers) if refers else None)):
                                c.append(v)
                        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2]), pa.array(out[3]), pa.array(out[4], pa.int64())], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
                        i = j

    got = archives.select("path").mapInArrow(tb.lean(run), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    return got if kind == "bigint" else got.withColumn("page_id", F.col("page_id").cast(kind)).withColumn("refers_to", F.col("refers_to").cast(kind))


def with_revisits(pages: DataFrame) -> DataFrame:
    """``page_id, url, html (bytes), size, digest, refers_to, revisit`` of every row."""
    html = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", html.alias("html"), F.length(html).cast("long").alias("size"), F.sha1(html).alias("digest"))
    narrow = cut(rows.select("page_id", "url", "size", "digest"), "payloads")
    many = narrow.where(F.col("size") >= LEAST_REVISIT).groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = F.coalesce(F.col("page_id") < F.col("refers_to"), F.col("refers_to").isNotNull())
    revisits = cut(narrow.where(F.col("size") >= LEAST_REVISIT).join(many, "digest").where(later).select("page_id", "url", "size", "digest", "refers_to"), "revisits")
    key = F.coalesce(F.col("page_id").cast("string"), F.lit("")).alias("page"), F.col("digest")
    responses = anti(rows, revisits.select(*key), list(key))
    columns = ["page_id", "url", "html", "size", "digest", "refers_to", "revisit"]
    responses = responses.withColumn("refers_to", F.lit(None).cast(revisits.schema["refers_to"].dataType)).withColumn("revisit", F.lit(False))
    return responses.select(columns).unionByName(revisits.withColumn("html", F.lit(None).cast("binary")).withColumn("revisit", F.lit(True)).select(columns))


def round_trip(pages: DataFrame) -> DataFrame:
    """Archive every row of ``pages`` and read the archives back."""
    spark = pages.sparkSession
    folder = f"{shared_dir(spark)}/loomcut/wacz-{uuid.uuid4().hex}"
    manifest = cut(write(with_revisits(pages), folder), "manifest")
    n = max(1, manifest.count())
    return read(manifest.repartition(min(n, 10_000), "path"), folder, pages.schema["page_id"].dataType.simpleString())
