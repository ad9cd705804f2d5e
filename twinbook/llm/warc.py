"""WARC records in ZIP packages: writing them, and reading without extraction.

A package is a ZIP file whose members are stored, not compressed:
``archive/data.warc.gz`` (each record a gzip member of its own) and
``indexes/index.tsv`` (offset and length of each record in that member). The
reader parses the end record, the ZIP64 records and the central directory,
finds both members, and reads the ranges that the index names. Packages are
kept as binary rows of a Parquet table in the session's shared folder, at most
about PACKAGE bytes of payload in each, so that no file passes through one task.

Edge cases: null html is an empty payload; a null url leaves the target header
out; records of equal payloads of at least ``least`` bytes become revisits of the
record with the largest page_id (rows that share this id are all responses, a null
id counts as smaller than any); repeated rows are records of their own; an empty
table writes no package and reads no record.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, shared_dir

PACKAGE = 4 << 20
#: Tasks over which pages of one payload are dealt.
SALTS = 16
MEMBERS = ("archive/data.warc.gz", "indexes/index.tsv")


def warc_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One gzip member with a response, or with a revisit, whose block has the HTTP head only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    kind = "response" if refers_to is None else "revisit"
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id}|{kind}|{digest}')}>",
        f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="%/:=&?~#+!$,;'@()*[]"))
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-Id: {refers_to}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def parse_record(packed: bytes) -> dict:
    """Headers (lower-case names), http headers and payload of one gzip member."""
    raw = zlib.decompress(packed, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = _fields(head)
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return {"headers": fields, "http": _fields(http), "payload": payload}


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")[1:]
    return {name.lower(): value.strip() for name, _, value in (line.partition(":") for line in lines)}


def zip_package(members: list[tuple[str, bytes]], zip64: bool = False) -> bytes:
    """A ZIP file of stored members; ZIP64 fields where sizes need them, or always if ``zip64``."""
    out, directory = io.BytesIO(), []
    big = lambda n: zip64 or n >= 0xFFFFFFFF
    for name, data in members:
        at, crc, size, raw = out.tell(), zlib.crc32(data), len(data), name.encode()
        wide = big(size) or big(at)
        extra = struct.pack("<HHQQ", 1, 16, size, size) if wide else b""
        shown = 0xFFFFFFFF if wide else size
        out.write(struct.pack("<4sHHHHHIIIHH", b"PK\3\4", 45 if wide else 20, 0x800, 0, 0, 33, crc, shown, shown, len(raw), len(extra)) + raw + extra + data)
        extra = struct.pack("<HHQQQ", 1, 24, size, size, at) if wide else b""
        directory.append(struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\1\2", 45, 45 if wide else 20, 0x800, 0, 0, 33, crc, shown, shown, len(raw), len(extra), 0, 0, 0, 0, 0xFFFFFFFF if wide else at) + raw + extra)
    start, body = out.tell(), b"".join(directory)
    out.write(body)
    n, wide = len(members), big(start)
    if wide:
        end = out.tell()
        out.write(struct.pack("<4sQHHIIQQQQ", b"PK\6\6", 44, 45, 45, 0, 0, n, n, len(body), start))
        out.write(struct.pack("<4sIQI", b"PK\6\7", 0, end, 1))
    out.write(struct.pack("<4sHHHHIIH", b"PK\5\6", 0, 0, 0xFFFF if wide else n, 0xFFFF if wide else n, 0xFFFFFFFF if wide else len(body), 0xFFFFFFFF if wide else start, 0))
    return out.getvalue()


#: Reads bytes [offset, offset + length) of a package.
Reader = Callable[[int, int], bytes]


def zip_members(read: Reader, size: int) -> dict[str, tuple[int, int, int]]:
    """Name -> (data offset, length, method) from the central directory of a package of ``size`` bytes."""
    tail_at = max(0, size - 65557)
    tail = read(tail_at, size - tail_at)
    at = tail.rfind(b"PK\5\6")
    if at < 0:
        raise ValueError("no end of central directory")
    n, length, start = struct.unpack_from("<HII", tail, at + 10)
    if n == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF:
        mark, _, end64, _ = struct.unpack("<4sIQI", read(tail_at + at - 20, 20))
        if mark != b"PK\6\7":
            raise ValueError("no ZIP64 locator")
        length, start = struct.unpack_from("<QQ", read(end64, 56), 40)
    body, found, at = read(start, length), {}, 0
    while at < len(body):
        mark, _, _, _, method, _, _, _, packed, full, n_name, n_extra, n_note, _, _, _, local = struct.unpack_from("<4sHHHHHHIIIHHHHHII", body, at)
        if mark != b"PK\1\2":
            raise ValueError("bad central directory")
        name = body[at + 46 : at + 46 + n_name].decode()
        extra = body[at + 46 + n_name : at + 46 + n_name + n_extra]
        full, packed, local = _wide(extra, full, packed, local)
        local_names = struct.unpack_from("<HH", read(local, 30), 26)
        found[name] = (local + 30 + sum(local_names), packed, method)
        at += 46 + n_name + n_extra + n_note
    return found


def _wide(extra: bytes, *values: int) -> list[int]:
    """Sizes and offset, those of 0xFFFFFFFF replaced from the ZIP64 field, in its order."""
    out, at = list(values), 0
    while at + 4 <= len(extra):
        kind, size = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            place = at + 4
            for i, v in enumerate(out):
                if v == 0xFFFFFFFF:
                    out[i] = struct.unpack_from("<Q", extra, place)[0]
                    place += 8
        at += 4 + size
    return out


def records(read: Reader, size: int) -> Iterator[dict]:
    """The records of a package, each by one range read at the place that the index names."""
    members = zip_members(read, size)
    if any(members[m][2] for m in MEMBERS):
        raise ValueError("members must be stored")
    base, index = members[MEMBERS[0]][0], members[MEMBERS[1]]
    for line in read(index[0], index[1]).decode().splitlines():
        offset, length = map(int, line.split("\t"))
        yield parse_record(read(base + offset, length))


def write_packages(pages: DataFrame, path: str, least: int = 1000) -> None:
    """Write pages (page_id, url, html) as packages: a Parquet table of (package, bytes) at ``path``."""
    bounded_batches(pages.sparkSession)
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), F.sha1(F.encode(html, "UTF-8")).alias("digest"))
    long_ = rows.where(F.octet_length("html") >= least)
    groups = long_.groupBy("digest").agg(F.count("*").alias("n"), F.max("page_id").alias("first")).where("n > 1").select("digest", "first")
    # A very common payload is dealt over SALTS tasks.
    groups = groups.withColumn("salt", F.explode(F.array(*(F.lit(k).cast("long") for k in range(SALTS)))))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS))).join(groups, ["digest", "salt"], "left")

    def pack(batches):
        body, index, size, at = [], [], 0, 0

        def package():
            data = zip_package([(MEMBERS[0], b"".join(body)), (MEMBERS[1], "".join(index).encode())])
            return pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), pa.array([data], pa.binary())], ["package", "bytes"])

        for batch in batches:
            for page_id, url, text, digest, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                payload = text.encode()
                record = warc_record(page_id, url, payload, digest, first if first != page_id else None)
                body.append(record)
                index.append(f"{at}\t{len(record)}\n")
                at += len(record)
                size += len(payload)
                if size >= PACKAGE:
                    yield package()
                    body, index, size, at = [], [], 0, 0
        if body:
            yield package()

    rows.select("page_id", "url", "html", "digest", "first").mapInArrow(pack, "package string, bytes binary").write.option(
        "parquet.page.size.row.check.min", "1"
    ).option("compression", "none").parquet(path)


def read_packages(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to) of all records."""
    bounded_batches(spark)

    def unpack(batches):
        for batch in batches:
            for blob in batch.column(0):
                view = memoryview(blob.as_buffer())
                rows = []
                for r in records(lambda offset, length: bytes(view[offset : offset + length]), len(view)):
                    h, revisit = r["headers"], r["headers"]["warc-type"] == "revisit"
                    digest = h["warc-payload-digest"].removeprefix("sha1:")
                    if not revisit and hashlib.sha1(r["payload"]).hexdigest() != digest:
                        raise ValueError(f"record {h['warc-record-id']}: payload and digest differ")
                    number = lambda name: int(h[name]) if name in h else None
                    rows.append((number("x-page-id"), h.get("warc-target-uri"), None if revisit else r["payload"], int(r["http"]["content-length"]), digest, h["warc-type"], number("x-refers-to-page-id")))
                kinds = (pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return spark.read.parquet(path).select("bytes").mapInArrow(
        unpack, "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"
    )


def new_store(spark: SparkSession) -> str:
    """A fresh path for packages in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
