"""WARC archives in ZIP packages: written by tasks, read by byte ranges without unpacking.

A package holds ``archive/data.warc.gz`` (one gzip member per record) and ``indexes/index.cdxj`` (one line per record with its
range), both stored, not compressed. The reader parses the end record, the ZIP64 records if there are any and the central
directory, finds where the stored members lie and then reads single records at their offsets.

Packages get a new name per attempt, and only those that a committed task reports are listed; a lost task leaves a package
that nobody reads.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagegraph.llm.common import new_folder, saved

LEAST = 100  # bytes from which equal payloads become revisits
PACKAGE = 32 << 20  # bytes of records after which a package ends
SPAN = 8 << 20  # bytes of a package that a reading task takes together
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
# Fixed values of the WARC standard.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"  # the table has no date of capture


# ZIP packages of stored members


def zip_stored(members: list[tuple[str, bytes]], zip64: bool = False) -> bytes:
    """A ZIP archive of stored members; ZIP64 records where sizes or offsets need them, or everywhere if asked."""
    big, out, central = 0xFFFFFFFF, bytearray(), bytearray()
    for name, data in members:
        raw, at, crc, n = name.encode(), len(out), zlib.crc32(data), len(data)
        wide = zip64 or n >= big or at >= big
        size, place = (big, big) if wide else (n, at)
        local = struct.pack("<HHQQ", 1, 16, n, n) if wide else b""
        extra = struct.pack("<HHQQQ", 1, 24, n, n, at) if wide else b""
        version = 45 if wide else 20
        out += struct.pack("<IHHHHHIIIHH", 0x04034B50, version, 0x800, 0, 0, 33, crc, size, size, len(raw), len(local)) + raw + local
        out += data
        central += struct.pack("<IHHHHHHIIIHHHHHII", 0x02014B50, version, version, 0x800, 0, 0, 33, crc, size, size,
                               len(raw), len(extra), 0, 0, 0, 0, place) + raw + extra
    at, n = len(out), len(members)
    out += central
    wide = zip64 or at >= big or n >= 0xFFFF
    if wide:
        out += struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, n, n, len(central), at)
        out += struct.pack("<IIQI", 0x07064B50, 0, at + len(central), 1)
    few = 0xFFFF if wide else n
    out += struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, few, few, big if wide else len(central), big if wide else at, 0)
    return bytes(out)


def range_of(f: BinaryIO, at: int, n: int) -> bytes:
    f.seek(at)
    return f.read(n)


def zip_members(f: BinaryIO, size: int) -> dict[str, tuple[int, int, int]]:
    """Members of a ZIP file: name to (offset of its data, packed size, method), from the directory alone."""
    tail_at = max(0, size - (22 + 0xFFFF))
    tail = range_of(f, tail_at, size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("not a ZIP file: no end record")
    n, directory_size, directory_at = struct.unpack_from("<HII", tail, end + 10)
    if n == 0xFFFF or directory_size == 0xFFFFFFFF or directory_at == 0xFFFFFFFF:
        locator = range_of(f, tail_at + end - 20, 20)
        if locator[:4] == b"PK\x06\x07":
            record = range_of(f, struct.unpack_from("<Q", locator, 8)[0], 56)
            if record[:4] != b"PK\x06\x06":
                raise ValueError("damaged ZIP64 end record")
            n, directory_size, directory_at = struct.unpack_from("<QQQ", record, 32)
    directory, at, out = range_of(f, directory_at, directory_size), 0, {}
    for _ in range(n):
        if directory[at:at + 4] != b"PK\x01\x02":
            raise ValueError("damaged central directory")
        method, = struct.unpack_from("<H", directory, at + 10)
        packed, whole, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", directory, at + 20)
        local, = struct.unpack_from("<I", directory, at + 42)
        name = directory[at + 46:at + 46 + n_name].decode()
        extra, i = directory[at + 46 + n_name:at + 46 + n_name + n_extra], 0
        while i + 4 <= len(extra):
            kind, length = struct.unpack_from("<HH", extra, i)
            if kind == 1:  # the fields that did not fit, in this order
                wide = i + 4
                if whole == 0xFFFFFFFF:
                    wide += 8
                if packed == 0xFFFFFFFF:
                    packed, = struct.unpack_from("<Q", extra, wide)
                    wide += 8
                if local == 0xFFFFFFFF:
                    local, = struct.unpack_from("<Q", extra, wide)
            i += 4 + length
        head = range_of(f, local, 30)
        n_name_here, n_extra_here = struct.unpack_from("<HH", head, 26)
        out[name] = (local + 30 + n_name_here + n_extra_here, packed, method)
        at += 46 + n_name + n_extra + n_comment
    return out


# WARC records


def record_id(page_id: int | None) -> str:
    """A version 8 UUID that holds the page id."""
    x = (page_id or 0) & 0xFFFFFFFFFFFFFFFF
    fields = ((x & 0xFFFFFFFFFFFF) << 80) | (8 << 76) | ((x >> 48 & 0xFFF) << 64) | (2 << 62) | (x >> 60)
    return f"<urn:uuid:{uuid.UUID(int=fields)}>"


def page_of(record: str) -> int:
    x = uuid.UUID(record.strip("<>").removeprefix("urn:uuid:")).int
    n = (x >> 80) | ((x >> 64 & 0xFFF) << 48) | ((x & 0xF) << 60)
    return n - (1 << 64) if n >> 63 else n


def line_safe(s: str | None) -> str:
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in s or "")


def make_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response record, or a revisit of the response of page ``refers_to``."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Target-URI: {line_safe(url)}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers(block: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = block.partition(b"\r\n\r\n")
    pairs = (line.partition(b":") for line in head.split(b"\r\n")[1:])
    return {k.decode().lower(): v.strip().decode() for k, _, v in pairs}, rest


def parse_record(data: bytes) -> dict:
    """Fields of one record; the payload's size and digest are those of the full payload, also for revisits."""
    warc, rest = headers(data)
    http, payload = headers(rest[:int(warc["content-length"])])
    revisit = warc["warc-type"] == "revisit"
    digest = warc["warc-payload-digest"].removeprefix("sha256:")
    if not revisit and hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError(f"damaged payload in {warc['warc-record-id']}")
    return {
        "page_id": int(warc["x-page-id"]) if "x-page-id" in warc else None, "url": warc["warc-target-uri"],
        "record_type": warc["warc-type"], "payload_bytes": int(http["content-length"]) if revisit else len(payload),
        "payload_digest": digest, "refers_to": page_of(warc["warc-refers-to"]) if revisit else None,
        "payload": None if revisit else payload,
    }


# Spark jobs


def with_revisits(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Pages as (page_id, url, payload, digest, refers_to), each payload's first page by id being the one referred to.

    A null html is the empty payload. Null ids come last; rows that repeat the smallest id are all responses, and so are copies
    that have no id between them. Other columns are not read.
    """
    rows = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    long = rows.filter(F.length("payload") >= least)
    groups = long.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null")
    others = (
        long.select("page_id", "digest").join(groups, "digest").filter(~F.col("page_id").eqNullSafe(F.col("first")))
        .select(F.coalesce("page_id", F.lit(0)).alias("id"), F.col("page_id").isNull().alias("no_id"), F.col("digest").alias("of"), "first")
        .distinct()
    )
    same = (
        (F.coalesce(rows["page_id"], F.lit(0)) == others["id"]) & (rows["page_id"].isNull() == others["no_id"])
        & (rows["digest"] == others["of"])
    )
    return rows.join(others, same, "left").select("page_id", "url", "payload", "digest", F.col("first").alias("refers_to"))


def write(pages: DataFrame, folder: str | None = None, least: int = LEAST, package: int = PACKAGE) -> DataFrame:
    """Writes a record per page into ZIP packages below ``folder`` (a URI); one row per package: path, n_records, n_bytes."""
    folder = folder or new_folder(pages.sparkSession, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        data, index = bytearray(), []

        def close() -> pa.RecordBatch:
            name = f"{uuid.uuid4().hex}.wacz"
            blob = zip_stored([(DATA, bytes(data)), (INDEX, "".join(index).encode())])
            with files.open_output_stream(f"{root}/{name}") as f:
                f.write(blob)
            return pa.RecordBatch.from_arrays(
                [pa.array([f"{folder}/{name}"]), pa.array([len(index)], pa.int64()), pa.array([len(blob)], pa.int64())],
                names=["path", "n_records", "n_bytes"],
            )

        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, payload, digest, refers_to = (c[i].as_py() for c in batch.columns)
                gz = zlib.compressobj(6, zlib.DEFLATED, 31)
                record = gz.compress(make_record(page_id, url, payload, digest, refers_to)) + gz.flush()
                place = {"offset": len(data), "length": len(record), "digest": f"sha256:{digest}"}
                index.append(f"{line_safe(url).replace(' ', '%20') or '-'} {DATE} {json.dumps(place)}\n")
                data += record
                if len(data) >= package:
                    yield close()
                    data, index = bytearray(), []
        if index:
            yield close()

    rows = with_revisits(pages, least)
    return saved(rows.mapInArrow(run, "path string, n_records long, n_bytes long"), "warc-list")


def index(packages: DataFrame) -> DataFrame:
    """Where each record of the packages (column ``path``) lies: path, at, length, from directories and indexes alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for path in batch.column(0).to_pylist():
                files, name = fs.FileSystem.from_uri(path)
                with files.open_input_file(name) as f:
                    members = zip_members(f, f.size())
                    for need in (DATA, INDEX):
                        if members[need][2] != 0:
                            raise ValueError(f"{need} in {path} is compressed")
                    at, n, _ = members[INDEX]
                    lines = range_of(f, at, n).splitlines()
                places = [json.loads(line[line.index(b"{"):]) for line in lines]
                base = members[DATA][0]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path] * len(places), pa.string()), pa.array([base + p["offset"] for p in places], pa.int64()),
                     pa.array([p["length"] for p in places], pa.int64())], names=["path", "at", "length"],
                )

    return packages.select("path").mapInArrow(run, "path string, at long, length long")


RECORD = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def read(packages: DataFrame) -> DataFrame:
    """The records of the packages, one row each, read by range; no package, no rows."""
    # index rows say little about the bytes behind them, so their number of partitions follows the packages' sizes
    size = packages.agg(F.sum("n_bytes").alias("n")).first()["n"] or 0
    spans = index(packages).repartition(size // SPAN + 1, "path", F.floor(F.col("at") / SPAN)).sortWithinPartitions("path", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        kind = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()),
                          ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
        path, f, out, size = None, None, [], 0
        for batch in batches:
            for name, at, length in zip(*(c.to_pylist() for c in batch.columns)):
                if name != path:
                    if f:
                        f.close()
                    files, inner = fs.FileSystem.from_uri(name)
                    path, f = name, files.open_input_file(inner)
                out.append(parse_record(zlib.decompress(range_of(f, at, length), 31)))
                size += out[-1]["payload_bytes"]
                if size > 4_000_000:
                    yield pa.RecordBatch.from_pylist(out, schema=kind)
                    out, size = [], 0
        if f:
            f.close()
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=kind)

    return spans.mapInArrow(run, RECORD)
