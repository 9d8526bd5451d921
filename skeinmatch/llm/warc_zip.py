"""WARC records in ZIP archives (operator 5): a writer, and a reader that range-reads single records.

An archive has two stored members: data.warc.gz, where each record is a gzip member of its own, one after another, and
index.cdxj, one line a record with its place. The directory is written in ZIP64 form, and entries without it are understood too. The
reader takes the end record from the file's tail, then the central directory, then the index, and reads each record by its range;
nothing is extracted. It takes archives of other writers too: with comments, with a deflated index, with plain records.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import struct
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_uri, bounded, fresh_path, open_fs, trimmed, written

#: Equal payloads from this size on are written once.
REVISIT_BYTES = 100
#: Effort of the compression, 1 to 9.
LEVEL = 5
#: Bytes of compressed records after which a task begins another archive.
ARCHIVE_BYTES = 32 << 20
#: How far apart two records may be and still come in one read.
READ_BYTES = 4 << 20
WARC_MEMBER, INDEX_MEMBER = "archive/data.warc.gz", "indexes/index.cdxj"


def zip_bytes(members: list[tuple[str, bytes]]) -> bytes:
    """An archive of stored members with ZIP64 sizes and directory."""
    out, central = [], []
    at = 0
    for name, data in members:
        n, crc = name.encode(), zlib.crc32(data)
        extra = struct.pack("<HHQQ", 1, 16, len(data), len(data))
        local = struct.pack("<IHHHHHIIIHH", 0x04034B50, 45, 0x800, 0, 0, 0x21, crc, 0xFFFFFFFF, 0xFFFFFFFF, len(n), len(extra)) + n + extra
        more = struct.pack("<HHQQQ", 1, 24, len(data), len(data), at)
        central.append(struct.pack("<IHHHHHHIIIHHHHHII", 0x02014B50, 45, 45, 0x800, 0, 0, 0x21, crc, 0xFFFFFFFF, 0xFFFFFFFF, len(n), len(more), 0, 0, 0, 0, 0xFFFFFFFF) + n + more)
        out += [local, data]
        at += len(local) + len(data)
    directory = b"".join(central)
    end64 = struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, len(members), len(members), len(directory), at)
    locator = struct.pack("<IIQI", 0x07064B50, 0, at + len(directory), 1)
    end = struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    return b"".join([*out, directory, end64, locator, end])


class ZipDirectory:
    """The members of an archive: name to (local header's place, method, packed size, plain size, crc). file: seekable, read by ranges."""

    def __init__(self, file, size: int):
        self.file = file
        tail_at = max(0, size - 65557)
        tail = self.read(tail_at, size - tail_at)
        end = tail.rfind(b"PK\x05\x06")
        while end >= 0 and (end + 22 > len(tail) or end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail)):
            end = tail.rfind(b"PK\x05\x06", 0, end + 3)  # the signature stands in a comment
        if end < 0:
            raise ValueError("no end of central directory")
        _, _, _, _, count, length, at, _ = struct.unpack_from("<IHHHHIIH", tail, end)
        locator = end - 20
        if locator >= 0 and tail[locator : locator + 4] == b"PK\x06\x07" and (count == 0xFFFF or length == 0xFFFFFFFF or at == 0xFFFFFFFF):
            (at64,) = struct.unpack_from("<Q", tail, locator + 8)
            record = self.read(at64, 56)
            if record[:4] != b"PK\x06\x06":
                raise ValueError("no ZIP64 end record")
            count, length, at = struct.unpack_from("<QQQ", record, 32)
        directory, self.members, p = self.read(at, length), {}, 0
        for _ in range(count):
            if directory[p : p + 4] != b"PK\x01\x02":
                raise ValueError("broken central directory")
            (method,) = struct.unpack_from("<H", directory, p + 10)
            crc, packed, plain, n, m, k = struct.unpack_from("<IIIHHH", directory, p + 16)
            (local,) = struct.unpack_from("<I", directory, p + 42)
            name = directory[p + 46 : p + 46 + n].decode("utf-8", "replace")
            extra, q = directory[p + 46 + n : p + 46 + n + m], 0
            while q + 4 <= len(extra):
                kind, width = struct.unpack_from("<HH", extra, q)
                if kind == 1:
                    wide, r = [plain, packed, local], q + 4
                    for j, v in enumerate(wide):
                        if v == 0xFFFFFFFF:
                            (wide[j],) = struct.unpack_from("<Q", extra, r)
                            r += 8
                    plain, packed, local = wide
                q += 4 + width
            self.members[name] = (local, method, packed, plain, crc)
            p += 46 + n + m + k

    def read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def _data_at(self, local: int) -> int:
        head = self.read(local, 30)
        if head[:4] != b"PK\x03\x04":
            raise ValueError("no local header where the directory points")
        n, m = struct.unpack_from("<HH", head, 26)
        return local + 30 + n + m

    def open(self, name: str) -> tuple[int, int]:
        """Where a stored member's data begin, past its local header, and their size; ValueError for a compressed one, which has no ranges."""
        local, method, _, plain, _ = self.members[name]
        if method:
            raise ValueError(f"{name} is not stored")
        return self._data_at(local), plain

    def whole(self, name: str) -> bytes:
        """All of a stored or deflated member, checked against its CRC."""
        local, method, packed, _, crc = self.members[name]
        data = self.read(self._data_at(local), packed)
        if method == 8:
            data = zlib.decompress(data, -15)
        elif method:
            raise ValueError(f"{name}: compression {method} is not understood")
        if zlib.crc32(data) != crc:
            raise ValueError(f"{name}: wrong CRC")
        return data


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, is_revisit: bool) -> bytes:
    """One WARC record; a revisit has no body but the headers of the full payload."""
    uri = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if is_revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}", "Content-Type: text/html; charset=utf-8"]
    if is_revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    body = b"" if is_revisit else payload
    head.append(f"Content-Length: {len(body)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and body of one record, plain or a gzip member."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    return fields, rest[: int(fields["Content-Length"])]


def decided(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) with digest, refers_to (the smallest page_id of an equal payload of REVISIT_BYTES or more, else null).

    Only ids and digests meet by digest; the payloads move once, by page."""
    slim = pages.select("page_id", F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256).alias("digest"), F.octet_length("html").alias("n")).where(f"n >= {REVISIT_BYTES}")
    firsts = slim.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1 and first is not null")
    copies = slim.select("page_id", "digest").distinct().join(firsts, "digest").where("page_id is null or page_id != first").select(F.col("page_id").alias("p"), F.col("digest").alias("d"), "first")
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    same = F.col("page_id").eqNullSafe(F.col("p")) & (F.col("digest") == F.col("d"))
    return rows.join(copies, same, "left").select("page_id", "url", "html", "digest", F.col("first").alias("refers_to"))


def _writer(folder: str):
    def rows(batches):
        fs, base = open_fs(folder)
        held: list[bytes] = []
        index: list[str] = []
        size = 0

        def flush():
            path = f"{base}/{uuid.uuid4().hex}.wacz"
            with fs.open_output_stream(path) as f:
                f.write(zip_bytes([(WARC_MEMBER, b"".join(held)), (INDEX_MEMBER, "".join(index).encode())]))
            return pa.RecordBatch.from_arrays([pa.array([folder]), pa.array([path]), pa.array([len(held)], pa.int64())], ["folder", "path", "records"])

        for batch in batches:
            for page, url, html, digest, first in zip(*(batch.column(k).to_pylist() for k in range(5))):
                r = gzip.compress(record(page, url, html.encode(), digest, first, first is not None), LEVEL, mtime=0)
                index.append(f"{page} {json.dumps({'offset': size, 'length': len(r)})}\n")
                held.append(r)
                size += len(r)
                if size >= ARCHIVE_BYTES:
                    yield flush()
                    held, index, size = [], [], 0
        if held:
            yield flush()

    return rows


def write_archives(pages: DataFrame) -> DataFrame:
    """Write a record a row into archives in the shared folder; returns the manifest (folder, path, records), a written table.

    Files of lost or repeated tasks are not in it."""
    spark = pages.sparkSession
    folder = as_uri(spark, fresh_path(spark, "archives"))
    fs, base = open_fs(folder)
    fs.create_dir(base, recursive=True)
    return written(decided(bounded(pages).select("page_id", "url", "html")).mapInArrow(trimmed(_writer(folder)), "folder string, path string, records bigint"), "manifest")


def records(file, size: int):
    """(headers, body) of the records of an archive, by its index, in reads of up to READ_BYTES."""
    zipped = ZipDirectory(file, size)
    places = [json.loads(line.split(b" ", 1)[1]) for line in zipped.whole(INDEX_MEMBER).splitlines()]
    begin, _ = zipped.open(WARC_MEMBER if WARC_MEMBER in zipped.members else WARC_MEMBER.removesuffix(".gz"))
    i = 0
    while i < len(places):
        j, end = i, places[i]["offset"]
        while j < len(places) and places[j]["offset"] == end and (j == i or end + places[j]["length"] - places[i]["offset"] <= READ_BYTES):
            end += places[j]["length"]
            j += 1
        block = zipped.read(begin + places[i]["offset"], end - places[i]["offset"])
        for p in places[i:j]:
            b = p["offset"] - places[i]["offset"]
            yield parse(block[b : b + p["length"]])
        i = j


def _urn(value: str | None) -> int | None:
    digits = (value or "")[len("<urn:page:") : -1]
    return int(digits) if digits else None


def _reader(batches):
    for batch in batches:
        for folder, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            fs = open_fs(folder)[0]
            rows = []
            with fs.open_input_file(path) as f:
                for head, body in records(f, f.size()):
                    revisit = head["WARC-Type"] == "revisit"
                    digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
                    if not revisit and (digest != hashlib.sha256(body).hexdigest() or len(body) != int(head["X-Payload-Length"])):
                        raise ValueError(f"{path}: a record's payload is not what was written")
                    rows.append((_urn(head["WARC-Record-ID"]), int(head["X-Payload-Length"]), digest, head["WARC-Type"], _urn(head.get("WARC-Refers-To"))))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def read_archives(manifest: DataFrame) -> DataFrame:
    """One row a record of the archives: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("folder", "path").repartition(n, "path").mapInArrow(trimmed(_reader), "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")


def archived(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html, ...) through archives and back.

    Null html is an empty payload; payloads under REVISIT_BYTES are all responses; very long ones are records like others. Repeated rows of the first page are each a response, rows of
    other pages each a revisit; a null page_id never is the first. No rows give none. Other columns are not read."""
    return read_archives(write_archives(pages))
