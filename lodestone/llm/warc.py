"""WARC records in stored members of ZIP packages, written and range-read by Spark tasks.

A package holds archive/data.warc.gz, a stored member of gzip-compressed records, and indexes/index.cdxj, a stored
member with a CDXJ line for each record, sorted: its SURT key, time, and its place and length in the archive member. `members` parses the end record,
the ZIP64 records and the central directory from ranges of the file; `read` takes the index, then reads each
record's range. Nothing is extracted, and no file is read whole.

Tasks write under names of their own and report them through Spark's committed manifest, so files of failed or
speculative attempts are never read. A task starts a new package after `PACKAGE_BYTES`.

Which record of equal payloads is the response is settled on ids and digests alone; digests of which one holds over
1 / `HOT_SHARE` of all rows are joined by a broadcast of at most `HOT_SHARE` rows. Payloads move once, by page_id.

Defined results: null html is the empty payload, null url the empty target; a null page_id is never the smallest
while there is another; rows that repeat the smallest page_id with an equal payload are all responses. An empty
table gives an empty result. Columns other than page_id, url and html aren't read.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, skew_join, written

PACKAGE_BYTES = 64 << 20
ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "path string, records long, bytes long"
FOUND = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _name(page_id: int | None, digest: str, copy: str = "") -> str:
    """A record's id; `copy` tells rows apart that repeat a page_id and payload."""
    return f"<urn:page:{'null' if page_id is None else page_id}:{digest}{':' + copy if copy else ''}>"


def _id(name: str) -> int | None:
    value = name.removeprefix("<urn:page:").removesuffix(">").partition(":")[0]
    return None if value == "null" else int(value)


def target(url: str) -> str:
    """`url` without characters that would end a header or an index key."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def surt(uri: str) -> str:
    """The sort-friendly form of a target: host parts from the last, then path and query."""
    found = re.match(r"(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#]*)([^#]*)", uri)
    if not found:
        return uri or "-"
    host, _, port = found[1].lower().partition(":")
    return ",".join(reversed(host.removeprefix("www.").split("."))) + (f":{port}" if port not in ("", "80", "443") else "") + ")" + (found[2] or "/").lower()


def record(page_id: int | None, url: str, payload: bytes, refers_to: int | None, revisit: bool, copy: str = "") -> bytes:
    """One WARC/1.1 record; a revisit keeps the HTTP headers, with the payload's length, and no payload."""
    digest = sha1_base32(payload)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_name(page_id, digest, copy)}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target(url)}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response",
    ]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_name(refers_to, digest)}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(data: bytes) -> dict:
    """The record in `data`, checked against its digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or sha1_base32(payload) != digest):
        raise ValueError(f"{fields['WARC-Record-ID']}: the payload doesn't match its digest")
    return {
        "page_id": _id(fields["WARC-Record-ID"]), "payload_bytes": size, "payload_digest": digest, "record_type": kind,
        "refers_to": _id(fields["WARC-Refers-To"]) if kind == "revisit" else None, "url": fields["WARC-Target-URI"], "payload": payload if kind == "response" else None,
    }


class Package:
    """Writes one package to a stream that needn't be seekable; its index is at most a line for each record."""

    def __init__(self, stream, name: str = "") -> None:
        self.name, self.last = name, None
        self.zip = zipfile.ZipFile(stream, "w", zipfile.ZIP_STORED)
        self.member = self.zip.open(zipfile.ZipInfo(ARCHIVE), "w", force_zip64=True)
        self.index: list[str] = []
        self.bytes = 0

    def add(self, page_id: int | None, url: str, payload: bytes, refers_to: int | None, revisit: bool) -> None:
        pack = zlib.compressobj(6, zlib.DEFLATED, 31)
        digest = sha1_base32(payload)
        # rows of one page_id and payload come one after the other
        copy = f"{self.name}-{len(self.index)}" if self.last == (page_id, digest) else ""
        self.last = (page_id, digest)
        data = pack.compress(record(page_id, url, payload, refers_to, revisit, copy)) + pack.flush()
        self.member.write(data)
        uri = target(url)
        about = {"url": uri, "mime": "warc/revisit" if revisit else "text/html", "status": "200", "digest": f"sha1:{digest}", "length": str(len(data)), "offset": str(self.bytes), "filename": "data.warc.gz"}
        self.index.append(f"{surt(uri)} {re.sub('[^0-9]', '', DATE)} {json.dumps(about)}")
        self.bytes += len(data)

    def close(self) -> None:
        self.member.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX), "".join(line + "\n" for line in sorted(self.index)))
        self.zip.close()


def members(file, size: int) -> dict[str, tuple[int, int]]:
    """(offset of data, length) of the stored members of a ZIP file, from its directories alone.

    `file` has seek and read. The end record is sought in the last 64 KB; fields it can't hold come from the ZIP64
    records. Raises ValueError for a file that isn't a whole ZIP file, KeyError never.
    """
    def at(offset: int, n: int) -> bytes:
        file.seek(offset)
        return file.read(n)

    tail_at = max(0, size - 22 - 0xFFFF)
    tail = at(tail_at, size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0 or len(tail) - end < 22:
        raise ValueError("no end record: not a ZIP file")
    entries, length, start = struct.unpack("<10xHII", tail[end : end + 20])
    if end >= 20 and tail[end - 20 : end - 16] == b"PK\x06\x07":
        (end64,) = struct.unpack("<8xQ", tail[end - 20 : end - 4])
        big = at(end64, 56)
        if big[:4] != b"PK\x06\x06":
            raise ValueError("the ZIP64 end record isn't where its locator says")
        entries, length, start = struct.unpack("<32xQQQ", big)
    directory, found, p = at(start, length), {}, 0
    for _ in range(entries):
        if directory[p : p + 4] != b"PK\x01\x02":
            raise ValueError("the central directory is cut short")
        method, packed, plain, n, extra, comment, offset = struct.unpack("<10xH8xIIHHH8xI", directory[p : p + 46])
        name = directory[p + 46 : p + 46 + n].decode()
        more, q = directory[p + 46 + n : p + 46 + n + extra], 0
        while q + 4 <= len(more):
            tag, width = struct.unpack("<HH", more[q : q + 4])
            if tag == 1:  # in this order, and only those that don't fit
                wide = io.BytesIO(more[q + 4 : q + 4 + width])
                plain = struct.unpack("<Q", wide.read(8))[0] if plain == 0xFFFFFFFF else plain
                packed = struct.unpack("<Q", wide.read(8))[0] if packed == 0xFFFFFFFF else packed
                offset = struct.unpack("<Q", wide.read(8))[0] if offset == 0xFFFFFFFF else offset
            q += 4 + width
        if method == 0 and packed == plain:
            local = at(offset, 30)
            n_local, extra_local = struct.unpack("<26xHH", local)
            found[name] = (offset + 30 + n_local + extra_local, packed)
        p += 46 + n + extra + comment
    return found


def _open(uri: str):
    store, path = fs.FileSystem.from_uri(uri)
    return store, path


def _writer(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        package = stream = path = None

        def done() -> pa.RecordBatch:
            package.close()
            stream.close()
            return pa.RecordBatch.from_pydict({"path": [path], "records": [len(package.index)], "bytes": [package.bytes]})

        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "html", "first")]
            for page_id, url, html, first in zip(*columns):
                if package is None:
                    path = f"{folder}/{uuid.uuid4().hex}.wacz"
                    store, inner = _open(path)
                    stream = store.open_output_stream(inner)
                    package = Package(stream, inner.rpartition("/")[2].partition(".")[0])
                page, first = page_id.as_py(), first.as_py()
                package.add(page, url.as_py() or "", (html.as_py() or "").encode(), first, page != first)
                if package.bytes >= PACKAGE_BYTES:
                    yield done()
                    package = None
        if package is not None:
            yield done()

    return write


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column("path").to_pylist():
            store, inner = _open(path)
            with store.open_input_file(inner) as file:
                found = members(file, file.size())
                start, length = found[INDEX]
                base, _ = found[ARCHIVE]
                file.seek(start)
                lines = [json.loads(x.split(b" ", 2)[2]) for x in file.read(length).split(b"\n") if x]
            places = sorted((base + int(x["offset"]), int(x["length"])) for x in lines)
            yield pa.RecordBatch.from_pydict({"path": [path] * len(places), "offset": pa.array([p[0] for p in places], pa.int64()), "length": pa.array([p[1] for p in places], pa.int64())})


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary())])
    opened, file = None, None
    for batch in batches:
        rows, held = [], 0
        for path, offset, length in zip(*(batch.column(c).to_pylist() for c in ("path", "offset", "length"))):
            if path != opened:
                store, inner = _open(path)
                opened, file = path, store.open_input_file(inner)
            file.seek(offset)
            rows.append(parsed(zlib.decompress(file.read(length), 31)))
            held += rows[-1]["payload_bytes"]
            if held > 8 << 20:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


def firsts(pages: DataFrame) -> DataFrame:
    """page_id, digest (_d) and the smallest page_id with an equal payload (first), once for each pair."""
    keys = written(pages.select("page_id", F.unhex(F.sha2(F.coalesce("html", F.lit("")), 256)).alias("_d")), "payloads")
    return skew_join(keys, keys.groupBy("_d").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("_n")), "_d").select("page_id", "_d", "first").distinct()


def write(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes packages of the pages' records to `folder` (by default a new one in the shared folder); the manifest."""
    spark = pages.sparkSession
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    folder = folder or new_path(spark, "packages")
    store, inner = _open(folder)
    store.create_dir(inner)
    named = firsts(pages).select(F.col("page_id").alias("_p"), F.col("_d").alias("_e"), "first")
    rows = pages.withColumn("_d", F.unhex(F.sha2(F.coalesce("html", F.lit("")), 256)))
    # by a shuffle, so that rows of one page_id and payload meet and their records' ids can be told apart
    rows = rows.join(named.hint("merge"), rows["page_id"].eqNullSafe(named["_p"]) & (rows["_d"] == named["_e"]))
    return written(rows.select("page_id", "url", "html", "first").mapInArrow(_writer(folder), MANIFEST), "manifest")


def read(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """The records of the packages that `manifest` lists, each read from its range and checked."""
    packages = manifest.select("path").repartition(F.col("path"))
    return packages.mapInArrow(_entries, "path string, offset long, length long").mapInArrow(_records, FOUND)


def archived(pages: DataFrame) -> DataFrame:
    """Writes `pages` and reads the archives back: a row for each record."""
    return read(pages.sparkSession, write(pages))
