import base64
import hashlib
import io
import json
import struct
import zipfile
import zlib
from collections import defaultdict

import pytest
from pyarrow import fs

from lodestone.llm import warc

PAGES = [
    (5, "http://a/", "<p>é</p>"), (3, "http://b/", "<p>é</p>"), (9, "http://c/", "<p>é</p>"), (4, None, None), (2, "http://d d\r\nX: y/", ""), (7, "u", "x" * 300_000),
    (8, "u", "a\r\n\r\nb WARC/1.1\r\n\r\n"), (None, "u", "<p>é</p>"), (None, "n", "only without id"), (11, "t", "tie"), (11, "t", "tie"), (11, "t", "other"), (12, "t", "tie"),
]


def pages(spark, rows, extra=False):
    if extra:
        return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "page_id long, url string, html string, first long, _d string, path int")
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def brute(rows):
    same = defaultdict(list)
    for i, _, html in rows:
        same[html or ""].append(i)
    out = []
    for i, _, html in rows:
        payload = (html or "").encode()
        low = min((x for x in same[html or ""] if x is not None), default=None)
        out.append((i, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "response" if i == low else "revisit", None if i == low else low))
    return sorted(out, key=repr)


@pytest.mark.parametrize("extra", [False, True])
def test_round_trip_equals_brute_force(spark, extra, monkeypatch):
    rows = PAGES + [(100 + i, f"http://h/{i}", f"page {i % 17} " * 50) for i in range(120)]
    out = warc.archived(pages(spark, rows, extra)).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out), key=repr) == brute(rows)
    texts = {(r[0], (r[2] or "").encode()) for r in rows}
    assert all((r.page_id, bytes(r.payload)) in texts for r in out if r.record_type == "response")
    assert all(r.payload is None for r in out if r.record_type == "revisit")


def test_packages_are_rotated_and_read_by_zipfile(spark, tmp_path, monkeypatch):
    folder = f"file://{tmp_path}/packages"
    rows = [(i, "u", f"{i} " * 5000) for i in range(60)]
    writer = warc._writer
    monkeypatch.setattr(warc, "_writer", lambda f: _small(writer(f)))
    manifest = warc.write(pages(spark, rows).coalesce(1), folder)
    assert sum(r.records for r in manifest.collect()) == 60
    for r in manifest.collect():
        path = r.path.removeprefix("file://")
        with open(path, "rb") as file:
            found = warc.members(file, fs.LocalFileSystem().get_file_info(path).size)
            with zipfile.ZipFile(path) as real:
                assert set(found) == set(real.namelist())
                for name, (offset, length) in found.items():
                    file.seek(offset)
                    assert file.read(length) == real.read(name)
    assert warc.read(spark, manifest).count() == 60


def test_index_lines_and_record_ids(spark, tmp_path):
    rows = [(1, "http://www.Example.org:80/a b?q", "x")] * 3 + [(1, "u", "y"), (2, "https://b.org", "x"), (3, None, "z")]
    ids, keys = [], []
    for r in warc.write(pages(spark, rows), f"file://{tmp_path}/packages").collect():
        with zipfile.ZipFile(r.path.removeprefix("file://")) as real:
            lines, data = real.read(warc.INDEX).decode().splitlines(), real.read(warc.ARCHIVE)
        assert lines == sorted(lines)
        for line in lines:
            key, time, about = line.split(" ", 2)
            about = json.loads(about)
            head = zlib.decompress(data[int(about["offset"]) : int(about["offset"]) + int(about["length"])], 31).decode().split("\r\n")
            ids += [h for h in head if h.startswith("WARC-Record-ID")]
            keys.append((key, time, about["mime"]))
            assert f"WARC-Target-URI: {about['url']}".rstrip() in [h.rstrip() for h in head]
    assert len(set(ids)) == len(rows)
    assert sorted(keys) == sorted([("org,example)/a%20b?q", "20240101000000", "text/html")] * 3 + [("u", "20240101000000", "text/html"), ("org,b)/", "20240101000000", "warc/revisit"), ("-", "20240101000000", "text/html")])


def _small(write):
    def run(batches):
        warc.PACKAGE_BYTES = 4096
        yield from write(batches)

    return run


def test_zip64_and_broken_files():
    data, name = b"stored bytes", b"big.warc"
    local = struct.pack("<IHHHHHIIIHH", 0x04034B50, 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(name), 20) + name + struct.pack("<HHQQ", 1, 16, len(data), len(data)) + data
    extra = struct.pack("<HHQQQ", 1, 24, len(data), len(data), 0)
    central = struct.pack("<IHHHHHHIIIHHHHHII", 0x02014B50, 45, 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(name), len(extra), 3, 0, 0, 0, 0xFFFFFFFF) + name + extra + b"com"
    end64 = struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, 1, 1, len(central), len(local))
    locator = struct.pack("<IIQI", 0x07064B50, 0, len(local) + len(central), 1)
    end = struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 7) + b"comment"
    whole = local + central + end64 + locator + end
    (offset, length) = warc.members(io.BytesIO(whole), len(whole))["big.warc"]
    assert whole[offset : offset + length] == data
    for bad in (b"", b"no zip at all" * 10, whole[: len(local) + 10]):
        with pytest.raises(ValueError):
            warc.members(io.BytesIO(bad), len(bad))
    with pytest.raises(ValueError):
        warc.parsed(warc.record(1, "u", b"abc", None, False).replace(b"abc", b"abd"))


def test_empty(spark):
    assert warc.archived(pages(spark, [])).count() == 0
