import gzip
import hashlib
import io
import json
import zipfile
from collections import Counter, defaultdict

import pyarrow as pa
import pyarrow.fs
import pytest

from rampart.llm import archives
from rampart.llm.common import shared_folder

BIG = "<p>ä same page</p>" * 10
PAGES = [
    (5, "http://a/1", BIG), (3, "http://a/2 x\r\ny%20z", BIG), (9, None, BIG), (3, "http://a/2", BIG), (None, "http://a/n", BIG),
    (4, "http://b", None), (6, "http://c", ""), (7, "http://d", "short"), (8, "http://e", "short"),
    (10, "http://f", "x" * 99), (11, "http://f", "x" * 99), (12, "http://f", "x" * 100), (13, "http://f", "x" * 100),
    (14, "u", "long \u0000 \r\n\r\n" * 300_000), (None, None, "y" * 200), (None, None, "y" * 200),
]


def brute(rows):
    groups = defaultdict(list)
    for i, _, h in rows:
        groups[(h or "").encode()].append(i)
    out = []
    for data, ids in groups.items():
        ids.sort(key=lambda i: (i is None, i or 0))
        for k, i in enumerate(ids):
            revisit = len(data) >= 100 and k > 0
            out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", ids[0] if revisit else None))
    return Counter(out)


def test_round_trip(spark, sf):
    made = spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "1 as digest", "2 as n", "3 as first")
    real = spark.read.parquet(f"{sf}/pages.parquet")
    for df in (made, made.limit(0), real):
        rows = [(r.page_id, r.url, r.html) for r in df.select("page_id", "url", "html").collect()]
        listed = archives.write_archives(df, f"{shared_folder(spark)}/archives", archive_bytes=3000)
        back = archives.read_archives(listed).collect()
        assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in back) == brute(rows)
        assert sum(r.records for r in listed.collect()) == len(rows)
        html = {hashlib.sha256((h or "").encode()).hexdigest(): (h or "").encode() for _, _, h in rows}
        assert all((r.payload is None) == (r.record_type == "revisit") and (r.payload is None or bytes(r.payload) == html[r.payload_digest]) for r in back)
        if df is made:
            assert {r.url for r in back if r.page_id == 3} <= {"http://a/2", "http://a/2%20x%0D%0Ay%20z"}


def test_other_tools_can_read_an_archive(spark):
    df = spark.createDataFrame(PAGES[:3], "page_id long, url string, html string").coalesce(1)
    listed = archives.write_archives(df, f"{shared_folder(spark)}/archives").collect()
    files, path = archives.open_fs(listed[0].path)
    with zipfile.ZipFile(io.BytesIO(files.open_input_file(path).read())) as z:
        assert z.testzip() is None and z.namelist() == [archives.DATA, archives.INDEX]


def directory(data):
    return archives.members(pa.PythonFile(io.BytesIO(data), mode="r"))


def test_zip64_directories():
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_STORED) as z:
        for i in range(66_000):  # more than the plain end record can count
            z.writestr(f"archive/{i}", b"%d" % i)
        z.comment = b"a comment PK"
    found = directory(buffer.getvalue())
    assert len(found) == 66_000
    offset, length = found["archive/65999"]
    assert buffer.getvalue()[offset : offset + length] == b"65999"


def test_zip64_sizes_in_an_entry():
    """Sizes and offset of all ones are taken from the extra field, in order."""
    import struct

    body = b"hello"
    local = b"PK\x03\x04" + bytes(22) + struct.pack("<HH", 1, 0) + b"a"
    extra = struct.pack("<HHHH", 0x9999, 4, 1, 2) + struct.pack("<HHQQQ", 1, 24, 5, 5, 0)
    entry = b"PK\x01\x02" + bytes(16) + struct.pack("<IIHHH", 0xFFFFFFFF, 0xFFFFFFFF, 1, len(extra), 0) + bytes(8) + struct.pack("<I", 0xFFFFFFFF) + b"a" + extra
    start = len(local) + len(body)
    end = b"PK\x05\x06" + bytes(4) + struct.pack("<HHIIH", 1, 1, len(entry), start, 0)
    assert directory(local + body + entry + end) == {"a": (len(local), 5)}


def test_what_cannot_be_range_read_raises():
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("archive/data.warc.gz", b"x" * 1000)
    with pytest.raises(ValueError, match="not stored"):
        directory(buffer.getvalue())
    with pytest.raises(ValueError, match="no end"):
        directory(b"not a zip file")


def foreign(kind, number, block, head=""):
    lines = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:{number}>\r\nContent-Length: {len(block)}\r\n{head}\r\n"
    return lines.encode() + block + b"\r\n\r\n"


HTTP = "Content-Type: application/http; msgtype=response\r\nWARC-Payload-Digest: sha1:ABC\r\n"


def other_archive(index_name, lines, gz=True):
    """Two WARC members and one index, as other tools write them."""
    pack = gzip.compress if gz else bytes
    one = [pack(foreign("warcinfo", 1, b"software: x")), pack(foreign("response", 2, b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nfirst page", HTTP))]
    two = [pack(foreign("response", 3, b"HTTP/1.1 200 OK\r\n\r\nsecond page" * n, HTTP)) for n in (1, 2)]
    two.append(pack(foreign("revisit", 4, b"HTTP/1.1 200 OK\r\n\r\n", HTTP)))
    buffer, places = io.BytesIO(), {}
    for name, parts in (("a.warc.gz", one), ("b.warc.gz", two)):
        at = 0
        for i, part in enumerate(parts):
            places[name, i] = {"offset": str(at), "length": str(len(part)), "filename": name}
            at += len(part)
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_STORED) as z:
        z.writestr("datapackage.json", b"{}")
        z.writestr("archive/a.warc.gz", b"".join(one))
        z.writestr("archive/b.warc.gz", b"".join(two))
        if index_name:
            index = "".join(lines(key, place) for key, place in places.items()).encode()
            z.writestr(index_name, gzip.compress(index[:50]) + gzip.compress(index[50:]) if index_name.endswith(".gz") else index)
    return buffer.getvalue()


def read(spark, data):
    folder = shared_folder(spark)
    files, path = archives.open_fs(folder)
    files.create_dir(path, recursive=True)
    with files.open_output_stream(f"{path}/other.zip") as out:
        out.write(data)
    return archives.read_archives(spark.createDataFrame([(f"{folder}/other.zip",)], "path string")).collect()


def test_archives_of_other_tools(spark):
    cdxj = lambda key, place: f"com,example)/{9 - key[1]} 20260101000000 {json.dumps(place)}\n" if key[0] == "b.warc.gz" or key[1] else ""
    rows = {"first page": 1, "second page": 1}
    for name, lines, gz, infos in (
        ("indexes/index.cdxj", cdxj, True, 0), ("indexes/index.cdx.gz", cdxj, True, 0), ("indexes/index.cdxj", cdxj, False, 0), (None, None, True, 1), (None, None, False, 1),
        ("indexes/index.cdxj", lambda key, place: "!meta x\n" + json.dumps(place) + "\n" if key[0] == "a.warc.gz" else "", True, 1),
    ):
        out = read(spark, other_archive(name, lines, gz))
        assert Counter(r.record_type for r in out) == Counter({"response": 3, "revisit": 1} | ({"warcinfo": 1} if infos else {}))
        payloads = Counter(bytes(r.payload).decode() for r in out if r.record_type == "response")
        assert all(payloads[p] == n for p, n in rows.items()) and len(payloads) == 3
        assert all(r.page_id is None for r in out)
        assert all(r.payload_digest == hashlib.sha256(r.payload).hexdigest() for r in out if r.record_type == "response")


def test_an_index_that_does_not_fit_raises():
    for line, message in (
        (lambda key, place: json.dumps({k: v for k, v in place.items() if k != "filename"}), "does not say"),
        (lambda key, place: json.dumps(place | {"filename": "c"}), "does not hold"),
        (lambda key, place: json.dumps(place | {"length": 10_000}), "beyond"),
    ):
        import os
        import tempfile

        path = os.path.join(tempfile.mkdtemp(prefix="run-"), "x.zip")
        with open(path, "wb") as f:
            f.write(other_archive("indexes/i.cdxj", lambda key, place: line(key, place) + "\n"))
        with pytest.raises(ValueError, match=message):
            list(archives.ranges(f"file://{path}"))
