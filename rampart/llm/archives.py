"""WARC records in ZIP-packaged archives.

Writing: each task packs the records of its pages into archives of bounded size, in the shared
folder.  An archive is a ZIP file with two stored members: the records, each a gzip member of its
own, and an index with offset and length of every record.  Records of an equal payload are
revisits of one response.

Reading: the end record, the ZIP64 locator and directory and the central directory give the stored
members; index members give the records (JSON or CDXJ lines, plain or compressed, of any number of
WARC members); ranges of a few megabytes are dealt out and read from the archive where they are,
without extraction.  Members that are not stored cannot be read so and raise an error.  A WARC
member that no index entry names is read as one range.

Files are opened by URI through pyarrow's file systems, in any folder that executors share.  File
names carry the task attempt, and only archives that a finished attempt reports are read, so lost
executors leave at most files that nobody reads.

Null html is an empty payload; null urls are left out, white space and control characters
in them are percent-encoded; rows without an id are records without one.  Of rows repeated under one id and payload, one may be the response.  No pages, no archives."""

from __future__ import annotations

import hashlib
import json
import os
import re
import struct
import zipfile
import zlib
from array import array
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rampart.llm.common import pieces, raw, written

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: Payloads below are always written whole.
LEAST = 100
ARCHIVE_BYTES, RANGE_BYTES = 64 << 20, 4 << 20
DATE = "2026-01-01T00:00:00Z"

_BREAKING = re.compile(r"[\x00-\x20\x7f]")
_PAGE, _SHA256 = re.compile(r"<urn:x-page:(-?[0-9]+)>"), re.compile(r"sha256:[0-9a-f]{64}")
_END, _LOCATOR, _END64, _ENTRY, _LOCAL = b"PK\x05\x06", b"PK\x06\x07", b"PK\x06\x06", b"PK\x01\x02", b"PK\x03\x04"
_MAX32, _MAX16 = 0xFFFFFFFF, 0xFFFF


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


# --- records ---


def _urn(page_id: int | None) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def _page(urn: str) -> int | None:
    found = _PAGE.fullmatch(urn)
    return int(found[1]) if found else None


def record(page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str, first: int | None) -> bytes:
    """One record; without a payload a revisit of the page `first`."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"")
    kind = "response" if payload is not None else "revisit"
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha256:{digest}"]
    if url is not None:
        head.append("WARC-Target-URI: " + _BREAKING.sub(lambda m: quote(m[0]), url))
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(first)}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(block: bytes) -> dict[str, str]:
    lines = block.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines if line)}


def parse(data: bytes) -> dict:
    """One record: page_id, record_type, refers_to, url, payload (null for revisits), payload_bytes
    and payload_digest of the whole payload.

    Records of other writers: an id that is no page's is null; what is not an HTTP message is all
    payload; only SHA-256 digests are compared, and a revisit's digest is given as it stands."""
    head, _, rest = data.partition(b"\r\n\r\n")
    if not head.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    warc = _headers(head)
    block = rest[: int(warc["content-length"])]
    http, payload = b"", block
    if warc.get("content-type", "").startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
    out = {"page_id": _page(warc["warc-record-id"]), "record_type": warc["warc-type"], "refers_to": None, "url": warc.get("warc-target-uri")}
    stated = warc.get("warc-payload-digest", "")
    if out["record_type"] == "revisit":
        size = _headers(http).get("content-length")
        return out | {
            "refers_to": _page(warc.get("warc-refers-to", "")), "payload": None, "payload_bytes": None if size is None else int(size),
            "payload_digest": stated.removeprefix("sha256:") or None,
        }
    digest = hashlib.sha256(payload).hexdigest()
    if _SHA256.fullmatch(stated) and stated != f"sha256:{digest}":
        raise ValueError(f"the payload of {warc['warc-record-id']} does not have its digest")
    return out | {"payload": payload, "payload_bytes": len(payload), "payload_digest": digest}


# --- archives ---


class Archive:
    """Writes one archive; records are compressed as they come, the index is kept until the end."""

    def __init__(self, uri: str):
        files, path = open_fs(uri)
        files.create_dir(os.path.dirname(path), recursive=True)
        self.uri, self.lines, self.at = uri, [], 0
        self.file = files.open_output_stream(path)
        self.zip = zipfile.ZipFile(self.file, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.data = self.zip.open(self._info(DATA), "w", force_zip64=True)

    @staticmethod
    def _info(name: str) -> zipfile.ZipInfo:
        return zipfile.ZipInfo(name, (2026, 1, 1, 0, 0, 0))

    def add(self, page_id: int | None, data: bytes) -> None:
        z = zlib.compressobj(1, zlib.DEFLATED, 31)
        member = z.compress(data) + z.flush()
        self.data.write(member)
        self.lines.append(json.dumps({"id": page_id, "offset": self.at, "length": len(member)}))
        self.at += len(member)

    def close(self) -> tuple[str, int, int]:
        self.data.close()
        self.zip.writestr(self._info(INDEX), "".join(f"{x}\n" for x in self.lines))
        self.zip.close()
        self.file.close()
        return self.uri, len(self.lines), self.at


def members(file: pa.NativeFile) -> dict[str, tuple[int, int]]:
    """Name -> (offset, length) of the bytes of every stored member, from the directories."""
    size = file.size()
    tail = min(size, 22 + _MAX16)
    end = file.read_at(tail, size - tail)
    at = end.rfind(_END)
    if at < 0:
        raise ValueError("no end of central directory")
    count, length, start = struct.unpack_from("<HII", end, at + 10)
    if _MAX16 == count or _MAX32 in (length, start):
        sign, _, where, _ = struct.unpack("<4sIQI", file.read_at(20, size - tail + at - 20))
        if sign != _LOCATOR:
            raise ValueError("no ZIP64 locator")
        found = file.read_at(56, where)
        if found[:4] != _END64:
            raise ValueError("no ZIP64 end of central directory")
        count, length, start = struct.unpack_from("<QQQ", found, 32)
    directory, out, p = file.read_at(length, start), {}, 0
    for _ in range(count):
        if directory[p : p + 4] != _ENTRY:
            raise ValueError("broken central directory")
        method, = struct.unpack_from("<H", directory, p + 10)
        packed, whole, n, m, k = struct.unpack_from("<IIHHH", directory, p + 20)
        local, = struct.unpack_from("<I", directory, p + 42)
        name = directory[p + 46 : p + 46 + n].decode()
        extra, q = directory[p + 46 + n : p + 46 + n + m], 0
        while q + 4 <= len(extra):
            tag, size_ = struct.unpack_from("<HH", extra, q)
            if tag == 1:  # only the fields that do not fit, in this order
                field = q + 4
                if whole == _MAX32:
                    whole, = struct.unpack_from("<Q", extra, field)
                    field += 8
                if packed == _MAX32:
                    packed, = struct.unpack_from("<Q", extra, field)
                    field += 8
                if local == _MAX32:
                    local, = struct.unpack_from("<Q", extra, field)
            q += 4 + size_
        p += 46 + n + m + k
        if name.endswith("/"):
            continue
        if method or packed != whole:
            raise ValueError(f"member {name} is not stored")
        head = file.read_at(30, local)
        if head[:4] != _LOCAL:
            raise ValueError(f"no local header of {name}")
        a, b = struct.unpack_from("<HH", head, 26)
        out[name] = (local + 30 + a + b, whole)
    return out


def index_lines(file: pa.NativeFile, name: str, offset: int, length: int) -> Iterator[dict]:
    """The entries of an index member, read in blocks: JSON lines, or CDXJ lines (key, time, JSON);
    compressed if the name ends with .gz.  Lines that begin with ! are remarks."""
    z, rest = zlib.decompressobj(31) if name.endswith(".gz") else None, b""
    for at in range(offset, offset + length, RANGE_BYTES):
        data = file.read_at(min(RANGE_BYTES, offset + length - at), at)
        if z is not None:
            parts = []
            while data:  # an index may be several gzip members
                parts.append(z.decompress(data))
                data = z.unused_data
                if z.eof:
                    z = zlib.decompressobj(31)
            data = b"".join(parts)
        *lines, rest = (rest + data).split(b"\n")
        yield from (_entry(x) for x in lines if x.strip() and not x.startswith(b"!"))
    if rest.strip() and not rest.startswith(b"!"):
        yield _entry(rest)


def _entry(line: bytes) -> dict:
    text = line.decode().strip()
    return json.loads(text if text.startswith("{") else text.split(" ", 2)[2])


def ranges(uri: str, size: int = RANGE_BYTES) -> Iterator[tuple[str, int, int]]:
    """(uri, offset, length) of runs of whole records of about `size` bytes.  An index entry names
    its WARC member by `filename`; without a name there must be only one.  A member that no entry
    names is one range."""
    files, path = open_fs(uri)
    with files.open_input_file(path) as file:
        found = members(file)
        data = sorted(n for n in found if n.startswith("archive/"))
        entries: dict[str, tuple[array, array]] = {n: (array("q"), array("q")) for n in data}
        for i in sorted(n for n in found if n.startswith("indexes/") and not n.endswith(".idx")):
            for x in index_lines(file, i, *found[i]):
                name = x.get("filename")
                if name is None and len(data) != 1:
                    raise ValueError(f"{i} does not say which of {len(data)} members a record is in")
                name = data[0] if name is None else "archive/" + name.removeprefix("archive/")
                if name not in entries:
                    raise ValueError(f"{i} names {name}, which the archive does not hold")
                entries[name][0].append(int(x["offset"]))
                entries[name][1].append(int(x["length"]))
        for name in data:
            base, whole = found[name]
            offsets, lengths = (np.array(c, np.int64) for c in entries[name])
            if not len(offsets):
                if whole:
                    yield uri, base, whole
                continue
            offsets, first = np.unique(offsets, return_index=True)  # an index is sorted by key, and may list a record twice
            start = stop = 0
            for at, n in zip(offsets.tolist(), lengths[first].tolist()):
                if at < 0 or n <= 0 or at + n > whole:
                    raise ValueError(f"the index names bytes beyond {name}")
                if at != stop or stop - start >= size:
                    if stop > start:
                        yield uri, base + start, stop - start
                    start = at
                stop = at + n
            if stop > start:
                yield uri, base + start, stop - start


def records(uri: str, offset: int, length: int) -> Iterator[dict]:
    """The records of a range, one at a time; each a gzip member, or all of them plain."""
    files, path = open_fs(uri)
    with files.open_input_file(path) as file:
        if file.read_at(min(5, length), offset) == b"WARC/":
            yield from _plain_records(file, offset, length)
            return
        file.seek(offset)
        left, rest, z, out = length, b"", zlib.decompressobj(31), []
        while left or rest:
            if not rest:
                rest = file.read(min(left, 1 << 20))
                if not rest:
                    raise ValueError("the archive ends within a record")
                left -= len(rest)
            out.append(z.decompress(rest))
            rest = z.unused_data if z.eof else b""
            if z.eof:
                yield parse(b"".join(out))
                z, out = zlib.decompressobj(31), []
        if out:
            raise ValueError("the range ends within a record")


def _plain_records(file: pa.NativeFile, at: int, length: int) -> Iterator[dict]:
    end = at + length
    while at < end:
        head = b""
        while b"\r\n\r\n" not in head:
            more = file.read_at(min(1 << 12, end - at - len(head)), at + len(head))
            if not more:
                raise ValueError("the range ends within a record")
            head += more
        head = head[: head.index(b"\r\n\r\n") + 4]
        n = len(head) + int(_headers(head)["content-length"])
        if at + n > end:
            raise ValueError("the range ends within a record")
        yield parse(file.read_at(n, at))
        at += n + 4


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes the records of `pages` (page_id, url, html) below `folder`, a URI that all executors
    reach; returns path, records, bytes of each archive."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"),
        F.octet_length(html).cast("long").alias("n"), F.sha2(html, 256).alias("digest"),
    )
    same = rows.filter(F.col("n") >= LEAST).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("_n"))
    same = written(same.filter("_n > 1").select("digest", "first", F.lit(True).alias("_twin")))
    rows = rows.join(same, "digest", "left").withColumn("_twin", F.coalesce("_twin", F.lit(False)))
    response = ~F.col("_twin") | F.col("page_id").eqNullSafe(F.col("first"))
    columns = ["page_id", "url", "html", "n", "digest", "first"]
    # rows repeated under the first page's id: one of them is the response
    again = written(rows.filter(F.col("_twin") & response).groupBy("digest").agg(F.count("*").alias("_n")).filter("_n > 1"))
    repeated = rows.filter(F.col("_twin") & response).join(again, "digest").groupBy("digest", "page_id", "first", "n").agg(
        F.max("url").alias("url"), F.max("html").alias("html"), F.count("*").alias("_n")
    )
    repeated = repeated.select("*", F.explode(F.expr("sequence(0L, (_n - 1) div 4096)")).alias("_block"))
    repeated = repeated.select("*", F.explode(F.expr("sequence(_block * 4096, least(_block * 4096 + 4095, _n - 1))")).alias("_i"))
    repeated = repeated.withColumn("html", F.when(F.col("_i") == 0, F.col("html"))).select(*columns)
    plain = rows.join(again.select("digest", F.lit(True).alias("_again")), "digest", "left")
    plain = plain.filter(~(F.coalesce("_again", F.lit(False)) & F.col("_twin") & response))
    plain = plain.withColumn("html", F.when(response, F.col("html"))).select(*columns)
    return written(plain.unionByName(repeated).mapInArrow(_writer(folder, archive_bytes), "path string, records long, bytes long"))


def read_archives(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of the archives that the column `path` lists: page_id, payload_bytes,
    payload_digest, record_type, refers_to, url, path and, if asked for, payload."""

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [r for uri in batch.column(0).to_pylist() for r in ranges(uri)]
            columns = [pa.array([r[0] for r in found], pa.string()), *(pa.array([r[i] for r in found], pa.int64()) for i in (1, 2))]
            yield pa.RecordBatch.from_arrays(columns, ["path", "offset", "length"])

    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", *(["payload"] if with_payload else [])]
    kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64(), "payload": pa.binary()}

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(path: str, rows: list[dict]) -> pa.RecordBatch:
            columns = [pa.array([r[c] for r in rows], kinds.get(c, pa.string())) for c in names]
            return pa.RecordBatch.from_arrays([*columns, pa.array([path] * len(rows), pa.string())], [*names, "path"])

        for batch in batches:
            for path, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                rows, held = [], 0
                for r in records(path, offset, length):
                    rows.append(r if with_payload else r | {"payload": None})
                    held += len(r["payload"] or b"") + (1 << 10)
                    if held >= RANGE_BYTES:
                        yield batch_of(path, rows)
                        rows, held = [], 0
                yield batch_of(path, rows)

    spark: SparkSession = archives.sparkSession
    runs = written(archives.select("path").mapInArrow(locate, "path string, offset long, length long"))
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"
    schema += (", payload binary" if with_payload else "") + ", path string"
    return runs.repartition(spark.sparkContext.defaultParallelism).mapInArrow(fetch, schema)


def _writer(folder: str, archive_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, archive, done = TaskContext.get(), None, []
        for batch in batches:
            for part in pieces(batch, 64):
                page, url, html, n, digest, first = (c.to_pylist() if i != 2 else raw(c) for i, c in enumerate(part.columns))
                for row in zip(page, url, html, n, digest, first):
                    if archive is None:
                        name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{len(done):04d}.zip"
                        archive = Archive(f"{folder}/{name}")
                    archive.add(row[0], record(*row))
                    if archive.at >= archive_bytes:
                        done.append(archive.close())
                        archive = None
        if archive is not None:
            done.append(archive.close())
        columns = [pa.array([d[0] for d in done], pa.string()), *(pa.array([d[i] for d in done], pa.int64()) for i in (1, 2))]
        yield pa.RecordBatch.from_arrays(columns, ["path", "records", "bytes"])

    return write
