"""Operator 5: WARC records in ZIP-packaged web archives.

A package is a ZIP file that stores (without compression) WARC files under archive/ and CDXJ
indexes under indexes/. The reader parses the end record, the ZIP64 records and the central
directory, finds the data of stored members by their local headers, takes record offsets from
the indexes, and range-reads just those bytes; nothing is extracted. What no index mentions, a
whole member or a gap between records, is walked from its start. Reading is spread over tasks by
archive and offset, in about equal numbers of bytes.

Defined results
* a null url or html comes back as null, an empty one as empty; texts of any length and with line ends come back whole;
* repeated records come back as often as they are stored, and records of an archive that several packages hold, from each;
* an empty table makes no package and gives an empty result; an archive without records gives none;
* a compressed archive member can't be range-read, and a file that is no ZIP isn't read: ValueError;
* extra columns of the pages aren't packaged.
"""

from __future__ import annotations

import datetime
import gzip
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch

#: A package is closed at about this size and the next one begun.
PACKAGE_BYTES = 64 << 20
#: Neighbouring records within a gap of this many bytes are read by one request, of at most SPAN bytes.
GAP = 64 << 10
SPAN = 4 << 20
LEVEL = 3
#: A task reads about so many bytes, more where that would make over MOST_TASKS tasks.
TASK_BYTES = 4 << 20
MOST_TASKS = 50_000


class Member(NamedTuple):
    name: str
    method: int
    size: int  # as stored
    header: int  # offset of the local header


def opened(uri: str) -> pa.NativeFile:
    fs, path = pafs.FileSystem.from_uri(uri)
    return fs.open_input_file(path)


def _at(f, offset: int, n: int) -> bytes:  # noqa: ANN001
    f.seek(offset)
    return f.read(n)


def directory(f) -> list[Member]:  # noqa: ANN001
    """Members of the ZIP file f, from its central directory; ZIP64 or not."""
    f.seek(0, 2)
    end = f.tell()
    tail_at = max(0, end - 65557 - 20)
    tail = _at(f, tail_at, end - tail_at)
    k = tail.rfind(b"PK\5\6")
    while k >= 0 and (k + 22 > len(tail) or k + 22 + struct.unpack_from("<H", tail, k + 20)[0] != len(tail)):  # the mark within a comment
        k = tail.rfind(b"PK\5\6", 0, k)
    if k < 0:
        raise ValueError("no end of central directory: not a ZIP file")
    count, size, start = struct.unpack_from("<HII", tail, k + 10)
    locator = k - 20
    if (count == 0xFFFF or size == 0xFFFFFFFF or start == 0xFFFFFFFF) and locator >= 0 and tail[locator : locator + 4] == b"PK\6\7":
        (where,) = struct.unpack_from("<Q", tail, locator + 8)
        record = _at(f, where, 56)
        if record[:4] != b"PK\6\6":
            raise ValueError("a ZIP64 locator without its record")
        count, size, start = struct.unpack_from("<QQQ", record, 32)
    raw, at, out = _at(f, start, size), 0, []
    while at + 46 <= len(raw) and raw[at : at + 4] == b"PK\1\2":
        flags, method = struct.unpack_from("<HH", raw, at + 8)
        packed, plain, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", raw, at + 20)
        (header,) = struct.unpack_from("<I", raw, at + 42)
        name = raw[at + 46 : at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra = raw[at + 46 + n_name : at + 46 + n_name + n_extra]
        e = 0
        while e + 4 <= len(extra):
            tag, n = struct.unpack_from("<HH", extra, e)
            if tag == 1:  # the 64-bit values of those fields that are full, in this order
                wide = [struct.unpack_from("<Q", extra, e + 4 + 8 * i)[0] for i in range(n // 8)]
                if plain == 0xFFFFFFFF and wide:
                    plain = wide.pop(0)
                if packed == 0xFFFFFFFF and wide:
                    packed = wide.pop(0)
                if header == 0xFFFFFFFF and wide:
                    header = wide.pop(0)
            e += 4 + n
        out.append(Member(name, method, packed, header))
        at += 46 + n_name + n_extra + n_comment
    if len(out) != count:
        raise ValueError(f"the central directory has {len(out)} of {count} members")
    return out


def data_offset(f, member: Member) -> int:  # noqa: ANN001
    head = _at(f, member.header, 30)
    if head[:4] != b"PK\3\4":
        raise ValueError(f"no local header for {member.name}")
    n_name, n_extra = struct.unpack_from("<HH", head, 26)
    return member.header + 30 + n_name + n_extra


def index_lines(f, member: Member) -> Iterator[dict]:  # noqa: ANN001
    """The JSON of each CDXJ line; an index may be deflated by the ZIP and gzipped in itself."""
    raw = _at(f, data_offset(f, member), member.size)
    if member.method == 8:
        raw = zlib.decompress(raw, -15)
    elif member.method:
        raise ValueError(f"{member.name}: unknown compression {member.method}")
    if member.name.endswith(".gz"):
        raw = gzip.decompress(raw)
    for line in raw.split(b"\n"):
        if line and not line.startswith(b"!") and (brace := line.find(b"{")) >= 0:
            yield json.loads(line[brace:])


class Entry(NamedTuple):
    uri: str
    offset: int  # of the record in the package
    length: int
    gz: bool


def entries(uri: str) -> Iterator[Entry]:
    """Where the records of a package are."""
    with opened(uri) as f:
        members = directory(f)
        archives = {}
        for m in members:
            if m.name.startswith("archive/") and m.name.endswith((".warc", ".warc.gz")):
                if m.method:
                    raise ValueError(f"{m.name} is compressed by the ZIP and can't be range-read")
                archives[m.name] = (data_offset(f, m), m.size, m.name.endswith(".gz"))
        ranges: dict[str, list[tuple[int, int]]] = {}
        for m in members:
            if m.name.startswith("indexes/") and m.name.endswith((".cdx", ".cdxj", ".cdx.gz", ".cdxj.gz")):
                for x in index_lines(f, m):
                    name = x["filename"] if x["filename"] in archives else f"archive/{x['filename']}"
                    if name not in archives:
                        raise ValueError(f"{m.name} names {x['filename']}, which isn't there")
                    start, size, gz = archives[name]
                    offset, length = int(x["offset"]), int(x["length"])
                    ranges.setdefault(name, []).append((offset, length))
                    if offset < 0 or offset + length > size:
                        raise ValueError(f"{m.name} points outside of {name}")
                    yield Entry(uri, start + offset, length, gz)
        for name, (start, size, gz) in archives.items():  # what no index names is walked: whole members, and gaps between indexed records
            at = 0
            for offset, length in [*sorted(ranges.get(name, [])), (size, 0)]:
                if offset > at:
                    yield from walked(f, uri, start + at, offset - at, gz)
                at = max(at, offset + length)


def walked(f, uri: str, start: int, size: int, gz: bool) -> Iterator[Entry]:  # noqa: ANN001
    """Records of a member without an index: gzip members or plain records one after another."""
    at = 0
    while at < size:
        if gz:
            stream, length, ended = zlib.decompressobj(31), 0, False
            while not ended and at + length < size:
                block = _at(f, start + at + length, min(1 << 20, size - at - length))
                stream.decompress(block)
                ended = stream.eof
                length += len(block) - len(stream.unused_data)
        else:
            head, n = b"", 4096
            while b"\r\n\r\n" not in head and len(head) < size - at:
                head = _at(f, start + at, min(n, size - at))
                n *= 2
            if (stop := head.find(b"\r\n\r\n")) < 0:
                return
            length = stop + 8 + int(_headers(head[:stop])[1].get("content-length", "0"))
        yield Entry(uri, start + at, length, gz)
        at += length


def _headers(block: bytes) -> tuple[str, dict[str, str]]:
    first, *rest = block.decode("utf-8", "replace").split("\r\n")
    return first, {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in rest)}


def parsed(record: bytes) -> dict | None:
    """page_id, url, status and html of a response record; None for another kind."""
    head, _, rest = record.partition(b"\r\n\r\n")
    version, fields = _headers(head)
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    if fields.get("warc-type") != "response":
        return None
    block = rest[: int(fields["content-length"])]
    top, _, body = block.partition(b"\r\n\r\n")
    status = top.split(b"\r\n", 1)[0].split(b" ")
    url = json.loads(fields["x-url-json"]) if "x-url-json" in fields else fields.get("warc-target-uri")
    return {
        "page_id": int(fields["x-page-id"]) if "x-page-id" in fields else None,
        "url": url,
        "status": int(status[1]) if len(status) > 1 and status[1].isdigit() else None,
        "html": None if fields.get("x-payload") == "null" else body.decode("utf-8", "replace"),
    }


def record(page_id: int | None, url: str | None, html: str | None, date: str) -> bytes:
    """A response record. A url that a header line can't hold goes into a field of its own, as JSON."""
    body = (html or "").encode("utf-8", "replace")
    block = (b"HTTP/1.1 204 No Content\r\n" if html is None else b"HTTP/1.1 200 OK\r\n") + b"Content-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body) + body
    head = ["WARC/1.1", "WARC-Type: response", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", f"WARC-Date: {date}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if url is not None:
        plain = url.isascii() and url.isprintable() and url.strip() == url and url != ""
        head.append(f"WARC-Target-URI: {url}" if plain else f"X-Url-Json: {json.dumps(url)}")
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if html is None:
        head.append("X-Payload: null")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class Package:
    """Writes one package to a stream; the archive member is streamed, with ZIP64 sizes."""

    def __init__(self, uri: str):
        self.uri = uri
        fs, path = pafs.FileSystem.from_uri(uri)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        self.out = fs.open_output_stream(path)
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED)
        self.member = self.zip.open("archive/data.warc.gz", "w", force_zip64=True)
        self.at, self.lines = 0, []
        self.date = datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def add(self, page_id: int | None, url: str | None, html: str | None) -> None:
        packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        raw = packer.compress(record(page_id, url, html, self.date)) + packer.flush()
        self.member.write(raw)
        self.lines.append(f"{len(self.lines):010d} 20240101000000 " + json.dumps({"url": url, "filename": "data.warc.gz", "offset": str(self.at), "length": str(len(raw)), "mime": "text/html"}))
        self.at += len(raw)

    def close(self) -> None:
        self.member.close()
        self.zip.writestr("indexes/index.cdx", "\n".join(self.lines) + "\n")
        self.zip.writestr(zipfile.ZipInfo("pages/pages.jsonl"), json.dumps({"format": "json-pages-1.0", "id": "pages"}) + "\n", zipfile.ZIP_DEFLATED)
        self.zip.writestr(zipfile.ZipInfo("datapackage.json"), json.dumps({"profile": "data-package", "resources": ["archive/data.warc.gz", "indexes/index.cdx"]}), zipfile.ZIP_DEFLATED)
        self.zip.close()
        self.out.close()


def package(pages: DataFrame, folder: str, size: int = PACKAGE_BYTES) -> DataFrame:
    """Write pages (page_id, url, html) into packages under folder; (uri, records) of each.

    A file's name holds the task's attempt, and only attempts that succeed get into the list,
    so a task that runs twice leaves at most a file that nothing names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext  # noqa: PLC0415

        task, done, open_ = TaskContext.get(), [], None
        for batch in batches:
            for page_id, url, html in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if open_ is None:
                    open_ = Package(f"{folder}/{task.partitionId():05d}-{task.taskAttemptId()}-{len(done):04d}.wacz")
                open_.add(page_id, url, html)
                if open_.at >= size:
                    open_.close()
                    done.append((open_.uri, len(open_.lines)))
                    open_ = None
        if open_ is not None:
            open_.close()
            done.append((open_.uri, len(open_.lines)))
        yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], names=["uri", "records"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "uri string, records long")


def located(packages: DataFrame) -> DataFrame:
    """From (uri): uri, offset, length, gz of every record, from the directories and indexes alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                rows = list(entries(uri))
                for at in range(0, len(rows), 10000):
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows[at : at + 10000]], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.bool_()))], names=["uri", "offset", "length", "gz"])

    return packages.select("uri").mapInArrow(run, "uri string, offset long, length long, gz boolean")


def fetched(located_: DataFrame, block: int = TASK_BYTES) -> DataFrame:
    """page_id, url, status, html: each task reads the records of some blocks of some packages, neighbours by one request."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("status", pa.int32()), ("html", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, f = None, None
        try:
            for batch in batches:
                rows = list(zip(*(batch.column(i).to_pylist() for i in range(4))))
                at = 0
                while at < len(rows):
                    uri, start, _, _ = rows[at]
                    to, stop = at, start
                    while to < len(rows) and rows[to][0] == uri and (to == at or start <= rows[to][1] <= stop + GAP and rows[to][1] + rows[to][2] - start <= SPAN):
                        stop = max(stop, rows[to][1] + rows[to][2])
                        to += 1
                    if uri != name:
                        if f is not None:
                            f.close()
                        name, f = uri, opened(uri)
                    raw, out = _at(f, start, stop - start), []
                    for _, offset, length, gz in rows[at:to]:
                        part = raw[offset - start : offset - start + length]
                        got = parsed(gzip.GzipFile(fileobj=io.BytesIO(part)).read() if gz else part)
                        if got is not None:
                            out.append(got)
                    if out:
                        yield pa.RecordBatch.from_pylist(out, schema)
                    at = to
        finally:
            if f is not None:
                f.close()

    spark = located_.sparkSession
    located_ = scratch.materialise(located_, "located")
    total = located_.agg(F.sum("length")).first()[0] or 0
    # An explicit number: left to itself, the engine would join these small rows, whose work is elsewhere, into one task.
    tasks = max(1, -(-total // block))
    spread = located_.repartition(min(tasks, max(MOST_TASKS, spark.sparkContext.defaultParallelism * 4)), "uri", F.expr(f"offset div {block}")).sortWithinPartitions("uri", "offset")
    return spread.mapInArrow(run, "page_id long, url string, status int, html string")


def read(packages: DataFrame) -> DataFrame:
    """All records of the packages named in (uri)."""
    return fetched(located(packages))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages table, packaged in the shared folder and read back by ranges."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    packages = scratch.materialise(package(pages, scratch.new_path(spark, "packages")), "package-list")
    return read(packages)


QUERIES = {"op5_warc": op5_warc}
SQL = {"op5_warc": "SELECT page_id, url, CASE WHEN html IS NULL THEN 204 ELSE 200 END AS status, html FROM pages"}
