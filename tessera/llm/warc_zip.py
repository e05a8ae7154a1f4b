"""WARC records in ZIP-packaged archives: a writer, and a range reader that never extracts.

A package is a ZIP of stored members: ``archive/data.warc.gz`` (one gzip member a record),
``indexes/index.cdx`` (one JSON line a record with its offset and length). The reader takes
the end record from the tail, follows the ZIP64 locator where there is one, parses the
central directory, finds where each stored member's data begins, and then range-reads
single records by the index's offsets.
"""

from __future__ import annotations

import hashlib
import io
import json
import struct
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.runtime import scratch_path

MIN_REVISIT_BYTES = 1000
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
#: Payload bytes of one package; a task starts another beyond it.
PACKAGE_BYTES = 64 << 20
#: Neighbouring records are fetched together up to so many bytes.
READ_AHEAD = 4 << 20
DATE = "2024-01-01T00:00:00Z"


# --- ZIP directory ---------------------------------------------------------------------


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    header_at: int


class StoredZip:
    """Members of a ZIP in a seekable file; stored ones can be read by range."""

    def __init__(self, file, size: int):
        self.file, self.size = file, size
        self.members = {m.name: m for m in self._directory()}

    def _read(self, at: int, n: int) -> bytes:
        if at < 0 or n < 0 or at + n > self.size:
            raise ValueError("a ZIP field points outside the file")
        self.file.seek(at)
        return self.file.read(n)

    def _directory(self) -> list[Member]:
        tail_at = max(0, self.size - 65_557)
        tail = self._read(tail_at, self.size - tail_at)
        end = tail.rfind(b"PK\5\6")
        while end >= 0 and (len(tail) - end < 22 or end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail)):
            end = tail.rfind(b"PK\5\6", 0, end)
        if end < 0:
            raise ValueError("not a ZIP file: no end of central directory")
        count, length, at = struct.unpack_from("<HII", tail, end + 10)
        locator_at = tail_at + end - 20
        if (count == 0xFFFF or length == 0xFFFFFFFF or at == 0xFFFFFFFF) and locator_at >= 0:
            locator = self._read(locator_at, 20)
            if locator[:4] == b"PK\6\7":
                record = self._read(struct.unpack_from("<Q", locator, 8)[0], 56)
                if record[:4] != b"PK\6\6":
                    raise ValueError("the ZIP64 locator leads to no ZIP64 record")
                count, length, at = struct.unpack_from("<QQQ", record, 32)
        return list(self._entries(self._read(at, length), count))

    @staticmethod
    def _entries(block: bytes, count: int) -> Iterator[Member]:
        at = 0
        for _ in range(count):
            if block[at : at + 4] != b"PK\1\2":
                raise ValueError("a central directory entry is broken")
            flags, method = struct.unpack_from("<HH", block, at + 8)
            packed, size, n_name, n_extra, n_note = struct.unpack_from("<IIHHH", block, at + 20)
            header_at = struct.unpack_from("<I", block, at + 42)[0]
            name = block[at + 46 : at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
            extra, x = block[at + 46 + n_name : at + 46 + n_name + n_extra], 0
            while x + 4 <= len(extra):
                kind, n = struct.unpack_from("<HH", extra, x)
                if kind == 1:  # ZIP64: the fields that are full, in this order
                    field = x + 4
                    if size == 0xFFFFFFFF:
                        size, field = struct.unpack_from("<Q", extra, field)[0], field + 8
                    if packed == 0xFFFFFFFF:
                        packed, field = struct.unpack_from("<Q", extra, field)[0], field + 8
                    if header_at == 0xFFFFFFFF:
                        header_at = struct.unpack_from("<Q", extra, field)[0]
                x += 4 + n
            yield Member(name, method, packed, header_at)
            at += 46 + n_name + n_extra + n_note

    def data_at(self, name: str) -> int:
        """Where a stored member's bytes begin; the local header has its own name and extra."""
        member = self.members[name]
        if member.method:
            raise ValueError(f"{name} is compressed; only stored members can be read by range")
        header = self._read(member.header_at, 30)
        if header[:4] != b"PK\3\4":
            raise ValueError(f"{name} has no local header")
        n_name, n_extra = struct.unpack_from("<HH", header, 26)
        return member.header_at + 30 + n_name + n_extra

    def read(self, name: str, at: int = 0, n: int | None = None) -> bytes:
        n = self.members[name].size - at if n is None else n
        if at < 0 or n < 0 or at + n > self.members[name].size:
            raise ValueError(f"a range is outside {name}")
        return self._read(self.data_at(name) + at, n)


# --- WARC records ----------------------------------------------------------------------


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit carries the HTTP head without the payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + (payload if kind == "response" else b"")
    fields = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {' '.join((url or '').split())}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response",
    ]
    if refers_to is not None:
        fields += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join([*fields, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC fields, HTTP fields, payload) of one record; field names in lower case."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    shown = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in http.decode("latin-1").split("\r\n")[1:])}
    return fields, shown, payload


class Package:
    """Writes one archive to a stream: records as they come, then index and directory."""

    def __init__(self, stream):
        self.zip = zipfile.ZipFile(stream, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.data = self.zip.open(zipfile.ZipInfo(DATA), "w", force_zip64=True)
        self.at, self.index = 0, []

    def add(self, raw: bytes, page_id: int | None) -> None:
        packer = zlib.compressobj(1, zlib.DEFLATED, 31)
        packed = packer.compress(raw) + packer.flush()
        self.data.write(packed)
        self.index.append(json.dumps({"page_id": page_id, "offset": self.at, "length": len(packed)}))
        self.at += len(packed)

    def close(self) -> None:
        self.data.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX), "\n".join(self.index))
        self.zip.close()


def records(file, size: int) -> Iterator[tuple[dict[str, str], dict[str, str], bytes]]:
    """Every record of a package in the index's order, read by range."""
    package = StoredZip(file, size)
    lines = [json.loads(x) for x in package.read(INDEX).decode().split("\n") if x]
    held, held_at = b"", 0
    limit = package.members[DATA].size
    for line in lines:
        at, n = line["offset"], line["length"]
        if not held_at <= at <= at + n <= held_at + len(held):
            held, held_at = package.read(DATA, at, min(max(n, READ_AHEAD), limit - at)), at
        yield parse(zlib.decompress(held[at - held_at : at - held_at + n], 31))


# --- Spark -----------------------------------------------------------------------------


def plan_records(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """page_id, url, html, digest, refers_to: null for responses.

    Payloads are compared by length and SHA-1. Only those that more than one page has, with
    their largest page_id, are joined back; a hot payload's rows are split by Spark's skew join.
    """
    html = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    named = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    named = named.withColumn("digest", F.sha1("html"))
    long_ = named.filter(F.octet_length("html") >= min_bytes)
    repeated = long_.groupBy("digest").agg(F.max("page_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1").select("digest", "first_id")
    key = F.when(F.octet_length("html") >= min_bytes, F.col("digest"))
    joined = named.withColumn("key", key).alias("p").join(repeated.alias("r"), F.col("p.key") == F.col("r.digest"), "left")
    other = F.when(F.col("r.first_id") != F.coalesce(F.col("p.page_id"), F.lit(-1)), F.col("r.first_id"))
    return joined.select("p.page_id", "p.url", "p.html", "p.digest", other.alias("refers_to"))


def _storage(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a folder or file that Spark names: file, hdfs, s3a, gs."""
    return pafs.FileSystem.from_uri("s3://" + uri[6:] if uri.startswith("s3a://") else uri)


def write_packages(planned: DataFrame, folder: str, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Write packages into a folder that all executors share; path, size and records of each.

    A file's name has the attempt's number: a retry never touches what another attempt
    writes, and only files of the attempts that Spark accepted are listed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        fs, base = _storage(folder)
        fs.create_dir(base, recursive=True)
        made: list[tuple[str, int, int]] = []
        package = stream = None
        held = 0

        def close() -> None:
            package.close()
            made.append((f"{folder}/{name}", stream.tell(), len(package.index)))
            stream.close()

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                page_id, url, html, digest, refers_to = row
                if package is None:
                    name = f"{task.partitionId():06d}-{task.taskAttemptId():08d}-{len(made):04d}.wacz"
                    stream = fs.open_output_stream(f"{base}/{name}")
                    package, held = Package(_Counted(stream)), 0
                kind = "response" if refers_to is None else "revisit"
                package.add(record(kind, page_id, url, html, digest, refers_to), page_id)
                held += len(html) + 512
                if held >= package_bytes:
                    close()
                    package = None
        if package is not None:
            close()
        columns = list(zip(*made, strict=True)) if made else [(), (), ()]
        kinds = (pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["path", "bytes", "records"])

    return planned.mapInArrow(run, "path string, bytes long, records long")


class _Counted(io.RawIOBase):
    """A write-only stream for zipfile over an Arrow output stream, which can't seek."""

    def __init__(self, stream):
        self.stream = stream

    def writable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return False

    def write(self, data) -> int:
        self.stream.write(data)
        return len(data)


READ_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def read_packages(manifest: DataFrame) -> DataFrame:
    """One row per record of the listed packages; digests of payloads that are there are computed anew."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda x: int(x.removeprefix("<urn:page:").removesuffix(">") or -1) if x else -1
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, name = _storage(path)
                rows = []
                with fs.open_input_file(name) as file:
                    for fields, http, payload in records(file, file.size()):
                        said = fields["warc-payload-digest"].removeprefix("sha1:")
                        if fields["warc-type"] == "response" and hashlib.sha1(payload).hexdigest() != said:
                            raise ValueError(f"a payload in {path} doesn't match its digest")
                        page, other = number(fields["warc-record-id"]), number(fields.get("warc-refers-to"))
                        rows.append((None if page < 0 else page, int(http["content-length"]), said, fields["warc-type"], None if other < 0 else other, fields["warc-target-uri"] or None))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
                names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]
                columns = list(zip(*rows, strict=True)) if rows else [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return manifest.select("path").mapInArrow(run, READ_SCHEMA)


def round_trip(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Write every page as a WARC record into packages and read the packages back.

    A null html is an empty payload; a null page_id is read back as null and never another
    page's original while a numbered page has the payload. Rows that repeat a page_id with
    one payload are all responses if theirs is the largest. White space in urls is one space.
    A long payload is held whole by one task, and no package grows past its bounds but by one
    record. Other columns are ignored; an empty table gives no rows.
    """
    spark = pages.sparkSession
    folder = scratch_path(spark, "warc")
    listed = f"{folder}-manifest"
    write_packages(plan_records(pages, min_bytes), folder).write.parquet(listed)
    manifest = spark.read.parquet(listed)
    files = manifest.count()
    return read_packages(manifest.repartition(max(1, files)))


ORACLE = """
WITH p AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest, url FROM pages),
g AS (
  SELECT payload_digest, max(page_id) AS original FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest HAVING count(*) > 1)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
       CASE WHEN g.original IS NOT NULL AND g.original <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN g.original <> p.page_id THEN g.original END AS refers_to, p.url
FROM p LEFT JOIN g ON p.payload_digest = g.payload_digest AND p.payload_bytes >= 1000
"""
