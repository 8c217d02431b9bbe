"""Web archives in ZIP packages: written with revisit records, read by byte ranges without extraction.

A package is a ZIP file whose members are stored, not deflated: ``archive/data.warc.gz`` with one gzip member for each
WARC record, ``indexes/index.cdxj`` with the place of every record, and ``datapackage.json``. A reader parses the end
record, the ZIP64 end record and the central directory, finds the members' data behind their local headers, and turns
the index into ranges of a few megabytes. The ranges are dealt over the cluster, so a large package is read by many
tasks; each fetches its range and inflates record by record. A package without an index is read from front to back.

Writing: the record with the smallest id among equal payloads of at least ``least_bytes`` is the response, the others
revisit it and carry no payload. Payloads of copies are dropped before the shuffle where a map task meets them. Tasks
write packages under names of their own and only those of committed tasks are listed, so a lost task leaves no double.

Defined cases: a null text is the empty payload; a null id is the largest and written as ``null``; of repeated rows
one is the response and the others revisit it; an empty table gives no package and no row; a file that is no readable
package gives one row with ``error``.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import partitions, slices, utf8
from plumbline.session import cut

#: a package is closed at so many bytes or records
PACKAGE_BYTES = 1 << 30
PACKAGE_RECORDS = 50_000
#: bytes of records that one range read fetches, if they are more than one record
RANGE_BYTES = 4 << 20
LEVEL = 4

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
_ID = "urn:page:"

RECORD = (
    "path string, offset long, length long, record_id string, record_type string, refers_to string, target_uri string, "
    "payload_bytes long, payload_digest string, payload binary, error string"
)
_CHUNK = "path string, start long, lengths array<long>, error string"


def filesystem(path: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a URI and the path in it; a path without a scheme is local to all hosts, as a mount is."""
    return pa.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pa.fs.LocalFileSystem(), path)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# -- writing ---------------------------------------------------------------------------------------------------


def planned_records(pages: DataFrame, page_id: str, url: str, text: str, least_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, n_bytes, sha1, refers): payload is null for revisits, refers for responses."""
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), utf8(text).alias("payload")).withColumn(
        "sha1", F.unhex(F.sha1("payload"))
    )
    n_bytes = F.length("payload").cast("long").alias("n_bytes")
    large = F.length("payload") >= least_bytes
    key = F.struct(F.col("page_id").isNull().alias("last"), "page_id", "url")
    first = rows.filter(large).groupBy("sha1").agg(F.min(F.struct(*[key.alias("key"), F.col("payload")])).alias("first"))
    first = cut(first.select("sha1", "first.key.page_id", "first.key.url", "first.payload"))
    kinds = rows.filter(large).groupBy("page_id", "url", "sha1", n_bytes).agg(F.count(F.lit(1)).cast("int").alias("n"))
    names = first.select("sha1", F.col("page_id").alias("first_id"), F.col("url").alias("first_url"))
    own = F.col("page_id").eqNullSafe(F.col("first_id")) & F.col("url").eqNullSafe(F.col("first_url"))
    more = (
        kinds.join(names, "sha1").withColumn("n", F.col("n") - own.cast("int")).filter("n > 0")
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n"))))
    )
    revisits = more.select("page_id", "url", F.lit(None).cast("binary").alias("payload"), "n_bytes", "sha1", F.coalesce(F.col("first_id").cast("string"), F.lit("null")).alias("refers"))
    responses = first.select("page_id", "url", "payload", n_bytes, "sha1", F.lit(None).cast("string").alias("refers"))
    small = rows.filter(~large).select("page_id", "url", "payload", n_bytes, "sha1", F.lit(None).cast("string").alias("refers"))
    planned = responses.unionAll(revisits)
    return planned.unionAll(small) if least_bytes > 0 else planned


def record(page_id: object, url: str | None, payload: bytes | None, n_bytes: int, sha1: bytes, refers: str | None) -> bytes:
    """One WARC record of an HTTP response; a revisit keeps the HTTP header, whose length names the payload's bytes."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    block = head + (payload or b"")
    uri = "".join(c if " " < c < "\x7f" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in url or "")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if refers is not None else 'response'}",
        f"WARC-Record-ID: <{_ID}{'null' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(sha1).decode()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers is not None:
        lines += [f"WARC-Refers-To: <{_ID}{refers}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class _Package:
    """One ZIP file that is open for writing."""

    def __init__(self, folder: str):
        fs, base = filesystem(folder)
        fs.create_dir(base, recursive=True)
        self.name = f"part-{uuid.uuid4().hex}.zip"
        self.stream = fs.open_output_stream(f"{base}/{self.name}", compression=None)
        self.zip = zipfile.ZipFile(self.stream, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.data = self.zip.open(zipfile.ZipInfo(DATA), "w", force_zip64=True)
        self.index: list[str] = []
        self.bytes = 0

    def add(self, page_id: object, url: str | None, *rest: object, level: int) -> None:
        squeeze = zlib.compressobj(level, zlib.DEFLATED, 31)
        member = squeeze.compress(record(page_id, url, *rest)) + squeeze.flush()
        self.data.write(member)
        place = json.dumps({"offset": str(self.bytes), "length": str(len(member)), "filename": "data.warc.gz"})
        self.index.append(f"{_ID}{page_id} 19700101000000 {place}\n")
        self.bytes += len(member)

    def close(self) -> tuple[str, int, int]:
        self.data.close()
        self.zip.writestr(INDEX, "".join(self.index))
        self.zip.writestr("datapackage.json", json.dumps({"profile": "data-package", "resources": [{"name": "data.warc.gz", "path": DATA}]}))
        self.zip.close()
        self.stream.close()
        return self.name, len(self.index), self.bytes


def write_packages(
    pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", text: str = "html", least_bytes: int = 0,
    package_bytes: int = PACKAGE_BYTES, package_records: int = PACKAGE_RECORDS, level: int = LEVEL,
) -> DataFrame:
    """Write ``pages`` below ``folder``, which all executors share; (path, n_records, n_bytes) of every package."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        package, done = None, []
        for batch in slices(batches, "payload"):
            for row in zip(*[batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "n_bytes", "sha1", "refers")]):
                package = package or _Package(folder)
                package.add(*row, level=level)
                if package.bytes >= package_bytes or len(package.index) >= package_records:
                    done.append(package.close())
                    package = None
        if package:
            done.append(package.close())
        columns = list(zip(*done)) or [[], [], []]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()))], names=["name", "n_records", "n_bytes"]
        )

    planned = planned_records(pages, page_id, url, text, least_bytes)
    written = cut(planned.mapInArrow(run, "name string, n_records long, n_bytes long"))
    return written.select(F.concat(F.lit(folder.rstrip("/") + "/"), "name").alias("path"), "n_records", "n_bytes")


# -- reading ---------------------------------------------------------------------------------------------------


class Damaged(ValueError):
    """A file that is not a readable package."""


def central_directory(file: pa.NativeFile) -> list[dict]:
    """The members of a ZIP file from its central directory: name, method, size and place of the local header."""
    size = file.size()
    tail_at = max(0, size - 65_557)
    tail = file.read_at(size - tail_at, tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0 or len(tail) < end + 22:
        raise Damaged("no end of central directory")
    entries, length, start = struct.unpack_from("<HII", tail, end + 10)
    locator = tail_at + end - 20
    if locator >= 0 and (found := file.read_at(20, locator))[:4] == b"PK\x06\x07":
        (at,) = struct.unpack_from("<Q", found, 8)
        end64 = file.read_at(56, at)
        if end64[:4] != b"PK\x06\x06" or len(end64) < 56:
            raise Damaged("no ZIP64 end of central directory")
        entries, length, start = struct.unpack_from("<QQQ", end64, 32)
    directory = file.read_at(length, start)
    members, at = [], 0
    for _ in range(entries):
        if directory[at : at + 4] != b"PK\x01\x02":
            raise Damaged("broken central directory")
        method, packed, full = struct.unpack_from("<H8xII", directory, at + 10)
        name_size, extra_size, comment = struct.unpack_from("<HHH", directory, at + 28)
        (header,) = struct.unpack_from("<I", directory, at + 42)
        name = directory[at + 46 : at + 46 + name_size].decode("utf-8", "replace")
        extra = directory[at + 46 + name_size : at + 46 + name_size + extra_size]
        while len(extra) >= 4:
            kind, n = struct.unpack_from("<HH", extra)
            if kind == 1:  # ZIP64: only the fields that are full in the entry, in this order
                wide = list(struct.unpack_from(f"<{n // 8}Q", extra, 4))
                full = wide.pop(0) if full == 0xFFFFFFFF and wide else full
                packed = wide.pop(0) if packed == 0xFFFFFFFF and wide else packed
                header = wide.pop(0) if header == 0xFFFFFFFF and wide else header
            extra = extra[4 + n :]
        members.append({"name": name, "method": method, "size": packed, "header": header})
        at += 46 + name_size + extra_size + comment
    return members


def data_start(file: pa.NativeFile, member: dict) -> int:
    """Where a member's bytes begin, behind its local header."""
    if member["method"] != 0:
        raise Damaged(f"{member['name']} is not stored")
    header = file.read_at(30, member["header"])
    if header[:4] != b"PK\x03\x04":
        raise Damaged(f"no local header of {member['name']}")
    name_size, extra_size = struct.unpack_from("<HH", header, 26)
    return member["header"] + 30 + name_size + extra_size


def ranges(file: pa.NativeFile, range_bytes: int) -> Iterator[tuple[int, list[int]]]:
    """(start, lengths of consecutive records) for all archive members; no lengths: read the member to its end."""
    members = central_directory(file)
    placed: dict[str, list[tuple[int, int]]] = {}
    for member in members:
        if member["name"].startswith("indexes/") and member["name"].endswith((".cdx", ".cdxj")):
            for line in file.read_at(member["size"], data_start(file, member)).decode("utf-8", "replace").splitlines():
                if "{" in line:
                    entry = json.loads(line[line.index("{") :])
                    placed.setdefault(entry["filename"], []).append((int(entry["offset"]), int(entry["length"])))
    for member in members:
        if not member["name"].startswith("archive/"):
            continue
        start, found = data_start(file, member), placed.get(member["name"].rpartition("/")[2])
        if found is None:
            if member["size"]:
                yield start, [-member["size"]]
            continue
        begin, lengths = None, []
        for offset, length in sorted(found):
            if lengths and (offset != begin + sum(lengths) or sum(lengths) + length > range_bytes):
                yield start + begin, lengths
                lengths = []
            begin = begin if lengths else offset
            lengths.append(length)
        if lengths:
            yield start + begin, lengths


def _headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines)}


def parse_record(data: bytes) -> dict:
    """The fields of one WARC record; the payload is what follows an HTTP header, if there is one."""
    head, found, rest = data.partition(b"\r\n\r\n")
    if not found or not head.startswith(b"WARC/"):
        raise Damaged("no WARC record")
    fields = _headers(head)
    block = rest[: int(fields.get("content-length", 0))]
    http, split, payload = block.partition(b"\r\n\r\n") if block.startswith(b"HTTP/") else (b"", b"", block)
    kind = fields.get("warc-type")
    stated = fields.get("warc-payload-digest", "").rpartition(":")[2] or None
    if kind == "revisit":
        length = _headers(http).get("content-length")
        payload, n_bytes = None, int(length) if length else None
    else:
        n_bytes = len(payload)
        if stated is None:
            stated = digest(payload)
        elif stated != digest(payload):
            raise Damaged("payload digest differs")
    strip = lambda value: value and value.strip("<>")
    return {
        "record_id": strip(fields.get("warc-record-id")), "record_type": kind, "refers_to": strip(fields.get("warc-refers-to")),
        "target_uri": fields.get("warc-target-uri"), "payload_bytes": n_bytes, "payload_digest": stated, "payload": payload,
    }


def _members(file: pa.NativeFile, start: int, end: int, block: int = 1 << 20) -> Iterator[tuple[int, int | None, bytes | Exception]]:
    """(offset, length, content) of the gzip members between two places, read block by block.

    Behind a damaged member the search goes on at the next gzip header; its content is the error.
    """
    held_at, held = start, b""

    def read(at: int) -> bytes:
        nonlocal held_at, held
        if not held_at <= at < held_at + len(held):
            held_at, held = at, file.read_at(max(0, min(block, end - at)), at)
        return held[at - held_at :]

    def member(at: int) -> tuple[int, bytes]:
        inflate, out = zlib.decompressobj(31), []
        while not inflate.eof:
            if not (rest := read(at)):
                raise Damaged("file ends within a record")
            out.append(inflate.decompress(rest))
            at += len(rest) - len(inflate.unused_data)
        return at, b"".join(out)

    def header(at: int) -> int:
        tail = b""
        while rest := read(at):
            if (found := (tail + rest).find(b"\x1f\x8b\x08")) >= 0:
                return at - len(tail) + found
            at, tail = at + len(rest), (tail + rest)[-2:]
        return end

    begin, failed = start, False
    while begin < end:
        try:
            stop, content = member(begin)
        except (Damaged, zlib.error) as e:
            if not failed:  # one error for what lies before the next whole member
                yield begin, None, e
            begin, failed = header(begin + 1), True
            continue
        yield begin, stop - begin, content
        begin, failed = stop, False


def read_packages(packages: DataFrame, path: str = "path", payload: bool = True, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Every WARC record of the packages named in ``packages``; without ``payload`` the column is null."""
    spark = packages.sparkSession
    chunk_layout = pa.schema([("path", pa.string()), ("start", pa.int64()), ("lengths", pa.list_(pa.int64())), ("error", pa.string())])

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows = []
                try:
                    fs, inner = filesystem(name)
                    with fs.open_input_file(inner) as file:
                        rows = [(name, start, lengths, None) for start, lengths in ranges(file, range_bytes)]
                except (Damaged, OSError, struct.error, ValueError, KeyError) as e:
                    rows = [(name, None, [], f"{type(e).__name__}: {e}"[:300])]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), chunk_layout)], schema=chunk_layout)

    layout = pa.schema([
        ("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string()),
        ("refers_to", pa.string()), ("target_uri", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
        ("payload", pa.binary()), ("error", pa.string()),
    ])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start, lengths, error in zip(*[c.to_pylist() for c in batch.columns]):
                if error is not None:
                    yield pa.RecordBatch.from_pylist([{"path": name, "error": error}], schema=layout)
                    continue
                rows, held = [], 0
                fs, inner = filesystem(name)
                with fs.open_input_file(inner) as file:
                    if lengths[0] < 0:
                        found = _members(file, start, start - lengths[0])
                    else:
                        data, ends = file.read_at(sum(lengths), start), 0
                        found = []
                        for length in lengths:
                            found.append((start + ends, length, data[ends : ends + length]))
                            ends += length
                    for offset, length, content in found:
                        try:
                            if isinstance(content, Exception):
                                raise content
                            content = content if lengths[0] < 0 else zlib.decompress(content, 31)
                            rows.append(parse_record(content) | {"path": name, "offset": offset, "length": length})
                        except (Damaged, zlib.error, ValueError) as e:
                            rows.append({"path": name, "offset": offset, "error": f"{type(e).__name__}: {e}"[:300]})
                            continue
                        if not payload:
                            rows[-1]["payload"] = None
                        held += len(content)
                        if held > 2 * range_bytes:
                            yield pa.RecordBatch.from_pylist(rows, schema=layout)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=layout)

    parts = partitions(spark)
    chunks = packages.select(F.col(path).cast("string").alias("path")).repartition(parts).mapInArrow(locate, _CHUNK)
    return chunks.repartition(parts, "path", "start").mapInArrow(fetch, RECORD)


def page_of(column: str):
    """The page id of a record id this module wrote, as text; null for the id of a null."""
    value = F.regexp_extract(column, f"^{_ID}(.*)$", 1)
    return F.when(value.isin("", "null"), None).otherwise(value)
