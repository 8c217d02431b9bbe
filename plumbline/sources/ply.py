"""PLY point files as a Spark data source, read in byte ranges and written as one file per block.

Register once per session with :func:`register`, then use ``spark.read.format("ply")`` and ``df.write.format("ply")``.
Paths must be readable from every executor as plain files.
"""

from __future__ import annotations

import glob
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from plumbline import schemas
from plumbline.sources.files import open_binary

# PLY scalar names -> NumPy types.
_TYPES = {
    "char": "i1", "uchar": "u1", "short": "i2", "ushort": "u2", "int": "i4", "uint": "u4", "float": "f4", "double": "f8",
    "int8": "i1", "uint8": "u1", "int16": "i2", "uint16": "u2", "int32": "i4", "uint32": "u4", "float32": "f4", "float64": "f8",
}
_ORDER = {"binary_little_endian": "<", "binary_big_endian": ">"}
SPLIT_BYTES = 64 << 20
WRITE_ROWS = 1_000_000
_MAX_HEADER = 1 << 20


@dataclass
class Header:
    layout: str
    vertices: int
    properties: list[tuple[str, str]]
    body: int
    more: bool = False  #: further elements follow the vertices


def parse_header(data: bytes) -> Header:
    """Header of a PLY file from its first bytes; only files whose first element is the vertex list."""
    if not data.startswith(b"ply"):
        raise ValueError("not a PLY file")
    end = data.find(b"end_header")
    if end < 0:
        raise ValueError("header does not end")
    body = data.index(b"\n", end) + 1
    layout, vertices, properties, element, more = "", 0, [], None, False
    for line in data[:end].decode("ascii", "replace").splitlines():
        words = line.split()
        if words[:1] == ["format"]:
            layout = words[1]
        elif words[:1] == ["element"]:
            if element is None and words[1] != "vertex":
                raise ValueError("the first element is not the vertex list")
            element = words[1]
            more = more or element != "vertex" and words[2:3] != ["0"]
            if element == "vertex":
                vertices = int(words[2])
        elif words[:1] == ["property"] and element == "vertex":
            if words[1] not in _TYPES:
                raise ValueError(f"vertex property type {words[1]} is not scalar")
            properties.append((words[2], _TYPES[words[1]]))
    if not {"x", "y", "z"} <= {name for name, _ in properties}:
        raise ValueError("no x, y, z properties")
    return Header(layout, vertices, properties, body, more)


@dataclass
class PlyRange(InputPartition):
    path: str
    cloud: str
    header: Header
    start: int
    end: int


class PlyReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.files = _expand(options.get("path", ""))
        self.clouds = _cloud_names(self.files, options.get("path", ""))
        if not self.files:
            raise FileNotFoundError(options.get("path", ""))
        self.split = int(options.get("splitBytes", SPLIT_BYTES))

    def partitions(self) -> list[InputPartition]:
        ranges: list[InputPartition] = []
        for path in self.files:
            with open(path, "rb") as f:
                header = parse_header(f.read(_MAX_HEADER))
            if header.vertices == 0:
                raise ValueError(f"{path}: point cloud is empty")
            if header.layout == "ascii":
                end = os.path.getsize(path)
                # with further elements only a reader that counts from the first vertex knows where the list ends
                step = max(1, end - header.body) if header.more else self.split
            else:
                stride = np.dtype([(n, t) for n, t in header.properties]).itemsize
                end = header.body + stride * header.vertices
                step = max(1, self.split // stride) * stride
            ranges += [PlyRange(path, self.clouds[path], header, at, min(end, at + step)) for at in range(header.body, end, step)]
        return ranges

    def read(self, partition: PlyRange) -> Iterator[pa.RecordBatch]:
        rows = _read_text(partition) if partition.header.layout == "ascii" else _read_binary(partition)
        for values in rows:
            xyz = [np.asarray(values[c], dtype=np.float64) for c in ("x", "y", "z")]
            if not all(np.isfinite(v).all() for v in xyz):
                raise ValueError(f"{partition.path}: coordinates are not finite")
            n = len(xyz[0])
            colors = [
                pa.array(values[c].astype(np.int16)) if c in values else pa.nulls(n, pa.int16()) for c in ("red", "green", "blue")
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array([partition.cloud] * n), *[pa.array(v) for v in xyz], *colors], ["cloud_id", "x", "y", "z", "r", "g", "b"]
            )


def _expand(paths: str) -> list[str]:
    """Files of one or more paths (one per line): folders, patterns or files."""
    found: list[str] = []
    for path in paths.splitlines():
        path = path.removeprefix("file://")
        pattern = os.path.join(path, "**", "*.ply") if os.path.isdir(path) else path
        found += sorted(glob.glob(pattern, recursive=True))
    return found


def _cloud_names(files: list[str], paths: str) -> dict[str, str]:
    """A cloud is named by its folder below the path it was read from, as the other readers name things."""
    roots = sorted({p.removeprefix("file://").rstrip("/") for p in paths.splitlines()}, key=len, reverse=True)
    names = {}
    for file in files:
        folder = os.path.dirname(file)
        below = next((os.path.relpath(folder, r) for r in roots if file.startswith(r + "/")), ".")
        names[file] = os.path.basename(folder) or os.path.basename(file) if below == "." else below
    return names


def _read_binary(part: PlyRange) -> Iterator[dict[str, np.ndarray]]:
    dtype = np.dtype([(n, _ORDER[part.header.layout] + t) for n, t in part.header.properties])
    with open(part.path, "rb") as f:
        f.seek(part.start)
        left = part.end - part.start
        while left > 0:
            data = f.read(min(left, dtype.itemsize * 65536))
            if len(data) % dtype.itemsize or not data:
                raise ValueError(f"{part.path}: file ends inside the vertex list")
            left -= len(data)
            block = np.frombuffer(data, dtype)
            yield {name: block[name].astype(block[name].dtype.newbyteorder("=")) for name in dtype.names}


def _read_text(part: PlyRange) -> Iterator[dict[str, np.ndarray]]:
    """Lines that start inside the range; with further elements as many as the header declares.

    The first range of a file also counts the lines of the others and holds them against the header.
    """
    names, left = [n for n, _ in part.header.properties], part.header.vertices
    with open(part.path, "rb") as f:
        f.seek(part.start)
        if part.start > part.header.body:
            f.seek(part.start - 1)
            f.readline()
        block: list[list[float]] = []
        while f.tell() < part.end and not (part.header.more and not left):
            words = f.readline().split()
            if words:
                left -= 1
                if len(words) < len(names):
                    raise ValueError(f"{part.path}: short vertex line")
                block.append([float(w) for w in words[: len(names)]])
            if len(block) == 65536:
                yield dict(zip(names, np.array(block).T))
                block = []
        if block:
            yield dict(zip(names, np.array(block).T))
        if part.start == part.header.body:
            left -= sum(not line.isspace() for line in f) if not part.header.more else 0
            if left:
                raise ValueError(f"{part.path}: {abs(left)} vertices {'fewer' if left > 0 else 'more'} than declared")


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class PlyWriter(DataSourceArrowWriter):
    """Every task writes complete PLY files of at most ``maxRows`` points under hidden names; the commit reveals them."""

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path = options["path"].removeprefix("file://")
        self.text = options.get("encoding", "binary") == "ascii"
        self.limit = int(options.get("maxRows", WRITE_ROWS))
        self.overwrite = overwrite
        os.makedirs(self.path, exist_ok=True)

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        context = TaskContext.get()
        prefix = f"part-{context.partitionId():05d}"
        files, held, rows = [], [], 0

        def flush() -> None:
            nonlocal held, rows
            name = f".{prefix}-{len(files):03d}-{context.taskAttemptId()}.ply"
            with open(os.path.join(self.path, name), "wb") as f:
                f.write(_encode(pa.Table.from_batches(held), self.text))
            files.append(name)
            held, rows = [], 0

        for batch in batches:
            while batch.num_rows:
                take = min(batch.num_rows, self.limit - rows)
                held.append(batch.slice(0, take))
                rows += take
                batch = batch.slice(take)
                if rows == self.limit:
                    flush()
        if rows:
            flush()
        return Written(files)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        new = [name for m in messages if m is not None for name in m.files]
        if not new:
            raise ValueError("point cloud is empty, nothing was written")
        if self.overwrite:
            for old in glob.glob(os.path.join(self.path, "part-*.ply")):
                os.remove(old)
        for name in new:
            attempt = name.rsplit("-", 1)[0].lstrip(".")
            os.replace(os.path.join(self.path, name), os.path.join(self.path, f"{attempt}.ply"))

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        for m in messages:
            for name in m.files if m is not None else ():
                os.remove(os.path.join(self.path, name))


def _encode(table: pa.Table, text: bool) -> bytes:
    columns = {c: table[c].to_numpy() for c in ("x", "y", "z")}
    colored = all(c in table.column_names for c in "rgb") and table["r"].null_count == 0
    layout = [(c, "<f8", "double") for c in ("x", "y", "z")]
    if colored:
        layout += [(c, "u1", "uchar") for c in ("red", "green", "blue")]
        columns.update(zip(("red", "green", "blue"), (table[c].to_numpy() for c in "rgb")))
    header = ["ply", f"format {'ascii' if text else 'binary_little_endian'} 1.0", f"element vertex {table.num_rows}"]
    header += [f"property {kind} {name}" for name, _, kind in layout] + ["end_header", ""]
    if text:
        form = " ".join("%.6f" if kind == "double" else "%d" for _, _, kind in layout)
        body = "".join(form % row + "\n" for row in zip(*(columns[n] for n, _, _ in layout))).encode()
    else:
        block = np.empty(table.num_rows, [(n, t) for n, t, _ in layout])
        for name, _, _ in layout:
            block[name] = columns[name]
        body = block.tobytes()
    return "\n".join(header).encode() + body


class PlySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ply"

    def schema(self) -> str:
        return schemas.PLY_POINT

    def reader(self, schema) -> DataSourceReader:
        return PlyReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return PlyWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PlySource)


def read_headers(spark: SparkSession, paths) -> DataFrame:
    """``(file, is_ply, num_vertices, properties)`` of many files, of which only the header is read, however long it is."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths).select("path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path in batch.column("path").to_pylist():
                head = b""
                with open_binary(path) as f:
                    while b"end_header" not in head and (more := f.read(65536)) and head[:3] in (b"", b"ply"):
                        head += more
                text = head.partition(b"end_header")[0].decode("latin-1")
                count = re.search(r"element vertex (\d+)", text)
                rows.append({
                    "file": path, "is_ply": re.match(r"\s*ply\s", text) is not None, "num_vertices": int(count[1]) if count else 0,
                    "properties": re.findall(r"property\s+\S+\s+(\S+)", text),
                })
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([
                ("file", pa.string()), ("is_ply", pa.bool_()), ("num_vertices", pa.int64()), ("properties", pa.list_(pa.string())),
            ]))

    return files.mapInArrow(run, "file string, is_ply boolean, num_vertices bigint, properties array<string>")
