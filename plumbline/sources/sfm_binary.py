"""Binary sparse models, read in byte ranges of whole records.

Records have varying lengths, so where they begin is only known from the records before. A first pass walks each file once,
looks at the lengths alone and cuts it into ranges of about ``range_bytes``; the ranges are then dealt to tasks that parse them.
No file is held whole and none is limited in size.

A file whose lengths cannot be followed (it ends early, or a camera has an unknown model) gives the records before that place and
one row with ``file_error``; a record that can be skipped (a coordinate is not finite, a name is not UTF-8) gives such a row itself.
A file without records and an empty file, which Spark's listing leaves out, give no row; bytes after the last record are ignored.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline import schemas
from plumbline.params import CAMERA_MODELS
from plumbline.session import cut, partitions
from plumbline.sources.files import folder_key, open_binary

RANGE_BYTES = 32 << 20
_READ_BYTES = 1 << 20
_BATCH_BYTES = 4 << 20
_COUNT = "<Q"
_CAMERA = "<iiQQ"
_POSE = "<I7dI"
_POINT = "<q3d3Bd"
_COUNT_SIZE, _CAMERA_SIZE, _POSE_SIZE, _POINT_SIZE = map(struct.calcsize, (_COUNT, _CAMERA, _POSE, _POINT))


class Window:
    """A part of an open file, moved along as places are asked for; bytes that nobody asks for are not read."""

    def __init__(self, file: pa.NativeFile, step: int):
        self.file, self.step, self.size = file, step, file.size()
        self.data, self.start = b"", 0

    def reach(self, at: int, length: int) -> int:
        """Make ``length`` bytes at ``at`` available; returns their place in ``data``."""
        if at + length > self.size:
            raise EOFError(f"the file ends at byte {self.size}, within a record")
        if at < self.start or at + length > self.start + len(self.data):
            self.file.seek(at)
            self.data, self.start = self.file.read(max(length, self.step)), at
        return at - self.start

    def unpack(self, layout: str, at: int) -> tuple:
        place = self.reach(at, struct.calcsize(layout))
        return struct.unpack_from(layout, self.data, place)

    def bytes(self, begin: int, end: int) -> bytes:
        place = self.reach(begin, end - begin)
        return self.data[place: place + end - begin]

    def zero(self, at: int) -> int:
        """The first zero byte at or after ``at``."""
        while True:
            place = self.reach(at, 1)
            found = self.data.find(b"\0", place)
            if found >= 0:
                return self.start + found
            at = self.start + len(self.data)


@dataclass(frozen=True)
class Kind:
    """How the records of one file are laid out: some values, then a list that fills the record's end."""

    schema: str
    items: np.dtype
    #: begin and end of the list of the record at a place
    tail: Callable[[Window, int], tuple[int, int]]
    #: the values before the list, from the record's begin and the list's begin
    head: Callable[[Window, int, int], tuple]


def _camera_tail(w: Window, at: int) -> tuple[int, int]:
    model = w.unpack(_CAMERA, at)[1]
    if model not in CAMERA_MODELS:
        # its length is unknown: nothing after it can be trusted
        raise KeyError(f"unknown camera model {model}")
    return at + _CAMERA_SIZE, at + _CAMERA_SIZE + 8 * CAMERA_MODELS[model][1]


def _camera_head(w: Window, at: int, tail: int) -> tuple:
    camera_id, model, width, height = w.unpack(_CAMERA, at)
    return camera_id, CAMERA_MODELS[model][0], width, height


def _image_tail(w: Window, at: int) -> tuple[int, int]:
    begin = w.zero(at + _POSE_SIZE) + 1 + _COUNT_SIZE
    return begin, begin + 24 * w.unpack(_COUNT, begin - _COUNT_SIZE)[0]


def _image_head(w: Window, at: int, tail: int) -> tuple:
    image_id, *pose, camera_id = w.unpack(_POSE, at)
    return image_id, *pose, camera_id, w.bytes(at + _POSE_SIZE, tail - 1 - _COUNT_SIZE).decode("utf-8")


def _point_tail(w: Window, at: int) -> tuple[int, int]:
    begin = at + _POINT_SIZE + _COUNT_SIZE
    return begin, begin + 8 * w.unpack(_COUNT, begin - _COUNT_SIZE)[0]


def _point_head(w: Window, at: int, tail: int) -> tuple:
    values = w.unpack(_POINT, at)
    if not all(map(math.isfinite, values[1:4])):
        raise ValueError(f"coordinate of point {values[0]} is not finite")
    return values


CAMERAS = Kind(schemas.CAMERA, np.dtype("<f8"), _camera_tail, _camera_head)
# the all-ones id of a point reads as -1 in a signed number
IMAGES = Kind(schemas.IMAGE, np.dtype([("px", "<f8"), ("py", "<f8"), ("point3d_id", "<i8")]), _image_tail, _image_head)
POINTS = Kind(schemas.POINT3D, np.dtype([("image_id", "<u4"), ("point2d_idx", "<u4")]), _point_tail, _point_head)


def record_ranges(spark: SparkSession, paths: str | Sequence[str], kind: Kind, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Ranges ``(model_id, file, begin, end, records, file_error)`` of whole records, found from the records' lengths alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths if isinstance(paths, str) else list(paths))
    listed = files.select(folder_key(F.col("path"), paths).alias("model_id"), F.col("path").alias("file"))

    def walk(file: str) -> Iterator[tuple[int, int, int, str | None]]:
        begin = at = _COUNT_SIZE
        held = 0
        with open_binary(file) as f:
            window = Window(f, _READ_BYTES)
            try:
                for _ in range(window.unpack(_COUNT, 0)[0]):
                    end = kind.tail(window, at)[1]
                    if end > window.size:
                        raise EOFError(f"the file ends at byte {window.size}, within a record")
                    at, held = end, held + 1
                    if at - begin >= range_bytes:
                        yield begin, at, held, None
                        begin, held = at, 0
            except (EOFError, KeyError) as error:
                yield at, at, 0, f"{type(error).__name__}: {error}"
            if held:
                yield begin, at, held, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["model_id", "file", "begin", "end", "records", "file_error"]
        types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        for batch in batches:
            for model_id, file in zip(batch["model_id"].to_pylist(), batch["file"].to_pylist()):
                rows = [(model_id, file, *r) for r in walk(file)]
                columns = zip(*rows) if rows else [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    return listed.mapInArrow(run, "model_id string, file string, begin bigint, end bigint, records bigint, file_error string")


_ARROW = {"string": pa.string(), "bigint": pa.int64(), "double": pa.float64(), "smallint": pa.int16(), "int": pa.int32()}


def _lists(tails: list[bytes], items: np.dtype) -> pa.Array:
    """The records' lists as one Arrow column, straight from their bytes."""
    offsets = np.cumsum([0, *[len(t) // items.itemsize for t in tails]]).astype(np.int32)
    values = np.frombuffer(b"".join(tails), items)
    if items.names is None:
        return pa.ListArray.from_arrays(offsets, pa.array(values))
    # an image id is wider than its four bytes, as elsewhere; places within an image are not
    widths = {"image_id": np.int64, "point2d_idx": np.int32}
    fields = [pa.array(np.ascontiguousarray(values[n]).astype(widths.get(n, items[n]))) for n in items.names]
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(fields, list(items.names)))


def _read(spark: SparkSession, paths: str | Sequence[str], kind: Kind, range_bytes: int) -> DataFrame:
    ranges = cut(record_ranges(spark, paths, kind, range_bytes))
    count, size = ranges.agg(F.count(F.lit(1)), F.sum(F.col("end") - F.col("begin"))).first()
    # small files and small ranges share a task: beyond four times the shuffle's partitions there are only as many tasks as large ranges fill
    wanted, whole = (math.ceil((size or 0) / most) for most in (range_bytes, max(range_bytes, RANGE_BYTES)))
    dealt = ranges.repartition(max(1, min(count, wanted, max(whole, 4 * partitions(spark)))))
    names = [part.split()[0] for part in kind.schema.split(", ")]
    kinds = [_ARROW[part.split()[1]] for part in kind.schema.split(", ")[1:-1]]
    listed = _lists([], kind.items).type

    def batch_of(model_id: str, file: str, heads: list[tuple], tails: list[bytes]) -> pa.RecordBatch:
        values = [pa.array(c, t) for c, t in zip(zip(*heads), kinds)]
        named = pa.array([model_id] * len(heads), pa.string()), pa.array([file] * len(heads), pa.string())
        return pa.RecordBatch.from_arrays(
            [named[0], *values, _lists(tails, kind.items), named[1], pa.nulls(len(heads), pa.string())], [*names, "file", "file_error"])

    def fault(model_id: str, file: str, error: str) -> pa.RecordBatch:
        empty = [pa.nulls(1, t) for t in [*kinds, listed]]
        return pa.RecordBatch.from_arrays(
            [pa.array([model_id]), *empty, pa.array([file]), pa.array([error])], [*names, "file", "file_error"])

    def parse(model_id: str, file: str, begin: int, end: int, records: int) -> Iterator[pa.RecordBatch]:
        heads: list[tuple] = []
        tails: list[bytes] = []
        with open_binary(file) as f:
            window, at, flushed = Window(f, min(_BATCH_BYTES, end - begin)), begin, begin
            for _ in range(records):
                first, last = kind.tail(window, at)
                try:
                    heads.append(kind.head(window, at, first))
                    tails.append(window.bytes(first, last))
                except ValueError as error:
                    yield fault(model_id, file, f"{type(error).__name__}: {error}")
                at = last
                if at - flushed >= _BATCH_BYTES and heads:
                    yield batch_of(model_id, file, heads, tails)
                    heads, tails, flushed = [], [], at
        if heads:
            yield batch_of(model_id, file, heads, tails)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                if r["file_error"] is not None:
                    yield fault(r["model_id"], r["file"], r["file_error"])
                else:
                    yield from parse(r["model_id"], r["file"], r["begin"], r["end"], r["records"])

    return dealt.mapInArrow(run, f"{kind.schema}, file string, file_error string")


def read_cameras_binary(spark: SparkSession, paths: str | Sequence[str], range_bytes: int = RANGE_BYTES) -> DataFrame:
    return _read(spark, paths, CAMERAS, range_bytes)


def read_images_binary(spark: SparkSession, paths: str | Sequence[str], range_bytes: int = RANGE_BYTES) -> DataFrame:
    return _read(spark, paths, IMAGES, range_bytes)


def read_points_binary(spark: SparkSession, paths: str | Sequence[str], range_bytes: int = RANGE_BYTES) -> DataFrame:
    return _read(spark, paths, POINTS, range_bytes)
