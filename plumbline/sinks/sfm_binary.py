"""Sparse models as binary files."""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.params import CAMERA_MODELS
from plumbline.sources.files import file_system
from plumbline.sources.sfm_binary import CAMERAS, IMAGES, POINTS

#: records of one file
FILE_ROWS = 1_000_000
_CODES = {name: code for code, (name, _) in CAMERA_MODELS.items()}


def _tails(column: pa.Array, items: np.dtype) -> list[bytes]:
    """Each row's list as the bytes of its file layout; a null list is empty."""
    ends = np.cumsum(pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False)).astype(np.int64)
    values = column.flatten()
    flat = np.empty(len(values), items)
    if items.names is None:
        flat[:] = values.to_numpy(zero_copy_only=False)
    else:
        for name in items.names:
            flat[name] = values.field(name).to_numpy(zero_copy_only=False).astype(items[name])
    data, places = flat.tobytes(), [0, *(ends * items.itemsize).tolist()]
    return [data[a:b] for a, b in zip(places, places[1:])]


def _camera(tail: bytes, camera_id: int, model: str, width: int, height: int) -> bytes:
    if len(tail) != 8 * CAMERA_MODELS[_CODES[model]][1]:
        raise ValueError(f"camera {camera_id}: {len(tail) // 8} parameters do not fit {model}")
    return struct.pack("<iiQQ", camera_id, _CODES[model], width, height) + tail


def _image(tail: bytes, *values) -> bytes:
    return b"".join((struct.pack("<I7dI", *values[:-1]), values[-1].encode(), b"\0", struct.pack("<Q", len(tail) // IMAGES.items.itemsize), tail))


def _point(tail: bytes, *values) -> bytes:
    return b"".join((struct.pack("<q3d3Bd", *values), struct.pack("<Q", len(tail) // POINTS.items.itemsize), tail))


_LAYOUTS = {
    "cameras": (CAMERAS, "camera_id", "params", _camera), "images": (IMAGES, "image_id", "observations", _image),
    "points3D": (POINTS, "point3d_id", "track", _point),
}


def write_binary(table: DataFrame, name: str, path: str, key: str = "model_id", file_rows: int = FILE_ROWS) -> int:
    """Cameras, images or points3D as ``<path>/<name>/<key>=.../part-*.bin`` in id order; returns the records written.

    Every part is a complete file of at most ``file_rows`` records. A part is written under a name of its own and then moved, so
    a task that runs again replaces it by the same file and a reader never sees half of one.
    """
    kind, order, nested, encode = _LAYOUTS[name]
    fs, root = file_system(f"{path}/{name}")
    if fs.get_file_info(root).type.value:
        raise FileExistsError(f"{path}/{name}")
    plain = [part.split()[0] for part in kind.schema.split(", ")[1:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, base = file_system(f"{path}/{name}")
        part, serial, model, held, total = TaskContext.get().partitionId(), 0, None, [], 0

        def flush() -> None:
            nonlocal serial
            if held:
                folder = f"{base}/{key}={model}"
                target.create_dir(folder, recursive=True)
                own = f"{folder}/.{uuid.uuid4().hex}"
                with target.open_output_stream(own) as out:
                    out.write(struct.pack("<Q", len(held)))
                    out.writelines(held)
                target.move(own, f"{folder}/part-{part:05d}-{serial:05d}.bin")
                serial += 1
                held.clear()

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in plain]
            for own, tail, *values in zip(batch.column(key).to_pylist(), _tails(batch.column(nested), kind.items), *columns):
                if own != model or len(held) == file_rows:
                    flush()
                    model = own
                held.append(encode(tail, *values))
            total += batch.num_rows
        flush()
        yield pa.RecordBatch.from_pydict({"records": pa.array([total], pa.int64())})

    ordered = table.select(key, *plain, nested).repartitionByRange(F.col(key), F.col(order)).sortWithinPartitions(key, order)
    return ordered.mapInArrow(run, "records bigint").agg(F.sum("records")).first()[0] or 0
