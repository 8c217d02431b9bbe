"""A keyed table kept up to date by a stream in update mode.

Each batch writes the keys it changed and nothing else, below its own number; readers take the newest version of a key. Now
and then the versions are merged into a base, so that a reader need not go through the whole history.

Retries: a batch that runs again replaces its own folder. A base counts only once its mark is written after it, and a marked base
is never written again, so a merge that was interrupted starts anew and a finished one stays. What a merge replaces is deleted when the
next one is done; a reader that listed the table before has until then.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from plumbline.sources.files import file_system

#: batches between looks at whether the log has outgrown the base
EVERY = 16


def _numbered(path: str, kind: str) -> list[int]:
    """Numbers of the batches that have an entry below ``path/kind``."""
    fs, root = file_system(f"{path}/{kind}")
    found = fs.get_file_info(pyarrow.fs.FileSelector(root, allow_not_found=True))
    return sorted(int(m[1]) for m in (re.fullmatch(r"batch_id=(\d+)", f.base_name) for f in found) if m)


def _bytes(path: str, kind: str, batches: Sequence[int]) -> int:
    fs, root = file_system(f"{path}/{kind}")
    listed = (fs.get_file_info(pyarrow.fs.FileSelector(f"{root}/batch_id={b}")) for b in batches)
    return sum(f.size or 0 for files in listed for f in files if f.is_file)


def _versions(spark: SparkSession, path: str, schema: StructType, base: int | None, log: Sequence[int]) -> DataFrame:
    """All versions of all keys from a base and the batches after it, with ``batch_id``."""
    folders = [f"{path}/log/batch_id={b}" for b in log] + ([f"{path}/base/batch_id={base}"] if base is not None else [])
    full = StructType([*schema.fields]).add("_version", LongType())
    if not folders:
        return spark.createDataFrame([], full)
    return spark.read.schema(full).parquet(*folders)


def _newest(versions: DataFrame, keys: Sequence[str]) -> DataFrame:
    rest = [c for c in versions.columns if c not in keys]
    return versions.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_version").alias("_v")).select(*keys, "_v.*")


def _state(path: str) -> tuple[int | None, list[int]]:
    """The newest marked base, and the batches after it."""
    marks = _numbered(path, "marks")
    base = marks[-1] if marks else None
    return base, [b for b in _numbered(path, "log") if base is None or b > base]


def compact(spark: SparkSession, path: str, schema: StructType, keys: Sequence[str]) -> bool:
    """Merge the newest base and the batches after it into a new base; false if there is nothing to merge."""
    base, log = _state(path)
    if not log:
        return False
    merged = _newest(_versions(spark, path, schema, base, log), keys)
    merged.write.mode("overwrite").parquet(f"{path}/base/batch_id={log[-1]}")
    fs, marks = file_system(f"{path}/marks")
    fs.create_dir(marks, recursive=True)
    fs.open_output_stream(f"{marks}/batch_id={log[-1]}").close()
    # what the former base had replaced: no reader that saw that base needs it
    for kind, known in (("log", _numbered(path, "log")), ("base", _numbered(path, "base"))):
        folder = file_system(f"{path}/{kind}")[1]
        for old in known:
            if base is not None and (old <= base if kind == "log" else old < base):
                fs.delete_dir(f"{folder}/batch_id={old}")
    return True


def change_log(path: str, keys: Sequence[str], every: int = EVERY) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function for update mode.

    Every ``every`` batches the log is merged if it takes as many bytes as the base, so over time merging writes no more than a small
    multiple of what the batches write.
    """

    def write(changed: DataFrame, batch_id: int) -> None:
        changed.withColumn("_version", F.lit(batch_id).cast("bigint")).write.mode("overwrite").parquet(f"{path}/log/batch_id={batch_id}")
        if (batch_id + 1) % every == 0:
            base, log = _state(path)
            if log and (base is None or _bytes(path, "log", log) >= _bytes(path, "base", [base])):
                compact(changed.sparkSession, path, changed.schema, keys)

    return write


def current(spark: SparkSession, path: str, schema: StructType, keys: Sequence[str]) -> DataFrame:
    """The newest version of every key; a table without batches is empty."""
    base, log = _state(path)
    return _newest(_versions(spark, path, schema, base, log), keys).select(*schema.names)
