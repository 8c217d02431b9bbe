"""Small helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.session import partitions  # noqa: F401

#: a word: no space, tab, line feed, vertical tab, form feed or carriage return
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(column: Column | str) -> Column:
    """The text's bytes; null counts as empty. Arrow then hands over bytes without decoding them."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column, F.lit("")).cast("binary")


def lower_ascii(column: Column | str) -> Column:
    """A-Z to lower case, all other letters untouched."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(column, upper, upper.lower())


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that ``column`` holds about ``most_bytes`` each; a longer single value stays alone."""
    for batch in batches:
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start = held = 0
        for row, size in enumerate(sizes.tolist()):
            if held and held + size > most_bytes:
                yield batch.slice(start, row - start)
                start, held = row, 0
            held += size
        if start < batch.num_rows:
            yield batch.slice(start)


_SEPARATORS = bytes(b for b in range(128) if not chr(b).isalnum())
_TO_WORDS = bytes.maketrans(
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" + _SEPARATORS, b"abcdefghijklmnopqrstuvwxyz" + b" " * len(_SEPARATORS)
)


def words(text: bytes) -> list[bytes]:
    """Lower-cased runs of a-z, 0-9 and bytes beyond ASCII."""
    return text.translate(_TO_WORDS).split()
