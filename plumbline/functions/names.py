"""Frame numbers and identifiers taken from file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def frame_key(name: Column) -> Column:
    """The last group of digits as a number, -1 without digits."""
    return F.coalesce(F.regexp_extract(name, r"(\d+)\D*$", 1).try_cast("bigint"), F.lit(-1).cast("bigint"))


def stem(name: Column) -> Column:
    """File name without folder and last extension; a leading dot is no extension."""
    base = F.regexp_replace(name, r"^.*/", "")
    return F.regexp_replace(base, r"(?<=.)\.[^.]*$", "")


def frame_id(name: Column) -> Column:
    key = frame_key(name)
    return F.when(key >= 0, F.concat(F.lit("frame_"), padded(key))).otherwise(stem(name))


def padded(number: Column, width: int = 6) -> Column:
    """Decimal digits, zero-padded to ``width`` and never cut."""
    digits = number.cast("string")
    return F.lpad(digits, F.greatest(F.lit(width), F.length(digits)), F.lit("0"))
