"""Parsing of the many spellings of a time into seconds since the epoch."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Date layouts tried after numbers and ISO-8601, in this order.
LAYOUTS = (
    "yyyy-MM-dd HH:mm:ss.SSSSSS",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy/MM/dd HH:mm:ss.SSSSSS",
    "yyyy/MM/dd HH:mm:ss",
    "dd-MM-yyyy HH:mm:ss.SSSSSS",
    "dd-MM-yyyy HH:mm:ss",
)


def _seconds(ts: Column) -> Column:
    return F.unix_micros(ts) / 1e6


def parse_seconds(text: Column) -> Column:
    """Seconds since the epoch, UTC unless the text names an offset; NULL when nothing fits.

    Non-finite numbers count as unparsable.
    """
    s = F.trim(text)
    number = s.try_cast("double")
    finite = F.when(~F.isnan(number) & (F.abs(number) != float("inf")), number)
    iso = F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(s))
    parsed = [_seconds(iso)]
    for layout in LAYOUTS:
        if "SSSSSS" in layout:
            # any number of fraction digits up to six
            filled = F.regexp_replace(s, r"^(.*\.)(\d{1,6})$", "$1$2000000")
            filled = F.regexp_replace(filled, r"(\.\d{6})\d*$", "$1")
            parsed.append(_seconds(F.try_to_timestamp(filled, F.lit(layout))))
        else:
            parsed.append(_seconds(F.try_to_timestamp(s, F.lit(layout))))
    return F.when(number.isNotNull(), finite).otherwise(F.coalesce(*parsed))


def seconds_in_name(name: Column) -> Column:
    """A ten-digit epoch, with or without fraction, found in a file name."""
    return F.nullif(F.regexp_extract(name, r"(\d{10}(?:\.\d+)?)", 1), F.lit("")).try_cast("double")
