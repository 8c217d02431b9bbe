"""Row rules, quarantine and metadata of GPS logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.timestamps import parse_seconds

# Cell texts that mean "no value".
MISSING_WORDS = ("", "nan", "null", "none")

ERROR_SAMPLE = 5


def check_rows(raw: DataFrame, time_unit: float = 1.0, angle_unit: float = 1.0) -> DataFrame:
    """Parse text columns ``time_text, lat_text, lon_text, alt_text`` and name the first broken rule.

    ``reject_reason`` is NULL for a usable fix. ``incomplete`` may already be set by the reader for short rows.
    The units divide parsed numbers, for logs in microseconds or scaled degrees.
    """
    texts = ["time_text", "lat_text", "lon_text", "alt_text"]
    missing = F.lit(False)
    for t in texts:
        missing = missing | F.lower(F.trim(t)).isin(*MISSING_WORDS)
    numbers = {t: F.trim(F.col(t)).try_cast("double") for t in texts[1:]}
    ts = parse_seconds(F.col("time_text")) / time_unit
    lat, lon, alt = numbers["lat_text"] / angle_unit, numbers["lon_text"] / angle_unit, numbers["alt_text"]
    short = F.col("incomplete") if "incomplete" in raw.columns else F.lit(False)
    null_cell = F.lit(False)
    for t in texts:
        null_cell = null_cell | F.col(t).isNull()
    # NaN compares as larger than every number, so the range tests refuse it
    parsed = raw.select("*", ts.alias("ts_s"), lat.alias("lat"), lon.alias("lon"), alt.alias("alt"))
    reason = (
        F.when(short | null_cell, "incomplete")
        .when(missing, "missing")
        .when(F.col("ts_s").isNull(), "bad_timestamp")
        .when(F.col("lat").isNull(), "bad_latitude")
        .when(~F.col("lat").between(-90, 90), "latitude_range")
        .when(F.col("lon").isNull(), "bad_longitude")
        .when(~F.col("lon").between(-180, 180), "longitude_range")
        .when(F.col("alt").isNull(), "bad_altitude")
        .when(F.isnan("alt") | (F.abs("alt") == float("inf")), "altitude_not_finite")
    )
    return parsed.withColumn("reject_reason", reason)


def valid_fixes(checked: DataFrame) -> DataFrame:
    return checked.filter(F.col("reject_reason").isNull()).drop("reject_reason")


def quarantine(checked: DataFrame) -> DataFrame:
    return checked.filter(F.col("reject_reason").isNotNull())


def flag_duplicate_times(fixes: DataFrame, key: str = "flight_id") -> DataFrame:
    """Mark every fix whose time an earlier row of the flight already has; nothing is removed."""
    first = fixes.groupBy(key, "ts_s").agg(F.min("seq").alias("_first"))
    return fixes.join(first, [key, "ts_s"]).withColumn("is_duplicate_time", F.col("seq") > F.col("_first")).drop("_first")


def error_sample(checked: DataFrame, key: str = "flight_id", limit: int = ERROR_SAMPLE) -> DataFrame:
    """The first few rejected rows per flight, for the failure text.

    ``row_number <= limit`` is applied before the shuffle as well, so a bad flight stays cheap.
    """
    bad = quarantine(checked).filter("reject_reason <> 'missing'").select(key, "seq", "reject_reason")
    rank = F.row_number().over(Window.partitionBy(key).orderBy("seq", "reject_reason"))
    first = bad.withColumn("_rank", rank).filter(F.col("_rank") <= limit)
    listed = first.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("seq", "reject_reason"))).alias("_l"))
    return listed.select(key, F.transform("_l", lambda m: F.concat(
        F.lit("row "), m["seq"].cast("string"), F.lit(": "), m["reject_reason"])).alias("first_errors"))


def metadata(checked: DataFrame, key: str = "flight_id") -> DataFrame:
    """Counts, time span and status per flight; a flight without one usable fix is FAILED.

    Times are grouped first, so duplicate counting needs no window over a whole flight.
    """
    good = F.col("reject_reason").isNull()
    per_time = checked.groupBy(key, F.when(good, F.col("ts_s")).alias("_ts")).agg(
        F.count_if(good).alias("_valid"),
        F.count_if(F.col("reject_reason") == "missing").alias("_missing"),
        F.count_if(~good & (F.col("reject_reason") != "missing")).alias("_errors"),
    )
    return per_time.groupBy(key).agg(
        F.sum("_valid").alias("valid_rows"),
        F.sum(F.greatest(F.col("_valid") - 1, F.lit(0))).alias("duplicate_timestamps"),
        F.sum("_missing").alias("missing_rows"),
        F.sum("_errors").alias("error_rows"),
        F.min("_ts").alias("time_start"),
        F.max("_ts").alias("time_end"),
        F.round(F.max("_ts") - F.min("_ts"), 3).alias("duration_seconds"),
        F.when(F.sum("_valid") > 0, "OK").otherwise("FAILED").alias("status"),
    )


def zone_span_warning(min_lon: Column, max_lon: Column) -> Column:
    """Set when fixes straddle the antimeridian, where a mean longitude names the wrong zone."""
    return (max_lon - min_lon) > 180
