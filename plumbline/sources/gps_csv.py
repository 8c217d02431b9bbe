"""GPS and IMU logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.gps import check_rows
from plumbline.params import GPS_ALIASES
from plumbline.sources.files import lines, stem_key

#: names the flight of each row in files that hold many flights
FLIGHT_COLUMN = "flight_id"


def _cells(value: Column) -> Column:
    """Cells of a CSV line; the quote-aware split runs only on lines that have quotes."""
    quoted = F.transform(
        F.split(value, r',(?=(?:[^"]*"[^"]*")*[^"]*$)'), lambda c: F.regexp_replace(F.regexp_replace(c, r'^\s*"|"\s*$', ""), '""', '"')
    )
    return F.when(value.contains('"'), quoted).otherwise(F.split(value, ","))


def _headers(rows: DataFrame) -> DataFrame:
    """Per file the cell numbers of the four columns, by the first alias present, and what is missing."""
    first = rows.groupBy("file").agg(F.min_by("cells", "line_id").alias("_h"), F.min("line_id").alias("_header_id"))
    lowered = F.transform("_h", lambda c: F.lower(F.trim(c)))
    at = {
        name: F.coalesce(*[F.nullif(F.array_position(lowered, alias), F.lit(0)) for alias in aliases])
        for name, aliases in GPS_ALIASES.items()
    }
    missing = F.array_compact(F.array(*[
        F.when(c.isNull(), F.lit(f"missing column '{name}', expected one of {', '.join(GPS_ALIASES[name])}"))
        for name, c in at.items()
    ]))
    return first.select(
        "file", "_header_id", *[c.cast("int").alias(f"_{name}") for name, c in at.items()],
        F.nullif(F.array_position(lowered, FLIGHT_COLUMN), F.lit(0)).cast("int").alias("_flight"),
        F.when(F.size(missing) > 0, missing[0]).alias("file_error"),
    )


def read_gps_csv(
    spark: SparkSession, paths: str | Sequence[str], altitude_reference: str = "WGS84_ellipsoidal"
) -> tuple[DataFrame, DataFrame]:
    """Checked rows of many logs (see :func:`plumbline.operators.gps.check_rows`) and the files with a broken header.

    Every file may name its columns differently. The flight is the file below the given path, without ending, or what the
    row has in a column ``flight_id``, so that one file can hold many flights. ``seq`` is the order in the file.
    """
    rows = lines(spark, paths).filter(F.trim(F.regexp_replace("value", "[,\"]", "")) != "").withColumn("cells", _cells(F.col("value")))
    headers = _headers(rows)
    joined = rows.join(headers, "file").filter((F.col("line_id") > F.col("_header_id")) & F.col("file_error").isNull())
    needed = F.greatest(*[F.col(f"_{name}") for name in GPS_ALIASES])
    cell = lambda name: F.trim(F.try_element_at("cells", F.col(f"_{name}")))
    short = F.size("cells") < needed
    raw = joined.select(
        F.coalesce(F.nullif(cell("flight"), F.lit("")), stem_key(F.col("file"), paths)).alias("flight_id"), "file", F.col("line_id").alias("seq"), short.alias("incomplete"),
        *[F.coalesce(cell(n), F.lit("")).alias(t) for n, t in (
            ("timestamp", "time_text"), ("latitude", "lat_text"), ("longitude", "lon_text"), ("altitude", "alt_text"))],
        F.lit(altitude_reference).alias("altitude_reference"),
    )
    bad_files = headers.filter("file_error IS NOT NULL").select(stem_key(F.col("file"), paths).alias("flight_id"), "file", "file_error")
    return check_rows(raw), bad_files


def imu_availability(spark: SparkSession, paths: str | Sequence[str], expected: DataFrame) -> DataFrame:
    """One row per expected flight: whether its IMU log could be read, and its record count.

    JSON holds a list or ``{"records": [...]}``; anything else is CSV with a header line.
    """
    texts = spark.read.option("recursiveFileLookup", "true")
    is_json = F.lower("file").endswith(".json")
    csv = lines(spark, paths).filter(~is_json & (F.trim("value") != "")).groupBy("file").agg(
        (F.count(F.lit(1)) - 1).alias("total_records")
    )
    whole = texts.option("wholetext", "true").text(paths if isinstance(paths, str) else list(paths)).select(
        F.col("_metadata.file_path").alias("file"), "value"
    ).filter(is_json)
    records = F.coalesce(F.json_array_length("value"), F.json_array_length(F.get_json_object("value", "$.records")))
    is_object = F.json_object_keys("value").isNotNull()
    # an object without records is readable but empty
    json = whole.select("file", F.coalesce(records, F.when(is_object, 0)).cast("bigint").alias("total_records"))
    found = csv.unionByName(json).select(stem_key(F.col("file"), paths).alias("flight_id"), F.col("file"), "total_records")
    return expected.select("flight_id").distinct().join(found, "flight_id", "left").select(
        "flight_id", F.col("total_records").isNotNull().alias("imu_available"), "total_records",
        F.when(F.col("file").isNull(), "no IMU file").when(F.col("total_records").isNull(), "parsing failed").alias("reason"),
    )
