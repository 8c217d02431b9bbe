"""Nearest-in-time match of camera poses and GPS fixes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.timestamps import parse_seconds, seconds_in_name

#: width of the time slices one task scans
SLICE_SECONDS = 600.0


def frame_times(poses: DataFrame, lookup: DataFrame | None = None, key: str = "flight_id") -> DataFrame:
    """Add ``ts_s``: from the lookup by frame id, then by image name, then the pose's own time, then its file name.

    ``lookup`` has ``(key, name, ts_s)``; of repeated names the last value in ``ts_s`` order is used.
    """
    own = parse_seconds(F.col("raw_time")) if "raw_time" in poses.columns else F.lit(None).cast("double")
    in_name = seconds_in_name(F.col("image_name"))
    if lookup is None:
        return poses.withColumn("ts_s", F.coalesce(own, in_name))
    named = lookup.groupBy(key, "name").agg(F.max("ts_s").alias("_ts"))
    by_id = named.select(key, F.col("name").alias("frame_id"), F.col("_ts").alias("_ts_id"))
    by_name = named.select(key, F.col("name").alias("image_name"), F.col("_ts").alias("_ts_name"))
    joined = poses.join(by_id, [key, "frame_id"], "left").join(by_name, [key, "image_name"], "left")
    return joined.withColumn("ts_s", F.coalesce("_ts_id", "_ts_name", own, in_name)).drop("_ts_id", "_ts_name")


def nearest_fix(
    poses: DataFrame,
    fixes: DataFrame,
    tolerance: float,
    key: str = "flight_id",
    slice_seconds: float = SLICE_SECONDS,
) -> DataFrame:
    """Every pose with the fix nearest in time; equal distances go to the earlier fix, equal times to the smaller seq.

    Flights are scanned in time slices, so a long flight is many tasks: the nearest fix lies either in the slice
    of the pose or is the last (first) fix of the closest filled slice before (after) it. Only distinct times
    enter the scan. Poses get ``gps_seq, gps_ts_s, gps_lat, gps_lon, gps_alt, time_diff_s, matched, unmatched_reason``;
    the fix is also reported when it is farther away than ``tolerance``.
    """
    fix = F.struct(F.col("ts_s").alias("ts_s"), "seq", "lat", "lon", "alt")
    at = F.floor(F.col("ts_s") / slice_seconds).alias("_slice")
    fix_times = fixes.groupBy(key, "ts_s").agg(F.min(F.struct("seq", "lat", "lon", "alt")).alias("_f")).select(
        key, "ts_s", "_f.*"
    ).select(key, "ts_s", fix.alias("_fix"), F.lit(0).alias("_side"), at)
    pose_times = poses.filter(F.col("ts_s").isNotNull()).select(key, "ts_s").distinct().select(
        key, "ts_s", F.lit(None).cast(fix_times.schema["_fix"].dataType).alias("_fix"), F.lit(1).alias("_side"), at
    )
    timeline = fix_times.unionByName(pose_times)

    forward = Window.partitionBy(key, "_slice").orderBy("ts_s", "_side")
    backward = Window.partitionBy(key, "_slice").orderBy(F.desc("ts_s"), F.desc("_side"))
    upto = (Window.unboundedPreceding, Window.currentRow)
    scanned = timeline.select(
        "*",
        F.last("_fix", ignorenulls=True).over(forward.rowsBetween(*upto)).alias("_before"),
        F.last("_fix", ignorenulls=True).over(backward.rowsBetween(*upto)).alias("_after"),
    ).filter("_side = 1")

    slices = timeline.groupBy(key, "_slice").agg(F.max("_fix").alias("_last"), F.min("_fix").alias("_first"))
    ascending = Window.partitionBy(key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    descending = Window.partitionBy(key).orderBy(F.desc("_slice")).rowsBetween(Window.unboundedPreceding, -1)
    carried = slices.select(
        key, "_slice",
        F.last("_last", ignorenulls=True).over(ascending).alias("_carry_before"),
        F.last("_first", ignorenulls=True).over(descending).alias("_carry_after"),
    )

    before, after = F.coalesce("_before", "_carry_before"), F.coalesce("_after", "_carry_after")
    pairs = scanned.join(carried, [key, "_slice"]).select(key, "ts_s", before.alias("_b"), after.alias("_a"))
    gap_before, gap_after = F.col("ts_s") - F.col("_b.ts_s"), F.col("_a.ts_s") - F.col("ts_s")
    best = F.when(F.col("_a").isNull() | (gap_before <= gap_after), F.col("_b")).otherwise(F.col("_a"))
    chosen = pairs.select(key, "ts_s", best.alias("_g"))

    diff = F.abs(F.col("ts_s") - F.col("_g.ts_s"))
    matched = F.coalesce(diff <= tolerance, F.lit(False))
    return poses.join(chosen, [key, "ts_s"], "left").select(
        *poses.columns,
        F.col("_g.seq").alias("gps_seq"),
        F.col("_g.ts_s").alias("gps_ts_s"),
        F.col("_g.lat").alias("gps_lat"),
        F.col("_g.lon").alias("gps_lon"),
        F.col("_g.alt").alias("gps_alt"),
        diff.alias("time_diff_s"),
        matched.alias("matched"),
        F.when(F.col("ts_s").isNull(), "no_timestamp")
        .when(F.col("_g").isNull(), "no_gps")
        .when(~matched, "over_tolerance").alias("unmatched_reason"),
    )


def sync_summary(synced: DataFrame, fixes: DataFrame, key: str = "flight_id") -> DataFrame:
    """Matched and unmatched counts of both sides, time differences and match rate per flight."""
    diff = F.when(F.col("matched"), F.col("time_diff_s"))
    per_fix = synced.groupBy(key, F.when(F.col("matched"), F.col("gps_seq")).alias("_seq")).agg(
        F.count(F.lit(1)).alias("_poses"), F.count_if("matched").alias("_matched"),
        F.sum(diff).alias("_sum"), F.max(diff).alias("_max"),
    )
    poses = per_fix.groupBy(key).agg(
        F.sum("_poses").alias("total_poses"), F.sum("_matched").alias("matched_poses"),
        F.count("_seq").alias("_used"), F.sum("_sum").alias("_sum"), F.max("_max").alias("_max"),
    )
    totals = fixes.groupBy(key).agg(F.count(F.lit(1)).alias("total_gps"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    total, matched = zero("total_poses"), zero("matched_poses")
    return poses.join(totals, key, "full").select(
        key,
        total.alias("total_poses"),
        zero("total_gps").alias("total_gps"),
        matched.alias("matched_poses"),
        (total - matched).alias("unmatched_poses"),
        (zero("total_gps") - zero("_used")).alias("unmatched_gps"),
        F.when(matched > 0, F.col("_sum") / matched).otherwise(0.0).alias("mean_time_diff_s"),
        F.coalesce("_max", F.lit(0.0)).alias("max_time_diff_s"),
        (matched / F.greatest(total, F.lit(1))).alias("match_rate"),
    )


def unmatched_poses(synced: DataFrame) -> DataFrame:
    return synced.filter(~F.col("matched"))


def unused_fixes(synced: DataFrame, fixes: DataFrame, key: str = "flight_id") -> DataFrame:
    used = synced.filter("matched").select(key, F.col("gps_seq").alias("seq")).distinct()
    return fixes.join(used, [key, "seq"], "left_anti")
