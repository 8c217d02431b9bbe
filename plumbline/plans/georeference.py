"""From local camera poses and GPS fixes to georeferenced cameras, per flight."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import utm
from plumbline.operators import similarity, timesync
from plumbline.session import cut

MIN_MATCHES = 3
MIN_RATE = 0.5
KEY = "flight_id"


def georeference(
    poses: DataFrame,
    fixes: DataFrame,
    tolerance: float = 1.0,
    target_epsg: int | None = None,
    imu: DataFrame | None = None,
    altitude_reference: str = "WGS84_ellipsoidal",
) -> dict[str, DataFrame]:
    """Match, project, fit and transform all flights.

    Returns the tables ``flights`` (status, fit and checks), ``cameras`` (new poses), ``trajectory`` (local, metric and
    WGS84 positions with the matched fix) and ``features`` (one GeoJSON feature per row, in order). A flight that
    cannot be fitted is a row with status ERROR and a reason; its cameras are left out.
    """
    synced = cut(timesync.nearest_fix(poses, fixes, tolerance))
    matched = synced.filter("matched")
    # the mean matched position picks the zone of the flight
    centers = matched.groupBy(KEY).agg(
        F.avg("gps_lon").alias("_lon"), F.avg("gps_lat").alias("_lat"),
        (F.max("gps_lon") - F.min("gps_lon") > 180).alias("crosses_antimeridian"),
    )
    zone = utm.zone_epsg(F.col("_lon"), F.col("_lat")) if target_epsg is None else F.lit(target_epsg)
    zones = centers.select(KEY, zone.alias("epsg"), "crosses_antimeridian")
    placed = matched.join(zones.filter(utm.is_utm(F.col("epsg"))), KEY).withColumn(
        "_utm", utm.to_utm(F.col("gps_lon"), F.col("gps_lat"), F.col("epsg"))
    )
    pairs = placed.select(
        KEY, "frame_id", "x", "y", "z",
        F.col("_utm.easting").alias("gx"), F.col("_utm.northing").alias("gy"), F.col("gps_alt").alias("gz"),
    )
    fits = cut(similarity.fit(similarity.pair_moments(pairs)))
    good = fits.filter("status <> 'ERROR'")
    residuals = similarity.residuals(pairs, good)
    quality = similarity.fit_quality(residuals, fits)

    moved = similarity.transform_poses(synced, good).join(good.select(KEY), KEY, "left_semi").join(
        zones.select(KEY, "epsg"), KEY
    )
    wgs = utm.to_wgs84(F.col("new_x"), F.col("new_y"), F.col("epsg"))
    located = moved.withColumn("_wgs", wgs)
    gaps = [F.col("new_x") - F.col("_fix.easting"), F.col("new_y") - F.col("_fix.northing"), F.col("new_z") - F.col("gps_alt")]
    fix_metric = F.when(F.col("matched"), utm.to_utm(F.col("gps_lon"), F.col("gps_lat"), F.col("epsg")))
    located = located.withColumn("_fix", fix_metric).withColumn(
        "residual_m", F.sqrt(gaps[0] * gaps[0] + gaps[1] * gaps[1] + gaps[2] * gaps[2])
    )
    wgs84 = F.struct(
        F.bround("_wgs.lon", 7).alias("longitude"), F.bround("_wgs.lat", 7).alias("latitude"),
        F.bround("new_z", 3).alias("altitude"),
    )
    metric = F.array(*[F.bround(c, 4) for c in ("new_x", "new_y", "new_z")])
    cameras = located.select(
        KEY, "frame_id", "image_name", metric.alias("position"),
        F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.transform(
            F.slice(F.col("new_r"), i * 3 + 1, 3), lambda v: F.bround(v, 6))).alias("rotation_matrix"),
        F.transform("new_q", lambda v: F.bround(v, 6)).alias("rotation_quaternion"),
        utm.crs_code(F.col("epsg")).alias("coordinate_system"), wgs84.alias("wgs84"),
    )
    gps_struct = F.when(F.col("matched"), F.struct(
        F.col("gps_seq").alias("seq"), F.col("gps_ts_s").alias("timestamp"), F.col("gps_lat").alias("latitude"),
        F.col("gps_lon").alias("longitude"), F.col("gps_alt").alias("altitude"),
        F.bround("time_diff_s", 4).alias("time_difference_s"),
    ))
    trajectory = located.select(
        KEY, "frame_id", "image_name", F.col("ts_s").alias("timestamp"), F.array("x", "y", "z").alias("local_position"),
        metric.alias("georeferenced_position"), wgs84.alias("wgs84_position"), gps_struct.alias("matched_gps"),
        F.bround("residual_m", 4).alias("residual_m"),
    )
    return {
        "flights": flight_rows(poses, synced, fixes, quality, zones, imu, altitude_reference),
        "cameras": cameras,
        "trajectory": trajectory,
        "features": point_features(trajectory),
    }


def flight_rows(poses, synced, fixes, quality, zones, imu, altitude_reference) -> DataFrame:
    """One verdict row per flight that has poses."""
    summary = timesync.sync_summary(synced, fixes).join(poses.select(KEY).distinct(), KEY, "left_semi")
    joined = summary.join(quality, KEY, "left").join(zones, KEY, "left")
    if imu is None:
        joined = joined.withColumn("imu_available", F.lit(False))
    else:
        joined = joined.join(imu.select(KEY, "imu_available"), KEY, "left").fillna(False, ["imu_available"])
    epsg = F.col("epsg")
    unsupported = epsg.isNotNull() & ~utm.is_utm(epsg)
    reason = (
        F.when(F.col("matched_poses") == 0, "no pose has a fix within tolerance")
        .when(unsupported, "target is no UTM zone")
        .when(F.col("matched_poses") < MIN_MATCHES, "fewer than 3 pairs")
        .otherwise(F.col("reason"))
    )
    sync_check = F.when(F.col("match_rate") >= MIN_RATE, "PASS").otherwise("WARNING")
    staged = joined.withColumn("_reason", reason).withColumn("synchronization_check", sync_check)
    status = (
        F.when(unsupported, "UNSUPPORTED_CRS").when(F.col("_reason").isNotNull(), "ERROR")
        .when((F.col("status") == "WARNING") | (F.col("synchronization_check") == "WARNING"), "WARNING").otherwise("PASS")
    )
    return staged.select(
        KEY, utm.crs_code(epsg).alias("target_crs"), utm.crs_name(epsg).alias("target_name"),
        "total_poses", "matched_poses", "unmatched_poses", "unmatched_gps", "match_rate", "mean_time_diff_s",
        "max_time_diff_s", "synchronization_check", "scale", "r", "t", "rmse", "max_error",
        F.col("status").alias("rmse_check"), "imu_available", F.lit(altitude_reference).alias("altitude_reference"),
        F.coalesce("crosses_antimeridian", F.lit(False)).alias("crosses_antimeridian"),
        status.alias("status"), F.col("_reason").alias("reason"), "notes",
    )


def metadata_documents(flights: DataFrame) -> DataFrame:
    """Published metadata per flight, rounded as documents are."""
    return flights.select(KEY, F.struct(
        F.lit("EPSG:4326").alias("source_crs"), F.col("target_crs"), F.col("target_name").alias("coordinate_system"),
        F.lit("similarity_transform").alias("alignment_method"), F.bround("scale", 8).alias("scale"),
        F.col("matched_poses").alias("matched_observations"), F.bround("rmse", 4).alias("alignment_rmse"),
        F.bround("max_error", 4).alias("alignment_max_error"), F.col("altitude_reference"),
        F.lit(True).alias("gps_available"), F.col("imu_available"),
        F.struct("total_poses", "matched_poses", "unmatched_poses", "unmatched_gps",
                 *[F.bround(c, 4).alias(c) for c in ("match_rate", "mean_time_diff_s", "max_time_diff_s")]).alias("synchronization"),
        F.struct(
            F.bround("scale", 8).alias("scale"),
            F.transform("r", lambda row: F.transform(row, lambda v: F.bround(v, 8))).alias("rotation_matrix"),
            F.transform("t", lambda v: F.bround(v, 4)).alias("translation_vector"), F.col("notes"),
        ).alias("alignment"),
        F.struct(F.col("status"), F.col("synchronization_check"), F.col("rmse_check")).alias("validation"),
    ).alias("metadata"))


def point_features(trajectory: DataFrame) -> DataFrame:
    """One GeoJSON point feature per camera as text."""
    where = F.array("wgs84_position.longitude", "wgs84_position.latitude", "wgs84_position.altitude")
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("Point").alias("type"), where.alias("coordinates")).alias("geometry"),
        F.struct(
            "frame_id", "image_name", F.col("wgs84_position.altitude").alias("altitude_m"), "residual_m",
            F.col("matched_gps").isNotNull().alias("matched_gps"),
        ).alias("properties"),
    )
    return trajectory.select(
        KEY, "frame_id", "image_name", where.alias("coordinates"),
        F.to_json(feature, {"ignoreNullFields": "false"}).alias("feature"),
    )
