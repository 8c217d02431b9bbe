"""Observations joined with their points and cameras, and the pixel error of each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import camera as C
from plumbline.functions import rotation as R
from plumbline.operators.ordering import exact_median, is_hot


def camera_rows(images: DataFrame, cameras: DataFrame, key: str = "model_id") -> DataFrame:
    """Images with rotation entries and lens, computed once per image instead of once per observation."""
    lenses = cameras.select(key, "camera_id", C.canonical(F.col("model"), F.col("params")).alias("lens"))
    matrix = R.quaternion_to_matrix(*[F.col(c) for c in ("qw", "qx", "qy", "qz")])
    return images.join(lenses, [key, "camera_id"]).select(
        key, "image_id", "tx", "ty", "tz", "lens", *[m.alias(f"r{i}") for i, m in enumerate(matrix)]
    )


def reprojection_errors(
    observations: DataFrame, points: DataFrame, images: DataFrame, cameras: DataFrame, key: str = "model_id"
) -> DataFrame:
    """``(key, image_id, point2d_idx, point3d_id, error_px, unsupported)`` for every usable observation.

    Observations without a point, with an unknown point or camera, or behind the camera drop out; with an
    unsupported lens they stay with a NULL error.
    """
    used = observations.filter("point3d_id >= 0")
    joined = used.join(camera_rows(images, cameras, key), [key, "image_id"]).join(
        points.select(key, "point3d_id", "x", "y", "z"), [key, "point3d_id"]
    )
    world = [F.col(c) for c in ("x", "y", "z")]
    shift = [F.col(c) for c in ("tx", "ty", "tz")]
    local = [v + t for v, t in zip(R.apply([F.col(f"r{i}") for i in range(9)], world), shift)]
    seen = joined.select(
        key, "image_id", "point2d_idx", "point3d_id", "px", "py", "lens",
        *[v.alias(n) for v, n in zip(local, ("cx", "cy", "cz"))],
    ).filter(F.col("cz") > C.MIN_DEPTH)
    u, v = C.project(F.col("lens"), F.col("cx"), F.col("cy"), F.col("cz"))
    dx, dy = u - F.col("px"), v - F.col("py")
    return seen.select(
        key, "image_id", "point2d_idx", "point3d_id",
        F.sqrt(dx * dx + dy * dy).alias("error_px"), F.col("lens").isNull().alias("unsupported"),
    )


def reprojection_stats(
    errors: DataFrame,
    key: str = "model_id",
    max_rmse: float = 1.0,
    partial: bool = False,
    hot: bool | None = None,
) -> DataFrame:
    """Mean, median, RMSE, maximum and verdict per model.

    One observation through an unsupported lens makes the whole model NOT_AVAILABLE unless ``partial``. ``hot``
    says whether a model may exceed one task's memory; measured when not given.
    """
    e = F.col("error_px")
    sums = [
        F.count(e).alias("observations_used"), F.bool_or("unsupported").alias("any_unsupported"),
        F.avg(e).alias("mean"), F.sqrt(F.avg(e * e)).alias("rmse"), F.max(e).alias("max"),
    ]
    if hot is None:
        hot = is_hot(errors, [key], None)
    if hot:
        stats = errors.groupBy(key).agg(*sums).join(exact_median(errors, [key], "error_px", hot_rows=0), key, "left")
    else:
        stats = errors.groupBy(key).agg(*sums, F.median(e).alias("median"))
    available = F.col("observations_used") > 0
    if not partial:
        available = available & ~F.col("any_unsupported")
    shown = lambda c: F.when(available, F.col(c))
    return stats.select(
        key,
        F.when(available, "AVAILABLE").otherwise("NOT_AVAILABLE").alias("reprojection_status"),
        F.when(available, F.col("observations_used")).otherwise(0).alias("observations_used"),
        shown("mean").alias("mean_px"), shown("median").alias("median_px"),
        shown("rmse").alias("rmse_px"), shown("max").alias("max_px"),
        F.when(~available, "NOT_AVAILABLE").when(F.round("rmse", 4) <= max_rmse, "PASS").otherwise("FAIL")
        .alias("reprojection_check"),
    )


def registration_rate(
    registered: DataFrame, inputs: DataFrame, key: str = "model_id", minimum: float = 0.80
) -> DataFrame:
    """Registered against all input images; without an input list the registered count is the baseline."""
    have = registered.groupBy(key).agg(F.count(F.lit(1)).alias("registered_images"))
    total = inputs.groupBy(key).agg(F.count(F.lit(1)).alias("total_images"))
    joined = have.join(total, key, "full")
    reg = F.coalesce("registered_images", F.lit(0))
    all_images = F.coalesce("total_images", "registered_images")
    rate = F.round(F.when(all_images > 0, reg / all_images).otherwise(0.0), 4)
    return joined.select(
        key, reg.alias("registered_images"), all_images.alias("total_images"),
        F.greatest(all_images - reg, F.lit(0)).alias("unregistered_images"), rate.alias("registration_rate"),
        F.when((rate >= minimum) & (reg > 0), "PASS").otherwise("FAIL").alias("registration_check"),
    )
