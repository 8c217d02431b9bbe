"""Pose quality: registration, reprojection error and trajectory, with one verdict per model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import reprojection, trajectory
from plumbline.operators.ordering import is_hot, measured


def verdicts(
    images: DataFrame,
    inputs: DataFrame,
    errors: DataFrame,
    minimum_rate: float = 0.80,
    max_rmse: float = 1.0,
    max_position_jump: float | None = None,
    max_rotation_jump: float | None = None,
    partial: bool = False,
    hot: bool | None = None,
) -> DataFrame:
    """One row per model of ``inputs`` with the three checks and ``validation_status``.

    All three must be PASS; a trajectory warning therefore fails the model.
    """
    key = "model_id"
    rates = reprojection.registration_rate(images, inputs, key, minimum_rate)
    pixels = reprojection.reprojection_stats(errors, key, max_rmse, partial, hot)
    limit = measured(images, [key])
    moves = trajectory.steps(trajectory.with_centers(images), key, hot_rows=limit)
    paths = trajectory.trajectory_stats(moves, max_position_jump, max_rotation_jump, key, hot=limit == 0)
    joined = rates.join(pixels, key, "left").join(paths.withColumnRenamed("status", "_path"), key, "left")
    trajectory_check = (
        F.when(F.col("registered_images") >= 2, F.col("_path"))
        .when(F.col("registered_images") > 0, "FAIL").otherwise("NOT_AVAILABLE")
    )
    checked = joined.withColumn("trajectory_check", trajectory_check).withColumn(
        "reprojection_check", F.coalesce("reprojection_check", F.lit("NOT_AVAILABLE"))
    ).withColumn("reprojection_status", F.coalesce("reprojection_status", F.lit("NOT_AVAILABLE"))).drop("_path")
    passed = [F.col(c) == "PASS" for c in ("registration_check", "reprojection_check", "trajectory_check")]
    warnings = F.array_compact(F.array(
        F.when(~passed[0], F.format_string("registration rate %.1f%% is below the minimum", F.col("registration_rate") * 100)),
        F.when(F.col("reprojection_check") == "FAIL", F.format_string("reprojection RMSE %.4f px is above the maximum", F.col("rmse_px"))),
        F.when(F.col("reprojection_check") == "NOT_AVAILABLE", "reprojection error could not be computed"),
        F.when(F.col("registered_images") < 2, "too few registered images for a trajectory"),
    ))
    return checked.withColumn(
        "validation_status", F.when(passed[0] & passed[1] & passed[2], "PASS").otherwise("FAIL")
    ).withColumn("warnings", warnings)


def validate_models(
    cameras: DataFrame,
    images: DataFrame,
    observations: DataFrame,
    points: DataFrame,
    inputs: DataFrame | None = None,
    **limits: object,
) -> DataFrame:
    """Quality of many models at once from their four tables; ``inputs`` lists the images each model was given."""
    errors = reprojection.reprojection_errors(observations, points, images, cameras)
    hot = is_hot(observations, ["model_id"], None)
    return verdicts(images, images if inputs is None else inputs, errors, hot=hot, **limits)


def trajectory_rows(images: DataFrame, key: str = "model_id") -> DataFrame:
    """Ordered camera positions as they are published: rounded centre and quaternion per frame."""
    from plumbline.functions.names import frame_id

    ordered = trajectory.frame_order(trajectory.with_centers(images), key)
    return ordered.select(
        key, "pos", frame_id(F.col("name")).alias("frame_id"), F.col("name").alias("image_name"), "image_id",
        F.array(*[F.bround(c, 6) for c in ("x", "y", "z")]).alias("position"),
        F.array(*[F.bround(c, 6) for c in ("qw", "qx", "qy", "qz")]).alias("rotation_quaternion"),
    )


def reports(checked: DataFrame, minimum_rate: float = 0.80, max_rmse: float = 1.0) -> DataFrame:
    """Nested report per model: checks, thresholds and warnings."""
    return checked.select("model_id", F.struct(
        F.col("validation_status"),
        F.struct("registered_images", "total_images", "unregistered_images", "registration_rate",
                 F.col("registration_check").alias("status")).alias("registration"),
        F.struct(F.col("reprojection_status").alias("status"),
                 *[F.bround(c, 4).alias(c) for c in ("mean_px", "median_px", "rmse_px", "max_px")],
                 "observations_used", F.col("reprojection_check").alias("check")).alias("reprojection"),
        F.struct(F.col("trajectory_check").alias("status"), "ordered_by",
                 *[F.bround(c, 4).alias(c) for c in ("mean_step", "median_step", "max_step")], "position_jumps",
                 *[F.bround(c, 2).alias(c) for c in ("mean_rotation_deg", "median_rotation_deg", "max_rotation_deg")],
                 "rotation_jumps").alias("trajectory"),
        F.struct(F.lit(minimum_rate).alias("minimum_registration_rate"),
                 F.lit(max_rmse).alias("maximum_reprojection_rmse_px")).alias("thresholds"),
        F.col("warnings"),
    ).alias("report"))
