"""Cleaning of many point clouds: outliers, voxel grid, ground analysis and a stage report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import clouds
from plumbline.params import CloudCleaning
from plumbline.session import cut

KEY = "cloud_id"


def clean(points: DataFrame, plan: CloudCleaning = CloudCleaning(), cloud_meta: DataFrame | None = None) -> dict[str, DataFrame]:
    """Tables ``points``, ``before``, ``after``, ``stages``, ``report`` and, if enabled, ``ground``.

    Stages that need statistics of the previous one work on its written result. Clouds that fail validation
    are reported in ``before`` and not cleaned.
    """
    before = cut(clouds.validate_clouds(points))
    bad = before.filter("status = 'ERROR'").select(KEY)
    current = points.join(bad, KEY, "left_anti")
    stages = [("input", current)]
    if plan.statistical:
        current = cut(clouds.remove_statistical_outliers(current, plan.neighbors, plan.std_ratio))
        stages.append(("statistical_outliers", current))
    if plan.radius_enabled and plan.radius is not None:
        current = cut(clouds.remove_radius_outliers(current, plan.radius, plan.min_points))
        stages.append(("radius_outliers", current))
    if plan.voxel_size is not None:
        current = cut(clouds.voxel_downsample(current, plan.voxel_size))
        stages.append(("voxel_downsample", current))
    after = cut(clouds.validate_clouds(current))
    rows = cut(clouds.stage_report(clouds.stage_counts(stages), [name for name, _ in stages]))
    tables = {"points": current, "before": before, "after": after, "stages": rows,
              "report": cleaning_report(before, after, rows, cloud_meta, plan.voxel_size)}
    if plan.ground_enabled:
        tables["ground"] = clouds.ground_planes(
            current, plan.ground_distance, plan.ground_iterations, plan.seed,
            id_column="point_id" if "point_id" in current.columns else "x",
        )
    return tables


def cleaning_report(
    before: DataFrame, after: DataFrame, stages: DataFrame, cloud_meta: DataFrame | None = None, voxel_size: float | None = None
) -> DataFrame:
    """Per cloud: points in and out, retention and warnings of the result."""
    last = stages.groupBy(KEY).agg(
        F.min_by("points", "stage_no").alias("input_points"), F.max_by("points", "stage_no").alias("final_points"),
        F.max_by("total_retention", "stage_no").alias("retention_rate"),
        F.max_by("excessive_removal", "stage_no").alias("excessive_removal"),
    )
    joined = before.select(KEY, F.col("status").alias("input_status"), F.col("reason")).join(last, KEY, "left").join(
        after.select(KEY, F.col("warnings").alias("_w")), KEY, "left"
    )
    local = F.lit(None).cast("string")
    if cloud_meta is not None:
        flags = cloud_meta.select(KEY, F.coalesce("is_georeferenced", F.lit(False)).alias("_geo"), "crs", "units")
        joined = joined.join(flags, KEY, "left")
        if voxel_size is not None:
            local = F.when(~F.col("_geo"), "voxel size is in local, unscaled units")
    warnings = F.array_compact(F.concat(
        F.coalesce("_w", F.array().cast("array<string>")),
        F.array(F.when(F.col("excessive_removal"), "less than 30 % of the points remain"), local),
    ))
    shown = ["crs", "units"] if cloud_meta is not None else []
    return joined.select(
        KEY, "input_points", "final_points", (F.col("input_points") - F.col("final_points")).alias("removed_points"),
        "retention_rate", *shown, warnings.alias("warnings"), "reason",
        F.when(F.col("input_status") == "ERROR", "ERROR").when(F.size(warnings) > 0, "WARNING").otherwise("PASS").alias("status"),
    )
