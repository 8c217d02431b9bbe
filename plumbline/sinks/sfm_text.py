"""Sparse models as text files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_GREY = 128


def camera_lines(cameras: DataFrame, key: str = "model_id") -> DataFrame:
    params = F.array_join(F.transform("params", lambda p: F.format_string("%.6f", p)), " ")
    return cameras.select(key, F.col("camera_id").alias("pos"), F.concat_ws(
        " ", F.col("camera_id").cast("string"), "model", F.col("width").cast("string"), F.col("height").cast("string"), params).alias("line"))


def image_lines(images: DataFrame, key: str = "model_id") -> DataFrame:
    """Pose line and observation line of each image; the second is blank without observations."""
    pose = F.format_string(
        "%d %.8f %.8f %.8f %.8f %.8f %.8f %.8f %d %s", "image_id", "qw", "qx", "qy", "qz", "tx", "ty", "tz", "camera_id", "name")
    points = F.lit("")
    if "observations" in images.columns:
        points = F.coalesce(F.array_join(F.transform("observations", lambda o: F.format_string(
            "%.6f %.6f %d", o["px"], o["py"], o["point3d_id"])), " "), F.lit(""))
    return images.select(key, F.col("image_id").alias("pos"), F.concat(pose, F.lit("\n"), points).alias("line"))


def point_lines(points: DataFrame, key: str = "model_id") -> DataFrame:
    """Points with six decimals; missing colours are grey, missing errors zero."""
    colors = [F.coalesce(F.col(c).cast("int"), F.lit(DEFAULT_GREY)) for c in "rgb"] if "r" in points.columns else [F.lit(DEFAULT_GREY)] * 3
    error = F.coalesce("error", F.lit(0.0)) if "error" in points.columns else F.lit(0.0)
    line = F.concat(
        F.format_string("%d %.6f %.6f %.6f %d %d %d ", "point3d_id", "x", "y", "z", *colors), error.cast("string"))
    if "track" in points.columns:
        track = F.array_join(F.transform("track", lambda t: F.format_string("%d %d", t["image_id"], t["point2d_idx"])), " ")
        line = F.when(F.size("track") > 0, F.concat(line, F.lit(" "), track)).otherwise(line)
    return points.select(key, F.col("point3d_id").alias("pos"), line.alias("line"))


def write_model(
    cameras: DataFrame, images: DataFrame, points: DataFrame, path: str, key: str = "model_id", mode: str = "errorifexists"
) -> None:
    """``<path>/{cameras,images,points3D}/<key>=.../part-*`` in id order; the parts in name order are the text file."""
    parts = (("cameras", cameras, "camera_id", camera_lines), ("images", images, "image_id", image_lines), ("points3D", points, "point3d_id", point_lines))
    for name, rows, pos, lines in parts:
        # rows are dealt before their lines are written out, else the sample for the ranges writes them out as well
        ordered = rows.repartitionByRange(F.col(key), F.col(pos)).sortWithinPartitions(key, pos)
        lines(ordered, key).select(key, "line").write.mode(mode).partitionBy(key).text(f"{path}/{name}")
