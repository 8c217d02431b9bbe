"""Queries that write given tables in a file format below the checkpoint folder and read them back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.params import CAMERA_MODELS
from plumbline.queries.spark import query, r4
from plumbline.queries.views import view
from plumbline.session import checkpoint_dir
from plumbline.sinks.documents import write_pose_json
from plumbline.sinks.sfm_binary import write_binary
from plumbline.sinks.sfm_text import write_model
from plumbline.sources import gps_csv, ply, sfm_model
from plumbline.sources.documents import read_poses


def _folder(spark) -> str:
    return f"{checkpoint_dir(spark)}/files-{uuid.uuid4().hex}"


def _tables(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The camera, image and point views in the layout of the model readers."""
    sizes = F.create_map(*[F.lit(x) for name, size in CAMERA_MODELS.values() for x in (name, size)])
    cameras = view(spark, sf_dir, "v_cameras").select(
        "model_id", "camera_id", "model", F.lit(1920).alias("width"), F.lit(1080).alias("height"),
        F.transform(F.sequence(F.lit(1), sizes[F.col("model")]), lambda i: (i * 100 + F.col("camera_id")).cast("double")).alias("params"),
    )
    seen = view(spark, sf_dir, "v_observations").groupBy("image_id").agg(
        F.array_sort(F.collect_list(F.struct("point2d_idx", "px", "py", "point3d_id"))).alias("observations")
    )
    return cameras, view(spark, sf_dir, "v_images").join(seen, "image_id", "left"), view(spark, sf_dir, "v_points3d")


def _model(spark, sf_dir) -> str:
    """The camera, image and point views as the text files of one model."""
    path = _folder(spark)
    write_model(*_tables(spark, sf_dir), path)
    return path


@query
def file_cameras_text(spark, sf_dir):
    back = sfm_model.read_cameras_text(spark, f"{_model(spark, sf_dir)}/cameras")
    total = F.aggregate("params", F.lit(0.0), lambda a, b: a + b)
    return back.select("camera_id", "model", "width", "height", F.size("params").alias("n_params"), total.alias("total"))


@query
def file_images_text(spark, sf_dir):
    back = sfm_model.read_images_text(spark, f"{_model(spark, sf_dir)}/images")
    ids = F.aggregate("observations", F.lit(0).cast("bigint"), lambda a, o: a + o["point3d_id"])
    px = F.aggregate("observations", F.lit(0.0), lambda a, o: a + o["px"]).alias("px")
    return back.select(
        "image_id", "camera_id", "name", F.size("observations").alias("n_observations"), ids.alias("point_ids"), "qw", "qz", "tx", px
    ).select("image_id", "camera_id", "name", "n_observations", "point_ids", *r4("qw", "qz", "tx", "px"))


@query
def file_points_text(spark, sf_dir):
    good, _ = sfm_model.read_points_text(spark, f"{_model(spark, sf_dir)}/points3D", strict=True)
    return good.select("point3d_id", *r4("x", "y", "z"), F.size("track").alias("n_track"))


#: small, so that files of the given tables are cut into several ranges
_RANGE_BYTES = 64 << 10


@query
def file_cameras_binary(spark, sf_dir):
    path = _folder(spark)
    write_binary(_tables(spark, sf_dir)[0], "cameras", path)
    back = sfm_model.read_cameras_binary(spark, f"{path}/cameras", _RANGE_BYTES).filter("file_error IS NULL")
    total = F.aggregate("params", F.lit(0.0), lambda a, b: a + b)
    return back.select("camera_id", "model", "width", "height", F.size("params").alias("n_params"), total.alias("total"))


@query
def file_images_binary(spark, sf_dir):
    """Poses turned about all axes, which a file must keep in their order."""
    path = _folder(spark)
    turned = _tables(spark, sf_dir)[1].withColumns({
        "qx": F.col("qz") * 0.5, "qy": F.col("qw") * -0.25, "ty": F.col("tx") + 1.0, "tz": F.col("tx") - 2.0})
    write_binary(turned, "images", path, file_rows=5_000)
    back = sfm_model.read_images_binary(spark, f"{path}/images", _RANGE_BYTES).filter("file_error IS NULL")
    ids = F.aggregate("observations", F.lit(0).cast("bigint"), lambda a, o: a + o["point3d_id"])
    px = F.aggregate("observations", F.lit(0.0), lambda a, o: a + o["px"]).alias("px")
    poses = ("qw", "qx", "qy", "qz", "tx", "ty", "tz")
    return back.select(
        "image_id", "camera_id", "name", F.size("observations").alias("n_observations"), ids.alias("point_ids"), *poses, px
    ).select("image_id", "camera_id", "name", "n_observations", "point_ids", *r4(*poses, "px"))


@query
def file_points_binary(spark, sf_dir):
    """Points with their tracks."""
    path = _folder(spark)
    seen = view(spark, sf_dir, "v_observations").groupBy("point3d_id").agg(
        F.array_sort(F.collect_list(F.struct("image_id", "point2d_idx"))).alias("track"))
    colors = {c: (F.col("point3d_id") % n).cast("smallint") for c, n in (("r", 256), ("g", 251), ("b", 241))}
    points = _tables(spark, sf_dir)[2].join(seen, "point3d_id", "left").withColumns(
        {**colors, "error": (F.col("point3d_id") % 8).cast("double") / 8})
    write_binary(points, "points3D", path, file_rows=5_000)
    back = sfm_model.read_points_binary(spark, f"{path}/points3D", _RANGE_BYTES).filter("file_error IS NULL")
    ids = F.aggregate("track", F.lit(0).cast("bigint"), lambda a, t: a + t["image_id"] * t["point2d_idx"])
    return back.select("point3d_id", *r4("x", "y", "z"), "r", "g", "b", "error", F.size("track").alias("n_track"), ids.alias("track_ids"))


@query
def file_pose_json(spark, sf_dir):
    path = _folder(spark)
    write_pose_json(view(spark, sf_dir, "v_images"), path)
    back = read_poses(spark, path).filter("pose_error IS NULL")
    return back.select("image_id", "camera_id", "frame_id", "image_name", "pose_type", *r4("x", "y", "z"))


@query
def file_gps_csv(spark, sf_dir):
    path = _folder(spark)
    fixes = view(spark, sf_dir, "v_gps").select("flight_id", F.col("ts_s").alias("utc_time"), F.col("lon").alias("lng"), "lat", "alt")
    # files of many flights: one for each flight would make files, not rows, the work
    fixes.write.option("header", "true").csv(path)
    checked, _ = gps_csv.read_gps_csv(spark, path)
    return checked.filter("reject_reason IS NULL").select(F.col("flight_id").cast("bigint").alias("flight_id"), *r4("ts_s", "lat", "lon", "alt"))


def _ply(spark, sf_dir, encoding: str) -> DataFrame:
    path = _folder(spark)
    ply.register(spark)
    points = view(spark, sf_dir, "v_points_big").select("x", "y", "z", *[F.col(c).cast("smallint").alias(c) for c in "rgb"])
    points.write.format("ply").option("encoding", encoding).option("maxRows", 20_000).mode("append").save(path)
    return spark.read.format("ply").load(path).select(*r4("x", "y", "z"), "r", "g", "b")


@query
def file_ply_binary(spark, sf_dir):
    return _ply(spark, sf_dir, "binary")


@query
def file_ply_ascii(spark, sf_dir):
    return _ply(spark, sf_dir, "ascii")
