"""JSON documents: poses, detections, frame logs and alignments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline import schemas
from plumbline.sources.files import file_stem, folder_key

Paths = str | Sequence[str]


def _json(spark: SparkSession, schema: str, paths: Paths) -> DataFrame:
    """Whole JSON documents with their file; an unparsable one gives a row with ``_corrupt_record``."""
    reader = spark.read.schema(schema + ", _corrupt_record string").option("multiLine", "true")
    reader = reader.option("recursiveFileLookup", "true").option("columnNameOfCorruptRecord", "_corrupt_record")
    return reader.json(paths if isinstance(paths, str) else list(paths)).withColumn("file", F.col("_metadata.file_path"))


def _unreadable() -> Column:
    """The reason why a document can't be read, with its file."""
    return F.when(F.col("_corrupt_record").isNotNull(), F.concat(F.lit("not a JSON document of this kind: "), F.col("file")))


def read_poses(spark: SparkSession, paths: Paths) -> DataFrame:
    """Camera poses from lists of pose records; the flight is the folder of the file below the given path.

    Rotation and intrinsics may be nested under ``rotation`` and ``intrinsics``. ``pose_error`` names documents or
    records that are no poses.
    """
    rows = _json(spark, schemas.POSE_JSON, paths)
    component = lambda array, i: F.try_element_at(array, F.lit(i + 1))
    either = lambda name: F.coalesce(name, f"intrinsics.{name}")
    return rows.select(
        folder_key(F.col("file"), paths).alias("flight_id"), "frame_id", "image_name", "image_id", "camera_id",
        F.col("timestamp").alias("raw_time"),
        *[component("position", i).alias(c) for i, c in enumerate("xyz")],
        *[component("rotation_quaternion", i).alias(c) for i, c in enumerate(("qw", "qx", "qy", "qz"))],
        F.coalesce("rotation_matrix", "rotation").alias("r"),
        F.coalesce("pose_type", F.lit("world_to_camera")).alias("pose_type"), "coordinate_convention",
        *[either(c).alias(c) for c in ("fl_x", "fl_y", "cx", "cy")],
        F.monotonically_increasing_id().alias("pose_no"),
        F.when(F.col("_corrupt_record").isNotNull(), "not a list of pose records")
        .when(F.size("position") < 3, "pose has no position").when(F.col("position").isNull(), "pose has no position")
        .alias("pose_error"),
    )


def flights_without_poses(expected: DataFrame, poses: DataFrame) -> DataFrame:
    have = poses.filter("pose_error IS NULL").select("flight_id").distinct()
    return expected.select("flight_id").distinct().join(have, "flight_id", "left_anti")


def read_frame_logs(spark: SparkSession, paths: Paths) -> DataFrame:
    """One row per logged frame with the totals of its log; the video is the folder below the given path.

    ``log_error`` names the file of a document that is no log, in a row without frame.
    """
    return _json(spark, schemas.FRAME_LOG_JSON, paths).select(
        folder_key(F.col("file"), paths).alias("video_id"), "source_video", "original_fps", "total_frames",
        "duration_seconds", "selected_frames", "blur_threshold_used", F.explode_outer("frames").alias("_f"), _unreadable().alias("log_error"),
    ).select("*", "_f.*").drop("_f")


def read_detections(spark: SparkSession, paths: Paths) -> DataFrame:
    """Detections of per-frame documents (``frame_stem``, ``detections``) or tracking logs (``frame``, ``objects``).

    ``detection_error`` names the file of a document that can't be read, in a row without class or box.
    """
    item = "struct<class:string,confidence:double,bbox:array<double>,object_id:bigint>"
    rows = _json(spark, f"frame_stem string, frame string, detections array<{item}>, objects array<{item}>", paths)
    nothing = F.array(F.lit(None).cast(item))
    listed = rows.select(
        folder_key(F.col("file"), paths).alias("video_id"), F.coalesce("frame_stem", "frame", file_stem(F.col("file"))).alias("frame_id"),
        _unreadable().alias("detection_error"),
        F.posexplode(F.when(F.col("_corrupt_record").isNotNull(), nothing).otherwise(F.coalesce("detections", "objects"))).alias("det_no", "_d"),
    )
    corner = lambda i: F.try_element_at("_d.bbox", F.lit(i))
    return listed.select(
        "video_id", "frame_id", "det_no", F.col("_d.class").alias("class"),
        F.when(F.col("detection_error").isNull(), F.coalesce("_d.confidence", F.lit(1.0))).alias("confidence"),
        *[corner(i + 1).alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))], F.col("_d.object_id").alias("object_id"), "detection_error",
    )


def read_alignments(spark: SparkSession, paths: Paths) -> DataFrame:
    """Published similarity of each cloud; rows with ``alignment_error`` are unusable, absent sections mean no transform."""
    rows = _json(spark, schemas.ALIGNMENT_JSON, paths)
    a = F.col("alignment")
    square = (F.size(a["rotation_matrix"]) == 3) & F.forall(a["rotation_matrix"], lambda row: F.size(row) == 3)
    broken = ~(F.coalesce(square & (F.size(a["translation_vector"]) == 3), F.lit(False)))
    return rows.filter(F.col("_corrupt_record").isNotNull() | a.isNotNull()).select(
        folder_key(F.col("file"), paths).alias("cloud_id"), a["scale"].alias("scale"), a["rotation_matrix"].alias("r"),
        a["translation_vector"].alias("t"), "target_crs",
        F.when(F.col("_corrupt_record").isNotNull(), "not a JSON document").when(broken, "rotation or translation malformed")
        .when(~F.coalesce(a["scale"] > 0, F.lit(False)), "scale is not positive").alias("alignment_error"),
    )
