"""Camera poses from predicted extrinsic matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import rotation as R
from plumbline.functions.names import padded, stem


def normalize_extrinsics(predictions: DataFrame, mapping: DataFrame, key: str = "scene_id") -> DataFrame:
    """Published poses of 3x4 world-to-camera matrices ``(key, index, extrinsic)``.

    ``mapping`` ``(key, index, image_name)`` names the inputs; an input it does not list is named by its index.
    """
    m = F.col("extrinsic")
    rotation = [m[i][j] for i in range(3) for j in range(3)]
    center = R.camera_center(rotation, [m[i][3] for i in range(3)])
    fallback = F.concat(F.lit("frame_"), padded(F.col("index")), F.lit(".jpg"))
    named = predictions.join(mapping.select(key, "index", "image_name"), [key, "index"], "left").withColumn(
        "image_name", F.coalesce("image_name", fallback)
    )
    return named.select(
        key, "index", stem(F.col("image_name")).alias("frame_id"), "image_name",
        F.array(*[F.bround(c, 6) for c in center]).alias("position"),
        F.transform(R.matrix_to_quaternion(rotation), lambda v: F.bround(v, 6)).alias("rotation_quaternion"),
        F.lit("x right, y down, z forward; quaternion w first").alias("coordinate_convention"),
        F.lit("world_to_camera").alias("pose_type"),
    )
