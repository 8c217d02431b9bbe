"""Training-set preparation for many scenes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import dataset
from plumbline.operators.ordering import measured

KEY = "scene_id"


def prepare(
    images: DataFrame,
    poses: DataFrame,
    points: DataFrame | None = None,
    target_radius: float = 1.0,
    normalize: bool = True,
    compat: bool = False,
) -> dict[str, DataFrame]:
    """Tables ``frames``, ``intrinsics``, ``normalization``, ``points``, ``scenes`` and ``match`` per scene.

    The scene is centred and scaled by the cameras that have an image; ``points`` must already be in the frame of
    the poses.
    """
    matched = dataset.match_images(images, poses)
    used = matched.filter("match_status = 'matched'").select(KEY, "pose_no")
    turned = dataset.camera_to_world(poses, compat).filter("pose_error IS NULL")
    centers = used.join(turned.select(KEY, "pose_no", "x", "y", "z"), [KEY, "pose_no"])
    normalization = dataset.scene_normalization(centers, target_radius)
    if not normalize:
        normalization = normalization.select(
            KEY, *[F.lit(0.0).alias(f"o{c}") for c in ("x", "y", "z")], F.lit(1.0).alias("norm_scale"), "images"
        )
    placed = dataset.normalize(turned, normalization)
    counts = matched.groupBy(KEY).agg(
        F.count_if(F.col("match_status") == "matched").alias("matched"),
        F.count_if(F.col("match_status") == "unreadable").alias("unreadable"),
        F.count_if(F.col("match_status") == "no_pose").alias("without_pose"),
    )
    scenes = counts.withColumn("status", F.when(F.col("matched") > 0, "READY").otherwise("FAILED"))
    tables = {
        "match": matched,
        "frames": dataset.manifest_frames(matched, placed, hot_rows=measured(images, [KEY])),
        "intrinsics": dataset.intrinsics(matched, poses),
        "normalization": normalization,
        "record": dataset.normalization_record(normalization, matched, target_radius),
        "scenes": scenes,
    }
    if points is not None:
        tables["points"] = dataset.normalize(points, normalization)
    return tables
