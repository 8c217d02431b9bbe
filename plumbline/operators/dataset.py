"""Training-set preparation: image/pose matching, camera-to-world poses, scene normalisation, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import rotation as R
from plumbline.functions.names import stem
from plumbline.operators.ordering import with_position

FOCAL_FACTOR = 1.2


def match_images(images: DataFrame, poses: DataFrame, key: str = "scene_id") -> DataFrame:
    """Each image with the pose of its name, else of its stem, ignoring case; later poses win.

    ``images`` has ``image_name, readable``; ``poses`` has ``pose_no, image_name, frame_id``. Adds ``pose_no``,
    the pose's ``frame_id`` and ``match_status``: matched, unreadable or no_pose. Only keys and pose numbers are shuffled.
    """
    names = poses.filter("image_name <> ''")
    by_name = names.groupBy(key, F.lower("image_name").alias("_name")).agg(F.max("pose_no").alias("_by_name"))
    stems = names.select(key, F.lower(stem(F.col("image_name"))).alias("_stem"), "pose_no").unionByName(
        poses.filter("frame_id <> ''").select(key, F.lower("frame_id").alias("_stem"), "pose_no")
    )
    by_stem = stems.groupBy(key, "_stem").agg(F.max("pose_no").alias("_by_stem"))
    joined = (
        images.withColumn("_name", F.lower("image_name")).withColumn("_stem", F.lower(stem(F.col("image_name"))))
        .join(by_name, [key, "_name"], "left").join(by_stem, [key, "_stem"], "left")
    )
    pose_no = F.coalesce("_by_name", "_by_stem")
    found = joined.select(
        *images.columns, F.when(F.col("readable"), pose_no).alias("pose_no"),
        F.when(~F.col("readable"), "unreadable").when(pose_no.isNull(), "no_pose").otherwise("matched").alias("match_status"),
    )
    ids = poses.select(key, "pose_no", F.col("frame_id").alias("_frame_id"))
    return found.join(ids, [key, "pose_no"], "left").select(
        *images.columns, "pose_no", "match_status",
        F.when(F.col("match_status") == "matched", F.coalesce("_frame_id", stem(F.col("image_name")))).alias("frame_id"),
    )


def poses_without_image(poses: DataFrame, matched: DataFrame, key: str = "scene_id") -> DataFrame:
    used = matched.filter("match_status = 'matched'").select(key, "pose_no").distinct()
    return poses.join(used, [key, "pose_no"], "left_anti")


def camera_to_world(poses: DataFrame, compat: bool = False) -> DataFrame:
    """Add ``c2w``: camera-to-world rotation entries with Y and Z camera axes reversed, and ``pose_error``.

    ``x, y, z`` is the camera centre. The rotation comes from ``r``, else the quaternion, else identity, and is
    inverted for world-to-camera poses; ``compat`` skips that inversion and takes every rotation as it is.
    """
    identity = [F.lit(1.0 if i % 4 == 0 else 0.0) for i in range(9)]
    given = R.matrix_columns(F.col("r")) if "r" in poses.columns else [F.lit(None).cast("double")] * 9
    from_q = R.quaternion_to_matrix(*[F.col(c) for c in ("qw", "qx", "qy", "qz")])
    staged = poses.withColumn("_m", F.array(*[F.coalesce(g, q, i) for g, q, i in zip(given, from_q, identity)]))
    own = [F.col("_m")[i] for i in range(9)]
    flipped = F.array(*R.flip_camera_axes(own))
    if not compat:
        inverted = F.array(*R.flip_camera_axes(R.transpose(own)))
        flipped = F.when(F.col("pose_type") == "world_to_camera", inverted).otherwise(flipped)
    missing = F.col("x").isNull() | F.col("y").isNull() | F.col("z").isNull()
    return staged.select(*poses.columns, flipped.alias("c2w"), F.when(missing, "pose has no position").alias("pose_error"))


def scene_normalization(centers: DataFrame, target_radius: float = 1.0, key: str = "scene_id") -> DataFrame:
    """``(key, ox, oy, oz, norm_scale, images)``: mean camera centre and the scale that brings the farthest to the radius."""
    means = centers.groupBy(key).agg(
        *[F.avg(c).alias(f"o{c}") for c in ("x", "y", "z")], F.count(F.lit(1)).alias("images")
    )
    gaps = [F.col(c) - F.col(f"o{c}") for c in ("x", "y", "z")]
    far = centers.join(means, key).groupBy(key).agg(
        F.sqrt(F.max(gaps[0] * gaps[0] + gaps[1] * gaps[1] + gaps[2] * gaps[2])).alias("_far")
    )
    return means.join(far, key).select(
        key, "ox", "oy", "oz",
        F.when(F.col("_far") < 1e-6, 1.0).otherwise(target_radius / F.col("_far")).alias("norm_scale"), "images",
    )


def normalize(rows: DataFrame, normalization: DataFrame, key: str = "scene_id") -> DataFrame:
    """Points or camera centres in the normalised scene; rotations do not change."""
    joined = rows.join(normalization.select(key, "ox", "oy", "oz", "norm_scale"), key)
    moved = [(F.col("norm_scale") * (F.col(c) - F.col(f"o{c}"))).alias(c) for c in ("x", "y", "z")]
    return joined.select(*[c for c in rows.columns if c not in ("x", "y", "z")], *moved)


def denormalize(rows: DataFrame, normalization: DataFrame, key: str = "scene_id") -> DataFrame:
    """Inverse of :func:`normalize`; NULL coordinates where the scale is near zero."""
    joined = rows.join(normalization.select(key, "ox", "oy", "oz", "norm_scale"), key)
    scale = F.when(F.abs("norm_scale") > 1e-12, F.col("norm_scale"))
    moved = [(F.col(c) / scale + F.col(f"o{c}")).alias(c) for c in ("x", "y", "z")]
    return joined.select(*[c for c in rows.columns if c not in ("x", "y", "z")], *moved)


def intrinsics(matched: DataFrame, poses: DataFrame, key: str = "scene_id") -> DataFrame:
    """Per scene the focal lengths and centre of the first image's pose, else defaults from the image size."""
    size = F.struct("image_name", "width", "height", "pose_no")
    first = matched.filter("match_status = 'matched'").groupBy(key).agg(F.min(size).alias("_i")).select(key, "_i.*")
    given = poses.select(key, "pose_no", "fl_x", "fl_y", "cx", "cy")
    joined = first.join(given, [key, "pose_no"], "left")
    focal = FOCAL_FACTOR * F.greatest("width", "height")
    focal_given = F.col("fl_x").isNotNull() & F.col("fl_y").isNotNull()
    center_given = F.col("cx").isNotNull() & F.col("cy").isNotNull()
    pick = lambda given, column, default: F.round(F.when(given, F.col(column)).otherwise(default), 4).alias(column)
    return joined.select(
        key, F.lit("OPENCV").alias("camera_model"),
        pick(focal_given, "fl_x", focal), pick(focal_given, "fl_y", focal),
        pick(center_given, "cx", F.col("width") / 2), pick(center_given, "cy", F.col("height") / 2),
        F.col("width").alias("w"), F.col("height").alias("h"),
    )


def manifest_frames(
    matched: DataFrame, normalized_poses: DataFrame, key: str = "scene_id", folder: str = "images",
    hot_rows: float | None = None,
) -> DataFrame:
    """One manifest row per matched image: path, 4x4 matrix, 1-based number in name order and frame id."""
    rows = matched.filter("match_status = 'matched'").select(key, "pose_no", "image_name", "frame_id")
    numbered = with_position(rows, [key], [F.col("image_name"), F.col("pose_no")], name="colmap_im_id", hot_rows=hot_rows)
    matrices = normalized_poses.select(
        key, "pose_no",
        R.homogeneous([F.col("c2w")[i] for i in range(9)], [F.col(c) for c in ("x", "y", "z")]).alias("transform_matrix"),
    )
    return numbered.join(matrices, [key, "pose_no"]).select(
        key, "colmap_im_id", F.concat(F.lit(f"{folder}/"), F.col("image_name")).alias("file_path"),
        "frame_id", "transform_matrix",
    )


def normalization_record(
    normalization: DataFrame, matched: DataFrame, target_radius: float = 1.0, crs: Column | None = None, key: str = "scene_id"
) -> DataFrame:
    """Document with offset, scale, formulas, provenance and counts per scene."""
    # The keys below are the layout of the training set's normalization file.
    counts = matched.groupBy(key).agg(
        F.count_if(F.col("match_status") == "matched").alias("total_images_processed"),
        F.count_if(F.col("match_status") == "unreadable").alias("unreadable_images_count"),
        F.count_if(F.col("match_status") == "no_pose").alias("missing_pose_images_count"),
    )
    source = F.lit(None).cast("string") if crs is None else crs
    return normalization.join(counts, key).select(key, F.struct(
        F.struct(
            source.alias("source_crs"),
            F.when(source.isNotNull(), "metres").otherwise("local_unscaled").alias("source_units"),
            source.isNotNull().alias("is_georeferenced"),
        ).alias("coordinate_system"),
        F.struct(
            F.array(*[F.bround(c, 6) for c in ("ox", "oy", "oz")]).alias("center_offset"),
            F.bround("norm_scale", 8).alias("scale_factor"), F.lit(target_radius).alias("target_radius"),
            F.lit("normalized = (source - center_offset) * scale_factor").alias("formula"),
            F.lit("source = center_offset + normalized / scale_factor").alias("inverse_formula"),
        ).alias("normalization"),
        F.struct("total_images_processed", "unreadable_images_count", "missing_pose_images_count").alias("summary"),
    ).alias("record"))
