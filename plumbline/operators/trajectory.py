"""Frame order, steps between consecutive cameras and robust jump detection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import names
from plumbline.functions import rotation as R
from plumbline.operators.ordering import exact_median, is_hot, measured, with_position, with_previous

MAD_FACTOR = 3.5
FLAT_MAD = 1e-7


def with_centers(images: DataFrame) -> DataFrame:
    """Add the camera centre ``x, y, z`` and the nine rotation entries ``rot`` of world-to-camera image rows."""
    matrix = R.quaternion_to_matrix(*[F.col(c) for c in ("qw", "qx", "qy", "qz")])
    staged = images.withColumn("rot", F.array(*matrix))
    center = R.camera_center([F.col("rot")[i] for i in range(9)], [F.col(c) for c in ("tx", "ty", "tz")])
    return staged.select("*", *[c.alias(n) for c, n in zip(center, ("x", "y", "z"))])


def with_order_key(images: DataFrame, key: str = "flight_id", name: str = "name") -> DataFrame:
    """Add ``sort_no`` and ``ordered_by``: by frame number if every name of the flight has one, else by name."""
    numbered = images.withColumn("_no", names.frame_key(F.col(name)))
    lowest = numbered.groupBy(key).agg(F.min("_no").alias("_low"))
    return numbered.join(lowest, key).select(
        *images.columns,
        F.when(F.col("_low") >= 0, F.col("_no")).otherwise(0).alias("sort_no"),
        F.when(F.col("_low") >= 0, "frame_filename").otherwise("lexicographical").alias("ordered_by"),
    )


def frame_order(
    images: DataFrame, key: str = "flight_id", name: str = "name", tie: str = "image_id", hot_rows: float | None = None
) -> DataFrame:
    """Images with their 1-based ``pos`` in flight order."""
    limit = measured(images, [key]) if hot_rows is None else hot_rows
    keyed = with_order_key(images, key, name)
    return with_position(keyed, [key], [F.col("sort_no"), F.col(name), F.col(tie)], hot_rows=limit)


def steps(
    images: DataFrame, key: str = "flight_id", name: str = "name", tie: str = "image_id", hot_rows: float | None = None
) -> DataFrame:
    """One row per transition between consecutive frames: 0-based ``transition``, ``step`` and ``rotation_deg``.

    ``images`` carries ``x, y, z`` and ``rot`` (see :func:`with_centers`).
    """
    limit = measured(images, [key]) if hot_rows is None else hot_rows
    keyed = with_order_key(images, key, name).select(
        key, "sort_no", "ordered_by", F.col(name).alias("name"), F.col(tie).alias("tie"), "x", "y", "z", "rot"
    )
    moved = with_previous(
        keyed, [key], [F.col("sort_no"), F.col("name"), F.col("tie")], ["x", "y", "z", "rot"], hot_rows=limit
    ).filter("pos > 1")
    gaps = [F.col(c) - F.col(f"prev_{c}") for c in ("x", "y", "z")]
    angle = R.relative_angle_deg([F.col("prev_rot")[i] for i in range(9)], [F.col("rot")[i] for i in range(9)])
    return moved.select(
        key, (F.col("pos") - 2).alias("transition"), "name", "ordered_by",
        F.sqrt(gaps[0] * gaps[0] + gaps[1] * gaps[1] + gaps[2] * gaps[2]).alias("step"),
        angle.alias("rotation_deg"),
    )


def jump_cutoffs(
    values: DataFrame,
    value: str,
    threshold: float | None = None,
    key: str = "flight_id",
    hot: bool | None = None,
) -> DataFrame:
    """``(key, median, cutoff)``: the given threshold, or median + 3.5 MAD with a floor for flat series."""
    limit = 0 if hot else None
    if hot is None:
        limit = 0 if is_hot(values, [key], None) else None
    small = limit is None
    median_of = lambda df, column, name: (
        df.groupBy(key).agg(F.median(column).alias(name)) if small else exact_median(df, [key], column, name, 0)
    )
    medians = median_of(values, value, "median")
    if threshold is not None:
        return medians.withColumn("cutoff", F.lit(float(threshold)))
    deviations = values.join(medians, key).select(key, F.abs(F.col(value) - F.col("median")).alias("_dev"))
    mad = median_of(deviations, "_dev", "mad")
    flat = F.greatest(F.col("median") * 3.0, F.lit(1e-4))
    return medians.join(mad, key).select(
        key, "median",
        F.when(F.col("mad") < FLAT_MAD, flat).otherwise(F.col("median") + MAD_FACTOR * F.col("mad")).alias("cutoff"),
    )


def jump_flags(
    values: DataFrame, value: str, threshold: float | None = None, key: str = "flight_id", hot: bool | None = None
) -> DataFrame:
    """The transitions whose value is above the cutoff of their flight."""
    cutoffs = jump_cutoffs(values, value, threshold, key, hot)
    return values.join(cutoffs, key).filter(F.col(value) > F.col("cutoff"))


def trajectory_stats(
    flight_steps: DataFrame,
    max_position_jump: float | None = None,
    max_rotation_jump: float | None = None,
    key: str = "flight_id",
    hot: bool | None = None,
) -> DataFrame:
    """Mean, median and largest step and rotation, jump counts, and PASS or WARNING, per flight with two frames."""
    if hot is None:
        hot = is_hot(flight_steps, [key], None)
    moves = jump_cutoffs(flight_steps, "step", max_position_jump, key, hot)
    turns = jump_cutoffs(flight_steps, "rotation_deg", max_rotation_jump, key, hot)
    joined = flight_steps.join(
        moves.select(key, F.col("median").alias("_ms"), F.col("cutoff").alias("_cs")), key
    ).join(turns.select(key, F.col("median").alias("_mr"), F.col("cutoff").alias("_cr")), key)
    stats = joined.groupBy(key).agg(
        F.count(F.lit(1)).alias("transitions"),
        F.min("ordered_by").alias("ordered_by"),
        F.avg("step").alias("mean_step"),
        F.first("_ms").alias("median_step"),
        F.max("step").alias("max_step"),
        F.count_if(F.col("step") > F.col("_cs")).alias("position_jumps"),
        F.avg("rotation_deg").alias("mean_rotation_deg"),
        F.first("_mr").alias("median_rotation_deg"),
        F.max("rotation_deg").alias("max_rotation_deg"),
        F.count_if(F.col("rotation_deg") > F.col("_cr")).alias("rotation_jumps"),
    )
    bad = F.lit(False)
    if max_position_jump is not None:
        bad = bad | (F.col("position_jumps") > 0)
    if max_rotation_jump is not None:
        bad = bad | (F.col("rotation_jumps") > 0)
    return stats.withColumn("status", F.when(bad, "WARNING").otherwise("PASS"))
