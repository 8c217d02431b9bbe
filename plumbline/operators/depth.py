"""World points from depth maps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import rotation as R

MIN_CONFIDENCE = 5.0
MAX_POINTS = 50_000


def unproject(depth_rows: DataFrame, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Confident pixels as world points.

    ``depth_rows`` holds one image row per line: ``scene_id, image_no, row, depth, confidence`` (arrays over the
    columns) with ``fx, fy, cx, cy`` and the world-to-camera ``rot`` (nine entries) and ``tx, ty, tz``.
    """
    pixels = depth_rows.select(
        "scene_id", "image_no", "row", "fx", "fy", "cx", "cy", "rot", "tx", "ty", "tz",
        F.posexplode(F.arrays_zip("depth", "confidence")).alias("col", "_p"),
    ).filter(F.col("_p.confidence") >= min_confidence)
    z = F.col("_p.depth").cast("double")
    camera = [(F.col("col") - F.col("cx")) * z / F.col("fx"), (F.col("row") - F.col("cy")) * z / F.col("fy"), z]
    shifted = [c - F.col(t) for c, t in zip(camera, ("tx", "ty", "tz"))]
    world = R.apply(R.transpose([F.col("rot")[i] for i in range(9)]), shifted)
    return pixels.select(
        "scene_id", "image_no", "row", "col", F.col("_p.confidence").alias("confidence"),
        *[w.alias(n) for w, n in zip(world, ("x", "y", "z"))],
    )


def first_points(points: DataFrame, cap: int = MAX_POINTS, key: str = "scene_id") -> DataFrame:
    """The first ``cap`` points of each scene in image, row, column order (the size limit of the exported cloud).

    A scene is first narrowed to whole image rows by their counts, so no task sorts all of its pixels.
    """
    rows = points.groupBy(key, "image_no", "row").agg(F.count(F.lit(1)).alias("_n"))
    images = rows.groupBy(key, "image_no").agg(F.sum("_n").alias("_image_n"))
    image_order = Window.partitionBy(key).orderBy("image_no").rowsBetween(Window.unboundedPreceding, -1)
    row_order = Window.partitionBy(key, "image_no").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    started = images.select(key, "image_no", F.coalesce(F.sum("_image_n").over(image_order), F.lit(0)).alias("_start"))
    offsets = rows.join(started.filter(F.col("_start") < cap), [key, "image_no"]).withColumn(
        "_before", F.col("_start") + F.coalesce(F.sum("_n").over(row_order), F.lit(0))
    ).filter(F.col("_before") < cap).select(key, "image_no", "row", "_before")
    inside = Window.partitionBy(key, "image_no", "row").orderBy("col")
    return (
        points.join(offsets, [key, "image_no", "row"])
        .withColumn("_rank", F.col("_before") + F.row_number().over(inside))
        .filter(F.col("_rank") <= cap).drop("_before", "_rank")
    )
