"""Detections to masks: filtering, box clipping, area of unions and coverage."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.params import DYNAMIC_CLASSES
from plumbline.schemas import DETECTION
from plumbline.session import cut, partitions

#: frames and detections that one task is given
TASK_ROWS = 500_000

_FRAME = ("video_id", "frame_id")


def detect(
    frames: DataFrame, detector: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], key: str = "video_id"
) -> DataFrame:
    """Run the caller's detector over frame batches; it yields detection rows and can load its model once per task."""
    key_type = dict(frames.dtypes)[key]
    return frames.mapInPandas(detector, f"{key} {key_type}, {DETECTION}")


def filter_detections(
    detections: DataFrame, classes: Iterable[str] = DYNAMIC_CLASSES, min_confidence: float = 0.25
) -> DataFrame:
    """Detections of the wanted classes, ignoring case, at or above the confidence."""
    wanted = sorted({c.lower() for c in classes})
    return detections.filter(F.lower("class").isin(*wanted) & (F.col("confidence") >= min_confidence))


def clip_boxes(detections: DataFrame) -> DataFrame:
    """Boxes cut to whole pixels and to the image; empty ones stay, with no area. Needs ``width, height``."""
    clipped = {
        "x1": F.greatest(F.lit(0), F.col("x1").cast("int")),
        "y1": F.greatest(F.lit(0), F.col("y1").cast("int")),
        "x2": F.least(F.col("width").cast("int"), F.col("x2").cast("int")),
        "y2": F.least(F.col("height").cast("int"), F.col("y2").cast("int")),
    }
    return detections.withColumns(clipped)


def mask_runs(boxes: DataFrame, frame: Sequence[str] = _FRAME) -> DataFrame:
    """The union of the boxes of each frame as disjoint pixel runs ``y1, y2, x1, x2`` (half-open).

    A frame is cut at the distinct box edges into horizontal strips; within a strip the x-intervals are merged.
    Boxes are deduplicated and intervals with one start reduced to the longest before any window, so a window
    never holds more rows than the image has columns.
    """
    distinct = boxes.filter("x2 > x1 AND y2 > y1").select(*frame, "x1", "y1", "x2", "y2").distinct()
    edges = distinct.groupBy(*frame).agg(
        F.array_sort(F.array_union(F.collect_set("y1"), F.collect_set("y2"))).alias("_edges")
    )
    starts = F.filter("_edges", lambda e: (e >= F.col("y1")) & (e < F.col("y2")))
    strips = distinct.join(edges, list(frame)).select(*frame, F.explode(starts).alias("sy"), "_edges", "x1", "x2")
    next_edge = F.element_at("_edges", (F.array_position("_edges", F.col("sy")) + 1).cast("int"))
    longest = (
        strips.select(*frame, "sy", next_edge.alias("ey"), "x1", "x2")
        .groupBy(*frame, "sy", "ey", "x1").agg(F.max("x2").alias("x2"))
    )
    row = Window.partitionBy(*frame, "sy").orderBy("x1")
    reach = F.max("x2").over(row.rowsBetween(Window.unboundedPreceding, -1))
    islands = longest.withColumn("_reach", reach).withColumn(
        "_island", F.sum(F.when(F.col("_reach") >= F.col("x1"), 0).otherwise(1)).over(row)
    )
    return islands.groupBy(*frame, F.col("sy").alias("y1"), F.col("ey").alias("y2"), "_island").agg(
        F.min("x1").alias("x1"), F.max("x2").alias("x2")
    ).drop("_island")


def mask_coverage(frames: DataFrame, kept: DataFrame, frame: Sequence[str] = _FRAME) -> DataFrame:
    """Detections, masked pixels and covered share for every listed frame, also those without detections.

    Frames are dealt once, by a number of partitions that grows with the rows, so what a task holds does not.
    """
    kept = cut(kept.select(*frame, "x1", "y1", "x2", "y2", "width", "height"))
    tasks = max(partitions(kept.sparkSession), math.ceil((kept.count() + frames.count()) / TASK_ROWS))
    kept, frames = kept.repartition(tasks, *frame), frames.repartition(tasks, *frame)
    counts = kept.groupBy(*frame).agg(F.count(F.lit(1)).alias("detections"))
    area = mask_runs(clip_boxes(kept), frame).groupBy(*frame).agg(
        F.sum((F.col("x2") - F.col("x1")).cast("bigint") * (F.col("y2") - F.col("y1"))).alias("masked_pixels")
    )
    joined = frames.join(counts, list(frame), "left").join(area, list(frame), "left")
    pixels = F.coalesce("masked_pixels", F.lit(0))
    total = F.col("width").cast("bigint") * F.col("height")
    return joined.select(
        *frame, "width", "height", F.coalesce("detections", F.lit(0)).alias("detections"),
        pixels.alias("masked_pixels"), F.when(total > 0, pixels / total).otherwise(0.0).alias("coverage"),
    )


def masking_summary(coverage: DataFrame, key: str = "video_id") -> DataFrame:
    """Per video: frames, masked frames, detections and mean coverage over all listed frames."""
    masked = (F.col("detections") > 0) & (F.col("masked_pixels") > 0)
    return coverage.groupBy(key).agg(
        F.count(F.lit(1)).alias("input_frames"), F.count_if(masked).alias("masked_frames"),
        F.sum("detections").alias("total_detections"), F.avg("coverage").alias("mask_coverage"),
    )
