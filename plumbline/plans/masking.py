"""Masks over moving objects."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import masks
from plumbline.params import DYNAMIC_CLASSES

_FRAME = ("video_id", "frame_id")


def mask(
    frames: DataFrame, detections: DataFrame, classes: Iterable[str] = DYNAMIC_CLASSES, min_confidence: float = 0.25
) -> dict[str, DataFrame]:
    """Tables ``kept``, ``runs``, ``coverage`` and ``summary`` for frames ``(video_id, frame_id, width, height)``.

    ``runs`` are ignored pixels; :func:`polarity` says what they mean in an exported mask.
    """
    kept = masks.filter_detections(detections, classes, min_confidence)
    sized = kept.drop("width", "height").join(frames.select(*_FRAME, "width", "height"), list(_FRAME))
    coverage = masks.mask_coverage(frames, sized, _FRAME)
    return {
        "kept": kept, "runs": masks.mask_runs(masks.clip_boxes(sized), _FRAME),
        "coverage": coverage, "summary": masks.masking_summary(coverage),
    }


def polarity(runs: DataFrame, ignored: int = 255) -> DataFrame:
    """Runs with the value they get in a mask; every other pixel gets the opposite one of 0 and 255."""
    return runs.withColumn("value", F.lit(ignored)).withColumn("background", F.lit(255 - ignored))
