"""Frame selection from image folders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import frames
from plumbline.operators.ordering import with_position
from plumbline.params import FrameGate
from plumbline.session import cut
from plumbline.sources.images import measure, read_images


def measure_folder(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Decoded and measured frames with their 0-based source index in name order per video."""
    measured = cut(measure(read_images(spark, paths), ["video_id", "name", "path"]))
    placed = with_position(measured, ["video_id"], [F.col("name"), F.col("path")])
    return placed.withColumn("source_idx", F.col("pos") - 1).drop("pos")


def select(
    measured: DataFrame, gate: FrameGate = FrameGate(), histogram: str = "color_hist", log: DataFrame | None = None
) -> dict[str, DataFrame]:
    """Tables ``manifest`` and ``summary``; a frame log ``(video_id, filename, timestamp_sec)`` adds frame times."""
    rows = measured.withColumn("hist", F.col(histogram)) if gate.duplicate_threshold is not None else measured
    manifest = cut(frames.select_frames(rows, gate))
    if log is not None:
        times = log.select("video_id", F.col("filename").alias("name"), F.col("timestamp_sec").alias("ts_s"))
        manifest = manifest.join(times, ["video_id", "name"], "left")
    metrics = F.struct(F.bround("laplacian_variance", 2).alias("laplacian_variance"), F.bround("mean_brightness", 2).alias("mean_brightness"))
    manifest = manifest.drop("hist", "color_hist").withColumn("metrics", metrics)
    return {"manifest": manifest, "summary": frames.selection_summary(manifest)}


def extract(
    measured: DataFrame, target: int = 400, blur_threshold: float = 100.0, similarity: float = 0.95, fps: float | None = None
) -> DataFrame:
    """Decoded video frames thinned by stride, sharpness, similarity and budget, as the video extractor does.

    Returns the kept frames with ``timestamp_sec`` if the frame rate is given.
    """
    looked_at = frames.stride_sample(measured, target)
    sharp = looked_at.filter(F.col("readable") & (F.col("laplacian_variance") >= blur_threshold))
    flagged = frames.drop_near_duplicates(sharp, similarity).withColumn("accepted", ~F.col("is_duplicate"))
    kept = frames.within_budget(flagged, target).filter("accepted")
    stamp = F.lit(None).cast("double") if fps is None else F.bround(F.col("source_idx") / fps, 3)
    return kept.select("video_id", "source_idx", "name", stamp.alias("timestamp_sec"), F.bround("laplacian_variance", 2).alias("laplacian_variance"))
