"""Image folders, pixel metrics and frame logs rebuilt from file names."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.params import IMAGE_EXTENSIONS

METRICS = (
    "readable boolean, width int, height int, laplacian_variance double, mean_brightness double, "
    "hist array<float>, color_hist array<float>"
)


def _with_extension(df: DataFrame, path: str = "path") -> DataFrame:
    ending = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    return df.filter(ending.isin(*IMAGE_EXTENSIONS))


def list_images(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """``path, name, video_id, size`` of the image files, without reading them; the folder names the video."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    named = _with_extension(files).select(
        "path", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"),
        F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("video_id"), F.col("length").alias("size"),
    )
    return named


def read_images(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Decoded images as ``path, name, video_id, image``; width is -1 where a file cannot be decoded."""
    decoded = spark.read.format("image").option("dropInvalid", "false").option("recursiveFileLookup", "true").load(paths)
    return _with_extension(decoded.withColumn("path", F.col("image.origin"))).select(
        "path", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"),
        F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("video_id"), "image",
    )


def dimensions(images: DataFrame) -> DataFrame:
    """Width, height and readability from the decoded images."""
    return images.select(
        *[c for c in images.columns if c != "image"], F.col("image.width").alias("width"),
        F.col("image.height").alias("height"), (F.col("image.width") > 0).alias("readable"),
    )


def _pixels(image) -> np.ndarray | None:
    height, width, channels = image["height"], image["width"], image["nChannels"]
    if width is None or width <= 0 or height <= 0:
        return None
    return np.frombuffer(image["data"], dtype=np.uint8).reshape(height, width, channels)


def _gray(pixels: np.ndarray) -> np.ndarray:
    """Luma of blue-green-red pixels, rounded to whole levels."""
    if pixels.shape[2] == 1:
        return pixels[:, :, 0].astype(np.float64)
    blue, green, red = (pixels[:, :, i].astype(np.float64) for i in range(3))
    return np.floor(0.299 * red + 0.587 * green + 0.114 * blue + 0.5)


def _laplacian_variance(gray: np.ndarray) -> float:
    """Population variance of the 4-neighbour Laplacian, borders mirrored without repeating the edge."""
    mode = "reflect" if min(gray.shape) > 1 else "edge"
    p = np.pad(gray, 1, mode=mode)
    return float((p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * gray).var())


def _color_histogram(pixels: np.ndarray) -> np.ndarray:
    """16 x 16 bins of hue (0..180) and saturation (0..256), scaled to 0..1."""
    if pixels.shape[2] == 1:
        pixels = np.repeat(pixels, 3, axis=2)
    blue, green, red = (pixels[:, :, i].astype(np.float64).ravel() for i in range(3))
    value = np.maximum(np.maximum(blue, green), red)
    spread = value - np.minimum(np.minimum(blue, green), red)
    safe = np.where(spread > 0, spread, 1.0)
    hue = np.where(value == red, (green - blue) / safe, np.where(value == green, 2 + (blue - red) / safe, 4 + (red - green) / safe))
    hue = np.floor(np.where(spread > 0, hue * 30 % 180, 0.0) + 0.5) % 180
    saturation = np.floor(np.where(value > 0, spread / np.where(value > 0, value, 1.0) * 255, 0.0) + 0.5)
    bins = (hue * 16 // 180).astype(int) * 16 + (saturation // 16).astype(int)
    return _scaled(np.bincount(bins, minlength=256).astype(np.float64))


def _scaled(counts: np.ndarray) -> np.ndarray:
    low, high = counts.min(), counts.max()
    return (counts - low) / (high - low) if high > low else counts * 0


def measure(images: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Sharpness, brightness and both histograms of every image in one pass over the decoded pixels."""
    types = dict(images.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in keep) + ", " + METRICS

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for image in frame["image"]:
                pixels = _pixels(image)
                if pixels is None:
                    rows.append((False, image["width"], image["height"], None, None, None, None))
                    continue
                gray = _gray(pixels)
                counts = np.bincount(gray.astype(int).ravel(), minlength=256).astype(np.float64)
                rows.append((
                    True, image["width"], image["height"], _laplacian_variance(gray), float(gray.mean()),
                    _scaled(counts).astype(np.float32), _color_histogram(pixels).astype(np.float32),
                ))
            names = [part.split(" ")[0] for part in METRICS.split(", ")]
            yield pd.concat([frame[list(keep)].reset_index(drop=True), pd.DataFrame(rows, columns=names)], axis=1)

    return images.select(*keep, "image").mapInPandas(batches, schema)


def frame_log_from_names(files: DataFrame, fps: float) -> DataFrame:
    """Frame index and time from numeric file stems, for logs that were lost; the sharpness is unknown."""
    index = F.regexp_extract("name", r"^(\d+)\.[^.]+$", 1)
    numbered = files.filter(index != "").withColumn("original_frame", index.cast("bigint"))
    return numbered.select(
        "video_id", F.col("name").alias("filename"), F.bround(F.col("original_frame") / fps, 3).alias("timestamp_sec"),
        "original_frame", F.lit(None).cast("double").alias("laplacian_variance"),
    )
