"""Sparse reconstruction models, text and binary, as tables over many models.

The model is named by the folder of its files below the given path. Text files are read line by line and split; binary files
are split between their records (:mod:`plumbline.sources.sfm_binary`).
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.ordering import running_max, with_next
from plumbline.sources.files import folder_key, lines, open_binary, tokens
from plumbline.sources.sfm_binary import read_cameras_binary, read_images_binary, read_points_binary  # noqa: F401

Paths = str | Sequence[str]


def _model_lines(spark: SparkSession, paths: Paths) -> DataFrame:
    return lines(spark, paths).filter(~F.col("value").startswith("#")).withColumn("model_id", folder_key(F.col("file"), paths))


def read_cameras_text(spark: SparkSession, paths: Paths) -> DataFrame:
    t = tokens(F.col("value"))
    rows = _model_lines(spark, paths).filter(F.trim("value") != "")
    return rows.select(
        "model_id", t[0].cast("bigint").alias("camera_id"), t[1].alias("model"), t[2].cast("bigint").alias("width"),
        t[3].cast("bigint").alias("height"), F.transform(F.slice(t, 5, F.greatest(F.size(t) - 4, F.lit(0))), lambda p: p.cast("double")).alias("params"),
    )


def read_images_text(spark: SparkSession, paths: Paths, hot_rows: float | None = None) -> DataFrame:
    """Images with their observations, two lines each: pose, then ``x y point_id`` triples, possibly none.

    Blank lines before a pose are skipped. After any blank line a pose is expected next, so whether a line is a pose
    follows from how many filled lines stand between it and the last blank one, and files can be split anywhere.
    The name is the rest of the pose line and may hold spaces.
    """
    rows = _model_lines(spark, paths).select("model_id", "file", "line_id", "value")
    placed = with_next(rows, ["file"], [F.col("line_id")], ["value"], "line_no", hot_rows)
    blank = F.trim("value") == ""
    scanned = running_max(placed, ["file"], "line_no", F.when(blank, F.col("line_no")), "_blank")
    since = F.col("line_no") - F.coalesce("_blank", F.lit(0))
    # each line is split once, not once for every number that is taken from it
    poses = scanned.filter(~blank & (since % 2 == 1)).select(
        "model_id", "value", tokens(F.col("value")).alias("_t"), tokens(F.coalesce("next_value", F.lit(""))).alias("_p"))
    t, p = F.col("_t"), F.col("_p")
    # of a blank line one empty token is left
    count = F.floor(F.size(p) / 3).cast("int")
    triples = F.transform(
        F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct(
            F.element_at(p, i * 3 + 1).cast("double").alias("px"), F.element_at(p, i * 3 + 2).cast("double").alias("py"),
            F.element_at(p, i * 3 + 3).cast("bigint").alias("point3d_id"),
        ),
    )
    number = lambda i: t[i].cast("double")
    return poses.select(
        "model_id", t[0].cast("bigint").alias("image_id"),
        *[number(i + 1).alias(c) for i, c in enumerate(("qw", "qx", "qy", "qz", "tx", "ty", "tz"))],
        t[8].cast("bigint").alias("camera_id"), F.regexp_extract(F.trim("value"), r"^(?:\S+\s+){9}(.*)$", 1).alias("name"),
        triples.alias("observations"),
    )


def read_points_text(spark: SparkSession, paths: Paths, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Good points and quarantined lines with the rule they break; ``strict`` raises if any line is bad."""
    t = tokens(F.col("value"))
    rows = _model_lines(spark, paths).filter(F.trim("value") != "").withColumn("t", t)
    at = lambda i, kind: F.try_element_at("t", F.lit(i + 1)).try_cast(kind)
    names = (("point3d_id", 0, "bigint"), ("x", 1, "double"), ("y", 2, "double"), ("z", 3, "double"),
             ("r", 4, "int"), ("g", 5, "int"), ("b", 6, "int"), ("error", 7, "double"))
    parsed = rows.select("model_id", "file", "line_id", "value", "t", *[at(i, kind).alias(n) for n, i, kind in names])
    unreadable, infinite = F.lit(False), F.lit(False)
    for n, _, _ in names:
        unreadable = unreadable | F.col(n).isNull()
    for n in ("x", "y", "z"):
        infinite = infinite | F.isnan(n) | (F.abs(n) == float("inf"))
    colors = F.col("r").between(0, 255) & F.col("g").between(0, 255) & F.col("b").between(0, 255)
    reason = (
        F.when(F.size("t") < 8, "fewer than 8 elements").when(unreadable, "not a number")
        .when(infinite, "coordinate not finite").when(~colors, "colour outside 0..255")
    )
    judged = parsed.withColumn("reject_reason", reason)
    tail = F.slice("t", 9, F.greatest(F.size("t") - 8, F.lit(0)))
    pairs = F.floor(F.size(tail) / 2).cast("int")
    track = F.transform(
        F.when(pairs > 0, F.sequence(F.lit(0), pairs - 1)).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct(F.element_at(tail, i * 2 + 1).try_cast("bigint").alias("image_id"),
                           F.element_at(tail, i * 2 + 2).try_cast("int").alias("point2d_idx")),
    )
    good = judged.filter("reject_reason IS NULL").select(
        "model_id", "point3d_id", "x", "y", "z", *[F.col(c).cast("smallint").alias(c) for c in "rgb"], "error", track.alias("track"), "file"
    )
    bad = judged.filter("reject_reason IS NOT NULL").select("model_id", "file", "line_id", "value", "reject_reason")
    if strict:
        first = bad.first()
        if first is not None:
            raise ValueError(f"{first['file']}: {first['reject_reason']}: {first['value']}")
    return good, bad


def observations(images: DataFrame) -> DataFrame:
    """Exploded 2D observations of image rows."""
    return images.select("model_id", "image_id", F.posexplode("observations").alias("point2d_idx", "_o")).select(
        "model_id", "image_id", "point2d_idx", "_o.px", "_o.py", "_o.point3d_id"
    )


def find_models(spark: SparkSession, roots: Paths) -> DataFrame:
    """Per root the model folder to use: a complete triple in the root itself, else the first such sub-folder by name.

    Returns ``(root, folder, format)``; binary files win over text in one folder.
    """
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    roots = [roots] if isinstance(roots, str) else list(roots)
    names = F.regexp_extract("path", r"([^/]+)$", 1)
    files = listing.load(roots).select(F.regexp_replace("path", "^file:/+", "/").alias("path")).select(
        F.regexp_extract("path", r"^(.*)/[^/]+$", 1).alias("folder"), names.alias("name")
    )
    complete: Callable[[str], Column] = lambda ext: F.size(F.array_intersect(
        F.collect_set("name"), F.array(*[F.lit(f"{part}.{ext}") for part in ("cameras", "images", "points3D")]))) == 3
    wanted = [f"{part}.{ext}" for part in ("cameras", "images", "points3D") for ext in ("bin", "txt")]
    folders = files.filter(F.col("name").isin(*wanted)).groupBy("folder").agg(
        complete("bin").alias("_bin"), complete("txt").alias("_txt")
    ).filter("_bin OR _txt")
    # the roots are the caller's argument list
    listed = spark.createDataFrame([(r.rstrip("/"),) for r in roots], "root string")
    parent = F.regexp_extract("folder", r"^(.*)/[^/]+$", 1)
    near = folders.withColumn("root", F.explode(F.array("folder", parent))).join(listed, "root")
    rank = F.struct((F.col("folder") != F.col("root")).alias("deep"), "folder")
    return near.groupBy("root").agg(
        F.min_by("folder", rank).alias("folder"), F.min_by(F.when(F.col("_bin"), "binary").otherwise("text"), rank).alias("format")
    )


def header_counts(spark: SparkSession, paths: Paths) -> DataFrame:
    """Record count from the first 8 bytes of binary model files: ``(model_id, name, records)``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.bin")
    listed = files.load(paths if isinstance(paths, str) else list(paths)).select("path")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            counts = []
            for path in frame["path"]:
                with open_binary(path) as f:
                    head = f.read(8)
                counts.append(struct.unpack("<q", head)[0] if len(head) == 8 else 0)
            yield frame.assign(records=counts)

    return listed.mapInPandas(run, "path string, records bigint").select(
        folder_key(F.col("path"), paths).alias("model_id"), F.regexp_extract("path", r"([^/]+)\.bin$", 1).alias("name"), "records"
    )


def table_counts(cameras: DataFrame, images: DataFrame, points: DataFrame) -> DataFrame:
    """Cameras, images and points per model from the parsed tables; images without observations count as well."""
    parts = [
        df.groupBy("model_id").agg(F.count(F.lit(1)).alias(name))
        for df, name in ((cameras, "num_cameras"), (images, "num_images"), (points, "num_points"))
    ]
    joined = parts[0].join(parts[1], "model_id", "full").join(parts[2], "model_id", "full")
    return joined.fillna(0, ["num_cameras", "num_images", "num_points"])
