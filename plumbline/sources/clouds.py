"""Point clouds from whatever file a folder offers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.clouds import georeference_meta, transform_points
from plumbline.sources import ply
from plumbline.sources.sfm_model import read_points_binary, read_points_text

# Files searched in a cloud folder, best first.
SEARCH_ORDER = ("sparse/points3D.txt", "sparse/points3D.bin", "points3D.txt", "points3D.bin", "pointcloud.ply")
_METHODS = {"txt": "colmap_sparse_text", "bin": "colmap_sparse_binary", "ply": "ply"}


def choose_files(spark: SparkSession, folders: Sequence[str]) -> DataFrame:
    """``(cloud_id, folder, file, kind)``: the best file of each folder; the cloud is named by the folder."""
    names = [f.rstrip("/").rpartition("/")[2] for f in folders]
    if len(set(names)) < len(names):
        raise ValueError(f"clouds are named by their folders, and two folders have one name: {', '.join(sorted(names))}")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(folders)).select(
        F.regexp_replace("path", "^file:/+", "/").alias("file")
    )
    # the folders are the caller's argument list
    listed = spark.createDataFrame([(f.rstrip("/"),) for f in folders], "folder string")
    places = F.array_compact(F.array(*[
        F.when(F.col("file").endswith(f"/{s}"), F.struct(
            F.lit(i).alias("_place"), F.expr(f"substring(file, 1, length(file) - {len(s) + 1})").alias("folder")))
        for i, s in enumerate(SEARCH_ORDER)
    ]))
    ranked = files.select("file", F.inline(places)).join(listed, "folder")
    best = ranked.groupBy("folder").agg(F.min_by("file", "_place").alias("file"))
    return best.select(
        F.regexp_extract("folder", r"([^/]+)$", 1).alias("cloud_id"), "folder", "file", F.substring_index("file", ".", -1).alias("kind")
    )


def _refuse(bad: DataFrame | None) -> None:
    first = bad.first() if bad is not None else None
    if first is not None:
        raise ValueError(": ".join(map(str, first)))


def load_clouds(
    spark: SparkSession, folders: Sequence[str], alignment: DataFrame | None = None, strict: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Points of many clouds and their ``cloud_meta``; clouds with an alignment are moved once, never twice.

    A bad line, a broken file or a malformed alignment raises, unless ``strict`` is off: then bad lines and files are
    left out and clouds with a malformed alignment stay where they are, as the readers' own reports tell.

    Chosen files are one short row per folder and come to the driver to name the reader inputs.
    """
    chosen = choose_files(spark, folders)
    picks = chosen.select("file", "kind").collect()
    shape = ["cloud_id", "point_id", "x", "y", "z", "r", "g", "b", "error"]
    named = chosen.select("cloud_id", "file")
    points: DataFrame | None = None
    for kind in ("txt", "bin", "ply"):
        paths = [row["file"] for row in picks if row["kind"] == kind]
        if not paths:
            continue
        if kind == "ply":
            ply.register(spark)
            part = spark.read.format("ply").load("\n".join(paths)).withColumn("error", F.lit(None).cast("double")).withColumn(
                "point_id", F.lit(None).cast("bigint"))
        else:
            if kind == "txt":
                rows = read_points_text(spark, paths, strict=strict)[0]
            else:
                rows = read_points_binary(spark, paths)
                _refuse(rows.filter("file_error IS NOT NULL").select("file", "file_error") if strict else None)
                rows = rows.filter("file_error IS NULL")
            part = rows.withColumn("file", F.regexp_replace("file", "^file:/+", "/")).withColumnRenamed("point3d_id", "point_id").join(named, "file")
        part = part.select(*shape)
        points = part if points is None else points.unionByName(part)
    if points is None:
        raise FileNotFoundError(f"no point cloud file in {', '.join(folders)}")
    method = F.lit(None).cast("string")
    for kind, name in _METHODS.items():
        method = F.when(F.col("kind") == kind, name).otherwise(method)
    meta = chosen.select(
        "cloud_id", method.alias("source_method"), F.col("file").alias("source_path"), F.lit(None).cast("string").alias("crs"),
        F.lit("local_unscaled").alias("units"), F.lit("local reconstruction coordinates").alias("convention"),
        F.lit(False).alias("is_georeferenced"),
    )
    if alignment is None:
        return points, meta
    _refuse(alignment.filter("alignment_error IS NOT NULL").select("cloud_id", "alignment_error") if strict else None)
    good = alignment.filter("alignment_error IS NULL")
    return transform_points(points, good), georeference_meta(meta, good)
