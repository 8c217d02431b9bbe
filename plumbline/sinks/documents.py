"""JSON and GeoJSON documents as ordered lines.

A document per flight can be as long as the flight, so it is never gathered in one row. Its lines carry
``(key, part, pos)``, are range-partitioned and sorted, and land in numbered part files that read in order.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.ordering import with_position

KEEP_NULLS = {"ignoreNullFields": "false"}


def array_document(
    rows: DataFrame, key: str, order: Sequence[Column], item: Column, head: DataFrame | None = None, name: str = "frames"
) -> DataFrame:
    """Lines of ``{<head fields>, "<name>": [items]}`` per key; ``head`` is ``(key, head)`` with a struct column."""
    placed = with_position(rows, [key], order).select(key, "pos", F.to_json(item, KEEP_NULLS).alias("_json"))
    keys = rows.select(key).distinct()
    opening = F.lit("{")
    if head is not None:
        keys = keys.join(head, key, "left")
        inner = F.regexp_replace(F.to_json("head", KEEP_NULLS), r"^\{|\}$", "")
        opening = F.concat(F.lit("{"), F.when(F.coalesce(inner, F.lit("")) != "", F.concat(inner, F.lit(","))).otherwise(""))
    first = keys.select(key, F.lit(0).alias("part"), F.lit(0).cast("bigint").alias("pos"), F.concat(opening, F.lit(f'"{name}":[')).alias("line"))
    comma = F.when(F.col("pos") > 1, ",").otherwise("")
    middle = placed.select(key, F.lit(1).alias("part"), "pos", F.concat(comma, F.col("_json")).alias("line"))
    last = keys.select(key, F.lit(2).alias("part"), F.lit(0).cast("bigint").alias("pos"), F.lit("]}").alias("line"))
    return first.unionByName(middle).unionByName(last)


def feature_collection(features: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """Lines of one GeoJSON FeatureCollection per key: the path first if it has two points, then every camera.

    ``features`` has ``coordinates`` (array) and ``feature`` (JSON text).
    """
    placed = with_position(features, [key], order).select(key, "pos", "coordinates", "feature")
    counts = features.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    with_path = counts.filter("_n >= 2").select(key)
    fixed = lambda df, part, text: df.select(key, F.lit(part).alias("part"), F.lit(0).cast("bigint").alias("pos"), F.lit(text).alias("line"))
    comma = F.when(F.col("pos") > 1, ",").otherwise("")
    head = fixed(counts, 0, '{"type":"FeatureCollection","crs":{"type":"name","properties":{"name":"urn:ogc:def:crs:OGC:1.3:CRS84"}},"features":[')
    path_open = fixed(with_path, 1, '{"type":"Feature","geometry":{"type":"LineString","coordinates":[')
    coordinates = placed.join(with_path, key, "left_semi").select(
        key, F.lit(2).alias("part"), "pos", F.concat(comma, F.to_json("coordinates")).alias("line"))
    path_close = fixed(with_path, 3, ']},"properties":{"name":"camera_trajectory"}}')
    # a comma also parts the path from the first camera
    lead = F.when((F.col("pos") > 1) | (F.col("_n") >= 2), ",").otherwise("")
    cameras = placed.join(counts, key).select(key, F.lit(4).alias("part"), "pos", F.concat(lead, F.col("feature")).alias("line"))
    tail = fixed(counts, 5, "]}")
    out = head
    for more in (path_open, coordinates, path_close, cameras, tail):
        out = out.unionByName(more)
    return out


def write_lines(lines: DataFrame, path: str, key: str, mode: str = "errorifexists") -> None:
    """One folder per key; its part files, in name order, are the document."""
    ordered = lines.repartitionByRange(F.col(key), F.col("part"), F.col("pos")).sortWithinPartitions(key, "part", "pos")
    ordered.select(key, "line").write.mode(mode).partitionBy(key).text(path)


def pose_records(images: DataFrame, key: str = "model_id") -> DataFrame:
    """Published poses: centre and quaternion rounded, names and convention."""
    from plumbline.functions.names import stem
    from plumbline.operators.trajectory import with_centers

    rows = with_centers(images)
    return rows.select(
        key, stem(F.col("name")).alias("frame_id"), F.col("name").alias("image_name"), "image_id", "camera_id",
        F.array(*[F.bround(c, 6) for c in "xyz"]).alias("position"),
        F.array(*[F.bround(c, 6) for c in ("qw", "qx", "qy", "qz")]).alias("rotation_quaternion"),
        F.lit("x right, y down, z forward; quaternion w first").alias("coordinate_convention"),
        F.lit("world_to_camera").alias("pose_type"),
    )


def _lists(ordered: DataFrame, key: str) -> DataFrame:
    """(key, json) rows as lines that make the rows of a key in one partition a complete JSON list."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            keys, lines = [], []
            for own, json in zip(batch.column(key).to_pylist(), batch.column("line").to_pylist()):
                if held is not None:
                    keys.append(held[0])
                    lines.append(held[1] + ("" if held[0] == own else "]"))
                held = (own, ("," if held is not None and held[0] == own else "[") + json)
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(key).type), pa.array(lines, pa.string())], names=[key, "line"])
            kind = batch.schema.field(key).type
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([held[0]], kind), pa.array([held[1] + "]"])], names=[key, "line"])

    return ordered.select(key, "line").mapInArrow(run, f"{key} {dict(ordered.dtypes)[key]}, line string")


def write_pose_json(images: DataFrame, path: str, key: str = "model_id", mode: str = "errorifexists") -> None:
    """Poses in name order, one folder per model; every file in it is a complete JSON list."""
    records = pose_records(images, key)
    item = F.struct(*[c for c in records.columns if c != key])
    rows = records.select(key, "image_name", F.to_json(item, KEEP_NULLS).alias("line"))
    ordered = rows.repartitionByRange(F.col(key), F.col("image_name")).sortWithinPartitions(key, "image_name")
    _lists(ordered, key).write.mode(mode).partitionBy(key).text(path)


def write_geojson(features: DataFrame, path: str, key: str = "flight_id", order: str = "image_name", mode: str = "errorifexists") -> None:
    write_lines(feature_collection(features, key, [F.col(order), F.col("frame_id")]), path, key, mode)


def write_trajectory(trajectory: DataFrame, path: str, key: str = "flight_id", head: DataFrame | None = None, mode: str = "errorifexists") -> None:
    item = F.struct(*[c for c in trajectory.columns if c not in (key, "pos")])
    order = [F.col("pos")] if "pos" in trajectory.columns else [F.col("image_name"), F.col("frame_id")]
    write_lines(array_document(trajectory, key, order, item, head), path, key, mode)


def write_training_set(tables: dict[str, DataFrame], path: str, key: str = "scene_id", ply_file: str | None = None, mode: str = "errorifexists") -> None:
    """``transforms`` (intrinsics and frames) and ``transform`` (normalisation record) documents per scene."""
    fields = ["camera_model", "fl_x", "fl_y", "cx", "cy", "w", "h"]
    extra = [F.lit(ply_file).alias("ply_file_path")] if ply_file else []
    head = tables["intrinsics"].select(key, F.struct(*fields, *extra).alias("head"))
    item = F.struct("file_path", "transform_matrix", "colmap_im_id", "frame_id")
    write_lines(array_document(tables["frames"], key, [F.col("colmap_im_id")], item, head), f"{path}/transforms", key, mode)
    tables["record"].select(key, F.to_json("record", KEEP_NULLS).alias("line")).write.mode(mode).partitionBy(key).text(f"{path}/transform")
    if "points" in tables:
        tables["points"].write.mode(mode).partitionBy(key).parquet(f"{path}/points")


def write_documents(documents: DataFrame, column: str, path: str, key: str, mode: str = "errorifexists") -> None:
    """One small document per key, as text lines (reports, metadata)."""
    documents.select(key, F.to_json(column, KEEP_NULLS).alias("line")).write.mode(mode).partitionBy(key).text(path)


def write_comparison(attempts: DataFrame, matrix: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Attempts by method and the comparison matrix."""
    attempts.write.mode(mode).partitionBy("method").json(f"{path}/methods")
    matrix.write.mode(mode).json(f"{path}/comparison")


def write_cloud_bundle(tables: dict[str, DataFrame], meta: DataFrame, path: str, as_ply: bool = False, mode: str = "overwrite") -> None:
    """Points (Parquet, or PLY as well), cloud metadata and the cleaning report from the written stages of one job."""
    tables["points"].write.mode(mode).partitionBy("cloud_id").parquet(f"{path}/points")
    if as_ply:
        from plumbline.sources import ply

        ply.register(meta.sparkSession)
        tables["points"].write.format("ply").mode("overwrite").save(f"{path}/ply")
    meta.write.mode(mode).json(f"{path}/metadata")
    tables["report"].write.mode(mode).json(f"{path}/report")
    tables["stages"].write.mode(mode).json(f"{path}/stages")


def write_detections(coverage: DataFrame, kept: DataFrame, summary: DataFrame, path: str, mode: str = "overwrite") -> None:
    coverage.write.mode(mode).json(f"{path}/frames")
    kept.write.mode(mode).json(f"{path}/detections")
    summary.write.mode(mode).json(f"{path}/summary")


def write_predictions(predictions: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Extrinsics, intrinsics, depth and confidence arrays as Parquet, one row per image row."""
    predictions.write.mode(mode).parquet(path)
