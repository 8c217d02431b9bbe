"""Streaming queries over the given tables, run to the end of the input and returned as tables."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.queries.views import table, view
from plumbline.queries.spark import fixed
from plumbline.session import checkpoint_dir
from plumbline.streaming.changelog import change_log, current
from plumbline.streaming.frames import dedupe_stream as dedupe
from plumbline.streaming.status import status_stream
from plumbline.streaming.sync import nearest_fix_stream
from plumbline.streaming.voxel import means, voxel_sums

_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.parquet*")


def _finish(spark: SparkSession, stream: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Run the stream to its end and read what it wrote: in update mode as a change log by ``keys``, else in append mode."""
    run = f"{checkpoint_dir(spark)}/streams/{uuid.uuid4().hex}"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)
    writer = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{run}/checkpoint")
    if keys:
        writer.outputMode("update").foreachBatch(change_log(f"{run}/out", keys)).start().awaitTermination()
        return current(spark, f"{run}/out", stream.schema, keys)
    writer.outputMode("append").format("parquet").option("path", f"{run}/out").start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{run}/out")


def run_status_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _stream(spark, sf_dir, "events")
    state = (
        F.when(F.col("event_type") == "signup", "FRAME_PROCESSING").when(F.col("event_type") == "view", "POSE_ESTIMATION")
        .when(F.col("event_type") == "click", "GEOREFERENCING").when(F.col("event_type") == "purchase", "POINT_CLOUD")
        .otherwise("EXPORT")
    )
    status = F.when(F.col("event_id") % 50 == 0, "FAILED").when(F.col("event_id") % 13 == 0, "WARNING").otherwise("SUCCESS")
    log = events.select(
        F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts_s"), state.alias("state"), status.alias("status"),
    )
    return _finish(spark, status_stream(log), ["run_id"])


def voxel_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _stream(spark, sf_dir, "events").select(
        (F.col("event_id") % 97).cast("double").alias("x"), (F.col("event_id") % 89).cast("double").alias("y"), F.col("value").alias("z")
    )
    grid = means(_finish(spark, voxel_sums(points, 10.0), ["vx", "vy", "vz"]))
    return grid.select("vx", "vy", "vz", "merged_points", *[fixed(c).alias(c) for c in ("x", "y", "z")])


def sync_stream(spark: SparkSession, sf_dir: str, tolerance: float) -> DataFrame:
    event_time = F.col("ts").cast("timestamp")
    seconds = F.unix_micros(event_time) / 1e6
    timeless = (F.col("event_type") == "view") & (F.col("event_id") % 11 == 0)
    events = _stream(spark, sf_dir, "events").select(
        F.col("user_id").alias("flight_id"), F.when(F.col("event_type") == "view", "pose").otherwise("gps").alias("side"),
        F.col("event_id").alias("row_id"), F.when(~timeless, seconds).alias("ts_s"), event_time.alias("event_time"),
    )
    # rows of a second source, far in the future, move the watermark past the last pose
    end = _stream(spark, sf_dir, "region").select(
        F.col("r_regionkey").cast("bigint").alias("flight_id"), F.lit("end").alias("side"),
        F.lit(-1).cast("bigint").alias("row_id"), F.lit(0.0).alias("ts_s"),
        F.to_timestamp(F.lit("2100-01-01 00:00:00")).alias("event_time"),
    )
    matched = _finish(spark, nearest_fix_stream(events.unionByName(end), tolerance, "1 hour"))
    return matched.select(
        "flight_id", F.col("pose_id").alias("frame_no"), "gps_seq", fixed("time_diff_s").alias("time_diff_s"), "matched"
    )


def dedupe_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of one a second from 1970 on, where watermarks begin, by their number; rows of a second source move the watermark past the last one."""
    rows = _stream(spark, sf_dir, "embeddings").select(
        F.col("label").cast("bigint").alias("video_id"), F.col("vec_id").alias("source_idx"), F.col("embedding").cast("array<double>").alias("hist"),
        F.timestamp_seconds(F.col("vec_id") + 1).alias("event_time"),
    )
    end = _stream(spark, sf_dir, "region").select(
        F.lit(-1).cast("bigint").alias("video_id"), F.col("r_regionkey").cast("bigint").alias("source_idx"),
        F.array(F.lit(0.0)).alias("hist"), F.to_timestamp(F.lit("2100-01-01 00:00:00")).alias("event_time"),
    )
    flagged = _finish(spark, dedupe(rows.unionByName(end), 0.2, "1 hour")).filter("video_id >= 0")
    return flagged.select(
        F.col("video_id").cast("int").alias("video_id"), "source_idx", "is_duplicate",
        fixed(F.nanvl("correlation", F.lit(None))).alias("correlation"),
    )
