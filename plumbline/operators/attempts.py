"""Acceptance of reconstruction attempts, choice of the first good one, and comparison of methods."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.params import Acceptance

GOOD_TRAJECTORY = ("PASS", "AVAILABLE", "WARNING")
METRICS = ("registered_images", "registration_rate", "reprojection_rmse_px", "runtime_seconds")


def decide(attempts: DataFrame, limits: Acceptance = Acceptance()) -> DataFrame:
    """Add ``reject_reason``, the first rule an attempt breaks, and ``accepted``.

    A status, image count, share or trajectory that is not known breaks its rule; an error in pixels that is not known
    does not, as the reprojection of some methods cannot be checked.
    """
    def known(test: Column) -> Column:
        return F.coalesce(test, F.lit(False))

    status = F.col("reprojection_status")
    rules = [
        (known(F.col("status") == "PASS"), F.concat(F.lit("status "), F.coalesce("status", F.lit("missing")))),
        (known(F.col("registered_images") >= limits.images), F.lit("too few registered images")),
        (known(F.col("registration_rate") >= limits.share), F.lit("registration rate too low")),
        (~known((status == "AVAILABLE") & (F.col("reprojection_rmse_px") > limits.rmse_px)), F.lit("reprojection error too high")),
        (~known(status == "FAIL"), F.lit("reprojection check failed")),
    ]
    if limits.needs_trajectory:
        rules.append((known(F.col("trajectory_status").isin(*GOOD_TRAJECTORY)), F.lit("trajectory not usable")))
    reason = F.coalesce(*[F.when(~kept, text) for kept, text in rules])
    return attempts.withColumn("reject_reason", reason).withColumn("accepted", F.col("reject_reason").isNull())


def first_acceptable(
    decided: DataFrame, key: str = "scene_id", order: Sequence[str] = ("ord", "attempt_id")
) -> DataFrame:
    """Per scene the first accepted attempt in plan order, with the tries and runtime spent up to it."""
    at = F.struct(*order)
    pick = F.struct(*[c for c in decided.columns if c != key])
    winners = decided.groupBy(key).agg(
        F.min_by(F.when(F.col("accepted"), pick), F.when(F.col("accepted"), at)).alias("winner"),
        F.min(F.when(F.col("accepted"), at)).alias("_stop"),
    )
    tried = decided.join(winners.select(key, "_stop"), key).filter(F.col("_stop").isNull() | (at <= F.col("_stop")))
    spent = tried.groupBy(key).agg(
        F.count(F.lit(1)).alias("attempts_run"), F.sum("runtime_seconds").alias("cumulative_runtime")
    )
    return winners.join(spent, key).select(
        key, F.when(F.col("_stop").isNull(), "FAIL").otherwise("PASS").alias("status"),
        F.col("winner.method").alias("selected_method"), "attempts_run", "cumulative_runtime", "winner",
    )


def attempts_run(decided: DataFrame, key: str = "scene_id", order: Sequence[str] = ("ord", "attempt_id")) -> DataFrame:
    """Attempts that were really made: everything up to the first accepted one."""
    at = F.struct(*order)
    stops = decided.groupBy(key).agg(F.min(F.when(F.col("accepted"), at)).alias("_stop"))
    return decided.join(stops, key).filter(F.col("_stop").isNull() | (at <= F.col("_stop"))).drop("_stop")


def compare_methods(
    attempts: DataFrame,
    methods: Sequence[str] | None = None,
    metrics: Sequence[str] = METRICS,
    key: str = "scene_id",
    order: Sequence[str] = ("ord", "attempt_id"),
) -> DataFrame:
    """One row per scene and metric, one column per method; of repeated attempts the first counts."""
    first = attempts.groupBy(key, "method").agg(
        F.min_by(F.struct(*[F.col(m).cast("double").alias(m) for m in metrics]), F.struct(*order)).alias("_m")
    )
    long = first.select(key, "method", "_m.*").unpivot([key, "method"], list(metrics), "metric", "value")
    pivoted = long.groupBy(key, "metric")
    pivoted = pivoted.pivot("method", list(methods)) if methods else pivoted.pivot("method")
    return pivoted.agg(F.first("value"))
