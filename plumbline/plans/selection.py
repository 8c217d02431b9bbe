"""Choice of the reconstruction attempt each scene goes on with, and comparison of methods."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import attempts as A
from plumbline.params import Acceptance


def select(
    attempts: DataFrame, preflight: DataFrame | None = None, policy: Acceptance = Acceptance()
) -> dict[str, DataFrame]:
    """Tables ``attempts`` (with decision), ``selected`` and ``failed`` per scene.

    Scenes that fail ``preflight`` ``(scene_id, status, reason)`` are not tried; ``failed`` lists every reject reason.
    """
    if preflight is not None:
        ready = preflight.filter("status = 'PASS'").select("scene_id")
        attempts = attempts.join(ready, "scene_id", "left_semi")
    decided = A.decide(attempts, policy)
    selected = A.first_acceptable(decided)
    reasons = decided.groupBy("scene_id", "reject_reason").agg(F.count(F.lit(1)).alias("attempts"))
    failed = selected.filter("status = 'FAIL'").select("scene_id").join(reasons, "scene_id")
    if preflight is not None:
        blocked = preflight.filter("status <> 'PASS'").select(
            "scene_id", F.concat(F.lit("preflight: "), "reason").alias("reject_reason"), F.lit(0).cast("bigint").alias("attempts"))
        failed = failed.unionByName(blocked)
    return {"attempts": A.attempts_run(decided), "selected": selected, "failed": failed}


def winner_rows(selected: DataFrame, table: DataFrame, key: str = "scene_id") -> DataFrame:
    """Rows of a per-method table (poses, points) that belong to the selected method of their scene."""
    wins = selected.filter("status = 'PASS'").select(key, F.col("selected_method").alias("method"))
    return table.join(wins, [key, "method"], "left_semi")


def compare(attempts: DataFrame, methods: Sequence[str] | None = None) -> DataFrame:
    return A.compare_methods(attempts, methods)
