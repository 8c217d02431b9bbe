"""Voxel grid kept up to date while points arrive."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_AXES = ("x", "y", "z")


def voxel_sums(points: DataFrame, size: float, origin: Sequence[float] = (0.0, 0.0, 0.0), keys: Sequence[str] = ()) -> DataFrame:
    """Count and coordinate sums per cell of a fixed grid, as a streaming aggregation.

    Written in update mode through :func:`plumbline.streaming.changelog.change_log` with the cells as keys.
    """
    cells = [F.floor((F.col(a) - float(o)) / size).alias(f"v{a}") for a, o in zip(_AXES, origin)]
    return points.groupBy(*keys, *cells).agg(
        F.count(F.lit(1)).alias("merged_points"), *[F.sum(a).alias(f"sum_{a}") for a in _AXES]
    )


def means(sums: DataFrame) -> DataFrame:
    rest = [c for c in sums.columns if not c.startswith("sum_")]
    return sums.select(*rest, *[(F.col(f"sum_{a}") / F.col("merged_points")).alias(a) for a in _AXES])
