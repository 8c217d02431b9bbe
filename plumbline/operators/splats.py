"""Attribute check of Gaussian-splat files from their headers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.params import SPLAT_ATTRIBUTES


def check_splats(headers: DataFrame) -> DataFrame:
    """Add ``missing`` and ``status``: PASS, WARNING (positions only) or FAIL, from ``is_ply, num_vertices, properties``."""
    required = F.array(*[F.lit(a) for a in SPLAT_ATTRIBUTES])
    missing = F.array_except(required, F.col("properties"))
    positions = F.array(F.lit("x"), F.lit("y"), F.lit("z"))
    status = (
        F.when(~F.col("is_ply") | (F.col("num_vertices") <= 0), "FAIL")
        .when(F.size(missing) == 0, "PASS")
        .when(F.size(F.array_except(positions, F.col("properties"))) == 0, "WARNING")
        .otherwise("FAIL")
    )
    return headers.withColumn("missing", missing).withColumn("status", status)
