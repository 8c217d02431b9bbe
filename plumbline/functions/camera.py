"""Pinhole projection with lens distortion as one expression per coordinate."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MIN_DEPTH = 1e-8

# Parameters each supported model needs.
NEEDED_PARAMS = {
    "SIMPLE_PINHOLE": 3,
    "PINHOLE": 4,
    "SIMPLE_RADIAL": 4,
    "RADIAL": 5,
    "OPENCV": 8,
    "OPENCV_FISHEYE": 8,
}


def is_supported(model: Column, params: Column) -> Column:
    """Whether a camera row can be projected with at all."""
    known = F.lit(False)
    for name, count in NEEDED_PARAMS.items():
        known = F.when(F.upper(model) == name, F.size(params) >= count).otherwise(known)
    return F.coalesce(known, F.lit(False))


def canonical(model: Column, params: Column) -> Column:
    """One parameter layout for all supported models.

    Every model is ``fx, fy, cx, cy`` plus a lens: polynomial radial terms ``k1, k2``, tangential ``p1, p2``
    or the fisheye terms ``f1..f4``; missing terms are zero. NULL for an unsupported camera. Doing this once
    per camera keeps the case distinction out of the per-observation expression.
    """
    name = F.upper(model)
    single = name.isin("SIMPLE_PINHOLE", "SIMPLE_RADIAL", "RADIAL")
    p = [F.try_element_at(params, F.lit(i + 1)) for i in range(8)]
    fisheye = name == "OPENCV_FISHEYE"
    shift = lambda i: F.when(single, p[i - 1]).otherwise(p[i])
    k1 = F.when(name == "OPENCV", p[4]).when(name.isin("SIMPLE_RADIAL", "RADIAL"), p[3]).otherwise(0.0)
    k2 = F.when(name == "OPENCV", p[5]).when(name == "RADIAL", p[4]).otherwise(0.0)
    fields = [
        F.coalesce(fisheye, F.lit(False)).alias("fisheye"),
        p[0].alias("fx"), shift(1).alias("fy"), shift(2).alias("cx"), shift(3).alias("cy"),
        k1.alias("k1"), k2.alias("k2"),
        F.when(name == "OPENCV", p[6]).otherwise(0.0).alias("p1"),
        F.when(name == "OPENCV", p[7]).otherwise(0.0).alias("p2"),
    ]
    fields += [F.when(fisheye, p[4 + i]).otherwise(0.0).alias(f"f{i + 1}") for i in range(4)]
    return F.when(is_supported(model, params), F.struct(*fields))


def project(lens: Column, x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    """Pixel of a point in camera coordinates; NULL behind the camera or without a supported lens."""
    front = F.when(z > MIN_DEPTH, z)
    u, v = x / front, y / front
    r2 = u * u + v * v
    radial = 1 + lens["k1"] * r2 + lens["k2"] * r2 * r2
    u_poly = u * radial + 2 * lens["p1"] * u * v + lens["p2"] * (r2 + 2 * u * u)
    v_poly = v * radial + lens["p1"] * (r2 + 2 * v * v) + 2 * lens["p2"] * u * v
    r = F.sqrt(r2)
    theta2 = F.pow(F.atan(r), 2)
    bend = 1 + theta2 * (lens["f1"] + theta2 * (lens["f2"] + theta2 * (lens["f3"] + theta2 * lens["f4"])))
    fisheye_scale = F.when(r < 1e-8, 1.0).otherwise(F.atan(r) * bend / r)
    u_lens = F.when(lens["fisheye"], u * fisheye_scale).otherwise(u_poly)
    v_lens = F.when(lens["fisheye"], v * fisheye_scale).otherwise(v_poly)
    return lens["fx"] * u_lens + lens["cx"], lens["fy"] * v_lens + lens["cy"]
