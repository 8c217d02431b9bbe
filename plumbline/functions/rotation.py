"""Rotations as column expressions; quaternions are scalar-first, matrices row-major."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

NEAR_ZERO_NORM = 1e-12


def quaternion_to_matrix(qw: Column, qx: Column, qy: Column, qz: Column) -> list[Column]:
    """Nine matrix entries of the normalised quaternion; NULL when its length is near zero."""
    norm2 = qw * qw + qx * qx + qy * qy + qz * qz
    scale = F.when(norm2 >= NEAR_ZERO_NORM**2, F.lit(2.0) / norm2)
    return [
        1 - scale * (qy * qy + qz * qz), scale * (qx * qy - qw * qz), scale * (qx * qz + qw * qy),
        scale * (qx * qy + qw * qz), 1 - scale * (qx * qx + qz * qz), scale * (qy * qz - qw * qx),
        scale * (qx * qz - qw * qy), scale * (qy * qz + qw * qx), 1 - scale * (qx * qx + qy * qy),
    ]


def matrix_columns(matrix: Column) -> list[Column]:
    """Nine entries of an ``array<array<double>>`` column."""
    return [matrix[i][j] for i in range(3) for j in range(3)]


def pack_matrix(m: Sequence[Column]) -> Column:
    return F.array(*(F.array(*m[3 * i: 3 * i + 3]) for i in range(3)))


def multiply(a: Sequence[Column], b: Sequence[Column]) -> list[Column]:
    return [sum((a[3 * i + k] * b[3 * k + j] for k in range(1, 3)), a[3 * i] * b[j]) for i in range(3) for j in range(3)]


def transpose(m: Sequence[Column]) -> list[Column]:
    return [m[3 * j + i] for i in range(3) for j in range(3)]


def apply(m: Sequence[Column], v: Sequence[Column]) -> list[Column]:
    return [m[3 * i] * v[0] + m[3 * i + 1] * v[1] + m[3 * i + 2] * v[2] for i in range(3)]


def matrix_to_quaternion(m: Sequence[Column]) -> Column:
    """Unit quaternion ``array(w, x, y, z)`` with ``w >= 0``; the largest component is taken first (Shepperd)."""
    trace = m[0] + m[4] + m[8]
    fours = [1 + trace, 1 + m[0] - m[4] - m[8], 1 + m[4] - m[0] - m[8], 1 + m[8] - m[0] - m[4]]
    yz, zx, xy = m[7] - m[5], m[2] - m[6], m[3] - m[1]
    sxy, szx, syz = m[3] + m[1], m[2] + m[6], m[7] + m[5]
    numerators = [
        [fours[0], yz, zx, xy],
        [yz, fours[1], sxy, szx],
        [zx, sxy, fours[2], syz],
        [xy, szx, syz, fours[3]],
    ]
    largest = F.greatest(*fours)
    raw = F.when(fours[0] == largest, F.array(*numerators[0]))
    for pick in (1, 2, 3):
        raw = raw.when(fours[pick] == largest, F.array(*numerators[pick]))
    # every candidate is the quaternion times a positive factor or its negative, so one scaling fixes both
    length = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda acc, v: acc + v * v))
    sign = F.when(raw[0] < 0, -1.0).otherwise(1.0)
    return F.transform(raw, lambda v: v * sign / length)


def camera_center(m: Sequence[Column], t: Sequence[Column]) -> list[Column]:
    """Position of a world-to-camera pose in world coordinates."""
    return [-(m[i] * t[0] + m[3 + i] * t[1] + m[6 + i] * t[2]) for i in range(3)]


def relative_angle_deg(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Angle of the rotation that takes ``a`` to ``b``."""
    trace = sum((a[i] * b[i] for i in range(1, 9)), a[0] * b[0])
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (trace - 1) / 2))))


def flip_camera_axes(m: Sequence[Column]) -> list[Column]:
    """Camera-to-world rotation with the Y and Z camera axes reversed; its own inverse."""
    return [m[i] if i % 3 == 0 else -m[i] for i in range(9)]


def homogeneous(m: Sequence[Column], center: Sequence[Column]) -> Column:
    """4x4 matrix as ``array<array<double>>``."""
    rows = [F.array(*m[3 * i: 3 * i + 3], center[i]) for i in range(3)]
    return F.array(*rows, F.array(*(F.lit(v) for v in (0.0, 0.0, 0.0, 1.0))))
