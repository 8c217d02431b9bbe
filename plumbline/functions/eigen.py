"""Eigenvalues and eigenvectors of small symmetric matrices as column expressions (cyclic Jacobi rotations)."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: rotations converge quadratically, so ten sweeps reach double precision for any 3x3 or 4x4 matrix
SWEEPS = 10


def symmetric(upper: dict[tuple[int, int], Column], size: int) -> Column:
    """``array<array<double>>`` from the entries on and above the diagonal."""
    return F.array(*(F.array(*(upper[min(i, j), max(i, j)] for j in range(size))) for i in range(size)))


def symmetric_eigen(matrix: Column, size: int, sweeps: int = SWEEPS) -> Column:
    """``array<struct(value, vector)>`` by ascending eigenvalue; vectors are unit columns of either sign.

    The matrix and the product of all rotations are turned together, as one stack of ``2 * size`` rows.
    """
    unit = F.array(*(F.array(*(F.lit(float(i == j)) for j in range(size))) for i in range(size)))
    planes = F.array(*(F.struct(F.lit(p).alias("p"), F.lit(q).alias("q")) for p, q in combinations(range(size), 2)))

    def rotate(stack: Column, plane: Column) -> Column:
        p, q = plane["p"], plane["q"]
        off = stack[p][q]
        tau = (stack[q][q] - stack[p][p]) / (2 * off)
        tangent = F.when(off != 0, F.when(tau < 0, -1.0).otherwise(1.0) / (F.abs(tau) + F.sqrt(1 + tau * tau))).otherwise(0.0)

        def turn(t: Column) -> Column:
            c = 1 / F.sqrt(1 + t * t)
            s = t * c
            columns = F.transform(stack, lambda row: F.transform(row, lambda v, j: (
                F.when(j == p, c * row[p] - s * row[q]).when(j == q, s * row[p] + c * row[q]).otherwise(v)
            )))
            return F.transform(F.array(columns), lambda m: F.transform(m, lambda row, i: (
                F.when(i == p, F.zip_with(m[p], m[q], lambda a, b: c * a - s * b))
                .when(i == q, F.zip_with(m[p], m[q], lambda a, b: s * a + c * b)).otherwise(row)
            )))[0]

        return F.transform(F.array(tangent), turn)[0]

    turned = F.aggregate(F.flatten(F.array_repeat(planes, sweeps)), F.concat(matrix, unit), rotate)
    pairs = F.transform(F.array(turned), lambda m: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda j: F.struct(
        m[j][j].alias("value"), F.transform(F.slice(m, size + 1, size), lambda row: row[j]).alias("vector")
    )))[0]
    return F.array_sort(pairs)
