"""Least-squares similarity (scale, rotation, translation) between matched point sets, in closed form (Horn 1987)."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import eigen
from plumbline.functions import rotation as R
from plumbline.session import cut

HIGH_RMSE = 5.0
_SRC = ("x", "y", "z")
_DST = ("gx", "gy", "gz")


def pair_moments(pairs: DataFrame, key: str = "flight_id") -> DataFrame:
    """All sums the fit needs, in one map-side combined aggregation per flight.

    ``pairs`` has source ``x, y, z`` and target ``gx, gy, gz``. Central moments keep precision at map coordinates.
    """
    finite = None
    for c in (*_SRC, *_DST):
        ok = F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
        finite = ok if finite is None else finite & ok
    sums = [F.count(F.lit(1)).alias("n"), F.bool_and(finite).alias("finite")]
    sums += [F.avg(c).alias(f"m_{c}") for c in (*_SRC, *_DST)]
    for prefix, cols in (("s", _SRC), ("d", _DST)):
        for i in range(3):
            for j in range(i, 3):
                sums.append(F.covar_pop(cols[i], cols[j]).alias(f"c_{prefix}{'xyz'[i]}{'xyz'[j]}"))
    sums += [F.covar_pop(_DST[i], _SRC[j]).alias(f"x_{i}{j}") for i, j in product(range(3), range(3))]
    return pairs.groupBy(key).agg(*sums)


def _entry(name: str) -> Column:
    """A moment, or zero where a flight has none."""
    return F.coalesce(F.nanvl(F.col(name), F.lit(0.0)), F.lit(0.0))


def _covariance(prefix: str) -> Column:
    upper = {(i, j): _entry(f"c_{prefix}{'xyz'[i]}{'xyz'[j]}") for i in range(3) for j in range(i, 3)}
    return eigen.symmetric(upper, 3)


def _quaternion_form() -> Column:
    """The 4x4 matrix whose eigenvector of the largest eigenvalue is the rotation from source to target (Horn 1987)."""
    s = {(a, b): _entry(f"x_{b}{a}") for a, b in product(range(3), range(3))}
    upper = {(0, 0): s[0, 0] + s[1, 1] + s[2, 2]}
    for i, (j, k) in enumerate(((1, 2), (2, 0), (0, 1))):
        upper[0, i + 1] = s[j, k] - s[k, j]
        upper[i + 1, i + 1] = s[i, i] - s[j, j] - s[k, k]
        upper[min(j, k) + 1, max(j, k) + 1] = s[j, k] + s[k, j]
    return eigen.symmetric(upper, 4)


def fit(moments: DataFrame, key: str = "flight_id") -> DataFrame:
    """``(key, n, scale, r, t, status, reason)``; a flight that cannot be fitted has status ERROR and a reason.

    The input is one short row per flight; the fit is closed (Horn's quaternion) and stays in column expressions, so
    it needs no Python worker and no other shuffle. The result is written, as filters and joins on it would else solve each
    flight again.
    """

    def degenerate(prefix: str, label: str) -> tuple[tuple[Column, str], ...]:
        total = sum((_entry(f"c_{prefix}{a}{a}") for a in "yz"), _entry(f"c_{prefix}xx"))
        middle, largest = (F.greatest(F.col(f"_{prefix}")[i]["value"], F.lit(0.0)) for i in (1, 2))
        # the square root of the ratio is compared, as spreads are lengths
        thin = F.sqrt(middle) < 1e-5 * F.sqrt(largest)
        return (total < 1e-10, f"{label} points coincide"), (thin, f"{label} points are collinear")

    solved = moments.withColumns({
        "_s": eigen.symmetric_eigen(_covariance("s"), 3), "_d": eigen.symmetric_eigen(_covariance("d"), 3),
        "_best": eigen.symmetric_eigen(_quaternion_form(), 4)[3],
    })
    variance = _entry("c_sxx") + _entry("c_syy") + _entry("c_szz")
    q = [F.col("_best")["vector"][i] for i in range(4)]
    turned = solved.withColumns({
        "_scale": F.when(variance > 0, F.col("_best")["value"] / variance),
        "_r": R.pack_matrix(R.quaternion_to_matrix(*q)),
    })
    checks = [(~F.col("finite"), "coordinates are not finite"), (F.col("n") < 3, "fewer than 3 pairs")]
    checks += [*degenerate("s", "source"), *degenerate("d", "target")]
    scale = F.col("_scale")
    checks.append((~F.coalesce((scale > 0) & ~F.isnan(scale) & (scale < float("inf")), F.lit(False)), "scale is not positive"))
    reason = F.coalesce(*[F.when(bad, text) for bad, text in checks])
    moved = R.apply(R.matrix_columns(F.col("_r")), [F.col(f"m_{c}") for c in _SRC])
    shift = F.array(*[F.col(f"m_{c}") - scale * v for c, v in zip(_DST, moved)])
    good = F.col("reason").isNull()
    return cut(turned.withColumn("reason", reason).select(
        key, "n", F.when(good, scale).alias("scale"), F.when(good, F.col("_r")).alias("r"), F.when(good, shift).alias("t"),
        F.when(good, "PASS").otherwise("ERROR").alias("status"), "reason",
    ))


def residuals(pairs: DataFrame, fits: DataFrame, key: str = "flight_id") -> DataFrame:
    """Each pair with the distance between its transformed source and its target."""
    joined = pairs.join(fits.select(key, F.col("scale").alias("_s"), F.col("r").alias("_r"), F.col("t").alias("_t")), key)
    turned = R.apply(R.matrix_columns(F.col("_r")), [F.col(c) for c in _SRC])
    gaps = [F.col("_s") * turned[i] + F.col("_t")[i] - F.col(_DST[i]) for i in range(3)]
    residual = F.sqrt(gaps[0] * gaps[0] + gaps[1] * gaps[1] + gaps[2] * gaps[2])
    return joined.withColumn("residual_m", residual).drop("_s", "_r", "_t")


def fit_quality(with_residuals: DataFrame, fits: DataFrame, key: str = "flight_id") -> DataFrame:
    """Fits with RMSE, largest residual, notes and the final status."""
    errors = with_residuals.groupBy(key).agg(
        F.sqrt(F.avg(F.col("residual_m") * F.col("residual_m"))).alias("rmse"), F.max("residual_m").alias("max_error")
    )
    high = (F.col("status") == "PASS") & (F.col("rmse") > HIGH_RMSE)
    notes = F.array_compact(F.array(
        F.when(F.col("status") == "PASS", F.format_string("similarity fit from %d pairs, scale %.6f", "n", "scale")),
        F.when(high, F.format_string("high alignment error %.2f m, check time sync and GPS quality", "rmse")),
        F.col("reason"),
    ))
    return fits.join(errors, key, "left").select(
        key, "n", "scale", "r", "t", "rmse", "max_error",
        F.when(high, "WARNING").otherwise(F.col("status")).alias("status"), "reason", notes.alias("notes"),
    )


def transform_poses(poses: DataFrame, fits: DataFrame, key: str = "flight_id") -> DataFrame:
    """Poses in the target frame: ``new_x, new_y, new_z`` and the world-to-camera rotation as ``new_q``.

    A pose has its orientation as ``r`` (3x3), else as quaternion, else identity; flights without a fit pass unchanged.
    """
    joined = poses.join(fits.select(key, F.col("scale").alias("_s"), F.col("r").alias("_r"), F.col("t").alias("_t")), key, "left")
    from_q = R.quaternion_to_matrix(*[F.col(c) for c in ("qw", "qx", "qy", "qz")])
    identity = [F.lit(1.0 if i % 4 == 0 else 0.0) for i in range(9)]
    given = R.matrix_columns(F.col("r")) if "r" in poses.columns else [F.lit(None).cast("double")] * 9
    staged = joined.select(
        "*", F.array(*[F.coalesce(g, q, i) for g, q, i in zip(given, from_q, identity)]).alias("_own")
    )
    own = [F.col("_own")[i] for i in range(9)]
    fitted = F.col("_s").isNotNull()
    turn = R.matrix_columns(F.col("_r"))
    position = [F.col(c) for c in _SRC]
    moved = [F.col("_s") * v + F.col("_t")[i] for i, v in enumerate(R.apply(turn, position))]
    rotated = F.when(fitted, F.array(*R.multiply(own, R.transpose(turn)))).otherwise(F.col("_own"))
    placed = staged.select(
        *poses.columns, rotated.alias("new_r"),
        *[F.when(fitted, m).otherwise(p).alias(f"new_{c}") for m, p, c in zip(moved, position, _SRC)],
    )
    return placed.withColumn("new_q", R.matrix_to_quaternion([F.col("new_r")[i] for i in range(9)]))
