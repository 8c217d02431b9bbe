import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.functions import camera, names, utm
from plumbline.functions import rotation as R
from plumbline.functions.eigen import symmetric_eigen
from plumbline.functions.timestamps import parse_seconds, seconds_in_name
from plumbline.operators import similarity
from plumbline.plans.georeference import georeference


def one(df, column):
    return df.select(column.alias("v")).first()["v"]


def project(spark, model, params, xyz):
    row = spark.range(1).select(
        F.lit(model).alias("m"), F.array(*[F.lit(float(p)) for p in params]).alias("p"), *[F.lit(float(v)).alias(n) for v, n in zip(xyz, "xyz")])
    row = row.withColumn("lens", camera.canonical(F.col("m"), F.col("p")))
    u, v = camera.project(F.col("lens"), F.col("x"), F.col("y"), F.col("z"))
    got = row.select(u.alias("u"), v.alias("v"), F.col("lens").isNotNull().alias("s")).first()
    return got["u"], got["v"], got["s"]


def test_projection_values(spark):
    assert project(spark, "SIMPLE_PINHOLE", (1000, 960, 540), (1, 2, 10))[:2] == (1060.0, 740.0)
    assert project(spark, "simple_radial", (1000, 960, 540, 0.1), (1, 0, 10))[:2] == pytest.approx((1060.1, 540.0))
    assert project(spark, "PINHOLE", (1000, 1000, 960, 540), (0, 0, -1)) == (None, None, True)
    assert project(spark, "FULL_OPENCV", [1.0] * 12, (0, 0, 1)) == (None, None, False)
    assert project(spark, "OPENCV", (1000, 1000, 960, 540), (0, 0, 1)) == (None, None, False)


def test_fisheye_projection(spark):
    k = (0.1, 0.01, 0.001, 0.002)
    u, v, _ = project(spark, "OPENCV_FISHEYE", (1000, 900, 960, 540, *k), (0.3, 0.4, 1))
    theta = math.atan(0.5)
    s = theta * (1 + sum(c * theta ** (2 * i + 2) for i, c in enumerate(k))) / 0.5
    assert (u, v) == pytest.approx((1000 * 0.3 * s + 960, 900 * 0.4 * s + 540))


def test_quaternion_round_trip(spark):
    rng = np.random.default_rng(1)
    q = rng.normal(size=(50, 4))
    q = np.vstack([q / np.linalg.norm(q, axis=1, keepdims=True), np.eye(4), [[0.5, 0.5, 0.5, -0.5]], [[0.0, 0.6, 0.8, 0.0]]])
    q[np.arange(len(q)), 0] = np.where(q[:, 0] == 0, 0.0, q[:, 0])
    df = spark.createDataFrame(pd.DataFrame(q * 3, columns=["w", "x", "y", "z"]).assign(i=range(len(q))))
    matrix = R.quaternion_to_matrix(*[F.col(c) for c in "wxyz"])
    back = df.withColumn("m", F.array(*matrix)).withColumn("q", R.matrix_to_quaternion([F.col("m")[i] for i in range(9)]))
    for row in back.collect():
        want = q[row["i"]]
        m = np.array(row["m"]).reshape(3, 3)
        assert np.allclose(m @ m.T, np.eye(3)) and np.isclose(np.linalg.det(m), 1)
        got = np.array(row["q"])
        assert got[0] >= 0 and (np.allclose(got, want) or np.allclose(got, -want))


def test_zero_quaternion_is_null(spark):
    zero = F.lit(0.0)
    assert one(spark.range(1), R.quaternion_to_matrix(zero, zero, zero, zero)[0]) is None


def test_camera_center_and_angle(spark):
    c, s = math.cos(0.3), math.sin(0.3)
    m = [F.lit(v) for v in (c, -s, 0.0, s, c, 0.0, 0.0, 0.0, 1.0)]
    center = [one(spark.range(1), v) for v in R.camera_center(m, [F.lit(1.0), F.lit(2.0), F.lit(3.0)])]
    assert center == pytest.approx(list(-np.array([[c, -s, 0], [s, c, 0], [0, 0, 1]]).T @ [1, 2, 3]))
    identity = [F.lit(1.0 if i % 4 == 0 else 0.0) for i in range(9)]
    assert one(spark.range(1), R.relative_angle_deg(identity, m)) == pytest.approx(math.degrees(0.3))


def test_axes_flip_is_its_own_inverse(spark):
    identity = [F.lit(1.0 if i % 4 == 0 else 0.0) for i in range(9)]
    flipped = R.flip_camera_axes(identity)
    assert [one(spark.range(1), v) for v in flipped] == [1, 0, 0, 0, -1, 0, 0, 0, -1]
    assert [one(spark.range(1), v) for v in R.flip_camera_axes(flipped)] == [1, 0, 0, 0, 1, 0, 0, 0, 1]


def test_frame_keys(spark):
    rows = spark.createDataFrame([("frame_000127.jpg",), ("DJI_0452.JPG",), ("000001.png",), ("no_number_here.png",)], "n string")
    got = [tuple(r) for r in rows.select(names.frame_key(F.col("n")), names.frame_id(F.col("n"))).collect()]
    assert got == [(127, "frame_000127"), (452, "frame_000452"), (1, "frame_000001"), (-1, "no_number_here")]


def test_timestamps(spark):
    texts = {
        "1725700000.5": 1725700000.5, " 1725700000 ": 1725700000.0, "2026-09-07T12:00:00Z": 1788782400.0,
        "2026-09-07T12:00:00+02:00": 1788775200.0, "2026-09-07 12:00:00": 1788782400.0, "2026-09-07 12:00:00.5": 1788782400.5,
        "2026/09/07 12:00:00": 1788782400.0, "2026/09/07 12:00:00.25": 1788782400.25, "07-09-2026 12:00:00": 1788782400.0,
        "07-09-2026 12:00:00.125": 1788782400.125, "garbage": None, "inf": None, "nan": None, "": None,
    }
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r["t"]: r["v"] for r in df.select("t", parse_seconds(F.col("t")).alias("v")).collect()}
    assert got == texts


def test_time_in_name(spark):
    df = spark.createDataFrame([("img_1725712345.123.jpg",), ("a1725712345b.jpg",), ("frame_000001.jpg",)], "n string")
    assert [r[0] for r in df.select(seconds_in_name(F.col("n"))).collect()] == [1725712345.123, 1725712345.0, None]


def redfearn(lon, lat, zone):
    """Independent transverse Mercator: numerical meridian arc and Redfearn's series in the longitude difference."""
    a, f = utm.SEMI_MAJOR, utm.FLATTENING
    e2 = f * (2 - f)
    phi = math.radians(lat)
    grid = np.linspace(0, phi, 20001)
    integrand = a * (1 - e2) / (1 - e2 * np.sin(grid) ** 2) ** 1.5
    m = np.trapezoid(integrand, grid)
    w = math.radians(lon - (zone * 6 - 183))
    s, c, t = math.sin(phi), math.cos(phi), math.tan(phi)
    nu = a / math.sqrt(1 - e2 * s * s)
    rho = a * (1 - e2) / (1 - e2 * s * s) ** 1.5
    psi = nu / rho
    east = nu * c * w * (1 + w**2 / 6 * c**2 * (psi - t**2) + w**4 / 120 * c**4 * (
        4 * psi**3 * (1 - 6 * t**2) + psi**2 * (1 + 8 * t**2) - psi * 2 * t**2 + t**4))
    north = m + nu * s * w**2 / 2 * c + nu * s * w**4 / 24 * c**3 * (4 * psi**2 + psi - t**2) + nu * s * w**6 / 720 * c**5 * (
        8 * psi**4 * (11 - 24 * t**2) - 28 * psi**3 * (1 - 6 * t**2) + psi**2 * (1 - 32 * t**2) - 2 * psi * t**2 + t**4)
    return 500000 + 0.9996 * east, 0.9996 * north + (1e7 if lat < 0 else 0)


def test_utm_against_redfearn(spark):
    rng = np.random.default_rng(3)
    pts = pd.DataFrame({"lon": rng.uniform(-179, 179, 200), "lat": rng.uniform(-80, 84, 200)})
    df = spark.createDataFrame(pts).withColumn("epsg", utm.zone_epsg(F.col("lon"), F.col("lat")))
    df = df.withColumn("u", utm.to_utm(F.col("lon"), F.col("lat"), F.col("epsg")))
    df = df.withColumn("b", utm.to_wgs84(F.col("u.easting"), F.col("u.northing"), F.col("epsg")))
    for r in df.collect():
        east, north = redfearn(r["lon"], r["lat"], r["epsg"] % 100)
        assert abs(r["u"]["easting"] - east) < 2e-3 and abs(r["u"]["northing"] - north) < 2e-3
        assert abs(r["b"]["lon"] - r["lon"]) < 1e-9 and abs(r["b"]["lat"] - r["lat"]) < 1e-9


def test_utm_zones(spark):
    df = spark.createDataFrame([(77.59, 12.97), (151.2, -33.8), (180.0, 10.0), (-180.0, -1.0), (0.0, 95.0)], "lon double, lat double")
    got = [tuple(r) for r in df.select(utm.zone_epsg(F.col("lon"), F.col("lat")), utm.crs_name(utm.zone_epsg(F.col("lon"), F.col("lat")))).collect()]
    assert [g[0] for g in got] == [32643, 32756, 32660, 32701, None]
    assert got[0][1] == "WGS 84 / UTM zone 43N"


def euler(z, y, x):
    z, y, x = map(math.radians, (z, y, x))
    rz = np.array([[math.cos(z), -math.sin(z), 0], [math.sin(z), math.cos(z), 0], [0, 0, 1]])
    ry = np.array([[math.cos(y), 0, math.sin(y)], [0, 1, 0], [-math.sin(y), 0, math.cos(y)]])
    rx = np.array([[1, 0, 0], [0, math.cos(x), -math.sin(x)], [0, math.sin(x), math.cos(x)]])
    return rz @ ry @ rx


def pair_table(spark, groups):
    frames = []
    for name, (src, dst) in groups.items():
        frames.append(pd.DataFrame(np.hstack([src, dst]), columns=["x", "y", "z", "gx", "gy", "gz"]).assign(flight_id=name))
    return spark.createDataFrame(pd.concat(frames))


def test_similarity_fit(spark):
    rng = np.random.default_rng(42)
    src = rng.normal(size=(8, 3)) * 10
    turn, shift = euler(25, -15, 40), np.array([500.0, -250, 100])
    far = shift + [781476.0, 1435426.0, 0]
    line = np.outer(np.arange(6.0), [1, 2, 3])
    noisy = 4.25 * src @ turn.T + shift + rng.normal(size=(8, 3)) * 30
    groups = {
        "good": (src, 4.25 * src @ turn.T + shift), "far": (src, 4.25 * src @ turn.T + far), "noisy": (src, noisy),
        "few": (src[:2], src[:2]), "line": (line, line), "same": (np.ones((5, 3)), src[:5]), "mirror": (src, src * [1, 1, -1]),
    }
    pairs = pair_table(spark, groups)
    fits = similarity.fit(similarity.pair_moments(pairs))
    rows = {r["flight_id"]: r for r in similarity.fit_quality(similarity.residuals(pairs, fits.filter("status <> 'ERROR'")), fits).collect()}
    for name, t in (("good", shift), ("far", far)):
        r = rows[name]
        assert r["scale"] == pytest.approx(4.25, abs=1e-6) and np.allclose(r["r"], turn, atol=1e-6)
        assert np.allclose(r["t"], t, atol=1e-4) and r["rmse"] < 1e-4 and r["status"] == "PASS"
    assert rows["noisy"]["status"] == "WARNING" and rows["noisy"]["rmse"] > 5
    assert rows["few"]["reason"] == "fewer than 3 pairs"
    assert rows["line"]["reason"] == "source points are collinear"
    assert rows["same"]["reason"] == "source points coincide"
    assert np.linalg.det(np.array(rows["mirror"]["r"])) == pytest.approx(1)


def test_pose_transform(spark):
    poses = spark.createDataFrame([("f", "a", 5.0, -2.0, 10.0, 1.0, 0.0, 0.0, 0.0)], "flight_id string, frame_id string, x double, y double, z double, qw double, qx double, qy double, qz double")
    fit = spark.createDataFrame([("f", 2.0, [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]], [100.0, 200.0, 300.0])], "flight_id string, scale double, r array<array<double>>, t array<double>")
    r = similarity.transform_poses(poses, fit).first()
    assert (r["new_x"], r["new_y"], r["new_z"], list(r["new_q"])) == (110.0, 196.0, 320.0, [1.0, 0.0, 0.0, 0.0])
    kept = similarity.transform_poses(poses, fit.filter("false")).first()
    assert (kept["new_x"], kept["new_y"], kept["new_z"]) == (5.0, -2.0, 10.0)


def test_georeference_job(spark):
    pos = [(0.0, 0.0, 0.0), (10.0, 0.0, 0.0), (0.0, 10.0, 0.0), (10.0, 10.0, 5.0)]
    poses = spark.createDataFrame(
        [("f", f"frame_{i:06d}", f"frame_{i:06d}.jpg", 100.0 + i, *p, 1.0, 0.0, 0.0, 0.0) for i, p in enumerate(pos)]
        + [("lonely", "frame_000000", "frame_000000.jpg", 100.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0)],
        "flight_id string, frame_id string, image_name string, ts_s double, x double, y double, z double, qw double, qx double, qy double, qz double")
    fixes = spark.createDataFrame(
        [("f", i, 100.0 + i, 12.9715 + p[1] * 9e-6, 77.5945 + p[0] * 9.2e-6, 920.0 + p[2]) for i, p in enumerate(pos)],
        "flight_id string, seq bigint, ts_s double, lat double, lon double, alt double")
    out = georeference(poses, fixes, 0.5)
    flights = {r["flight_id"]: r for r in out["flights"].collect()}
    assert flights["f"]["status"] == "PASS" and flights["f"]["matched_poses"] == 4 and flights["f"]["target_crs"] == "EPSG:32643"
    assert flights["lonely"]["status"] == "ERROR"
    assert out["features"].count() == 4
    assert all(r["wgs84"]["altitude"] > 900 for r in out["cameras"].collect())


def test_symmetric_eigen(spark):
    rng = np.random.default_rng(5)
    cases = [rng.normal(size=(4, 4)) * 10.0 ** k for k in (-8, 0, 9)] + [np.zeros((4, 4)), np.diag([3.0, 1, 1, 2]), np.outer([1, 2, 3, 4], [1, 2, 3, 4])]
    cases = [(m + m.T) / 2 for m in cases]
    rows = spark.createDataFrame([(i, m.tolist()) for i, m in enumerate(cases)], "id int, m array<array<double>>")
    for r in rows.select("id", symmetric_eigen(F.col("m"), 4).alias("e")).collect():
        m = cases[r["id"]]
        values, vectors = np.array([e["value"] for e in r["e"]]), np.array([e["vector"] for e in r["e"]])
        size = max(np.abs(m).max(), 1e-300)
        assert np.allclose(values / size, np.linalg.eigvalsh(m) / size, atol=1e-12)
        assert np.allclose(vectors @ vectors.T, np.eye(4), atol=1e-12)
        assert np.allclose(vectors @ m / size, values[:, None] * vectors / size, atol=1e-11)


def test_similarity_fit_equals_svd(spark):
    """Random, flat, mirrored and nearly collinear pairs against the decomposition of their cross covariance."""
    rng = np.random.default_rng(6)
    groups = {}
    for i in range(12):
        src = rng.normal(size=(6, 3)) * [[1, 1, 1], [1, 1, 0], [1, 1e-3, 1e-3]][i % 3] * 50
        mirror = [1, 1, -1] if i % 4 == 3 else [1, 1, 1]
        groups[f"g{i:02}"] = (src, (src * mirror) @ euler(*rng.uniform(-180, 180, 3)).T * rng.uniform(0.1, 9) + rng.normal(size=(6, 3)) * (i % 2) + [5e5, 4e6, 90])
    groups["flat cross"] = (np.array([[1.0, 0, 0], [-1, 0, 0], [0, 1, 0], [0, -1, 0]]), np.array([[0.0, 0, 1], [0, 0, 1], [0, 0, -1], [0, 1, -1]]))
    fits = {r["flight_id"]: r for r in similarity.fit(similarity.pair_moments(pair_table(spark, groups))).collect()}
    for name, (src, dst) in groups.items():
        r, a, b = fits[name], src - src.mean(0), dst - dst.mean(0)
        u, sv, vt = np.linalg.svd(b.T @ a / len(a))
        sign = np.array([1, 1, -1.0 if np.linalg.det(u @ vt) < 0 else 1.0])
        scale = (sv * sign).sum() / (a ** 2).sum(1).mean()
        assert r["status"] == ("PASS" if scale > 1e-15 else "ERROR"), (name, r)
        if r["status"] == "PASS":
            assert r["scale"] == pytest.approx(scale, rel=1e-9) and np.linalg.det(np.array(r["r"])) == pytest.approx(1)
            if sv[1] + sign[2] * sv[2] > 1e-4 * sv[0]:
                assert np.allclose(r["r"], (u * sign) @ vt, atol=1e-5), name
                assert np.allclose(r["t"], dst.mean(0) - scale * ((u * sign) @ vt) @ src.mean(0), atol=1e-3), name


def test_similarity_fit_not_finite(spark):
    src = np.arange(12.0).reshape(4, 3) ** 2
    bad = src.copy()
    bad[1, 1] = np.nan
    rows = {r["flight_id"]: r for r in similarity.fit(similarity.pair_moments(pair_table(spark, {"nan": (src, bad), "two": (src[:2], src[:2])}))).collect()}
    assert (rows["nan"]["status"], rows["nan"]["reason"], rows["nan"]["scale"], rows["nan"]["r"]) == ("ERROR", "coordinates are not finite", None, None)
    assert rows["two"]["reason"] == "fewer than 3 pairs"


def test_a_fit_is_solved_once_whatever_reads_it(spark):
    """A filter on the status does not bring the eigenvalues into the reader's plan."""
    from plumbline.operators import similarity

    pairs = spark.range(30).selectExpr(
        "id % 2 AS flight_id", "CAST(id * id % 7 AS DOUBLE) AS x", "CAST(id % 5 AS DOUBLE) AS y", "CAST(id % 3 AS DOUBLE) AS z",
    ).selectExpr("*", "2 * x + 1 AS gx", "2 * y AS gy", "2 * z AS gz")
    fits = similarity.fit(similarity.pair_moments(pairs))
    good = fits.filter("status <> 'ERROR'")
    assert "aggregate(" not in good._jdf.queryExecution().executedPlan().toString()
    assert [round(r["scale"], 9) for r in good.collect()] == [2.0, 2.0]
