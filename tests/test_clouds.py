import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.operators import clouds, neighbors
from plumbline.params import CloudCleaning
from plumbline.plans.cloud_cleaning import clean


def cloud(spark, xyz, name="a", **columns):
    return spark.createDataFrame(pd.DataFrame(np.asarray(xyz, float), columns=["x", "y", "z"]).assign(
        cloud_id=name, point_id=np.arange(len(xyz)), **columns))


def mixed(seed=0):
    """Dense core, wide halo, one heap of copies and grid points: the shapes that break fixed grids."""
    rng = np.random.default_rng(seed)
    return np.concatenate([
        rng.normal(0, 1, (900, 3)), rng.normal(5, 0.01, (900, 3)), rng.normal(0, 30, (80, 3)), np.tile([[1.0, 2, 3]], (1000, 1)),
        np.round(rng.uniform(0, 4, (300, 3))), np.column_stack([rng.uniform(0, 9, 200), np.zeros(200), np.zeros(200)]),
    ])


def distances(p):
    return np.sqrt(((p[:, None] - p[None]) ** 2).sum(-1))


def test_neighbours_equal_brute_force(spark):
    p = mixed()
    df, d = cloud(spark, p), distances(mixed())
    want = np.sort(d, axis=1)[:, :12]
    by_place = {tuple(c): w for c, w in zip(p, want)}
    got = neighbors.nearest_distances(df, 12, tile_points=64).collect()
    assert len(got) == len(by_place)
    for r in got:
        assert np.allclose(r["distances"], by_place[(r["x"], r["y"], r["z"])], atol=1e-12)
    counts = {tuple(c): n for c, n in zip(p, (d <= 0.7).sum(axis=1))}
    for r in neighbors.radius_counts(df, 0.7, tile_points=64).collect():
        assert r["neighbors"] == counts[(r["x"], r["y"], r["z"])]
    for r in neighbors.radius_counts(df, 0.7, enough=20, tile_points=64).collect():
        n = counts[(r["x"], r["y"], r["z"])]
        assert (r["neighbors"] > 20) == (n > 20) and (n > 20 or r["neighbors"] == n)


def test_neighbour_ids(spark):
    p = mixed(1)
    d = distances(p)
    np.fill_diagonal(d, np.inf)
    got = neighbors.nearest_neighbors(cloud(spark, p), 4, tile_points=64).toPandas().sort_values(["point_id", "neighbor_rank"])
    ids = got.neighbor_id.to_numpy().reshape(-1, 4)
    want = np.array([np.lexsort((np.arange(len(p)), row))[:4] for row in d])
    assert (ids == want).all()


def _tree(p):
    weights = np.arange(len(p)) % 3 + 1
    return neighbors._Tree(np.asarray(p, float), weights), weights


def test_tree_search_measures_few_distances():
    """The k nearest of every point, ties and heaps included, from a small share of all distances."""
    p = np.concatenate([mixed(), np.random.default_rng(2).normal(0, 3, (8000, 3))])
    tree, _ = _tree(p)
    for block in tree.blocks():
        found, parts, nearest = tree.candidates(p[block], 20)
        d = ((p[block][:, None] - p[None]) ** 2)
        want = np.sort(d[..., 0] + d[..., 1] + d[..., 2], axis=1)[:, :20]
        assert (np.sort(nearest, axis=1) == want).all()
        read = np.concatenate(found)
        assert len(np.unique(read)) == len(read) and (np.sort(np.concatenate(parts, axis=1), axis=1)[:, :20] == want).all()
    assert tree.measured < 0.15 * len(p) ** 2
    near, _, _ = tree.candidates(p[:1], 20, np.array([0.0]))
    assert not near or len(np.concatenate(near)) <= 2 * neighbors.LEAF_POINTS + 1000


@pytest.mark.parametrize("radius, most", [(0.5, 0.1), (5.0, 0.65), (200.0, 0.0001)])
def test_tree_counts_add_whole_nodes(radius, most):
    """A ball about as large as the cloud is counted from few nodes' weights; points are compared at its surface only."""
    p = np.random.default_rng(3).normal(0, 3, (9000, 3))
    tree, weights = _tree(p)
    for block in tree.blocks():
        d = ((p[block][:, None] - p[None]) ** 2)
        want = (d[..., 0] + d[..., 1] + d[..., 2] <= radius * radius) @ weights
        assert (tree.count(p[block], radius * radius, weights) == want).all()
    assert tree.measured < most * len(p) ** 2


def test_small_cloud_has_fewer_neighbours(spark):
    got = neighbors.nearest_distances(cloud(spark, [[0, 0, 0], [1, 0, 0]]), 5).collect()
    assert all(list(r["distances"]) == [0.0, 1.0] for r in got)


def test_validation(spark):
    corners = [[0, 0, 0], [10, 0, 0], [0, 10, 0], [0, 0, 10]]
    df = cloud(spark, corners, "box", r=1, g=2, b=3).unionByName(cloud(spark, [[1, 1, 1], [1, 1, 1], [2, 2, 2]], "copies", r=1, g=2, b=300))
    df = df.unionByName(cloud(spark, [[np.nan, 0, 0], [1, 1, 1]], "broken", r=1, g=2, b=3))
    rows = {r["cloud_id"]: r for r in clouds.validate_clouds(df).collect()}
    box = rows["box"]
    assert (box["status"], box["volume"], box["extent_x"], box["density"]) == ("PASS", 1000.0, 10.0, 0.004)
    assert rows["copies"]["duplicate_points"] == 1 and rows["copies"]["status"] == "WARNING" and not rows["copies"]["rgb_valid"]
    assert rows["broken"]["status"] == "ERROR"


def brute_sor(p, k, ratio):
    means = np.sort(distances(p), axis=1)[:, :k].mean(axis=1)
    positive = means > 0
    mu = means[positive].sum() / len(p)
    sd = np.sqrt(((means[positive] - mu) ** 2).sum() / (len(p) - 1))
    return positive & (means < mu + ratio * sd)


def test_statistical_filter(spark):
    rng = np.random.default_rng(42)
    p = np.vstack([rng.normal(0, 0.2, (100, 3)), [[50, 50, 50], [-50, -50, -50]]])
    kept = {r["point_id"] for r in clouds.remove_statistical_outliers(cloud(spark, p), 16, 1.5).collect()}
    assert kept == set(np.flatnonzero(brute_sor(p, 16, 1.5))) and not {100, 101} & kept
    heap = np.vstack([p, np.tile([[0.0, 0, 0]], (30, 1))])
    kept = {r["point_id"] for r in clouds.remove_statistical_outliers(cloud(spark, heap), 16, 1.5).collect()}
    assert kept == set(np.flatnonzero(brute_sor(heap, 16, 1.5)))
    few = clouds.statistical_scores(cloud(spark, p[:10]), 16, 1.5).collect()
    assert all(r["keep"] and r["skipped"] for r in few)


def test_radius_filter(spark):
    rng = np.random.default_rng(3)
    p = np.vstack([rng.uniform(0, 0.3, (15, 3)), [[10, 10, 10]]])
    kept = {r["point_id"] for r in clouds.remove_radius_outliers(cloud(spark, p), 0.5, 8).collect()}
    assert kept == set(np.flatnonzero((distances(p) <= 0.5).sum(axis=1) > 8)) and 15 not in kept


def test_voxel(spark):
    p = np.vstack([np.random.default_rng(0).uniform(0, 0.1, (4, 3)), np.random.default_rng(1).uniform(5, 5.1, (4, 3))])
    got = clouds.voxel_downsample(cloud(spark, p, r=[10, 11, 11, 11, 200, 200, 200, 201], g=0, b=255), 0.5).collect()
    assert len(got) == 2 and sorted(r["r"] for r in got) == [10, 200]
    assert sorted(r["x"] for r in got) == pytest.approx(sorted([p[:4, 0].mean(), p[4:, 0].mean()]))


@pytest.mark.parametrize("call", [
    lambda d: clouds.statistical_scores(d, -5, 1.0), lambda d: clouds.statistical_scores(d, 5, -1.0),
    lambda d: clouds.radius_scores(d, -0.5), lambda d: clouds.voxel_downsample(d, -0.1),
])
def test_bad_parameters(spark, call):
    with pytest.raises(ValueError):
        call(cloud(spark, [[0, 0, 0]]))


def test_ground_plane(spark):
    rng = np.random.default_rng(7)
    flat = np.column_stack([rng.uniform(0, 50, (3000, 2)), rng.normal(2.0, 0.02, 3000)])
    p = np.vstack([flat, rng.uniform(0, 50, (1000, 3)) + [0, 0, 5]])
    r = clouds.ground_planes(cloud(spark, p), 0.2, 100, chunk_points=700).first()
    assert abs(r["c"]) > 0.999 and abs(r["d"]) == pytest.approx(2.0, abs=0.1) and r["ground_inliers"] >= 2950


def test_ground_plane_small_and_flat_clouds(spark):
    """Three points have one plane; points on a line, and fewer than three, have none; repeated ids are allowed."""
    three = cloud(spark, [[0, 0, 1], [1, 0, 1], [0, 1, 1]])
    r = clouds.ground_planes(three, 0.1, 20).first()
    assert (abs(r["c"]), r["ground_inliers"], r["num_points"], r["ground_fraction"]) == (1.0, 3, 3, 1.0)
    line = cloud(spark, [[0, 0, 0], [1, 1, 1], [2, 2, 2], [5, 5, 5]])
    assert clouds.ground_planes(line, 0.1, 20).count() == 0
    assert clouds.ground_planes(three.limit(2), 0.1, 20).count() == 0
    assert clouds.ground_planes(three.filter("false"), 0.1, 20).count() == 0
    repeated = three.withColumn("point_id", F.lit(1))
    assert clouds.ground_planes(repeated, 0.1, 20).first()["ground_inliers"] == 3


def test_ground_plane_draws_differ(spark):
    """All triples of a small cloud come up: of ten points each of the 120 possible planes is tried."""
    rng = np.random.default_rng(3)
    p = rng.normal(size=(10, 3))
    rows = spark.range(1).select(F.array(*[F.struct(F.lit(i).alias("rank"), *[F.lit(float(v)).alias(a) for a, v in zip("xyz", q)]) for i, q in enumerate(p)]).alias("ps"))
    planes = clouds._planes(rows.select(F.lit("a").alias("k"), F.inline(clouds._triples(2000, 0))), "k").toPandas()
    assert len({tuple(np.flatnonzero(np.abs(p @ r[["a", "b", "c"]].to_numpy(float) + r["d"]) < 1e-9)) for _, r in planes.iterrows()}) == 120


def test_transform_points(spark):
    fit = spark.createDataFrame([("a", 2.0, [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]], [100.0, 200.0, 300.0], "EPSG:32643")], "cloud_id string, scale double, r array<array<double>>, t array<double>, target_crs string")
    got = clouds.transform_points(cloud(spark, [[0, 0, 0], [1, 0, 0]]), fit).orderBy("point_id").collect()
    assert [(r["x"], r["y"], r["z"]) for r in got] == [(100, 200, 300), (102, 200, 300)]
    meta = spark.createDataFrame([("a", None, "local_unscaled", "local", False), ("b", "EPSG:32601", "metres", "georeferenced", True)], "cloud_id string, crs string, units string, convention string, is_georeferenced boolean")
    out = {r["cloud_id"]: r for r in clouds.georeference_meta(meta, fit).collect()}
    assert out["a"]["crs"] == "EPSG:32643" and out["a"]["units"] == "metres" and out["b"]["crs"] == "EPSG:32601"


def test_cleaning_job(spark):
    rng = np.random.default_rng(0)
    p = np.vstack([rng.normal(0, 0.5, (100, 3)), [[30, 30, 30]]])
    meta = spark.createDataFrame([("a", "EPSG:32643", "metres", True)], "cloud_id string, crs string, units string, is_georeferenced boolean")
    out = clean(cloud(spark, p, r=200, g=200, b=200), CloudCleaning(voxel_size=0.2, radius_enabled=True, radius=2.0, min_points=5), meta)
    report = out["report"].first()
    assert report["input_points"] == 101 and report["final_points"] < 101 and report["crs"] == "EPSG:32643"
    stages = [r["stage"] for r in out["stages"].orderBy("stage_no").collect()]
    assert stages == ["input", "statistical_outliers", "radius_outliers", "voxel_downsample"]
    assert out["points"].filter("x > 20").count() == 0 and out["points"].filter("r <> 200").count() == 0


def test_visits_grow_with_the_points(spark, monkeypatch):
    """On a rolling surface with thin corners, the tiles visited per point stay the same when the points are four times as many."""
    visits = {}
    kept = neighbors.cut

    def counting(df):
        out = kept(df)
        if "reach" in out.columns:
            visits[n] = out.count()
        return out

    monkeypatch.setattr(neighbors, "cut", counting)
    for n in (6000, 24000):
        rng = np.random.default_rng(n)
        xy = rng.normal(0, 100, (n, 2))
        pdf = pd.DataFrame({"cloud_id": "c", "x": xy[:, 0], "y": xy[:, 1], "z": 20 * np.sin(xy[:, 0] / 40)})
        out = neighbors.nearest_distances(spark.createDataFrame(pdf), 20, tile_points=64)
        assert out.filter("size(distances) <> 20").count() == 0
    assert visits[24000] / 24000 < 1.5 * visits[6000] / 6000


def test_leaves_do_not_share_lines():
    """Points on parallel lines: no leaf's box reaches into another's, so a search need not read both."""
    rng = np.random.default_rng(4)
    p = np.column_stack([rng.integers(0, 9, 5000), rng.uniform(0, 9, 5000), rng.integers(0, 3, 5000)]).astype(float)
    tree = neighbors._Tree(p)
    low, high = tree.low[tree.leaves], tree.high[tree.leaves]
    holding = ((p[:, None] >= low) & (p[:, None] <= high)).all(axis=2).sum(axis=1)
    assert (holding == 1).all()
    assert sorted(np.concatenate(list(tree.blocks()))) == list(range(len(p)))


def test_points_are_written_twice_to_be_tiled(spark, monkeypatch):
    """Splits are planned on a sample, so all points are written once as they come and once with their tile."""
    written = []
    kept = neighbors.cut

    def counting(df):
        out = kept(df)
        written.append(out.count() if {"x", "y", "z", "weight"} <= set(out.columns) else 0)
        return out

    monkeypatch.setattr(neighbors, "cut", counting)
    p = np.random.default_rng(5).uniform(0, 9, (40000, 3))
    tiling = neighbors.build_tiles(cloud(spark, p).withColumn("weight", F.lit(1).cast("bigint")), "cloud_id", 1024)
    assert written.count(40000) == 2 and len(tiling.levels) >= 1
    sizes = tiling.points.groupBy("tile").count().agg(F.max("count"), F.sum("count")).first()
    assert sizes[0] <= 2048 and sizes[1] == 40000


def test_cuts_keep_rounded_values_together(spark):
    """Planes whose heights differ by rounding only are not cut apart, so few points have to visit other tiles."""
    rng = np.random.default_rng(6)
    z = rng.integers(0, 12, 20000)
    p = np.column_stack([rng.integers(0, 9, 20000), rng.uniform(0, 9, 20000), np.where(rng.random(20000) < 0.5, z, np.nextafter(z, 99))])
    tiling = neighbors.build_tiles(cloud(spark, p).withColumn("weight", F.lit(1).cast("bigint")), "cloud_id", 1000)
    tiles = tiling.points.groupBy(F.round("z").alias("z"), F.col("x"), "tile").agg(F.min("z").alias("low"), F.max("z").alias("high"))
    assert tiles.filter("low = high").count() == 0
