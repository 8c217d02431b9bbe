"""The bounded-task forms must equal the plain windows."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from plumbline.operators import frames, ordering, timesync


def table(spark, n=3000, seed=0):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({
        "k": np.where(rng.random(n) < 0.4, 0, rng.integers(1, 30, n)), "i": rng.permutation(n), "v": np.round(rng.normal(size=n), 1),
    })
    return pdf, spark.createDataFrame(pdf)


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


def test_positions_and_neighbours(spark):
    _, df = table(spark)
    order = [F.col("v"), F.col("i")]
    for build, columns in (
        (ordering.with_position, ("k", "i", "pos")),
    ):
        assert rows(build(df, ["k"], order), *columns) == rows(build(df, ["k"], order, hot_rows=50), *columns)
    assert rows(ordering.with_previous(df, ["k"], order, ["v"]), "k", "i", "pos", "prev_v") == rows(
        ordering.with_previous(df, ["k"], order, ["v"], hot_rows=50), "k", "i", "pos", "prev_v")
    assert rows(ordering.with_next(df, ["k"], order, ["v"]), "k", "i", "pos", "next_v") == rows(
        ordering.with_next(df, ["k"], order, ["v"], hot_rows=50), "k", "i", "pos", "next_v")


def test_exact_median(spark):
    pdf, df = table(spark)
    want = pdf.groupby("k")["v"].median()
    for limit in (None, 10):
        got = {r["k"]: r["median"] for r in ordering.exact_median(df, ["k"], "v", hot_rows=limit).collect()}
        assert got.keys() == set(want.index) and all(abs(got[k] - want[k]) < 1e-12 for k in got)


def test_running_max(spark):
    pdf, df = table(spark, 500)
    placed = ordering.with_position(df, ["k"], [F.col("i")])
    got = ordering.running_max(placed, ["k"], "pos", F.when(F.col("v") > 1, F.col("v")), "best", slice_rows=16)
    have = {(r["k"], r["i"]): r["best"] for r in got.collect()}
    for k, group in pdf.sort_values("i").groupby("k"):
        best = None
        for row in group.itertuples():
            assert have[(k, row.i)] == best
            if row.v > 1:
                best = row.v if best is None else max(best, row.v)


def test_nearest_fix_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    fixes = pd.DataFrame({"flight_id": rng.integers(0, 4, 400), "seq": range(400), "ts_s": np.round(rng.uniform(0, 5000, 400), 0)})
    fixes = fixes[fixes.flight_id != 3].assign(lat=1.0, lon=2.0, alt=3.0)
    poses = pd.DataFrame({"flight_id": rng.integers(0, 4, 300), "frame": range(300), "ts_s": np.round(rng.uniform(-500, 6000, 300) * 2) / 2})
    poses.loc[::13, "ts_s"] = np.nan
    sp = spark.createDataFrame(poses).withColumn("ts_s", F.nanvl("ts_s", F.lit(None)))
    for width in (7.0, 100.0, 1e6):
        got = {r["frame"]: r for r in timesync.nearest_fix(sp, spark.createDataFrame(fixes), 3.0, slice_seconds=width).collect()}
        assert len(got) == len(poses)
        for p in poses.itertuples():
            r = got[p.frame]
            own = fixes[fixes.flight_id == p.flight_id]
            if np.isnan(p.ts_s):
                assert r["unmatched_reason"] == "no_timestamp" and r["gps_seq"] is None
            elif own.empty:
                assert r["unmatched_reason"] == "no_gps"
            else:
                best = min((abs(f.ts_s - p.ts_s), f.ts_s, f.seq) for f in own.itertuples())
                assert (r["gps_seq"], r["time_diff_s"], r["matched"]) == (best[2], best[0], best[0] <= 3.0)


def test_sync_literals(spark):
    fixes = spark.createDataFrame([("f", i, 100.0 + i, 1.0, 2.0, 3.0) for i in range(3)], "flight_id string, seq bigint, ts_s double, lat double, lon double, alt double")
    poses = spark.createDataFrame([("f", "f0", 100.0), ("f", "f1", 101.1), ("f", "f2", 105.0)], "flight_id string, frame_id string, ts_s double")
    synced = timesync.nearest_fix(poses, fixes, 0.5)
    s = timesync.sync_summary(synced, fixes).first()
    assert (s["matched_poses"], s["unmatched_poses"], s["unmatched_gps"]) == (2, 1, 1)
    assert [r["frame_id"] for r in timesync.unmatched_poses(synced).collect()] == ["f2"]
    assert [r["seq"] for r in timesync.unused_fixes(synced, fixes).collect()] == [2]


def test_frame_times(spark):
    poses = spark.createDataFrame(
        [("f", "a", "a.jpg", "5"), ("f", "b", "b.jpg", "6"), ("f", "c", "img_1725712345.5.jpg", None), ("f", "d", "d.jpg", "soon")],
        "flight_id string, frame_id string, image_name string, raw_time string")
    lookup = spark.createDataFrame([("f", "a", 1.0), ("f", "a.jpg", 2.0), ("f", "b.jpg", 3.0)], "flight_id string, name string, ts_s double")
    got = {r["frame_id"]: r["ts_s"] for r in timesync.frame_times(poses, lookup).collect()}
    assert got == {"a": 1.0, "b": 3.0, "c": 1725712345.5, "d": None}


def test_dedupe_chunks_equal_one_scan(spark):
    rng = np.random.default_rng(9)
    walk = np.cumsum(rng.normal(size=(900, 16)) * 0.4, axis=0)
    walk[300:420] = walk[300]  # a long stretch of copies that spans several chunks
    pdf = pd.DataFrame({"video_id": np.where(np.arange(900) < 700, 1, 2), "source_idx": np.arange(900) * 3, "hist": list(walk)})
    df = spark.createDataFrame(pdf, "video_id bigint, source_idx bigint, hist array<double>")
    whole = rows(frames.drop_near_duplicates(df, 0.9), "video_id", "source_idx", "is_duplicate")
    cut = rows(frames.drop_near_duplicates(df, 0.9, chunk_frames=40), "video_id", "source_idx", "is_duplicate")
    assert whole == cut and 0 < sum(r[2] for r in whole) < 900
    for video, group in pdf.groupby("video_id"):
        last, flags = None, {}
        for r in group.itertuples():
            same = last is not None and np.corrcoef(last, r.hist)[0, 1] > 0.9
            flags[r.source_idx] = same
            last = last if same else r.hist
        assert flags == {i: d for v, i, d in whole if v == video}
