"""Streams fed in several batches against the batch operators."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.operators import frames, timesync
from plumbline.streaming import changelog, sync, voxel
from plumbline.streaming.frames import dedupe_stream

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture(autouse=True)
def rocksdb(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def feed(spark, batches, path, schema):
    """A file stream that takes one batch per trigger, in order."""
    import os

    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/b{i}")
        for name in os.listdir(f"{path}/b{i}"):
            os.utime(f"{path}/b{i}/{name}", (1000 + i, 1000 + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path)


def drain(stream, mode, path, each=None):
    writer = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{path}/check")
    query = writer.foreachBatch(each).start() if each else writer.format("parquet").option("path", f"{path}/out").start()
    query.awaitTermination()
    return query


CELL = ["vx", "vy", "vz"]


def test_voxel_change_log(spark, tmp_path):
    """Seven batches, merged on the way: each writes changed cells only, the newest versions are the batch result."""
    rng = np.random.default_rng(0)
    rows = [tuple(map(float, r)) for r in rng.uniform(0, 4, (300, 3))]
    schema = "x double, y double, z double"
    parts = [rows[:100], *[rows[i: i + 30] for i in range(100, 250, 30)], rows[250:]]
    sums = voxel.voxel_sums(feed(spark, parts, str(tmp_path / "in"), schema), 1.0)
    target, written = str(tmp_path / "grid"), []
    write = changelog.change_log(target, CELL, every=2)

    def each(changed, batch):
        write(changed, batch)
        written.append({tuple(r) for r in spark.read.parquet(f"{target}/log/batch_id={batch}").select(*CELL).collect()})
        write(changed, batch)  # a retry changes nothing

    drain(sums, "update", str(tmp_path), each)
    cells = lambda part: {tuple(int(v // 1) for v in r) for r in part}
    assert written[: len(parts)] == [cells(p) for p in parts] and not any(written[len(parts):])
    assert changelog._numbered(target, "marks") and len(changelog._numbered(target, "base")) <= 2
    assert len(changelog._numbered(target, "log")) < len(parts)
    live = voxel.means(changelog.current(spark, target, sums.schema, CELL))
    batch = voxel.means(voxel.voxel_sums(spark.createDataFrame(rows, schema), 1.0))
    columns = [*CELL, "merged_points", "x", "y", "z"]
    a, b = (np.array(sorted(map(tuple, df.select(*columns).collect()))) for df in (live, batch))
    assert np.allclose(a, b)


def test_change_log_merges(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "k long, v string"
    frame = lambda *rows: spark.createDataFrame(list(rows), schema)
    write = changelog.change_log(path, ["k"], every=100)
    kind = frame((1, "a")).schema
    read = lambda: {r.k: r.v for r in changelog.current(spark, path, kind, ["k"]).collect()}
    assert read() == {} and not changelog.compact(spark, path, kind, ["k"])
    write(frame((1, "a"), (2, "b"), (None, "n")), 0)
    write(frame((2, "c")), 1)
    assert read() == {1: "a", 2: "c", None: "n"}
    assert changelog.compact(spark, path, kind, ["k"]) and not changelog.compact(spark, path, kind, ["k"])
    assert read() == {1: "a", 2: "c", None: "n"} and changelog._numbered(path, "log") == [0, 1]
    write(frame((1, None)), 2)
    # a base without its mark, as an interrupted merge leaves it, is not read
    frame((1, "broken")).withColumn("_version", F.lit(9)).write.parquet(f"{path}/base/batch_id=2")
    assert read() == {1: None, 2: "c", None: "n"}
    assert changelog.compact(spark, path, kind, ["k"]) and changelog._numbered(path, "log") == [2]
    assert read() == {1: None, 2: "c", None: "n"}


FRAME = "video_id bigint, source_idx bigint, hist array<double>, event_time timestamp"


def video(count, seed=1):
    """Frames of two videos, two a second."""
    walk = np.cumsum(np.random.default_rng(seed).normal(size=(count, 8)) * 0.5, axis=0)
    return [(i % 2, i, walk[i].tolist(), pd.Timestamp(1000 + i / 2, unit="s").to_pydatetime()) for i in range(count)]


def end_of(seconds, source_idx=0):
    return (-1, source_idx, [0.0] * 8, pd.Timestamp(seconds, unit="s").to_pydatetime())


def flags(df):
    return sorted(map(tuple, df.filter("video_id >= 0").select("video_id", "source_idx", "is_duplicate").collect()))


def test_dedupe_out_of_order(spark, tmp_path):
    """Frames shuffled over batches, and one that comes twice, give the result of one scan in order."""
    rows = video(120)
    batch = frames.drop_near_duplicates(spark.createDataFrame(rows, FRAME), 0.8)
    want = flags(batch)
    # each block of 20 frames (10 s) is shuffled, and some of a block come one batch later
    draw = np.random.default_rng(3)
    mixed = [rows[i: i + 20] for i in range(0, 120, 20)]
    mixed = [[block[k] for k in draw.permutation(len(block))] for block in mixed]
    parts = [block[:14] + (mixed[n - 1][14:] if n else []) for n, block in enumerate(mixed)] + [[*mixed[-1][14:], rows[119]], [end_of(10**6)]]
    stream = feed(spark, parts, str(tmp_path / "in"), FRAME)
    drain(dedupe_stream(stream, 0.8, "30 seconds"), "append", str(tmp_path / "all"))
    assert flags(spark.read.parquet(str(tmp_path / "all/out"))) == want
    drain(dedupe_stream(stream, 0.8, "30 seconds", limit=6), "append", str(tmp_path / "few"))
    budget = frames.within_budget(batch.withColumn("accepted", ~F.col("is_duplicate")), 4)
    assert flags(spark.read.parquet(str(tmp_path / "few/out"))) == flags(budget)


def test_dedupe_forgets_quiet_videos(spark, tmp_path):
    """After the idle time the state is gone: the same frame is accepted again; before it, it is a duplicate."""
    one = [1.0, 5.0, 2.0, 4.0, 9.0, 0.0, 3.0, 7.0]
    at = lambda s: pd.Timestamp(s, unit="s").to_pydatetime()
    parts = [[(0, 0, one, at(1000))], [end_of(1100, 1)], [(0, 1, one, at(1150))], [end_of(3000, 2)], [(0, 2, one, at(3050))], [end_of(10**5, 3)],
             [end_of(10**6, 4)]]
    stream = feed(spark, parts, str(tmp_path / "in"), FRAME)
    want = [(0, 0, False), (0, 1, True), (0, 2, False)]
    query = drain(dedupe_stream(stream, 0.8, "10 seconds", idle_seconds=600), "append", str(tmp_path))
    assert flags(spark.read.parquet(str(tmp_path / "out"))) == want
    # one row each of the newest time and the last histogram per video; the far ends of the input close all but the last
    left = (query.lastProgress if isinstance(query.lastProgress, dict) else json.loads(query.lastProgress.json))["stateOperators"][0]["numRowsTotal"]
    assert left <= 3
    once = feed(spark, [sum(parts[:-2], []), *parts[-2:]], str(tmp_path / "once"), FRAME)
    drain(dedupe_stream(once, 0.8, "10 seconds", idle_seconds=600), "append", str(tmp_path / "o"))
    assert flags(spark.read.parquet(str(tmp_path / "o/out"))) == want


def test_dedupe_keeps_frames_in_pieces(spark, tmp_path):
    """Two batches whose frames alternate, more than a piece holds: decided as by one scan, from few rows of state."""
    rows = video(3000)
    batch = frames.drop_near_duplicates(spark.createDataFrame(rows, FRAME), 0.8)
    parts = [rows[0:2800:4] + rows[1:2800:4], rows[2:2800:4] + rows[3:2800:4] + rows[5:6], rows[2800:], [end_of(10**6)]]
    query = drain(dedupe_stream(feed(spark, parts, str(tmp_path / "in"), FRAME), 0.8, "2 hours"), "append", str(tmp_path))
    assert flags(spark.read.parquet(str(tmp_path / "out"))) == flags(batch)
    progress = [p if isinstance(p, dict) else json.loads(p.json) for p in query.recentProgress]
    assert 0 < max(op["numRowsTotal"] for p in progress for op in p["stateOperators"]) < 50


def test_sync_in_batches_counts_late_rows(spark, tmp_path):
    rng = np.random.default_rng(2)
    at = np.sort(rng.uniform(0, 400, 200)).round(1)
    rows = [(1, "pose" if i % 3 == 0 else "gps", i, float(t), pd.Timestamp(t, unit="s").to_pydatetime()) for i, t in enumerate(at)]
    late = (1, "gps", 999, 1.0, pd.Timestamp(1, unit="s").to_pydatetime())
    end = (1, "end", -1, 0.0, pd.Timestamp("2030-01-01").to_pydatetime())
    schema = "flight_id bigint, side string, row_id bigint, ts_s double, event_time timestamp"
    stream = feed(spark, [rows[:80], rows[80:160], [*rows[160:], late], [end]], str(tmp_path / "in"), schema)
    query = drain(sync.nearest_fix_stream(stream, 1.0, "5 seconds"), "append", str(tmp_path))
    got = {r["pose_id"]: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    poses = spark.createDataFrame([(1, r[2], r[3]) for r in rows if r[1] == "pose"], "flight_id bigint, pose_id bigint, ts_s double")
    fixes = spark.createDataFrame([(1, r[2], r[3], 0.0, 0.0, 0.0) for r in rows if r[1] == "gps"],
                                  "flight_id bigint, seq bigint, ts_s double, lat double, lon double, alt double")
    for w in timesync.nearest_fix(poses, fixes, 1.0).collect():
        r = got.pop(w["pose_id"])
        assert r["matched"] == w["matched"]
        if w["matched"]:
            assert (r["gps_seq"], r["time_diff_s"]) == (w["gps_seq"], pytest.approx(w["time_diff_s"]))
    assert not got
    assert sync.dropped_rows([p if isinstance(p, dict) else json.loads(p.json) for p in query.recentProgress]) >= 1


def test_sync_keeps_state_by_slice_not_by_flight(spark, tmp_path):
    moment = lambda t: pd.Timestamp(t, unit="s").to_pydatetime()
    rows = [(f, side, f, float(t), moment(t)) for f in range(300) for side, t in (("pose", 4), ("gps", 4 + f % 3))]
    stray = (None, "pose", 900, 4.0, moment(4))
    end = (1, "end", -1, 0.0, moment(4e9))
    schema = "flight_id bigint, side string, row_id bigint, ts_s double, event_time timestamp"
    stream = feed(spark, [[*rows, stray], [end]], str(tmp_path / "in"), schema)
    query = drain(sync.nearest_fix_stream(stream, 1.0, "5 seconds"), "append", str(tmp_path))
    got = sorted((r["pose_id"], r["flight_id"], r["gps_seq"], r["time_diff_s"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(f, f, f if f % 3 < 2 else None, float(f % 3) if f % 3 < 2 else None) for f in range(300)] + [(900, None, None, None)]
    progress = [p if isinstance(p, dict) else json.loads(p.json) for p in query.recentProgress]
    pieces = max(op["numRowsTotal"] for p in progress for op in p["stateOperators"])
    assert 0 < pieces < 400
