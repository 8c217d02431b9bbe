"""Readers and writers on files made here."""

import json
import os
import struct

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.operators import splats
from plumbline.operators.gps import metadata, quarantine, valid_fixes
from plumbline.params import FrameGate
from plumbline.plans import frame_selection
from plumbline.sinks import documents, sfm_text
from plumbline.sinks.sfm_binary import write_binary
from plumbline.sources import clouds as cloud_files
from plumbline.sources import documents as docs
from plumbline.sources import gps_csv, images, ply
from plumbline.sources import sfm_binary
from plumbline.sources import sfm_model as sfm
from plumbline.sources.files import open_binary


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(path)


def test_gps_csv(spark, tmp_path):
    put(tmp_path / "a.csv", "﻿timestamp,latitude,longitude,altitude\n1725700000.0,12.971598,77.594562,920.5\n\n1725700000.0,12.9716,77.5946,921\n1725700002,12.9717,\"77.5947\",922\n")
    put(tmp_path / "b.csv", "Alt, LON ,lat,Time\n1,2,95.0,5\n1,-195,3,6\n1,2,3,\n1,2\nx,2,3,7\n4,2,3,2026-09-07T12:00:00Z\n")
    put(tmp_path / "c.csv", "timestamp,latitude,altitude\n1,2,3\n")
    put(tmp_path / "d.csv", "t,y,x,z\n1,95,0,0\n")
    checked, bad = gps_csv.read_gps_csv(spark, str(tmp_path))
    meta = {r["flight_id"]: r for r in metadata(checked).collect()}
    assert (meta["a"]["valid_rows"], meta["a"]["duplicate_timestamps"], meta["a"]["duration_seconds"]) == (3, 1, 2.0)
    assert (meta["b"]["valid_rows"], meta["b"]["missing_rows"], meta["b"]["error_rows"]) == (1, 1, 4)
    assert meta["d"]["status"] == "FAILED"
    reasons = [r["reject_reason"] for r in quarantine(checked).filter("flight_id = 'b'").orderBy("seq").collect()]
    assert reasons == ["latitude_range", "longitude_range", "missing", "incomplete", "bad_altitude"]
    assert [r["ts_s"] for r in valid_fixes(checked).filter("flight_id = 'b'").collect()] == [1788782400.0]
    errors = bad.collect()
    assert len(errors) == 1 and "longitude" in errors[0]["file_error"]


def test_imu(spark, tmp_path):
    put(tmp_path / "a.json", json.dumps({"records": [{"t": 1}, {"t": 2}]}))
    put(tmp_path / "b.json", "[{\"t\": 1}]")
    put(tmp_path / "c.json", "{broken")
    put(tmp_path / "d.csv", "t,gx\n1,2\n2,3\n3,4\n")
    flights = spark.createDataFrame([(f,) for f in "abcde"], "flight_id string")
    got = {r["flight_id"]: (r["imu_available"], r["total_records"]) for r in gps_csv.imu_availability(spark, str(tmp_path), flights).collect()}
    assert got == {"a": (True, 2), "b": (True, 1), "c": (False, None), "d": (True, 3), "e": (False, None)}


def test_pose_detection_log_alignment_documents(spark, tmp_path):
    put(tmp_path / "p/f1/cameras.json", json.dumps([
        {"frame_id": "a", "image_name": "a.jpg", "position": [1, 2, 3], "rotation_quaternion": [1, 0, 0, 0], "timestamp": 5.5},
        {"frame_id": "b", "image_name": "b.jpg", "position": [1, 2, 3], "rotation": [[1, 0, 0], [0, 1, 0], [0, 0, 1]], "intrinsics": {"fl_x": 9}},
        {"frame_id": "c", "image_name": "c.jpg"}]))
    put(tmp_path / "p/f2/cameras.json", "{nope")
    poses = docs.read_poses(spark, str(tmp_path / "p"))
    rows = {r["frame_id"]: r for r in poses.filter("flight_id = 'f1'").collect()}
    assert (rows["a"]["x"], rows["a"]["qw"], rows["a"]["raw_time"], rows["b"]["fl_x"]) == (1.0, 1.0, "5.5", 9.0)
    assert rows["b"]["r"][1] == [0.0, 1.0, 0.0] and rows["c"]["pose_error"] == "pose has no position"
    wanted = spark.createDataFrame([("f1",), ("f2",)], "flight_id string")
    assert [r[0] for r in docs.flights_without_poses(wanted, poses).collect()] == ["f2"]

    put(tmp_path / "d/v/x.json", json.dumps({"frame": "x.jpg", "frame_stem": "x", "detections": [{"class": "car", "confidence": 0.9, "bbox": [1, 2, 3, 4]}]}))
    det = docs.read_detections(spark, str(tmp_path / "d")).first()
    assert (det["video_id"], det["frame_id"], det["class"], det["x2"]) == ("v", "x", "car", 3.0)

    put(tmp_path / "l/v/metadata.json", json.dumps({"original_fps": 29.97, "total_frames": 359, "frames": [
        {"filename": "000000.jpg", "timestamp_sec": 0.0, "original_frame": 0, "laplacian_variance": 366.45}]}))
    log = docs.read_frame_logs(spark, str(tmp_path / "l")).first()
    assert (log["video_id"], log["filename"], log["total_frames"], log["laplacian_variance"]) == ("v", "000000.jpg", 359, 366.45)

    for folder in ("d", "l"):
        put(tmp_path / folder / "broken/metadata.json", '{"frames": [{')
    bad = docs.read_detections(spark, str(tmp_path / "d")).filter("detection_error IS NOT NULL").collect()
    assert [(r["video_id"], r["class"], r["x1"], r["confidence"]) for r in bad] == [("broken", None, None, None)] and "broken/metadata.json" in bad[0]["detection_error"]
    bad = docs.read_frame_logs(spark, str(tmp_path / "l")).filter("log_error IS NOT NULL").collect()
    assert [(r["video_id"], r["filename"]) for r in bad] == [("broken", None)] and "broken/metadata.json" in bad[0]["log_error"]

    good = {"alignment": {"scale": 2.0, "rotation_matrix": np.eye(3).tolist(), "translation_vector": [1, 2, 3]}, "target_crs": "EPSG:32643"}
    put(tmp_path / "a/one/metadata.json", json.dumps(good))
    put(tmp_path / "a/two/metadata.json", json.dumps({**good, "alignment": {**good["alignment"], "scale": -1}}))
    put(tmp_path / "a/three/metadata.json", json.dumps({"target_crs": "EPSG:1"}))
    got = {r["cloud_id"]: r["alignment_error"] for r in docs.read_alignments(spark, str(tmp_path / "a")).collect()}
    assert got == {"one": None, "two": "scale is not positive"}


IMAGES_TXT = "# comment\n\n1 1 0 0 0 0.5 0 0 1 frame 1.jpg\n10 20 7 30 40 -1\n2 1 0 0 0 1 0 0 1 frame_2.jpg\n\n\n3 1 0 0 0 2 0 0 1 frame_3.jpg\n1 2 3\n4 1 0 0 0 2 0 0 1 frame_4.jpg\n"


@pytest.mark.parametrize("hot", [None, 2])
def test_image_text(spark, tmp_path, hot):
    put(tmp_path / "m/images.txt", IMAGES_TXT)
    rows = {r["image_id"]: r for r in sfm.read_images_text(spark, str(tmp_path / "m/images.txt"), hot).collect()}
    assert {i: (r["name"], len(r["observations"])) for i, r in rows.items()} == {
        1: ("frame 1.jpg", 2), 2: ("frame_2.jpg", 0), 3: ("frame_3.jpg", 1), 4: ("frame_4.jpg", 0)}
    assert rows[1]["observations"][1]["point3d_id"] == -1 and rows[1]["model_id"] == "m"


def test_camera_and_point_text(spark, tmp_path):
    put(tmp_path / "m/cameras.txt", "# c\n1 PINHOLE 1920 1080 1000 1000 960 540\n")
    cam = sfm.read_cameras_text(spark, str(tmp_path / "m/cameras.txt")).first()
    assert (cam["model"], cam["width"], list(cam["params"])) == ("PINHOLE", 1920, [1000.0, 1000.0, 960.0, 540.0])
    put(tmp_path / "m/points3D.txt", "# p\n1 0 0 0 255 0 0 0.5 1 2 3 4\n2 1 1 1 0 255 0 0.1\n3 x 1 1 0 0 0 0\n4 nan 0 0 1 1 1 0\n5 1 1 1 300 0 0 0\n6 1 1\n")
    good, bad = sfm.read_points_text(spark, str(tmp_path / "m/points3D.txt"))
    assert [r["point3d_id"] for r in good.orderBy("point3d_id").collect()] == [1, 2]
    assert [tuple(t) for t in good.filter("point3d_id = 1").first()["track"]] == [(1, 2), (3, 4)]
    assert [r["reject_reason"] for r in bad.orderBy("line_id").collect()] == [
        "not a number", "coordinate not finite", "colour outside 0..255", "fewer than 8 elements"]
    with pytest.raises(ValueError):
        sfm.read_points_text(spark, str(tmp_path / "m/points3D.txt"), strict=True)


def binary_model(folder):
    put(folder / "cameras.bin", struct.pack("<Q", 1) + struct.pack("<iiQQ4d", 1, 1, 1920, 1080, 1000, 1000, 960, 540))
    image = struct.pack("<I7dI", 5, 1, 0, 0, 0, 0.5, 0, 0, 1) + b"frame_5.jpg\0" + struct.pack("<Q", 2)
    image += struct.pack("<ddQ", 10, 20, 7) + struct.pack("<ddQ", 30, 40, 2**64 - 1)
    put(folder / "images.bin", struct.pack("<Q", 1) + image)
    point = lambda i, x: struct.pack("<Q3d3BdQ", i, x, 2, 3, 255, 128, 0, 0.25, 1) + struct.pack("<II", 5, 0)
    put(folder / "points3D.bin", struct.pack("<Q", 2) + point(7, 1.0) + point(8, 1.5))


def test_binary_model(spark, tmp_path):
    binary_model(tmp_path / "0")
    cam = sfm.read_cameras_binary(spark, str(tmp_path / "0/cameras.bin")).first()
    assert (cam["model_id"], cam["model"], cam["height"], list(cam["params"])) == ("0", "PINHOLE", 1080, [1000.0, 1000.0, 960.0, 540.0])
    img = sfm.read_images_binary(spark, str(tmp_path / "0/images.bin"))
    assert img.first()["name"] == "frame_5.jpg"
    assert [(r["point2d_idx"], r["px"], r["point3d_id"]) for r in sfm.observations(img).collect()] == [(0, 10.0, 7), (1, 30.0, -1)]
    points = sfm.read_points_binary(spark, str(tmp_path / "0/points3D.bin")).orderBy("point3d_id").collect()
    assert [(p["x"], p["r"], p["track"][0]["image_id"]) for p in points] == [(1.0, 255, 5), (1.5, 255, 5)]
    counts = {r["name"]: r["records"] for r in sfm.header_counts(spark, str(tmp_path)).collect()}
    assert counts == {"cameras": 1, "images": 1, "points3D": 2}


def test_broken_binary_is_a_row(spark, tmp_path):
    put(tmp_path / "m/cameras.bin", struct.pack("<Q", 1) + struct.pack("<iiQQ", 1, 99, 1, 1))
    put(tmp_path / "n/points3D.bin", struct.pack("<Q", 5) + b"\0" * 20)
    assert "KeyError" in sfm.read_cameras_binary(spark, str(tmp_path / "m/cameras.bin")).first()["file_error"]
    assert sfm.read_points_binary(spark, str(tmp_path / "n/points3D.bin")).first()["file_error"]


def points_file(count, size, bad=()):
    """``count`` points with tracks of ``size`` entries; those in ``bad`` have no finite place."""
    point = lambda i: struct.pack("<Q3d3BdQ", i, float("nan") if i in bad else i, 0, 0, 1, 2, 3, 0.5, size) + struct.pack("<II", i, 7) * size
    return struct.pack("<Q", count) + b"".join(map(point, range(count)))


def test_binary_file_is_read_in_ranges(spark, tmp_path):
    put(tmp_path / "m/points3D.bin", points_file(1000, 3, bad={17, 900}))
    path = str(tmp_path / "m/points3D.bin")
    record = 51 + 8 * 3
    ranges = sfm_binary.record_ranges(spark, path, sfm_binary.POINTS, 10 * record).orderBy("begin").collect()
    assert len(ranges) == 100 and {r["records"] for r in ranges} == {10}
    assert [r["begin"] for r in ranges] == [8 + 10 * record * i for i in range(100)]
    back = sfm.read_points_binary(spark, path, 10 * record)
    assert back.select(F.spark_partition_id().alias("p")).distinct().count() > 20
    rows = back.filter("file_error IS NULL").orderBy("point3d_id").collect()
    assert [r["point3d_id"] for r in rows] == [i for i in range(1000) if i not in (17, 900)]
    assert all(r["x"] == r["point3d_id"] and [tuple(t) for t in r["track"]] == [(r["point3d_id"], 7)] * 3 for r in rows)
    # a bad point is one row; the points around it stay
    faults = [r["file_error"] for r in back.filter("file_error IS NOT NULL").collect()]
    assert sorted(f.split("point ")[1] for f in faults) == ["17 is not finite", "900 is not finite"]


def test_small_ranges_share_tasks(spark, tmp_path):
    """More ranges do not make more tasks than four for each partition of a shuffle."""
    put(tmp_path / "m/points3D.bin", points_file(1000, 3))
    back = sfm.read_points_binary(spark, str(tmp_path), 75)
    assert back.rdd.getNumPartitions() <= 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert back.select("point3d_id").distinct().count() == 1000


def test_index_reads_lengths_only(tmp_path):
    path = put(tmp_path / "points3D.bin", points_file(40, 200_000))
    read = 0

    class Counting:
        def __init__(self, file):
            self.file = file

        def __getattr__(self, name):
            return getattr(self.file, name)

        def read(self, n):
            nonlocal read
            data = self.file.read(n)
            read += len(data)
            return data

    with open_binary(path) as f:
        window, at = sfm_binary.Window(Counting(f), 4096), 8
        for _ in range(40):
            at = sfm_binary.POINTS.tail(window, at)[1]
    assert at == os.path.getsize(path) and read <= 40 * 4096


def test_binary_file_cut_short(spark, tmp_path):
    whole = points_file(50, 2)
    put(tmp_path / "a/points3D.bin", whole[:-5])
    put(tmp_path / "b/points3D.bin", whole + b"rest")
    put(tmp_path / "c/points3D.bin", struct.pack("<Q", 0))
    put(tmp_path / "d/points3D.bin", b"")
    put(tmp_path / "e/points3D.bin", struct.pack("<Q", 2**63))
    rows = sfm.read_points_binary(spark, str(tmp_path), 500).groupBy("model_id").agg(
        F.count("point3d_id").alias("n"), F.count("file_error").alias("bad")).collect()
    assert {r["model_id"]: (r["n"], r["bad"]) for r in rows} == {"a": (49, 1), "b": (50, 0), "e": (0, 1)}


def test_binary_writer(spark, tmp_path):
    images = spark.createDataFrame(
        [(m, i, *[float(k + i) for k in range(7)], 1, f"bild_{i}_ä.jpg", [(1.5, 2.5, -1)] * i if i else None) for m in ("u", "v") for i in range(5)],
        sfm_binary.IMAGES.schema)
    path = str(tmp_path / "out")
    assert write_binary(images, "images", path, file_rows=2) == 10
    assert not [n for _, _, names in os.walk(path) for n in names if n.startswith(".") and not n.endswith(".crc")]
    back = sfm.read_images_binary(spark, f"{path}/images", 100)
    key = F.regexp_replace("model_id", "^model_id=", "").alias("model_id")
    want = images.withColumn("observations", F.coalesce("observations", F.expr("array()")))
    assert sorted(map(str, back.select(key, *images.columns[1:]).collect())) == sorted(map(str, want.collect()))
    with pytest.raises(FileExistsError):
        write_binary(images, "images", path)


def test_model_discovery(spark, tmp_path):
    binary_model(tmp_path / "r1/1")
    binary_model(tmp_path / "r1/0")
    put(tmp_path / "r1/0/cameras.txt", "x")
    for part in ("cameras", "images", "points3D"):
        put(tmp_path / f"r2/{part}.txt", "# x")
    binary_model(tmp_path / "r2/0")
    put(tmp_path / "r3/0/cameras.bin", b"")
    roots = [str(tmp_path / r) for r in ("r1", "r2", "r3")]
    got = {r["root"]: (r["folder"], r["format"]) for r in sfm.find_models(spark, roots).collect()}
    assert got == {roots[0]: (f"{roots[0]}/0", "binary"), roots[1]: (roots[1], "text")}


@pytest.mark.parametrize("encoding", ["binary", "ascii"])
def test_ply_round_trip(spark, tmp_path, encoding):
    ply.register(spark)
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame(np.round(rng.uniform(-50, 50, (500, 3)), 6), columns=list("xyz")).assign(cloud_id="c", r=1, g=200, b=255)
    df = spark.createDataFrame(pdf).select("cloud_id", "x", "y", "z", *[F.col(c).cast("smallint").alias(c) for c in "rgb"])
    out = str(tmp_path / "c")
    df.repartition(3).write.format("ply").option("encoding", encoding).option("maxRows", 100).mode("overwrite").save(out)
    back = spark.read.format("ply").option("splitBytes", 1000).load(out)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    assert back.rdd.getNumPartitions() > 6
    with pytest.raises(Exception):
        df.filter("false").write.format("ply").mode("overwrite").save(str(tmp_path / "none"))


def test_ply_headers_and_splats(spark, tmp_path):
    names = ["x", "y", "z", "opacity", "scale_0", "scale_1", "scale_2", "rot_0", "rot_1", "rot_2", "rot_3", "f_dc_0", "f_dc_1", "f_dc_2"]
    head = lambda n, props: "ply\nformat binary_little_endian 1.0\nelement vertex %d\n%send_header\n" % (n, "".join(f"property float {p}\n" for p in props))
    for name, text in {"full": head(9, names), "cloud": head(3, "xyz"), "empty": head(0, names), "odd": head(3, "xy"), "text": "hello"}.items():
        put(tmp_path / f"{name}.ply", text)
    got = {r["file"].split("/")[-1][:-4]: r["status"] for r in splats.check_splats(ply.read_headers(spark, str(tmp_path))).collect()}
    assert got == {"full": "PASS", "cloud": "WARNING", "empty": "FAIL", "odd": "FAIL", "text": "FAIL"}


def test_cloud_loader(spark, tmp_path):
    line = "1 1 2 3 255 0 0 0.5\n"
    put(tmp_path / "a/sparse/points3D.txt", line)
    put(tmp_path / "a/points3D.txt", line * 2)
    binary_model(tmp_path / "b")
    ply.register(spark)
    one = spark.createDataFrame([("x", 1.0, 1.0, 1.0)], "cloud_id string, x double, y double, z double")
    one.write.format("ply").mode("overwrite").save(str(tmp_path / "made"))
    put(tmp_path / "c/pointcloud.ply", next((tmp_path / "made").glob("*.ply")).read_bytes())
    fit = spark.createDataFrame([("a", 2.0, np.eye(3).tolist(), [10.0, 0.0, 0.0], "EPSG:32643", None)], "cloud_id string, scale double, r array<array<double>>, t array<double>, target_crs string, alignment_error string")
    points, meta = cloud_files.load_clouds(spark, [str(tmp_path / c) for c in "abc"], fit)
    xs = {}
    for r in points.collect():
        xs.setdefault(r["cloud_id"], []).append(r["x"])
    assert {c: sorted(v) for c, v in xs.items()} == {"a": [12.0], "b": [1.0, 1.5], "c": [1.0]}
    m = {r["cloud_id"]: r for r in meta.collect()}
    assert m["a"]["is_georeferenced"] and m["a"]["crs"] == "EPSG:32643" and not m["b"]["is_georeferenced"] and m["c"]["source_method"] == "ply"


def bmp(pixels):
    """24-bit BMP of blue-green-red rows."""
    h, w, _ = pixels.shape
    row = b"\0" * ((-3 * w) % 4)
    body = b"".join(line.astype(np.uint8).tobytes() + row for line in pixels[::-1])
    return struct.pack("<2sIHHI", b"BM", 54 + len(body), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, len(body), 2835, 2835, 0, 0) + body


def pictures(folder):
    rng = np.random.default_rng(0)
    for i in range(25):
        put(folder / f"img_{i:03d}.bmp", bmp(rng.integers(40, 200, (24, 32, 3)) * np.array([1, (i % 5) / 5 + 0.2, (i % 7) / 7 + 0.1])))
    put(folder / "img_025.bmp", (folder / "img_024.bmp").read_bytes())
    put(folder / "img_026.bmp", bmp(np.zeros((24, 32, 3))))
    put(folder / "img_027.bmp", bmp(np.full((24, 32, 3), 255)))
    put(folder / "img_028.bmp", b"broken")


def test_image_gate(spark, tmp_path):
    pictures(tmp_path / "v")
    measured = frame_selection.measure_folder(spark, str(tmp_path))
    gate = FrameGate(blur_threshold=50, duplicate_threshold=0.999)
    out = frame_selection.select(measured, gate)
    s = out["summary"].first()
    assert s["input_frames"] == 29 and s["rejected_unreadable"] == 1 and s["rejected_too_dark"] == 1 and s["rejected_too_bright"] == 1
    assert s["rejected_duplicate"] >= 1
    manifest = {r["name"]: r for r in out["manifest"].collect()}
    assert manifest["img_025.bmp"]["rejection_reason"] == "duplicate" and manifest["img_028.bmp"]["frame_id"] == "unusable_000028"
    assert manifest["img_000.bmp"]["frame_id"] == "frame_000001"
    row = measured.filter("name = 'img_026.bmp'").first()
    assert (row["laplacian_variance"], row["mean_brightness"], row["width"]) == (0.0, 0.0, 32)
    kept = frame_selection.extract(measured, target=20, blur_threshold=50, similarity=0.9999, fps=10.0)
    assert kept.filter("source_idx = 1").count() <= 1 and kept.count() > 0


def test_image_lists(spark, tmp_path):
    put(tmp_path / "v/000010.jpg", b"x")
    put(tmp_path / "v/notes.txt", b"x")
    files = images.list_images(spark, str(tmp_path))
    assert [r["name"] for r in files.collect()] == ["000010.jpg"]
    log = images.frame_log_from_names(files, 4.0).first()
    assert (log["original_frame"], log["timestamp_sec"]) == (10, 2.5)


def read_parts(folder):
    return "\n".join(p.read_text() for p in sorted(folder.glob("part-*"))).replace("\n\n", "\n")


def test_geojson_document(spark, tmp_path):
    feature = lambda i: json.dumps({"type": "Feature", "geometry": {"type": "Point", "coordinates": [i, i, i]}, "properties": {"frame_id": f"f{i}"}})
    df = spark.createDataFrame(
        [("a", f"f{i}", f"n{i}", [float(i)] * 3, feature(i)) for i in range(5)] + [("b", "f0", "n0", [0.0] * 3, feature(0))],
        "flight_id string, frame_id string, image_name string, coordinates array<double>, feature string")
    documents.write_geojson(df, str(tmp_path / "g"))
    a = json.loads(read_parts(tmp_path / "g/flight_id=a"))
    assert [f["geometry"]["type"] for f in a["features"]] == ["LineString"] + ["Point"] * 5
    assert a["features"][0]["geometry"]["coordinates"][4] == [4.0, 4.0, 4.0]
    assert len(json.loads(read_parts(tmp_path / "g/flight_id=b"))["features"]) == 1


def test_trajectory_document(spark, tmp_path):
    rows = spark.createDataFrame([("m", i, f"n{i}") for i in range(1, 4)], "model_id string, pos bigint, image_name string")
    head = spark.createDataFrame([("m", "local")], "model_id string, cs string").select("model_id", F.struct("cs").alias("head"))
    documents.write_trajectory(rows, str(tmp_path / "t"), "model_id", head)
    doc = json.loads(read_parts(tmp_path / "t/model_id=m"))
    assert doc["cs"] == "local" and [f["image_name"] for f in doc["frames"]] == ["n1", "n2", "n3"]


def test_model_text_round_trip(spark, tmp_path):
    cameras = spark.createDataFrame([("m", 1, "PINHOLE", 640, 480, [1.0, 2.0, 3.0, 4.0])], "model_id string, camera_id bigint, model string, width bigint, height bigint, params array<double>")
    imgs = spark.createDataFrame([("m", i, 1.0, 0.0, 0.0, 0.0, 0.5, 0.25, 0.0, 1, f"n{i}.jpg") for i in (1, 2)],
                                 "model_id string, image_id bigint, qw double, qx double, qy double, qz double, tx double, ty double, tz double, camera_id bigint, name string")
    pts = spark.createDataFrame([("m", 1, 1.5, 2.5, 3.5)], "model_id string, point3d_id bigint, x double, y double, z double")
    sfm_text.write_model(cameras, imgs, pts, str(tmp_path / "out"))
    put(tmp_path / "back/m/images.txt", "\n".join(p.read_text() for p in sorted((tmp_path / "out/images/model_id=m").glob("part-*"))))
    back = sfm.read_images_text(spark, str(tmp_path / "back/m/images.txt")).orderBy("image_id").collect()
    assert [(r["name"], r["tx"], r["observations"]) for r in back] == [("n1.jpg", 0.5, []), ("n2.jpg", 0.5, [])]
    text = "".join(p.read_text() for p in (tmp_path / "out/points3D/model_id=m").glob("part-*"))
    assert text.strip() == "1 1.500000 2.500000 3.500000 128 128 128 0.0"


def test_equal_folder_names_stay_apart(spark, tmp_path):
    for run in "AB":
        put(tmp_path / run / "sparse/0/cameras.txt", f"{ord(run)} PINHOLE 10 10 1 1 5 5\n")
        put(tmp_path / run / "log.csv", "timestamp,lat,lon,alt\n1.0,2.0,3.0,4.0\n")
    cameras = sfm.read_cameras_text(spark, f"{tmp_path}/*/sparse/*/cameras.txt").collect()
    assert {(r["model_id"], r["camera_id"]) for r in cameras} == {("A/sparse/0", 65), ("B/sparse/0", 66)}
    assert {r["model_id"] for r in sfm.read_cameras_text(spark, f"file://{tmp_path}/A/sparse").collect()} == {"0"}
    checked, _ = gps_csv.read_gps_csv(spark, f"{tmp_path}/*/*.csv")
    assert {r["flight_id"] for r in checked.collect()} == {"A/log", "B/log"}


def test_long_tracks_and_parameters_are_whole(spark, tmp_path):
    put(tmp_path / "points3D.txt", "1 0 0 0 1 2 3 0.5 " + "4 5 " * 3000 + "\n")
    put(tmp_path / "cameras.txt", "1 PINHOLE 10 10 " + "1.5 " * 1500 + "\n")
    good, _ = sfm.read_points_text(spark, str(tmp_path / "points3D.txt"))
    assert len(good.first()["track"]) == 3000
    assert len(sfm.read_cameras_text(spark, str(tmp_path / "cameras.txt")).first()["params"]) == 1500


def test_ascii_mesh_and_short_file(spark, tmp_path):
    ply.register(spark)
    head = "ply\nformat ascii 1.0\nelement vertex {}\nproperty float x\nproperty float y\nproperty float z\n"
    put(tmp_path / "mesh.ply", head.format(3) + "element face 1\nproperty list uchar int v\nend_header\n0 0 0\n1 0 0\n0 1 0\n3 0 1 2\n")
    assert spark.read.format("ply").load(str(tmp_path / "mesh.ply")).count() == 3
    put(tmp_path / "short.ply", head.format(5) + "end_header\n0 0 0\n1 0 0\n0 1 0\n")
    with pytest.raises(Exception, match="2 vertices fewer"):
        spark.read.format("ply").load(str(tmp_path / "short.ply")).count()
    put(tmp_path / "h/long.ply", "ply\nformat ascii 1.0\n" + "comment x\n" * 20_000 + "element vertex 7\nproperty float opacity\nend_header\n")
    row = ply.read_headers(spark, str(tmp_path / "h")).first()
    assert (row["is_ply"], row["num_vertices"], row["properties"]) == (True, 7, ["opacity"])


def test_bad_cloud_lines_raise(spark, tmp_path):
    put(tmp_path / "a/points3D.txt", "1 0 0 0 1 2 3 0.5\n2 x 0 0 1 2 3 0.5\n3 0 0 0 1 2 3 0.5\n")
    with pytest.raises(ValueError, match="not a number"):
        cloud_files.load_clouds(spark, [str(tmp_path / "a")])
    assert cloud_files.load_clouds(spark, [str(tmp_path / "a")], strict=False)[0].count() == 2


def test_gps_csv_of_many_flights(spark, tmp_path):
    (tmp_path / "all.csv").write_text("flight_id,timestamp,latitude,longitude,altitude\nA,1,2,3,4\nB,2,3,4,5\n,3,4,5,6\n")
    (tmp_path / "own.csv").write_text("timestamp,latitude,longitude,altitude\n7,8,9,10\n")
    checked, bad = gps_csv.read_gps_csv(spark, str(tmp_path))
    got = sorted((r["flight_id"], r["ts_s"], r["lat"]) for r in checked.filter("reject_reason IS NULL").collect())
    assert got == [("A", 1.0, 2.0), ("B", 2.0, 3.0), ("all", 3.0, 4.0), ("own", 7.0, 8.0)]
    assert bad.isEmpty()


def test_image_lines_are_written_and_read_in_one_pass(spark, tmp_path, monkeypatch):
    """Rows are dealt by range before their lines are made, and the lines of a file are scanned for poses and points at once."""
    from plumbline.sinks import sfm_text
    from plumbline.sources import sfm_model

    made, lines = [], sfm_text.image_lines
    monkeypatch.setattr(sfm_text, "image_lines", lambda rows, key: made.append(rows._jdf.queryExecution().optimizedPlan().toString()) or lines(rows, key))
    seen = "array(named_struct('px', 1.5D, 'py', 2.5D, 'point3d_id', 7L), named_struct('px', 3D, 'py', 4D, 'point3d_id', -1L))"
    images = spark.range(20).selectExpr(
        "0L AS model_id", "id AS image_id", "1d AS qw", "0d AS qx", "0d AS qy", "0d AS qz", "0d AS tx", "0d AS ty", "0d AS tz",
        "id % 3 AS camera_id", "concat('a b ', id, '.jpg') AS name", f"IF(id % 4 = 0, NULL, {seen}) AS observations")
    cameras = spark.sql("SELECT 0L AS model_id, 1L AS camera_id, 'PINHOLE' AS model, 4 AS width, 3 AS height, array(1d) AS params")
    points = spark.sql("SELECT 0L AS model_id, 1L AS point3d_id, 0d AS x, 0d AS y, 0d AS z")
    sfm_text.write_model(cameras, images, points, str(tmp_path / "m"))
    assert len(made) == 1 and "RepartitionByExpression" in made[0]
    back = sfm_model.read_images_text(spark, str(tmp_path / "m" / "images"))
    # once for the poses with their points, once for the last blank line of each slice
    assert back._jdf.queryExecution().executedPlan().toString().count("FileScan text") == 2
    rows = {r["image_id"]: r for r in back.collect()}
    assert len(rows) == 20 and rows[5]["name"] == "a b 5.jpg" and rows[4]["observations"] == []
    assert [tuple(o) for o in rows[5]["observations"]] == [(1.5, 2.5, 7), (3.0, 4.0, -1)]
