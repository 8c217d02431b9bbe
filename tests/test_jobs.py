"""Jobs on small literal inputs."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.operators import attempts, dataset, frames, masks, pairs, runs, trajectory
from plumbline.params import Acceptance, CloudCleaning
from plumbline.plans import full_run, masking, pose_qa, selection, training_set
from plumbline.sinks import documents

IMAGE = "model_id string, image_id bigint, qw double, qx double, qy double, qz double, tx double, ty double, tz double, camera_id bigint, name string"


def model(spark, noise=0.0, frames_n=10):
    xyz = [(-1.0, -1.0, 10.0), (1.0, -1.0, 10.0), (-1.0, 1.0, 10.0), (1.0, 1.0, 10.0)]
    rng = np.random.default_rng(0)
    images, obs = [], []
    for i in range(frames_n):
        x = 0.5 * i
        images.append(("m", i + 1, 1.0, 0.0, 0.0, 0.0, -x, 0.0, 0.0, 1, f"frame_{i:06d}.jpg"))
        for k, (px, py, pz) in enumerate(xyz):
            dx, dy = rng.normal(size=2) * noise
            obs.append(("m", i + 1, k, float(1000 * (px - x) / pz + 960 + dx), float(1000 * py / pz + 540 + dy), k + 1))
        obs.append(("m", i + 1, 9, 0.0, 0.0, -1))
    cam = spark.createDataFrame([("m", 1, "PINHOLE", [1000.0, 1000.0, 960.0, 540.0])], "model_id string, camera_id bigint, model string, params array<double>")
    img = spark.createDataFrame(images, IMAGE)
    pts = spark.createDataFrame([("m", k + 1, *p) for k, p in enumerate(xyz)], "model_id string, point3d_id bigint, x double, y double, z double")
    o = spark.createDataFrame(obs, "model_id string, image_id bigint, point2d_idx int, px double, py double, point3d_id bigint")
    return cam, img, o, pts


def test_pose_qa(spark):
    good = pose_qa.validate_models(*model(spark)).first()
    assert good["validation_status"] == "PASS" and good["rmse_px"] < 1e-9 and good["mean_step"] == pytest.approx(0.5)
    assert good["observations_used"] == 40 and good["registration_rate"] == 1.0
    bad = pose_qa.validate_models(*model(spark, 5.0)).first()
    assert bad["validation_status"] == "FAIL" and bad["rmse_px"] > 1
    inputs = spark.createDataFrame([("m", i) for i in range(10)], "model_id string, i int")
    few = pose_qa.validate_models(*model(spark, frames_n=3), inputs=inputs).first()
    assert few["registration_rate"] == 0.3 and few["registration_check"] == "FAIL" and few["validation_status"] == "FAIL"
    cam, img, o, pts = model(spark)
    odd = pose_qa.validate_models(cam.withColumn("model", F.lit("FOV")), img, o, pts).first()
    assert odd["reprojection_status"] == "NOT_AVAILABLE" and odd["validation_status"] == "FAIL"
    report = pose_qa.reports(pose_qa.validate_models(cam, img, o, pts)).first()["report"]
    assert report["registration"]["status"] == "PASS"
    rows = pose_qa.trajectory_rows(img).orderBy("pos").collect()
    assert rows[2]["position"] == [1.0, 0.0, 0.0] and rows[2]["frame_id"] == "frame_000002"


def test_jumps(spark):
    values = lambda vs: spark.createDataFrame([("f", i, float(v)) for i, v in enumerate(vs)], "flight_id string, transition int, step double")
    flagged = lambda vs, limit=None, hot=None: [r["transition"] for r in trajectory.jump_flags(values(vs), "step", limit, hot=hot).collect()]
    assert flagged([0.5, 0.4, 0.6, 5.0, 0.5], 2.0) == [3]
    series = [0.5, 0.51, 0.49, 0.5, 0.52, 10.0, 0.5, 0.48]
    assert flagged(series) == [5] and flagged(series, hot=True) == [5]
    assert flagged([1.0] * 6 + [3.5]) == [6] and flagged([1.0] * 6 + [2.9]) == []


def test_order_without_numbers(spark):
    img = spark.createDataFrame([("f", 1, "b.jpg"), ("f", 2, "a10.jpg"), ("g", 1, "x10.jpg"), ("g", 2, "x9.jpg")], "flight_id string, image_id bigint, name string")
    got = [(r["flight_id"], r["name"]) for r in trajectory.frame_order(img).orderBy("flight_id", "pos").collect()]
    assert got == [("f", "a10.jpg"), ("f", "b.jpg"), ("g", "x9.jpg"), ("g", "x10.jpg")]


ATTEMPT = ("scene_id string, ord int, attempt_id bigint, method string, status string, registered_images bigint, registration_rate double, "
           "reprojection_status string, reprojection_rmse_px double, trajectory_status string, runtime_seconds double")


def tries(spark):
    ok = (20, 0.95, "AVAILABLE", 0.5, "PASS")
    none = (0, 0.0, "NOT_AVAILABLE", None, "NOT_AVAILABLE")
    return spark.createDataFrame([
        ("first", 1, 1, "fastmap", "PASS", *ok, 1.2), ("first", 2, 2, "vggt", "PASS", *ok, 9.0),
        ("second", 1, 3, "fastmap", "BLOCKED", *none, 1.0), ("second", 2, 4, "global_sfm", "PASS", *ok, 8.0),
        ("third", 1, 5, "fastmap", "BLOCKED", *none, 1.0), ("third", 2, 6, "global_sfm", "FAIL", *none, 3.0),
        ("third", 3, 7, "vggt", "PASS", 20, 0.9, "NOT_AVAILABLE", None, "AVAILABLE", 6.0),
        ("none", 1, 8, "fastmap", "FAIL", *none, 1.0), ("none", 2, 9, "vggt", "PASS", 20, 0.5, "AVAILABLE", 0.5, "PASS", 2.0),
    ], ATTEMPT)


def test_first_acceptable(spark):
    out = selection.select(tries(spark))
    got = {r["scene_id"]: (r["status"], r["selected_method"], r["cumulative_runtime"]) for r in out["selected"].collect()}
    assert got == {"first": ("PASS", "fastmap", 1.2), "second": ("PASS", "global_sfm", 9.0), "third": ("PASS", "vggt", 10.0), "none": ("FAIL", None, 3.0)}
    assert out["attempts"].count() == 8
    assert {r["reject_reason"] for r in out["failed"].collect()} == {"status FAIL", "registration rate too low"}
    strict = attempts.decide(tries(spark), Acceptance(rmse_px=0.1))
    assert strict.filter("accepted").count() == 1
    blocked = selection.select(tries(spark), spark.createDataFrame([("first", "PASS", None), ("none", "FAIL", "too few images")], "scene_id string, status string, reason string"))
    assert blocked["selected"].count() == 1 and "preflight: too few images" in {r["reject_reason"] for r in blocked["failed"].collect()}
    matrix = {(r["scene_id"], r["metric"]): r for r in selection.compare(tries(spark)).collect()}
    assert matrix[("second", "runtime_seconds")]["global_sfm"] == 8.0 and matrix[("second", "reprojection_rmse_px")]["fastmap"] is None
    table = spark.createDataFrame([("second", "fastmap", 1), ("second", "global_sfm", 2)], "scene_id string, method string, v int")
    assert [r["v"] for r in selection.winner_rows(out["selected"], table).collect()] == [2]


def test_masks(spark):
    frame = spark.createDataFrame([("v", "a", 160, 120), ("v", "b", 160, 120)], "video_id string, frame_id string, width int, height int")
    det = spark.createDataFrame([("v", "a", 0, "Car", 0.95, 20.0, 30.0, 80.0, 70.0), ("v", "a", 1, "bench", 0.85, 0.0, 0.0, 10.0, 10.0)],
                                "video_id string, frame_id string, det_no int, class string, confidence double, x1 double, y1 double, x2 double, y2 double")
    out = masking.mask(frame, det)
    s = out["summary"].first()
    assert (s["input_frames"], s["masked_frames"], s["total_detections"]) == (2, 1, 1)
    assert out["coverage"].filter("frame_id = 'a'").first()["coverage"] == 2400 / 19200
    assert out["runs"].filter("x1 <= 40 AND x2 > 40 AND y1 <= 40 AND y2 > 40").count() == 1
    assert masking.polarity(out["runs"], 0).first()["background"] == 255


def test_mask_union_equals_raster(spark):
    rng = np.random.default_rng(4)
    rows, want = [], {}
    for f in range(6):
        raster = np.zeros((40, 60), bool)
        for d in range(rng.integers(1, 12)):
            x1, y1 = rng.integers(-5, 55), rng.integers(-5, 35)
            x2, y2 = x1 + rng.integers(-2, 20), y1 + rng.integers(-2, 20)
            rows.append(("v", f"f{f}", int(d), "car", 1.0, x1 + 0.7, y1 + 0.2, x2 + 0.9, y2 + 0.4, 60, 40))
            cx1, cy1, cx2, cy2 = max(0, int(x1 + 0.7)), max(0, int(y1 + 0.2)), min(60, int(x2 + 0.9)), min(40, int(y2 + 0.4))
            if cx2 > cx1 and cy2 > cy1:
                raster[cy1:cy2, cx1:cx2] = True
        want[f"f{f}"] = int(raster.sum())
    rows = [tuple(float(v) if 5 <= i < 9 else v for i, v in enumerate(r)) for r in rows]
    det = spark.createDataFrame(rows, "video_id string, frame_id string, det_no int, class string, confidence double, x1 double, y1 double, x2 double, y2 double, width int, height int")
    frame = det.select("video_id", "frame_id", "width", "height").distinct()
    got = {r["frame_id"]: r["masked_pixels"] for r in masks.mask_coverage(frame, det).collect()}
    assert got == want


def test_detector_hook(spark):
    frame = spark.createDataFrame([(1, "a"), (1, "b")], "video_id bigint, frame_id string")

    def detector(batches):
        for b in batches:
            yield b.assign(**{"det_no": 0, "class": "car", "confidence": 0.9, "x1": 0.0, "y1": 0.0, "x2": 2.0, "y2": 2.0, "object_id": 7})

    assert masks.detect(frame, detector).filter("class = 'car' AND object_id = 7").count() == 2


def test_uniform_subset(spark):
    df = spark.createDataFrame([("v", f"n{i:02d}") for i in range(20)] + [("w", "a"), ("w", "b")], "video_id string, name string")
    got = frames.uniform_subset(df, 5, "video_id", [F.col("name")]).orderBy("video_id", "new_index").collect()
    assert [r["source_index"] for r in got if r["video_id"] == "v"] == list(np.round(np.linspace(0, 19, 5)).astype(int))
    assert [r["source_index"] for r in got if r["video_id"] == "w"] == [0, 1]
    single = frames.uniform_subset(df, 1, "video_id", [F.col("name")]).collect()
    assert sorted((r["video_id"], r["name"]) for r in single) == [("v", "n00"), ("w", "a")]


def test_pairs(spark):
    df = spark.createDataFrame([("v", i, f"n{i}") for i in range(5)], "video_id string, id bigint, name string")
    seq = pairs.sequential_pairs(df, 2, "video_id", "id", [F.col("name")], hot_rows=2)
    assert {(r["first_id"], r["second_id"]) for r in seq.collect()} == {(0, 1), (0, 2), (1, 2), (1, 3), (2, 3), (2, 4), (3, 4)}
    ranges = pairs.exhaustive_ranges(df, "video_id", "id", [F.col("name")]).agg(F.sum("partners")).first()[0]
    assert ranges == 10


@pytest.mark.parametrize("block", [90, 5000])
def test_exact_similar_pairs(spark, block):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(600, 16))
    v[200:300] = v[0]
    df = spark.createDataFrame([("c", i, x.tolist()) for i, x in enumerate(v)], "c string, id bigint, v array<double>")
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    cosine = np.round(unit @ unit.T, 9)
    np.fill_diagonal(cosine, -2)
    want = np.argsort(-cosine, axis=1, kind="stable")[:, :3]
    got = pairs.exact_similar_pairs(df, 3, "c", "id", "v", block=block).toPandas().sort_values(["id", "rank"])
    assert (got.similar_id.to_numpy().reshape(-1, 3) == want).mean() > 0.999
    assert np.allclose(got.cosine.to_numpy().reshape(-1, 3), np.take_along_axis(cosine, want, 1))


def test_similar_query_finds_all_of_the_true_best(spark):
    from plumbline.queries.spark import REGISTRY

    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").orderBy("vec_id").toPandas()
    v, ids = np.stack(table.embedding).astype(float), table.vec_id.to_numpy()
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    cosine = unit @ unit.T
    np.fill_diagonal(cosine, -2)
    got = REGISTRY["pairs_similar"](spark, "/root/testdata/sf0.01").toPandas().sort_values(["vec_id", "rank"])
    assert len(got) == 5 * len(ids) and np.allclose(got.cosine.to_numpy().reshape(-1, 5), -np.sort(-cosine, axis=1)[:, :5], atol=6e-5)


def test_training_set(spark, tmp_path):
    images = spark.createDataFrame([("s", n, r, 640, 480) for n, r in (("A_1.JPG", True), ("a_2.jpg", True), ("a_3.jpg", True), ("bad.jpg", False))],
                                   "scene_id string, image_name string, readable boolean, width int, height int")
    corner = [(0.0, 0.0), (10.0, 0.0), (0.0, 10.0), (10.0, 10.0)]
    poses = spark.createDataFrame(
        [("s", i, n, f, *c, 0.0, 1.0, 0.0, 0.0, 0.0, "camera_to_world", None, None, None, None) for i, (n, f, c) in enumerate(
            (("a_1.jpg", "one", corner[0]), ("x.jpg", "a_2", corner[1]), ("a_1.jpg", "again", corner[2]), ("zz.jpg", "zz", corner[3])))],
        "scene_id string, pose_no bigint, image_name string, frame_id string, x double, y double, z double, qw double, qx double, qy double, qz double, "
        "pose_type string, fl_x double, fl_y double, cx double, cy double")
    out = training_set.prepare(images, poses)
    got = {r["image_name"]: (r["match_status"], r["pose_no"], r["frame_id"]) for r in out["match"].collect()}
    assert got == {"A_1.JPG": ("matched", 2, "again"), "a_2.jpg": ("matched", 1, "a_2"), "a_3.jpg": ("no_pose", None, None), "bad.jpg": ("unreadable", None, None)}
    assert {r["pose_no"] for r in dataset.poses_without_image(poses, out["match"]).collect()} == {0, 3}
    norm = out["normalization"].first()
    assert (norm["ox"], norm["oy"], norm["norm_scale"]) == (5.0, 5.0, pytest.approx(1 / np.sqrt(50)))
    intr = out["intrinsics"].first()
    assert (intr["fl_x"], intr["cx"], intr["cy"]) == (768.0, 320.0, 240.0)
    documents.write_training_set(out, str(tmp_path / "t"))
    doc = json.loads("".join(p.read_text() for p in sorted((tmp_path / "t/transforms/scene_id=s").glob("part-*"))))
    assert [f["colmap_im_id"] for f in doc["frames"]] == [1, 2] and doc["camera_model"] == "OPENCV"
    assert doc["frames"][0]["transform_matrix"][1][1] == -1.0 and doc["frames"][0]["file_path"] == "images/A_1.JPG"
    record = json.loads("".join(p.read_text() for p in (tmp_path / "t/transform/scene_id=s").glob("part-*")))
    assert record["summary"] == {"total_images_processed": 2, "unreadable_images_count": 1, "missing_pose_images_count": 1}


def test_scene_normalization_inverse(spark):
    square = spark.createDataFrame([("s", x, y, 0.0) for x in (0.0, 10.0) for y in (0.0, 10.0)], "scene_id string, x double, y double, z double")
    norm = dataset.scene_normalization(square)
    r = norm.first()
    assert (r["ox"], r["oy"], r["oz"], r["norm_scale"]) == (5.0, 5.0, 0.0, pytest.approx(1 / np.sqrt(50)))
    back = dataset.denormalize(dataset.normalize(square, norm), norm)
    assert np.allclose(sorted(map(tuple, back.select("x", "y", "z").collect())), sorted(map(tuple, square.select("x", "y", "z").collect())))
    same = dataset.scene_normalization(square.select("scene_id", F.lit(1.0).alias("x"), F.lit(1.0).alias("y"), F.lit(1.0).alias("z"))).first()
    assert same["norm_scale"] == 1.0


def test_camera_to_world(spark):
    c, s = np.cos(0.5), np.sin(0.5)
    p = spark.createDataFrame([(t, 10.0, 20.0, 30.0, float(np.cos(0.25)), 0.0, 0.0, float(np.sin(0.25))) for t in ("world_to_camera", "camera_to_world")],
                              "pose_type string, x double, y double, z double, qw double, qx double, qy double, qz double")
    got = {r["pose_type"]: np.array(r["c2w"]).reshape(3, 3) for r in dataset.camera_to_world(p).collect()}
    turn = np.array([[c, -s, 0], [s, c, 0], [0, 0, 1]])
    flip = np.diag([1, -1, -1])
    assert np.allclose(got["camera_to_world"], turn @ flip) and np.allclose(got["world_to_camera"], turn.T @ flip)
    compat = {r["pose_type"]: np.array(r["c2w"]).reshape(3, 3) for r in dataset.camera_to_world(p, compat=True).collect()}
    assert np.allclose(compat["world_to_camera"], turn @ flip)


def test_run_states(spark):
    log = lambda *events: spark.createDataFrame([("r", float(i), i, *e) for i, e in enumerate(events)], "run_id string, ts_s double, seq bigint, state string, phase string, status string")
    status = lambda *ss: runs.run_status(log(*[(f"S{i}", "END", s) for i, s in enumerate(ss)])).first()
    assert status("SUCCESS", "FAILED")["current_state"] == "FAILED" and status("SUCCESS", "FAILED")["run_status"] == "FAIL"
    assert status("WARNING", "SUCCESS")["run_status"] == "WARNING" and status("WARNING", "FAILED", "SUCCESS")["run_status"] == "PASS"
    pairs_ = runs.paired_stages(log(("A", "START", "RUNNING"), ("A", "END", "SUCCESS"), ("B", "START", "RUNNING"), ("B", "END", "FAILED"), ("C", "START", "RUNNING")))
    assert [(r["state"], r["status"], r["completed_at"]) for r in pairs_.orderBy("pos").collect()] == [("A", "SUCCESS", 1.0), ("B", "FAILED", 3.0), ("C", "RUNNING", None)]
    nested = log(*[(s, p, f"S{i}") for i, (s, p) in enumerate((
        ("A", "END"), ("A", "START"), ("B", "START"), ("A", "START"), ("A", "END"), ("B", "END"), ("A", "END"), ("A", "START"), ("C", "NOTE"), ("B", "START")))])
    for hot_rows in (None, 0):
        found = [(r["state"], r["started_at"], r["completed_at"], r["status"]) for r in runs.paired_stages(nested, hot_rows=hot_rows).orderBy("pos").collect()]
        assert found == [("A", 1.0, 6.0, "S6"), ("B", 2.0, 5.0, "S5"), ("A", 3.0, 4.0, "S4"), ("A", 7.0, None, "RUNNING"), ("B", 9.0, None, "RUNNING")]
    metrics = spark.createDataFrame([("r", "cloud", "points", 3), ("r", "frames", "kept", 2)], "run_id string, stage string, metric string, value bigint")
    assert set(runs.run_report(metrics).first()["sections"]) == {"cloud", "frames"}


def test_full_run_and_resume(spark, tmp_path):
    rng = np.random.default_rng(0)
    pts = spark.createDataFrame(pd.DataFrame(rng.normal(size=(200, 3)), columns=list("xyz")).assign(cloud_id="c", point_id=range(200)))
    data = full_run.SurveyInputs(attempts=tries(spark), points=pts)
    plan = full_run.SurveyPlan(cleaning=CloudCleaning(neighbors=8))
    survey = full_run.Survey(spark, str(tmp_path / "run"))
    out = survey.run(data, plan)
    assert out["report"]["status"].first()["report_status"] == "COMPLETE_WITH_WARNINGS"
    assert [name for _, name, _, note in survey.log] == ["selection", "cloud", "report"]
    again = full_run.Survey(spark, str(tmp_path / "run"))
    again.run(data, plan)
    assert {note for *_, note in again.log} == {"kept from an earlier run"}


def test_full_run_isolates_failures(spark, tmp_path):
    broken = spark.createDataFrame([(1,)], "nothing int")
    data = full_run.SurveyInputs(attempts=tries(spark), points=broken, model=model(spark))
    survey = full_run.Survey(spark, str(tmp_path / "run"))
    out = survey.run(data)
    assert {name: status for _, name, status, _ in survey.log} == {"selection": "SUCCESS", "pose_qa": "SUCCESS", "cloud": "FAILED", "report": "SUCCESS"}
    assert out["report"]["status"].first()["report_status"] == "FAILED" and "cloud" not in out
    assert out["pose_qa"]["models"].first()["validation_status"] == "PASS"
    assert [r["stage"] for r in out["report"]["inventory"].orderBy("pos").collect()] == ["selection", "pose_qa", "cloud"]
    rng = np.random.default_rng(0)
    points = spark.createDataFrame(pd.DataFrame(rng.normal(size=(200, 3)), columns=list("xyz")).assign(cloud_id="c", point_id=range(200)))
    again = full_run.Survey(spark, str(tmp_path / "run"))
    fixed = again.run(full_run.SurveyInputs(attempts=tries(spark), points=points, model=model(spark)), full_run.SurveyPlan(cleaning=CloudCleaning(neighbors=8)))
    assert {name: note for _, name, _, note in again.log} == {
        "selection": "kept from an earlier run", "pose_qa": "kept from an earlier run", "cloud": "written", "report": "written"}
    assert fixed["report"]["status"].first()["report_status"] == "COMPLETE_WITH_WARNINGS"
    empty = full_run.Survey(spark, str(tmp_path / "none")).run(full_run.SurveyInputs())
    assert empty["report"]["stages"].count() == 0


def test_mask_tasks_follow_rows(spark, monkeypatch):
    """Twice the shuffle's partitions once the rows need them, with the same result."""
    frames = spark.range(80).select(F.lit(1).alias("video_id"), F.col("id").alias("frame_id"), F.lit(100).alias("width"), F.lit(50).alias("height"))
    boxes = frames.filter("frame_id % 2 = 0").select("*", *[F.lit(v).alias(c) for c, v in (("x1", 0.0), ("y1", 0.0), ("x2", 50.0), ("y2", 25.0))])
    few = sorted(map(tuple, masks.mask_coverage(frames, boxes).collect()))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    monkeypatch.setattr(masks, "TASK_ROWS", 60 // parts)
    many = masks.mask_coverage(frames, boxes)
    assert many.rdd.getNumPartitions() >= 2 * parts and sorted(map(tuple, many.collect())) == few
    assert [r[-1] for r in few] == [0.25, 0.0] * 40
