"""Table layouts shared by readers, operators and tests."""

from __future__ import annotations

GPS_FIX = (
    "flight_id string, seq bigint, ts_s double, lat double, lon double, alt double, "
    "raw_timestamp string, altitude_reference string"
)

POSE_JSON = (
    "frame_id string, image_name string, image_id bigint, camera_id bigint, "
    "position array<double>, rotation_quaternion array<double>, rotation_matrix array<array<double>>, "
    "timestamp string, coordinate_convention string, pose_type string, width bigint, height bigint, "
    "fl_x double, fl_y double, cx double, cy double, "
    "intrinsics struct<fl_x:double,fl_y:double,cx:double,cy:double>, "
    "rotation array<array<double>>"
)

POSE = (
    "flight_id string, frame_id string, image_name string, image_id bigint, camera_id bigint, raw_time string, "
    "x double, y double, z double, qw double, qx double, qy double, qz double, "
    "r array<array<double>>, pose_type string, coordinate_convention string, "
    "fl_x double, fl_y double, cx double, cy double"
)

CAMERA = "model_id string, camera_id bigint, model string, width bigint, height bigint, params array<double>"

IMAGE = (
    "model_id string, image_id bigint, qw double, qx double, qy double, qz double, "
    "tx double, ty double, tz double, camera_id bigint, name string, "
    "observations array<struct<px:double,py:double,point3d_id:bigint>>"
)

POINT3D = (
    "model_id string, point3d_id bigint, x double, y double, z double, "
    "r smallint, g smallint, b smallint, error double, "
    "track array<struct<image_id:bigint,point2d_idx:int>>"
)

PLY_POINT = "cloud_id string, x double, y double, z double, r smallint, g smallint, b smallint"

PLY_HEADER = "file string, is_ply boolean, num_vertices bigint, properties array<string>"

DETECTION = (
    "frame_id string, det_no int, class string, confidence double, "
    "x1 double, y1 double, x2 double, y2 double, object_id bigint"
)

ALIGNMENT_JSON = (
    "alignment struct<scale:double,rotation_matrix:array<array<double>>,translation_vector:array<double>>, "
    "target_crs string"
)

FRAME_LOG_JSON = (
    "source_video string, original_fps double, total_frames bigint, duration_seconds double, "
    "selected_frames bigint, blur_threshold_used double, "
    "frames array<struct<filename:string,timestamp_sec:double,original_frame:bigint,laplacian_variance:double>>"
)
