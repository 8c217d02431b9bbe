"""SQL counterparts of the registered queries, formulated independently of the Spark plans where that is possible."""

from __future__ import annotations

from plumbline.functions import utm
from plumbline.params import CAMERA_MODELS, DYNAMIC_CLASSES, SPLAT_ATTRIBUTES
from plumbline.queries.views import duckdb_views as using

ORACLE: dict[str, str] = {}

_XYZ = ("x", "y", "z")
_R4 = ", ".join(f"round({c}, 4) AS {c}" for c in _XYZ)

ORACLE["cloud_validate"] = f"""
WITH {using('v_points_big')},
places AS (SELECT cloud_id, x, y, z, count(*) AS c, bool_and(r BETWEEN 0 AND 255 AND g BETWEEN 0 AND 255 AND b BETWEEN 0 AND 255) AS ok
           FROM v_points_big GROUP BY ALL),
m AS (SELECT cloud_id, CAST(sum(c) AS BIGINT) AS num_points, count(*) AS unique_points, bool_and(ok) AS rgb_valid,
      {', '.join(f'min({a}) AS lo{a}, max({a}) AS hi{a}, max({a})-min({a}) AS e{a}' for a in _XYZ)} FROM places GROUP BY cloud_id)
SELECT cloud_id, CASE WHEN num_points > unique_points OR NOT rgb_valid OR least(ex, ey, ez) <= 1e-6 THEN 'WARNING' ELSE 'PASS' END AS status,
       num_points, unique_points, num_points - unique_points AS duplicate_points,
       {', '.join(f'round(lo{a}, 4) AS min_{a}, round(hi{a}, 4) AS max_{a}, round(e{a}, 4) AS extent_{a}' for a in _XYZ)},
       round(ex*ey*ez, 4) AS volume, round(num_points/(ex*ey*ez), 4) AS density, true AS rgb_available, rgb_valid
FROM m"""


def _voxels(view: str, size: float) -> str:
    cells = ", ".join(f"CAST(floor(({a} - o{a})/{size}e0) AS BIGINT) AS v{a}" for a in _XYZ)
    starts = ", ".join(f"min({a}) - {size / 2}e0 AS o{a}" for a in _XYZ)
    return f"""starts AS (SELECT cloud_id, {starts} FROM {view} GROUP BY cloud_id),
cells AS (SELECT {view}.*, {cells} FROM {view} JOIN starts USING (cloud_id)),
voxels AS (SELECT cloud_id, vx, vy, vz, count(*) AS merged_points, avg(x) AS x, avg(y) AS y, avg(z) AS z,
   {', '.join(f'CAST(floor(avg({c})) AS INTEGER) AS {c}' for c in 'rgb')} FROM cells GROUP BY cloud_id, vx, vy, vz)"""


ORACLE["voxel_downsample"] = f"""
WITH {using('v_points_big')}, {_voxels('v_points_big', 2.0)}
SELECT cloud_id, vx, vy, vz, merged_points, {_R4}, r, g, b FROM voxels"""

ORACLE["stage_report"] = f"""
WITH {using('v_points_big')}, {_voxels('v_points_big', 8.0)},
c AS (SELECT a.cloud_id, a.n, b.m FROM (SELECT cloud_id, count(*) AS n FROM v_points_big GROUP BY 1) a
      JOIN (SELECT cloud_id, count(*) AS m FROM voxels GROUP BY 1) b USING (cloud_id))
SELECT cloud_id, 0 AS stage_no, 'input' AS stage, n AS points, CAST(0 AS BIGINT) AS removed_points, 1e0 AS stage_retention,
       1e0 AS total_retention, false AS excessive_removal FROM c
UNION ALL
SELECT cloud_id, 1, 'voxel_downsample', m, n - m, round(m/n, 4), round(m/n, 4), m/n < 0.3 FROM c"""


def _sor(view: str) -> str:
    return f"""d AS (SELECT a.cloud_id, a.point_id, a.x, a.y, a.z,
   list_avg(min(sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)), 20)) AS mean_distance
   FROM (SELECT DISTINCT cloud_id, x, y, z, 0 AS point_id FROM {view}) a JOIN {view} b USING (cloud_id) GROUP BY ALL),
w AS (SELECT p.cloud_id, p.point_id, p.x, p.y, d.mean_distance FROM {view} p JOIN d ON p.cloud_id = d.cloud_id AND p.x = d.x AND p.y = d.y AND p.z = d.z),
s AS (SELECT cloud_id, count(*) AS n, sum(mean_distance)/count(*) AS mu FROM w GROUP BY 1),
t AS (SELECT w.cloud_id, any_value(n) AS n, any_value(mu) AS mu,
      sqrt(sum(CASE WHEN mean_distance > 0 THEN (mean_distance-mu)*(mean_distance-mu) ELSE 0 END)/(any_value(n)-1)) AS sd FROM w JOIN s USING (cloud_id) GROUP BY 1),
judged AS (SELECT w.*, n <= 20 OR (mean_distance > 0 AND mean_distance < mu + 2*sd) AS keep FROM w JOIN t USING (cloud_id))"""


ORACLE["sor_filter"] = f"""
WITH {using('v_points')}, {_sor('v_points')}
SELECT cloud_id, point_id, round(mean_distance, 4) AS mean_distance, keep FROM judged"""

ORACLE["sor_filter_clouds"] = f"""
WITH {using('v_points_big')}, {_sor('v_points_big')}
SELECT cloud_id, count(*) AS kept_points, CAST(sum(point_id) AS BIGINT) AS point_id_sum,
       round(avg(x), 4) AS mean_x, round(avg(y), 4) AS mean_y FROM judged WHERE keep GROUP BY cloud_id"""

_HASH = "CAST(concat('0x', substr(md5(concat_ws(':', 0, {})), 1, 8)) AS BIGINT)"
ORACLE["plane_fit"] = f"""
WITH {using('v_points_big')},
corners AS (SELECT cloud_id, x, y, z, row_number() OVER (PARTITION BY cloud_id ORDER BY {_HASH.format("point_id")}, point_id, x, y, z) - 1 AS i FROM v_points_big
  QUALIFY i < 600),
sizes AS (SELECT cloud_id, count(*) AS n FROM corners GROUP BY 1),
steps AS (SELECT cloud_id, n, h, {_HASH.format('h, 1')} AS u, 1 + {_HASH.format('h, 2')} % (n - 1) AS s, 1 + {_HASH.format('h, 3')} % (n - 2) AS w
  FROM sizes, range(200) r(h) WHERE n >= 3),
picks AS (SELECT cloud_id, h, u % n AS i, (u + s) % n AS j, (u + w + CASE WHEN w >= s THEN 1 ELSE 0 END) % n AS k FROM steps),
sides AS (SELECT cloud_id, h, p.x, p.y, p.z, q.x - p.x AS ux, q.y - p.y AS uy, q.z - p.z AS uz, r.x - p.x AS vx, r.y - p.y AS vy, r.z - p.z AS vz
  FROM picks JOIN corners p USING (cloud_id, i) JOIN (SELECT cloud_id, i AS j, x, y, z FROM corners) q USING (cloud_id, j)
  JOIN (SELECT cloud_id, i AS k, x, y, z FROM corners) r USING (cloud_id, k)),
normals AS (SELECT cloud_id, h, x, y, z, uy*vz - uz*vy AS a, uz*vx - ux*vz AS b, ux*vy - uy*vx AS c FROM sides),
planes AS (SELECT cloud_id, h, a/l AS a, b/l AS b, c/l AS c, -(a*x + b*y + c*z)/l AS d FROM (SELECT *, sqrt(a*a + b*b + c*c) AS l FROM normals) WHERE l > 1e-12),
best AS (SELECT cloud_id, h, any_value(a) AS a, any_value(b) AS b, any_value(c) AS c, any_value(d) AS d,
  count(*) FILTER (abs(a*x + b*y + c*z + d) < 0.5) AS hits, count(*) AS n FROM (SELECT cloud_id, h, a, b, c, d FROM planes)
  JOIN (SELECT cloud_id, x, y, z FROM v_points_big) USING (cloud_id) GROUP BY cloud_id, h
  QUALIFY row_number() OVER (PARTITION BY cloud_id ORDER BY hits DESC, h) = 1)
SELECT cloud_id, round(a, 6) AS a, round(b, 6) AS b, round(c, 6) AS c, round(d, 6) AS d, hits AS ground_inliers, n AS num_points,
       round(hits/n, 4) AS ground_fraction, 'ANALYZED_NOT_FILTERED' AS status FROM best"""

ORACLE["radius_filter"] = f"""
WITH {using('v_points_big')},
n AS (SELECT a.cloud_id, a.x, a.y, a.z, count(*) AS c FROM (SELECT DISTINCT cloud_id, x, y, z FROM v_points_big) a
      JOIN v_points_big b ON a.cloud_id = b.cloud_id AND b.x BETWEEN a.x - 1.5 AND a.x + 1.5
       AND (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z) <= 1.5e0*1.5e0 GROUP BY ALL)
SELECT cloud_id, count(*) FILTER (c > 10) AS kept_points, CAST(sum(point_id) FILTER (c > 10) AS BIGINT) AS point_id_sum,
       count(*) FILTER (c <= 10) AS removed_points
FROM v_points_big JOIN n USING (cloud_id, x, y, z) GROUP BY cloud_id"""

ORACLE["radius_neighbors"] = f"""
WITH {using('v_points')}
SELECT a.point_id, count(*) AS neighbors FROM v_points a JOIN v_points b
  ON (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z) <= 0.15e0*0.15e0 GROUP BY a.point_id"""


_VOXEL4 = _voxels("judged", 4.0).replace("FROM judged JOIN", "FROM (SELECT * FROM judged WHERE keep) judged JOIN").replace(
    "FROM judged GROUP", "FROM judged WHERE keep GROUP"
).split(",\nvoxels AS")[0]
ORACLE["cloud_cleaning"] = f"""
WITH {using('v_points_big')}, {_sor('v_points_big').replace('p.y, d.mean', 'p.y, p.z, d.mean')}, {_VOXEL4},
n AS (SELECT a.cloud_id, a.n AS n0, b.n AS n1, c.n AS n2 FROM (SELECT cloud_id, count(*) AS n FROM v_points_big GROUP BY 1) a
  JOIN (SELECT cloud_id, count(*) AS n FROM judged WHERE keep GROUP BY 1) b USING (cloud_id)
  JOIN (SELECT cloud_id, count(*) AS n FROM (SELECT DISTINCT cloud_id, vx, vy, vz FROM cells) GROUP BY 1) c USING (cloud_id))
SELECT cloud_id, 0 AS stage_no, 'input' AS stage, n0 AS points, CAST(0 AS BIGINT) AS removed_points, 1e0 AS stage_retention, 1e0 AS total_retention, false AS excessive_removal FROM n
UNION ALL SELECT cloud_id, 1, 'statistical_outliers', n1, n0 - n1, round(n1/n0, 4), round(n1/n0, 4), n1/n0 < 0.3 FROM n
UNION ALL SELECT cloud_id, 2, 'voxel_downsample', n2, n1 - n2, round(n2/n1, 4), round(n2/n0, 4), n2/n0 < 0.3 FROM n"""


def _nearest(k: int) -> str:
    return f"""near AS (SELECT a.point_id, b.point_id AS neighbor_id,
   sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) AS distance
   FROM v_points a JOIN v_points b ON a.point_id <> b.point_id),
top AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY distance, neighbor_id) AS rn FROM near QUALIFY rn <= {k})"""


ORACLE["knn_topk"] = f"""
WITH {using('v_points')}, {_nearest(5)}
SELECT point_id, CAST(rn AS INTEGER) AS neighbor_rank, neighbor_id, round(distance, 4) AS distance FROM top"""

ORACLE["pairs_spatial"] = f"""
WITH {using('v_points')}, {_nearest(3)}
SELECT least(point_id, neighbor_id) AS first_id, greatest(point_id, neighbor_id) AS second_id, round(min(distance), 4) AS distance
FROM top GROUP BY 1, 2"""

ORACLE["transform_points"] = f"""
WITH {using('v_points_big', 'v_alignment')}
SELECT cloud_id, point_id, round(scale*(cos(angle)*x - sin(angle)*y) + shift, 4) AS x,
       round(scale*(sin(angle)*x + cos(angle)*y) + 2*shift, 4) AS y, round(scale*z + 3, 4) AS z
FROM v_points_big JOIN v_alignment USING (cloud_id)"""

_CHECKED = f"""{using('v_gps_raw')},
parsed AS (SELECT *, TRY_CAST(time_text AS DOUBLE)/1e6 AS ts_s, TRY_CAST(lat_text AS DOUBLE)/1e5 AS lat,
                  TRY_CAST(lon_text AS DOUBLE)/1e5 AS lon, TRY_CAST(alt_text AS DOUBLE) AS alt FROM v_gps_raw),
checked AS (SELECT *, CASE
   WHEN list_has_any(['', 'nan', 'null', 'none'], [lower(time_text), lower(lat_text), lower(lon_text), lower(alt_text)]) THEN 'missing'
   WHEN ts_s IS NULL THEN 'bad_timestamp' WHEN lat NOT BETWEEN -90 AND 90 THEN 'latitude_range'
   WHEN lon NOT BETWEEN -180 AND 180 THEN 'longitude_range' WHEN isinf(alt) THEN 'altitude_not_finite' END AS reject_reason FROM parsed)"""

ORACLE["gps_validate"] = f"""
WITH {_CHECKED}
SELECT flight_id, seq, reject_reason,
       {', '.join(f'CASE WHEN reject_reason IS NULL THEN {c} END AS {c}' for c in ('ts_s', 'lat', 'lon', 'alt'))} FROM checked"""

ORACLE["gps_metadata"] = f"""
WITH {_CHECKED}
SELECT flight_id, count(*) FILTER (reject_reason IS NULL) AS valid_rows,
       count(*) FILTER (reject_reason IS NULL) - count(DISTINCT CASE WHEN reject_reason IS NULL THEN ts_s END) AS duplicate_timestamps,
       count(*) FILTER (reject_reason = 'missing') AS missing_rows,
       count(*) FILTER (reject_reason <> 'missing') AS error_rows,
       min(ts_s) FILTER (reject_reason IS NULL) AS time_start, max(ts_s) FILTER (reject_reason IS NULL) AS time_end,
       round(max(ts_s) FILTER (reject_reason IS NULL) - min(ts_s) FILTER (reject_reason IS NULL), 3) AS duration_seconds,
       CASE WHEN bool_or(reject_reason IS NULL) THEN 'OK' ELSE 'FAILED' END AS status
FROM checked GROUP BY flight_id"""

ORACLE["gps_error_sample"] = f"""
WITH {_CHECKED},
bad AS (SELECT *, row_number() OVER (PARTITION BY flight_id ORDER BY seq) AS rn FROM checked WHERE reject_reason <> 'missing' QUALIFY rn <= 5)
SELECT flight_id, string_agg('row ' || seq || ': ' || reject_reason, '; ' ORDER BY seq) AS first_errors FROM bad GROUP BY flight_id"""

ORACLE["gps_duplicate_times"] = f"""
WITH {using('v_gps')}, days AS (SELECT flight_id, seq, floor(ts_s/86400)*86400e0 AS ts_s FROM v_gps)
SELECT flight_id, seq, ts_s, row_number() OVER (PARTITION BY flight_id, ts_s ORDER BY seq) > 1 AS is_duplicate_time FROM days"""

ORACLE["timestamp_parse"] = f"""
WITH {using('v_time_texts')}
SELECT v.event_id, time_text, CASE WHEN e.event_id % 7 = 6 THEN NULL
   ELSE (epoch_us(ts) // 1000000) + CASE WHEN e.event_id % 7 = 5 THEN 0.25e0 ELSE 0e0 END END AS ts_s
FROM v_time_texts v JOIN events e USING (event_id)"""

_SYNCED = f"""{using('v_gps', 'v_poses')},
cand AS (SELECT p.flight_id, p.frame_no, p.x, p.y, p.z, g.seq AS gps_seq, g.lat, g.lon, g.alt, abs(p.ts_s - g.ts_s) AS diff
         FROM v_poses p JOIN v_gps g USING (flight_id) WHERE p.ts_s IS NOT NULL
         QUALIFY row_number() OVER (PARTITION BY p.flight_id, p.frame_no ORDER BY abs(p.ts_s - g.ts_s), g.ts_s, g.seq) = 1),
synced AS (SELECT p.flight_id, p.frame_no, c.gps_seq, c.diff AS time_diff_s, coalesce(c.diff <= 21600, false) AS matched,
           CASE WHEN p.ts_s IS NULL THEN 'no_timestamp' WHEN c.diff IS NULL THEN 'no_gps' WHEN c.diff > 21600 THEN 'over_tolerance' END AS unmatched_reason,
           p.x, p.y, p.z, c.lat, c.lon, c.alt
           FROM v_poses p LEFT JOIN cand c USING (flight_id, frame_no))"""

ORACLE["nearest_time_sync"] = f"""
WITH {_SYNCED}
SELECT flight_id, frame_no, gps_seq, round(time_diff_s, 4) AS time_diff_s, matched, unmatched_reason FROM synced"""

ORACLE["sync_summary"] = f"""
WITH {_SYNCED},
p AS (SELECT flight_id, count(*) AS n, count(*) FILTER (matched) AS m, count(DISTINCT CASE WHEN matched THEN gps_seq END) AS u,
      avg(time_diff_s) FILTER (matched) AS a, max(time_diff_s) FILTER (matched) AS b FROM synced GROUP BY 1),
g AS (SELECT flight_id, count(*) AS k FROM v_gps GROUP BY 1)
SELECT flight_id, coalesce(n, 0) AS total_poses, coalesce(k, 0) AS total_gps, coalesce(m, 0) AS matched_poses,
       coalesce(n, 0) - coalesce(m, 0) AS unmatched_poses, coalesce(k, 0) - coalesce(u, 0) AS unmatched_gps,
       round(coalesce(a, 0e0), 4) AS mean_time_diff_s, round(coalesce(b, 0e0), 4) AS max_time_diff_s,
       round(coalesce(m, 0)/greatest(coalesce(n, 0), 1), 4) AS match_rate
FROM p FULL JOIN g USING (flight_id)"""

ORACLE["sync_unmatched"] = f"""
WITH {_SYNCED}
SELECT flight_id, 'pose' AS side, frame_no AS row_id, unmatched_reason AS reason, round(time_diff_s, 4) AS time_diff_s FROM synced WHERE NOT matched
UNION ALL
SELECT flight_id, 'gps', seq, NULL, NULL FROM v_gps g WHERE NOT EXISTS
  (SELECT 1 FROM synced s WHERE s.matched AND s.flight_id = g.flight_id AND s.gps_seq = g.seq)"""

ORACLE["utm_zone"] = f"""
WITH {using('v_gps')}, spread AS (SELECT seq, seq*37 % 360 - 180 + 5e-1 AS lon, seq*13 % 168 - 84 + 25e-2 AS lat FROM v_gps),
z AS (SELECT *, CAST(floor((lon + 180)/6) AS INTEGER) + 1 AS zone FROM spread)
SELECT seq, lon, lat, CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END + zone AS epsg,
       'WGS 84 / UTM zone ' || zone || CASE WHEN lat >= 0 THEN 'N' ELSE 'S' END AS crs_name FROM z"""

# Transverse Mercator by the classic power series in the longitude difference (Snyder 1987), not the Spark formula.
_E2 = utm.FLATTENING * (2 - utm.FLATTENING)
_EP2 = _E2 / (1 - _E2)
_M = [
    1 - _E2 / 4 - 3 * _E2**2 / 64 - 5 * _E2**3 / 256,
    3 * _E2 / 8 + 3 * _E2**2 / 32 + 45 * _E2**3 / 1024,
    15 * _E2**2 / 256 + 45 * _E2**3 / 1024,
    35 * _E2**3 / 3072,
]
_SNYDER = f"""geo AS (SELECT *, CAST(floor((lon + 180)/6) AS INTEGER) + 1 AS zone, radians(lat) AS p FROM fixes),
tm AS (SELECT *, {utm.SEMI_MAJOR!r}/sqrt(1 - {_E2!r}*sin(p)*sin(p)) AS n, tan(p)*tan(p) AS t, {_EP2!r}*cos(p)*cos(p) AS c,
       (radians(lon) - radians(zone*6e0 - 183e0))*cos(p) AS a,
       {utm.SEMI_MAJOR!r}*({_M[0]!r}*p - {_M[1]!r}*sin(2*p) + {_M[2]!r}*sin(4*p) - {_M[3]!r}*sin(6*p)) AS m FROM geo),
projected AS (SELECT *, 5e5 + 0.9996e0*n*(a + (1-t+c)*a**3/6 + (5-18*t+t*t+72*c-58*{_EP2!r})*a**5/120) AS easting,
       CASE WHEN lat < 0 THEN 1e7 ELSE 0e0 END + 0.9996e0*(m + n*tan(p)*(a*a/2 + (5-t+9*c+4*c*c)*a**4/24
        + (61-58*t+t*t+600*c-330*{_EP2!r})*a**6/720)) AS northing FROM tm)"""


def _kruger(source: str) -> str:
    terms_e = " + ".join(f"{c!r}*cos({2 * j}*xi)*sinh({2 * j}*eta)" for j, c in enumerate(utm.FORWARD, 1))
    terms_n = " + ".join(f"{c!r}*sin({2 * j}*xi)*cosh({2 * j}*eta)" for j, c in enumerate(utm.FORWARD, 1))
    e = repr(utm.ECCENTRICITY)
    return f"""g0 AS (SELECT *, CAST(floor((lon + 180)/6) AS INTEGER) + 1 AS zone FROM {source}),
g1 AS (SELECT *, radians(lon) - radians(zone*6e0 - 183e0) AS lam,
       sinh(atanh(sin(radians(lat))) - {e}*atanh({e}*sin(radians(lat)))) AS tt FROM g0),
g2 AS (SELECT *, atan2(tt, cos(lam)) AS xi, asinh(sin(lam)/sqrt(tt*tt + cos(lam)*cos(lam))) AS eta FROM g1),
projected AS (SELECT *, 5e5 + {utm.RADIUS!r}*(eta + {terms_e}) AS easting,
       CASE WHEN lat < 0 THEN 1e7 ELSE 0e0 END + {utm.RADIUS!r}*(xi + {terms_n}) AS northing FROM g2)"""


ORACLE["utm_forward"] = f"""
WITH {using('v_gps')}, {_kruger('v_gps')}
SELECT flight_id, seq, 32600 + zone AS epsg, round(easting, 3) AS easting, round(northing, 3) AS northing, alt FROM projected"""

ORACLE["utm_roundtrip"] = f"""
WITH {using('v_gps')} SELECT flight_id, seq, round(lon, 7) AS lon, round(lat, 7) AS lat, round(alt, 3) AS alt FROM v_gps"""

_PAIRS = f"""{_SYNCED}, matched AS (SELECT * FROM synced WHERE matched), {_kruger('matched')},
pairs AS (SELECT flight_id, x, y, z, easting AS gx, northing AS gy, alt AS gz FROM projected)"""

_SRC, _DST = ("x", "y", "z"), ("gx", "gy", "gz")
_MOMENTS = [f"round(avg({c}), 3) AS m_{c}" for c in (*_SRC, *_DST)]
for _prefix, _cols in (("s", _SRC), ("d", _DST)):
    _MOMENTS += [
        f"round(covar_pop({_cols[i]}, {_cols[j]}), 3) AS c_{_prefix}{'xyz'[i]}{'xyz'[j]}" for i in range(3) for j in range(i, 3)
    ]
_MOMENTS += [f"round(covar_pop({_DST[i]}, {_SRC[j]}), 3) AS x_{i}{j}" for i in range(3) for j in range(3)]
ORACLE["similarity_moments"] = f"""
WITH {_PAIRS} SELECT flight_id, count(*) AS n, {', '.join(_MOMENTS)} FROM pairs GROUP BY flight_id"""

def _fits() -> str:
    """``fits`` by the power method: the projector on the dominant eigenvector of Horn's matrix, shifted to be positive,
    is the limit of its powers, and holds all products of quaternion entries that the rotation needs."""
    moments = [f"avg({c}) AS m_{c}" for c in (*_SRC, *_DST)]
    moments += [f"covar_pop({_DST[b]}, {_SRC[a]}) AS s{a}{b}" for a in range(3) for b in range(3)]
    for name, cols in (("a", _SRC), ("b", _DST)):
        moments += [f"covar_pop({cols[i]}, {cols[j]}) AS {name}{i}{j}" for i in range(3) for j in range(i, 3)]
    upper = [(i, j) for i in range(4) for j in range(i, 4)]
    form = {
        (0, 0): "s00+s11+s22", (0, 1): "s12-s21", (0, 2): "s20-s02", (0, 3): "s01-s10", (1, 1): "s00-s11-s22", (1, 2): "s01+s10",
        (1, 3): "s02+s20", (2, 2): "s11-s00-s22", (2, 3): "s12+s21", (3, 3): "s22-s00-s11",
    }
    norm = "+".join(f"{1 if i == j else 2}*h{i}{j}*h{i}{j}" for i, j in upper)
    at = lambda i, j: f"p{min(i, j)}{max(i, j)}"
    squares = ", ".join(f"{'+'.join(f'{at(i, k)}*{at(k, j)}' for k in range(4))} AS q{i}{j}" for i, j in upper)
    scaled = ", ".join(f"q{i}{j}/(q00+q11+q22+q33)" for i, j in upper)
    turn = [
        ["p00+p11-p22-p33", "2*(p12-p03)", "2*(p13+p02)"],
        ["2*(p12+p03)", "p00-p11+p22-p33", "2*(p23-p01)"],
        ["2*(p13-p02)", "2*(p23+p01)", "p00-p11-p22+p33"],
    ]
    thin = {n: f"{n}00*{n}11-{n}01*{n}01 + {n}00*{n}22-{n}02*{n}02 + {n}11*{n}22-{n}12*{n}12 < 1e-10*({n}00+{n}11+{n}22)**2" for n in "ab"}
    return f"""moments AS (SELECT flight_id, count(*) AS n, {', '.join(moments)} FROM pairs GROUP BY flight_id),
form AS (SELECT *, {', '.join(f'{e} AS h{i}{j}' for (i, j), e in form.items())} FROM moments),
start AS (SELECT flight_id, sqrt({norm}) + 1e-300 AS w, {', '.join(f'h{i}{j}' for i, j in upper)} FROM form),
powers AS (SELECT flight_id, 0 AS k, {', '.join(f"h{i}{j}/w{' + 1' if i == j else ''} AS p{i}{j}" for i, j in upper)} FROM start
 UNION ALL SELECT flight_id, k + 1, {scaled} FROM (SELECT flight_id, k, {squares} FROM powers WHERE k < 60)),
turned AS (SELECT form.*, {'+'.join(f'{1 if i == j else 2}*h{i}{j}*p{i}{j}' for i, j in upper)} AS top,
 {', '.join(f'{turn[i][j]} AS r{i}{j}' for i in range(3) for j in range(3))} FROM form JOIN powers USING (flight_id) WHERE k = 60),
judged AS (SELECT *, CASE WHEN a00+a11+a22 > 0 THEN top/(a00+a11+a22) END AS f,
 CASE WHEN n < 3 THEN 'fewer than 3 pairs' WHEN a00+a11+a22 < 1e-10 THEN 'source points coincide' WHEN {thin['a']} THEN 'source points are collinear'
  WHEN b00+b11+b22 < 1e-10 THEN 'target points coincide' WHEN {thin['b']} THEN 'target points are collinear'
  WHEN NOT coalesce(top > 0, false) THEN 'scale is not positive' END AS reason FROM turned),
fits AS (SELECT *, {', '.join(f'm_{_DST[i]} - f*({"+".join(f"r{i}{j}*m_{_SRC[j]}" for j in range(3))}) AS t{i}' for i in range(3))} FROM judged),
gaps AS (SELECT flight_id, sqrt({'+'.join(f'(f*(r{i}0*x+r{i}1*y+r{i}2*z) + t{i} - {_DST[i]})**2' for i in range(3))}) AS d
 FROM pairs JOIN fits USING (flight_id) WHERE reason IS NULL),
quality AS (SELECT fits.*, rmse, max_error FROM fits LEFT JOIN
 (SELECT flight_id, sqrt(avg(d*d)) AS rmse, max(d) AS max_error FROM gaps GROUP BY 1) USING (flight_id))"""


ORACLE["similarity_fit"] = f"""
WITH RECURSIVE {_PAIRS}, {_fits()}
SELECT flight_id, n, CASE WHEN reason IS NULL THEN round(f, 4) END AS scale, round(rmse, 4) AS rmse, round(max_error, 4) AS max_error,
       CASE WHEN reason IS NOT NULL THEN 'ERROR' WHEN rmse > 5 THEN 'WARNING' ELSE 'PASS' END AS status, reason FROM quality"""

ORACLE["georeference_flights"] = f"""
WITH RECURSIVE {_PAIRS}, {_fits()},
p AS (SELECT flight_id, count(*) AS total, count(*) FILTER (matched) AS m FROM synced GROUP BY 1),
j AS (SELECT p.*, f, rmse, CASE WHEN m = 0 THEN 'no pose has a fix within tolerance' ELSE reason END AS reason FROM p LEFT JOIN quality USING (flight_id))
SELECT flight_id, CASE WHEN m > 0 THEN 'EPSG:32643' END AS target_crs, m AS matched_poses, round(m/total, 4) AS match_rate,
       CASE WHEN reason IS NULL THEN round(f, 4) END AS scale, round(rmse, 4) AS rmse,
       CASE WHEN reason IS NOT NULL THEN 'ERROR' WHEN rmse > 5 OR m/total < 0.5 THEN 'WARNING' ELSE 'PASS' END AS status, reason FROM j"""


def _back_to_wgs84(rounds: int = 12) -> str:
    """``back`` with lon and lat of ``moved``: the forward series and the conformal latitude are inverted by iteration."""
    north = " - ".join(["v"] + [f"{c!r}*sin({2 * j}*xi)*cosh({2 * j}*eta)" for j, c in enumerate(utm.FORWARD, 1)])
    east = " - ".join(["u"] + [f"{c!r}*cos({2 * j}*xi)*sinh({2 * j}*eta)" for j, c in enumerate(utm.FORWARD, 1)])
    e = repr(utm.ECCENTRICITY)
    return f"""plane AS (SELECT flight_id, frame_no, (gx - 5e5)/({utm.RADIUS!r}) AS u, gy/({utm.RADIUS!r}) AS v FROM moved),
flat AS (SELECT *, v AS xi, u AS eta, 0 AS k FROM plane
 UNION ALL SELECT flight_id, frame_no, u, v, {north}, {east}, k + 1 FROM flat WHERE k < {rounds}),
sphere AS (SELECT flight_id, frame_no, sin(xi)/cosh(eta) AS s, atan2(sinh(eta), cos(xi)) AS lam FROM flat WHERE k = {rounds}),
bent AS (SELECT *, s AS q, 0 AS k FROM sphere
 UNION ALL SELECT flight_id, frame_no, s, lam, tanh(atanh(s) + {e}*atanh({e}*q)), k + 1 FROM bent WHERE k < {rounds}),
back AS (SELECT flight_id, frame_no, degrees(lam) + 75 AS lon, degrees(asin(q)) AS lat FROM bent WHERE k = {rounds})"""


ORACLE["geojson_features"] = f"""
WITH RECURSIVE {_PAIRS}, {_fits()},
moved AS (SELECT synced.flight_id, synced.frame_no, matched, {', '.join(f'f*(r{i}0*x+r{i}1*y+r{i}2*z) + t{i} AS {_DST[i]}' for i in range(3))}
 FROM synced JOIN fits USING (flight_id) WHERE reason IS NULL), {_back_to_wgs84()},
found AS (SELECT m.flight_id, m.frame_no, v.frame_id, v.image_name, m.matched, round(back.lon, 7) AS lon, round(back.lat, 7) AS lat, round(m.gz, 3) AS alt,
 round(sqrt((m.gx - easting)**2 + (m.gy - northing)**2 + (m.gz - p.alt)**2), 4) AS gap
 FROM moved m JOIN back USING (flight_id, frame_no) JOIN v_poses v USING (flight_id, frame_no) LEFT JOIN projected p USING (flight_id, frame_no)),
told AS (SELECT *, CASE WHEN gap IS NULL THEN 'null' WHEN gap > 0 AND gap < 1e-3 THEN concat(CAST(round(gap*1e4, 0) AS INTEGER), '.0E-4') ELSE CAST(gap AS VARCHAR) END AS gap_text FROM found)
SELECT flight_id, frame_id, image_name, lon, lat, alt AS altitude_m, concat('{{"type":"Feature","geometry":{{"type":"Point","coordinates":[', lon, ',', lat, ',', alt,
 ']}},"properties":{{"frame_id":"', frame_id, '","image_name":"', image_name, '","altitude_m":', alt, ',"residual_m":', gap_text,
 ',"matched_gps":', CAST(matched AS VARCHAR), '}}}}') AS feature FROM told"""

ORACLE["transform_poses"] = f"""
WITH {using('v_poses', 'v_flight_fit')},
turned AS (SELECT p.*, scale, angle, shift, (frame_no % 360)*pi()/180 - angle AS turn FROM v_poses p JOIN v_flight_fit USING (flight_id))
SELECT flight_id, frame_no, round(scale*(cos(angle)*x - sin(angle)*y) + shift, 4) AS new_x,
       round(scale*(sin(angle)*x + cos(angle)*y) + 2*shift, 4) AS new_y, round(scale*z + 3, 4) AS new_z,
       round(abs(cos(turn/2)), 4) AS new_qw, round(sin(turn/2)*sign(cos(turn/2)) + 0e0, 4) AS new_qz FROM turned"""

_ERRORS = f"""{using('v_observations', 'v_images', 'v_cameras', 'v_points3d')},
local AS (SELECT o.image_id, o.point2d_idx, o.point3d_id, o.px, o.py, i.flight_id, c.model,
   (1-2*qz*qz)*p.x - 2*qw*qz*p.y + tx AS cx, 2*qw*qz*p.x + (1-2*qz*qz)*p.y + ty AS cy, p.z + tz AS cz
   FROM v_observations o JOIN v_images i USING (image_id) JOIN v_cameras c USING (camera_id)
   JOIN v_points3d p ON p.point3d_id = o.point3d_id WHERE o.point3d_id >= 0),
norm AS (SELECT *, cx/cz AS u, cy/cz AS v, (cx/cz)*(cx/cz) + (cy/cz)*(cy/cz) AS r2 FROM local WHERE cz > 1e-8),
lens AS (SELECT *, CASE model WHEN 'SIMPLE_PINHOLE' THEN 1e0 WHEN 'PINHOLE' THEN 1e0 WHEN 'SIMPLE_RADIAL' THEN 1 + 0.1e0*r2
   WHEN 'RADIAL' THEN 1 + 0.1e0*r2 + 0.01e0*r2*r2 WHEN 'OPENCV' THEN 1 + 0.1e0*r2 + 0.01e0*r2*r2
   WHEN 'OPENCV_FISHEYE' THEN CASE WHEN r2 < 1e-16 THEN 1e0 ELSE
     atan(sqrt(r2))*(1 + 0.1e0*atan(sqrt(r2))**2 + 0.01e0*atan(sqrt(r2))**4 + 0.001e0*atan(sqrt(r2))**6 + 0.002e0*atan(sqrt(r2))**8)/sqrt(r2) END
   END AS k, CASE WHEN model = 'OPENCV' THEN 1e0 ELSE 0e0 END AS tang FROM norm),
errors AS (SELECT image_id, point2d_idx, point3d_id, flight_id, model = 'FULL_OPENCV' AS unsupported,
   sqrt((1000*(u*k + tang*(2*0.001e0*u*v + 0.002e0*(r2 + 2*u*u))) + 960 - px)**2
      + (1000*(v*k + tang*(0.001e0*(r2 + 2*v*v) + 2*0.002e0*u*v)) + 540 - py)**2) AS error_px FROM lens)"""

ORACLE["reprojection_errors"] = f"""
WITH {_ERRORS} SELECT image_id, point2d_idx, point3d_id, round(error_px, 4) AS error_px, unsupported FROM errors"""


def _stats(limit: float) -> str:
    return f"""sums AS (SELECT flight_id, count(error_px) AS n, bool_or(unsupported) AS bad, avg(error_px) AS mean, median(error_px) AS med,
   sqrt(avg(error_px*error_px)) AS rmse, max(error_px) AS mx FROM errors GROUP BY 1),
stats AS (SELECT flight_id, CASE WHEN ok THEN 'AVAILABLE' ELSE 'NOT_AVAILABLE' END AS reprojection_status,
   CASE WHEN ok THEN n ELSE 0 END AS observations_used, CASE WHEN ok THEN round(mean, 4) END AS mean_px,
   CASE WHEN ok THEN round(med, 4) END AS median_px, CASE WHEN ok THEN round(rmse, 4) END AS rmse_px,
   CASE WHEN ok THEN round(mx, 4) END AS max_px,
   CASE WHEN NOT ok THEN 'NOT_AVAILABLE' WHEN round(rmse, 4) <= {limit} THEN 'PASS' ELSE 'FAIL' END AS reprojection_check
   FROM (SELECT *, n > 0 AND NOT bad AS ok FROM sums))"""


ORACLE["reprojection_stats"] = f"WITH {_ERRORS}, {_stats(1.0)} SELECT * FROM stats"


def _rates(limit: float) -> str:
    return f"""rates AS (SELECT flight_id, count(*) FILTER (seen) AS registered_images, count(*) AS total_images,
   count(*) FILTER (NOT seen) AS unregistered_images, round(count(*) FILTER (seen)/count(*), 4) AS registration_rate,
   CASE WHEN round(count(*) FILTER (seen)/count(*), 4) >= {limit} AND count(*) FILTER (seen) > 0 THEN 'PASS' ELSE 'FAIL' END AS registration_check
   FROM (SELECT *, EXISTS (SELECT 1 FROM v_observations o WHERE o.image_id = v_images.image_id AND o.point3d_id >= 0) AS seen FROM v_images)
   GROUP BY 1)"""


ORACLE["registration_rate"] = f"WITH {using('v_images', 'v_observations')}, {_rates(0.95)} SELECT * FROM rates"

# camera centre and rotation angle of a turn by (o_orderkey % 360) degrees about z
_STEPS = f"""{using('v_images')},
centers AS (SELECT flight_id, name, image_id, image_id % 360 AS deg,
   -cos((image_id % 360)*pi()/180)*tx AS x, sin((image_id % 360)*pi()/180)*tx AS y FROM v_images),
lagged AS (SELECT *, row_number() OVER w AS pos, lag(x) OVER w AS px, lag(y) OVER w AS py, lag(deg) OVER w AS pdeg
   FROM centers WINDOW w AS (PARTITION BY flight_id ORDER BY image_id)),
steps AS (SELECT flight_id, pos - 2 AS transition, name, 'frame_filename' AS ordered_by, sqrt((x-px)*(x-px) + (y-py)*(y-py)) AS step,
   CAST(least(abs(deg-pdeg), 360 - abs(deg-pdeg)) AS DOUBLE) AS rotation_deg FROM lagged WHERE pos > 1)"""

ORACLE["trajectory_steps"] = f"""
WITH {_STEPS} SELECT flight_id, transition, name, ordered_by, round(step, 4) AS step, round(rotation_deg, 4) AS rotation_deg FROM steps"""

_CUTOFF = """med AS (SELECT flight_id, median(step) AS median FROM steps GROUP BY 1),
mads AS (SELECT flight_id, median(abs(step - median)) AS mad FROM steps JOIN med USING (flight_id) GROUP BY 1),
cut AS (SELECT flight_id, median, CASE WHEN mad < 1e-7 THEN greatest(median*3, 1e-4) ELSE median + 3.5*mad END AS cutoff FROM med JOIN mads USING (flight_id))"""

ORACLE["pose_records"] = f"""
WITH {using('v_images')}
SELECT image_id, camera_id, replace(name, '.jpg', '') AS frame_id, name AS image_name, 'world_to_camera' AS pose_type,
       round(round(-cos((image_id % 360)*pi()/180)*tx, 6), 4) AS x, round(round(sin((image_id % 360)*pi()/180)*tx, 6), 4) AS y, 0e0 AS z FROM v_images"""

ORACLE["normalized_extrinsics"] = f"""
WITH {using('v_images')}
SELECT flight_id, image_id AS index, name AS image_name, replace(name, '.jpg', '') AS frame_id,
       round(round(-cos((image_id % 360)*pi()/180)*tx, 6), 4) AS x, round(round(sin((image_id % 360)*pi()/180)*tx, 6), 4) AS y, 0e0 AS z,
       round(round(abs(cos((image_id % 360)*pi()/360)), 6), 4) AS qw FROM v_images"""

ORACLE["jump_flags"] = f"""
WITH {_STEPS}, {_CUTOFF}
SELECT flight_id, transition, round(step, 4) AS step, round(median, 4) AS median, round(cutoff, 4) AS cutoff
FROM steps JOIN cut USING (flight_id) WHERE step > cutoff"""

ORACLE["trajectory_stats"] = f"""
WITH {_STEPS}, {_CUTOFF}
SELECT flight_id, count(*) AS transitions, min(ordered_by) AS ordered_by, round(avg(step), 4) AS mean_step, round(any_value(median), 4) AS median_step,
       round(max(step), 4) AS max_step, count(*) FILTER (step > cutoff) AS position_jumps, round(avg(rotation_deg), 4) AS mean_rotation_deg,
       round(median(rotation_deg), 4) AS median_rotation_deg, round(max(rotation_deg), 4) AS max_rotation_deg,
       count(*) FILTER (rotation_deg > 179.5) AS rotation_jumps,
       CASE WHEN count(*) FILTER (rotation_deg > 179.5) > 0 THEN 'WARNING' ELSE 'PASS' END AS status
FROM steps JOIN cut USING (flight_id) GROUP BY flight_id"""

ORACLE["pose_qa"] = f"""
WITH {_ERRORS}, {_stats(400.0)}, {_rates(0.9)}
SELECT CAST(r.flight_id AS BIGINT) AS model_id, registration_check, coalesce(reprojection_check, 'NOT_AVAILABLE') AS reprojection_check,
       CASE WHEN registered_images >= 2 THEN 'PASS' WHEN registered_images > 0 THEN 'FAIL' ELSE 'NOT_AVAILABLE' END AS trajectory_check,
       CASE WHEN registration_check = 'PASS' AND reprojection_check = 'PASS' AND registered_images >= 2 THEN 'PASS' ELSE 'FAIL' END AS validation_status,
       rmse_px, registration_rate
FROM rates r LEFT JOIN stats USING (flight_id)"""

ORACLE["frame_order"] = f"""
WITH {using('v_frames')}
SELECT video_id, source_idx, row_number() OVER (PARTITION BY video_id ORDER BY source_idx) AS pos, 'frame_filename' AS ordered_by,
       source_idx AS frame_key, 'frame_' || lpad(CAST(source_idx AS VARCHAR), 6, '0') AS frame_id FROM v_frames"""

_GATED = f"""{using('v_frames')},
gated AS (SELECT *, CASE WHEN NOT readable THEN 'unreadable' WHEN n <= 20 THEN NULL WHEN mean_brightness < 20 THEN 'too_dark'
   WHEN mean_brightness > 230 THEN 'too_bright' WHEN laplacian_variance < 10 THEN 'too_blurry' END AS reason
   FROM (SELECT *, count(*) OVER (PARTITION BY video_id) AS n FROM v_frames)),
manifest AS (SELECT video_id, source_idx, readable, passed = 0 AS fallback, CASE WHEN passed = 0 THEN readable ELSE reason IS NULL END AS accepted, reason
   FROM (SELECT *, count(*) FILTER (reason IS NULL) OVER (PARTITION BY video_id) AS passed FROM gated))"""

ORACLE["frame_gate"] = f"""
WITH {_GATED}
SELECT video_id, source_idx, CASE WHEN accepted THEN 'ACCEPTED' WHEN reason = 'unreadable' THEN 'REJECTED_UNREADABLE' ELSE 'REJECTED' END AS quality_status,
       CASE WHEN NOT accepted THEN reason END AS rejection_reason,
       CASE WHEN accepted THEN 'frame_' || lpad(CAST(CASE WHEN fallback THEN source_idx + 1 ELSE row_number() OVER (PARTITION BY video_id, accepted ORDER BY source_idx) END AS VARCHAR), 6, '0')
            WHEN reason = 'unreadable' THEN 'unusable_' || lpad(CAST(source_idx AS VARCHAR), 6, '0')
            ELSE 'rejected_' || lpad(CAST(source_idx AS VARCHAR), 6, '0') END AS frame_id
FROM manifest"""

ORACLE["frame_summary"] = f"""
WITH {_GATED}
SELECT video_id, count(*) AS input_frames, count(*) FILTER (accepted) AS accepted_frames, count(*) FILTER (NOT accepted) AS rejected_frames,
       round(count(*) FILTER (accepted)/count(*), 4) AS selection_ratio,
       {', '.join(f"count(*) FILTER (NOT accepted AND reason = '{r}') AS rejected_{r}" for r in ('unreadable', 'too_dark', 'too_bright', 'too_blurry', 'duplicate'))}
FROM manifest GROUP BY video_id"""

ORACLE["frame_budget"] = f"""
WITH {_GATED},
ranked AS (SELECT video_id, source_idx, reason IS NULL AS accepted,
   coalesce(sum(CASE WHEN reason IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY source_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
   FROM gated)
SELECT video_id, source_idx, accepted FROM ranked WHERE before < 15"""

ORACLE["stride_sample"] = f"""
WITH {using('v_frames')}
SELECT video_id, source_idx, name FROM (SELECT *, count(*) OVER (PARTITION BY video_id) AS n FROM v_frames)
WHERE source_idx % greatest(1, n // 20) = 0"""

ORACLE["uniform_subset"] = f"""
WITH {using('v_frames')},
placed AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY name) - 1 AS i, count(*) OVER (PARTITION BY video_id) AS n FROM v_frames),
picks AS (SELECT DISTINCT video_id, CASE WHEN n <= 20 THEN k ELSE CAST(round_even(k*(n-1)/19e0, 0) AS BIGINT) END AS i
   FROM (SELECT DISTINCT video_id, n FROM placed), range(20) r(k) WHERE k < n)
SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY i) - 1 AS new_index, i AS source_index, name FROM placed JOIN picks USING (video_id, i)"""

_CORR = """CASE WHEN abs((list_sum(list_transform(a, lambda x: x*x)) - list_sum(a)*list_sum(a)/len(a))*(list_sum(list_transform(b, lambda x: x*x)) - list_sum(b)*list_sum(b)/len(b))) <= 2.220446049250313e-16 THEN 1e0
 ELSE (list_inner_product(a, b) - list_sum(a)*list_sum(b)/len(a))
  / sqrt((list_sum(list_transform(a, lambda x: x*x)) - list_sum(a)*list_sum(a)/len(a))*(list_sum(list_transform(b, lambda x: x*x)) - list_sum(b)*list_sum(b)/len(b))) END"""

ORACLE["frame_dedupe"] = f"""
WITH RECURSIVE {using('v_hist')},
h AS (SELECT video_id, source_idx, CAST(hist AS DOUBLE[]) AS b, row_number() OVER (PARTITION BY video_id ORDER BY source_idx) AS pos FROM v_hist),
walk AS (
  SELECT video_id, source_idx, pos, b AS a, false AS is_duplicate, CAST(NULL AS DOUBLE) AS correlation FROM h WHERE pos = 1
  UNION ALL
  SELECT video_id, source_idx, pos, CASE WHEN c > 0.2 THEN a ELSE b END, c > 0.2, c
  FROM (SELECT h.video_id, h.source_idx, h.pos, w.a, h.b, {_CORR.replace('(a', '(w.a').replace(', b)', ', h.b)').replace('list_transform(b', 'list_transform(h.b').replace('list_sum(b)', 'list_sum(h.b)').replace('len(b)', 'len(h.b)')} AS c
        FROM walk w JOIN h ON h.video_id = w.video_id AND h.pos = w.pos + 1))
SELECT video_id, source_idx, is_duplicate, round(correlation, 4) AS correlation FROM walk"""

ORACLE["histogram_correlation"] = f"""
WITH {using('v_hist')}, two AS (SELECT p.source_idx, CAST(p.hist AS DOUBLE[]) AS a, CAST(q.hist AS DOUBLE[]) AS b
   FROM v_hist p JOIN v_hist q ON q.source_idx = p.source_idx + 1)
SELECT source_idx, round({_CORR}, 4) AS correlation FROM two"""

ORACLE["image_metrics"] = """
WITH px AS (SELECT vec_id AS source_idx, i, CAST(floor((CAST(list_extract(embedding, i + 1) AS DOUBLE) + 1)*120) AS BIGINT) % 256 AS v
   FROM embeddings, range(64) r(i)),
lap AS (SELECT c.source_idx, c.v AS v, u.v + d.v + l.v + g.v - 4*c.v AS q FROM px c
   JOIN px u ON u.source_idx = c.source_idx AND u.i = (CASE WHEN c.i // 8 = 0 THEN 1 ELSE c.i // 8 - 1 END)*8 + c.i % 8
   JOIN px d ON d.source_idx = c.source_idx AND d.i = (CASE WHEN c.i // 8 = 7 THEN 6 ELSE c.i // 8 + 1 END)*8 + c.i % 8
   JOIN px l ON l.source_idx = c.source_idx AND l.i = (c.i // 8)*8 + CASE WHEN c.i % 8 = 0 THEN 1 ELSE c.i % 8 - 1 END
   JOIN px g ON g.source_idx = c.source_idx AND g.i = (c.i // 8)*8 + CASE WHEN c.i % 8 = 7 THEN 6 ELSE c.i % 8 + 1 END)
SELECT source_idx, true AS readable, round(var_pop(q), 4) AS laplacian_variance, round(avg(v), 4) AS mean_brightness FROM lap GROUP BY source_idx"""

ORACLE["preflight"] = f"""
WITH {using('v_frames')},
dims AS (SELECT video_id, string_agg(s || ':' || c, ',' ORDER BY s) AS dimensions FROM
   (SELECT video_id, width || 'x' || height AS s, count(*) AS c FROM v_frames WHERE width > 0 GROUP BY 1, 2) GROUP BY 1),
t AS (SELECT video_id, count(*) AS n, count(*) FILTER (width < 1) AS bad FROM v_frames GROUP BY 1)
SELECT video_id, CASE WHEN n < 60 OR bad > 0 THEN 'FAIL' ELSE 'PASS' END AS status,
       CASE WHEN n < 60 THEN 'too few images' WHEN bad > 0 THEN 'unreadable images' END AS reason,
       n AS total_images, CAST(0 AS BIGINT) AS duplicate_names, bad AS unreadable_images, n - bad AS verified_readable, '.jpg' AS formats, coalesce(dimensions, '') AS dimensions
FROM t LEFT JOIN dims USING (video_id)"""

_KEPT = f"""{using('v_detections', 'v_mask_frames')},
kept AS (SELECT frame_id, det_no, class, confidence, greatest(0, CAST(trunc(x1) AS INTEGER)) AS x1, greatest(0, CAST(trunc(y1) AS INTEGER)) AS y1,
   least(160, CAST(trunc(x2) AS INTEGER)) AS x2, least(120, CAST(trunc(y2) AS INTEGER)) AS y2
   FROM v_detections WHERE lower(class) IN ({', '.join(repr(c) for c in DYNAMIC_CLASSES)}) AND confidence >= 0.25)"""
_COVER = f"""{_KEPT},
area AS (SELECT frame_id, count(*) AS masked_pixels FROM (SELECT DISTINCT frame_id, x, y FROM
   (SELECT frame_id, unnest(range(x1, x2)) AS x, y FROM (SELECT frame_id, x1, x2, unnest(range(y1, y2)) AS y FROM kept))) GROUP BY 1),
cover AS (SELECT video_id, f.frame_id, coalesce(d.n, 0) AS detections, coalesce(masked_pixels, 0) AS masked_pixels, coalesce(masked_pixels, 0)/(160*120) AS coverage
   FROM v_mask_frames f LEFT JOIN (SELECT frame_id, count(*) AS n FROM kept GROUP BY 1) d USING (frame_id) LEFT JOIN area USING (frame_id))"""

ORACLE["detections_filter"] = f"""
WITH {_KEPT} SELECT frame_id, det_no, class, round(confidence, 4) AS confidence, x1, y1, x2, y2 FROM kept"""
ORACLE["mask_coverage"] = f"""
WITH {_COVER} SELECT video_id, frame_id, detections, masked_pixels, round(coverage, 6) AS coverage FROM cover"""
ORACLE["mask_summary"] = f"""
WITH {_COVER} SELECT video_id, count(*) AS input_frames, count(*) FILTER (detections > 0 AND masked_pixels > 0) AS masked_frames,
  CAST(sum(detections) AS BIGINT) AS total_detections, round(avg(coverage), 4) AS mask_coverage FROM cover GROUP BY video_id"""

_DECIDED = f"""{using('v_attempts')},
decided AS (SELECT *, reject_reason IS NULL AS accepted FROM (SELECT *, CASE WHEN status IS NULL OR status <> 'PASS' THEN 'status ' || coalesce(status, 'missing')
   WHEN registered_images IS NULL OR registered_images < 2 THEN 'too few registered images'
   WHEN registration_rate IS NULL OR registration_rate < 0.8 THEN 'registration rate too low'
   WHEN reprojection_status = 'AVAILABLE' AND reprojection_rmse_px > 1.0 THEN 'reprojection error too high'
   WHEN trajectory_status IS NULL OR trajectory_status NOT IN ('PASS', 'AVAILABLE', 'WARNING') THEN 'trajectory not usable' END AS reject_reason FROM v_attempts))"""
ORACLE["candidate_decision"] = f"WITH {_DECIDED} SELECT scene_id, attempt_id, accepted, reject_reason FROM decided"
ORACLE["first_acceptable"] = f"""
WITH {_DECIDED},
n AS (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY ord, attempt_id) AS rn FROM decided),
w AS (SELECT scene_id, min(rn) FILTER (accepted) AS stop FROM n GROUP BY 1)
SELECT scene_id, CASE WHEN any_value(stop) IS NULL THEN 'FAIL' ELSE 'PASS' END AS status, max(CASE WHEN rn = stop THEN method END) AS selected_method,
       count(*) AS attempts_run, round(sum(runtime_seconds), 4) AS cumulative_runtime
FROM n JOIN w USING (scene_id) WHERE stop IS NULL OR rn <= stop GROUP BY scene_id"""

_METHODS = ("URGENT", "HIGH", "MEDIUM", "NOT SPECIFIED", "LOW")
_METRICS = ("registered_images", "registration_rate", "reprojection_rmse_px", "runtime_seconds")
ORACLE["backend_compare"] = f"""
WITH {using('v_attempts')},
f AS (SELECT * FROM v_attempts QUALIFY row_number() OVER (PARTITION BY scene_id, method ORDER BY ord, attempt_id) = 1),
l AS ({' UNION ALL '.join(f"SELECT scene_id, method, '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM f" for m in _METRICS)})
SELECT scene_id, metric, {', '.join(f"round(max(CASE WHEN method = '{m}' THEN value END), 4) AS {m.lower().replace(' ', '_')}" for m in _METHODS)}
FROM l GROUP BY scene_id, metric"""

_STATUS = f"""{using('v_run_events')},
seqd AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY ts_s, seq) AS rn FROM v_run_events),
walk AS (SELECT run_id, seq, rn, state, CASE WHEN status = 'FAILED' THEN 'FAIL' WHEN status = 'WARNING' THEN 'WARNING' ELSE 'PASS' END AS st, status FROM seqd WHERE rn = 1
   UNION ALL
   SELECT s.run_id, s.seq, s.rn, s.state, CASE WHEN s.status = 'FAILED' THEN 'FAIL' WHEN s.status = 'WARNING' THEN 'WARNING'
     WHEN w.st = 'WARNING' THEN 'WARNING' ELSE 'PASS' END, s.status FROM walk w JOIN seqd s ON s.run_id = w.run_id AND s.rn = w.rn + 1)"""
_RUN_STATUS = f"""
WITH RECURSIVE {_STATUS}
SELECT run_id, count(*) AS transitions, CASE WHEN arg_max(status, rn) = 'FAILED' THEN 'FAILED' ELSE arg_max(state, rn) END AS current_state,
       arg_max(st, rn) AS run_status, count(*) FILTER (status = 'FAILED') AS failed_stages, count(*) FILTER (status = 'WARNING') AS warning_stages
FROM walk GROUP BY run_id"""
ORACLE["run_status"] = _RUN_STATUS
ORACLE["run_durations"] = f"""
WITH {using('v_run_events')}
SELECT run_id, seq, row_number() OVER w AS pos, state, round(lead(ts_s) OVER w - ts_s, 4) AS duration_s FROM v_run_events
WINDOW w AS (PARTITION BY run_id ORDER BY ts_s, seq)"""
# the first end behind a start at which as many are open as before the start
ORACLE["run_pairs"] = f"""
WITH {using('v_run_events')},
e AS (SELECT *, seq % 5 < 3 AS starts, row_number() OVER (PARTITION BY run_id ORDER BY ts_s, seq) AS pos FROM v_run_events),
d AS (SELECT *, sum(CASE WHEN starts THEN 1 ELSE -1 END) OVER (PARTITION BY run_id, state ORDER BY pos) AS depth FROM e),
p AS (SELECT s.run_id, s.pos, s.state, s.ts_s AS started_at, x.ts_s AS completed_at, coalesce(x.status, 'RUNNING') AS status
      FROM d s LEFT JOIN d x ON s.run_id = x.run_id AND s.state = x.state AND NOT x.starts AND x.pos > s.pos AND x.depth = s.depth - 1
      WHERE s.starts QUALIFY row_number() OVER (PARTITION BY s.run_id, s.pos ORDER BY x.pos) = 1)
SELECT run_id, pos, state, round(started_at, 4) AS started_at, round(completed_at, 4) AS completed_at, status FROM p"""
ORACLE["report_status"] = f"""
WITH {using('v_run_events')}
SELECT run_id, CASE WHEN bool_or(status = 'FAILED') THEN 'FAILED' WHEN bool_or(status = 'WARNING') THEN 'COMPLETE_WITH_WARNINGS' ELSE 'COMPLETE' END AS report_status
FROM v_run_events GROUP BY run_id"""

_REQUIRED = "[" + ", ".join(repr(a) for a in SPLAT_ATTRIBUTES) + "]"
ORACLE["splat_attributes"] = f"""
WITH {using('v_headers')},
h AS (SELECT *, string_split(property_list, ',') AS props FROM v_headers),
m AS (SELECT *, list_filter({_REQUIRED}, lambda a: NOT list_contains(props, a)) AS missing FROM h)
SELECT file_id, CASE WHEN NOT is_ply OR num_vertices <= 0 THEN 'FAIL' WHEN len(missing) = 0 THEN 'PASS'
   WHEN list_contains(props, 'x') AND list_contains(props, 'y') AND list_contains(props, 'z') THEN 'WARNING' ELSE 'FAIL' END AS status,
   array_to_string(missing, ',') AS missing FROM m"""

ORACLE["pairs_sequential"] = f"""
WITH {using('v_frames')}, p AS (SELECT video_id, source_idx, row_number() OVER (PARTITION BY video_id ORDER BY name) AS pos FROM v_frames)
SELECT a.video_id, a.source_idx AS first_id, b.source_idx AS second_id FROM p a JOIN p b
ON a.video_id = b.video_id AND b.pos BETWEEN a.pos + 1 AND a.pos + 10"""
ORACLE["pairs_exhaustive"] = f"""
WITH {using('v_frames')}, p AS (SELECT video_id, source_idx, row_number() OVER (PARTITION BY video_id ORDER BY name) AS pos,
  count(*) OVER (PARTITION BY video_id) AS n FROM v_frames)
SELECT video_id, source_idx AS first_id, pos, pos + 1 AS partner_from, n AS partner_to, n - pos AS partners FROM p"""
ORACLE["pairs_similar"] = """
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
c AS (SELECT p.vec_id, q.vec_id AS similar_id, list_cosine_similarity(p.v, q.v) AS cosine FROM e p JOIN e q ON p.vec_id <> q.vec_id)
SELECT vec_id, row_number() OVER (PARTITION BY vec_id ORDER BY cosine DESC, similar_id) AS rank, similar_id, round(cosine, 4) AS cosine FROM c
QUALIFY rank <= 5"""

_STEM = r"lower(regexp_replace({0}, '\.[^.]*$', ''))"
_MATCH = f"""{using('v_frames', 'v_match_poses')},
im AS (SELECT video_id AS scene_id, name AS image_name, readable, width, height FROM v_frames),
keys AS (SELECT scene_id, 1 AS kind, lower(image_name) AS k, pose_no FROM v_match_poses
  UNION ALL SELECT scene_id, 2, {_STEM.format('image_name')}, pose_no FROM v_match_poses
  UNION ALL SELECT scene_id, 2, lower(frame_id), pose_no FROM v_match_poses),
last AS (SELECT scene_id, kind, k, max(pose_no) AS pose_no FROM keys GROUP BY ALL),
hit AS (SELECT im.*, coalesce(a.pose_no, b.pose_no) AS found FROM im
  LEFT JOIN last a ON a.scene_id = im.scene_id AND a.kind = 1 AND a.k = lower(im.image_name)
  LEFT JOIN last b ON b.scene_id = im.scene_id AND b.kind = 2 AND b.k = {_STEM.format('im.image_name')}),
matched AS (SELECT hit.*, CASE WHEN readable THEN found END AS pose_no,
  CASE WHEN NOT readable THEN 'unreadable' WHEN found IS NULL THEN 'no_pose' ELSE 'matched' END AS match_status FROM hit)"""
ORACLE["image_pose_match"] = f"""
WITH {_MATCH}
SELECT m.scene_id, m.image_name, m.pose_no, p.frame_id, match_status FROM matched m LEFT JOIN v_match_poses p ON p.scene_id = m.scene_id AND p.pose_no = m.pose_no"""


def _normalized(source: str) -> str:
    return f"""o AS (SELECT scene_id, avg(x) AS ox, avg(y) AS oy, avg(z) AS oz FROM {source} GROUP BY 1),
far AS (SELECT scene_id, any_value(ox) AS ox, any_value(oy) AS oy, any_value(oz) AS oz,
   sqrt(max((x-ox)*(x-ox) + (y-oy)*(y-oy) + (z-oz)*(z-oz))) AS d FROM {source} JOIN o USING (scene_id) GROUP BY 1),
norm AS (SELECT scene_id, ox, oy, oz, CASE WHEN d < 1e-6 THEN 1e0 ELSE 1/d END AS s FROM far)"""


ORACLE["scene_normalize"] = f"""
WITH {using('v_match_poses')}, {_normalized('v_match_poses')}
SELECT scene_id, pose_no, round(s*(x-ox), 4) AS x, round(s*(y-oy), 4) AS y, round(s*(z-oz), 4) AS z FROM v_match_poses JOIN norm USING (scene_id)"""
ORACLE["axes_flip"] = f"""
WITH {using('v_match_poses')},
a AS (SELECT *, (pose_no % 360)*pi()/180*CASE WHEN pose_type = 'world_to_camera' THEN -1 ELSE 1 END AS t FROM v_match_poses)
SELECT scene_id, pose_no, round(cos(t), 4) AS m0, round(sin(t) + 0e0, 4) AS m1, round(sin(t) + 0e0, 4) AS m3, round(-cos(t) + 0e0, 4) AS m4, -1e0 AS m8 FROM a"""
ORACLE["training_manifest"] = f"""
WITH {_MATCH}, used AS (SELECT m.*, p.frame_id, p.x, p.y, p.z FROM matched m JOIN v_match_poses p ON p.scene_id = m.scene_id AND p.pose_no = m.pose_no),
{_normalized('used')}
SELECT scene_id, row_number() OVER (PARTITION BY scene_id ORDER BY image_name, pose_no) AS colmap_im_id, 'images/' || image_name AS file_path, frame_id,
       round(s*(x-ox), 4) AS p0, round(s*(y-oy), 4) AS p1, round(s*(z-oz), 4) AS p2 FROM used JOIN norm USING (scene_id)"""

_DEPTH = """px AS (SELECT label AS scene_id, vec_id // 8 AS image_no, vec_id % 8 AS row, i AS col, CAST(list_extract(embedding, i + 1) AS DOUBLE) AS e
   FROM embeddings, range(64) r(i)),
cam AS (SELECT scene_id, image_no, row, col, (col - 32)*(e + 6)/50e0 - 1 AS u, (row - 4)*(e + 6)/40e0 - 2 AS v, e + 6 - 3 AS w FROM px WHERE abs(e)*60 >= 5),
world AS (SELECT scene_id, image_no, row, col, -0.28e0*u + 0.96e0*v AS x, -0.96e0*u - 0.28e0*v AS y, w AS z FROM cam)"""
ORACLE["depth_unproject"] = f"WITH {_DEPTH} SELECT scene_id, image_no, row, col, {_R4} FROM world"
ORACLE["capped_points"] = f"""
WITH {_DEPTH} SELECT scene_id, image_no, row, col, {_R4} FROM world
QUALIFY row_number() OVER (PARTITION BY scene_id ORDER BY image_no, row, col) <= 100"""

ORACLE["stream_status"] = _RUN_STATUS
ORACLE["stream_voxel"] = """
SELECT CAST(floor(event_id % 97/1e1) AS BIGINT) AS vx, CAST(floor(event_id % 89/1e1) AS BIGINT) AS vy, CAST(floor(value/1e1) AS BIGINT) AS vz,
       count(*) AS merged_points, round(avg(event_id % 97), 4) AS x, round(avg(event_id % 89), 4) AS y, round(avg(value), 4) AS z
FROM events GROUP BY 1, 2, 3"""
ORACLE["stream_sync"] = f"""
WITH {_SYNCED}
SELECT flight_id, frame_no, CASE WHEN matched THEN gps_seq END AS gps_seq, CASE WHEN matched THEN round(time_diff_s, 4) END AS time_diff_s, matched
FROM synced"""
ORACLE["stream_dedupe"] = ORACLE["frame_dedupe"]


def _fixed_rounding(sql: str) -> str:
    """Spell ``round(expr, n)`` as the arithmetic the Spark side uses."""
    at = 0
    while (at := sql.find("round(", at)) >= 0:
        if at and (sql[at - 1].isalnum() or sql[at - 1] == "_"):
            at += 1
            continue
        depth, end, comma = 0, at + 5, -1
        while True:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            if sql[end] == "," and depth == 1:
                comma = end
            if depth == 0:
                break
            end += 1
        value, digits = sql[at + 6: comma], int(sql[comma + 1: end])
        sql = f"{sql[:at]}(floor(({value})*1e{digits} + 0.500001e0)/1e{digits}){sql[end + 1:]}"
    return sql


ORACLE = {name: " ".join(_fixed_rounding(text).split()) for name, text in ORACLE.items()}


# -- files: what was written is what is read ---------------------------------------------------------------------

_SIZES = {name: size for name, size in CAMERA_MODELS.values()}
_N_PARAMS = "CASE model " + " ".join(f"WHEN '{n}' THEN {s}" for n, s in _SIZES.items()) + " END"
ORACLE["file_cameras_text"] = f"""
WITH {using('v_cameras')}
SELECT camera_id, model, CAST(1920 AS BIGINT) AS width, CAST(1080 AS BIGINT) AS height, {_N_PARAMS} AS n_params,
       CAST(list_sum(list_transform(range(1, {_N_PARAMS} + 1), lambda i: i * 100 + camera_id)) AS DOUBLE) AS total FROM v_cameras"""
ORACLE["file_images_text"] = f"""
WITH {using('v_images', 'v_observations')},
o AS (SELECT image_id, count(*) AS n, sum(point3d_id) AS ids, sum(px) AS px FROM v_observations GROUP BY image_id)
SELECT image_id, camera_id, name, CAST(coalesce(n, 0) AS INTEGER) AS n_observations, CAST(coalesce(ids, 0) AS BIGINT) AS point_ids,
       {', '.join(f'floor({c} * 1e4 + 0.500001) / 1e4 AS {c}' for c in ('qw', 'qz', 'tx'))}, round(coalesce(px, 0), 4) AS px
FROM v_images LEFT JOIN o USING (image_id)"""
ORACLE["file_points_text"] = f"""
WITH {using('v_points3d')} SELECT point3d_id, {_R4}, CAST(0 AS INTEGER) AS n_track FROM v_points3d"""
ORACLE["file_cameras_binary"] = ORACLE["file_cameras_text"]
ORACLE["file_images_binary"] = f"""
WITH {using('v_images', 'v_observations')},
o AS (SELECT image_id, count(*) AS n, sum(point3d_id) AS ids, sum(px) AS px FROM v_observations GROUP BY image_id),
t AS (SELECT image_id, camera_id, name, qw, qz * 0.5e0 AS qx, qw * -0.25e0 AS qy, qz, tx, tx + 1e0 AS ty, tx - 2e0 AS tz FROM v_images)
SELECT image_id, camera_id, name, CAST(coalesce(n, 0) AS INTEGER) AS n_observations, CAST(coalesce(ids, 0) AS BIGINT) AS point_ids,
       {', '.join(f'floor({c} * 1e4 + 0.500001) / 1e4 AS {c}' for c in ('qw', 'qx', 'qy', 'qz', 'tx', 'ty', 'tz'))}, round(coalesce(px, 0), 4) AS px
FROM t LEFT JOIN o USING (image_id)"""
ORACLE["file_points_binary"] = f"""
WITH {using('v_points3d', 'v_observations')},
k AS (SELECT point3d_id, count(*) AS n, sum(image_id * point2d_idx) AS ids FROM v_observations GROUP BY point3d_id)
SELECT point3d_id, {_R4}, {', '.join(f'CAST(point3d_id % {n} AS SMALLINT) AS {c}' for c, n in zip('rgb', (256, 251, 241)))},
       (point3d_id % 8) / 8e0 AS error, CAST(coalesce(n, 0) AS INTEGER) AS n_track, CAST(coalesce(ids, 0) AS BIGINT) AS track_ids
FROM v_points3d LEFT JOIN k USING (point3d_id)"""
ORACLE["file_pose_json"] = ORACLE["pose_records"]
ORACLE["file_gps_csv"] = f"""
WITH {using('v_gps')} SELECT flight_id, {', '.join(f'floor({c} * 1e4 + 0.500001) / 1e4 AS {c}' for c in ('ts_s', 'lat', 'lon', 'alt'))} FROM v_gps"""
ORACLE["file_ply_binary"] = ORACLE["file_ply_ascii"] = f"""
WITH {using('v_points_big')}
SELECT {', '.join(f'floor({c} * 1e4 + 0.500001) / 1e4 AS {c}' for c in _XYZ)}, {', '.join(f'CAST({c} AS SMALLINT) AS {c}' for c in 'rgb')} FROM v_points_big"""
