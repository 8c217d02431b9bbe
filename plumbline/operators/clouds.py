"""Point-cloud validation, outlier removal, voxel grid and ground plane, many clouds per call."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.neighbors import mean_distances, radius_counts
from plumbline.session import cut

_AXES = ("x", "y", "z")
LOW_RETENTION = 0.30


def is_finite(column: Column) -> Column:
    return column.isNotNull() & ~F.isnan(column) & (F.abs(column) != float("inf"))


def validate_clouds(points: DataFrame, key: str = "cloud_id") -> DataFrame:
    """One row of metrics per cloud; a cloud with a non-finite coordinate gets status ERROR.

    Copies are merged first, so distinct counting is one ordinary two-level aggregation.
    """
    has_colors = {"r", "g", "b"} <= set(points.columns)
    colors = [F.col(c) for c in ("r", "g", "b")] if has_colors else [F.lit(None).cast("int")] * 3
    good_color = reduce(lambda a, b: a & b, [c.between(0, 255) for c in colors])
    finite = reduce(lambda a, b: a & b, [is_finite(F.col(a)) for a in _AXES])
    places = points.groupBy(key, *_AXES).agg(
        F.count(F.lit(1)).alias("copies"),
        F.bool_or(colors[0].isNotNull()).alias("colored"),
        F.bool_and(good_color).alias("good_color"),
    )
    sums = places.groupBy(key).agg(
        F.sum("copies").alias("num_points"),
        F.count(F.lit(1)).alias("unique_points"),
        F.bool_and(finite).alias("finite"),
        F.bool_or("colored").alias("rgb_available"),
        F.coalesce(F.bool_and("good_color"), F.lit(False)).alias("rgb_valid"),
        *[F.min(a).alias(f"min_{a}") for a in _AXES],
        *[F.max(a).alias(f"max_{a}") for a in _AXES],
    )
    extents = {a: F.col(f"max_{a}") - F.col(f"min_{a}") for a in _AXES}
    volume = extents["x"] * extents["y"] * extents["z"]
    duplicates = F.col("num_points") - F.col("unique_points")
    flat = reduce(lambda a, b: a | b, [e <= 1e-6 for e in extents.values()])
    warnings = F.array_compact(F.array(
        F.when(flat, "near-zero spatial extent in one or more dimensions"),
        F.when(duplicates > 0, F.concat(F.lit("duplicate coordinates: "), duplicates.cast("string"))),
        F.when(F.col("rgb_available") & ~F.col("rgb_valid"), "colour values outside 0..255"),
    ))
    return sums.select(
        key,
        F.when(~F.col("finite"), "ERROR").when(F.size(warnings) > 0, "WARNING").otherwise("PASS").alias("status"),
        F.when(~F.col("finite"), "coordinates contain NaN or infinite values").alias("reason"),
        "num_points",
        "unique_points",
        duplicates.alias("duplicate_points"),
        *[f"min_{a}" for a in _AXES],
        *[f"max_{a}" for a in _AXES],
        *[e.alias(f"extent_{a}") for a, e in extents.items()],
        volume.alias("volume"),
        F.when(volume > 1e-12, F.col("num_points") / volume).otherwise(0.0).alias("density"),
        "rgb_available",
        (F.col("rgb_available") & F.col("rgb_valid")).alias("rgb_valid"),
        warnings.alias("warnings"),
    )


def _judged_statistically(points: DataFrame, k: int, ratio: float, key: str) -> DataFrame:
    """(key, x, y, z, mean_distance, cutoff, skipped, keep) per distinct place."""
    if k <= 0:
        raise ValueError(f"number of neighbours must be positive, got {k}")
    if ratio <= 0:
        raise ValueError(f"ratio must be positive, got {ratio}")
    scored = cut(mean_distances(points, k, key))
    positive = F.col("mean_distance") > 0
    centers = scored.groupBy(key).agg(
        F.sum("weight").alias("_n"),
        (F.sum(F.when(positive, F.col("mean_distance") * F.col("weight")).otherwise(0.0)) / F.sum("weight")).alias("_mu"),
    )
    squares = F.when(positive, F.pow(F.col("mean_distance") - F.col("_mu"), 2) * F.col("weight")).otherwise(0.0)
    limits = scored.join(centers, key).groupBy(key, "_n", "_mu").agg(F.sum(squares).alias("_sq")).select(
        key,
        (F.col("_mu") + ratio * F.sqrt(F.col("_sq") / F.nullif(F.col("_n") - 1, F.lit(0)))).alias("cutoff"),
        (F.col("_n") <= k).alias("skipped"),
    )
    return scored.join(limits, key).select(
        key, *_AXES, "mean_distance", "cutoff", "skipped",
        (F.col("skipped") | (positive & (F.col("mean_distance") < F.col("cutoff")))).alias("keep"),
    )


def _without_places(points: DataFrame, judged: DataFrame, key: str) -> DataFrame:
    """Points at places that are judged and kept. The places that are not kept are few, so only those are joined."""
    dropped = cut(judged.filter("keep IS NULL OR NOT keep").select(key, *_AXES))
    return _placed(points, key).join(dropped, [key, *_AXES], "left_anti")


def _placed(points: DataFrame, key: str) -> DataFrame:
    """Points that have a cloud and a place."""
    placed = reduce(lambda a, b: a & b, [F.col(a).isNotNull() & ~F.isnan(a) for a in _AXES])
    return points.filter(placed & F.col(key).isNotNull())


def statistical_scores(points: DataFrame, k: int, ratio: float, key: str = "cloud_id") -> DataFrame:
    """Each point with its mean neighbour distance and whether it is kept.

    The ``k`` neighbours include the point itself. A mean of zero (a point in a heap of ``k`` or more copies)
    never passes and adds nothing to the sums, but counts in the divisors. Clouds of at most ``k`` points pass whole.
    """
    return points.join(_judged_statistically(points, k, ratio, key), [key, *_AXES])


def remove_statistical_outliers(points: DataFrame, k: int = 20, ratio: float = 2.0, key: str = "cloud_id") -> DataFrame:
    return _without_places(points, _judged_statistically(points, k, ratio, key), key)


def _judged_by_radius(points: DataFrame, radius: float, min_points: int, key: str) -> DataFrame:
    """(key, x, y, z, skipped, keep) per distinct place."""
    if radius <= 0:
        raise ValueError(f"radius must be positive, got {radius}")
    if min_points <= 0:
        raise ValueError(f"minimum point count must be positive, got {min_points}")
    counted = radius_counts(points, radius, key, enough=min_points)
    return counted.join(_sizes(points, min_points, key), key).select(
        key, *_AXES, "skipped", (F.col("skipped") | (F.col("neighbors") > min_points)).alias("keep")
    )


def _sizes(points: DataFrame, min_points: int, key: str) -> DataFrame:
    return points.groupBy(key).agg((F.count(F.lit(1)) < min_points).alias("skipped"))


def radius_scores(points: DataFrame, radius: float, min_points: int = 10, key: str = "cloud_id") -> DataFrame:
    """Each point with whether more than ``min_points`` points, itself included, lie within ``radius``."""
    judged = _judged_by_radius(points, radius, min_points, key)
    dropped = cut(judged.filter("NOT keep").select(key, *_AXES, F.lit(False).alias("keep")))
    marked = _placed(points, key).join(dropped, [key, *_AXES], "left").join(_sizes(points, min_points, key), key)
    return marked.select(key, *_AXES, *[c for c in points.columns if c not in (key, *_AXES)], "skipped", F.coalesce("keep", F.lit(True)).alias("keep"))


def remove_radius_outliers(points: DataFrame, radius: float, min_points: int = 10, key: str = "cloud_id") -> DataFrame:
    return _without_places(points, _judged_by_radius(points, radius, min_points, key), key)


def voxel_downsample(
    points: DataFrame, size: float, key: str = "cloud_id", origin: Sequence[float] | None = None
) -> DataFrame:
    """Mean point per cubic cell; the grid starts half a cell below the smallest coordinates unless told otherwise.

    Colours are averaged and truncated. Every cell is reduced on the map side first.
    """
    if size <= 0:
        raise ValueError(f"voxel size must be positive, got {size}")
    has_colors = {"r", "g", "b"} <= set(points.columns)
    used = points.select(key, *_AXES, *(("r", "g", "b") if has_colors else ()))
    if origin is None:
        starts = used.groupBy(key).agg(*[(F.min(a) - size / 2).alias(f"_o{a}") for a in _AXES])
        placed = used.join(starts, key)
        corner = [F.col(f"_o{a}") for a in _AXES]
    else:
        placed, corner = used, [F.lit(float(o)) for o in origin]
    cells = [F.floor((F.col(a) - o) / size).alias(f"v{a}") for a, o in zip(_AXES, corner)]
    means = [F.avg(a).alias(a) for a in _AXES]
    if has_colors:
        means += [F.floor(F.avg(c)).cast("int").alias(c) for c in ("r", "g", "b")]
    return placed.groupBy(key, *cells).agg(F.count(F.lit(1)).alias("merged_points"), *means)


def voxel_warnings(cloud_meta: DataFrame, key: str = "cloud_id") -> DataFrame:
    """Clouds whose voxel size is in arbitrary units because they are not georeferenced."""
    return cloud_meta.filter(~F.coalesce("is_georeferenced", F.lit(False))).select(
        key, F.lit("voxel size is in local, unscaled units").alias("warning")
    )


def _draw(*parts: Column) -> Column:
    """32 bits of a hash that is spelled alike in every engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 8), 16, 10).cast("bigint")


def _triples(iterations: int, seed: int) -> Column:
    """``array<struct(hypothesis, p, q, r)>`` of three different entries of ``ps`` for each hypothesis."""
    n = F.size("ps")

    def steps(h: Column) -> Column:
        first, second, third = (_draw(F.lit(seed), h, F.lit(k)) for k in (1, 2, 3))
        return F.struct(h.cast("bigint").alias("h"), first.alias("at"), (1 + second % (n - 1)).alias("s"), (1 + third % (n - 2)).alias("w"))

    def corners(d: Column) -> Column:
        places = (F.lit(0), d["s"], d["w"] + F.when(d["w"] >= d["s"], 1).otherwise(0))
        ends = [F.get("ps", ((d["at"] + place) % n).cast("int")).alias(name) for place, name in zip(places, "pqr")]
        return F.struct(d["h"].alias("hypothesis"), *ends)

    return F.transform(F.transform(F.sequence(F.lit(0), F.lit(iterations - 1)), steps), corners)


def _planes(triples: DataFrame, key: str) -> DataFrame:
    """``(key, hypothesis, a, b, c, d)``: the unit plane through ``p, q, r``; three points on a line have none."""
    u, v = ([F.col(f"{end}.{axis}") - F.col(f"p.{axis}") for axis in _AXES] for end in "qr")
    normal = [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
    raw = triples.select(key, "hypothesis", "p", *[c.alias(n) for c, n in zip(normal, "abc")])
    length = F.sqrt(F.col("a") * F.col("a") + F.col("b") * F.col("b") + F.col("c") * F.col("c"))
    offset = -(F.col("a") * F.col("p.x") + F.col("b") * F.col("p.y") + F.col("c") * F.col("p.z"))
    sized = raw.select("*", length.alias("_length"), offset.alias("d")).filter("_length > 1e-12")
    return sized.select(key, "hypothesis", *[(F.col(c) / F.col("_length")).alias(c) for c in "abcd"])


def ground_planes(
    points: DataFrame,
    distance: float = 0.2,
    iterations: int = 1000,
    seed: int = 0,
    key: str = "cloud_id",
    id_column: str = "point_id",
    chunk_points: int = 100_000,
) -> DataFrame:
    """The plane through three sampled points that most points of the cloud lie near, per cloud.

    Points are drawn in the order of a hash of their id, and the corners of hypothesis ``h`` by hashes of ``h``, so any
    engine can repeat a run. All hypotheses of a cloud are counted in one pass over salted chunks of its points.
    """
    key_type = dict(points.dtypes)[key]
    narrow = points.select(key, F.col(id_column).alias("id"), *_AXES)
    sizes = narrow.groupBy(key).agg(F.count(F.lit(1)).alias("num_points"))
    wanted = 3 * iterations
    # a hash threshold keeps about eight times the wanted number, so the ranking below is small for any cloud
    share = F.least(F.lit(1.0), F.lit(8.0 * wanted) / F.col("num_points"))
    drawn = narrow.join(sizes, key).withColumn("_h", _draw(F.lit(seed), F.col("id"))).filter(F.col("_h") < share * float(1 << 32))
    by_cloud = Window.partitionBy(key).orderBy("_h", "id", *_AXES)
    corner = F.struct(F.row_number().over(by_cloud).alias("rank"), *_AXES)
    ranked = drawn.select(key, corner.alias("p")).filter(F.col("p.rank") <= wanted)
    # at most ``wanted`` corners a cloud
    corners = ranked.groupBy(key).agg(F.array_sort(F.collect_list("p")).alias("ps")).filter(F.size("ps") >= 3)
    planes = cut(_planes(corners.select(key, F.inline(_triples(iterations, seed))), key))
    chunks = sizes.withColumn("_chunks", F.ceil(F.col("num_points") / chunk_points).cast("int")).select(key, "_chunks")
    salted_points = narrow.join(chunks, key).withColumn(
        "_salt", F.pmod(F.xxhash64("id", *_AXES), F.col("_chunks")).cast("int")
    )
    copies = chunks.select(key, F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)).alias("_copy"))
    salted_planes = cut(planes.join(copies, key))

    def count_near(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame(columns=[key, "hypothesis", "inliers"])
        normals = right[["a", "b", "c"]].to_numpy()
        counts = np.zeros(len(right), dtype=np.int64)
        xyz = left[list(_AXES)].to_numpy()
        for start in range(0, len(xyz), 4096):
            gap = np.abs(xyz[start: start + 4096] @ normals.T + right["d"].to_numpy())
            counts += (gap < distance).sum(axis=0)
        return pd.DataFrame({key: right[key], "hypothesis": right["hypothesis"], "inliers": counts})

    votes = (
        salted_points.groupBy(key, "_salt").cogroup(salted_planes.groupBy(key, "_copy"))
        .applyInPandas(count_near, f"{key} {key_type}, hypothesis bigint, inliers bigint")
        .groupBy(key, "hypothesis").agg(F.sum("inliers").alias("inliers"))
    )
    plane = F.struct("a", "b", "c", "d", "inliers")
    best = votes.join(planes, [key, "hypothesis"]).groupBy(key).agg(
        F.max_by(plane, F.struct("inliers", -F.col("hypothesis"))).alias("p")
    )
    return best.join(sizes, key).select(
        key, *[F.round(f"p.{c}", 6).alias(c) for c in ("a", "b", "c", "d")],
        F.col("p.inliers").alias("ground_inliers"), "num_points",
        F.round(F.col("p.inliers") / F.col("num_points"), 4).alias("ground_fraction"),
        F.lit("ANALYZED_NOT_FILTERED").alias("status"),
    )


def stage_counts(stages: Sequence[tuple[str, DataFrame]], key: str = "cloud_id") -> DataFrame:
    """Points per cloud after each named stage, as ``(key, stage_no, stage, points)``."""
    parts = [
        df.groupBy(key).agg(F.count(F.lit(1)).alias("points"))
        .select(key, F.lit(i).alias("stage_no"), F.lit(name).alias("stage"), "points")
        for i, (name, df) in enumerate(stages)
    ]
    return reduce(DataFrame.unionByName, parts)


def stage_report(counts: DataFrame, names: Sequence[str], key: str = "cloud_id") -> DataFrame:
    """Removed points and retention from stage to stage and against the input.

    A cloud that a stage emptied has no row in ``counts``; the list of stages is completed with zero first.
    """
    listed = F.array(*[F.struct(F.lit(i).alias("stage_no"), F.lit(n).alias("stage")) for i, n in enumerate(names)])
    grid = counts.select(key).distinct().select(key, F.inline(listed))
    full = grid.join(counts, [key, "stage_no", "stage"], "left").fillna(0, ["points"])
    order = Window.partitionBy(key).orderBy("stage_no")
    before = F.lag("points").over(order)
    at_start = F.first("points").over(order)
    retention = F.when(at_start > 0, F.col("points") / at_start).otherwise(0.0)
    return full.select(
        key, "stage_no", "stage", "points",
        (F.coalesce(before, F.col("points")) - F.col("points")).alias("removed_points"),
        F.when(before > 0, F.col("points") / before).otherwise(1.0).alias("stage_retention"),
        retention.alias("total_retention"),
        (retention < LOW_RETENTION).alias("excessive_removal"),
    )


def transform_points(points: DataFrame, alignment: DataFrame, key: str = "cloud_id") -> DataFrame:
    """Apply the similarity of each cloud, ``scale * R * p + t``; clouds without one pass unchanged."""
    a = alignment.select(F.col(key), F.struct("scale", "r", "t").alias("_a"))
    joined = points.join(a, key, "left")
    moved = []
    for i, axis in enumerate(_AXES):
        turned = sum((F.col("_a.r")[i][j] * F.col(_AXES[j]) for j in (1, 2)), F.col("_a.r")[i][0] * F.col("x"))
        moved.append(F.coalesce(F.col("_a.scale") * turned + F.col("_a.t")[i], F.col(axis)).alias(axis))
    return joined.select(*[c for c in points.columns if c not in _AXES], *moved)


def georeference_meta(cloud_meta: DataFrame, alignment: DataFrame, key: str = "cloud_id") -> DataFrame:
    """Coordinate system, units and convention of the clouds after :func:`transform_points`."""
    placed = F.col("_crs").isNotNull() & ~F.coalesce(F.col("is_georeferenced"), F.lit(False))
    joined = cloud_meta.join(alignment.select(key, F.col("target_crs").alias("_crs")), key, "left")
    return joined.select(
        *[c for c in cloud_meta.columns if c not in ("crs", "units", "convention", "is_georeferenced")],
        F.when(placed, F.col("_crs")).otherwise(F.col("crs")).alias("crs"),
        F.when(placed, "metres").otherwise(F.col("units")).alias("units"),
        F.when(placed, "georeferenced").otherwise(F.col("convention")).alias("convention"),
        (placed | F.coalesce("is_georeferenced", F.lit(False))).alias("is_georeferenced"),
    )
