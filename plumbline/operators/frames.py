"""Frame quality gate, near-duplicate removal, budgets, stable ids and selection summaries."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.names import padded
from plumbline.operators.ordering import largest_group, measured, with_position
from plumbline.params import IMAGE_EXTENSIONS, FrameGate
from plumbline.session import cut

REASONS = ("unreadable", "too_dark", "too_bright", "too_blurry", "duplicate")
#: frames of one video that one task scans
CHUNK_FRAMES = 4096
_EPSILON = 2.220446049250313e-16
_BLOCK = 64


def gate_frames(frames: DataFrame, gate: FrameGate = FrameGate(), key: str = "video_id") -> DataFrame:
    """Add ``gate_reason``: unreadable always counts, quality only in videos with enough inputs; first match wins."""
    totals = frames.groupBy(key).agg(F.count(F.lit(1)).alias("input_frames"))
    gated = F.col("input_frames") > gate.min_inputs_for_gating
    reason = (
        F.when(~F.col("readable"), "unreadable")
        .when(gated & (F.col("mean_brightness") < gate.min_brightness), "too_dark")
        .when(gated & (F.col("mean_brightness") > gate.max_brightness), "too_bright")
        .when(gated & (F.col("laplacian_variance") < gate.blur_threshold), "too_blurry")
    )
    return frames.join(totals, key).withColumn("gate_reason", reason)


def _scan(histograms: np.ndarray, incoming: np.ndarray | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Accept flags and correlations with the last accepted frame, in order."""
    def center(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        centered = h - h.mean(axis=-1, keepdims=True)
        return centered, (centered * centered).sum(axis=-1)

    values, spread = center(histograms)
    accepted = np.zeros(len(values), dtype=bool)
    score = np.full(len(values), np.nan)
    if incoming is None:
        accepted[0] = True
        last, last_spread, at = values[0], spread[0], 1
    else:
        last, last_spread = center(incoming)
        at = 0
    while at < len(values):
        # look ahead in blocks; everything up to the next accepted frame is compared with the same frame
        block = slice(at, at + _BLOCK)
        product = spread[block] * last_spread
        safe = np.where(product > _EPSILON, product, 1.0)
        correlation = np.where(product > _EPSILON, values[block] @ last / np.sqrt(safe), 1.0)
        hits = np.flatnonzero(correlation <= threshold)
        stop = hits[0] + 1 if len(hits) else len(correlation)
        score[at: at + stop] = correlation[:stop]
        at += stop
        if len(hits):
            accepted[at - 1] = True
            last, last_spread = values[at - 1], spread[at - 1]
    return accepted, score


def drop_near_duplicates(
    frames: DataFrame,
    threshold: float,
    key: str = "video_id",
    order: str = "source_idx",
    histogram: str = "hist",
    chunk_frames: int = CHUNK_FRAMES,
) -> DataFrame:
    """Add ``is_duplicate`` and ``correlation`` against the last accepted frame of the video.

    Each decision depends on the one before it, so a long video is cut into chunks that are first scanned as if
    nothing came before. A chunk is scanned again only when the last accepted frame before it turns out to be
    another one than assumed; when no assumption changes any more, the result is that of one long scan.
    ``order`` must be unique within a video.
    """
    types = dict(frames.dtypes)
    narrow = frames.select(key, order, F.col(histogram).alias("hist"))
    group = f"{key} {types[key]}, {order} {types[order]}"

    def stacked(frame: pd.DataFrame) -> np.ndarray:
        return np.stack(frame["hist"].to_numpy()).astype(np.float64)

    def decide(frame: pd.DataFrame, incoming: np.ndarray | None) -> pd.DataFrame:
        frame = frame.sort_values(order)
        accepted, score = _scan(stacked(frame), incoming, threshold)
        return pd.DataFrame({
            key: frame[key], order: frame[order], "is_duplicate": ~accepted, "correlation": score
        })

    flags = f"{group}, is_duplicate boolean, correlation double"
    tidy = lambda df: df.withColumn("correlation", F.nanvl("correlation", F.lit(None)))
    if largest_group(narrow, [key]) <= chunk_frames:
        decided = narrow.groupBy(key).applyInPandas(lambda frame: decide(frame, None), flags)
        return frames.join(tidy(decided), [key, order])

    placed = with_position(narrow, [key], [F.col(order)])
    placed = cut(placed.withColumn("chunk", F.floor((F.col("pos") - 1) / chunk_frames)).drop("pos"))
    state_schema = (
        f"{key} {types[key]}, chunk bigint, in_id {types[order]}, out_id {types[order]}, out_hist array<double>"
    )

    def assumption(right: pd.DataFrame) -> tuple[object, np.ndarray | None]:
        if right.empty or right["in_hist"].iloc[0] is None:
            return None, None
        return right["in_id"].iloc[0], np.asarray(right["in_hist"].iloc[0], dtype=np.float64)

    def outcome(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty:
            return pd.DataFrame(columns=[key, "chunk", "in_id", "out_id", "out_hist"])
        left = left.sort_values(order)
        in_id, incoming = assumption(right)
        values = stacked(left)
        accepted, _ = _scan(values, incoming, threshold)
        last = np.flatnonzero(accepted)
        out_id = left[order].iloc[last[-1]] if len(last) else in_id
        out_hist = values[last[-1]] if len(last) else incoming
        return pd.DataFrame({
            key: [left[key].iloc[0]], "chunk": [left["chunk"].iloc[0]], "in_id": pd.Series([in_id], dtype=object),
            "out_id": pd.Series([out_id], dtype=object), "out_hist": [out_hist],
        })

    def run(rows: DataFrame, assumed: DataFrame) -> DataFrame:
        return rows.groupBy(key, "chunk").cogroup(assumed.groupBy(key, "chunk")).applyInPandas(outcome, state_schema)

    chunks = placed.select(key, "chunk").distinct()
    nothing = chunks.select(
        key, "chunk", F.lit(None).cast(types[order]).alias("in_id"), F.lit(None).cast("array<double>").alias("in_hist")
    )
    state = cut(run(placed, nothing))
    while True:
        before = state.select(
            key, (F.col("chunk") + 1).alias("chunk"), F.col("out_id").alias("want_id"), F.col("out_hist").alias("in_hist")
        )
        changed = state.join(before, [key, "chunk"]).filter(~F.col("want_id").eqNullSafe(F.col("in_id"))).select(
            key, "chunk", F.col("want_id").alias("in_id"), "in_hist"
        )
        changed = cut(changed)
        if changed.isEmpty():
            break
        redone = run(placed.join(changed.select(key, "chunk"), [key, "chunk"], "left_semi"), changed)
        state = cut(state.join(changed, [key, "chunk"], "left_anti").unionByName(redone))
    settled = state.select(key, (F.col("chunk") + 1).alias("chunk"), F.col("out_id").alias("in_id"), F.col("out_hist").alias("in_hist"))

    def final(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty:
            return pd.DataFrame(columns=[key, order, "is_duplicate", "correlation"])
        return decide(left, assumption(right)[1])

    decided = placed.groupBy(key, "chunk").cogroup(settled.groupBy(key, "chunk")).applyInPandas(final, flags)
    return frames.join(tidy(decided), [key, order])


def select_frames(
    frames: DataFrame, gate: FrameGate = FrameGate(), key: str = "video_id", order: str = "source_idx"
) -> DataFrame:
    """The manifest: every frame with quality status, rejection reason and stable frame id.

    A video in which nothing is accepted keeps all readable frames, numbered by their place in the source.
    """
    gated = gate_frames(frames, gate, key)
    if gate.duplicate_threshold is not None:
        gated = cut(gated)
        checked = F.col("gate_reason").isNull() & (F.col("input_frames") > gate.min_inputs_for_gating)
        flagged = drop_near_duplicates(gated.filter(checked), gate.duplicate_threshold, key, order)
        twins = flagged.filter("is_duplicate").select(key, order, F.lit("duplicate").alias("_twin"))
        gated = gated.join(twins, [key, order], "left").withColumn(
            "gate_reason", F.coalesce("gate_reason", "_twin")
        ).drop("_twin")
    counts = gated.groupBy(key).agg(F.count_if(F.col("gate_reason").isNull()).alias("_passed"))
    tagged = gated.join(counts, key)
    fallback = F.col("_passed") == 0
    accepted = F.when(fallback, F.col("readable")).otherwise(F.col("gate_reason").isNull())
    tagged = tagged.withColumn("accepted", accepted).withColumn("fallback", fallback)
    limit = measured(frames, [key])
    ranked = with_position(tagged, [key, "accepted"], [F.col(order)], name="_rank", hot_rows=limit)
    number = F.when(F.col("fallback"), F.col(order) + 1).otherwise(F.col("_rank"))
    frame_id = (
        F.when(F.col("accepted"), F.concat(F.lit("frame_"), padded(number)))
        .when(F.col("gate_reason") == "unreadable", F.concat(F.lit("unusable_"), padded(F.col(order))))
        .otherwise(F.concat(F.lit("rejected_"), padded(F.col(order))))
    )
    status = (
        F.when(F.col("accepted"), "ACCEPTED")
        .when(F.col("gate_reason") == "unreadable", "REJECTED_UNREADABLE")
        .otherwise("REJECTED")
    )
    return ranked.select(
        *frames.columns, "input_frames", "accepted", "fallback", status.alias("quality_status"),
        F.when(~F.col("accepted"), F.col("gate_reason")).alias("rejection_reason"), frame_id.alias("frame_id"),
    )


def selection_summary(manifest: DataFrame, key: str = "video_id") -> DataFrame:
    """Inputs, accepted, rejected, ratio and rejections by reason per video."""
    per_reason = [F.count_if(F.col("rejection_reason") == r).alias(f"rejected_{r}") for r in REASONS]
    sums = manifest.groupBy(key).agg(
        F.count(F.lit(1)).alias("input_frames"), F.count_if("accepted").alias("accepted_frames"), *per_reason
    )
    return sums.select(
        key, "input_frames", "accepted_frames",
        (F.col("input_frames") - F.col("accepted_frames")).alias("rejected_frames"),
        (F.col("accepted_frames") / F.col("input_frames")).alias("selection_ratio"),
        *[f"rejected_{r}" for r in REASONS],
    )


def stride_sample(frames: DataFrame, target: int, key: str = "video_id", order: str = "source_idx") -> DataFrame:
    """Every n-th frame, n chosen per video so that about twice the target number is looked at."""
    totals = frames.groupBy(key).agg(F.count(F.lit(1)).alias("_total"))
    stride = F.greatest(F.lit(1), F.floor(F.col("_total") / (2 * target)))
    return frames.join(totals, key).filter(F.col(order) % stride == 0).drop("_total")


def within_budget(
    scanned: DataFrame, target: int, key: str = "video_id", order: str = "source_idx", accepted: str = "accepted",
    hot_rows: float | None = None,
) -> DataFrame:
    """Frames looked at before the scan stops, which it does at the frame that fills 1.5 times the target."""
    limit = math.ceil(1.5 * target)
    kept = with_position(
        scanned.filter(accepted).select(key, order), [key], [F.col(order)], name="_rank", hot_rows=hot_rows)
    last = kept.filter(F.col("_rank") == limit).select(key, F.col(order).alias("_stop"))
    joined = scanned.join(last, key, "left")
    return joined.filter(F.col("_stop").isNull() | (F.col(order) <= F.col("_stop"))).drop("_stop")


def uniform_subset(
    items: DataFrame, maximum: int, key: str, order: Sequence[Column], hot_rows: float | None = None
) -> DataFrame:
    """At most ``maximum`` evenly spaced rows per key, first and last included, renumbered as ``new_index``."""
    placed = with_position(items, [key], order, hot_rows=hot_rows)
    totals = items.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    n = F.col("_n")
    if maximum == 1:
        picked = F.array(F.lit(1).cast("bigint"))
    else:
        steps = F.sequence(F.lit(0), F.least(F.lit(maximum), n) - 1)
        spaced = F.array_distinct(F.transform(
            steps, lambda i: F.bround(i.cast("double") * (n - 1) / (maximum - 1)).cast("bigint") + 1))
        picked = F.when(n <= maximum, F.transform(steps, lambda i: i + 1)).otherwise(spaced)
    wanted = totals.select(key, F.posexplode(picked).alias("new_index", "pos"))
    return placed.join(wanted, [key, "pos"]).withColumn("source_index", F.col("pos") - 1).drop("pos")


def preflight(images: DataFrame, minimum: int = 20, key: str = "video_id") -> DataFrame:
    """Directory checks before any reconstruction: ``images`` has ``name, width, height`` (width below 1: unreadable)."""
    extension = F.lower(F.regexp_extract("name", r"(\.[^.]+)$", 1))
    usable = images.withColumn("_ext", extension).filter(F.col("_ext").isin(*IMAGE_EXTENSIONS))
    per_name = usable.groupBy(key, F.lower("name").alias("_name")).agg(
        F.count(F.lit(1)).alias("_c"), F.count_if(F.col("width") < 1).alias("_bad")
    )
    by_name = per_name.groupBy(key).agg(
        F.sum("_c").alias("total_images"), F.sum(F.col("_c") - 1).alias("duplicate_names"),
        F.sum("_bad").alias("unreadable_images"),
    )
    size = F.concat_ws("x", F.col("width").cast("string"), F.col("height").cast("string"))
    sizes = usable.filter("width >= 1").groupBy(key, size.alias("_size")).agg(F.count(F.lit(1)).alias("_c"))
    dims = sizes.groupBy(key).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("_size", "_c")))).alias("dimension_distribution"),
        F.sum("_c").alias("verified_readable"),
    )
    formats = usable.groupBy(key).agg(F.array_sort(F.collect_set("_ext")).alias("formats"))
    keys = images.select(key).distinct()
    joined = keys.join(by_name, key, "left").join(dims, key, "left").join(formats, key, "left")
    total = F.coalesce("total_images", F.lit(0))
    reason = (
        F.when(total == 0, "no supported images")
        .when(total < minimum, "too few images")
        .when(F.col("duplicate_names") > 0, "duplicate file names")
        .when(F.col("unreadable_images") > 0, "unreadable images")
    )
    return joined.select(
        key, F.when(reason.isNull(), "PASS").otherwise("FAIL").alias("status"), reason.alias("reason"),
        total.alias("total_images"), F.lit(minimum).alias("min_images_required"),
        F.coalesce("duplicate_names", F.lit(0)).alias("duplicate_names"),
        F.coalesce("unreadable_images", F.lit(0)).alias("unreadable_images"),
        F.coalesce("verified_readable", F.lit(0)).alias("verified_readable"),
        "dimension_distribution", "formats",
    )
