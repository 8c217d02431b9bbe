"""Live matching of poses and GPS fixes."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: keys of one time slice that share out its flights
GROUPS = 64

_OUTPUT = "{key} bigint, pose_id bigint, ts_s double, gps_seq bigint, time_diff_s double, matched boolean"


class NearestFix(StatefulProcessor):
    """Collects the poses and fixes of one time slice of many flights and matches them when no fix can follow.

    Rows wait as the bytes of whole columns, one state entry for each side of each piece of input.
    """

    def __init__(self, key: str, tolerance: float, width: float):
        self.key, self.tolerance, self.width = key, tolerance, width

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        piece = "flights binary, times binary, ids binary"
        self.poses, self.fixes = handle.getListState("poses", piece), handle.getListState("fixes", piece)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        for frame in rows:
            for side, state in (("pose", self.poses), ("gps", self.fixes)):
                chosen = frame[frame["side"] == side]
                if len(chosen):
                    columns = zip((self.key, "ts_s", "row_id"), (np.int64, np.float64, np.int64))
                    state.appendValue(tuple(chosen[name].to_numpy(kind).tobytes() for name, kind in columns))
        # one timer per slice: the same instant is registered again without effect
        self.handle.registerTimer(int(((key[0] + 1) * self.width + self.tolerance) * 1000) + 1)
        return iter([])

    def _taken(self, state: Any, at: str, row_id: str) -> pd.DataFrame:
        pieces = list(state.get())
        state.clear()
        names = ((self.key, np.int64), (at, np.float64), (row_id, np.int64))
        return pd.DataFrame({
            name: np.frombuffer(b"".join(bytes(p[i]) for p in pieces), kind) for i, (name, kind) in enumerate(names)
        })

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        poses, fixes = self._taken(self.poses, "ts_s", "pose_id"), self._taken(self.fixes, "at", "gps_seq")
        if poses.empty:
            return
        # of fixes of one instant the first counts, of two equally near ones the earlier
        fixes = fixes.sort_values(["at", "gps_seq"]).drop_duplicates([self.key, "at"]).astype({"gps_seq": "Int64"})
        near = pd.merge_asof(
            poses.sort_values("ts_s"), fixes, left_on="ts_s", right_on="at", by=self.key, direction="nearest")
        gap = (near["at"] - near["ts_s"]).abs()
        hit = gap <= self.tolerance
        yield pd.DataFrame({
            self.key: near[self.key], "pose_id": near["pose_id"], "ts_s": near["ts_s"],
            "gps_seq": near["gps_seq"].where(hit), "time_diff_s": gap.where(hit), "matched": hit,
        })

    def close(self) -> None:
        pass


def nearest_fix_stream(
    events: DataFrame, tolerance: float, delay: str, key: str = "flight_id", width: float | None = None, groups: int = GROUPS
) -> DataFrame:
    """Poses with their nearest fix within ``tolerance`` seconds, emitted once the watermark has passed their slice.

    ``events`` is one stream of both sides: ``(key, side, row_id, ts_s, event_time)`` with side ``pose`` or ``gps``.
    State is kept per time slice of ``width`` seconds and group of flights; a fix goes to every slice it is within
    tolerance of, so a slice needs no other one, a busy flight is many keys, and closed slices leave nothing behind.
    Flights are dealt to ``groups`` groups by hash, as a key of its own for each of many short flights costs far more
    than its rows. Rows later than the watermark are dropped by Spark. Poses without a time or a flight are
    emitted at once, unmatched. Append mode.
    """
    width = 8 * tolerance if width is None else width
    at = F.floor(F.col("ts_s") / width)
    low, high = F.floor((F.col("ts_s") - tolerance) / width), F.floor((F.col("ts_s") + tolerance) / width)
    slices = F.when(F.col("side") == "gps", F.sequence(low, high)).otherwise(F.array(at))
    known = F.col("ts_s").isNotNull() & F.col(key).isNotNull()
    timed = events.filter(known).withWatermark("event_time", delay).withColumn("slice", F.explode(slices))
    timed = timed.withColumn("group", F.pmod(F.xxhash64(key), F.lit(groups)))
    matched = timed.groupBy("slice", "group").transformWithStateInPandas(
        NearestFix(key, tolerance, width), _OUTPUT.format(key=key), "Append", "EventTime"
    )
    unknown = [F.lit(None).cast(kind).alias(name) for name, kind in (("gps_seq", "bigint"), ("time_diff_s", "double"))]
    timeless = events.filter((F.col("side") == "pose") & ~known).select(
        F.col(key).cast("bigint").alias(key), F.col("row_id").alias("pose_id"), "ts_s", *unknown, F.lit(False).alias("matched")
    )
    return matched.unionByName(timeless)


def dropped_rows(progress: list[dict]) -> int:
    """Rows that came too late, from a query's ``recentProgress``; a fix counts once per slice it belongs to."""
    return sum(int(op.get("numRowsDroppedByWatermark", 0)) for p in progress for op in p.get("stateOperators", []))
