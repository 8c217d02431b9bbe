"""Live near-duplicate removal."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from plumbline.operators.frames import _scan

#: frames compared, and kept in one piece of state, at once
PIECE = 1024


class LastAccepted(StatefulProcessor):
    """Holds a video's frames back until the watermark has passed them, then decides them in the order of their time.

    State of a video: the waiting frames, packed by up to ``PIECE`` of one batch that follow each other in time; the histogram of
    the last accepted one, how many were accepted and the time of the last decided one; the time of the newest frame, the number of
    pieces so far and the end of the earliest waiting slice. Timers: one at that end, and one that ends a quiet video.
    """

    def __init__(self, key: str, threshold: float, limit: int | None, slice_ms: int, idle_ms: int):
        self.key, self.threshold, self.limit, self.slice_ms, self.idle_ms = key, threshold, limit, slice_ms, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "at bigint, piece bigint", "places binary, hists binary")
        self.last = handle.getValueState("last", "hist array<double>, accepted bigint, at bigint")
        self.clock = handle.getValueState("clock", "newest bigint, pieces bigint, due bigint")

    def _ends(self, at: int) -> int:
        """The end of the slice that holds a time: frames of a slice are decided together."""
        return (at // self.slice_ms + 1) * self.slice_ms

    def _wait(self, places: np.ndarray, hists: np.ndarray, pieces: int) -> int:
        """Keep frames ``(at, source_idx, piece)`` in the order of their time; returns the number of pieces so far."""
        for begin in range(0, len(places), PIECE):
            part = slice(begin, begin + PIECE)
            self.waiting.updateValue((int(places[begin, 0]), pieces), (places[part].tobytes(), hists[part].tobytes()))
            pieces += 1
        return pieces

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        state = self.clock.get()
        newest, pieces, due = before = state if state is not None else (None, 0, None)
        for frame in rows:
            if frame.empty:
                continue
            at, source_idx = (frame[c].to_numpy(np.int64) for c in ("at_ms", "source_idx"))
            order = np.lexsort((source_idx, at))
            places = np.stack((at, source_idx, np.full(len(at), pieces)), axis=1)[order]
            pieces = self._wait(places, np.array(frame["hist"].tolist(), dtype=np.float64)[order], pieces)
            first, last = int(places[0, 0]), int(places[-1, 0])
            newest = last if newest is None else max(newest, last)
            due = self._ends(first) if due is None else min(due, self._ends(first))
        self._tick(before, (newest, pieces, due))
        return iter([])

    def _tick(self, before: tuple, after: tuple) -> None:
        """Keep the clock and move the timers."""
        if after[0] is None:
            return
        for timer in {t for t in self._timers(before) if t not in self._timers(after)}:
            self.handle.deleteTimer(timer)
        for timer in self._timers(after):
            self.handle.registerTimer(timer)
        self.clock.update(after)

    def _timers(self, clock: tuple) -> set[int]:
        newest, _, due = clock
        return ({self._ends(newest) + self.idle_ms} if newest is not None else set()) | ({due} if due is not None else set())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        # timers of one batch come in any order, so whichever is first decides all that the watermark has passed
        passed = timerValues.getCurrentWatermarkInMs()
        state = self.clock.get()
        if state is None:
            return
        newest, pieces, due = state
        if due is not None and due <= passed:
            # only the pieces' places are listed; frames before the next piece's begin are decided before it is read
            listed = sorted(tuple(k) for k in self.waiting.keys())
            ready = [k for k in listed if self._ends(k[0]) <= passed]
            places, hists = np.empty((0, 3), np.int64), None
            for number, k in enumerate(ready):
                more, values = (np.frombuffer(v, t) for v, t in zip(self.waiting.getValue(k), (np.int64, np.float64)))
                self.waiting.removeKey(k)
                places, hists = self._merged(places, hists, more.reshape(-1, 3), values)
                complete = min([passed, *[self._ends(k[0]) - self.slice_ms for k in ready[number + 1 : number + 2]]])
                count = int(np.searchsorted(places[:, 0] // self.slice_ms, complete // self.slice_ms))
                for begin in range(0, count, PIECE):
                    part = slice(begin, min(begin + PIECE, count))
                    yield from self._decided(key, places[part], hists[part])
                places, hists = places[count:], hists[count:]
            pieces = self._wait(places, hists, pieces) if len(places) else pieces
            rest = [k[0] for k in listed[len(ready) :]] + places[:1, 0].tolist()
            due = self._ends(int(min(rest))) if rest else None
            if due is not None:
                self.handle.registerTimer(due)
            self.clock.update((newest, pieces, due))
        if self._ends(newest) + self.idle_ms <= passed:
            self.last.clear()
            self.clock.clear()

    def _merged(self, places: np.ndarray, hists: np.ndarray | None, more: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Frames in the order of their time, then ``source_idx``; of one that came twice the later."""
        values = values.reshape(len(more), -1)
        if not len(places):
            places, hists = more, values
        else:
            places, hists = np.concatenate((places, more)), np.concatenate((hists, values))
        order = np.lexsort((places[:, 2], places[:, 1], places[:, 0]))
        places, hists = places[order], hists[order]
        latest = np.append((places[1:, :2] != places[:-1, :2]).any(axis=1), True)
        return places[latest], hists[latest]

    def _decided(self, key: Any, places: np.ndarray, values: np.ndarray) -> Iterator[pd.DataFrame]:
        piece = [tuple(p) for p in places[:, :2].tolist()]
        # a pause parts what comes before it from what comes after
        pauses = (np.flatnonzero(np.diff(places[:, 0]) > self.idle_ms) + 1).tolist()
        for low, high in zip([0, *pauses], [*pauses, len(piece)]):
            decided = self._decide(key, piece[low:high], values[low:high])
            if decided is not None:
                yield decided

    def _decide(self, key: Any, piece: list[tuple[int, int]], values: np.ndarray) -> pd.DataFrame | None:
        state = self.last.get()
        if state is None or piece[0][0] - state[2] > self.idle_ms:
            incoming, count = None, 0
        else:
            incoming, count = np.asarray(state[0]), state[1]
        if self.limit is not None and count >= self.limit:
            self.last.update((state[0], count, piece[-1][0]))
            return None
        accepted, score = _scan(values, incoming, self.threshold)
        stop = len(piece)
        if self.limit is not None:
            over = np.flatnonzero(count + accepted.cumsum() >= self.limit)
            stop = over[0] + 1 if len(over) else stop
        hits = np.flatnonzero(accepted[:stop])
        hist = values[hits[-1]] if len(hits) else incoming
        self.last.update((hist.tolist(), int(count + len(hits)), piece[-1][0]))
        places = [source_idx for _, source_idx in piece[:stop]]
        return pd.DataFrame({self.key: key[0], "source_idx": places, "is_duplicate": ~accepted[:stop], "correlation": score[:stop]})

    def close(self) -> None:
        pass


def dedupe_stream(
    frames: DataFrame, threshold: float, delay: str, limit: int | None = None, key: str = "video_id", key_type: str = "bigint",
    slice_seconds: float = 1.0, idle_seconds: float = 3600.0,
) -> DataFrame:
    """Duplicate flags for frames ``(key, source_idx, hist, event_time)``; ``limit`` ends a video's scan.

    Frames may arrive in any order, within and across batches, as long as none is later than ``delay``: they are decided in the order
    of event time, then ``source_idx``, once the watermark has passed their slice of ``slice_seconds``. Later ones are dropped by Spark,
    which counts them; a frame that arrives twice counts once. After a pause of more than ``idle_seconds`` a video begins anew, however its
    frames fall into batches; one that is quiet for that long is forgotten. Rows without a time or a histogram are left out. Append mode.

    State of a video: frames of about ``delay``, and one histogram.
    """
    timed = frames.filter("event_time IS NOT NULL AND hist IS NOT NULL").withWatermark("event_time", delay)
    placed = timed.withColumn("at_ms", F.unix_millis(F.col("event_time").cast("timestamp")))
    return placed.groupBy(key).transformWithStateInPandas(
        LastAccepted(key, threshold, limit, int(slice_seconds * 1000), int(idle_seconds * 1000)),
        f"{key} {key_type}, source_idx bigint, is_duplicate boolean, correlation double", "Append", "EventTime",
    )
