"""Sub-chains of a stream of points as a stateful processor."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUTPUT = "vehicle_id string, start_time timestamp, end_time timestamp, n_points long, max_speed double"
#: Times in the state are microseconds since 1970.
WAITING = "time long, event_id long, segment_flag int, speed_kmh double"
OPEN = "start_time long, end_time long, n_points long, max_speed double"


class Segments(StatefulProcessor):
    """State of a vehicle: points that the watermark has not passed, and the sub-chain that is open.

    A timer stands at the moment when the first waiting point is passed, or else when the open sub-chain ends.
    """

    def __init__(self, gap_s: float):
        self.gap = int(gap_s * 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", WAITING)
        self.open = handle.getValueState("open", OPEN)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = []
        for batch in rows:
            times = pd.to_datetime(batch["time"]).to_numpy("datetime64[us]").astype("int64")
            new += zip(times.tolist(), batch["event_id"].tolist(), batch["segment_flag"].tolist(), batch["speed_kmh"].tolist(), strict=True)
        yield self.advance(key, new, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield self.advance(key, [], timerValues.getCurrentWatermarkInMs())

    def advance(self, key, new: list[tuple], watermark_ms: int) -> pd.DataFrame:
        """Takes the points that the watermark has passed, in order, and gives the sub-chains that have ended."""
        now = watermark_ms * 1000
        rows = sorted([*(tuple(r) for r in self.waiting.get()), *new], key=lambda r: r[:2])
        passed = [r for r in rows if r[0] < now]
        left = rows[len(passed) :]
        run, ended = self.open.get(), []
        run = None if run is None else tuple(run)
        for time, _, flag, speed in passed:
            speed = None if speed is None or speed != speed else speed
            if run is None or flag == 1 or time - run[1] > self.gap:
                ended += [run] if run else []
                run = (time, time, 1, speed)
            else:
                most = speed if run[3] is None else run[3] if speed is None else max(run[3], speed)
                run = (run[0], time, run[2] + 1, most)
        # Points that wait may still follow the open sub-chain within the gap.
        if run and run[1] + self.gap < min([now, *(r[0] for r in left[:1])]):
            ended.append(run)
            run = None
        self.waiting.put(left) if left else self.waiting.clear()
        self.open.update(run) if run else self.open.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if left or run:
            at = min([left[0][0] if left else run[1] + self.gap, run[1] + self.gap if run else left[0][0]])
            self.handle.registerTimer(max(at // 1000, watermark_ms) + 1)
        columns = list(zip(*ended, strict=True)) or [[]] * 4
        times = [pd.to_datetime(pd.Series(c, dtype="int64"), unit="us") for c in columns[:2]]
        return pd.DataFrame({
            "vehicle_id": pd.Series([key[0]] * len(ended), dtype="object"), "start_time": times[0], "end_time": times[1],
            "n_points": pd.Series(columns[2], dtype="int64"), "max_speed": pd.Series(columns[3], dtype="float64"),
        })

    def close(self) -> None:
        pass
