"""Keyed state of the streams: what a job must remember of a key between micro-batches, and when it may forget it.

The state is in Spark's state store and part of the stream's checkpoint, so a stopped job goes on where it was and no
earlier output is read. Rows of a key are combined in the tasks that read them (``combined``), so a hot key sends its
state one row per Arrow batch.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# Spark starts processors in a process of its own on the driver, which knows no files added to the session
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def combined(stream: DataFrame, combine: Callable[[pa.Table], pa.Table], schema: str | T.StructType) -> DataFrame:
    """Each Arrow batch cut down by ``combine`` before anything is shuffled."""
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    out = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from combine(pa.Table.from_batches([batch])).cast(out).to_batches()

    return stream.mapInArrow(run, schema)


class FirstCrossing(StatefulProcessor):
    """The earliest snippet over the limit of a video, told once, when the watermark has passed its time.

    Rows are (video_id, idx, at, seen): the least index over the limit with its time (null if none) and the latest time of some
    rows of a video. Until the watermark reaches the time of the best index so far an earlier snippet may still come and takes
    its place; after that none can. A video without rows for ``idle_ms`` of event time is forgotten, told or not.
    """

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.video = handle.getValueState("video", "idx long, at long, seen long, told boolean")

    def _timers(self) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        idx, at, seen, told = self.video.get()
        if idx is not None and not told:
            self.handle.registerTimer(at)
        self.handle.registerTimer(seen + self.idle_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        idx, at, seen, told = self.video.get() if self.video.exists() else (None, None, None, False)
        for row in rows:
            if row.video_id is None:  # a heartbeat only moves the watermark
                return
            seen = row.seen if seen is None else max(seen, row.seen)
            if row.idx is not None and not told and (idx is None or row.idx < idx):
                idx, at = row.idx, row.at
        self.video.update((idx, at, seen, told))
        self._timers()
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if not self.video.exists():
            return
        idx, at, seen, told = self.video.get()
        now = timerValues.getCurrentWatermarkInMs()
        if idx is not None and not told and at <= now:
            yield Row(video_id=key[0], first_idx=idx)
            told = True
        if seen + self.idle_ms <= now:
            self.video.clear()
        else:
            self.video.update((idx, at, seen, told))

    def close(self) -> None:
        pass


class FirstRow(StatefulProcessor):
    """The first row of a key by ``order`` in the micro-batch that brings the key; later rows of the key are left out."""

    def __init__(self, order: str, columns: list[str], ttl_ms: int | None):
        self.order, self.columns, self.ttl_ms = order, columns, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.done = handle.getValueState("done", "done boolean", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        if self.done.exists():
            return
        first = min(rows, key=lambda r: (r[self.order] is not None, r[self.order]) if r[self.order] is not None else (False,))
        self.done.update((True,))
        yield Row(**{c: first[c] for c in self.columns})

    def close(self) -> None:
        pass


class RunningCost(StatefulProcessor):
    """Calls and cost of a backend so far; ``raised`` in the one row that first passes the limit."""

    def __init__(self, limit, ttl_ms: int | None):
        self.limit, self.ttl_ms = limit, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.total = handle.getValueState("total", "calls long, cost decimal(38,10), told boolean", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        calls, cost, told = self.total.get() if self.total.exists() else (0, 0, False)
        for row in rows:
            calls += row.calls
            cost += row.cost or 0
        raised = not told and cost > self.limit
        self.total.update((calls, cost, told or raised))
        yield Row(backend=key[0], calls=calls, cost=cost, raised=raised)

    def close(self) -> None:
        pass
