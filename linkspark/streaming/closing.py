"""Completion of jobs by timers: a job closes when it has stored no page for a while, whatever other jobs do.

With the clock ``event`` a stretch of activity is closed when the watermark passes its end, as a session window does.
With the clock ``processing`` it is closed by the time of the machine, ``idle`` after the job's last page has come in:
no event of any job is needed for that. State that no timer has cleared (a job whose timer was lost with an old
version of the query) leaves by its time to live.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from linkspark.operators.metrics import seconds

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MEMORY = 24 * 3600  # seconds that an open stretch is kept at most by the clock of the machine
_SPAN = "first bigint, last bigint, pages bigint"


@contextmanager
def timer_state(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, which timers need."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


def merged(spans: list[tuple[int, int, int]], idle: int) -> list[tuple[int, int, int]]:
    """(first, last, pages) stretches, those no more than ``idle`` apart as one."""
    out: list[tuple[int, int, int]] = []
    for first, last, pages in sorted(spans):
        if out and first - out[-1][1] <= idle:
            out[-1] = out[-1][0], max(out[-1][1], last), out[-1][2] + pages
        else:
            out.append((first, last, pages))
    return out


def stretches(moments: np.ndarray, idle: int) -> list[tuple[int, int, int]]:
    """(first, last, pages) of the stretches of some times."""
    if not len(moments):
        return []
    own = np.sort(moments)
    starts = np.flatnonzero(np.diff(own, prepend=own[:1] - idle - 1) > idle)
    ends = np.append(starts[1:], len(own))
    return list(zip(own[starts].tolist(), own[ends - 1].tolist(), (ends - starts).tolist()))


class Closing(StatefulProcessor):
    """Open stretches of one job, in microseconds, and one timer: for the stretch that ends first, or by the machine's clock.

    Every call of the state or the timers goes from the worker to its executor and back, so there are a few for a job and
    none for a stretch.
    """

    def __init__(self, idle: int, clock: str) -> None:
        self.idle, self.clock = idle, clock

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", _SPAN, MEMORY * 1000 if self.clock == "processing" else None)

    def _due(self, last: int) -> int:
        return -(-(last + self.idle) // 1000)

    def _keep(self, spans: list[tuple[int, int, int]]) -> None:
        if spans:
            self.open.put(spans)
        else:
            self.open.clear()

    def _due_first(self, spans: list[tuple[int, int, int]]) -> int:
        return self._due(min(last for _, last, _ in spans))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before = [tuple(map(int, s)) for s in self.open.get()]
        fresh = [s for batch in rows for s in stretches(batch["moment"].to_numpy(), self.idle)]
        if not fresh:
            return iter([])
        spans = merged([*before, *fresh], self.idle)
        self._keep(spans)
        if self.clock == "event":
            wanted = self._due_first(spans)
        else:
            wanted = timerValues.getCurrentProcessingTimeInMs() + self.idle // 1000
        # by the clock event a job without open stretches has no timer to come
        known = list(self.handle.listTimers()) if before or self.clock != "event" else []
        for at in known:
            if at != wanted:
                self.handle.deleteTimer(at)
        if wanted not in known:
            self.handle.registerTimer(wanted)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        spans = [tuple(map(int, s)) for s in self.open.get()]
        closed, left = spans, []
        if self.clock == "event":
            now = timerValues.getCurrentWatermarkInMs()
            closed = [s for s in spans if self._due(s[1]) <= now]
            left = [s for s in spans if self._due(s[1]) > now]
        if closed:
            self._keep(left)
        if left:
            self.handle.registerTimer(self._due_first(left))
        if closed:
            yield pd.DataFrame([(*key, *s) for s in closed], columns=["job_id", "first", "last", "pages"])

    def close(self) -> None:
        pass


def closing_stream(pages: DataFrame, idle: str = "30 seconds", late: str = "30 seconds", clock: str = "event") -> DataFrame:
    """(job_id, started_at, completed_at, pages) of every closed stretch of activity of ``pages(job_id, crawled_at)``.

    Pages later than ``late`` are left out by the clock ``event``. Rows without a time are no activity; a null job is
    a job. Start the query inside :func:`timer_state`.
    """
    if clock not in ("event", "processing"):
        raise ValueError("the clock is event or processing")
    rows = pages.filter("crawled_at is not null")
    if clock == "event":
        rows = rows.withWatermark("crawled_at", late)
    rows = rows.select("job_id", "crawled_at", F.unix_micros("crawled_at").alias("moment"))
    gap = seconds(idle) * 1_000_000
    closed = rows.groupBy("job_id").transformWithStateInPandas(
        Closing(gap, clock), f"job_id string, {_SPAN}", "Append", "EventTime" if clock == "event" else "ProcessingTime")
    return closed.select("job_id", F.timestamp_micros("first").alias("started_at"),
                         F.timestamp_micros(F.col("last") + gap).alias("completed_at"), "pages")
