"""Alerts for runs that did not come, over a stream of runs: the event is that nothing happened until a time.

Each key holds the times of its successful runs that aren't settled yet, and one timer at the next time at which something
is due. When the watermark passes a timer, all that was due by then is settled; rows come in any order within the lateness.
Failed runs don't count as runs but move the watermark on. State is bounded by the runs of the span that is still open.
"""

from __future__ import annotations

import bisect
import datetime as dt
from collections.abc import Iterator
from dataclasses import dataclass
from zoneinfo import ZoneInfo

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

HOUR_MS = 3_600_000
#: The store that keyed state with timers needs.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ALERTS = "key string, since timestamp, due timestamp, text string"


@dataclass(frozen=True)
class Gap:
    """No success for longer than ``hours`` after one: an alert each time, due at the end of the span. Nothing is due before the first success."""

    hours: float
    text: str = "no successful run in the last {hours:g} h"

    def settle(self, times: list[int], cursor: int | None, watermark: int) -> tuple[list[tuple[int | None, int]], list[int], int | None, int | None]:
        """(alerts as (since, due), times left, cursor, the next time at which something is due), of sorted times, up to a watermark in ms."""
        span = round(self.hours * HOUR_MS)
        alerts = []
        done = 0
        for i, at in enumerate(times):
            if at + span >= watermark:
                break
            if i + 1 == len(times) or times[i + 1] > at + span:
                alerts.append((at, at + span))
            done = i + 1
        left = times[done:]
        return alerts, left, cursor, left[0] + span + 1 if left else None

    def say(self) -> str:
        return self.text.format(hours=self.hours)


@dataclass(frozen=True)
class Daily:
    """A success each day by a time on the clock of a zone: an alert for each day without one, from the first day on whose time comes after the key's first run."""

    time: str
    zone: str
    text: str = "no successful run today (due {time} {zone})"

    def _due(self, day: dt.date) -> int:
        hour, minute = map(int, self.time.split(":"))
        return int(dt.datetime(day.year, day.month, day.day, hour, minute, tzinfo=ZoneInfo(self.zone)).timestamp() * 1000)

    def _day(self, at: int) -> dt.date:
        return dt.datetime.fromtimestamp(at / 1000, ZoneInfo(self.zone)).date()

    def first(self, at: int) -> int:
        """The first due time at or after a time."""
        day = self._day(at)
        return next(due for due in (self._due(day), self._due(day + dt.timedelta(days=1))) if due >= at)

    def settle(self, times: list[int], cursor: int | None, watermark: int) -> tuple[list[tuple[int | None, int]], list[int], int | None, int | None]:
        """As with ``Gap``; the cursor is the next due time."""
        alerts = []
        while cursor is not None and cursor < watermark:
            day = self._day(cursor)
            end = bisect.bisect_right(times, cursor)
            if not any(self._day(t) == day for t in times[:end]):
                alerts.append((times[end - 1] if end else None, cursor))
            cursor = self._due(day + dt.timedelta(days=1))
        # what a later day can still look at: that day's own runs, and the newest before
        keep = max(0, bisect.bisect_left(times, self._due(self._day(cursor)) - 36 * HOUR_MS) - 1) if cursor is not None else 0
        return alerts, times[keep:], cursor, cursor + 1 if cursor is not None else None

    def say(self) -> str:
        return self.text.format(time=self.time, zone=self.zone)


class Absences(StatefulProcessor):
    """A key's unsettled successes, and the timer of what is due next."""

    def __init__(self, rule: Gap | Daily) -> None:
        self.rule = rule

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "times array<long>, cursor long, timer long")

    def _settle(self, key: str, times: list[int], cursor: int | None, timer: int | None, watermark: int) -> Iterator[Row]:
        alerts, left, cursor, due = self.rule.settle(times, cursor, watermark)
        if due != timer:
            if timer is not None and timer > watermark:
                self.handle.deleteTimer(timer)
            if due is not None:
                self.handle.registerTimer(due)
        if left or cursor is not None:
            self.held.update((left, cursor, due))
        else:
            self.held.clear()
        moment = lambda ms: None if ms is None else dt.datetime.fromtimestamp(ms / 1000)
        for since, at in alerts:
            yield Row(key=key, since=moment(since), due=moment(at), text=self.rule.say())

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:  # noqa: N802, N803
        times, cursor, timer = self.held.get() if self.held.exists() else ([], None, None)
        new = [(r.ms, r.ok) for r in rows]
        if cursor is None and isinstance(self.rule, Daily) and new:
            cursor = self.rule.first(min(ms for ms, _ in new))
        merged = sorted({*(times or []), *(ms for ms, ok in new if ok)})
        yield from self._settle(key[0], merged, cursor, timer, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        if self.held.exists():
            times, cursor, timer = self.held.get()
            fired = None if timer == expiredTimerInfo.getExpiryTimeInMs() else timer
            yield from self._settle(key[0], list(times or []), cursor, fired, timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def absences(runs: DataFrame, key: Column, finished_at: Column, succeeded: Column, rule: Gap | Daily, lateness: str = "1 hour") -> DataFrame:
    """A stream of alerts (``ALERTS``) for the runs of each key that did not come by the rule, as far as the watermark has got.

    Runs without a key or a time don't count; times are taken in milliseconds.
    """
    runs.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    told = runs.select(key.cast("string").alias("key"), finished_at.cast("timestamp").alias("at"), F.coalesce(succeeded, F.lit(False)).alias("ok"))
    timed = told.filter(F.col("key").isNotNull() & F.col("at").isNotNull()).withWatermark("at", lateness).withColumn("ms", F.unix_millis("at"))
    return timed.groupBy("key").transformWithState(Absences(rule), ALERTS, "append", "eventTime")


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Process what is there, append it to a Parquet table and return that."""
    spark: SparkSession = stream.sparkSession
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
