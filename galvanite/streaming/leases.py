"""Leases and results on streams, keyed by job, in any order of arrival.

Both operators decide by event time alone, so how a stream is cut into batches
changes no row: a lease runs out when the watermark passes its last expiry,
and results are judged once the watermark has passed them. Rows behind the
watermark are late and are dropped. State needs ``campaigns.with_rocksdb``."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

EXPIRED = "job_id string, lease_generation long, expired_at timestamp"
JUDGED = "job_id string, event_id string, lease_generation long, status string"
#: What a job's newest lease generation is: it may run out, it ended, it ran out.
ACTIVE, ENDED, FIRED = "active", "ended", "fired"


class _ByEventTime(StatefulProcessor):
    """Holds a job's rows until the watermark has passed them and then gives
    them to ``rows_passed`` in the order of event time. Rows that a batch
    brings behind its watermark, but not late, are passed in that batch."""

    def __init__(self, forget_ms: int):
        self.forget_ms = forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", self.HELD, "yes boolean")
        self.job = handle.getValueState("job", self.STATE)

    def close(self) -> None:
        pass

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        watermark, due = timerValues.getCurrentWatermarkInMs(), set()
        for row in rows:
            held = self.held(row)
            self.waiting.updateValue(held, (True,))
            due.add(held[0] // 1000 + 1)
        for at in due:
            if at > watermark:
                self.handle.registerTimer(at)
        yield from self._passed(key[0], watermark)

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        yield from self._passed(key[0], timerValues.getCurrentWatermarkInMs())

    def _passed(self, job: str, watermark: int) -> Iterator[Row]:
        ready = sorted(tuple(k) for k in self.waiting.keys() if k[0] // 1000 < watermark)
        for held in ready:
            self.waiting.removeKey(held)
        yield from self.rows_passed(job, ready, watermark)

    def later(self, at_ms: int, watermark: int) -> int:
        """A timer, which may be one that the watermark has passed already."""
        if at_ms > watermark:
            self.handle.registerTimer(at_ms)
        return at_ms


class _Leases(_ByEventTime):
    """State: the newest generation, its last expiry (microseconds), what
    became of it, and when that is forgotten (milliseconds)."""

    HELD = "at long, generation long, expires long, ended boolean"
    STATE = "generation long, expires long, status string, forget long"

    @staticmethod
    def held(row: Row) -> tuple:
        return row["at_us"], row["lease_generation"], row["expires_us"], bool(row["ended"])

    def rows_passed(self, job: str, rows: list[tuple], watermark: int) -> Iterator[Row]:
        kept = self.job.get()
        none = (-1, 0, ENDED, 0)
        generation, expires, status, forget = now = tuple(kept) if kept else none
        for at, own, until, over in rows:
            if status == ACTIVE and expires <= at:
                status, forget = FIRED, expires // 1000 + self.forget_ms
                yield Row(job_id=job, lease_generation=generation, expires_us=expires)
            if status != ACTIVE and at // 1000 >= forget:
                generation = -1
            if own > generation:
                generation, expires, status = own, until, ENDED if over else ACTIVE
            elif own == generation and status == ACTIVE:
                expires, status = max(expires, until), ENDED if over else ACTIVE
            if status == ENDED:
                forget = max(forget, max(expires, at) // 1000 + self.forget_ms)
        if status == ACTIVE and expires // 1000 < watermark:
            status, forget = FIRED, expires // 1000 + self.forget_ms
            yield Row(job_id=job, lease_generation=generation, expires_us=expires)
        if (generation, expires, status, forget) != now:
            self.later(expires // 1000 + 1 if status == ACTIVE else forget, watermark)
            self.job.update((generation, expires, status, forget))
        if status != ACTIVE and forget <= watermark and generation >= 0:
            self.job.clear()


def expirations(leases: DataFrame, time: str, lateness: str, forget: str = "7 days") -> DataFrame:
    """A stream of leases and heartbeats (job_id, lease_generation,
    lease_expires_at, ended, and the event time ``time``) to the leases that
    ran out: one row when the watermark passes the last expiry that a job was
    given, unless its generation ended or a newer one took over before.

    A row counts at its event time. Once a generation has ended or run out,
    its later rows change nothing, as a lease that ran out can't be renewed;
    rows of older generations never do. That mark stays until ``forget`` after
    the expiry (or the end), then the job's state is removed: a row of a later
    time begins anew. State is one row for each job of that time, and the rows
    that the watermark hasn't passed. Rows with a null job, generation, expiry
    or time are not read."""
    rows = leases.withWatermark(time, lateness).where(F.col(time).isNotNull() & F.expr("job_id is not null and lease_generation is not null and lease_expires_at is not null"))
    rows = rows.select("job_id", F.col("lease_generation").cast("long").alias("lease_generation"), F.unix_micros("lease_expires_at").alias("expires_us"), "ended", F.unix_micros(time).alias("at_us"), time)
    out = rows.groupBy("job_id").transformWithState(_Leases(milliseconds(leases, forget)), "job_id string, lease_generation long, expires_us long", "Append", "EventTime")
    return out.select("job_id", "lease_generation", F.timestamp_micros("expires_us").alias("expired_at"))


class _Results(_ByEventTime):
    """State: the newest generation, whether a result was accepted, and when
    the job is forgotten (milliseconds)."""

    HELD = "at long, kind string, event_id string, generation long"
    STATE = "newest long, accepted boolean, forget long"

    @staticmethod
    def held(row: Row) -> tuple:
        return row["at_us"], row["kind"], row["event_id"], row["lease_generation"]

    def rows_passed(self, job: str, rows: list[tuple], watermark: int) -> Iterator[Row]:
        kept = self.job.get()
        newest, accepted, forget = tuple(kept) if kept else (0, False, 0)
        for at, kind, event, generation in rows:  # "lease" sorts before "result"
            if forget and at // 1000 >= forget:
                newest, accepted = 0, False
            if kind == "lease":
                newest = max(newest, generation)
            else:
                status = "received" if generation < newest else "duplicate_suppressed" if accepted else "accepted"
                accepted = accepted or status == "accepted"
                yield Row(job_id=job, event_id=event, lease_generation=generation, status=status)
            forget = at // 1000 + self.forget_ms
        if rows:
            self.later(forget, watermark)
            self.job.update((newest, accepted, forget))
        if forget and forget <= watermark:
            self.job.clear()


def judged_results(events: DataFrame, time: str, lateness: str, forget: str = "7 days") -> DataFrame:
    """A stream of leases and results (job_id, event_id, lease_generation,
    kind lease or result, and the event time ``time``) to each result's
    status: accepted for the first one of the generation that holds the lease,
    duplicate_suppressed for later ones, and received, kept but never
    accepted, for a result whose lease was lost to a newer generation.

    A row waits until the watermark has passed it, so results are judged in
    the order of event time (a lease before a result of the same time, then
    by event_id). A row that is delivered again while it waits is one row.
    A job's state is removed when the watermark is ``forget`` past its last
    row; a row of a later time begins anew. Rows with a null in a column are
    not read."""
    rows = events.withWatermark(time, lateness).where(F.col(time).isNotNull() & F.expr("job_id is not null and event_id is not null and kind in ('lease', 'result') and lease_generation is not null"))
    rows = rows.select("job_id", F.col("event_id").cast("string").alias("event_id"), F.col("lease_generation").cast("long").alias("lease_generation"), "kind", F.unix_micros(time).alias("at_us"), time)
    return rows.groupBy("job_id").transformWithState(_Results(milliseconds(events, forget)), JUDGED, "Append", "EventTime")


def milliseconds(frame: DataFrame, interval: str) -> int:
    """The length of an interval of days or less, like ``2 hours``."""
    text = interval if interval.lower().startswith("interval") else f"interval {interval}"
    found = frame.sparkSession.sql(f"SELECT CAST(unix_millis(timestamp '2000-01-01' + {text}) - unix_millis(timestamp '2000-01-01') AS LONG) AS ms")
    return found.first()[0]
