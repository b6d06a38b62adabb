"""Deliveries and jobs as streams: exactly-once ids, one active job per key, lost leases, event feeds."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tracegauge.streaming.ordered import InOrder, in_order


def unique_deliveries(push: DataFrame, poll: DataFrame, delay: str) -> DataFrame:
    """Each delivery id once, whichever source brings it first, within the watermark delay."""
    both = push.select("delivery_id", "delivered_at").unionByName(poll.select("delivery_id", "delivered_at"))
    return both.withWatermark("delivered_at", delay).dropDuplicatesWithinWatermark(["delivery_id"])


def within_lookback(deliveries: DataFrame, start: Column, lookback: str = "10 minutes") -> DataFrame:
    """Mark deliveries older than ``start - lookback``; they are counted aside, never processed."""
    return deliveries.withColumn("late", F.col("delivered_at") < start - F.expr(f"INTERVAL {lookback}"))


class _OneActive(InOrder):
    """Carries the id of the active job, nothing when none is queued or running."""

    def __init__(self, idle_ms: int | None) -> None:
        super().__init__([("t", "DOUBLE"), ("seq", "BIGINT"), ("kind", "STRING")], ["t", "seq"], "job BIGINT", ["key", "seq", "job", "outcome"], idle_ms)

    def rows(self, key, rows, state):
        job, out = state[0][0] if state else None, []
        for _, seq, kind in rows:
            if kind == "finish":
                job = None
            elif job is None:
                job = seq
                out.append((key[0], seq, job, "created"))
            else:
                out.append((key[0], seq, job, "attached"))
        return [] if job is None else [(job,)], out


def one_active_job(triggers: DataFrame, late: str = "1 hour", idle_ms: int | None = None) -> DataFrame:
    """Triggers (key, seq, t, kind) to created or attached, with the job they belong to, in event order.

    A trigger comes out once the watermark has passed it. ``idle_ms`` gives up a job whose key stays silent for so long.
    """
    return in_order(triggers, "key", F.col("t"), _OneActive(idle_ms), "key BIGINT, seq BIGINT, job BIGINT, outcome STRING", late)


class _Lease(StatefulProcessor):
    """State per job: last heartbeat and attempts; one event-time timer at heartbeat + lease."""

    def __init__(self, lease_ms: int, max_attempts: int) -> None:
        self.lease_ms, self.max_attempts = lease_ms, max_attempts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.beat = handle.getValueState("beat", "at BIGINT, attempts INT")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        at, attempts = self.beat.get() if self.beat.exists() else (0, 0)
        for p in rows:
            at = max(at, int(p["at_ms"].max()))
            attempts = max(attempts, int(p["attempts"].max()))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(at + self.lease_ms)
        self.beat.update((at, attempts))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at, attempts = self.beat.get()
        self.beat.clear()
        yield pd.DataFrame({"job": [key[0]], "last_beat_ms": [at], "state": ["exhausted" if attempts >= self.max_attempts else "retryable"]})

    def close(self) -> None:
        pass


def lost_leases(heartbeats: DataFrame, lease_s: int, max_attempts: int, late: str = "1 minute") -> DataFrame:
    """Jobs whose heartbeats stopped for longer than the lease (job, at, attempts)."""
    h = heartbeats.withWatermark("at", late).withColumn("at_ms", F.unix_millis("at"))
    return h.groupBy("job").transformWithStateInPandas(
        statefulProcessor=_Lease(lease_s * 1000, max_attempts), outputStructType="job BIGINT, last_beat_ms BIGINT, state STRING",
        outputMode="Append", timeMode="EventTime",
    )


class _RateLimit(InOrder):
    """Carries the times of the last accepted requests, at most ``limit`` of them; they are idle after the window."""

    def __init__(self, limit: int, window_s: float) -> None:
        super().__init__([("t", "DOUBLE"), ("seq", "BIGINT")], ["t", "seq"], "t DOUBLE", ["key", "seq", "accepted"], int(window_s * 1000) + 1000)
        self.limit, self.window_s = limit, window_s

    def rows(self, key, rows, state):
        hits, out = [x[0] for x in state], []
        for t, seq in rows:
            hits = [x for x in hits if t - x <= self.window_s]
            out.append((key[0], seq, len(hits) < self.limit))
            if out[-1][2]:
                hits.append(t)
        return [(x,) for x in hits], out


def rate_limit(requests: DataFrame, limit: int = 3, window_s: float = 600.0, late: str = "1 hour") -> DataFrame:
    """Accept at most ``limit`` requests of a client per window, in event order; refused ones do not count (key, seq, t)."""
    return in_order(requests, "key", F.col("t"), _RateLimit(limit, window_s), "key BIGINT, seq BIGINT, accepted BOOLEAN", late)


def event_feed(events: DataFrame, after_id: int, terminal: tuple[str, ...] = ("done", "failed")) -> DataFrame:
    """Events after an id; a terminal status closes the feed of its job. The checkpoint is the offset."""
    return events.where(F.col("id") > after_id).withColumn("closes", F.col("status").isin(*terminal))
