"""Batch views of jobs, deliveries and leases (the streaming forms are in ``tracegauge.streaming``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracegauge.operators.ordered import last_known, neighbour, order_bucket


def unseen_deliveries(deliveries: DataFrame, known: DataFrame, rejected: DataFrame, since: Column) -> DataFrame:
    """Fresh deliveries, one per id (the newest), neither known nor rejected."""
    rest = [c for c in deliveries.columns if c != "delivery_id"]
    fresh = deliveries.where(F.col("delivery_id").isNotNull() & (F.col("delivered_at") >= since))
    one = fresh.groupBy("delivery_id").agg(F.max_by(F.struct(*rest), F.struct("delivered_at", "seq")).alias("_d")).select("delivery_id", "_d.*")
    return one.join(known, "delivery_id", "left_anti").join(rejected, "delivery_id", "left_anti")


def lease_state(jobs: DataFrame, now: Column, lease_s: float) -> DataFrame:
    """Running jobs whose last heartbeat is older than the lease: retryable or exhausted."""
    stale = (F.col("status") == "running") & (F.col("heartbeat_at") < now - lease_s)
    state = F.when(stale & (F.col("attempts") >= F.col("max_attempts")), "exhausted").when(stale, "retryable").otherwise("alive")
    return jobs.withColumn("lease", state)


def fencing_audit(events: DataFrame, width: float | None = None) -> DataFrame:
    """Writes whose (worker, attempt) is not the job's current claim, and the backoff of each attempt.

    ``events``: job, seq, t, kind ('claim' or 'write'), worker, attempt.
    """
    claim = F.when(F.col("kind") == "claim", F.struct("worker", "attempt"))
    e = last_known(events, ["job"], [F.col("t"), F.col("seq")], order_bucket(events, ["job"], ["t", "seq"], width), {"held": claim})
    fenced = (F.col("kind") == "write") & ~((F.col("held.worker") == F.col("worker")) & (F.col("held.attempt") == F.col("attempt")))
    return e.where("kind = 'write'").select(
        "job", "seq", F.coalesce(fenced, F.lit(True)).alias("fenced"), (5 * F.pow(F.lit(2.0), F.col("attempt") - 1)).alias("backoff_s")
    )


def one_active_job(triggers: DataFrame, width: float | None = None) -> DataFrame:
    """Trigger log (key, seq, t, kind: 'trigger' or 'finish') -> created or attached.

    A trigger creates a job unless one is active, i.e. unless the latest event of the key before it
    is another trigger (a finish closes the active job).
    """
    p = neighbour(triggers, ["key"], [F.col("t"), F.col("seq")], order_bucket(triggers, ["key"], ["t", "seq"], width), F.col("kind"), "_prev")
    active = F.coalesce(F.col("_prev") == "trigger", F.lit(False))
    return p.where("kind = 'trigger'").select("key", "seq", F.when(active, "attached").otherwise("created").alias("outcome"))


def active_runs(jobs: DataFrame, now: Column, lease_s: float, window_s: float) -> DataFrame:
    """Queued jobs, and running ones with a fresh heartbeat, created inside the recent window."""
    fresh = (F.col("status") == "queued") | ((F.col("status") == "running") & (F.col("heartbeat_at") > now - lease_s))
    return jobs.where((F.col("created_at") > now - window_s) & fresh)
