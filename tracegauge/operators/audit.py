"""Audits: recompute from raw rows and compare with what was stored."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def close(a: Column, b: Column, rel: float = 1e-8) -> Column:
    return F.abs(a - b) <= rel * F.greatest(F.abs(a), F.abs(b))


def verdict_mismatches(stored: DataFrame, recomputed: DataFrame, keys: Sequence[str], tol_pts: float = 0.1) -> DataFrame:
    """Rows whose stored verdict differs, or whose interval moved by more than ``tol_pts``."""
    s = stored.select(*keys, F.col("verdict").alias("stored_verdict"), F.col("ci_lo").alias("_lo"), F.col("ci_hi").alias("_hi"))
    j = recomputed.join(s, list(keys))
    moved = F.greatest(F.abs(F.col("_lo") - F.col("ci_lo")), F.abs(F.col("_hi") - F.col("ci_hi"))) > tol_pts + 1e-9
    return j.where((F.col("stored_verdict") != F.col("verdict")) | moved).select(*keys, "stored_verdict", "verdict")


def counter_violations(deltas: DataFrame, keys: Sequence[str], hits: str, queries: str) -> DataFrame:
    """Windows whose counters are missing, reset, or report more hits than queries."""
    h, q = F.col(hits), F.col(queries)
    reason = (
        F.when(h.isNull() | q.isNull(), "missing")
        .when((h < 0) | (q < 0), "reset")
        .when(h > q, "hits exceed queries")
    )
    return deltas.select(*keys, reason.alias("reason")).where("reason IS NOT NULL")


def request_violations(requests: DataFrame, max_tokens: int) -> DataFrame:
    """Successful requests that cannot enter a summary, with the first reason."""
    t = F.col("ttft_ms")
    reason = (
        F.when(t.isNull() | F.isnan(t) | (t <= 0) | (t == float("inf")), "invalid timing")
        .when(F.col("output_tokens").isNull() | F.col("input_tokens").isNull(), "missing token count")
        .when(F.col("output_tokens") > max_tokens, "output length not controlled")
        .when(F.col("e2e_ms") < t, "ends before first token")
    )
    return requests.where("ok").select("idx", reason.alias("reason")).where("reason IS NOT NULL")


def comparable(runs: DataFrame, keys: Sequence[str], clock: str, tolerance: float) -> DataFrame:
    """Mark runs whose clock is further than ``tolerance`` from the group median (run rows only)."""
    med = F.median(clock).over(Window.partitionBy(*keys))
    off = F.abs(F.col(clock) - med) / med
    return runs.withColumn("comparable", off <= tolerance)
