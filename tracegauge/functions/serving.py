"""Column builders for request records: latency, SLO, rates. NULL is never read as zero."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Error classes that count as timeouts.
TIMEOUT_ERRORS = ("ttft_timeout", "total_timeout")


@dataclass(frozen=True)
class SLO:
    """Per-request bounds in milliseconds; an unset bound is not tested."""

    ttft_ms: float | None = None
    tpot_ms: float | None = None
    e2e_ms: float | None = None

    @property
    def is_set(self) -> bool:
        return any(b is not None for b in (self.ttft_ms, self.tpot_ms, self.e2e_ms))


def tpot_ms(ttft: Column, e2e: Column, output_tokens: Column) -> Column:
    """Time per output token after the first; NULL below two tokens or when a part is missing."""
    return F.when(output_tokens >= 2, (e2e - ttft) / (output_tokens - 1))


def slo_ok(ttft: Column, tpot: Column, e2e: Column, slo: SLO) -> Column:
    """A missing TTFT or E2E misses its bound; a missing TPOT does not."""
    met = F.lit(True)
    if slo.ttft_ms is not None:
        met = met & F.coalesce(ttft <= slo.ttft_ms, F.lit(False))
    if slo.tpot_ms is not None:
        met = met & F.coalesce(tpot <= slo.tpot_ms, F.lit(True))
    if slo.e2e_ms is not None:
        met = met & F.coalesce(e2e <= slo.e2e_ms, F.lit(False))
    return met


def counter_delta(current: Column, previous: Column) -> Column:
    """Increase of a counter; NULL when a side is missing or the counter went backwards."""
    return F.when(current >= previous, current - previous)


def ratio(num: Column, den: Column) -> Column:
    """num/den as double, NULL when the denominator is zero."""
    return F.when(den != 0, num.cast("double") / den)
