"""Live telemetry: counter rates with state per source, and the recent history of a source."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tracegauge.streaming.ordered import InOrder, in_order

COUNTERS = ("prefix_cache_queries", "prefix_cache_hits", "generation_tokens")
RATES = "run_id STRING, seq BIGINT, t DOUBLE, window_s DOUBLE, prefix_hit_rate DOUBLE, prefix_hit_rate_total DOUBLE, gen_tok_s DOUBLE"
STATE = "t DOUBLE, q DOUBLE, h DOUBLE, g DOUBLE"
HISTORY_SAMPLES = 90
#: A source that is silent for longer starts afresh.
IDLE_MS = 90 * 86_400_000


def _increase(now: float | None, before: float | None) -> float | None:
    return None if now is None or before is None or now < before else now - before


def _ratio(a: float | None, b: float | None) -> float | None:
    return None if a is None or not b else a / b


class _Rates(InOrder):
    """Carries one sample (time and three counters) per source."""

    def __init__(self, idle_ms: int | None) -> None:
        columns = [("t", "DOUBLE"), ("seq", "BIGINT"), *((c, "DOUBLE") for c in COUNTERS)]
        names = ["run_id", "seq", "t", "window_s", "prefix_hit_rate", "prefix_hit_rate_total", "gen_tok_s"]
        super().__init__(columns, ["t", "seq"], STATE, names, idle_ms)

    def rows(self, key, rows, state):
        before, out = state[0] if state else (None,) * 4, []
        for t, seq, q, h, g in rows:
            # an offline sample (no counter answered) cuts the chain; the next one starts afresh
            dt = None if before[0] is None else t - before[0]
            dq, dh, dg = (_increase(now, old) for now, old in zip((q, h, g), before[1:], strict=True))
            speed = None if dg is None or dt is None or dt <= 0 else dg / dt
            out.append((key[0], seq, t, None if dt is None else round(dt, 3), _ratio(dh, dq), _ratio(h, q), speed))
            before = (t, q, h, g)
        return [before], out


def live_rates(samples: DataFrame, late: str = "1 hour", idle_ms: int | None = IDLE_MS) -> DataFrame:
    """Stream of wide samples (run_id, seq, t, counters) to rates, in event order; NULL across a restart.

    A sample comes out once the watermark has passed it.
    """
    return in_order(samples, "run_id", F.col("t"), _Rates(idle_ms), RATES, late)


class _History(StatefulProcessor):
    """Keeps the last samples of a source: a bounded list, however long the stream runs."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.recent = handle.getListState("recent", "seq BIGINT, t DOUBLE, running DOUBLE, waiting DOUBLE")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names = ["seq", "t", "running", "waiting"]
        kept = pd.DataFrame(list(self.recent.get()) if self.recent.exists() else [], columns=names)
        for part in rows:
            part = part[names]
            kept = (part if kept.empty else pd.concat([kept, part])).sort_values(["t", "seq"]).tail(HISTORY_SAMPLES)
        vals = [(int(r.seq), float(r.t), None if pd.isna(r.running) else float(r.running), None if pd.isna(r.waiting) else float(r.waiting)) for r in kept.itertuples()]
        self.recent.put(vals)
        yield pd.DataFrame(vals, columns=names).assign(run_id=key[0])[["run_id", *names]]

    def close(self) -> None:
        pass


def recent_history(samples: DataFrame) -> DataFrame:
    """What a new viewer sees: the last 90 samples of each source, sent again when the source changes."""
    return samples.select("run_id", "seq", "t", "running", "waiting").groupBy("run_id").transformWithStateInPandas(
        statefulProcessor=_History(), outputStructType="run_id STRING, seq BIGINT, t DOUBLE, running DOUBLE, waiting DOUBLE",
        outputMode="Update", timeMode="None",
    )


def run_windows(requests: DataFrame, width: str = "1 day", late: str = "2 hours") -> DataFrame:
    """Per window and run: counts, failure rate and approximate TTFT percentiles as records arrive."""
    r = requests.withWatermark("at", late)
    return r.groupBy(F.window("at", width), "run_id").agg(
        F.count("*").alias("n"), F.count_if("ok").alias("n_ok"), F.avg((~F.col("ok")).cast("double")).alias("failure_rate"),
        F.percentile_approx("ttft_ms", F.array(F.lit(0.5), F.lit(0.95)), F.lit(10000)).alias("_p"),
    ).select(
        F.col("window.start").alias("start"), "run_id", "n", "n_ok", "failure_rate", F.get("_p", F.lit(0)).alias("ttft_p50"), F.get("_p", F.lit(1)).alias("ttft_p95")
    )
