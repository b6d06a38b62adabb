"""Time the headline queries: python bench.py prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from tracegauge.plans import load_all
from tracegauge.plans.registry import QUERIES
from tracegauge.session import local_session

HEADLINE = (
    "A1_summarize_level", "A3_latency_percentiles", "A6_window_telemetry", "J1_state_at_send", "W4_concurrency_histogram",
    "A19_spearman_by_level", "A13_gate_verdict", "A40_run_statistics", "K2_select_config", "X1_prefix_reuse", "C10_suite_summary",
    "A34_claim_reconcile", "J4_overlap_join", "G2_affected_ancestors", "K7_bm25_top_k", "S4_parse_metrics_text", "T9_rate_limit",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    load_all()
    spark = local_session(cpus, app="tracegauge-bench")
    spark.sparkContext.setLogLevel("OFF")
    spark.read.parquet(f"{sf_dir}/events.parquet").count()  # start the executors
    times: dict[str, float] = {}
    for name in HEADLINE:
        t = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1], "cpus": cpus,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
