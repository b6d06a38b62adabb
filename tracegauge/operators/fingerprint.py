"""Workload fingerprint of a set of call traces: sizes, arrivals, concurrency, reuse, traffic class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracegauge.functions.text import approx_token_count, render_prompt
from tracegauge.operators import serving as S
from tracegauge.operators.prefix import prefix_reuse, reuse_ratio
from tracegauge.operators.quantiles import exact_quantiles
from tracegauge.session import written


def traffic_class(
    *, streaming: Column | None = None, input_p95: Column | None = None, output_p95: Column | None = None,
    peak: Column | None = None, tool_calls: Column | None = None,
) -> Column:
    """Labels that apply to a workload (several may)."""
    s = F.col("streaming_ratio") if streaming is None else streaming
    i = F.col("input_p95") if input_p95 is None else input_p95
    o = F.col("output_p95") if output_p95 is None else output_p95
    p = F.col("peak_concurrency") if peak is None else peak
    tools = F.col("tool_calls") if tool_calls is None else tool_calls
    labels = F.array(
        F.when((s >= 0.5) & (o > 0) & (o <= 1024), "interactive"),
        F.when(s < 0.5, "batch"),
        F.when(i > 8000, "long_context"),
        F.when(p > 32, "high_concurrency"),
        F.when(tools > 0, "tool_agent"),
    )
    return F.filter(labels, lambda x: x.isNotNull())


def fingerprint(traces: DataFrame) -> DataFrame:
    """One row describing the workload. ``ts`` is the completion time; start = ts - latency.

    The rendered traces are written once; each part of the row is a scalar subquery over them, so nothing is joined.
    """
    one = F.lit("all").alias("w")
    t = written(traces.withColumn("prompt", render_prompt(F.col("messages"))).withColumn(
        "start", F.col("ts") - F.coalesce("latency_ms", F.lit(0.0)) / 1000.0
    ), "traces")
    timed = t.where("ts IS NOT NULL").select(one, "start", "ts")
    arrivals = S.arrival_stats(timed, ["w"], "start").drop("n")
    steps = S.concurrency_steps(timed, ["w"], F.col("start"), F.col("ts"))
    peak = S.peak_concurrency(steps, ["w"])
    counted = approx_token_count(F.col("prompt"))
    n_in = F.coalesce(F.col("prompt_tokens"), counted) if "prompt_tokens" in t.columns else counted
    sizes = t.select(one, n_in.alias("i"), F.col("completion_tokens").alias("o"))
    inp = exact_quantiles(sizes, ["w"], "i", {"input_p95": 0.95}).drop("n")
    outp = exact_quantiles(sizes, ["w"], "o", {"output_p95": 0.95}).drop("n")
    tools = F.sum("tool_calls") if "tool_calls" in t.columns else F.lit(0)
    base = t.groupBy(one).agg(
        F.count("*").alias("n_observed"), F.avg(F.col("stream").cast("double")).alias("streaming_ratio"), tools.alias("tool_calls")
    )
    models = t.where("model IS NOT NULL").groupBy(one, "model").agg(F.count("*").alias("c")).groupBy("w").agg(
        F.min_by("model", F.struct(-F.col("c"), F.col("model"))).alias("model")
    )
    reuse = reuse_ratio(prefix_reuse(t.select("seq", "prompt"))).select(one, F.col("ratio").alias("reuse_ratio"))
    j = base
    for i, part in enumerate((arrivals, peak, inp, outp, models, reuse)):
        names = [c for c in part.columns if c != "w"]
        j = j.withColumn(f"_p{i}", part.select(F.struct(*names)).scalar()).select(*j.columns, f"_p{i}.*")
    return j.withColumn("traffic_class", traffic_class()).drop("w")
