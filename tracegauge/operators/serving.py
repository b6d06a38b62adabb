"""Aggregates over request records: level summaries, errors, gaps, arrivals, concurrency."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracegauge.functions.serving import TIMEOUT_ERRORS, ratio
from tracegauge.operators.ordered import neighbour, order_bucket, running_sum
from tracegauge.operators.quantiles import exact_quantiles

LEVEL_KEYS = ("run_id", "level", "repeat")
LATENCIES = ("ttft_ms", "tpot_ms", "e2e_ms")
PERCENTILES = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}


def ended(send: Column, e2e: Column) -> Column:
    return send + F.coalesce(e2e, F.lit(0.0)) / 1000.0


def summarize_level(requests: DataFrame, keys: Sequence[str] = LEVEL_KEYS, *, slo_set: bool = True) -> DataFrame:
    """Counts, window, throughput, failure and goodput per key: one map-side-combined aggregate.

    A token rate is NULL unless *every* successful request carries the count.
    """
    ok = F.col("ok")

    def all_present(c: str) -> Column:
        have = F.count(F.when(ok, F.col(c)))
        return F.when((have == F.count_if(ok)) & (have > 0), F.sum(F.when(ok, F.col(c))))

    g = requests.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.count_if(ok).alias("n_ok"),
        F.greatest(F.max(ended(F.col("send_ts"), F.col("e2e_ms"))) - F.min("send_ts"), F.lit(1e-9)).alias("window_s"),
        all_present("input_tokens").alias("_in"),
        all_present("output_tokens").alias("_out"),
        F.count_if(F.col("error").isin(*TIMEOUT_ERRORS) & ~ok).alias("_timeouts"),
        F.count_if(ok & F.col("slo_ok")).alias("_good"),
        F.sum(F.when(ok & (F.col("output_tokens") > 0) & (F.col("n_chunks") > 0), F.col("output_tokens"))).alias("_ct"),
        F.sum(F.when(ok & (F.col("output_tokens") > 0) & (F.col("n_chunks") > 0), F.col("n_chunks"))).alias("_cc"),
    )
    w = F.col("window_s")
    good = F.col("_good") if slo_set else F.lit(None).cast("long")
    return g.select(
        *keys,
        "n",
        "n_ok",
        "window_s",
        (F.col("n_ok") / w).alias("request_throughput_rps"),
        (F.col("_in") / w).alias("input_tok_s"),
        (F.col("_out") / w).alias("output_tok_s"),
        ((F.col("_in") + F.col("_out")) / w).alias("total_tok_s"),
        ((F.col("n") - F.col("n_ok")) / F.col("n")).alias("failure_rate"),
        (F.col("_timeouts") / F.col("n")).alias("timeout_rate"),
        (good / w).alias("slo_goodput_rps"),
        (good / F.col("n")).alias("goodput_ratio"),
        ratio(F.col("_ct"), F.col("_cc")).alias("tokens_per_chunk"),
    )


def latency_percentiles(requests: DataFrame, keys: Sequence[str] = LEVEL_KEYS) -> DataFrame:
    """Exact p50/p90/p95/p99 and mean of TTFT, TPOT and E2E over successful requests, long form."""
    long = (
        requests.where("ok")
        .select(*keys, *LATENCIES)
        .unpivot(list(keys), list(LATENCIES), "metric", "value")
    )
    return exact_quantiles(long, [*keys, "metric"], "value", PERCENTILES, mean="mean")


def error_histogram(requests: DataFrame, keys: Sequence[str] = LEVEL_KEYS) -> DataFrame:
    """Failed requests per error class, as rows."""
    return requests.where("NOT ok AND error IS NOT NULL").groupBy(*keys, "error").agg(F.count("*").alias("n"))


def error_map(requests: DataFrame, keys: Sequence[str] = LEVEL_KEYS) -> DataFrame:
    """The same as one map per key (the number of error classes is fixed, so the map is small)."""
    return error_histogram(requests, keys).groupBy(*keys).agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("error", "n")))).alias("errors")
    )


def gap_percentiles(requests: DataFrame, keys: Sequence[str] = LEVEL_KEYS) -> DataFrame:
    gaps = requests.where("ok").select(*keys, F.explode_outer("chunk_gaps_ms").alias("gap_ms"))
    return exact_quantiles(gaps, keys, "gap_ms", PERCENTILES, mean="mean")


def interarrival_gaps(df: DataFrame, keys: Sequence[str], start: str, width: float | None = None, out: str = "gap") -> DataFrame:
    """Difference to the previous start of the same key (NULL for the first)."""
    prev = neighbour(df, keys, [F.col(start)], order_bucket(df, keys, start, width), F.col(start), "_before")
    return prev.withColumn(out, F.col(start) - F.col("_before")).drop("_before")


def arrival_stats(df: DataFrame, keys: Sequence[str], start: str, width: float | None = None) -> DataFrame:
    """n, window, mean rate (n-1)/window and the population CV of inter-arrival gaps."""
    g = interarrival_gaps(df, keys, start, width).groupBy(*keys).agg(
        F.count("*").alias("n"),
        (F.max(start) - F.min(start)).alias("window_s"),
        F.avg("gap").alias("_mean"),
        F.stddev_pop("gap").alias("_sd"),
        F.count("gap").alias("_gaps"),
    )
    return g.select(
        *keys,
        "n",
        "window_s",
        F.when(F.col("window_s") > 0, (F.col("n") - 1) / F.col("window_s")).alias("mean_rps"),
        F.when((F.col("_gaps") > 1) & (F.col("_mean") > 0), F.col("_sd") / F.col("_mean")).alias("cv_interarrival"),
    )


def concurrency_steps(df: DataFrame, keys: Sequence[str], start: Column, end: Column, width: float | None = None) -> DataFrame:
    """Running number of open intervals after every start/end instant, and how long it held.

    Equal instants are merged per direction first; ends sort before starts at the same time.
    """
    marks = df.select(*keys, F.explode(F.array(
        F.struct(start.alias("t"), F.lit(1).alias("d")), F.struct(end.alias("t"), F.lit(-1).alias("d"))
    )).alias("m")).select(*keys, "m.t", "m.d")
    marks = marks.groupBy(*keys, "t", "d").agg(F.sum("d").alias("_step"))
    order, bucket = [F.col("t"), F.col("d")], order_bucket(marks, keys, ["t", "d"], width)
    open_ = running_sum(marks, keys, order, bucket, F.col("_step"), "open")
    nxt = neighbour(open_, keys, order, bucket, F.col("t"), "_next", following=True)
    return nxt.select(*keys, "t", "d", "open", (F.col("_next") - F.col("t")).alias("held_s"))


def peak_concurrency(steps: DataFrame, keys: Sequence[str]) -> DataFrame:
    return steps.groupBy(*keys).agg(F.max("open").alias("peak_concurrency"))


def concurrency_histogram(steps: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Share of the observed time spent at each concurrency."""
    per = steps.where("held_s IS NOT NULL").groupBy(*keys, "open").agg(F.sum("held_s").alias("_s"))
    total = F.sum("_s").over(Window.partitionBy(*keys))
    return per.select(*keys, F.col("open").alias("concurrency"), F.when(total > 0, F.col("_s") / total).alias("share"))


def distribution_edges(df: DataFrame, keys: Sequence[str], value: str, bins: int = 12) -> DataFrame:
    """n, mean, p50/p95/p99, min, max and the distinct quantile edges of ``bins`` equal-mass bins."""
    probs = {f"e{i}": i / bins for i in range(bins + 1)}
    q = exact_quantiles(df, keys, value, {**probs, "p50": 0.5, "p95": 0.95, "p99": 0.99}, mean="mean")
    # interpolation noise is rounded off, so a value that equals an edge falls into the bin it opens
    edges = F.array_distinct(F.array(*[F.round(f"e{i}", 9) for i in range(bins + 1)]))
    return q.select(
        *keys, "n", "mean", "p50", "p95", "p99", F.col("e0").alias("min"), F.col(f"e{bins}").alias("max"),
        edges.alias("edges"),
    )


def distribution_histogram(df: DataFrame, keys: Sequence[str], value: str, bins: int = 12) -> DataFrame:
    """Counts per bin (upper edge), left-closed, the last bin closed on both sides."""
    edges = distribution_edges(df, keys, value, bins).select(*[F.col(k).alias(f"_e_{k}") for k in keys], "edges")
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_x")).agg(
        F.count("*").alias("_c")
    )
    joined = counts.join(edges, [counts[k].eqNullSafe(edges[f"_e_{k}"]) for k in keys])
    below = F.size(F.filter("edges", lambda e: e <= F.col("_x")))
    upper = F.get("edges", F.least(F.greatest(below, F.lit(1)), F.size("edges") - 1).cast("int"))
    single = F.get("edges", F.lit(0))
    return (
        joined.withColumn("upper", F.when(F.size("edges") >= 2, upper).otherwise(single))
        .groupBy(*keys, "upper")
        .agg(F.sum("_c").alias("count"))
    )
