"""Telemetry operators: as-of state, window aggregates, counter rates, per-second resampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracegauge.functions.serving import counter_delta, ratio
from tracegauge.operators.ordered import ROWS_PER_BUCKET, last_known, neighbour, order_bucket, running_sum, splitters, time_bucket
from tracegauge.operators.quantiles import average_ranks
from tracegauge.session import written

# The metrics a server may expose.
GAUGES = (
    "running", "waiting", "kv_cache_usage", "gpu_util_pct", "gpu_mem_used_mb", "gpu_power_w", "gpu_temp_c",
    "gpu_sm_clock_mhz",
)
COUNTERS = ("prefix_cache_queries", "prefix_cache_hits")


def state_at_send(
    requests: DataFrame, samples: DataFrame, fields: Sequence[str], *, run: str = "run_id", width: float | None = None
) -> DataFrame:
    """As-of join: each request with the last sample of its run at or before ``send_ts``.

    The *sample* decides, not the field: a sample whose field is NULL gives NULL, it does not fall
    back to an older one. Requests before the first sample keep a NULL ``sample_t``.
    """
    carried = requests.select(
        run, F.col("send_ts").alias("_t"), F.lit(1).alias("_side"), F.lit(0).cast("long").alias("_seq"),
        F.struct(*[F.col(c) for c in requests.columns if c != run]).alias("_req"),
    )
    sample = samples.select(
        run, F.col("t").alias("_t"), F.lit(0).alias("_side"), F.col("seq").cast("long").alias("_seq"),
        F.struct(F.col("t").alias("sample_t"), *[F.col(f) for f in fields]).alias("_sample"),
    )
    both = carried.unionByName(sample, allowMissingColumns=True)
    order = [F.col("_t"), F.col("_side"), F.col("_seq")]
    done = last_known(both, [run], order, order_bucket(both, [run], ["_t", "_side", "_seq"], width), {"_at": F.col("_sample")})
    return done.where("_side = 1").select(run, "_req.*", "_at.*")


def counters_at(
    instants: DataFrame, samples: DataFrame, counters: Sequence[str], at: str, *, run: str = "run_id",
    width: float | None = None,
) -> DataFrame:
    """Last non-NULL value of each counter at or before ``at`` (NULL samples are skipped here)."""
    left = instants.select(
        run, F.col(at).alias("_t"), F.lit(1).alias("_side"), F.lit(0).cast("long").alias("_seq"),
        F.struct(*[F.col(c) for c in instants.columns if c != run]).alias("_row"),
    )
    right = samples.select(run, F.col("t").alias("_t"), F.lit(0).alias("_side"), F.col("seq").cast("long").alias("_seq"), *counters)
    both = left.unionByName(right, allowMissingColumns=True)
    order = [F.col("_t"), F.col("_side"), F.col("_seq")]
    bucket = order_bucket(both, [run], ["_t", "_side", "_seq"], width)
    done = last_known(both, [run], order, bucket, {f"{c}_at": F.col(c) for c in counters})
    return done.where("_side = 1").select(run, "_row.*", *[f"{c}_at" for c in counters])


def window_gauges(
    windows: DataFrame, telemetry: DataFrame, *, run: str = "run_id", window_id: str = "window_id", width: float = 3600.0
) -> DataFrame:
    """Per window and metric: count, mean and max of the samples with ``t0 <= t <= t1``.

    Whole time buckets inside a window are read from per-bucket aggregates; only the first and the
    last bucket meet the raw samples. Long overlapping windows therefore never list every sample.
    """
    t = telemetry.withColumn("_b", time_bucket(F.col("t"), width))
    cells = t.groupBy(run, "metric", "_b").agg(
        F.count("value").alias("_n"), F.sum("value").alias("_s"), F.max("value").alias("_m")
    )
    w = windows.select(
        run, window_id, "t0", "t1",
        time_bucket(F.col("t0"), width).alias("_b0"), time_bucket(F.col("t1"), width).alias("_b1"),
    )
    inner = w.where("_b1 - _b0 > 1").withColumn("_b", F.explode(F.sequence(F.col("_b0") + 1, F.col("_b1") - 1)))
    edge = w.withColumn("_b", F.explode(F.array_distinct(F.array("_b0", "_b1"))))
    from_cells = inner.join(cells, [run, "_b"]).select(run, window_id, "metric", "_n", "_s", "_m")
    from_rows = (
        edge.join(t, [run, "_b"])
        .where("t >= t0 AND t <= t1")
        .groupBy(run, window_id, "metric")
        .agg(F.count("value").alias("_n"), F.sum("value").alias("_s"), F.max("value").alias("_m"))
    )
    return (
        from_cells.unionByName(from_rows)
        .groupBy(run, window_id, "metric")
        .agg(F.sum("_n").alias("n"), (F.sum("_s") / F.sum("_n")).alias("mean"), F.max("_m").alias("max"))
    )


def window_counters(windows: DataFrame, samples: DataFrame, *, run: str = "run_id", width: float | None = None) -> DataFrame:
    """Counter deltas over each window and the prefix-cache hit rate."""
    marks = windows.select(run, "window_id", F.explode(F.array(
        F.struct(F.lit("a").alias("edge"), F.col("t0").alias("at")),
        F.struct(F.lit("b").alias("edge"), F.col("t1").alias("at")),
    )).alias("m")).select(run, "window_id", "m.edge", "m.at")
    vals = counters_at(marks, samples, COUNTERS, "at", run=run, width=width)
    pick = lambda c, e: F.max(F.when(F.col("edge") == e, F.col(f"{c}_at")))
    d = vals.groupBy(run, "window_id").agg(*[(pick(c, "b") - pick(c, "a")).alias(f"{c}_delta") for c in COUNTERS])
    return d.withColumn(
        "prefix_cache_hit_rate",
        ratio(F.coalesce("prefix_cache_hits_delta", F.lit(0.0)), F.col("prefix_cache_queries_delta")),
    )


def not_exposed(telemetry: DataFrame, *, run: str = "run_id") -> DataFrame:
    """Known metrics a run never reported (the set of metric names is fixed, so the array is small)."""
    known = F.array(*[F.lit(m) for m in (*GAUGES, *COUNTERS)])
    seen = telemetry.select(run, "metric").distinct().groupBy(run).agg(F.collect_set("metric").alias("_seen"))
    return seen.select(run, F.array_except(known, "_seen").alias("not_exposed"))


def counter_rates(
    samples: DataFrame, keys: Sequence[str], counters: Sequence[str], t: str = "t", width: float | None = None
) -> DataFrame:
    """Delta of every counter to the previous sample (NULL across a restart or a missing value)."""
    prev = neighbour(
        samples, keys, [F.col(t), F.col("seq")], order_bucket(samples, keys, [t, "seq"], width),
        F.struct(F.col(t).alias("t"), *[F.col(c) for c in counters]), "_p",
    )
    return prev.select(
        *samples.columns,
        (F.col(t) - F.col("_p.t")).alias("dt"),
        *[counter_delta(F.col(c), F.col(f"_p.{c}")).alias(f"d_{c}") for c in counters],
    )


def live_rates(samples: DataFrame, keys: Sequence[str], width: float | None = None) -> DataFrame:
    """Hit rate over the last interval, hit rate in total, generated tokens per second."""
    c = ("prefix_cache_queries", "prefix_cache_hits", "generation_tokens")
    r = counter_rates(samples, keys, c, width=width)
    dq, dh, dg = (F.col(f"d_{x}") for x in c)
    return r.select(
        *keys, "seq", "t",
        F.round("dt", 3).alias("window_s"),
        F.when(dq != 0, dh / dq).alias("prefix_hit_rate"),
        ratio(F.col("prefix_cache_hits"), F.col("prefix_cache_queries")).alias("prefix_hit_rate_total"),
        F.when(F.col("dt") > 0, dg / F.col("dt")).alias("gen_tok_s"),
    )


def per_second(samples: DataFrame, keys: Sequence[str], width: float | None = None) -> DataFrame:
    """One row per second: peak queue depth, mean gauges, hit rate between the last samples."""
    order = F.struct("t", "seq")
    sec = samples.groupBy(*keys, F.floor("t").alias("sec")).agg(
        F.max(F.coalesce("running", F.lit(0.0))).alias("running"),
        F.max(F.coalesce("waiting", F.lit(0.0))).alias("waiting"),
        F.avg("kv_cache_usage").alias("kv_cache_usage"),
        F.max_by(F.struct(*COUNTERS), order).alias("_last"),
    ).select(*keys, "sec", "running", "waiting", "kv_cache_usage", "_last.*")
    prev = neighbour(sec, keys, [F.col("sec")], order_bucket(sec, keys, "sec", width), F.struct(*COUNTERS), "_p")
    dq = counter_delta(F.col(COUNTERS[0]), F.col(f"_p.{COUNTERS[0]}"))
    dh = counter_delta(F.col(COUNTERS[1]), F.col(f"_p.{COUNTERS[1]}"))
    return prev.select(
        *keys, "sec", "running", "waiting", "kv_cache_usage", F.when(dq != 0, dh / dq).alias("prefix_hit_rate")
    )


def spearman(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Rank correlation per key (ties share their mean rank); NULL if n < 3 or a side is constant.

    Works on distinct (x, y) pairs with counts, so repeated values cost one row each.
    """
    keys = list(keys)
    pairs = written(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys, x, y).agg(F.count("*").alias("_n")), "pairs")
    rx = average_ranks(pairs, keys, x, "_rx", F.col("_n")).drop("_c")
    ry = average_ranks(pairs, keys, y, "_ry", F.col("_n")).drop("_c")
    j = pairs.join(rx, [*keys, x]).join(ry, [*keys, y])
    n = F.sum("_n")
    w = F.col("_n")
    s = j.groupBy(*keys).agg(
        n.alias("n"),
        F.max(x).alias("state_max"),
        F.sum(w * F.col("_rx")).alias("_sx"), F.sum(w * F.col("_ry")).alias("_sy"),
        F.sum(w * F.col("_rx") * F.col("_rx")).alias("_sxx"), F.sum(w * F.col("_ry") * F.col("_ry")).alias("_syy"),
        F.sum(w * F.col("_rx") * F.col("_ry")).alias("_sxy"),
    )
    n = F.col("n").cast("double")
    cov = F.col("_sxy") - F.col("_sx") * F.col("_sy") / n
    vx = F.col("_sxx") - F.col("_sx") * F.col("_sx") / n
    vy = F.col("_syy") - F.col("_sy") * F.col("_sy") / n
    rho = F.when((F.col("n") >= 3) & (vx > 1e-9) & (vy > 1e-9), cov / F.sqrt(vx * vy))
    return s.select(*keys, "n", "state_max", rho.alias("rho"))


def sliding_count(events: DataFrame, keys: Sequence[str], t: str, seconds: float, out: str, rows: int | None = None) -> DataFrame:
    """Events of the key in the ``seconds`` before and including each row.

    The count is a difference of two positions: events up to ``t`` less events before ``t - seconds``. Both are read off one
    running sum over the counts per time, with marks at the two instants, which is cut wherever the rows are; no window
    of events is ever held, so a burst inside one window is spread like any other rows. A row without a time counts nothing.
    """
    keys = list(keys)
    counts = events.where(F.col(t).isNotNull()).groupBy(*keys, F.col(t).alias("_t")).agg(F.count("*").alias("_n"))
    # order of equal instants: the mark before the events, the events, the mark behind them
    mark = lambda at, side, n: F.struct(at.alias("_at"), F.lit(side).alias("_side"), n.alias("_c"))
    zero = F.lit(0).cast("long")
    marks = counts.select(*keys, "_t", F.explode(F.array(
        mark(F.col("_t") - seconds, 0, zero), mark(F.col("_t"), 1, F.col("_n")), mark(F.col("_t"), 2, zero),
    )).alias("m")).select(*keys, "_t", "m.*")
    bucket = splitters(marks, keys, ["_at", "_side"], rows or ROWS_PER_BUCKET)
    upto = running_sum(marks, keys, [F.col("_at"), F.col("_side")], bucket, F.col("_c"), "_upto")
    at = lambda side: F.max(F.when(F.col("_side") == side, F.col("_upto")))
    per = upto.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys], "_t").agg((at(2) - at(0)).alias(out))
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys] + [F.col(t) == F.col("_t")]
    return events.join(per, same, "left").select(*events.columns, out)
