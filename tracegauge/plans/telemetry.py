"""Telemetry queries: as-of joins, window aggregates, rates, rank correlation, rate limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracegauge.operators import serving as S
from tracegauge.operators import telemetry as T
from tracegauge.operators.quantiles import average_ranks
from tracegauge.plans import views as V
from tracegauge.plans.registry import query, sql_view

# DuckDB's ASOF join picks among equal times arbitrarily; timestamps are unique per run in the data.
sql_view(
    "state_at_send",
    """SELECT r.run_id, r.level, r.repeat, r.idx, r.ttft_ms, s.t AS sample_t, s.running, s.waiting, s.kv_cache_usage
       FROM requests r ASOF JOIN telemetry_wide s ON r.run_id = s.run_id AND r.send_ts >= s.t
       WHERE r.ok AND r.ttft_ms IS NOT NULL""",
    "requests", "telemetry_wide",
)
sql_view(
    "level_windows",
    """SELECT run_id, level::VARCHAR || '/' || repeat::VARCHAR AS window_id, min(send_ts) AS t0,
       max(send_ts + coalesce(e2e_ms, 0) / 1000.0) AS t1 FROM requests GROUP BY ALL""",
    "requests",
)


def _state(spark, d):
    req = V.requests(spark, d).where("ok AND ttft_ms IS NOT NULL").select(
        "run_id", "level", "repeat", "idx", "send_ts", "ttft_ms"
    )
    return T.state_at_send(req, V.telemetry_wide(spark, d), ["running", "waiting", "kv_cache_usage"]).where(
        "sample_t IS NOT NULL"
    )


def _windows(spark, d):
    r = V.requests(spark, d).select("run_id", "level", "repeat", "send_ts", "e2e_ms")
    return r.groupBy("run_id", F.concat_ws("/", F.col("level").cast("string"), "repeat").alias("window_id")).agg(
        F.min("send_ts").alias("t0"), F.max(S.ended(F.col("send_ts"), F.col("e2e_ms"))).alias("t1")
    )


@query(
    "J1_state_at_send",
    "state_at_send",
    sql="SELECT run_id, idx, level, waiting, ttft_ms FROM state_at_send WHERE waiting IS NOT NULL",
)
def j1(spark, d):
    return _state(spark, d).where("waiting IS NOT NULL").select("run_id", "idx", "level", "waiting", "ttft_ms")


COUNTER_SQL = """
    WITH c AS (SELECT run_id, t, prefix_cache_queries AS q, prefix_cache_hits AS h FROM telemetry_wide),
    a AS (SELECT w.*, c.q AS qa, c.h AS ha FROM level_windows w ASOF LEFT JOIN c ON w.run_id = c.run_id AND w.t0 >= c.t),
    b AS (SELECT a.*, c.q AS qb, c.h AS hb FROM a ASOF LEFT JOIN c ON a.run_id = c.run_id AND a.t1 >= c.t)
"""


@query(
    "J2_counter_delta",
    "level_windows", "telemetry_wide",
    sql=COUNTER_SQL + """SELECT run_id, window_id, qb - qa AS prefix_cache_queries_delta, hb - ha AS prefix_cache_hits_delta,
      round(CASE WHEN qb - qa <> 0 THEN coalesce(hb - ha, 0) / (qb - qa) END, 9) AS prefix_cache_hit_rate FROM b""",
)
def j2(spark, d):
    c = T.window_counters(_windows(spark, d), V.telemetry_wide(spark, d))
    return c.select("run_id", "window_id", "prefix_cache_queries_delta", "prefix_cache_hits_delta",
                    F.round("prefix_cache_hit_rate", 9).alias("prefix_cache_hit_rate"))


@query(
    "J3_window_gauges",
    "level_windows", "telemetry",
    sql="""SELECT w.run_id, w.window_id, t.metric, count(*) AS n, round(avg(t.value), 8) AS mean, max(t.value) AS max
      FROM level_windows w JOIN telemetry t ON t.run_id = w.run_id AND t.t BETWEEN w.t0 AND w.t1
      WHERE t.metric IN ('running', 'waiting', 'kv_cache_usage') GROUP BY ALL""",
)
def j3(spark, d):
    t = V.telemetry(spark, d).where(F.col("metric").isin("running", "waiting", "kv_cache_usage"))
    g = T.window_gauges(_windows(spark, d), t)
    return g.select("run_id", "window_id", "metric", "n", F.round("mean", 8).alias("mean"), "max")


@query(
    "A6_not_exposed",
    "telemetry",
    sql="""WITH k(metric) AS (SELECT unnest(['running', 'waiting', 'kv_cache_usage', 'gpu_util_pct', 'gpu_mem_used_mb',
      'gpu_power_w', 'gpu_temp_c', 'gpu_sm_clock_mhz', 'prefix_cache_queries', 'prefix_cache_hits']))
    SELECT r.run_id, k.metric FROM (SELECT DISTINCT run_id FROM telemetry) r, k
    WHERE NOT EXISTS (SELECT 1 FROM telemetry t WHERE t.run_id = r.run_id AND t.metric = k.metric)""",
)
def a6n(spark, d):
    return T.not_exposed(V.telemetry(spark, d)).select("run_id", F.explode("not_exposed").alias("metric"))


@query(
    "A6_window_telemetry",
    "level_windows", "telemetry_wide",
    sql=COUNTER_SQL + """, g AS (SELECT w.run_id, w.window_id, avg(running) AS running_mean, max(running) AS running_max,
        avg(waiting) AS waiting_mean, max(waiting) AS waiting_max, avg(kv_cache_usage) AS kv_mean, max(kv_cache_usage) AS kv_max
      FROM level_windows w JOIN telemetry_wide t ON t.run_id = w.run_id AND t.t BETWEEN w.t0 AND w.t1 GROUP BY ALL)
    SELECT run_id, window_id, round(running_mean, 8) AS running_mean, running_max, round(waiting_mean, 8) AS waiting_mean,
      waiting_max, round(kv_mean, 8) AS kv_cache_usage_mean, kv_max AS kv_cache_usage_max,
      round(CASE WHEN qb - qa <> 0 THEN (hb - ha) / (qb - qa) END, 9) AS prefix_cache_hit_rate
    FROM b LEFT JOIN g USING (run_id, window_id)""",
)
def a6(spark, d):
    """Gauges (mean, max) and counter deltas of every level window in one wide row."""
    w = _windows(spark, d)
    names = ("running", "waiting", "kv_cache_usage")
    g = T.window_gauges(w, V.telemetry(spark, d).where(F.col("metric").isin(*names)))
    wide = g.groupBy("run_id", "window_id").agg(*[
        F.max(F.when(F.col("metric") == m, F.col(s))).alias(f"{m}_{s}") for m in names for s in ("mean", "max")
    ])
    c = T.window_counters(w, V.telemetry_wide(spark, d))
    return c.join(wide, ["run_id", "window_id"], "left").select(
        "run_id", "window_id",
        *[F.round(f"{m}_mean", 8).alias(f"{m}_mean") for m in names], *[f"{m}_max" for m in names],
        F.round("prefix_cache_hit_rate", 9).alias("prefix_cache_hit_rate"),
    )


@query(
    "W1_average_rank",
    "requests",
    sql="""SELECT level, ttft_ms, round(any_value(rk + (c - 1) / 2.0), 3) AS rank FROM (
      SELECT level, ttft_ms, rank() OVER (PARTITION BY level ORDER BY ttft_ms) AS rk,
        count(*) OVER (PARTITION BY level, ttft_ms) AS c FROM requests WHERE ok) GROUP BY level, ttft_ms""",
)
def w1(spark, d):
    r = average_ranks(V.requests(spark, d).where("ok"), ["level"], "ttft_ms", "rank")
    return r.select("level", "ttft_ms", F.round("rank", 3).alias("rank"))


RATES_SQL = """
    WITH l AS (SELECT *, lag(t) OVER w AS pt, lag(prefix_cache_queries) OVER w AS pq, lag(prefix_cache_hits) OVER w AS ph,
      lag(generation_tokens) OVER w AS pg FROM telemetry_wide WINDOW w AS (PARTITION BY run_id ORDER BY t, seq)),
    x AS (SELECT *, CASE WHEN prefix_cache_queries >= pq THEN prefix_cache_queries - pq END AS dq,
      CASE WHEN prefix_cache_hits >= ph THEN prefix_cache_hits - ph END AS dh,
      CASE WHEN generation_tokens >= pg THEN generation_tokens - pg END AS dg, t - pt AS dt FROM l)
"""


@query(
    "W2_counter_delta",
    "telemetry_wide",
    sql=RATES_SQL + "SELECT run_id, seq, dq AS d_prefix_cache_queries, dg AS d_generation_tokens FROM x",
)
def w2(spark, d):
    r = T.counter_rates(V.telemetry_wide(spark, d), ["run_id"], ["prefix_cache_queries", "generation_tokens"])
    return r.select("run_id", "seq", "d_prefix_cache_queries", "d_generation_tokens")


@query(
    "W3_windowed_rates",
    "telemetry_wide",
    sql=RATES_SQL + """SELECT run_id, seq, round(dt, 3) AS window_s,
      round(CASE WHEN dq <> 0 THEN dh / dq END, 9) AS prefix_hit_rate,
      round(CASE WHEN prefix_cache_queries <> 0 THEN prefix_cache_hits / prefix_cache_queries END, 9) AS prefix_hit_rate_total,
      round(CASE WHEN dt > 0 THEN dg / dt END, 9) AS gen_tok_s FROM x""",
)
def w3(spark, d):
    r = T.live_rates(V.telemetry_wide(spark, d), ["run_id"])
    return r.select("run_id", "seq", "window_s",
                    *[F.round(c, 9).alias(c) for c in ("prefix_hit_rate", "prefix_hit_rate_total", "gen_tok_s")])


@query(
    "W6_per_second",
    "telemetry_wide",
    sql="""
    WITH s AS (SELECT run_id, floor(t)::BIGINT AS sec, max(coalesce(running, 0)) AS running, max(coalesce(waiting, 0)) AS waiting,
      avg(kv_cache_usage) AS kv, arg_max(prefix_cache_queries, t) AS q, arg_max(prefix_cache_hits, t) AS h
      FROM telemetry_wide GROUP BY ALL),
    l AS (SELECT *, lag(q) OVER w AS pq, lag(h) OVER w AS ph FROM s WINDOW w AS (PARTITION BY run_id ORDER BY sec))
    SELECT run_id, sec, running, waiting, round(kv, 8) AS kv_cache_usage,
      round(CASE WHEN q > pq AND h >= ph THEN (h - ph) / (q - pq) END, 9) AS prefix_hit_rate FROM l""",
)
def w6(spark, d):
    s = T.per_second(V.telemetry_wide(spark, d), ["run_id"])
    return s.select("run_id", "sec", "running", "waiting", F.round("kv_cache_usage", 8).alias("kv_cache_usage"),
                    F.round("prefix_hit_rate", 9).alias("prefix_hit_rate"))


SPEARMAN_SQL = """
    WITH p AS (SELECT run_id, level, waiting AS x, ttft_ms AS y FROM state_at_send WHERE waiting IS NOT NULL),
    rk AS (SELECT run_id, level, x, rank() OVER (PARTITION BY run_id, level ORDER BY x) + (count(*) OVER (PARTITION BY run_id, level, x) - 1) / 2.0 AS rx,
      rank() OVER (PARTITION BY run_id, level ORDER BY y) + (count(*) OVER (PARTITION BY run_id, level, y) - 1) / 2.0 AS ry FROM p),
    cells AS (SELECT run_id, level, count(*) AS n, max(x) AS state_max,
      CASE WHEN count(*) >= 3 AND stddev_pop(rx) > 0 AND stddev_pop(ry) > 0 THEN corr(rx, ry) END AS rho FROM rk GROUP BY ALL)
"""


@query(
    "A19_spearman_by_level",
    "state_at_send",
    sql=SPEARMAN_SQL + "SELECT run_id, level, n, state_max, round(rho, 8) AS rho FROM cells",
)
def a19(spark, d):
    s = T.spearman(_state(spark, d), ["run_id", "level"], "waiting", "ttft_ms")
    return s.select("run_id", "level", "n", "state_max", F.round("rho", 8).alias("rho"))


@query(
    "A20_correlation_cells",
    "state_at_send",
    sql=SPEARMAN_SQL + """SELECT level, sum(n)::BIGINT AS n, max(state_max) AS state_max, count(rho) AS cells,
      round(median(rho), 8) AS rho_median, round(min(rho), 8) AS rho_min, round(max(rho), 8) AS rho_max FROM cells GROUP BY level""",
)
def a20(spark, d):
    """Median and range of the per-run rho: runs are summarized, their requests never pooled."""
    s = T.spearman(_state(spark, d), ["run_id", "level"], "waiting", "ttft_ms")
    return s.groupBy("level").agg(
        F.sum("n").alias("n"), F.max("state_max").alias("state_max"), F.count("rho").alias("cells"),
        F.round(F.median("rho"), 8).alias("rho_median"), F.round(F.min("rho"), 8).alias("rho_min"),
        F.round(F.max("rho"), 8).alias("rho_max"),
    )


@query(
    "T9_rate_limit",
    sql="""WITH e AS (SELECT event_id, user_id, epoch_us(ts) / 1e6 - 1704067200.0 AS t FROM events)
    SELECT event_id, user_id, n_recent, n_recent > 3 AS limited FROM (
      SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN 14400 PRECEDING AND CURRENT ROW) AS n_recent
      FROM e)""",
)
def t9(spark, d):
    """More than 3 requests of one client inside the sliding window (here 4 h: the events are sparse)."""
    e = V.table(spark, d, "events").select("event_id", "user_id", V.clock(F.col("ts")).alias("t"))
    return T.sliding_count(e, ["user_id"], "t", 14400, "n_recent").select(
        "event_id", "user_id", "n_recent", (F.col("n_recent") > 3).alias("limited")
    )
