"""Request-record queries: scalars, level summaries, percentiles, arrivals, concurrency."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracegauge.functions.serving import SLO, slo_ok, tpot_ms
from tracegauge.operators import serving as S
from tracegauge.plans import views as V
from tracegauge.plans.registry import query


def r6(*cols):
    return [F.round(F.col(c), 6).alias(c) for c in cols]


def r8(c):
    """Means over money-like two-digit values tie at 6 or 7 digits, so they are kept to 8."""
    return F.round(F.col(c), 8).alias(c)


@query("P1_tpot_ms", "requests", sql="SELECT idx, round(tpot_ms, 6) AS tpot_ms FROM requests")
def p1(spark, d):
    r = V.requests(spark, d)
    t = tpot_ms(F.col("ttft_ms"), F.col("e2e_ms"), F.col("output_tokens"))
    return r.select("idx", F.round(t, 6).alias("tpot_ms"))


@query(
    "P2_slo_ok",
    "requests",
    sql="""SELECT idx, coalesce(ttft_ms <= 150.0, FALSE) AND coalesce(tpot_ms <= 11.0, TRUE)
           AND coalesce(e2e_ms <= 700.0, FALSE) AS slo_ok FROM requests""",
)
def p2(spark, d):
    slo = SLO(ttft_ms=150.0, tpot_ms=11.0, e2e_ms=700.0)
    r = V.requests(spark, d)
    return r.select("idx", slo_ok(F.col("ttft_ms"), F.col("tpot_ms"), F.col("e2e_ms"), slo).alias("slo_ok"))


@query(
    "A1_summarize_level",
    "requests",
    sql="""
    WITH g AS (SELECT run_id, level, repeat, count(*) AS n, count(*) FILTER (ok) AS n_ok,
      greatest(max(send_ts + coalesce(e2e_ms, 0) / 1000.0) - min(send_ts), 1e-9) AS w,
      CASE WHEN count(input_tokens) FILTER (ok) = count(*) FILTER (ok) THEN sum(input_tokens) FILTER (ok) END AS i,
      CASE WHEN count(output_tokens) FILTER (ok) = count(*) FILTER (ok) THEN sum(output_tokens) FILTER (ok) END AS o,
      count(*) FILTER (error IN ('ttft_timeout', 'total_timeout')) AS tmo, count(*) FILTER (slo_ok) AS good,
      sum(output_tokens) FILTER (ok AND output_tokens > 0 AND n_chunks > 0) AS ct,
      sum(n_chunks) FILTER (ok AND output_tokens > 0 AND n_chunks > 0) AS cc
      FROM requests GROUP BY ALL)
    SELECT run_id, level, repeat, n, n_ok, round(w, 6) AS window_s, round(n_ok / w, 9) AS request_throughput_rps,
      round(i / w, 9) AS input_tok_s, round(o / w, 9) AS output_tok_s, round((i + o) / w, 9) AS total_tok_s,
      round((n - n_ok) / n, 9) AS failure_rate, round(tmo / n, 9) AS timeout_rate,
      round(good / w, 9) AS slo_goodput_rps, round(good / n, 9) AS goodput_ratio, round(ct / cc, 9) AS tokens_per_chunk
    FROM g""",
)
def a1(spark, d):
    s = S.summarize_level(V.requests(spark, d))
    rates = [c for c in s.columns if c not in (*S.LEVEL_KEYS, "n", "n_ok", "window_s")]
    return s.select(*S.LEVEL_KEYS, "n", "n_ok", F.round("window_s", 6).alias("window_s"),
                    *[F.round(c, 9).alias(c) for c in rates])


@query(
    "A2_error_histogram",
    "requests",
    sql="SELECT run_id, level, repeat, error, count(*) AS n FROM requests WHERE NOT ok GROUP BY ALL",
)
def a2(spark, d):
    m = S.error_map(V.requests(spark, d))
    return m.select(*S.LEVEL_KEYS, F.explode("errors").alias("error", "n"))


@query(
    "A3_latency_percentiles",
    "requests",
    sql="""
    WITH m AS (SELECT run_id, level, repeat, 'ttft_ms' AS metric, ttft_ms AS v FROM requests WHERE ok
      UNION ALL SELECT run_id, level, repeat, 'tpot_ms', tpot_ms FROM requests WHERE ok
      UNION ALL SELECT run_id, level, repeat, 'e2e_ms', e2e_ms FROM requests WHERE ok)
    SELECT run_id, level, repeat, metric, count(v) AS n, round(quantile_cont(v, 0.5), 6) AS p50,
      round(quantile_cont(v, 0.9), 6) AS p90, round(quantile_cont(v, 0.95), 6) AS p95,
      round(quantile_cont(v, 0.99), 6) AS p99, round(avg(v), 8) AS mean
    FROM m WHERE v IS NOT NULL GROUP BY ALL""",
)
def a3(spark, d):
    q = S.latency_percentiles(V.requests(spark, d))
    return q.select(*S.LEVEL_KEYS, "metric", "n", *r6("p50", "p90", "p95", "p99"), r8("mean"))


@query(
    "A5_gap_percentiles",
    "requests",
    sql="""
    SELECT run_id, level, repeat, count(*) AS n, round(quantile_cont(g, 0.5), 6) AS p50,
      round(quantile_cont(g, 0.9), 6) AS p90, round(quantile_cont(g, 0.95), 6) AS p95,
      round(quantile_cont(g, 0.99), 6) AS p99, round(avg(g), 8) AS mean
    FROM (SELECT run_id, level, repeat, unnest(chunk_gaps_ms) AS g FROM requests WHERE ok) GROUP BY ALL""",
)
def a5(spark, d):
    q = S.gap_percentiles(V.requests(spark, d))
    return q.select(*S.LEVEL_KEYS, "n", *r6("p50", "p90", "p95", "p99"), r8("mean"))


@query(
    "A7_distribution",
    "requests",
    sql="""
    WITH v AS (SELECT level, value FROM (SELECT level, e2e_ms::DOUBLE AS value FROM requests WHERE ok)),
    e AS (SELECT level, list_distinct(list_transform(range(0, 13), lambda i: round(quantile_cont_l[i + 1], 9))) AS edges FROM (
      SELECT level, quantile_cont(value, [0.0, 1.0/12, 2.0/12, 3.0/12, 4.0/12, 5.0/12, 6.0/12, 7.0/12, 8.0/12, 9.0/12,
        10.0/12, 11.0/12, 1.0]) AS quantile_cont_l FROM v GROUP BY level)),
    s AS (SELECT level, list_sort(edges) AS edges FROM e),
    b AS (SELECT v.level, s.edges[least(greatest(len(list_filter(s.edges, lambda x: x <= v.value)), 1), len(s.edges) - 1) + 1] AS upper
      FROM v JOIN s USING (level))
    SELECT level, round(upper, 6) AS upper, count(*) AS count FROM b GROUP BY ALL""",
)
def a7(spark, d):
    h = S.distribution_histogram(V.requests(spark, d).where("ok"), ["level"], "e2e_ms")
    return h.select("level", F.round("upper", 6).alias("upper"), "count")


@query(
    "A7_distribution_summary",
    "requests",
    sql="""SELECT level, count(*) AS n, round(avg(e2e_ms), 8) AS mean, round(quantile_cont(e2e_ms, 0.5), 6) AS p50,
      round(quantile_cont(e2e_ms, 0.95), 6) AS p95, round(quantile_cont(e2e_ms, 0.99), 6) AS p99,
      round(min(e2e_ms), 6) AS min, round(max(e2e_ms), 6) AS max FROM requests WHERE ok GROUP BY level""",
)
def a7s(spark, d):
    s = S.distribution_edges(V.requests(spark, d).where("ok"), ["level"], "e2e_ms")
    return s.select("level", "n", r8("mean"), *r6("p50", "p95", "p99", "min", "max"))


@query(
    "A8_arrival_stats",
    "requests",
    sql="""
    WITH g AS (SELECT run_id, send_ts, send_ts - lag(send_ts) OVER (PARTITION BY run_id ORDER BY send_ts) AS gap FROM requests)
    SELECT run_id, count(*) AS n, round(max(send_ts) - min(send_ts), 6) AS window_s,
      round((count(*) - 1) / (max(send_ts) - min(send_ts)), 9) AS mean_rps,
      round(stddev_pop(gap) / avg(gap), 6) AS cv_interarrival FROM g GROUP BY run_id""",
)
def a8(spark, d):
    a = S.arrival_stats(V.requests(spark, d).select("run_id", "send_ts"), ["run_id"], "send_ts")
    return a.select("run_id", "n", *r6("window_s"), F.round("mean_rps", 9).alias("mean_rps"), *r6("cv_interarrival"))


@query(
    "W5_interarrival_gaps",
    "requests",
    sql="""SELECT run_id, idx, round(send_ts - lag(send_ts) OVER (PARTITION BY run_id ORDER BY send_ts), 6) AS gap_s
           FROM requests""",
)
def w5(spark, d):
    r = V.requests(spark, d).select("run_id", "idx", "send_ts")
    return S.interarrival_gaps(r, ["run_id"], "send_ts", out="gap_s").select("run_id", "idx", *r6("gap_s"))


CONCURRENCY_SQL = """
    WITH ev AS (SELECT run_id, send_ts AS t, 1 AS d FROM requests
      UNION ALL SELECT run_id, send_ts + coalesce(e2e_ms, 0) / 1000.0 * 3600, -1 FROM requests),
    m AS (SELECT run_id, t, d, sum(d) AS step FROM ev GROUP BY ALL),
    o AS (SELECT run_id, t, d, sum(step) OVER (PARTITION BY run_id ORDER BY t, d ROWS UNBOUNDED PRECEDING) AS open,
      lead(t) OVER (PARTITION BY run_id ORDER BY t, d) - t AS held FROM m)
"""


def _steps(spark, d):
    r = V.requests(spark, d).select("run_id", "send_ts", "e2e_ms")
    end = F.col("send_ts") + F.coalesce(F.col("e2e_ms"), F.lit(0.0)) / 1000.0 * 3600
    return S.concurrency_steps(r, ["run_id"], F.col("send_ts"), end)


@query(
    "W4_concurrency_peak",
    "requests",
    sql=CONCURRENCY_SQL + "SELECT run_id, max(open)::BIGINT AS peak_concurrency FROM o GROUP BY run_id",
)
def w4(spark, d):
    return S.peak_concurrency(_steps(spark, d), ["run_id"])


@query(
    "W4_concurrency_histogram",
    "requests",
    sql=CONCURRENCY_SQL + """SELECT run_id, open::BIGINT AS concurrency,
      round(sum(held) / sum(sum(held)) OVER (PARTITION BY run_id), 6) AS share
      FROM o WHERE held IS NOT NULL GROUP BY run_id, open""",
)
def w4h(spark, d):
    h = S.concurrency_histogram(_steps(spark, d), ["run_id"])
    return h.select("run_id", "concurrency", *r6("share"))


@query(
    "W8_level_spans",
    "requests",
    sql="""SELECT level, repeat, round(min(send_ts), 6) AS t0, round(max(send_ts + coalesce(e2e_ms, 0) / 1000.0), 6) AS t1
           FROM requests GROUP BY ALL""",
)
def w8(spark, d):
    r = V.requests(spark, d)
    return r.groupBy("level", "repeat").agg(
        F.round(F.min("send_ts"), 6).alias("t0"),
        F.round(F.max(S.ended(F.col("send_ts"), F.col("e2e_ms"))), 6).alias("t1"),
    )


@query(
    "W7_tokens_per_second",
    "requests",
    sql="""
    WITH c AS (SELECT run_id, output_tokens / n_chunks AS per, send_ts + ttft_ms / 1000.0 AS t, coalesce(chunk_gaps_ms, []) AS g
      FROM requests WHERE ok AND ttft_ms IS NOT NULL AND n_chunks > 0),
    x AS (SELECT run_id, per, floor(t + coalesce(list_sum(g[1:i]), 0) / 1000.0)::BIGINT AS sec
      FROM (SELECT *, unnest(range(0, len(g) + 1)) AS i FROM c))
    SELECT run_id, sec, round(sum(per), 6) AS tokens FROM x GROUP BY ALL""",
)
def w7(spark, d):
    """Tokens placed at each streamed chunk: a running sum of gaps inside the request's own array."""
    r = V.requests(spark, d).where("ok AND ttft_ms IS NOT NULL AND n_chunks > 0")
    sums = F.aggregate(
        F.coalesce("chunk_gaps_ms", F.array().cast("array<double>")),
        F.array(F.lit(0.0)),
        lambda acc, g: F.concat(acc, F.array(F.element_at(acc, -1) + g)),
    )
    t = F.col("send_ts") + F.col("ttft_ms") / 1000.0 + F.col("off") / 1000.0
    return (
        r.select("run_id", "send_ts", "ttft_ms", (F.col("output_tokens") / F.col("n_chunks")).alias("per"),
                 F.explode_outer(sums).alias("off"))
        .groupBy("run_id", F.floor(t).alias("sec"))
        .agg(F.round(F.sum("per"), 6).alias("tokens"))
    )
