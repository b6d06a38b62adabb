"""Streaming queries: every table row goes through readStream; results equal the batch view."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracegauge.plans import views as V
from tracegauge.plans.registry import query
from tracegauge.plans.telemetry import RATES_SQL
from tracegauge.streaming import jobs as SJ
from tracegauge.streaming import live as SL
from tracegauge.streaming.run import read_table, run_available, use_rocksdb


def _samples(spark, d):
    e = read_table(spark, d, "events").where("event_type = 'view'")
    step = F.col("event_id") % 4000
    return e.select(
        F.concat(F.lit("r"), (F.col("user_id") % 12).cast("string")).alias("run_id"), F.col("event_id").alias("seq"), V.clock(F.col("ts")).alias("t"),
        F.floor(F.col("value") / 60.0).cast("double").alias("running"),
        F.when(F.col("event_id") % 7 != 0, F.floor(F.col("value") / 25.0).cast("double")).alias("waiting"),
        (step * 10).cast("double").alias("prefix_cache_queries"), F.floor(step * 7.0 + F.col("event_id") % 7).cast("double").alias("prefix_cache_hits"),
        F.when(F.col("event_id") % 11 != 0, (step * 3).cast("double")).alias("generation_tokens"),
    )


@query(
    "T1_live_rates", "telemetry_wide",
    sql=RATES_SQL + """SELECT run_id, seq, round(CASE WHEN dq <> 0 THEN dh / dq END, 8) AS prefix_hit_rate,
      round(CASE WHEN prefix_cache_queries <> 0 THEN prefix_cache_hits / prefix_cache_queries END, 8) AS prefix_hit_rate_total, round(CASE WHEN dt > 0 THEN dg / dt END, 8) AS gen_tok_s FROM x WHERE t < (SELECT max(t) FROM x) - 3600""",
)
def t1(spark, d):
    """Samples that the watermark (an hour behind the newest) has passed."""
    use_rocksdb(spark)
    r = run_available(SL.live_rates(_samples(spark, d)))
    return r.select("run_id", "seq", *[F.round(F.nanvl(c, F.lit(None)), 8).alias(c) for c in ("prefix_hit_rate", "prefix_hit_rate_total", "gen_tok_s")])


@query(
    "T2_recent_history", "telemetry_wide",
    sql="SELECT run_id, seq, running FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY t DESC, seq DESC) AS rn FROM telemetry_wide) WHERE rn <= 90",
)
def t2(spark, d):
    """The history after the last micro-batch that touched the source."""
    use_rocksdb(spark)
    h = run_available(SL.recent_history(_samples(spark, d)), "update")
    last = h.groupBy("run_id").agg(F.max("batch").alias("batch"))
    return h.join(last, ["run_id", "batch"], "left_semi").select("run_id", "seq", "running")


def _deliveries(spark, d):
    e = read_table(spark, d, "events")
    return e.select(F.md5(F.concat(F.col("user_id").cast("string"), "props")).alias("delivery_id"), V.utc_instant(F.col("ts")).alias("delivered_at"), "event_type")


@query("T3_delivery_dedupe", sql="SELECT DISTINCT md5(user_id::VARCHAR || props) AS delivery_id FROM events")
def t3(spark, d):
    s = _deliveries(spark, d)
    u = SJ.unique_deliveries(s.where("event_type <> 'click'"), s.where("event_type = 'click'"), "60 days")
    return run_available(u).select("delivery_id")


@query("T4_lookback", sql="SELECT ts < TIMESTAMP '2024-01-15 12:00:00' - INTERVAL 10 MINUTE AS late, count(*) AS n FROM events GROUP BY 1")
def t4(spark, d):
    s = SJ.within_lookback(_deliveries(spark, d), V.utc_instant(F.to_timestamp_ntz(F.lit("2024-01-15 12:00:00"))))
    return run_available(s).groupBy("late").agg(F.count("*").alias("n"))


@query(
    "T5_one_active_job",
    sql="""WITH e AS (SELECT user_id AS key, event_id AS seq, ts, event_type = 'purchase' AS fin, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events),
      c AS (SELECT *, p IS NULL OR p = 'purchase' AS created FROM e WHERE NOT fin)
      SELECT * EXCLUDE (ts) FROM (SELECT key, seq, ts, max(CASE WHEN created THEN seq END) OVER (PARTITION BY key ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS job, CASE WHEN created THEN 'created' ELSE 'attached' END AS outcome FROM c)
      WHERE ts < (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""",
)
def t5(spark, d):
    """Triggers that the watermark (an hour behind the newest event) has passed."""
    use_rocksdb(spark)
    e = read_table(spark, d, "events").select(
        F.col("user_id").alias("key"), F.col("event_id").alias("seq"), V.clock(F.col("ts")).alias("t"), F.when(F.col("event_type") == "purchase", "finish").otherwise("trigger").alias("kind")
    )
    return run_available(SJ.one_active_job(e))


@query(
    "T6_lost_leases",
    sql="""WITH m AS (SELECT epoch_us(max(ts)) // 1000 - 60000 AS wm FROM events WHERE event_type = 'click'), j AS (SELECT user_id AS job, epoch_us(max(ts)) // 1000 AS beat, max(event_id % 4) AS attempts FROM events WHERE event_type = 'click' GROUP BY user_id)
      SELECT job, beat::BIGINT AS last_beat_ms, CASE WHEN attempts >= 3 THEN 'exhausted' ELSE 'retryable' END AS state FROM j, m WHERE beat + 86400000 <= wm""",
)
def t6(spark, d):
    use_rocksdb(spark)
    e = read_table(spark, d, "events").where("event_type = 'click'").select(
        F.col("user_id").alias("job"), V.utc_instant(F.col("ts")).alias("at"), (F.col("event_id") % 4).cast("int").alias("attempts")
    )
    return run_available(SJ.lost_leases(e, 86400, 3))


@query(
    "T9_rate_limit_stream",
    sql="""WITH RECURSIVE e AS (SELECT user_id AS key, event_id AS seq, epoch_us(ts) / 1e6 AS t, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
      r AS (SELECT key, seq, ts, i, TRUE AS accepted, [t] AS hits FROM e WHERE i = 1
        UNION ALL SELECT e.key, e.seq, e.ts, e.i, len(list_filter(r.hits, lambda h: e.t - h <= 14400.0)) < 3,
          CASE WHEN len(list_filter(r.hits, lambda h: e.t - h <= 14400.0)) < 3 THEN list_append(list_filter(r.hits, lambda h: e.t - h <= 14400.0), e.t) ELSE list_filter(r.hits, lambda h: e.t - h <= 14400.0) END
        FROM r JOIN e ON e.key = r.key AND e.i = r.i + 1)
      SELECT key, seq, accepted FROM r WHERE ts < (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""",
)
def t9(spark, d):
    """Accepted and refused requests per client; a refusal depends on the acceptances before it, so the twin recurs."""
    use_rocksdb(spark)
    e = read_table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), V.clock(F.col("ts")).alias("t"))
    return run_available(SJ.rate_limit(e, 3, 14400.0))


@query("T8_event_feed", sql="SELECT event_id AS id, user_id AS job, event_type AS status, event_type IN ('purchase', 'error') AS closes FROM events WHERE event_id > 500")
def t8(spark, d):
    e = read_table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("job"), F.col("event_type").alias("status"))
    return run_available(SJ.event_feed(e, 500, ("purchase", "error")))


@query(
    "T11_streaming_summary", "requests",
    sql="""WITH w AS (SELECT floor(send_ts / 86400)::BIGINT AS day, * FROM requests), m AS (SELECT max(send_ts) - 7200 AS wm FROM requests)
      SELECT day, run_id, count(*) AS n, count(*) FILTER (ok) AS n_ok, round(avg((NOT ok)::INTEGER), 8) AS failure_rate, quantile_disc(ttft_ms, 0.5) AS ttft_p50, quantile_disc(ttft_ms, 0.95) AS ttft_p95 FROM w GROUP BY day, run_id HAVING (day + 1) * 86400 <= (SELECT wm FROM m)""",
)
def t11(spark, d):
    """Closed windows only: a window is written once the watermark has passed its end."""
    e = read_table(spark, d, "events").select(
        V.utc_instant(F.col("ts")).alias("at"), F.concat(F.lit("r"), (F.col("user_id") % 12).cast("string")).alias("run_id"),
        (F.col("event_type") != "error").alias("ok"), F.when(F.col("event_type") != "error", F.col("value")).alias("ttft_ms"),
    )
    r = run_available(SL.run_windows(e))
    return r.select(F.floor((F.unix_micros("start") / 1e6 - V.EPOCH) / 86400).alias("day"), "run_id", "n", "n_ok", F.round("failure_rate", 8).alias("failure_rate"), "ttft_p50", "ttft_p95")
