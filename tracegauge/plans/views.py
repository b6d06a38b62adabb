"""Typed views over the given tables, once for Spark and once (same mapping) for the SQL side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracegauge.functions.serving import SLO, slo_ok, tpot_ms
from tracegauge.plans.registry import sql_view

EPOCH = 1704067200.0  # 2024-01-01, the origin of the relative clock
REQUEST_SLO = SLO(ttft_ms=200.0, tpot_ms=12.0, e2e_ms=900.0)


TEXT_TABLES = ("documents", "pages", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. Text work is CPU-bound per row, so a text table that arrives in fewer splits
    than there are cores (one small file, one row group) is spread; a large one is left as it is."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name in TEXT_TABLES:
        cores = spark.sparkContext.defaultParallelism
        if df.rdd.getNumPartitions() < cores:
            return df.repartition(cores)
    return df


def utc_micros(ts: Column) -> Column:
    """Microseconds since 1970 of a zone-less timestamp read as UTC, whatever the session's time zone."""
    origin = F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00"))
    return F.timestamp_diff("MICROSECOND", origin, ts)


def utc_instant(ts: Column) -> Column:
    """The same as a timestamp with time zone, as watermarks need it."""
    return F.timestamp_micros(utc_micros(ts))


def clock(ts: Column) -> Column:
    """Seconds since EPOCH as double."""
    return utc_micros(ts) / 1e6 - EPOCH


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request records from ``events``."""
    e = table(spark, sf_dir, "events")
    ok = F.col("event_type") != "error"
    k = F.get_json_object("props", "$.k").cast("int")
    levels = F.array(*[F.lit(float(x)) for x in (1, 2, 4, 8, 16)])
    errors = F.array(*[F.lit(x) for x in ("ttft_timeout", "total_timeout", "http_5xx", "connect")])
    base = e.select(
        F.col("event_id").alias("idx"),
        F.concat(F.lit("r"), (F.col("user_id") % 12).cast("string")).alias("run_id"),
        F.get(levels, (F.col("user_id") % 5).cast("int")).alias("level"),
        (F.col("event_id") % 3).cast("int").alias("repeat"),
        ok.alias("ok"),
        F.when(~ok, F.get(errors, (F.col("event_id") % 4).cast("int"))).alias("error"),
        clock(F.col("ts")).alias("send_ts"),
        F.when(ok, F.col("value")).alias("ttft_ms"),
        F.when(ok, F.col("value") + k * 10.0).alias("e2e_ms"),
        F.when(ok, k).alias("output_tokens"),
        F.when(ok & (F.col("event_id") % 997 != 0), (F.col("user_id") + 100).cast("int")).alias("input_tokens"),
        F.when(ok, k).otherwise(F.lit(0)).alias("n_chunks"),
        F.when(
            ok & (k >= 2),
            F.transform(F.sequence(F.lit(1), k - 1), lambda i: F.col("value") * ((i * 7) % 5 + 1) / 10.0),
        ).alias("chunk_gaps_ms"),
        "user_id",
    )
    tpot = tpot_ms(F.col("ttft_ms"), F.col("e2e_ms"), F.col("output_tokens"))
    return base.withColumn("tpot_ms", tpot).withColumn(
        "slo_ok", F.col("ok") & slo_ok(F.col("ttft_ms"), F.col("tpot_ms"), F.col("e2e_ms"), REQUEST_SLO)
    )


sql_view(
    "requests",
    """
    SELECT *, ok AND ttft_ms <= 200.0 AND coalesce(tpot_ms <= 12.0, TRUE) AND e2e_ms <= 900.0 AS slo_ok
    FROM (SELECT *, CASE WHEN output_tokens >= 2 THEN (e2e_ms - ttft_ms) / (output_tokens - 1) END AS tpot_ms
    FROM (SELECT event_id AS idx, 'r' || (user_id % 12)::VARCHAR AS run_id,
      ([1.0, 2.0, 4.0, 8.0, 16.0]::DOUBLE[])[user_id % 5 + 1] AS level,
      (event_id % 3)::INTEGER AS repeat, ok,
      CASE WHEN NOT ok THEN (['ttft_timeout', 'total_timeout', 'http_5xx', 'connect'])[event_id % 4 + 1] END AS error,
      epoch_us(ts) / 1e6 - 1704067200.0 AS send_ts,
      CASE WHEN ok THEN value END AS ttft_ms, CASE WHEN ok THEN value + k * 10.0 END AS e2e_ms,
      CASE WHEN ok THEN k END AS output_tokens,
      CASE WHEN ok AND event_id % 997 <> 0 THEN (user_id + 100)::INTEGER END AS input_tokens,
      CASE WHEN ok THEN k ELSE 0 END AS n_chunks,
      CASE WHEN ok AND k >= 2 THEN list_transform(range(1, k), lambda i: value * ((i * 7) % 5 + 1) / 10.0) END AS chunk_gaps_ms,
      user_id
      FROM (SELECT *, event_type <> 'error' AS ok, (props::JSON ->> '$.k')::INTEGER AS k FROM events)))
    """,
)


def telemetry_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide telemetry samples from the ``view`` events; counters restart every 4000 events."""
    e = table(spark, sf_dir, "events").where("event_type = 'view'")
    step = F.col("event_id") % 4000
    return e.select(
        F.concat(F.lit("r"), (F.col("user_id") % 12).cast("string")).alias("run_id"),
        F.col("event_id").alias("seq"),
        clock(F.col("ts")).alias("t"),
        F.floor(F.col("value") / 60.0).cast("double").alias("running"),
        F.when(F.col("event_id") % 7 != 0, F.floor(F.col("value") / 25.0).cast("double")).alias("waiting"),
        F.when(F.col("event_id") % 5 != 0, F.col("value") / 500.0).alias("kv_cache_usage"),
        (step * 10).cast("double").alias("prefix_cache_queries"),
        F.floor(step * 7.0 + F.col("event_id") % 7).cast("double").alias("prefix_cache_hits"),
        F.when(F.col("event_id") % 11 != 0, (step * 3).cast("double")).alias("generation_tokens"),
    )


sql_view(
    "telemetry_wide",
    """
    SELECT 'r' || (user_id % 12)::VARCHAR AS run_id, event_id AS seq, epoch_us(ts) / 1e6 - 1704067200.0 AS t,
      floor(value / 60.0)::DOUBLE AS running,
      CASE WHEN event_id % 7 <> 0 THEN floor(value / 25.0)::DOUBLE END AS waiting,
      CASE WHEN event_id % 5 <> 0 THEN value / 500.0 END AS kv_cache_usage,
      (event_id % 4000 * 10)::DOUBLE AS prefix_cache_queries,
      floor((event_id % 4000) * 7.0 + event_id % 7)::DOUBLE AS prefix_cache_hits,
      CASE WHEN event_id % 11 <> 0 THEN ((event_id % 4000) * 3)::DOUBLE END AS generation_tokens
    FROM events WHERE event_type = 'view'
    """,
)

METRICS = ("running", "waiting", "kv_cache_usage", "prefix_cache_queries", "prefix_cache_hits", "generation_tokens")


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long telemetry: one row per sample and metric the sample carries."""
    wide = telemetry_wide(spark, sf_dir)
    return wide.unpivot(["run_id", "seq", "t"], list(METRICS), "metric", "value").where("value IS NOT NULL")


sql_view(
    "telemetry",
    " UNION ALL ".join(
        f"SELECT run_id, seq, t, '{m}' AS metric, {m} AS value FROM telemetry_wide WHERE {m} IS NOT NULL" for m in METRICS
    ),
    "telemetry_wide",
)


#: One base run and one candidate run without a successful request.
DEAD_RUNS = "(l_suppkey % 8 = 6 AND l_returnflag = 'A' AND month(l_shipdate) % 4 = 2 OR l_suppkey % 8 = 7 AND l_returnflag = 'R' AND month(l_shipdate) % 4 = 1)"


def gate_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-request TTFT samples of three revisions over trials and runs, from ``lineitem``. In two runs every request fails."""
    li = table(spark, sf_dir, "lineitem")
    side = F.expr("CASE l_returnflag WHEN 'A' THEN 'base' WHEN 'N' THEN 'head' ELSE 'candidate' END")
    trial = (F.col("l_suppkey") % 8).cast("int")
    drift = F.when(F.col("l_returnflag") == "N", 1.0 + trial * 0.06).otherwise(1.0)
    return li.select(
        trial.alias("trial"),
        side.alias("side"),
        (F.month("l_shipdate") % 4).cast("int").alias("run"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"),
        (F.col("l_extendedprice") / 100.0 * drift).alias("ttft_ms"),
        F.expr(f"l_discount >= 0.099 OR {DEAD_RUNS}").alias("failed"),
    )


sql_view(
    "gate_samples",
    f"""
    SELECT (l_suppkey % 8)::INTEGER AS trial,
      CASE l_returnflag WHEN 'A' THEN 'base' WHEN 'N' THEN 'head' ELSE 'candidate' END AS side,
      (month(l_shipdate) % 4)::INTEGER AS run, l_orderkey * 8 + l_linenumber AS seq,
      l_extendedprice / 100.0 * CASE WHEN l_returnflag = 'N' THEN 1.0 + (l_suppkey % 8) * 0.06 ELSE 1.0 END AS ttft_ms,
      l_discount >= 0.099 OR {DEAD_RUNS} AS failed
    FROM lineitem
    """,
)


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Call traces: each assistant turn with the turn before it and the conversation's system turn.

    Both lookups are joins on unique keys, so a conversation with very many turns spreads out.
    """
    c = table(spark, sf_dir, "conversations")
    reply = c.where("role = 'assistant'").select(
        "conv_id", "turn", (F.col("turn") - 1).alias("_prev"), F.col("text").alias("completion")
    )
    asked = c.where("role = 'user'").select("conv_id", F.col("turn").alias("_prev"), F.col("text").alias("question"))
    system = c.where("role = 'system' AND turn = 0").select("conv_id", F.col("text").alias("system"))
    j = reply.join(asked, ["conv_id", "_prev"], "left").join(system, "conv_id", "left")
    message = lambda role, text: F.when(text.isNotNull(), F.struct(F.lit(role).alias("role"), text.alias("content")))
    return j.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"),
        "conv_id",
        F.filter(
            F.array(message("system", F.col("system")), message("user", F.col("question"))), lambda m: m.isNotNull()
        ).alias("messages"),
        "system",
        "question",
        "completion",
        (F.col("conv_id") * 7.0 + F.col("turn") * 1.5 + 10.0).alias("ts"),
        F.when(F.col("conv_id") % 9 != 0, F.length("completion") * 20.0).alias("latency_ms"),
        F.when(F.col("conv_id") % 4 != 0, (F.length("completion") / 4).cast("int")).alias("completion_tokens"),
        F.when(F.col("conv_id") % 6 != 0, F.col("conv_id") % 3 != 0).alias("stream"),
        F.concat(F.lit("model-"), (F.col("conv_id") % 4).cast("string")).alias("model"),
    ).where(F.size("messages") > 0)


sql_view(
    "traces",
    """
    SELECT a.conv_id * 1000 + a.turn AS seq, a.conv_id, s.text AS system, u.text AS question, a.text AS completion,
      a.conv_id * 7.0::DOUBLE + a.turn * 1.5::DOUBLE + 10.0::DOUBLE AS ts,
      CASE WHEN a.conv_id % 9 <> 0 THEN length(a.text) * 20.0::DOUBLE END AS latency_ms,
      CASE WHEN a.conv_id % 4 <> 0 THEN (length(a.text) // 4)::INTEGER END AS completion_tokens,
      CASE WHEN a.conv_id % 6 <> 0 THEN a.conv_id % 3 <> 0 END AS stream,
      'model-' || (a.conv_id % 4)::VARCHAR AS model,
      CASE WHEN s.text IS NULL THEN '' ELSE 'system' || chr(10) || s.text || chr(10) END
        || CASE WHEN u.text IS NULL THEN '' ELSE 'user' || chr(10) || u.text || chr(10) END AS prompt
    FROM conversations a
    LEFT JOIN conversations u ON u.conv_id = a.conv_id AND u.turn = a.turn - 1 AND u.role = 'user'
    LEFT JOIN conversations s ON s.conv_id = a.conv_id AND s.turn = 0 AND s.role = 'system'
    WHERE a.role = 'assistant' AND (s.text IS NOT NULL OR u.text IS NOT NULL)
    """,
)
