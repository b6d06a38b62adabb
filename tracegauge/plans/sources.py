"""Source and parser queries: raw text is derived from the tables, then parsed back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracegauge.functions.serving import SLO, slo_ok
from tracegauge.plans import views as V
from tracegauge.plans.registry import query, shared_view, view
from tracegauge.sources import files as FS
from tracegauge.sources import metrics as M
from tracegauge.sources import traces as T


def trace_lines(spark, d):
    """JSON lines of both log shapes; every seventh line is cut off, some carry no messages."""
    t = V.traces(spark, d)
    parts = F.transform("messages", lambda m: F.struct(m["role"].alias("role"), F.array(F.struct(F.lit("text").alias("type"), m["content"].alias("text"))).alias("content")))
    flat = F.to_json(F.struct(F.col("seq").alias("ts"), "messages", "model", "stream", F.col("completion_tokens").alias("completion_tokens"), F.lit(0).alias("prompt_tokens"),
                              F.struct(F.length("completion").alias("prompt_tokens")).alias("usage")))
    pair = F.to_json(F.struct(
        F.col("seq").alias("ts"), F.struct(parts.alias("messages"), "model", "stream").alias("request"),
        F.struct(F.struct(F.col("completion_tokens"), F.length("completion").alias("prompt_tokens")).alias("usage"),
                 F.array(F.struct(F.struct(F.array(F.lit("a"), F.lit("b")).alias("tool_calls")).alias("message"))).alias("choices")).alias("response"),
    ))
    line = F.when(F.col("conv_id") % 3 == 0, pair).otherwise(flat)
    return t.select(F.when(F.col("seq") % 7 == 0, F.substring(line, 1, 60)).when(F.col("seq") % 11 == 0, '{"ts": 1, "messages": []}').otherwise(line).alias("value"))


@query(
    "S1_read_traces", "traces",
    sql="""SELECT seq::DOUBLE AS ts, md5(prompt) AS digest, length(completion)::INTEGER AS prompt_tokens, completion_tokens, stream, model, CASE WHEN conv_id % 3 = 0 THEN 2 ELSE 0 END AS tool_calls
      FROM traces WHERE seq % 7 <> 0 AND seq % 11 <> 0""",
)
def s1(spark, d):
    t = T.parse_traces(trace_lines(spark, d))
    return t.select("ts", F.md5("prompt").alias("digest"), "prompt_tokens", "completion_tokens", "stream", "model", "tool_calls")


@query("S9_split_broken", "traces", sql="SELECT count(*) FILTER (seq % 7 <> 0) AS complete, count(*) FILTER (seq % 7 = 0) AS broken FROM traces")
def s9(spark, d):
    good, bad = T.split_broken(trace_lines(spark, d))
    broken = bad.agg(F.count("*")).scalar()
    return good.agg(F.count("*").alias("complete")).select("complete", broken.alias("broken"))


@query("S2_request_records", "requests", sql="SELECT run_id, idx::INTEGER AS idx, level, repeat, ok, error, round(send_ts, 6) AS send_ts, ttft_ms, output_tokens, len(coalesce(chunk_gaps_ms, []))::INTEGER AS n_gaps FROM requests")
def s2(spark, d):
    """Request rows to JSON lines and back through the fixed schema of the run files."""
    r = V.requests(spark, d)
    cols = ["run_id", "idx", "level", "repeat", "ok", "error", "send_ts", "ttft_ms", "output_tokens", "chunk_gaps_ms"]
    lines = r.select(F.to_json(F.struct(*cols)).alias("value"))
    back = lines.select(F.from_json("value", T.REQUEST_SCHEMA + ", run_id STRING").alias("r")).select("r.*")
    return back.select("run_id", "idx", "level", "repeat", "ok", "error", F.round("send_ts", 6).alias("send_ts"), "ttft_ms", "output_tokens",
                       F.size(F.coalesce("chunk_gaps_ms", F.array().cast("array<double>"))).alias("n_gaps"))


@query("S3_read_telemetry", "telemetry", sql="SELECT run_id, seq, round(t, 6) AS t, metric, value FROM telemetry")
def s3(spark, d):
    w = V.telemetry_wide(spark, d)
    lines = w.select("run_id", "seq", F.to_json(F.struct("t", *V.METRICS)).alias("value"))
    return M.parse_telemetry(lines).select("run_id", "seq", F.round("t", 6).alias("t"), "metric", "value")


shared_view(
    "snapshots",
    """SELECT event_id AS snapshot_id, '# HELP x' || chr(10) || 'vllm:num_requests_running{{m="a"}} ' || CAST(user_id AS STRING) || chr(10) || 'vllm:num_requests_running{{m="b}} c"}} ' || CAST(event_id % 10 AS STRING)
      || chr(10) || 'lat_bucket{{le="1"}} 5' || chr(10) || 'lat_created 1.5' || chr(10) || 'broken abc' || chr(10) || 'nan_metric NaN' || chr(10) || '' || chr(10)
      || CASE WHEN event_id % 3 = 0 THEN 'vllm:prefix_cache_hits ' WHEN event_id % 3 = 1 THEN 'vllm:prefix_cache_hits_total ' ELSE 'other_hits ' END || CASE WHEN event_id % 13 = 0 THEN '-1' ELSE CAST(user_id * 3 AS STRING) END || ' 1700000000'
      || CASE WHEN event_id % 6 = 1 THEN chr(10) || 'vllm:prefix_cache_hits 999' ELSE '' END
      || CASE WHEN event_id % 4 = 2 THEN chr(10) || 'sglang:num_running_reqs 4' || chr(10) || 'sglang:num_queue_reqs{{engine="x"}} ' || CAST(event_id % 7 AS STRING) || chr(10) || 'sglang:token_usage 0.25' ELSE '' END AS body FROM {events}""",
)
METRICS_SQL = """WITH m AS (SELECT event_id AS snapshot_id, 'vllm:num_requests_running' AS metric, (user_id + event_id % 10)::DOUBLE AS value FROM events
    UNION ALL SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'vllm:prefix_cache_hits' WHEN 1 THEN 'vllm:prefix_cache_hits_total' ELSE 'other_hits' END, CASE WHEN event_id % 13 = 0 THEN -1 ELSE user_id * 3 END FROM events
    UNION ALL SELECT event_id, 'vllm:prefix_cache_hits', 999 FROM events WHERE event_id % 6 = 1
    UNION ALL SELECT event_id, unnest(['sglang:num_running_reqs', 'sglang:num_queue_reqs', 'sglang:token_usage']), unnest([4.0, event_id % 7, 0.25])::DOUBLE FROM events WHERE event_id % 4 = 2)"""


@query("S4_parse_metrics_text", sql=METRICS_SQL + " SELECT snapshot_id, metric, value FROM m")
def s4(spark, d):
    return M.parse_metrics_text(view(spark, d, "snapshots"))


@query(
    "S5_strict_counter",
    sql="""SELECT event_id AS snapshot_id, CASE WHEN event_id % 3 = 1 AND event_id % 13 <> 0 THEN (user_id * 3)::DOUBLE END AS value, CASE WHEN event_id % 3 <> 1 THEN 'missing' WHEN event_id % 13 = 0 THEN 'invalid' END AS reject FROM events""",
)
def s5(spark, d):
    return M.strict_counter(view(spark, d, "snapshots"), "vllm:prefix_cache_hits_total")


@query(
    "S6_canonical_metrics",
    sql=METRICS_SQL + """ SELECT snapshot_id, 'running' AS canonical, value FROM m WHERE metric = 'vllm:num_requests_running' UNION ALL
      SELECT snapshot_id, 'prefix_cache_hits', arg_min(value, CASE metric WHEN 'vllm:prefix_cache_hits_total' THEN 0 ELSE 1 END) FROM m WHERE metric LIKE 'vllm:prefix%' GROUP BY snapshot_id
      UNION ALL SELECT snapshot_id, CASE metric WHEN 'sglang:num_queue_reqs' THEN 'waiting' ELSE 'kv_cache_usage' END, value FROM m WHERE metric IN ('sglang:num_queue_reqs', 'sglang:token_usage')""",
)
def s6(spark, d):
    return M.canonical_metrics(M.parse_metrics_text(view(spark, d, "snapshots")))


shared_view(
    "chunk_log",
    """SELECT CAST(floor(event_id / 6) AS BIGINT) AS request_id, event_id AS ts, CAST(floor(event_id / 6) AS BIGINT) * 6 - 1 AS send_ts, event_type, value,
      CASE WHEN event_type = 'view' THEN '{{"choices":[{{"delta":{{"role":"assistant","content":""}}}}]}}' WHEN event_type = 'click' THEN '{{"choices":[{{"delta":{{"content":"hi"}}}}]}}'
        WHEN event_type = 'purchase' THEN '{{"choices":[{{"delta":{{"reasoning":"r"}},"finish_reason":"stop"}}]}}' WHEN event_type = 'signup' THEN '{{"choices":[],"usage":{{"prompt_tokens":7,"completion_tokens":' || CAST(user_id AS STRING) || '}}}}'
        WHEN value > 60 THEN '{{"error":{{"message":"boom"}}}}' ELSE '{{"choices":[{{"delta":{{"tool_calls":[{{"id":"t"}}]}}}}]}}' END AS payload FROM {events}""",
)
CHUNK_SQL = """WITH e AS (SELECT *, event_type = 'error' AND value > 60 AS err, event_type IN ('click', 'purchase') OR (event_type = 'error' AND value <= 60) AS outp, nullif(regexp_extract(payload, 'completion_tokens":([0-9]+)', 1), '') AS ct FROM chunk_log),
    b AS (SELECT *, min(CASE WHEN err THEN ts END) OVER (PARTITION BY request_id) AS stop FROM e),
    r AS (SELECT request_id, min(send_ts) AS send, min(ts) AS fb, any_value(stop) AS stop, min(ts) FILTER (outp AND ts <= coalesce(stop, 1e18)) AS first, max(ts) FILTER (ts <= coalesce(stop, 1e18)) AS last,
      count(*) FILTER (outp AND ts <= coalesce(stop, 1e18)) AS n, max(ts) FILTER (outp AND ts <= coalesce(stop, 1e18)) AS last_out, arg_max(ct::INTEGER, ts) FILTER (ct IS NOT NULL AND ts <= coalesce(stop, 1e18)) AS tokens,
      count(*) FILTER (event_type = 'purchase' AND ts <= coalesce(stop, 1e18)) > 0 AS fin FROM b GROUP BY request_id),
    t AS (SELECT request_id, CASE WHEN stop IS NOT NULL THEN 'http_5xx' WHEN n = 0 THEN 'empty_output' END AS error, (fb - send) * 1000.0 AS first_byte_ms, (first - send) * 1000.0 AS ttft_ms, (last - send) * 1000.0 AS e2e_ms, n::INTEGER AS n_chunks,
      CASE WHEN n > 1 THEN (last_out - first) * 1000.0 ELSE 0.0 END::DOUBLE AS gap_sum, tokens, CASE WHEN fin THEN 'stop' END AS finish_reason FROM r)"""


@query("S7_chunks_to_requests", "chunk_log", sql=CHUNK_SQL + " SELECT request_id, error, first_byte_ms::DOUBLE AS first_byte_ms, ttft_ms::DOUBLE AS ttft_ms, e2e_ms::DOUBLE AS e2e_ms, n_chunks, gap_sum, tokens, finish_reason FROM t")
def s7(spark, d):
    t = M.chunks_to_requests(view(spark, d, "chunk_log").withColumn("ts", F.col("ts").cast("double")))
    return t.select("request_id", "error", "first_byte_ms", "ttft_ms", "e2e_ms", "n_chunks", F.aggregate("chunk_gaps_ms", F.lit(0.0), lambda a, g: a + g).alias("gap_sum"),
                    F.col("usage.completion_tokens").alias("tokens"), "finish_reason")


@query(
    "P3_to_request_record", "chunk_log",
    sql=CHUNK_SQL + """, u AS (SELECT *, error IS NULL AS ok, coalesce(tokens, CASE WHEN error IS NULL AND n_chunks > 0 THEN n_chunks END) AS out FROM t),
      p AS (SELECT *, CASE WHEN ok AND out >= 2 THEN (e2e_ms - ttft_ms) / (out - 1) END AS tpot FROM u)
      SELECT request_id, out AS output_tokens, CASE WHEN tokens IS NOT NULL THEN 'server_usage' WHEN out IS NOT NULL THEN 'chunk_count' END AS token_count_source, round(tpot, 6) AS tpot_ms,
        ok AND coalesce(ttft_ms <= 3000, FALSE) AND coalesce(tpot <= 500, TRUE) AS slo_ok FROM p""",
)
def p3(spark, d):
    r = M.to_request_record(M.chunks_to_requests(view(spark, d, "chunk_log").withColumn("ts", F.col("ts").cast("double"))))
    ok = F.col("ok") & slo_ok(F.col("ttft_ms"), F.col("tpot_ms"), F.col("e2e_ms"), SLO(ttft_ms=3000.0, tpot_ms=500.0))
    return r.select("request_id", "output_tokens", "token_count_source", F.round("tpot_ms", 6).alias("tpot_ms"), ok.alias("slo_ok"))


@query(
    "S8_file_inventory",
    sql="""SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'python' WHEN 1 THEN 'markdown' WHEN 2 THEN 'other' ELSE 'dockerfile' END AS lang, octet_length(encode(html))::BIGINT + CASE WHEN page_id % 6 = 0 THEN 1 ELSE 0 END AS bytes,
      page_id % 6 = 0 AS binary, page_id % 6 <> 0 AS parseable, CASE WHEN page_id % 6 <> 0 THEN sha256(html) END AS sha256 FROM pages WHERE url LIKE 'https%'""",
)
def s8(spark, d):
    """Pages as files of a tree; pages served without TLS lie in a vendored folder that is skipped."""
    p = V.table(spark, d, "pages")
    ext = F.element_at(F.array(F.lit("a.py"), F.lit("b.md"), F.lit("c.xyz"), F.lit("Dockerfile")), (F.col("page_id") % 4 + 1).cast("int"))
    root = F.when(F.col("url").like("https%"), "src/").otherwise("node_modules/")
    body = F.when(F.col("page_id") % 6 == 0, F.concat(F.unhex(F.lit("00")), F.encode("html", "UTF-8"))).otherwise(F.encode("html", "UTF-8"))
    inv = FS.inventory(p.select(F.concat(root, F.col("page_id").cast("string"), F.lit("/"), ext).alias("path"), body.alias("content")))
    return inv.select(F.split_part("path", F.lit("/"), F.lit(2)).cast("long").alias("page_id"), "lang", "bytes", "binary", "parseable", F.when(~F.col("binary"), F.col("sha256")).alias("sha256"))


@query(
    "S10_flatten_json",
    sql="""SELECT o_orderkey, 'a.b' AS keypath, o_orderstatus AS value FROM orders UNION ALL SELECT o_orderkey, 'a.c.d', o_custkey::VARCHAR FROM orders UNION ALL SELECT o_orderkey, 'k', 'true' FROM orders""",
)
def s10(spark, d):
    o = V.table(spark, d, "orders")
    doc = F.to_json(F.struct(
        F.struct(F.col("o_orderstatus").alias("b"), F.struct(F.col("o_custkey").alias("d")).alias("c")).alias("a"), F.array(F.lit(1), F.lit(2)).alias("e"), F.lit(True).alias("k"),
    ))
    return T.flatten_json(o.select("o_orderkey", doc.alias("doc")), "doc")


WANTED = {"rq1": "rq1.json", "rq4": "rq4/rq4.json", "gate": "validation/report.json"}


@query(
    "S11_campaign_catalog",
    sql="""WITH p AS (SELECT strftime(o_orderdate, '%Y-%m-%d') || '-' || lower(substr(o_orderpriority, 3, 3)) AS campaign, CASE o_orderkey % 7 WHEN 0 THEN 'rq1.json' WHEN 1 THEN 'rq4/rq4.json' WHEN 2 THEN 'validation/report.json' WHEN 3 THEN 'REPORT.md' WHEN 4 THEN 'NOTES.md' ELSE 'x.txt' END AS f,
        o_orderpriority FROM orders WHERE o_orderpriority NOT LIKE '4%')
      SELECT campaign, coalesce(array_to_string(list_sort(list(DISTINCT CASE f WHEN 'rq1.json' THEN 'rq1' WHEN 'rq4/rq4.json' THEN 'rq4' WHEN 'validation/report.json' THEN 'gate' END) FILTER (f LIKE '%json')), ','), '') AS available,
        bool_or(f = 'REPORT.md') AS has_report, bool_or(f = 'NOTES.md') AS has_notes FROM p GROUP BY campaign HAVING bool_or(f <> 'x.txt')""",
)
def s11(spark, d):
    o = V.table(spark, d, "orders")
    name = F.element_at(F.array(*[F.lit(x) for x in ("rq1.json", "rq4/rq4.json", "validation/report.json", "REPORT.md", "NOTES.md", "x.txt", "x.txt")]), (F.col("o_orderkey") % 7 + 1).cast("int"))
    folder = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("-"), F.lower(F.substring("o_orderpriority", 3, 3)))
    bad = F.when(F.col("o_orderpriority").startswith("4"), F.concat(F.lit("draft-"), folder)).otherwise(folder)
    c = T.campaign_catalog(o.select(F.concat(bad, F.lit("/"), name).alias("path")), WANTED)
    return c.select("campaign", F.array_join("available", ",").alias("available"), "has_report", "has_notes")
