"""Telemetry files, metrics snapshots in the text exposition format, and stream chunk logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracegauge.functions.text import strip

# Engine metric names per canonical name, preferred alias first.
METRIC_ALIASES = {
    "running": ["vllm:num_requests_running", "sglang:num_running_reqs"],
    "waiting": ["vllm:num_requests_waiting", "sglang:num_queue_reqs"],
    "kv_cache_usage": ["vllm:kv_cache_usage_perc", "vllm:gpu_cache_usage_perc", "sglang:token_usage"],
    "prefix_cache_queries": ["vllm:prefix_cache_queries_total", "vllm:prefix_cache_queries", "vllm:gpu_prefix_cache_queries_total"],
    "prefix_cache_hits": ["vllm:prefix_cache_hits_total", "vllm:prefix_cache_hits", "vllm:gpu_prefix_cache_hits_total"],
}


def parse_telemetry(lines: DataFrame, column: str = "value") -> DataFrame:
    """Wide samples ``{t, metric: value, ..}`` to long rows; absent keys stay absent."""
    m = F.from_json(F.col(column), "map<string,double>")
    rest = [c for c in lines.columns if c != column]
    return lines.select(*rest, m.alias("_m")).select(
        *rest, F.col("_m")["t"].alias("t"), F.explode_outer(F.map_filter("_m", lambda k, v: (k != "t") & v.isNotNull() & ~F.isnan(v))).alias("metric", "value")
    ).where("metric IS NOT NULL")


def read_telemetry(spark: SparkSession, path: str) -> DataFrame:
    return parse_telemetry(spark.read.text(path))


def _metric_lines(snapshots: DataFrame, keys: Sequence[str], body: str) -> DataFrame:
    line = snapshots.select(*keys, F.explode_outer(F.split(body, "\n")).alias("_l")).select(*keys, strip(F.col("_l")).alias("_l"))
    return line.where((F.col("_l") != "") & ~F.col("_l").startswith("#"))


def parse_metrics_text(snapshots: DataFrame, keys: Sequence[str] = ("snapshot_id",), body: str = "body") -> DataFrame:
    """Value per metric name summed over its label sets, for many snapshots at once.

    Histogram buckets, creation times, NaN and unreadable values are skipped.
    """
    l = _metric_lines(snapshots, keys, body)
    labelled = F.contains("_l", F.lit("{"))
    name = F.when(labelled, F.regexp_extract("_l", r"^([^{]*)\{", 1)).otherwise(F.split_part("_l", F.lit(" "), F.lit(1)))
    rest = F.when(labelled, F.regexp_extract("_l", r"^.*\}(.*)$", 1)).otherwise(F.regexp_extract("_l", r"^\S+ (.*)$", 1))
    value = F.regexp_extract(F.trim(rest), r"^(\S+)", 1).try_cast("double")
    v = l.select(*keys, name.alias("metric"), value.alias("value"))
    good = v.where(~F.col("metric").rlike(r"(_bucket|_created)$") & F.col("value").isNotNull() & ~F.isnan("value"))
    return good.groupBy(*keys, "metric").agg(F.sum("value").alias("value"))


def strict_counter(snapshots: DataFrame, name: str, keys: Sequence[str] = ("snapshot_id",), body: str = "body") -> DataFrame:
    """Sum of exactly this counter per snapshot, or the reason it cannot be trusted (a reject row)."""
    # the name stands alone, with labels, and possibly with a timestamp after the value
    quoted = "".join(c if c.isalnum() or c in "_:" else "\\" + c for c in name)
    pattern = rf"^{quoted}(?:\{{[^\n]*\}})?\s+(\S+)(?:\s+\S+)?$"
    l = snapshots.select(*keys, F.explode_outer(F.split(body, "\n")).alias("_l"))
    v = l.select(*keys, F.when(F.col("_l").rlike(pattern), F.regexp_extract("_l", pattern, 1)).alias("raw")).withColumn("x", F.col("raw").try_cast("double"))
    bad = F.col("raw").isNotNull() & (F.col("x").isNull() | F.isnan("x") | (F.abs("x") == float("inf")) | (F.col("x") < 0))
    g = v.groupBy(*keys).agg(F.count("raw").alias("_n"), F.count_if(bad).alias("_bad"), F.sum("x").alias("_sum"))
    reason = F.when(F.col("_n") == 0, "missing").when(F.col("_bad") > 0, "invalid")
    return g.select(*keys, F.when(reason.isNull(), F.col("_sum")).alias("value"), reason.alias("reject"))


def canonical_metrics(metrics: DataFrame, aliases: dict[str, list[str]] = METRIC_ALIASES, keys: Sequence[str] = ("snapshot_id",)) -> DataFrame:
    """Engine names to canonical names; the first available alias of each name wins.

    The alias list is a short constant, compiled into one lookup instead of a join.
    """
    flat = [x for canon, names in aliases.items() for rank, n in enumerate(names) for x in (F.lit(n), F.struct(F.lit(canon).alias("c"), F.lit(rank).alias("r")))]
    hit = metrics.withColumn("_h", F.try_element_at(F.create_map(*flat), F.col("metric"))).where("_h IS NOT NULL")
    return hit.groupBy(*keys, F.col("_h.c").alias("canonical")).agg(F.min_by("value", "_h.r").alias("value"))


CHUNK = (
    "error STRING, usage STRUCT<prompt_tokens INT, completion_tokens INT>, choices ARRAY<STRUCT<finish_reason STRING, text STRING, "
    "delta STRUCT<role STRING, content STRING, reasoning_content STRING, reasoning STRING, tool_calls ARRAY<STRING>>>>"
)


def chunks_to_requests(chunks: DataFrame) -> DataFrame:
    """Stream payloads (request_id, ts, payload, send_ts) to request timings.

    A chunk is output if any choice carries text, reasoning or tool calls; role-only chunks are not.
    Nothing after a server error counts. One shuffle; the chunk times of a request are its record.
    """
    c = chunks.withColumn("j", F.from_json("payload", CHUNK, {"columnNameOfCorruptRecord": "_bad"}))
    some = lambda x: F.length(F.coalesce(x, F.lit(""))) > 0
    out = F.exists(
        F.coalesce("j.choices", F.array().cast("array<struct<finish_reason:string,text:string,delta:struct<role:string,content:string,reasoning_content:string,reasoning:string,tool_calls:array<string>>>>")),
        lambda x: some(x["text"]) | some(x["delta"]["content"]) | some(x["delta"]["reasoning_content"]) | some(x["delta"]["reasoning"])
        | (F.coalesce(F.size(x["delta"]["tool_calls"]), F.lit(0)) > 0),
    )
    finish = F.get(F.filter(F.transform("j.choices", lambda x: x["finish_reason"]), lambda x: x.isNotNull()), F.lit(0))
    r = c.select("request_id", "send_ts", F.struct(
        "ts", F.when(some(F.col("j.error")), F.lit(True)).otherwise(False).alias("err"), out.alias("out"),
        F.col("j.usage").alias("usage"), finish.alias("finish"),
    ).alias("k"))
    g = r.groupBy("request_id").agg(F.min("send_ts").alias("send_ts"), F.array_sort(F.collect_list("k")).alias("ks"))
    upto = F.coalesce(F.get(F.filter("ks", lambda k: k["err"]), F.lit(0))["ts"], F.lit(float("inf")))
    g = g.withColumn("end_ts", upto).withColumn("seen", F.filter("ks", lambda k: k["ts"] <= F.col("end_ts")))
    g = g.withColumn("times", F.transform(F.filter("seen", lambda k: k["out"] & ~k["err"]), lambda k: k["ts"]))
    n = F.size("times")
    ms = lambda t: (t - F.col("send_ts")) * 1000.0
    has = lambda a: F.size(a) > 0
    usage = F.filter(F.transform("seen", lambda k: k["usage"]), lambda u: u.isNotNull())
    fin = F.filter(F.transform("seen", lambda k: k["finish"]), lambda u: u.isNotNull())
    err = F.when(F.col("end_ts") < float("inf"), "http_5xx").when(n == 0, "empty_output")
    return g.select(
        "request_id", "send_ts", err.isNull().alias("ok"), err.alias("error"),
        ms(F.get("ks", F.lit(0))["ts"]).alias("first_byte_ms"), ms(F.get("times", F.lit(0))).alias("ttft_ms"),
        ms(F.element_at("seen", -1)["ts"]).alias("e2e_ms"), n.alias("n_chunks"),
        F.when(n > 1, F.zip_with(F.slice("times", 2, F.greatest(n - 1, F.lit(1))), F.slice("times", 1, F.greatest(n - 1, F.lit(1))), lambda b, a: F.round((b - a) * 1000.0, 3)))
        .otherwise(F.array().cast("array<double>")).alias("chunk_gaps_ms"),
        F.when(has(usage), F.try_element_at(usage, F.lit(-1))).alias("usage"), F.when(has(fin), F.try_element_at(fin, F.lit(-1))).alias("finish_reason"),
    )


def to_request_record(timings: DataFrame) -> DataFrame:
    """Token counts from server usage, else the number of chunks of a successful request."""
    from tracegauge.functions.serving import tpot_ms

    counted = F.when(F.col("ok") & (F.col("n_chunks") > 0), F.col("n_chunks"))
    out = F.coalesce(F.col("usage.completion_tokens"), counted)
    source = F.when(F.col("usage.completion_tokens").isNotNull(), "server_usage").when(counted.isNotNull(), "chunk_count")
    t = timings.withColumns({"input_tokens": F.col("usage.prompt_tokens"), "output_tokens": out, "token_count_source": source})
    return t.withColumn("tpot_ms", F.when(F.col("ok"), tpot_ms(F.col("ttft_ms"), F.col("e2e_ms"), F.col("output_tokens"))))
