"""Call logs and run files as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracegauge.functions.text import render_prompt, strict_json

MESSAGES = "array<struct<role:string,content:variant>>"
REQUEST_SCHEMA = (
    "idx INT, level DOUBLE, repeat INT, ok BOOLEAN, error STRING, error_detail STRING, send_ts DOUBLE, headers_ms DOUBLE, "
    "first_byte_ms DOUBLE, ttft_ms DOUBLE, e2e_ms DOUBLE, tpot_ms DOUBLE, chunk_gaps_ms ARRAY<DOUBLE>, n_chunks INT, "
    "input_tokens INT, output_tokens INT, token_count_source STRING, prefix_group STRING, slo_ok BOOLEAN"
)


def content_text(content: Column) -> Column:
    """Message content as text: a string as it is, an array of parts joined by their ``text``."""
    parts = F.try_variant_get(content, "$", "array<variant>")
    joined = F.array_join(F.transform(parts, lambda p: F.coalesce(F.try_variant_get(p, "$.text", "string"), F.lit(""))), "")
    is_array = F.schema_of_variant(content).startswith("ARRAY")
    return F.coalesce(F.when(is_array, joined).otherwise(F.try_variant_get(content, "$", "string")), F.lit(""))


def parse_traces(lines: DataFrame, column: str = "value") -> DataFrame:
    """JSON lines of two shapes (flat, or request/response) to call traces.

    Lines that are not complete JSON or carry no messages are dropped. A count of zero falls back
    to the usage block like a missing one.
    """
    v = lines.withColumn("_v", strict_json(F.col(column))).where("_v IS NOT NULL")
    get = lambda p, t: F.try_variant_get("_v", p, t)
    nested = F.schema_of_variant(get("$.request", "variant")).startswith("OBJECT")
    raw = F.when(nested, get("$.request.messages", MESSAGES)).otherwise(get("$.messages", MESSAGES))
    usage = lambda k: F.coalesce(get(f"$.response.usage.{k}", "int"), get(f"$.usage.{k}", "int"))
    count = lambda k: F.coalesce(F.nullif(get(f"$.{k}", "int"), F.lit(0)), usage(k))
    calls = F.transform(
        F.coalesce(get("$.response.choices", "array<variant>"), F.array().cast("array<variant>")),
        lambda c: F.coalesce(F.size(F.try_variant_get(c, "$.message.tool_calls", "array<variant>")), F.lit(0)),
    )
    flat = v.select(
        *[c for c in lines.columns if c != column],
        get("$.ts", "double").alias("ts"),
        F.transform(raw, lambda m: F.struct(F.coalesce(m["role"], F.lit("user")).alias("role"), content_text(m["content"]).alias("content"))).alias("messages"),
        count("prompt_tokens").alias("prompt_tokens"),
        count("completion_tokens").alias("completion_tokens"),
        get("$.latency_ms", "double").alias("latency_ms"),
        get("$.ttft_ms", "double").alias("ttft_ms"),
        F.coalesce(get("$.stream", "boolean"), get("$.request.stream", "boolean")).alias("stream"),
        F.coalesce(F.nullif(get("$.model", "string"), F.lit("")), get("$.request.model", "string")).alias("model"),
        get("$.completion", "string").alias("completion"),
        F.aggregate(calls, F.lit(0), lambda a, n: a + F.greatest(n, F.lit(0))).alias("tool_calls"),
    )
    return flat.where(F.size("messages") > 0).withColumn("prompt", render_prompt(F.col("messages")))


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    return parse_traces(spark.read.text(path))


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """Per-request JSON lines with the fixed schema; ``run_id`` comes from the partition folder."""
    return spark.read.schema(REQUEST_SCHEMA + ", run_id STRING").json(path)


def write_run(requests: DataFrame, path: str, fmt: str = "parquet") -> None:
    """One folder per run, so a reader of some runs prunes the others."""
    requests.write.partitionBy("run_id").mode("overwrite").format(fmt).save(path)


def split_broken(lines: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """(complete rows with their parsed variant, truncated lines); broken lines are kept, never counted."""
    v = lines.where(F.trim(column) != "").withColumn("record", strict_json(F.col(column)))
    return v.where("record IS NOT NULL"), v.where("record IS NULL").drop("record")


def flatten_json(df: DataFrame, column: str, depth: int = 16, max_keys: int | None = None) -> DataFrame:
    """Leaf values of nested JSON objects as (keypath, value) rows; ``max_keys`` keeps the first ones per document.

    Arrays are no leaves and are left out. The nesting is unrolled to ``depth`` levels inside one
    expression, so a document is read once and nothing is shuffled; an object below that is one leaf, as JSON text.
    """
    leaf_type = "array<struct<keypath:string,value:string>>"

    def leaves(obj: Column, prefix: Column | None, left: int) -> Column:
        entries = F.map_entries(F.try_variant_get(obj, "$", "map<string,variant>"))

        def one(e: Column) -> Column:
            path = e["key"] if prefix is None else F.concat(prefix, F.lit("."), e["key"])
            kind = F.schema_of_variant(e["value"])
            leaf = F.array(F.struct(path.alias("keypath"), F.try_variant_get(e["value"], "$", "string").alias("value")))
            none = F.array().cast(leaf_type)
            rest = F.array(F.struct(path.alias("keypath"), F.to_json(e["value"]).alias("value")))
            deeper = leaves(e["value"], path, left - 1) if left > 1 else rest
            return F.when(kind.startswith("OBJECT"), deeper).when(kind.startswith("ARRAY"), none).otherwise(leaf)

        return F.flatten(F.transform(entries, one))

    v = df.withColumn("_v", strict_json(F.col(column))).where("_v IS NOT NULL")
    keep = [c for c in df.columns if c != column]
    found = leaves(F.col("_v"), None, depth)
    return v.select(*keep, (found if max_keys is None else F.slice(found, 1, max_keys)).alias("_l")).select(
        *keep, F.explode_outer("_l").alias("l")
    ).where("l IS NOT NULL").select(*keep, "l.*")


def campaign_catalog(paths: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """Campaign folders (``YYYY-MM-DD[-name]/..``) with the result kinds, report and notes they hold."""
    p = paths.select(
        F.regexp_extract("path", r"^(\d{4}-\d{2}-\d{2}(?:-[a-z0-9-]+)?)/", 1).alias("campaign"),
        F.regexp_extract("path", r"^[^/]+/(.*)$", 1).alias("file"),
    ).where("campaign <> ''")
    kind = F.element_at(F.create_map(*[F.lit(x) for k, f in wanted.items() for x in (f, k)]), F.col("file"))
    p = p.withColumn("kind", F.when(F.col("file").isin(*wanted.values()), kind))
    g = p.groupBy("campaign").agg(
        F.array_sort(F.collect_set("kind")).alias("available"),
        F.bool_or(F.col("file") == "REPORT.md").alias("has_report"), F.bool_or(F.col("file") == "NOTES.md").alias("has_notes"),
    )
    return g.where((F.size("available") > 0) | F.col("has_report") | F.col("has_notes"))
