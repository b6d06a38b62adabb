"""Model, engine and retrieval mentions in architecture documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracegauge.functions.text import redact, strip

# What counts as a mention.
MODEL_PATTERNS = {
    "openai": r"(?i)\b(gpt-4o(?:-mini)?|gpt-4\.1(?:-mini|-nano)?|gpt-4(?:-turbo)?|gpt-3\.5-turbo|gpt-5(?:\.\d)?(?:-mini|-nano)?|o[134](?:-mini)?)\b",
    "anthropic": r"(?i)\b(claude[- ](?:opus|sonnet|haiku|fable)?[- ]?[\d.]*[\w.-]*|claude-[\w.-]+)\b",
    "meta": r"(?i)\b(llama[- ]?\d(?:\.\d)?[\w.-]*)\b",
    "qwen": r"(?i)\b(qwen[\d.]*(?:-[\w.]+)*)\b",
    "mistral": r"(?i)\b(mistral[\w.-]*|mixtral[\w.-]*)\b",
    "google": r"(?i)\b(gemini[\w.-]*|gemma[\w.-]*)\b",
    "deepseek": r"(?i)\b(deepseek[\w.-]*)\b",
}
ENGINE_PATTERNS = {
    "vllm": r"(?i)\bvllm\b", "sglang": r"(?i)\bsglang\b", "ollama": r"(?i)\bollama\b",
    "tgi": r"(?i:\btext[- ]generation[- ]inference\b)|\bTGI\b", "tensorrt-llm": r"(?i)\btensorrt[- ]llm\b",
}
RETRIEVAL = r"(?i)\b(retriev\w*|vector (?:store|database|search)|embeddings?|RAG|pgvector|bm25|semantic search|documentation search|knowledge base)\b"
ARCHITECTURE_DOC = r"(?i)(^|/)(readme|architecture|design|overview|system|contributing)[^/]*\.(md|mdx|rst|txt)$"


EXCERPT = 300


def _item(kind: str, value: Column, maker: str | None = None) -> Column:
    return F.struct(F.lit(kind).alias("kind"), value.alias("value"), F.lit(maker).cast("string").alias("provider"))


def _model(maker: str) -> Callable[[Column], Column]:
    return lambda v: _item("model", F.regexp_replace(F.trim(v), r"\.+$", ""), maker)


def doc_mentions(docs: DataFrame, keys: list[str], path: str = "path") -> DataFrame:
    """(keys, line, kind, value, provider, excerpt) per mention in an architecture document; the pattern list is a constant, not a joined table.

    ``provider`` is the model's maker. The excerpt is the trimmed line without secrets, cut to ``EXCERPT`` characters. A readme's
    first heading is a mention of kind ``title`` on line 1. Other files say nothing about the architecture.
    """
    held = docs.where(F.col(path).rlike(ARCHITECTURE_DOC))
    lines = held.select(*keys, path, F.posexplode_outer(F.split("text", "\n")).alias("i", "l"))
    found = []
    for maker, p in MODEL_PATTERNS.items():
        hits = F.regexp_extract_all("l", F.lit(p), F.lit(1))
        found.append(F.transform(hits, _model(maker)))
    engines = F.filter(F.array(*[F.when(F.col("l").rlike(p), F.lit(e)) for e, p in ENGINE_PATTERNS.items()]), lambda e: e.isNotNull())
    found.append(F.transform(engines, lambda e: _item("engine", e)))
    first = F.slice(F.regexp_extract_all("l", F.lit(RETRIEVAL), F.lit(1)), 1, 1)
    found.append(F.transform(first, lambda v: _item("retrieval", v)))
    m = lines.select(*keys, (F.col("i") + 1).alias("line"), F.col("l"), F.concat(*found).alias("_m"))
    said = m.where(F.size("_m") > 0).withColumn("excerpt", F.substring(redact(strip(F.col("l"))), 1, EXCERPT))
    said = said.select(*keys, "line", F.explode("_m").alias("m"), "excerpt")
    heading = F.regexp_extract("text", r"(?m)^# (.*)$", 1)
    title = strip(F.regexp_replace(heading, "^[# ]+", ""))
    titled = held.where(F.lower(F.element_at(F.split(path, "/"), -1)).startswith("readme") & (title != ""))
    titles = titled.select(*keys, F.lit(1).alias("line"), _item("title", title).alias("m"), F.substring(redact(title), 1, EXCERPT).alias("excerpt"))
    return said.unionByName(titles).select(*keys, "line", "m.*", "excerpt")
