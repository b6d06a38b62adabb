"""Prefix-reuse and workload-fingerprint queries over documents, conversations and traces."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from tracegauge.functions.text import TOKEN, approx_token_count
from tracegauge.operators import prefix as P
from tracegauge.plans import views as V
from tracegauge.plans.registry import query, sql_view


def prompts(spark, d):
    return V.table(spark, d, "documents").select(F.col("doc_id").alias("seq"), "lang", "source", F.col("text").alias("prompt"))


def _reuse_ctes(text: str) -> str:
    """The chained digest equals, for equality, the digest of the whole token prefix."""
    return f"""
    WITH t AS (SELECT doc_id AS seq, lang, regexp_extract_all({text}, '{TOKEN}') AS tok FROM documents),
    b AS (SELECT seq, i - 1 AS pos, md5(array_to_string(tok[1:16 * i], chr(31))) AS dg FROM (SELECT seq, tok, unnest(range(1, len(tok) // 16 + 1)) AS i FROM t)),
    f AS (SELECT *, min(seq) OVER (PARTITION BY dg) AS first_seq, lag(seq) OVER (PARTITION BY dg ORDER BY seq) AS prev FROM b),
    r AS (SELECT t.seq, t.lang, len(tok)::BIGINT AS n_tokens, (len(tok) // 16)::BIGINT AS n_blocks,
      coalesce((SELECT min(pos) FROM f WHERE f.seq = t.seq AND f.first_seq = f.seq), len(tok) // 16)::BIGINT AS reused_blocks FROM t)
    """


@query("X1_prefix_reuse", sql=_reuse_ctes("text") + "SELECT seq, n_tokens, n_blocks, reused_blocks FROM r")
def x1(spark, d):
    return P.prefix_reuse(prompts(spark, d))


@query("P6_block_digests", sql=_reuse_ctes("text") + "SELECT seq, count(*) AS n_blocks, count(*) FILTER (first_seq < seq) AS seen_before FROM f GROUP BY seq")
def p6(spark, d):
    """Blocks per prompt and how many occurred in an earlier prompt (at any position of the chain)."""
    b = P.prompt_blocks(prompts(spark, d))
    firsts = b.groupBy("digest").agg(F.min("seq").alias("seq"), F.count("*").alias("c"))
    new = firsts.groupBy("seq").agg(F.count("*").alias("n_new"))
    return b.groupBy("seq").agg(F.count("*").alias("n_blocks")).join(new, "seq", "left").select(
        "seq", "n_blocks", (F.col("n_blocks") - F.coalesce("n_new", F.lit(0))).alias("seen_before")
    )


@query(
    "X1_reuse_ratio",
    sql=_reuse_ctes("text") + """SELECT lang, sum(reused_blocks * 16)::BIGINT AS reused_tokens, sum(n_tokens)::BIGINT AS total_tokens,
      round(sum(reused_blocks * 16) / sum(n_tokens), 9) AS ratio FROM r GROUP BY lang""",
)
def x1r(spark, d):
    p = prompts(spark, d)
    r = P.prefix_reuse(p).join(p.select("seq", "lang"), "seq")
    return P.reuse_ratio(r, keys=["lang"]).withColumn("ratio", F.round("ratio", 9))


@F.arrow_udf(ArrayType(StringType()))
def whitespace_tokens(text: pa.Array) -> pa.Array:
    """A stand-in for a model's tokenizer: whole Arrow batches in, token lists out."""
    return pc.ascii_split_whitespace(pc.ascii_trim_whitespace(text))


@query(
    "U8_tokenizer_hook",
    sql=_reuse_ctes("text").replace(f"regexp_extract_all(text, '{TOKEN}')", r"string_split_regex(trim(text, E' \t\n\x0B\f\r'), '[ \t\n\x0B\f\r]+')") + "SELECT seq, n_tokens, n_blocks, reused_blocks FROM r",
)
def u8(spark, d):
    """Prefix reuse with a tokenizer of the caller's."""
    return P.prefix_reuse(prompts(spark, d), tokenize=whitespace_tokens)


GAPS = (50, 200, 1000)


@query(
    "X2_reuse_gap_curve",
    sql=_reuse_ctes("text") + """, g AS (SELECT unnest([50, 200, 1000])::INTEGER AS gap),
    m AS (SELECT gap, seq, count(*) AS n, min(CASE WHEN prev IS NULL OR seq - prev > gap THEN pos END) AS miss FROM f, g GROUP BY ALL)
    SELECT gap, (sum(coalesce(miss, n)) * 16)::BIGINT AS reused_tokens FROM m GROUP BY gap""",
)
def x2(spark, d):
    return P.reuse_gap_curve(prompts(spark, d), GAPS)


@query(
    "X3_dynamic_head",
    sql=_reuse_ctes("doc_id::VARCHAR || ' ' || text") + """SELECT 'head' AS placement, sum(reused_blocks * 16)::BIGINT AS reused_tokens, sum(n_tokens)::BIGINT AS total_tokens FROM r
      UNION ALL """ + "SELECT * FROM (" + _reuse_ctes("text || ' ' || doc_id::VARCHAR") + "SELECT 'tail' AS placement, sum(reused_blocks * 16)::BIGINT AS reused_tokens, sum(n_tokens)::BIGINT AS total_tokens FROM r)",
)
def x3(spark, d):
    """Reuse when per-request metadata leads the prompt against when it trails it."""
    p = prompts(spark, d)
    one = lambda tag, text: P.reuse_ratio(P.prefix_reuse(p.withColumn("prompt", text))).select(F.lit(tag).alias("placement"), "reused_tokens", "total_tokens")
    meta = F.col("seq").cast("string")
    return one("head", F.concat(meta, F.lit(" "), F.col("prompt"))).unionByName(one("tail", F.concat(F.col("prompt"), F.lit(" "), meta)))


# ---------------------------------------------------------------- groups and fingerprint

sql_view("sys_prompts", "SELECT seq, prompt, coalesce(system, '') AS system, model FROM traces", "traces")


def sys_prompts(spark, d):
    from tracegauge.functions.text import first_system, render_prompt

    t = V.traces(spark, d)
    return t.select("seq", "model", render_prompt(F.col("messages")).alias("prompt"), first_system(F.col("messages")).alias("system"))


GROUPS_SQL = f"""WITH g AS (SELECT substr(sha256(system), 1, 12) AS prefix_hash, seq, regexp_extract_all(prompt, '{TOKEN}') AS tok FROM sys_prompts WHERE system <> ''),
    f AS (SELECT prefix_hash, count(*) AS n, arg_min(tok, seq) AS ft FROM g GROUP BY prefix_hash HAVING count(*) >= 2),
    c AS (SELECT g.prefix_hash, f.n, coalesce(list_min(list_filter(range(1, least(len(tok), len(ft)) + 1), lambda i: tok[i] <> ft[i])) - 1, least(len(tok), len(ft))) AS common FROM g JOIN f USING (prefix_hash)),
    groups AS (SELECT prefix_hash, n, min(common)::BIGINT AS tokens, n / (SELECT count(*) FROM sys_prompts) AS share FROM c GROUP BY prefix_hash, n)"""


@query("A9_prefix_groups", "sys_prompts", sql=GROUPS_SQL + "SELECT prefix_hash, n, tokens, round(share, 9) AS share FROM groups")
def a9(spark, d):
    return P.prefix_groups(sys_prompts(spark, d)).withColumn("share", F.round("share", 9))


@query(
    "A18_expected_hit_rate", "sys_prompts",
    sql=GROUPS_SQL + f"""SELECT round((SELECT sum(tokens * share) FROM groups) / (SELECT avg(len(regexp_extract_all(prompt, '{TOKEN}'))) FROM sys_prompts), 8) AS expected_hit_rate""",
)
def a18h(spark, d):
    p = sys_prompts(spark, d)
    shared = P.prefix_groups(p).agg(F.sum(F.col("tokens") * F.col("share")).alias("s"))
    mean = p.agg(F.avg(approx_token_count(F.col("prompt"))).alias("m"))
    return mean.select(F.round(shared.scalar() / F.col("m"), 8).alias("expected_hit_rate"))


@query(
    "A36_minimum_shared_prefix", "sys_prompts",
    sql="""WITH f AS (SELECT system, arg_min(prompt, seq) AS fp FROM sys_prompts WHERE system <> '' GROUP BY system)
    SELECT md5(p.system) AS system_digest, min(list_max(list_filter(range(0, least(length(prompt), length(fp)) + 1), lambda i: substring(prompt, 1, i) = substring(fp, 1, i))))::BIGINT AS shared
    FROM sys_prompts p JOIN f USING (system) GROUP BY p.system""",
)
def a36(spark, d):
    p = sys_prompts(spark, d).where("system <> ''")
    return P.shared_prefix(p, "system").select(F.md5("system").alias("system_digest"), "shared")


@query(
    "A10_fingerprint", "traces",
    sql=f"""WITH p AS (SELECT *, len(regexp_extract_all(prompt, '{TOKEN}')) AS in_tok, ts - coalesce(latency_ms, 0) / 1000.0 AS start FROM traces),
    g AS (SELECT start - lag(start) OVER (ORDER BY start, seq) AS gap FROM p),
    ev AS (SELECT start AS t, 1 AS d FROM p UNION ALL SELECT ts, -1 FROM p),
    o AS (SELECT sum(d) OVER (ORDER BY t, d ROWS UNBOUNDED PRECEDING) AS open FROM ev),
    md AS (SELECT model FROM p GROUP BY model ORDER BY count(*) DESC, model LIMIT 1),
    tk AS (SELECT seq, regexp_extract_all(prompt, '{TOKEN}') AS tok FROM traces),
    b AS (SELECT seq, i - 1 AS pos, md5(array_to_string(tok[1:16 * i], chr(31))) AS dg FROM (SELECT seq, tok, unnest(range(1, len(tok) // 16 + 1)) AS i FROM tk)),
    fs AS (SELECT *, min(seq) OVER (PARTITION BY dg) AS first_seq FROM b),
    ru AS (SELECT sum(16 * coalesce((SELECT min(pos) FROM fs WHERE fs.seq = tk.seq AND fs.first_seq = fs.seq), len(tok) // 16)) / sum(len(tok)) AS ratio FROM tk),
    s AS (SELECT count(*) AS n_observed, round(max(start) - min(start), 6) AS window_s, round((count(*) - 1) / (max(start) - min(start)), 8) AS mean_rps,
      round((SELECT stddev_pop(gap) / avg(gap) FROM g), 6) AS cv_interarrival, (SELECT max(open) FROM o)::BIGINT AS peak_concurrency,
      round(avg(stream::INTEGER), 8) AS streaming_ratio, round(quantile_cont(in_tok, 0.95), 6) AS input_p95, round(quantile_cont(completion_tokens, 0.95), 6) AS output_p95,
      round((SELECT ratio FROM ru), 8) AS reuse_ratio, (SELECT model FROM md) AS model FROM p)
    SELECT *, array_to_string(list_filter([CASE WHEN streaming_ratio >= 0.5 AND output_p95 <= 1024 THEN 'interactive' END, CASE WHEN streaming_ratio < 0.5 THEN 'batch' END,
      CASE WHEN input_p95 > 8000 THEN 'long_context' END, CASE WHEN peak_concurrency > 32 THEN 'high_concurrency' END], lambda x: x IS NOT NULL), ',') AS traffic_class FROM s""",
)
def a10(spark, d):
    from tracegauge.operators.fingerprint import fingerprint

    f = fingerprint(V.traces(spark, d))
    return f.select(
        "n_observed", F.round("window_s", 6).alias("window_s"), F.round("mean_rps", 8).alias("mean_rps"), F.round("cv_interarrival", 6).alias("cv_interarrival"),
        "peak_concurrency", F.round("streaming_ratio", 8).alias("streaming_ratio"), F.round("input_p95", 6).alias("input_p95"), F.round("output_p95", 6).alias("output_p95"),
        F.round("reuse_ratio", 8).alias("reuse_ratio"), "model", F.array_join("traffic_class", ",").alias("traffic_class"),
    )


@query(
    "P23_traffic_class", "traces",
    sql=f"""WITH s AS (SELECT model, avg(stream::INTEGER) AS sr, quantile_cont(len(regexp_extract_all(prompt, '{TOKEN}')), 0.95) AS ip, quantile_cont(completion_tokens, 0.95) AS op FROM traces GROUP BY model)
    SELECT model, array_to_string(list_filter([CASE WHEN sr >= 0.5 AND op <= 1024 THEN 'interactive' END, CASE WHEN sr < 0.5 THEN 'batch' END, CASE WHEN ip > 8000 THEN 'long_context' END], lambda x: x IS NOT NULL), ',') AS traffic_class FROM s""",
)
def p23(spark, d):
    from tracegauge.functions.text import render_prompt
    from tracegauge.operators.fingerprint import traffic_class
    from tracegauge.operators.quantiles import exact_quantiles

    t = V.traces(spark, d).withColumn("in_tok", approx_token_count(render_prompt(F.col("messages"))))
    s = t.groupBy("model").agg(F.avg(F.col("stream").cast("double")).alias("streaming_ratio"))
    i = exact_quantiles(t, ["model"], "in_tok", {"input_p95": 0.95}).drop("n")
    o = exact_quantiles(t, ["model"], "completion_tokens", {"output_p95": 0.95}).drop("n")
    j = s.join(i, "model", "left").join(o, "model", "left")
    return j.select("model", F.array_join(traffic_class(peak=F.lit(None).cast("long"), tool_calls=F.lit(0)), ",").alias("traffic_class"))
