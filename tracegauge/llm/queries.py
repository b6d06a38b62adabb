"""The registered queries of the corpus operators and, where SQL can say it, their twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracegauge.llm import decontaminate, licenses, lloyd, packing, pii, quality, relative_lz, simhash, suffixes, topk, urls, warc, whitening

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def _re2(pattern: str) -> str:
    return pattern.replace("'", "''")


@query("op9_quality_rules", rf"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    p AS (SELECT doc_id, text, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
            list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
    w AS (SELECT doc_id, len(words) AS n, unnest(range(1, len(words) - 6)) AS i, words FROM p WHERE len(words) > 8),
    h AS (SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS v FROM w),
    r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, v) AS c FROM h) WHERE c > 1),
    c AS (SELECT doc_id, sum(least(8, coalesce(nxt - i, 8))) AS n_repeat FROM
            (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM r) GROUP BY doc_id),
    m AS (SELECT doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
            len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
            list_sum(list_transform(lines, lambda x: length(x))) AS line_chars,
            list_sum(list_transform(list_filter(lines, lambda x: regexp_matches(x, '{_re2(quality.NAVIGATION)}')
              OR regexp_matches(x, '{_re2(quality.BOILERPLATE)}') OR NOT regexp_matches(x, '{quality.LETTER}')
              OR len(regexp_extract_all(x, '{_re2(quality.ODD_MARKS)}')) * 5 > length(x)
              OR (len(regexp_extract_all(x, '{quality.SHOUTING}')) >= 3 AND len(regexp_extract_all(x, '{quality.SHOUTING}')) * 20 > length(x))),
              lambda x: length(x))) AS lost FROM p),
    b AS (SELECT m.*, coalesce(n_repeat, 0) AS n_repeat_words FROM m LEFT JOIN c USING (doc_id))
    SELECT doc_id, n_words, word_chars::BIGINT AS word_chars, n_symbols, n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
      n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
      NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND coalesce(lost, 0) * 100 <= coalesce(line_chars, 0) * 50 AS kept
    FROM b""")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = quality.assess(documents(spark, sf_dir))
    cols = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return q.select("doc_id", *(F.col("quality")[c].alias(c) for c in cols))


@query("op2_license_scans")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(documents(spark, sf_dir))
    places, base = F.col("base_words"), F.col("base_labels")
    both = F.array_sort(F.array_union(base, F.array_distinct(F.transform("matches", lambda m: m["label"]))))
    return found.select(
        "doc_id", "n_words", F.size(places).cast("long").alias("n_base"), F.array_min(places).alias("first_word"),
        F.array_max(places).alias("last_word"), F.array_join(base, ",").alias("base_labels"), F.array_join(both, ",").alias("labels"), "score",
    )


@query("op3_benchmark_decontamination", r"""
    WITH dw AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words FROM documents),
    bw AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words FROM benchmark),
    bi AS (SELECT item_id, words, unnest(range(1, greatest(len(words) - 12, 1) + 1)) AS i FROM bw WHERE len(words) > 0),
    win AS (SELECT DISTINCT item_id, least(13, len(words)) AS n, array_to_string(words[i:i + 12], ' ') AS w FROM bi),
    sizes AS (SELECT DISTINCT n FROM win),
    di AS (SELECT doc_id, n, words, unnest(range(1, len(words) - n + 2)) AS i FROM dw, sizes WHERE len(words) >= n),
    hit AS (SELECT d.doc_id, d.i, d.n, w.item_id FROM di d JOIN win w ON w.n = d.n AND w.w = array_to_string(d.words[d.i:d.i + d.n - 1], ' ')),
    pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
    it AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hit) GROUP BY doc_id)
    SELECT doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
      coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
    FROM dw LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)""")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = F.col("hits")
    marked = decontaminate.annotate(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return marked.select(
        "doc_id", hits["n_words"].alias("n_words"), decontaminate.n_hit(hits).alias("n_hit"), F.size(hits["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(hits["items"], ","), 256).alias("items_sha256"), decontaminate.contaminated(hits).alias("contaminated"),
    )


@query("op7_best_fit_packing")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


@query("op8_pii")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    def shown(spans: str) -> Column:
        rank = F.create_map(*(F.lit(x) for i, k in enumerate(pii.KINDS) for x in (k, i)))
        ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("a"), rank[x["kind"]].alias("r"), x["end"].alias("b"), x["kind"].alias("k"))))
        return F.array_join(F.transform(ordered, lambda x: F.concat_ws(":", x["k"], x["a"], x["b"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return pii.scan(documents(spark, sf_dir)).select("doc_id", *map(count, pii.KINDS), F.sha2(shown("base"), 256).alias("base_sha256"), shown("spans").alias("spans"))


@query("op1_simhash_near_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.classes(documents(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


# The rules of the query.
RULES = (
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"),
)
_RULE_ROWS = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)


@query("op4_url_filters", f"""
    WITH r(rhost, rpath, v) AS (VALUES {_RULE_ROWS}),
    s AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS t FROM pages),
    u AS (SELECT page_id, translate(regexp_extract(t, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
            regexp_extract(t, '^[^/?#]*([^?#]*)', 1) AS path FROM s),
    m AS (SELECT page_id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(v, length(rhost || rpath)) AS verdict
          FROM u JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id)
    SELECT page_id, host, path, rule, coalesce(verdict, '{urls.DEFAULT}') AS verdict FROM u LEFT JOIN m USING (page_id)""")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(RULES), "host string, path string, verdict string")
    return urls.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules)


@query("op5_warc", f"""
    WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
    f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= {warc.MIN_SHARED} GROUP BY 1)
    SELECT page_id, payload_bytes, payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
      CASE WHEN first <> page_id THEN first END AS refers_to FROM p LEFT JOIN f USING (payload_digest)""")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


@query("op6_suffix_array_dedup", """
    WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
    w AS (SELECT doc_id, i, md5(substr(h, (2 * i + 1)::BIGINT, 100)) AS v FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS i FROM d WHERE n >= 50)),
    dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY v) AS first FROM w) WHERE doc_id > first),
    edge AS (SELECT doc_id, i, i > coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50, -1) AS opens FROM dup),
    run AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM (SELECT doc_id, i, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM edge) GROUP BY doc_id, g),
    gap AS (SELECT r.doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY r.doc_id ORDER BY a), 0) AS prev FROM run r),
    kept AS (SELECT doc_id, string_agg(substr(h, (2 * prev + 1)::BIGINT, (2 * (a - prev))::BIGINT), '' ORDER BY a) AS k, max(b) AS last, sum(b - a) AS gone, count(*) AS runs
             FROM gap JOIN d USING (doc_id) GROUP BY doc_id)
    SELECT doc_id, n AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(runs, 0) AS n_spans,
      sha256(unhex(coalesce(k, '') || substr(h, (2 * coalesce(last, 0) + 1)::BIGINT))) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)""")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffixes.remove_repeats(documents(spark, sf_dir))
    return done.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query("op10_substring_dedup", r"""
    WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents),
    w AS (SELECT doc_id, i, md5(array_to_string(words[i:i + 49], ' ')) AS v FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM d WHERE len(words) >= 50)),
    dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY v) AS first FROM w) WHERE doc_id > first),
    gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM dup),
    word AS (SELECT doc_id, unnest(words) AS x, unnest(range(1, len(words) + 1)) AS p FROM d),
    kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS k, count(*) AS c FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
    SELECT doc_id, len(words) AS n_words, len(words) - coalesce(c, 0) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = relative_lz.remove_repeats(documents(spark, sf_dir))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")


#: Vectors without nulls and non-finite components, in SQL.
_SOUND = "embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0"


@query("op11_exact_top_k", f"""
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda c: floor(1024 * c::DOUBLE)::BIGINT) AS x FROM embeddings WHERE {_SOUND}),
    s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.x, c.x), lambda t: t[1] * t[2]))::BIGINT AS score
          FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(embeddings(spark, sf_dir))


@query("op12_embedding_whitening")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(embeddings(spark, sf_dir))


def _lloyd_sql(rounds: int = 3, k: int = 16) -> str:
    steps = [f"""v AS (SELECT vec_id, list_transform(embedding, lambda c: floor(64 * c::DOUBLE)::BIGINT) AS x FROM embeddings WHERE len(embedding) = 64 AND {_SOUND}),
    c0 AS (SELECT (row_number() OVER (ORDER BY h) - 1)::INTEGER AS i, x FROM
           (SELECT x, sha256('1:' || vec_id::VARCHAR) AS h FROM v ORDER BY h LIMIT {k}))"""]
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS (SELECT vec_id, any_value(v.x) AS x, min((d, i)) AS b FROM
           (SELECT vec_id, v.x, i, list_sum(list_transform(list_zip(v.x, c{r}.x), lambda t: (t[1] - t[2]) * (t[1] - t[2])))::BIGINT AS d FROM v, c{r}) AS v GROUP BY vec_id)""")
        if r < rounds:
            steps.append(f"""u{r} AS (SELECT i, p, sum(e) AS s, count(*) AS n FROM (SELECT b[2] AS i, unnest(x) AS e, unnest(range(1, 65)) AS p FROM a{r}) GROUP BY i, p),
    m{r} AS (SELECT i, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY p) AS x FROM u{r} GROUP BY i),
    c{r + 1} AS (SELECT c.i, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN m{r} m USING (i))""")
    return "WITH " + ",\n    ".join(steps) + f"""
    SELECT vec_id, b[2]::INTEGER AS cluster, b[1]::BIGINT AS distance, sum(b[1]) OVER (PARTITION BY b[2])::BIGINT AS cluster_inertia,
      sum(b[1]) OVER ()::BIGINT AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
    FROM a{rounds} JOIN c{rounds} c ON c.i = b[2]"""


@query("op13_centroid_clustering", _lloyd_sql())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lloyd.cluster(embeddings(spark, sf_dir))
