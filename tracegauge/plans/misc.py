"""Retrieval, resampling, synthesis, exact tests, jobs and deliveries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tracegauge.functions import mentions as MN
from tracegauge.functions import stats as ST
from tracegauge.operators import calibration as K
from tracegauge.operators import jobs as JB
from tracegauge.operators import resample as RS
from tracegauge.operators import retrieval as RT
from tracegauge.operators import serving as S
from tracegauge.operators import synth as SY
from tracegauge.plans import views as V
from tracegauge.plans.registry import query, shared_view, view

# ---------------------------------------------------------------- K7

shared_view("headed", "SELECT doc_id, '## ' || source || chr(10) || text AS text FROM {documents}")


@query(
    "K7_bm25_top_k",
    sql="""
    WITH ch AS (SELECT doc_id AS chunk_id, regexp_extract_all(lower(source || ' ' || trim(text)), '[a-z0-9]+') AS tok FROM documents),
    ln AS (SELECT chunk_id, len(tok) AS l FROM ch), tf AS (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest(tok) AS term FROM ch) GROUP BY ALL),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), ri AS (SELECT term, ln((SELECT count(*) FROM ln) - df + 0.5) - ln(df + 0.5) AS idf FROM df),
    idf AS (SELECT term, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM ri) ELSE idf END AS idf FROM ri),
    q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark) GROUP BY ALL),
    sc AS (SELECT query_id, chunk_id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l / (SELECT avg(l) FROM ln)))) AS score FROM q JOIN idf USING (term) JOIN tf USING (term) JOIN ln USING (chunk_id) GROUP BY ALL)
    SELECT query_id, chunk_id, rank::INTEGER AS rank, round(score, 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM sc) WHERE rank <= 5""",
)
def k7(spark, d):
    s = RT.sections(view(spark, d, "headed")).select(F.col("doc_id").alias("chunk_id"), F.concat_ws(" ", "heading", "body").alias("text"))
    q = V.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return RT.bm25(s, q, 5).select("query_id", "chunk_id", "rank", F.round("score", 5).alias("score"))


shared_view(
    "arch_docs",
    """SELECT id, path, CASE WHEN id % 24 = 0 THEN '# Service ' || CAST(id AS STRING) || chr(10) ELSE '' END || text
        || CASE WHEN lang = 'de' THEN chr(10) || 'We serve GPT-4o-mini and Qwen2.5-0.5B. on vLLM with a vector store; token = "q8Zr4Lk2Vw9Xt7Bn" ' WHEN lang = 'es' THEN chr(10) || 'TGI and llama-3.1 for RAG' ELSE '' END AS text
      FROM {files}""",
    "files",
)
_RAG = MN.RETRIEVAL


@query(
    "P24_doc_mentions", "arch_docs",
    sql=rf"""WITH a AS (SELECT id, path, string_split(text, chr(10)) AS ls, text FROM arch_docs WHERE regexp_matches(path, '{MN.ARCHITECTURE_DOC}')),
      l AS (SELECT id, unnest(ls) AS l, unnest(range(1, len(ls) + 1)) AS line FROM a),
      m AS (SELECT id, line, l, 'model' AS kind, unnest(['GPT-4o-mini', 'Qwen2.5-0.5B']) AS value, unnest(['openai', 'qwen']) AS provider FROM l WHERE l LIKE 'We serve GPT%'
        UNION ALL SELECT id, line, l, 'model', 'llama-3.1', 'meta' FROM l WHERE l LIKE 'TGI and%' UNION ALL SELECT id, line, l, 'engine', 'vllm', NULL FROM l WHERE regexp_matches(l, '(?i)\bvllm\b')
        UNION ALL SELECT id, line, l, 'engine', 'tgi', NULL FROM l WHERE regexp_matches(l, '\bTGI\b') UNION ALL SELECT id, line, l, 'retrieval', regexp_extract(l, '{_RAG}', 1), NULL FROM l WHERE regexp_matches(l, '{_RAG}'))
      SELECT id, line::INTEGER AS line, kind, value, provider, substr(replace(trim(l), 'q8Zr4Lk2Vw9Xt7Bn', '[REDACTED:assigned_secret]'), 1, 300) AS excerpt FROM m
      UNION ALL SELECT id, 1, 'title', substr(ls[1], 3), NULL, substr(ls[1], 3) FROM a WHERE path LIKE 'README%' AND ls[1] LIKE '# Service%'""",
)
def p24(spark, d):
    """Models with their makers, engines and retrieval words of architecture documents, with redacted excerpts; titles of readmes."""
    return MN.doc_mentions(view(spark, d, "arch_docs"), ["id"])


@query(
    "O5_array_set_algebra",
    sql="""SELECT doc_id, array_to_string(list_sort(list_filter(a, lambda x: NOT list_contains(b, x))), ',') AS missing, array_to_string(list_sort(list_intersect(a, b)), ',') AS shared, list_has_any(a, b) AS overlaps
      FROM (SELECT doc_id, [lang, source] AS a, [CASE WHEN doc_id % 2 = 0 THEN lang ELSE 'xx' END, CASE WHEN doc_id % 3 = 0 THEN source ELSE 'yy' END] AS b FROM documents)""",
)
def o5(spark, d):
    t = V.table(spark, d, "documents")
    a = F.array("lang", "source")
    b = F.array(F.when(F.col("doc_id") % 2 == 0, F.col("lang")).otherwise("xx"), F.when(F.col("doc_id") % 3 == 0, F.col("source")).otherwise("yy"))
    return t.select("doc_id", F.array_join(F.array_sort(F.array_except(a, b)), ",").alias("missing"), F.array_join(F.array_sort(F.array_intersect(a, b)), ",").alias("shared"), F.arrays_overlap(a, b).alias("overlaps"))


# ---------------------------------------------------------------- exact tests

FISHER = """WITH c AS (SELECT trial, count(*) FILTER (side = 'head' AND NOT failed) AS kh, count(*) FILTER (side = 'head') AS nh, count(*) FILTER (side = 'base' AND NOT failed) AS kb, count(*) FILTER (side = 'base') AS nb FROM
      (SELECT trial, side, failed OR (side = 'head' AND trial % 3 = 0 AND run = 1) AS failed FROM gate_samples) GROUP BY trial),
    p AS (SELECT *, least(list_sum(list_transform(range(greatest(0, kh + kb - nb), kh + 1), lambda k: exp(lgamma(nh + 1) - lgamma(k + 1) - lgamma(nh - k + 1) + lgamma(nb + 1) - lgamma(kh + kb - k + 1) - lgamma(nb - kh - kb + k + 1)
      - lgamma(nh + nb + 1) + lgamma(kh + kb + 1) + lgamma(nh + nb - kh - kb + 1)))), 1.0) AS p FROM c)"""


def _passes(spark, d):
    g = V.gate_samples(spark, d)
    bad = F.col("failed") | ((F.col("side") == "head") & (F.col("trial") % 3 == 0) & (F.col("run") == 1))
    n = lambda s, ok: F.count_if((F.col("side") == s) & (~bad if ok else F.lit(True)))
    c = g.groupBy("trial").agg(n("head", True).alias("kh"), n("head", False).alias("nh"), n("base", True).alias("kb"), n("base", False).alias("nb"))
    return c.withColumn("p", ST.fisher_less(F.col("kh"), F.col("nh"), F.col("kb"), F.col("nb")))


@query("A30_fisher_exact", "gate_samples", sql=FISHER + " SELECT trial, kh, nh, kb, nb, round(p, 7) AS p FROM p")
def a30(spark, d):
    return _passes(spark, d).withColumn("p", F.round("p", 7))


@query(
    "A31_quality_drop", "gate_samples",
    sql=FISHER + """ SELECT trial, round(kb / nb * 100 - kh / nh * 100, 7) AS drop_pts, CASE WHEN kb / nb * 100 - kh / nh * 100 > 5 AND p < 0.05 THEN 'fail' WHEN kb / nb * 100 - kh / nh * 100 > 5 THEN 'warn' ELSE 'pass' END AS verdict FROM p""",
)
def a31(spark, d):
    """A drop of more than 5 points fails if significant and warns otherwise."""
    drop = F.col("kb") / F.col("nb") * 100 - F.col("kh") / F.col("nh") * 100
    v = F.when((drop > 5) & (F.col("p") < 0.05), "fail").when(drop > 5, "warn").otherwise("pass")
    return _passes(spark, d).select("trial", F.round(drop, 7).alias("drop_pts"), v.alias("verdict"))


@query(
    "A48_share_passing",
    sql="SELECT l_suppkey AS question, count(*) AS answers, round(avg((l_returnflag <> 'R' AND l_linestatus <> 'F')::INTEGER), 8) AS share FROM lineitem GROUP BY l_suppkey",
)
def a48(spark, d):
    """Share of sampled answers that pass per question; a failed request counts as a failed answer."""
    li = V.table(spark, d, "lineitem")
    ok = (F.col("l_returnflag") != "R") & (F.col("l_linestatus") != "F")
    return li.groupBy(F.col("l_suppkey").alias("question")).agg(F.count("*").alias("answers"), F.round(F.avg(ok.cast("double")), 8).alias("share"))


# ---------------------------------------------------------------- bootstrap, from keyed random numbers

def _uniform(digest: str, i: int = 0) -> str:
    """SQL of ``stats.uniform_of``."""
    n = ST.UNIFORM_DIGITS
    return f"((('0x' || substr({digest}, {1 + n * i}, {n}))::BIGINT::DOUBLE + 0.5) / {float(1 << (4 * n))!r}::DOUBLE)"


def _normal(digest: str) -> str:
    return f"(sqrt(-2.0 * ln({_uniform(digest, 0)})) * cos({2 * math.pi!r}::DOUBLE * {_uniform(digest, 1)}))"


def _replicates(name: str, source: str, keys: str, value: str, probs: tuple[float, ...], reps: int) -> str:
    """SQL of ``resample.quantile_replicates``: CTE ``name`` (prob, keys, rep, v) of the values in ``source``."""
    names = [k.strip() for k in keys.split(",")]
    key = "'0:' || prob::VARCHAR || ':' || " + " || ':' || ".join(f"{k}::VARCHAR" for k in names) + " || ':' || rep::VARCHAR || ':'"
    return f"""{name}_n AS (SELECT {keys}, count(*)::DOUBLE AS n, list_sort(list({value}::DOUBLE)) AS xs FROM {source} WHERE {value} IS NOT NULL GROUP BY {keys} HAVING count(*) >= 20),
    {name}_e AS (SELECT {keys}, n, prob, rep, floor(prob * (n - 1)) + 1.0 AS k, prob * (n - 1) - floor(prob * (n - 1)) AS frac
      FROM {name}_n, (SELECT unnest({list(probs)}::DOUBLE[]) AS prob), (SELECT unnest(range(0, {reps})) AS rep)),
    {name}_t AS (SELECT *, md5({key} || arm || ':' || i::VARCHAR) AS dg, CASE arm WHEN 'a' THEN k ELSE n - k + 1 END - 1.0::DOUBLE / 3.0::DOUBLE AS d
      FROM {name}_e, (SELECT unnest(['a', 'b']) AS arm), (SELECT unnest(range(0, {ST.GAMMA_TRIES})) AS i)),
    {name}_x AS (SELECT *, {_normal('dg')} AS x FROM {name}_t),
    {name}_v AS (SELECT *, pow(1.0 + x / sqrt(9.0 * d), 3.0) AS v FROM {name}_x),
    {name}_ok AS (SELECT *, CASE WHEN v > 0 THEN ln({_uniform('dg', 2)}) < 0.5 * x * x + d - d * v + d * ln(v) ELSE FALSE END AS ok FROM {name}_v),
    {name}_g AS (SELECT {keys}, prob, rep, arm, coalesce(arg_min(d * v, i) FILTER (ok), any_value(d)) AS g FROM {name}_ok GROUP BY {keys}, prob, rep, arm),
    {name}_u AS (SELECT {keys}, prob, rep, max(g) FILTER (arm = 'a') / (max(g) FILTER (arm = 'a') + max(g) FILTER (arm = 'b')) AS u FROM {name}_g GROUP BY {keys}, prob, rep),
    {name}_w AS (SELECT *, CASE WHEN n - k > 0 THEN 1 - (1 - u) * pow({_uniform(f"md5({key} || 'next')")}, 1.0 / (n - k)) ELSE u END AS w FROM {name}_u JOIN {name}_e USING ({keys}, prob, rep)),
    {name}_r AS (SELECT {keys}, prob, rep, frac, least(floor(u * n), n - 1)::BIGINT + 1 AS lo, least(floor(w * n), n - 1)::BIGINT + 1 AS hi FROM {name}_w),
    {name} AS (SELECT {keys}, prob, rep, xs[lo] + (xs[hi] - xs[lo]) * frac AS v FROM {name}_r JOIN {name}_n USING ({keys}))"""


QUANTILES = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


@query(
    "A4_percentile_ci", "requests",
    sql="WITH ok AS (SELECT level, ttft_ms FROM requests WHERE ok), " + _replicates("r", "ok", "level", "ttft_ms", tuple(QUANTILES.values()), 400) + """
      SELECT level, CASE prob WHEN 0.5 THEN 'p50' WHEN 0.95 THEN 'p95' ELSE 'p99' END AS quantile, round(quantile_cont(v, 0.025), 6) AS lo, round(quantile_cont(v, 0.975), 6) AS hi FROM r GROUP BY level, prob""",
)
def a4(spark, d):
    r = V.requests(spark, d).where("ok")
    ci = RS.percentile_ci(r, ["level"], "ttft_ms", QUANTILES, reps=400)
    return ci.select("level", "quantile", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


@query("A24_corrected_rate_ci")
def a24(spark, d):
    from tracegauge.functions import checks as C
    from tracegauge.plans.evals import SUITE, cases, labeled

    cal = K.confusion(labeled(spark, d), ["lang"])
    v = C.run_suite(cases(spark, d), [SUITE[3]]).select("case_id", F.col("verdict").alias("judge"))
    v = v.join(V.table(spark, d, "documents").select(F.col("doc_id").alias("case_id"), "lang"), "case_id")
    obs = v.groupBy("lang").agg(F.count_if(F.col("judge") == "FAIL").alias("fails"), F.count("*").alias("total"))
    j = obs.join(cal, "lang").withColumn("ci", RS.corrected_rate_ci("fails", "total", "tp", "fp", "tn", "fn", F.xxhash64("lang")))
    return j.select("lang", "fails", "total", F.col("ci.lo").alias("lo"), F.col("ci.hi").alias("hi"))


@query(
    "A45_hierarchical_bootstrap", "gate_samples",
    sql="WITH s AS (SELECT trial, side, run, ttft_ms FROM gate_samples WHERE side IN ('base', 'head')), " + _replicates("r", "s", "trial, side, run", "ttft_ms", (0.95,), 200) + f""",
    l AS (SELECT trial, side, list_sort(list(DISTINCT run)) AS runs FROM r GROUP BY ALL),
    w AS (SELECT *, unnest(range(0, len(runs))) AS slot FROM l, (SELECT unnest(range(0, 200)) AS out_rep)),
    k AS (SELECT *, trial::VARCHAR || ':' || side || ':' || out_rep::VARCHAR || ':' || slot::VARCHAR AS key FROM w),
    p AS (SELECT trial, side, out_rep, runs[floor({_uniform("md5('0:run:' || key)")} * len(runs))::BIGINT + 1] AS run, floor({_uniform("md5('0:rep:' || key)")} * 200)::BIGINT AS rep FROM k),
    m AS (SELECT trial, side, out_rep, quantile_cont(v, 0.5) AS m FROM p JOIN r USING (trial, side, run, rep) GROUP BY ALL),
    c AS (SELECT trial, out_rep, (max(m) FILTER (side = 'head') - max(m) FILTER (side = 'base')) / max(m) FILTER (side = 'base') * 100 AS c FROM m GROUP BY ALL)
    SELECT trial, round(quantile_cont(c, 0.025), 6) AS lo, round(quantile_cont(c, 0.975), 6) AS hi FROM c GROUP BY trial""",
)
def a45(spark, d):
    ci = RS.hierarchical_change_ci(V.gate_samples(spark, d), "base", "head", reps=200)
    return ci.select("trial", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


# ---------------------------------------------------------------- synthesis

@query(
    "D1_sample_lengths",
    sql=f"""WITH q AS (SELECT quantile_cont(n_chars::DOUBLE, {[i / 12 for i in range(13)]}) AS l FROM documents), s AS (SELECT list_sort(list_distinct(list_transform(l, lambda x: round(x, 9)))) AS edges FROM q),
    b AS (SELECT CASE WHEN len(edges) < 2 THEN edges[1] ELSE edges[least(greatest(len(list_filter(edges, lambda x: x <= n_chars)), 1), len(edges) - 1) + 1] END AS upper FROM documents, s WHERE n_chars IS NOT NULL),
    h AS (SELECT upper, count(*) AS c FROM b GROUP BY upper), t AS (SELECT coalesce(lag(upper) OVER (ORDER BY upper), 1.0) AS lo, upper AS hi, sum(c) OVER (ORDER BY upper) / sum(c) OVER () AS share FROM h),
    u AS (SELECT doc_id, {_uniform("md5('0:' || doc_id::VARCHAR || ':bin')")} AS u, {_uniform("md5('0:' || doc_id::VARCHAR || ':in')")} AS v FROM documents),
    p AS (SELECT doc_id, v, arg_min(lo, share) AS lo, arg_min(hi, share) AS hi FROM u JOIN t ON u <= share GROUP BY ALL)
    SELECT doc_id, greatest(1, round(lo + v * (hi - lo)))::INTEGER AS length FROM p""",
)
def d1(spark, d):
    docs = V.table(spark, d, "documents")
    h = S.distribution_histogram(docs.withColumn("_g", F.lit(0)), ["_g"], "n_chars")
    return SY.sample_lengths(docs.select("doc_id"), "doc_id", h, 1.0)


GROUPS = [("support", 0.5, 24), ("search", 0.3, 12)]
WORDS = ["alpha", "beta", "gamma", "delta", "oven", "order", "ship", "error"]


@query(
    "D2_generate_requests",
    sql=f"""WITH l AS (SELECT event_id, greatest(1, round(exp({math.log(40.0)!r}::DOUBLE + {(math.log(160.0) - math.log(40.0)) / 1.6448536269514722!r}::DOUBLE * {_normal("md5('0:' || event_id::VARCHAR || ':length')")})))::INTEGER AS length,
        {_uniform("md5('0:' || event_id::VARCHAR || ':group')")} AS u FROM events),
    g AS (SELECT event_id, length, CASE WHEN u < 0.5 THEN 'support' WHEN u < 0.8 THEN 'search' END AS prefix_group, least(CASE WHEN u < 0.5 THEN 24 WHEN u < 0.8 THEN 12 ELSE 0 END, length) AS s FROM l)
    SELECT event_id, length, prefix_group, array_to_string(list_concat(
      list_transform(range(1, s + 1), lambda i: {WORDS}[floor({_uniform("md5('0:' || prefix_group || ':' || i::VARCHAR)")} * {len(WORDS)})::BIGINT + 1]),
      list_transform(range(1, length - s + 1), lambda i: {WORDS}[floor({_uniform("md5('0:' || event_id::VARCHAR || ':tail:' || i::VARCHAR)")} * {len(WORDS)})::BIGINT + 1])), ' ') AS prompt FROM g""",
)
def d2(spark, d):
    ev = V.table(spark, d, "events").select("event_id")
    return SY.generate_requests(SY.log_normal_lengths(ev, "event_id", 40.0, 160.0), "event_id", GROUPS, WORDS)


@query(
    "D3_replay_cycle",
    sql="""WITH r AS (SELECT event_id, row_number() OVER (ORDER BY md5('3:' || event_id::VARCHAR), event_id) - 1 AS p, count(*) OVER () AS n FROM events)
      SELECT event_id, k * n + p AS seq FROM r, (SELECT unnest(range(0, 3)) AS k)""",
)
def d3(spark, d):
    return SY.replay_cycle(V.table(spark, d, "events").select("event_id"), "event_id", 3, seed=3)


# ---------------------------------------------------------------- jobs and deliveries (batch)

shared_view(
    "deliveries",
    "SELECT md5(CAST(user_id AS STRING) || props) AS delivery_id, event_id AS seq, ts AS delivered_at, event_type FROM {events}",
)


@query(
    "J11_unseen_deliveries", "deliveries",
    sql="""WITH f AS (SELECT delivery_id, max(seq) AS seq FROM deliveries WHERE delivered_at >= TIMESTAMP '2024-01-16 00:00:00' GROUP BY delivery_id)
      SELECT delivery_id, seq FROM f WHERE delivery_id NOT IN (SELECT delivery_id FROM deliveries WHERE delivered_at < TIMESTAMP '2024-01-10 00:00:00') AND delivery_id NOT IN (SELECT delivery_id FROM deliveries WHERE event_type = 'error')""",
)
def j11(spark, d):
    e = view(spark, d, "deliveries")
    at = lambda s: F.to_timestamp_ntz(F.lit(s))
    known = e.where(F.col("delivered_at") < at("2024-01-10 00:00:00")).select("delivery_id")
    rejected = e.where("event_type = 'error'").select("delivery_id")
    return JB.unseen_deliveries(e, known, rejected, at("2024-01-16 00:00:00")).select("delivery_id", "seq")


@query(
    "T5_one_active_job_batch",
    sql="""WITH e AS (SELECT user_id AS key, event_id AS seq, CASE WHEN event_type = 'purchase' THEN 'finish' ELSE 'trigger' END AS kind, lag(CASE WHEN event_type = 'purchase' THEN 'finish' ELSE 'trigger' END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)
      SELECT key, seq, CASE WHEN p = 'trigger' THEN 'attached' ELSE 'created' END AS outcome FROM e WHERE kind = 'trigger'""",
)
def t5b(spark, d):
    return JB.one_active_job(_triggers(spark, d))


def _triggers(spark, d):
    e = V.table(spark, d, "events")
    return e.select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), V.clock(F.col("ts")).alias("t"), F.when(F.col("event_type") == "purchase", "finish").otherwise("trigger").alias("kind"))


shared_view(
    "job_rows",
    """SELECT user_id AS job, max(CASE WHEN event_type = 'click' THEN event_id END) AS last_beat, min(event_id) AS first_id, max(event_id) AS last_id, count(*) AS n FROM {events} GROUP BY user_id""",
)


def _jobs(spark, d):
    j = view(spark, d, "job_rows")
    status = F.when(F.col("job") % 3 == 0, "queued").when(F.col("job") % 3 == 1, "running").otherwise("done")
    return j.select("job", status.alias("status"), F.col("last_beat").cast("double").alias("heartbeat_at"), F.col("first_id").cast("double").alias("created_at"), (F.col("job") % 4).alias("attempts"), F.lit(3).alias("max_attempts"), "last_id")


@query(
    "T6_lease_state_batch", "job_rows",
    sql="""WITH m AS (SELECT max(last_id) AS now FROM job_rows) SELECT job, CASE WHEN job % 3 = 1 AND last_beat < now - 200 AND job % 4 >= 3 THEN 'exhausted' WHEN job % 3 = 1 AND last_beat < now - 200 THEN 'retryable' ELSE 'alive' END AS lease FROM job_rows, m""",
)
def t6b(spark, d):
    j = _jobs(spark, d)
    now = j.agg(F.max("last_id")).scalar().cast("double")
    return JB.lease_state(j, now, 200.0).select("job", "lease")


@query(
    "T10_active_runs", "job_rows",
    sql="""WITH m AS (SELECT max(last_id) AS now FROM job_rows) SELECT job FROM job_rows, m WHERE first_id > now - 100000 AND (job % 3 = 0 OR (job % 3 = 1 AND last_beat > now - 500))""",
)
def t10(spark, d):
    j = _jobs(spark, d)
    now = j.agg(F.max("last_id")).scalar().cast("double")
    return JB.active_runs(j, now, 500.0, 100000.0).select("job")


@query(
    "T7_fencing_audit",
    sql="""WITH e AS (SELECT user_id AS job, event_id AS seq, ts, CASE WHEN event_type IN ('signup', 'view') THEN 'claim' ELSE 'write' END AS kind, event_id % 3 AS worker, (event_id % 4 + 1)::BIGINT AS attempt FROM events),
      h AS (SELECT *, last_value(CASE WHEN kind = 'claim' THEN worker END IGNORE NULLS) OVER w AS hw, last_value(CASE WHEN kind = 'claim' THEN attempt END IGNORE NULLS) OVER w AS ha FROM e WINDOW w AS (PARTITION BY job ORDER BY ts, seq ROWS UNBOUNDED PRECEDING))
      SELECT job, seq, coalesce(NOT (hw = worker AND ha = attempt), TRUE) AS fenced, 5 * pow(2.0, attempt - 1) AS backoff_s FROM h WHERE kind = 'write'""",
)
def t7(spark, d):
    e = V.table(spark, d, "events").select(
        F.col("user_id").alias("job"), F.col("event_id").alias("seq"), V.clock(F.col("ts")).alias("t"),
        F.when(F.col("event_type").isin("signup", "view"), "claim").otherwise("write").alias("kind"), (F.col("event_id") % 3).alias("worker"), (F.col("event_id") % 4 + 1).alias("attempt"),
    )
    return JB.fencing_audit(e)
