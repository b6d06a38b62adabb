"""Configuration choice over orders x customer, and repeat/paired summaries over requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracegauge.operators import optimizer as O
from tracegauge.operators import serving as S
from tracegauge.operators.quantiles import exact_quantiles
from tracegauge.plans import views as V
from tracegauge.plans.registry import query, sql_view, t_quantile_ctes

BASELINE = "1-URGENT"
POLICY = O.ChoicePolicy(quality_tol_pts=12.0, max_failure_rate=0.42, slo_ttft_p95_ms=480000.0)


def _orders(spark, d):
    o, c = V.table(spark, d, "orders"), V.table(spark, d, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("c_mktsegment").alias("grid"), F.col("o_orderpriority").alias("config"), F.year("o_orderdate").alias("run"),
        F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("question"), "o_totalprice", "o_orderstatus",
    )


sql_view(
    "config_orders",
    """SELECT c_mktsegment AS grid, o_orderpriority AS config, year(o_orderdate)::INTEGER AS run, 'n' || c_nationkey::VARCHAR AS question,
       o_totalprice, o_orderstatus FROM orders JOIN customer ON o_custkey = c_custkey""",
)
sql_view(
    "config_runs",
    """SELECT grid, config, run, avg(o_totalprice) / 1000.0 AS goodput_rps, quantile_cont(o_totalprice, 0.95) AS ttft_p95_ms,
       avg((o_orderstatus = 'F')::INTEGER) AS failure_rate FROM config_orders GROUP BY ALL""",
    "config_orders",
)
sql_view(
    "config_quality",
    """SELECT grid, config, 'open' AS metric, question, avg((o_orderstatus = 'O')::INTEGER) AS share FROM config_orders GROUP BY ALL
       UNION ALL SELECT grid, config, 'large', question, avg((o_totalprice > 200000)::INTEGER) FROM config_orders GROUP BY ALL""",
    "config_orders",
)
sql_view(
    "quality_diffs",
    """SELECT q.grid, q.config, q.metric, count(*) AS questions, avg(100.0 * (q.share - b.share)) AS diff_pts,
       stddev_samp(100.0 * (q.share - b.share)) AS sd, (count(*) - 1)::DOUBLE AS df
       FROM config_quality q JOIN config_quality b ON b.grid = q.grid AND b.metric = q.metric AND b.question = q.question AND b.config = '1-URGENT'
       GROUP BY ALL""",
    "config_quality",
)


def config_runs(spark, d):
    o = _orders(spark, d)
    agg = o.groupBy("grid", "config", "run").agg(
        (F.avg("o_totalprice") / 1000.0).alias("goodput_rps"), F.avg((F.col("o_orderstatus") == "F").cast("double")).alias("failure_rate")
    )
    p = exact_quantiles(o, ["grid", "config", "run"], "o_totalprice", {"ttft_p95_ms": 0.95}).drop("n")
    return agg.join(p, ["grid", "config", "run"])


def config_quality(spark, d):
    o = _orders(spark, d).groupBy("grid", "config", "question").agg(
        F.avg((F.col("o_orderstatus") == "O").cast("double")).alias("open"), F.avg((F.col("o_totalprice") > 200000).cast("double")).alias("large")
    )
    return o.unpivot(["grid", "config", "question"], ["open", "large"], "metric", "share")


DIFF_CTES = "WITH " + t_quantile_ctes("quality_diffs", "qd_tq") + """, qd AS (SELECT g.*, diff_pts - CASE WHEN sd = 0 THEN 0 ELSE q * sd / sqrt(questions) END AS lo_pts,
    diff_pts + CASE WHEN sd = 0 THEN 0 ELSE q * sd / sqrt(questions) END AS hi_pts FROM quality_diffs g JOIN qd_tq ON df9 = round(g.df, 9)),
  med AS (SELECT grid, config, count(*) AS runs, median(goodput_rps) AS goodput_rps, min(goodput_rps) AS goodput_lo, max(goodput_rps) AS goodput_hi,
    median(ttft_p95_ms) AS ttft_p95_ms, median(failure_rate) AS failure_rate FROM config_runs GROUP BY ALL),
  feas AS (SELECT m.*, qp.quality_pct, failure_rate > 0.42 AS fails, ttft_p95_ms > 480000 AS too_slow, x.missed > 0 AS quality_not_shown,
    NOT (failure_rate > 0.42 OR ttft_p95_ms > 480000 OR x.missed > 0) AS feasible FROM med m
    JOIN (SELECT grid, config, 100 * avg(share) AS quality_pct FROM config_quality GROUP BY ALL) qp USING (grid, config)
    JOIN (SELECT grid, config, count(*) FILTER (config <> '1-URGENT' AND lo_pts < -12) AS missed FROM qd GROUP BY ALL) x USING (grid, config)),
  top AS (SELECT grid, config AS pick, goodput_lo AS top_lo FROM (SELECT *, row_number() OVER (PARTITION BY grid ORDER BY goodput_rps DESC, config DESC) AS rn FROM feas WHERE feasible) WHERE rn = 1),
  ties AS (SELECT f.grid, count(*) AS n_ties, bool_or(f.config = '1-URGENT') AS bt FROM feas f JOIN top USING (grid) WHERE f.feasible AND f.config <> pick AND f.goodput_hi >= top_lo GROUP BY f.grid),
  sel AS (SELECT g.grid, pick, coalesce(n_ties, 0) AS n_ties, CASE WHEN pick IS NULL THEN 'no config meets the constraints'
    WHEN pick = '1-URGENT' THEN 'keep: no feasible config has higher median goodput' WHEN bt THEN 'keep: the winner''s range overlaps the baseline''s' ELSE 'switch' END AS recommendation
    FROM (SELECT DISTINCT grid FROM feas) g LEFT JOIN top USING (grid) LEFT JOIN ties USING (grid)),
  ch AS (SELECT grid, config AS c FROM (SELECT *, row_number() OVER (PARTITION BY grid ORDER BY goodput_rps DESC, config DESC) AS rn FROM feas WHERE feasible AND config <> '1-URGENT') WHERE rn = 1),
  tgt AS (SELECT grid, pick, CASE WHEN pick <> '1-URGENT' THEN pick WHEN pick = '1-URGENT' THEN c END AS target FROM sel LEFT JOIN ch USING (grid))
"""
NEED = ("config_runs", "quality_diffs")


@query("A32_paired_difference", *NEED, sql=DIFF_CTES + """SELECT grid, config, metric, questions, round(diff_pts, 7) AS diff_pts, round(lo_pts, 5) AS lo_pts,
    round(hi_pts, 5) AS hi_pts FROM qd""")
def a32(spark, d):
    p = O.paired_difference(config_quality(spark, d), BASELINE, POLICY)
    return p.select("grid", "config", "metric", "questions", F.round("diff_pts", 7).alias("diff_pts"),
                    F.round("lo_pts", 5).alias("lo_pts"), F.round("hi_pts", 5).alias("hi_pts"))


def _feasible(spark, d):
    return O.feasibility(config_runs(spark, d), config_quality(spark, d), BASELINE, POLICY)


@query("K2_feasibility", *NEED, sql=DIFF_CTES + """SELECT grid, config, runs, round(goodput_rps, 6) AS goodput_rps, round(ttft_p95_ms, 5) AS ttft_p95_ms,
    round(failure_rate, 8) AS failure_rate, round(quality_pct, 7) AS quality_pct, fails, too_slow, quality_not_shown, feasible FROM feas""")
def k2f(spark, d):
    return _feasible(spark, d).select(
        "grid", "config", "runs", F.round("goodput_rps", 6).alias("goodput_rps"), F.round("ttft_p95_ms", 5).alias("ttft_p95_ms"),
        F.round("failure_rate", 8).alias("failure_rate"), F.round("quality_pct", 7).alias("quality_pct"),
        "fails", "too_slow", "quality_not_shown", "feasible",
    )


@query("K2_select_config", *NEED, sql=DIFF_CTES + "SELECT grid, pick, n_ties, recommendation FROM sel")
def k2(spark, d):
    return O.select_config(_feasible(spark, d))


@query("K3_pareto_front", *NEED, sql=DIFF_CTES + """SELECT grid, config FROM feas a WHERE NOT EXISTS (SELECT 1 FROM feas b WHERE b.grid = a.grid
    AND b.goodput_rps >= a.goodput_rps AND b.ttft_p95_ms <= a.ttft_p95_ms AND b.quality_pct >= a.quality_pct
    AND (b.goodput_rps > a.goodput_rps OR b.ttft_p95_ms < a.ttft_p95_ms OR b.quality_pct > a.quality_pct))""")
def k3(spark, d):
    return O.pareto_front(_feasible(spark, d)).select("grid", "config")


@query("K4_confirmation_target", *NEED, sql=DIFF_CTES + "SELECT grid, pick, target FROM tgt")
def k4(spark, d):
    f = _feasible(spark, d)
    return O.confirmation_target(f, O.select_config(f), BASELINE)


@query(
    "K5_confirmation_outcome", *NEED,
    sql=DIFF_CTES + """, st AS (SELECT grid, config, count(*) AS n, avg(ln(goodput_rps)) AS m, var_samp(ln(goodput_rps)) / count(*) AS v FROM config_runs GROUP BY ALL),
    pr AS (SELECT t.grid, t.target, o.m - b.m AS d, sqrt(b.v + o.v) AS se, (b.v + o.v) * (b.v + o.v) / (b.v * b.v / (b.n - 1) + o.v * o.v / (o.n - 1)) AS df
      FROM tgt t JOIN st b ON b.grid = t.grid AND b.config = '1-URGENT' JOIN st o ON o.grid = t.grid AND o.config = t.target),
    """ + t_quantile_ctes("pr", "pr_tq") + """, ci AS (SELECT pr.*, (exp(d) - 1) * 100 AS change, (exp(d - q * se) - 1) * 100 AS lo, (exp(d + q * se) - 1) * 100 AS hi FROM pr JOIN pr_tq ON df9 = round(df, 9))
    SELECT ci.grid, ci.target, round(change, 6) AS goodput_change, round(lo, 5) AS goodput_lo, round(hi, 5) AS goodput_hi,
      CASE WHEN hi <= 0 THEN 'not confirmed: no improvement' WHEN lo > 0 AND f.feasible THEN 'confirmed' WHEN lo > 0 THEN 'not confirmed: constraints' ELSE 'inconclusive' END AS outcome
    FROM ci JOIN feas f ON f.grid = ci.grid AND f.config = ci.target""",
)
def k5(spark, d):
    runs, quality = config_runs(spark, d), config_quality(spark, d)
    f = O.feasibility(runs, quality, BASELINE, POLICY)
    t = O.confirmation_target(f, O.select_config(f), BASELINE)
    c = O.confirm(runs, quality, t, BASELINE, POLICY)
    return c.select("grid", "target", F.round("goodput_change", 6).alias("goodput_change"), F.round("goodput_lo", 5).alias("goodput_lo"),
                    F.round("goodput_hi", 5).alias("goodput_hi"), "outcome")


# ---------------------------------------------------------------- repeats and pairs over requests

sql_view(
    "level_metrics",
    """SELECT run_id, level, repeat, quantile_cont(ttft_ms, 0.5) FILTER (ok) AS ttft_p50_ms, quantile_cont(ttft_ms, 0.95) FILTER (ok) AS ttft_p95_ms,
      quantile_cont(ttft_ms, 0.99) FILTER (ok) AS ttft_p99_ms, quantile_cont(tpot_ms, 0.5) FILTER (ok) AS tpot_p50_ms, quantile_cont(e2e_ms, 0.95) FILTER (ok) AS e2e_p95_ms,
      count(*) FILTER (ok) / w AS throughput_rps, sum(output_tokens) / w AS output_tok_s, count(*) FILTER (slo_ok) / w AS goodput_rps,
      count(*) FILTER (NOT ok) / count(*) AS failure_rate
      FROM requests JOIN (SELECT run_id, level, repeat, greatest(max(send_ts + coalesce(e2e_ms, 0) / 1000.0) - min(send_ts), 1e-9) AS w FROM requests GROUP BY ALL) USING (run_id, level, repeat)
      GROUP BY run_id, level, repeat, w""",
    "requests",
)
METRICS = ["ttft_p50_ms", "ttft_p95_ms", "ttft_p99_ms", "tpot_p50_ms", "e2e_p95_ms", "throughput_rps", "output_tok_s", "goodput_rps", "failure_rate"]


def level_metrics(spark, d):
    r = V.requests(spark, d)
    s = S.summarize_level(r).select(
        *S.LEVEL_KEYS, F.col("request_throughput_rps").alias("throughput_rps"), "output_tok_s", F.col("slo_goodput_rps").alias("goodput_rps"), "failure_rate"
    )
    pick = lambda m, p: F.max(F.when(F.col("metric") == m, F.col(p)))
    q = S.latency_percentiles(r).groupBy(*S.LEVEL_KEYS).agg(
        pick("ttft_ms", "p50").alias("ttft_p50_ms"), pick("ttft_ms", "p95").alias("ttft_p95_ms"), pick("ttft_ms", "p99").alias("ttft_p99_ms"),
        pick("tpot_ms", "p50").alias("tpot_p50_ms"), pick("e2e_ms", "p95").alias("e2e_p95_ms"),
    )
    return s.join(q, list(S.LEVEL_KEYS), "left")


@query(
    "A16_repeat_summary", "level_metrics",
    sql=" UNION ALL ".join(f"""SELECT run_id AS config, level, '{m}' AS metric, round(median({m}), 8) AS median, round(min({m}), 8) AS min, round(max({m}), 8) AS max,
      count({m}) AS n FROM level_metrics GROUP BY run_id, level""" for m in METRICS),
)
def a16(spark, d):
    m = level_metrics(spark, d).withColumnRenamed("run_id", "config")
    s = O.repeat_summary(m, ["config", "level"], METRICS)
    return s.select("config", "level", "metric", *[F.round(c, 8).alias(c) for c in ("median", "min", "max")], "n")


PAIRED_SQL = """WITH p AS (SELECT substr(a.run_id, 2)::INTEGER % 6 AS pair, a.level, a.repeat, a.ttft_p95_ms AS on_v, b.ttft_p95_ms AS off_v
    FROM level_metrics a JOIN level_metrics b ON a.level = b.level AND a.repeat = b.repeat AND substr(b.run_id, 2)::INTEGER = substr(a.run_id, 2)::INTEGER + 6)"""


def _pairs(spark, d):
    m = level_metrics(spark, d).select(F.substring("run_id", 2, 9).cast("int").alias("k"), "level", "repeat", "ttft_p95_ms")
    on = m.where("k < 6").select(F.col("k").alias("pair"), "level", "repeat", F.col("ttft_p95_ms").alias("on_v"))
    off = m.where("k >= 6").select((F.col("k") - 6).alias("pair"), "level", "repeat", F.col("ttft_p95_ms").alias("off_v"))
    return on.join(off, ["pair", "level", "repeat"])


@query("J7_paired_join", "level_metrics", sql=PAIRED_SQL + "SELECT pair, level, repeat, round(on_v, 6) AS on_v, round(off_v, 6) AS off_v FROM p")
def j7(spark, d):
    return _pairs(spark, d).select("pair", "level", "repeat", F.round("on_v", 6).alias("on_v"), F.round("off_v", 6).alias("off_v"))


@query(
    "A17_paired_effect", "level_metrics",
    sql=PAIRED_SQL + """SELECT pair, level, count(x) AS n_pairs, round(median(x), 6) AS median_pct, round(min(x), 6) AS min_pct, round(max(x), 6) AS max_pct,
      count(x) > 0 AND (min(x) > 0 OR max(x) < 0) AS consistent_sign FROM (SELECT *, (off_v - on_v) / on_v * 100 AS x FROM p) GROUP BY pair, level""",
)
def a17(spark, d):
    e = O.paired_effect(_pairs(spark, d), ["pair", "level"], F.col("on_v"), F.col("off_v"))
    return e.select("pair", "level", "n_pairs", *[F.round(c, 6).alias(c) for c in ("median_pct", "min_pct", "max_pct")], "consistent_sign")


@query(
    "A18_clock_spread", "telemetry_wide",
    sql="""SELECT round((max(m) - min(m)) / max(m) * 100, 7) AS clock_spread_pct FROM (SELECT run_id, avg(kv_cache_usage) AS m FROM telemetry_wide GROUP BY run_id)""",
)
def a18(spark, d):
    m = V.telemetry_wide(spark, d).groupBy("run_id").agg(F.avg("kv_cache_usage").alias("m"))
    return m.agg(F.round((F.max("m") - F.min("m")) / F.max("m") * 100, 7).alias("clock_spread_pct"))


@query(
    "A46_campaign_medians", "level_metrics", "telemetry_wide",
    sql="""WITH h AS (SELECT run_id, sum(prefix_cache_hits) AS hits, sum(prefix_cache_queries) AS queries FROM telemetry_wide GROUP BY run_id)
    SELECT level, count(*) AS runs, count(*) = count(DISTINCT run_id || '/' || repeat::VARCHAR) AS complete, round(median(ttft_p50_ms), 7) AS p50, round(median(ttft_p95_ms), 7) AS p95,
      round(median(output_tok_s), 9) AS tok_s, round(sum(hits) / sum(queries), 8) AS cache_rate FROM level_metrics JOIN h USING (run_id) GROUP BY level""",
)
def a46(spark, d):
    """Medians of the run statistics per condition (here: level) and the ratio of summed counters."""
    h = V.telemetry_wide(spark, d).groupBy("run_id").agg(F.sum("prefix_cache_hits").alias("hits"), F.sum("prefix_cache_queries").alias("queries"))
    j = level_metrics(spark, d).join(h, "run_id")
    return j.groupBy("level").agg(
        F.count("*").alias("runs"), (F.count("*") == F.countDistinct("run_id", "repeat")).alias("complete"),
        F.round(F.median("ttft_p50_ms"), 7).alias("p50"), F.round(F.median("ttft_p95_ms"), 7).alias("p95"),
        F.round(F.median("output_tok_s"), 9).alias("tok_s"), F.round(F.sum("hits") / F.sum("queries"), 8).alias("cache_rate"),
    )


@query(
    "O4_design_completeness", "requests",
    sql="""WITH o AS (SELECT run_id, level, repeat, count(*) AS n FROM requests WHERE idx % 5 <> 0 OR level < 16 OR repeat > 0 GROUP BY ALL),
    d AS (SELECT run_id, level, repeat FROM (SELECT DISTINCT run_id FROM requests), (SELECT DISTINCT level FROM requests), (SELECT DISTINCT repeat FROM requests))
    SELECT run_id, count(*) AS cells, count(o.n) AS observed FROM d LEFT JOIN o USING (run_id, level, repeat) GROUP BY run_id""",
)
def o4(spark, d):
    """Cells of the design (levels and repeats are fixed lists) that each run covers."""
    r = V.requests(spark, d).where("idx % 5 <> 0 OR level < 16 OR repeat > 0")
    seen = r.select("run_id", "level", "repeat").distinct().withColumn("seen", F.lit(True))
    cells = F.array(*[F.struct(F.lit(float(l)).alias("level"), F.lit(k).alias("repeat")) for l in (1, 2, 4, 8, 16) for k in (0, 1, 2)])
    design = r.select("run_id").distinct().select("run_id", F.explode(cells).alias("c")).select("run_id", "c.*")
    j = design.join(seen, ["run_id", "level", "repeat"], "left")
    return j.groupBy("run_id").agg(F.count("*").alias("cells"), F.count("seen").alias("observed"))


@query(
    "W11_order_rotation", "requests",
    sql="SELECT DISTINCT substr(run_id, 2)::INTEGER AS idx, repeat, (substr(run_id, 2)::INTEGER - repeat + 12) % 12 AS position FROM requests",
)
def w11(spark, d):
    """Position of a variant in a repeat when the order rotates by one each time (Latin square)."""
    r = V.requests(spark, d).select(F.substring("run_id", 2, 9).cast("int").alias("idx"), "repeat").distinct()
    return r.withColumn("position", F.pmod(F.col("idx") - F.col("repeat"), F.lit(12)))


@query(
    "V2_counter_sanity", "level_windows", "telemetry_wide",
    sql="""
    WITH c AS (SELECT run_id, t, prefix_cache_queries AS q, prefix_cache_hits AS h FROM telemetry_wide),
    a AS (SELECT w.*, c.q AS qa, c.h AS ha FROM level_windows w ASOF LEFT JOIN c ON w.run_id = c.run_id AND w.t0 >= c.t),
    b AS (SELECT a.*, c.q - qa AS dq, c.h - ha AS dh FROM a ASOF LEFT JOIN c ON a.run_id = c.run_id AND a.t1 >= c.t)
    SELECT * FROM (SELECT run_id, window_id, CASE WHEN dq IS NULL OR dh IS NULL THEN 'missing' WHEN dq < 0 OR dh < 0 THEN 'reset' WHEN dh > dq THEN 'hits exceed queries' END AS reason FROM b) WHERE reason IS NOT NULL""",
)
def v2(spark, d):
    from tracegauge.operators.audit import counter_violations
    from tracegauge.operators.telemetry import window_counters
    from tracegauge.plans.telemetry import _windows

    c = window_counters(_windows(spark, d), V.telemetry_wide(spark, d))
    return counter_violations(c, ["run_id", "window_id"], "prefix_cache_hits_delta", "prefix_cache_queries_delta")


@query(
    "V4_run_validity", "requests",
    sql="""SELECT * FROM (SELECT idx, CASE WHEN ttft_ms IS NULL OR ttft_ms <= 0 THEN 'invalid timing' WHEN output_tokens IS NULL OR input_tokens IS NULL THEN 'missing token count'
      WHEN output_tokens > 90 THEN 'output length not controlled' WHEN e2e_ms < ttft_ms THEN 'ends before first token' END AS reason FROM requests WHERE ok) WHERE reason IS NOT NULL""",
)
def v4(spark, d):
    from tracegauge.operators.audit import request_violations

    return request_violations(V.requests(spark, d), 90)


@query(
    "V5_comparable_runs", "telemetry_wide",
    sql="""WITH r AS (SELECT run_id, floor(t / 86400)::BIGINT AS day, avg(kv_cache_usage) AS clock FROM telemetry_wide GROUP BY ALL HAVING count(kv_cache_usage) > 0),
    m AS (SELECT *, median(clock) OVER (PARTITION BY run_id) AS med FROM r)
    SELECT run_id, day, abs(clock - med) / med <= 0.5 AS comparable FROM m""",
)
def v5(spark, d):
    """Daily runs whose clock strays from the run's median are marked, not dropped."""
    from tracegauge.operators.audit import comparable

    r = V.telemetry_wide(spark, d).groupBy("run_id", F.floor(F.col("t") / 86400).alias("day")).agg(F.avg("kv_cache_usage").alias("clock")).where("clock IS NOT NULL")
    return comparable(r, ["run_id"], "clock", 0.5).select("run_id", "day", "comparable")
