"""Regression-gate queries over the revision samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracegauge.functions.stats import clopper_pearson, wilson
from tracegauge.operators import gate as G
from tracegauge.operators.audit import close, verdict_mismatches
from tracegauge.operators.quantiles import exact_quantiles
from tracegauge.plans import views as V
from tracegauge.session import written
from tracegauge.plans.registry import query, sql_view, t_quantile_ctes

sql_view(
    "run_logs",
    """SELECT trial, side, run, count(*) AS n, CASE WHEN count(*) >= 20 AND min(ttft_ms) > 0 THEN avg(ln(ttft_ms)) END AS log_mean
       FROM gate_samples WHERE NOT failed GROUP BY ALL""",
    "gate_samples",
)
sql_view(
    "run_logs_p95",
    """SELECT trial, side, run, count(*) AS n, CASE WHEN count(*) >= 20 THEN ln(quantile_cont(ttft_ms, 0.95)) END AS log_mean
       FROM gate_samples WHERE NOT failed GROUP BY ALL""",
    "gate_samples",
)


def _pairs_sql(runs: str, pairs: tuple[tuple[str, str], ...]) -> str:
    sides = f"""SELECT trial, side, count(*) AS runs, avg(log_mean) AS m, var_samp(log_mean) AS v, min(log_mean) AS mn,
        max(log_mean) AS mx FROM {runs} GROUP BY ALL HAVING count(*) = count(log_mean)"""
    want = " OR ".join(f"(b.side = '{a}' AND o.side = '{c}')" for a, c in pairs)
    return f"""SELECT *, CASE WHEN se > 0 THEN (va + vb) * (va + vb) / (va * va / (b_runs - 1) + vb * vb / (o_runs - 1)) END AS df
      FROM (SELECT o.trial, b.side AS base, o.side AS other, b.runs AS b_runs, o.runs AS o_runs, b.m AS b_mean, o.m AS o_mean,
        b.mx AS b_max, o.mn AS o_min, b.v / b.runs AS va, o.v / o.runs AS vb, o.m - b.m AS d, sqrt(b.v / b.runs + o.v / o.runs) AS se
        FROM ({sides}) b JOIN ({sides}) o ON b.trial = o.trial AND ({want}))"""


ALL_PAIRS = (("base", "head"), ("base", "candidate"), ("head", "candidate"))
for _tag, _runs in (("gate", "run_logs"), ("tail", "run_logs_p95")):
    sql_view(f"{_tag}_pairs", _pairs_sql(_runs, ALL_PAIRS), _runs)
sql_view(
    "failure_rates",
    """SELECT trial, side, avg(f) AS fr FROM (SELECT trial, side, run, avg(failed::INTEGER) AS f FROM gate_samples GROUP BY ALL)
       GROUP BY ALL""",
    "gate_samples",
)


def _verdict_ctes(tag: str) -> str:
    return (
        t_quantile_ctes(f"{tag}_pairs", f"{tag}_tq")
        + f""", {tag}_ci AS (SELECT p.*, (exp(d) - 1) * 100 AS change_pct, (exp(d - coalesce(q, 0) * se) - 1) * 100 AS ci_lo,
        (exp(d + coalesce(q, 0) * se) - 1) * 100 AS ci_hi FROM {tag}_pairs p LEFT JOIN {tag}_tq t ON t.df9 = round(p.df, 9))"""
    )


sql_view(
    "gate_sides",
    """SELECT trial, side, count(*) AS runs, bool_and(ok >= 20) AS complete, median(p95) AS med, min(p95) AS mn, max(p95) AS mx, count(p95) AS known FROM (
         SELECT trial, side, run, count(*) FILTER (NOT failed) AS ok, quantile_cont(ttft_ms, 0.95) FILTER (NOT failed) AS p95 FROM gate_samples GROUP BY ALL)
       GROUP BY ALL""",
    "gate_samples",
)
GATE_CTES = _verdict_ctes("gate") + """, every_pair AS (SELECT b.trial, b.side AS base, o.side AS other, b.runs AS b_runs, o.runs AS o_runs,
      b.complete AND o.complete AS whole, b.med AS p0, o.med AS p1, (o.med - b.med) / b.med * 100 AS p_change, o.mn > b.mx AS p_sep, b.known = 1 AS p_one, fo.fr - fb.fr > 0.01 AS failed_more
      FROM gate_sides b JOIN gate_sides o ON b.trial = o.trial AND (b.side, o.side) IN (('base', 'head'), ('base', 'candidate'), ('head', 'candidate'))
      JOIN failure_rates fb ON fb.trial = b.trial AND fb.side = b.side JOIN failure_rates fo ON fo.trial = o.trial AND fo.side = o.side),
    gate_verdicts AS (SELECT e.trial, e.base, e.other, failed_more, ci_lo, ci_hi,
      CASE WHEN whole THEN exp(b_mean) ELSE p0 END AS baseline, CASE WHEN whole THEN exp(o_mean) ELSE p1 END AS value, CASE WHEN whole THEN change_pct ELSE p_change END AS change_pct,
      CASE WHEN whole THEN round(exp(o_min), 1) > round(exp(b_max), 1) ELSE p_sep END AS separated,
      CASE WHEN NOT whole AND p_change IS NULL THEN 'error' WHEN failed_more THEN 'block'
        WHEN NOT whole THEN CASE WHEN p_change > 25 AND (p_sep OR p_one) THEN 'block' WHEN p_change > 10 THEN 'warn' ELSE 'pass' END
        WHEN least(e.b_runs, e.o_runs) < 3 THEN 'inconclusive' WHEN ci_hi <= 10 THEN 'pass'
        WHEN ci_lo > 10 AND change_pct > 25 THEN 'block' WHEN ci_lo > 10 THEN 'warn' ELSE 'inconclusive' END AS verdict
      FROM every_pair e LEFT JOIN gate_ci g ON whole AND g.trial = e.trial AND g.base = e.base AND g.other = e.other)"""
GATE = ("gate_pairs", "failure_rates", "gate_sides")


def r6(*cols):
    return [F.round(F.col(c), 6).alias(c) for c in cols]


@query("A11_run_geometric_mean", "run_logs",
       sql="SELECT trial, side, run, n, round(exp(log_mean), 6) AS gmean_ms FROM run_logs")
def a11(spark, d):
    r = G.run_log_means(V.gate_samples(spark, d).where("NOT failed"))
    return r.select("trial", "side", "run", "n", F.round(F.exp("log_mean"), 6).alias("gmean_ms"))


@query(
    "A12_welch_interval", "gate_pairs",
    sql="WITH " + _verdict_ctes("gate") + """SELECT trial, other, round(d, 8) AS d, round(se, 8) AS se, round(df, 6) AS df,
      round(change_pct, 6) AS change_pct, round(ci_lo, 5) AS ci_lo, round(ci_hi, 5) AS ci_hi FROM gate_ci WHERE base = 'base'""",
)
def a12(spark, d):
    runs = G.run_log_means(V.gate_samples(spark, d).where("NOT failed"))
    w = G.with_welch(G.pair_sides(G.side_stats(runs, "log_mean"), "base", ["head", "candidate"]), 0.90)
    return w.select("trial", "other", F.round("d", 8).alias("d"), F.round("se", 8).alias("se"), *r6("df", "change_pct"),
                    F.round("ci_lo", 5).alias("ci_lo"), F.round("ci_hi", 5).alias("ci_hi"))


@query(
    "A13_gate_verdict", *GATE,
    sql="WITH " + GATE_CTES + """SELECT trial, other, round(baseline, 6) AS baseline, round(value, 6) AS value,
      round(change_pct, 6) AS change_pct, round(ci_lo, 5) AS ci_lo, round(ci_hi, 5) AS ci_hi, separated, failed_more, verdict FROM gate_verdicts WHERE base = 'base'""",
)
def a13(spark, d):
    g = G.gate(V.gate_samples(spark, d), "base", ["head", "candidate"])
    return g.select("trial", "other", *r6("baseline", "value", "change_pct"), F.round("ci_lo", 5).alias("ci_lo"),
                    F.round("ci_hi", 5).alias("ci_hi"), "separated", "failed_more", "verdict")


@query(
    "A13_tail_advisory", "tail_pairs",
    sql="WITH " + _verdict_ctes("tail") + """SELECT trial, other, round(exp(b_mean), 6) AS baseline, round(exp(o_mean), 6) AS value,
      round(change_pct, 6) AS change_pct, round(ci_lo, 5) AS ci_lo, round(ci_hi, 5) AS ci_hi FROM tail_ci WHERE base = 'base'""",
)
def a13t(spark, d):
    t = G.tail_advisory(V.gate_samples(spark, d), "base", ["head", "candidate"])
    return t.select("trial", "other", *r6("baseline", "value", "change_pct"), F.round("ci_lo", 5).alias("ci_lo"),
                    F.round("ci_hi", 5).alias("ci_hi"))


@query(
    "A14_point_rule", "gate_samples",
    sql="""
    WITH p AS (SELECT trial, side, run, quantile_cont(ttft_ms, 0.95) AS p95 FROM gate_samples GROUP BY ALL),
    s AS (SELECT trial, side, median(p95) AS med, min(p95) AS mn, max(p95) AS mx, count(*) AS runs FROM p GROUP BY ALL)
    SELECT o.trial, o.side AS other, round(b.med, 9) AS baseline, round(o.med, 9) AS value,
      round((o.med - b.med) / b.med * 100, 6) AS change_pct, o.mn > b.mx AS separated,
      CASE WHEN (o.med - b.med) / b.med * 100 > 25 AND (o.mn > b.mx OR b.runs = 1) THEN 'block'
        WHEN (o.med - b.med) / b.med * 100 > 10 THEN 'warn' ELSE 'pass' END AS verdict
    FROM s b JOIN s o ON b.trial = o.trial AND b.side = 'base' AND o.side <> 'base'""",
)
def a14(spark, d):
    p = G.point_rule(V.gate_samples(spark, d), "base", ["head", "candidate"])
    return p.select("trial", "other", F.round("baseline", 9).alias("baseline"), F.round("value", 9).alias("value"), *r6("change_pct"), "separated", "verdict")


@query(
    "A15_repair_acceptance", *GATE,
    sql="WITH " + GATE_CTES + """SELECT hb.trial, ch.ci_hi < 0 AS faster_than_head, cb.ci_hi < 25 AS bounded_vs_base,
      cb.ci_hi <= 10 AS within_tolerance, coalesce(NOT cb.failed_more AND ch.ci_hi < 0 AND cb.ci_hi < 25, FALSE) AS accepted
      FROM gate_verdicts hb JOIN gate_verdicts cb ON hb.trial = cb.trial JOIN gate_verdicts ch ON hb.trial = ch.trial
      WHERE hb.base = 'base' AND hb.other = 'head' AND cb.base = 'base' AND cb.other = 'candidate' AND ch.base = 'head'""",
)
def a15(spark, d):
    return G.repair_acceptance(V.gate_samples(spark, d))


# ---------------------------------------------------------------- trial sets (A37-A39, O3, V3)

sql_view("affected_trials", "SELECT DISTINCT 'head' AS set, trial FROM gate_samples WHERE trial % 4 = 3", "gate_samples")
TRIALS_SQL = GATE_CTES + """, trials AS (SELECT other AS set, trial, change_pct, ci_lo, ci_hi, verdict, separated FROM gate_verdicts WHERE base = 'base')"""


def _trials(spark, d):
    return G.gate(V.gate_samples(spark, d), "base", ["head", "candidate"]).withColumnRenamed("other", "set")


def _affected(spark, d):
    return V.gate_samples(spark, d).where("trial % 4 = 3").select(F.lit("head").alias("set"), "trial").distinct()


@query(
    "A37_trial_set_summary", *GATE, "affected_trials",
    sql="WITH " + TRIALS_SQL + """, u AS (
      SELECT *, FALSE AS affected_included FROM trials t WHERE NOT EXISTS (SELECT 1 FROM affected_trials a WHERE a.set = t.set AND a.trial = t.trial)
      UNION ALL SELECT *, TRUE FROM trials)
    SELECT set, affected_included, count(*) AS trials, count(*) FILTER (verdict = 'pass') AS n_pass,
      count(*) FILTER (verdict = 'inconclusive') AS n_inconclusive, count(*) FILTER (verdict = 'warn') AS n_warn,
      count(*) FILTER (verdict = 'block') AS n_block, count(*) FILTER (ci_lo <= 0 AND ci_hi >= 0) AS covers_zero,
      round(median(change_pct), 5) AS change_median, round(min(change_pct), 5) AS change_min, round(max(change_pct), 5) AS change_max,
      round(median(ci_hi - ci_lo), 5) AS width_median FROM u GROUP BY ALL""",
)
def a37(spark, d):
    s = G.trial_summary(_trials(spark, d), _affected(spark, d))
    med = ("change_median", "change_min", "change_max", "width_median")
    return s.select(*[c for c in s.columns if c not in med], *[F.round(c, 5).alias(c) for c in med])


@query(
    "A38_tail_summary", "tail_pairs",
    sql="WITH " + _verdict_ctes("tail") + """SELECT other, count(*) AS n, count(*) FILTER (ci_hi <= 10) AS ruled_out,
      count(*) FILTER (ci_lo > 10) AS established, count(*) FILTER (NOT (ci_hi <= 10 OR ci_lo > 10)) AS unresolved,
      round(median(change_pct), 5) AS change_median, round(min(change_pct), 5) AS change_min, round(max(change_pct), 5) AS change_max,
      round(median(ci_hi - ci_lo), 5) AS width_median FROM tail_ci WHERE base = 'base' GROUP BY other""",
)
def a38(spark, d):
    s = G.tail_summary(G.tail_advisory(V.gate_samples(spark, d), "base", ["head", "candidate"]))
    med = ("change_median", "change_min", "change_max", "width_median")
    return s.select(*[c for c in s.columns if c not in med], *[F.round(c, 5).alias(c) for c in med])


@query(
    "A39_noise_table", *GATE,
    sql="WITH " + TRIALS_SQL + """SELECT count(*) AS trials, round(median(change_pct), 5) AS change_median,
      round(median(abs(change_pct)), 5) AS abs_median, round(max(abs(change_pct)), 5) AS abs_max,
      count(*) FILTER (separated) AS separated_by_chance, count(*) FILTER (ci_lo <= 0 AND ci_hi >= 0) AS covers_zero,
      round(median(ci_hi - ci_lo), 5) AS width_median, round(max(ci_hi - ci_lo), 5) AS width_max FROM trials WHERE set = 'candidate'""",
)
def a39(spark, d):
    """The candidate side carries no drift, so any change it shows is noise."""
    t = _trials(spark, d).where("set = 'candidate'")
    t = written(t.withColumns({"_abs": F.abs("change_pct"), "_width": F.col("ci_hi") - F.col("ci_lo")}), "trials")
    n = t.groupBy("set").agg(
        F.count("*").alias("trials"), F.max("_abs").alias("abs_max"), F.count_if("separated").alias("separated_by_chance"),
        F.count_if((F.col("ci_lo") <= 0) & (F.col("ci_hi") >= 0)).alias("covers_zero"), F.max("_width").alias("width_max"),
    )
    m = G.with_medians(n, t, ["set"], {"change_median": "change_pct", "abs_median": "_abs", "width_median": "_width"})
    return m.select("trials", "separated_by_chance", "covers_zero", *[F.round(c, 5).alias(c) for c in ("change_median", "abs_median", "abs_max", "width_median", "width_max")])


@query(
    "A40_run_statistics", "gate_samples",
    sql="""
    WITH s AS (SELECT *, row_number() OVER (PARTITION BY trial, side, run ORDER BY ttft_ms) AS rn,
      count(*) OVER (PARTITION BY trial, side, run) AS n FROM gate_samples)
    SELECT trial, side, run, any_value(n) AS n, round(avg(ln(ttft_ms)), 8) AS gmean, round(ln(avg(ttft_ms)), 8) AS mean,
      round(ln(quantile_cont(ttft_ms, 0.5)), 8) AS p50, round(ln(quantile_cont(ttft_ms, 0.75)), 8) AS p75,
      round(ln(quantile_cont(ttft_ms, 0.9)), 8) AS p90, round(ln(quantile_cont(ttft_ms, 0.95)), 8) AS p95,
      round(ln(avg(ttft_ms) FILTER (rn > greatest(1, floor(n * 0.1)) AND rn <= n - greatest(1, floor(n * 0.1)))), 8) AS trim
    FROM s GROUP BY trial, side, run""",
)
def a40(spark, d):
    r = G.run_statistics(V.gate_samples(spark, d))
    return r.select("trial", "side", "run", "n",
                    *[F.round(c, 8).alias(c) for c in ("gmean", "mean", "p50", "p75", "p90", "p95", "trim")])


@query(
    "A41_within_run_dependence", "gate_samples",
    sql="""
    WITH s AS (SELECT *, lag(ttft_ms) OVER (PARTITION BY trial, side, run ORDER BY seq, ttft_ms) AS p,
      avg(ln(ttft_ms)) OVER (PARTITION BY trial, side, run) AS m FROM gate_samples)
    SELECT trial, side, run, round(avg((abs(ttft_ms - p) / p < 0.03)::INTEGER), 8) AS near_share,
      round(sum((ln(ttft_ms) - m) * (ln(p) - m)) / sum((ln(ttft_ms) - m) * (ln(ttft_ms) - m)), 7) AS lag1_autocorrelation
    FROM s GROUP BY trial, side, run""",
)
def a41(spark, d):
    r = G.within_run_dependence(V.gate_samples(spark, d))
    return r.select("trial", "side", "run", F.round("near_share", 8).alias("near_share"),
                    F.round("lag1_autocorrelation", 7).alias("lag1_autocorrelation"))


@query(
    "A42_variance_components", "run_logs",
    sql="""
    WITH p AS (SELECT trial, count(*) AS k, avg(log_mean) AS m, var_pop(log_mean) * count(*) AS ss FROM run_logs GROUP BY trial)
    SELECT round(w, 8) AS sd_within, round(b, 8) AS sd_between, round(b * b / (b * b + w * w), 7) AS icc FROM (
      SELECT sqrt(sum(ss) / (sum(k) - count(*))) AS w, stddev_samp(m) AS b FROM p)""",
)
def a42(spark, d):
    v = G.variance_components(G.run_log_means(V.gate_samples(spark, d).where("NOT failed")))
    return v.select(F.round("sd_within", 8).alias("sd_within"), F.round("sd_between", 8).alias("sd_between"),
                    F.round("icc", 7).alias("icc"))


@query(
    "A42_pairing", "run_logs",
    sql="""
    WITH d AS (SELECT a.trial, h.log_mean - a.log_mean AS d FROM run_logs a JOIN run_logs h ON a.trial = h.trial AND a.run = h.run
        AND a.side = 'base' AND h.side = 'head'),
    e AS (SELECT log_mean - avg(log_mean) OVER (PARTITION BY trial, side) AS e FROM run_logs WHERE side IN ('base', 'head'))
    SELECT round((SELECT stddev_samp(d) FROM d), 8) AS sd_paired, round((SELECT sqrt(2) * stddev_samp(e) FROM e), 8) AS sd_unpaired""",
)
def a42p(spark, d):
    p = G.pairing_gain(G.run_log_means(V.gate_samples(spark, d).where("NOT failed")), "base", "head")
    return p.select(F.round("sd_paired", 8).alias("sd_paired"), F.round("sd_unpaired", 8).alias("sd_unpaired"))


_STATS = {
    "gmean": "exp(avg(ln(ttft_ms)))", "mean": "avg(ttft_ms)", "p50": "quantile_cont(ttft_ms, 0.5)",
    "p75": "quantile_cont(ttft_ms, 0.75)", "p90": "quantile_cont(ttft_ms, 0.9)", "p95": "quantile_cont(ttft_ms, 0.95)",
    "trim": "avg(ttft_ms) FILTER (rn > greatest(1, floor(n * 0.1)) AND rn <= n - greatest(1, floor(n * 0.1)))",
}


def _spread_sql() -> str:
    parts = []
    for name, e in _STATS.items():
        parts.append(f"""SELECT '{name}' AS statistic, 'median of runs' AS aggregate, trial, side, median(v) AS v FROM (
          SELECT trial, side, run, {e} AS v FROM byrun GROUP BY trial, side, run) GROUP BY trial, side""")
        parts.append(f"SELECT '{name}', 'pooled requests', trial, side, {e} FROM pooled GROUP BY trial, side")
    return f"""
    WITH g AS (SELECT * FROM gate_samples WHERE side IN ('base', 'candidate')),
    byrun AS (SELECT *, row_number() OVER (PARTITION BY trial, side, run ORDER BY ttft_ms) AS rn, count(*) OVER (PARTITION BY trial, side, run) AS n FROM g),
    pooled AS (SELECT *, row_number() OVER (PARTITION BY trial, side ORDER BY ttft_ms) AS rn, count(*) OVER (PARTITION BY trial, side) AS n FROM g),
    s AS ({" UNION ALL ".join(parts)}),
    r AS (SELECT o.statistic, o.aggregate, ln(o.v / b.v) AS lr FROM s o JOIN s b USING (statistic, aggregate, trial)
      WHERE o.side = 'candidate' AND b.side = 'base')
    SELECT statistic, aggregate, round(stddev_samp(lr), 8) AS sd_log_ratio, round((exp(max(abs(lr))) - 1) * 100, 6) AS max_abs_change_pct
    FROM r GROUP BY ALL"""


@query("A43_aggregation_spread", "gate_samples", sql=_spread_sql())
def a43(spark, d):
    s = G.aggregation_spread(V.gate_samples(spark, d), "base", "candidate")
    return s.select("statistic", "aggregate", F.round("sd_log_ratio", 8).alias("sd_log_ratio"), *r6("max_abs_change_pct"))


_SUBSETS_SQL = """
    WITH i AS (SELECT *, row_number() OVER (PARTITION BY trial, side ORDER BY run) - 1 AS i FROM run_logs WHERE side IN ('base', 'head')),
    mk AS (SELECT trial, unnest(range(0, (1 << (max(i) + 1))::BIGINT)) AS mask FROM i GROUP BY trial),
    s AS (SELECT i.trial, mask, side, count(*) AS runs, avg(log_mean) AS m, var_samp(log_mean) AS v FROM i JOIN mk USING (trial)
      WHERE bit_count(mask) = 3 AND (mask >> i) & 1 = 1 GROUP BY ALL),
    p AS (SELECT *, CASE WHEN se > 0 THEN (va + vb) * (va + vb) / (va * va / (nb - 1) + vb * vb / (no - 1)) END AS df FROM (
      SELECT b.trial, b.mask, o.m - b.m AS d, b.runs AS nb, o.runs AS no, b.v / b.runs AS va, o.v / o.runs AS vb,
        sqrt(b.v / b.runs + o.v / o.runs) AS se
      FROM s b JOIN s o ON b.trial = o.trial AND b.mask = o.mask AND b.side = 'base' AND o.side = 'head')),
    """ + t_quantile_ctes("p") + """,
    c AS (SELECT (exp(d - coalesce(q, 0) * se) - 1) * 100 AS lo, (exp(d + coalesce(q, 0) * se) - 1) * 100 AS hi
      FROM p LEFT JOIN tq ON df9 = round(df, 9))
    SELECT 3 AS runs_per_side, count(*) AS subsets, round(avg((hi <= 10)::INTEGER), 8) AS pass,
      round(avg((hi > 10 AND lo <= 10)::INTEGER), 8) AS inconclusive, round(avg((lo > 10)::INTEGER), 8) AS fail,
      round(median(hi - lo), 5) AS median_width_pts FROM c"""


def _subset_shares(runs, k):
    s = G.subset_characteristics(runs, "base", "head", k)
    return s.select("runs_per_side", "subsets", *[F.round(c, 8).alias(c) for c in ("pass", "inconclusive", "fail")],
                    F.round("median_width_pts", 5).alias("median_width_pts"))


@query("A44_subset_characteristics", "run_logs", sql=_SUBSETS_SQL)
def a44(spark, d):
    return _subset_shares(G.run_log_means(V.gate_samples(spark, d).where("NOT failed")), 3)


def _other_subsets(view: str, logs, k: int) -> None:
    sql = _SUBSETS_SQL.replace("bit_count(mask) = 3", f"bit_count(mask) = {k}").replace("SELECT 3 AS", f"SELECT {k} AS").replace("FROM run_logs ", f"FROM {view} ")
    tag = "" if view == "run_logs" else "_p95"
    query(f"A44_subset_characteristics{tag}_k{k}", view, sql=sql)(
        lambda spark, d: _subset_shares(logs(V.gate_samples(spark, d).where("NOT failed")), k))


for _view, _logs, _sizes in (("run_logs", G.run_log_means, (4, 5)), ("run_logs_p95", G.run_log_p95, (3, 4, 5))):
    for _k in _sizes:
        _other_subsets(_view, _logs, _k)


@query(
    "A51_effect_sizes", "run_logs",
    sql="""
    WITH s AS (SELECT trial, side, avg(log_mean) AS m, count(log_mean) AS runs FROM run_logs GROUP BY ALL)
    SELECT s.trial, s.side AS variant, round(exp(s.m), 6) AS geomean_ms, round((exp(s.m - b.m) - 1) * 100, 6) AS change_pct, s.runs
    FROM s JOIN s b ON s.trial = b.trial AND b.side = 'base'""",
)
def a51(spark, d):
    e = G.effect_sizes(G.run_log_means(V.gate_samples(spark, d).where("NOT failed")), "base")
    return e.select("trial", "variant", *r6("geomean_ms", "change_pct"), "runs")


@query(
    "A52_slowest_positions", "gate_samples",
    sql="""
    WITH p AS (SELECT *, row_number() OVER (PARTITION BY trial, side, run ORDER BY seq, ttft_ms) AS position,
      row_number() OVER (PARTITION BY trial, side, run ORDER BY ttft_ms DESC, seq) AS rank FROM gate_samples)
    SELECT trial, side, run, rank::INTEGER AS rank, position, round(ttft_ms, 6) AS ttft_ms FROM p WHERE rank <= 4""",
)
def a52(spark, d):
    s = G.slowest_positions(V.gate_samples(spark, d))
    return s.select("trial", "side", "run", "rank", "position", *r6("ttft_ms"))


@query(
    "O3_affected_exclusion", *GATE, "affected_trials",
    sql="WITH " + TRIALS_SQL + """SELECT set, trial, verdict FROM trials t
      WHERE NOT EXISTS (SELECT 1 FROM affected_trials a WHERE a.set = t.set AND a.trial = t.trial)""",
)
def o3(spark, d):
    return _trials(spark, d).join(_affected(spark, d), ["set", "trial"], "left_anti").select("set", "trial", "verdict")


@query(
    "A28_wilson_interval", "gate_samples",
    sql="""
    WITH c AS (SELECT side, count(*) FILTER (failed) AS k, count(*) AS n FROM gate_samples GROUP BY side),
    x AS (SELECT *, k / n AS p, 1 + 3.8416 / n AS dd, (k / n + 3.8416 / (2 * n)) / (1 + 3.8416 / n) AS c,
      1.96 * sqrt(k / n * (1 - k / n) / n + 3.8416 / (4 * n * n)) / (1 + 3.8416 / n) AS h FROM c)
    SELECT side, k, n, round(greatest(0, c - h), 9) AS lo, round(least(1, c + h), 9) AS hi FROM x""",
)
def a28(spark, d):
    c = V.gate_samples(spark, d).groupBy("side").agg(F.count_if("failed").alias("k"), F.count("*").alias("n"))
    w = c.withColumn("w", wilson(F.col("k"), F.col("n")))
    return w.select("side", "k", "n", F.round("w.lo", 9).alias("lo"), F.round("w.hi", 9).alias("hi"))


@query(
    "A29_clopper_pearson", *GATE,
    sql="WITH " + TRIALS_SQL + """, k AS (SELECT set, count(*) FILTER (verdict IN ('warn', 'block')) AS k, count(*) AS n FROM trials GROUP BY set),
    b AS (SELECT set, k, n, 0.0::DOUBLE AS l0, 1.0::DOUBLE AS l1, 0.0::DOUBLE AS u0, 1.0::DOUBLE AS u1, 0 AS i FROM k
      UNION ALL SELECT set, k, n, CASE WHEN lt < 0.025 THEN (l0 + l1) / 2 ELSE l0 END, CASE WHEN lt < 0.025 THEN l1 ELSE (l0 + l1) / 2 END,
        CASE WHEN ut < 0.025 THEN u0 ELSE (u0 + u1) / 2 END, CASE WHEN ut < 0.025 THEN (u0 + u1) / 2 ELSE u1 END, i + 1 FROM (
        SELECT *, list_sum(list_transform(range(k, n + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1)) * pow((l0 + l1) / 2, j) * pow(1 - (l0 + l1) / 2, n - j))) AS lt,
          list_sum(list_transform(range(0, k + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1)) * pow((u0 + u1) / 2, j) * pow(1 - (u0 + u1) / 2, n - j))) AS ut
        FROM b WHERE i < 60))
    SELECT set, k, n, round(CASE WHEN k = 0 THEN 0.0 ELSE l0 END, 7) AS lo, round(CASE WHEN k = n THEN 1.0 ELSE u0 END, 7) AS hi FROM b WHERE i = 60""",
)
def a29(spark, d):
    k = _trials(spark, d).groupBy("set").agg(
        F.count_if(F.col("verdict").isin("warn", "block")).alias("k"), F.count("*").alias("n")
    ).withColumn("c", clopper_pearson("k", "n"))
    return k.select("set", "k", "n", F.round("c.lo", 7).alias("lo"), F.round("c.hi", 7).alias("hi"))


# ---------------------------------------------------------------- audits

PUBLISHED_NUDGE = 1e-6


@query(
    "V1_recompute_vs_published", "gate_samples",
    sql="""
    WITH q AS (SELECT trial, side, run, quantile_cont(ttft_ms, 0.5) AS p50, quantile_cont(ttft_ms, 0.95) AS p95 FROM gate_samples GROUP BY ALL),
    pub AS (SELECT trial, side, run, p50 * CASE WHEN run = 2 THEN 1.000001 ELSE 1 END AS pub_p50, p95 AS pub_p95 FROM q)
    SELECT q.trial, q.side, q.run, abs(p50 - pub_p50) <= 1e-8 * greatest(abs(p50), abs(pub_p50)) AS p50_matches,
      abs(p95 - pub_p95) <= 1e-8 * greatest(abs(p95), abs(pub_p95)) AS p95_matches FROM q JOIN pub USING (trial, side, run)""",
)
def v1(spark, d):
    """Published percentiles (built-in percentile, one of four runs nudged) against the recomputed ones."""
    s = V.gate_samples(spark, d)
    pub = exact_quantiles(s, G.RUN_KEYS, "ttft_ms", {"pub_p50": 0.5, "pub_p95": 0.95}).select(
        *G.RUN_KEYS,
        (F.col("pub_p50") * F.when(F.col("run") == 2, 1 + PUBLISHED_NUDGE).otherwise(1.0)).alias("pub_p50"), "pub_p95",
    )
    q = exact_quantiles(s, G.RUN_KEYS, "ttft_ms", {"p50": 0.5, "p95": 0.95})
    return q.join(pub, list(G.RUN_KEYS)).select(
        *G.RUN_KEYS, close(F.col("p50"), F.col("pub_p50")).alias("p50_matches"),
        close(F.col("p95"), F.col("pub_p95")).alias("p95_matches"),
    )


@query(
    "V3_verdict_mismatch", *GATE,
    sql="WITH " + TRIALS_SQL + """, stored AS (SELECT set, trial, round(ci_lo, 1) + CASE WHEN trial = 5 THEN 0.3 ELSE 0 END AS s_lo,
      round(ci_hi, 1) AS s_hi, CASE WHEN trial = 6 THEN 'pass' ELSE verdict END AS s_verdict FROM trials)
    SELECT set, trial, s_verdict AS stored_verdict, verdict FROM trials JOIN stored USING (set, trial)
    WHERE s_verdict <> verdict OR greatest(abs(s_lo - ci_lo), abs(s_hi - ci_hi)) > 0.1 + 1e-9""",
)
def v3(spark, d):
    """Stored verdicts (one trial tampered, one bound shifted) that a recomputation does not confirm."""
    t = _trials(spark, d).select("set", "trial", "verdict", "ci_lo", "ci_hi")
    stored = t.select(
        "set", "trial", F.when(F.col("trial") == 6, "pass").otherwise(F.col("verdict")).alias("verdict"),
        (F.round("ci_lo", 1) + F.when(F.col("trial") == 5, 0.3).otherwise(0.0)).alias("ci_lo"), F.round("ci_hi", 1).alias("ci_hi"),
    )
    return verdict_mismatches(stored, t, ["set", "trial"])
