"""Run-level regression decisions. Requests are summarized to runs; runs are compared.

Every step is a map-side-combined aggregate: requests -> (trial, side, run) -> (trial, side) ->
one row per comparison. Only that last, small table meets the t-quantile finisher.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracegauge.functions.stats import percent_change, t_quantile, welch
from tracegauge.operators.ordered import neighbour, order_bucket, position
from tracegauge.operators.quantiles import counted, exact_quantiles, ranks_upto
from tracegauge.session import written

MIN_SAMPLES_PER_RUN = 20


@dataclass(frozen=True)
class GatePolicy:
    warn_pct: float = 10.0
    block_pct: float = 25.0
    confidence: float = 0.90
    min_runs: int = 3
    max_extra_failure_rate: float = 0.01


RUN_KEYS = ("trial", "side", "run")


def run_log_means(samples: DataFrame, keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    """ln of the geometric-mean TTFT per run; NULL below 20 samples or with a non-positive one."""
    g = samples.groupBy(*keys).agg(
        F.count("ttft_ms").alias("n"), F.min("ttft_ms").alias("_min"),
        F.avg(F.when(F.col("ttft_ms") > 0, F.log("ttft_ms"))).alias("_m"),
    )
    valid = (F.col("n") >= MIN_SAMPLES_PER_RUN) & (F.col("_min") > 0)
    return g.select(*keys, "n", F.when(valid, F.col("_m")).alias("log_mean"))


def run_log_p95(samples: DataFrame, keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    q = exact_quantiles(samples, keys, "ttft_ms", {"p95": 0.95})
    valid = (F.col("n") >= MIN_SAMPLES_PER_RUN) & (F.col("p95") > 0)
    return q.select(*keys, "n", F.when(valid, F.log("p95")).alias("log_mean"))


def side_stats(runs: DataFrame, value: str, keys: Sequence[str] = ("trial",), side: str = "side") -> DataFrame:
    """Per (key, side): number of runs, mean and sample variance. A missing run value voids the side."""
    return runs.groupBy(*keys, side).agg(
        F.count("*").alias("runs"),
        (F.count(value) == F.count("*")).alias("complete"),
        F.avg(value).alias("mean"),
        F.var_samp(value).alias("var"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )


def pair_sides(stats: DataFrame, base: str, others: Sequence[str], keys: Sequence[str] = ("trial",), side: str = "side") -> DataFrame:
    """Put the base row beside each other side of the same key (both are tiny aggregates)."""
    cols = [c for c in stats.columns if c not in (*keys, side)]
    b = stats.where(F.col(side) == base).select(*keys, *[F.col(c).alias(f"b_{c}") for c in cols])
    o = stats.where(F.col(side).isin(*others)).select(
        *keys, F.lit(base).alias("base"), F.col(side).alias("other"), *[F.col(c).alias(f"o_{c}") for c in cols]
    )
    return o.join(b, list(keys))


def with_welch(pairs: DataFrame, confidence: float) -> DataFrame:
    """Add d, se, df and the interval of the log difference; a zero spread gives a point."""
    w = welch(
        F.col("b_runs"), F.col("b_mean"), F.col("b_var"), F.col("o_runs"), F.col("o_mean"), F.col("o_var"), confidence
    )
    p = pairs.withColumns({"d": w["d"], "se": w["se"], "df": w["df"]}).withColumn("_q", t_quantile(w["p"], F.col("df")))
    half = F.when(F.col("se") == 0, F.lit(0.0)).otherwise(F.col("_q") * F.col("se"))
    return p.withColumns({
        "change_pct": percent_change(F.col("d")),
        "ci_lo": percent_change(F.col("d") - half),
        "ci_hi": percent_change(F.col("d") + half),
    }).drop("_q")


def interval_verdict(lo: Column, hi: Column, change: Column, policy: GatePolicy) -> Column:
    """pass below the tolerance, warn or block above it, otherwise the data support neither."""
    return (
        F.when(hi <= policy.warn_pct, "pass")
        .when((lo > policy.warn_pct) & (change > policy.block_pct), "block")
        .when(lo > policy.warn_pct, "warn")
        .otherwise("inconclusive")
    )


def failure_rates(samples: DataFrame, keys: Sequence[str] = ("trial",)) -> DataFrame:
    """Mean over runs of the failed share, per (key, side)."""
    per_run = samples.groupBy(*keys, "side", "run").agg(F.avg(F.col("failed").cast("double")).alias("f"))
    return per_run.groupBy(*keys, "side").agg(F.avg("f").alias("failure_rate"))


def run_facts(samples: DataFrame, keys: Sequence[str] = ("trial",)) -> DataFrame:
    """All that a verdict needs of a run, from one pass: log_mean as ``run_log_means`` has it, and the failed share (f), written.

    A failed request has no latency, but its run counts.
    """
    ok = ~F.col("failed") if "failed" in samples.columns else F.lit(True)
    x = F.when(ok, F.col("ttft_ms"))
    g = samples.groupBy(*keys, "side", "run").agg(
        F.count(x).alias("n"), F.min(x).alias("_min"), F.avg(F.when(x > 0, F.log(x))).alias("_m"), F.avg((~ok).cast("double")).alias("f"))
    valid = (F.col("n") >= MIN_SAMPLES_PER_RUN) & (F.col("_min") > 0)
    return written(g.select(*keys, "side", "run", "n", F.when(valid, F.col("_m")).alias("log_mean"), "f"), "runs")


def gate(
    samples: DataFrame, base: str, others: Sequence[str], policy: GatePolicy = GatePolicy(), keys: Sequence[str] = ("trial",),
    runs: DataFrame | None = None,
) -> DataFrame:
    """Verdict per comparison. ``samples``: keys, side, run, ttft_ms and, where known, failed.

    Every pair of sides gives a row. Where a run of either side lacks samples, the point rule decides
    (``rule`` = 'point'), and a side without any successful request gives 'error'. The samples are read once
    (``run_facts``, which may be passed), and those of trials with such a run a second time.
    """
    keys = list(keys)
    runs = run_facts(samples, keys) if runs is None else runs
    stats = side_stats(runs, "log_mean", keys).join(runs.groupBy(*keys, "side").agg(F.avg("f").alias("failure_rate")), [*keys, "side"])
    pairs = written(with_welch(pair_sides(stats, base, others, keys), policy.confidence), "pairs")
    whole = F.col("b_complete") & F.col("o_complete")
    short = pairs.where(~whole).select(*keys).distinct()
    names = ("baseline", "value", "change_pct", "separated", "verdict")
    if short.isEmpty():
        types = {"separated": "boolean", "verdict": "string"}
        w = pairs.withColumns({f"p_{c}": F.lit(None).cast(types.get(c, "double")) for c in names})
    else:
        seen = samples.where("NOT failed") if "failed" in samples.columns else samples
        points = point_rule(seen.where("ttft_ms IS NOT NULL").join(short, keys, "left_semi"), base, others, policy, keys)
        w = pairs.join(points.select(*keys, "other", *(F.col(c).alias(f"p_{c}") for c in names)), [*keys, "other"], "left")
    enough = whole & (F.least("b_runs", "o_runs") >= policy.min_runs)
    of_runs = F.when(enough, interval_verdict(F.col("ci_lo"), F.col("ci_hi"), F.col("change_pct"), policy)).otherwise("inconclusive")
    either = lambda x, point: F.when(whole, x).otherwise(F.col(point))
    verdict = F.coalesce(either(of_runs, "p_verdict"), F.lit("error"))
    out = [
        *keys, "base", "other", "b_runs", "o_runs", F.when(whole, "interval").otherwise("point").alias("rule"),
        either(F.exp("b_mean"), "p_baseline").alias("baseline"), either(F.exp("o_mean"), "p_value").alias("value"),
        *(F.when(whole, F.col(c)).alias(c) for c in ("d", "se", "df")),
        either(F.col("change_pct"), "p_change_pct").alias("change_pct"),
        F.when(enough, F.col("ci_lo")).alias("ci_lo"), F.when(enough, F.col("ci_hi")).alias("ci_hi"),
        either(F.round(F.exp("o_min"), 1) > F.round(F.exp("b_max"), 1), "p_separated").alias("separated"),
    ]
    if "failed" not in samples.columns:
        return w.select(*out, verdict.alias("verdict"), F.lit(False).alias("failed_more"))
    worse = F.coalesce(F.col("o_failure_rate") - F.col("b_failure_rate") > policy.max_extra_failure_rate, F.lit(False))
    decided = F.when(worse & (verdict != "error"), "block").otherwise(verdict)
    return w.select(*out, decided.alias("verdict"), "b_failure_rate", "o_failure_rate", worse.alias("failed_more"))


def tail_advisory(samples: DataFrame, base: str, others: Sequence[str], policy: GatePolicy = GatePolicy()) -> DataFrame:
    """The same interval for the run p95: reported, never decisive."""
    runs = run_log_p95(samples.where("NOT failed"))
    return with_welch(pair_sides(side_stats(runs, "log_mean"), base, others), policy.confidence).select(
        "trial", "base", "other", F.exp("b_mean").alias("baseline"), F.exp("o_mean").alias("value"),
        "change_pct", "ci_lo", "ci_hi",
    )


def point_rule(
    samples: DataFrame, base: str, others: Sequence[str], policy: GatePolicy = GatePolicy(), keys: Sequence[str] = ("trial",)
) -> DataFrame:
    """Rule for summaries without samples: medians of the run p95 and whether the runs separate."""
    p95 = exact_quantiles(samples, [*keys, "side", "run"], "ttft_ms", {"p95": 0.95})
    s = p95.groupBy(*keys, "side").agg(
        F.median("p95").alias("med"), F.min("p95").alias("min"), F.max("p95").alias("max"), F.count("*").alias("runs")
    )
    j = pair_sides(s, base, others, keys)
    change = (F.col("o_med") - F.col("b_med")) / F.col("b_med") * 100
    sep = F.col("o_min") > F.col("b_max")
    verdict = (
        F.when((change > policy.block_pct) & (sep | (F.col("b_runs") == 1)), "block")
        .when(change > policy.warn_pct, "warn")
        .otherwise("pass")
    )
    return j.select(
        *keys, "other", F.col("b_med").alias("baseline"), F.col("o_med").alias("value"),
        change.alias("change_pct"), sep.alias("separated"), verdict.alias("verdict"),
    )


def repair_acceptance(samples: DataFrame, policy: GatePolicy = GatePolicy()) -> DataFrame:
    """Accept a candidate only if it is shown faster than the head and bounded against the base."""
    runs = run_facts(samples)
    vs_base = gate(samples, "base", ["head", "candidate"], policy, runs=runs)
    vs_head = gate(samples, "head", ["candidate"], policy, runs=runs)
    one = lambda df, other, tag: df.where(F.col("other") == other).select(
        "trial", F.col("ci_hi").alias(f"hi_{tag}"), F.col("ci_lo").alias(f"lo_{tag}"),
        F.col("verdict").alias(f"verdict_{tag}"), F.col("failed_more").alias(f"failed_{tag}"),
        F.col("change_pct").alias(f"change_{tag}"),
    )
    j = one(vs_base, "head", "hb").join(one(vs_base, "candidate", "cb"), "trial").join(one(vs_head, "candidate", "ch"), "trial")
    valid = F.lit(True)
    for t in ("hb", "cb", "ch"):
        valid = valid & F.col(f"lo_{t}").isNotNull() & (F.col(f"lo_{t}") <= F.col(f"change_{t}")) & (F.col(f"change_{t}") <= F.col(f"hi_{t}"))
    faster = F.col("hi_ch") < 0
    bounded = F.col("hi_cb") < policy.block_pct
    accept = F.coalesce(valid, F.lit(False)) & ~F.col("failed_cb") & faster & bounded
    return j.select(
        "trial", faster.alias("faster_than_head"), bounded.alias("bounded_vs_base"),
        (F.col("hi_cb") <= policy.warn_pct).alias("within_tolerance"), accept.alias("accepted"),
    )


def run_statistics(samples: DataFrame, keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    """Log of geometric mean, mean, p50/p75/p90/p95 and 10 % trimmed mean of each run.

    The trimmed mean counts, per distinct value, the copies whose rank lies inside the kept range.
    """
    keys = list(keys)
    base = samples.groupBy(*keys).agg(
        F.count("ttft_ms").alias("n"), F.avg(F.log("ttft_ms")).alias("gmean"), F.log(F.avg("ttft_ms")).alias("mean")
    )
    held = counted(samples, keys, "ttft_ms")
    q = exact_quantiles(samples, keys, "ttft_ms", {"p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95}, held=held).select(
        *keys, *[F.log(c).alias(c) for c in ("p50", "p75", "p90", "p95")]
    )
    upto = ranks_upto(keys, held)
    sized = upto.join(base.select(*keys, "n"), keys)
    k = F.greatest(F.lit(1).cast("long"), F.floor(F.col("n") * 0.1))
    kept = F.greatest(
        F.lit(0).cast("long"), F.least(F.col("_upto"), F.col("n") - k) - F.greatest(F.col("_upto") - F.col("_c"), k)
    )
    trim = sized.groupBy(*keys).agg(F.log(F.sum(kept * F.col("_x")) / F.sum(kept)).alias("trim"))
    return base.join(q, keys).join(trim, keys)


def within_run_dependence(samples: DataFrame, keys: Sequence[str] = RUN_KEYS, width: float | None = None) -> DataFrame:
    """Share of consecutive samples within 3 % and lag-1 autocorrelation of ln(sample), per run."""
    keys = list(keys)
    prev = neighbour(samples, keys, [F.col("seq"), F.col("ttft_ms")], order_bucket(samples, keys, ["seq", "ttft_ms"], width), F.col("ttft_ms"), "_p")
    means = samples.groupBy(*keys).agg(F.avg(F.log("ttft_ms")).alias("_m"))
    j = prev.join(means, keys)
    x, p = F.log("ttft_ms") - F.col("_m"), F.log("_p") - F.col("_m")
    near = (F.abs(F.col("ttft_ms") - F.col("_p")) / F.col("_p") < 0.03).cast("double")
    return j.groupBy(*keys).agg(
        F.avg(near).alias("near_share"), (F.sum(x * p) / F.sum(x * x)).alias("lag1_autocorrelation")
    )


def variance_components(run_logs: DataFrame, value: str = "log_mean") -> DataFrame:
    """Within-trial SD (pooled), SD of trial means and the intraclass share, in one row."""
    per = run_logs.groupBy("trial").agg(
        F.count(value).alias("k"), F.avg(value).alias("m"), (F.var_pop(value) * F.count(value)).alias("ss")
    )
    s = per.agg(
        F.sqrt(F.sum("ss") / (F.sum("k") - F.count("*"))).alias("sd_within"), F.stddev_samp("m").alias("sd_between")
    )
    b2, w2 = F.col("sd_between") * F.col("sd_between"), F.col("sd_within") * F.col("sd_within")
    return s.withColumn("icc", b2 / (b2 + w2))


def pairing_gain(run_logs: DataFrame, base: str, other: str, value: str = "log_mean") -> DataFrame:
    """SD of paired run differences against the SD expected from unpaired runs."""
    both = run_logs.where(F.col("side").isin(base, other))
    paired = both.groupBy("trial", "run").agg(
        (F.max(F.when(F.col("side") == other, F.col(value))) - F.max(F.when(F.col("side") == base, F.col(value)))).alias("d")
    )
    means = both.groupBy("trial", "side").agg(F.avg(value).alias("_m"))
    resid = both.join(means, ["trial", "side"]).select((F.col(value) - F.col("_m")).alias("e"))
    unpaired = resid.agg(F.sqrt(F.lit(2.0)) * F.stddev_samp("e")).scalar()
    return paired.agg(F.stddev_samp("d").alias("sd_paired")).select("sd_paired", unpaired.alias("sd_unpaired"))


def aggregation_spread(samples: DataFrame, base: str, other: str) -> DataFrame:
    """SD of the log ratio between sides for each statistic, by 'median of runs' and 'pooled requests'."""
    names = ("gmean", "mean", "p50", "p75", "p90", "p95", "trim")
    s = samples.where(F.col("side").isin(base, other))
    by_run = run_statistics(s).unpivot(["trial", "side", "run"], list(names), "statistic", "v")
    med = by_run.groupBy("trial", "side", "statistic").agg(F.median(F.exp("v")).alias("v")).withColumn(
        "aggregate", F.lit("median of runs")
    )
    pool = run_statistics(s, ["trial", "side"]).unpivot(["trial", "side"], list(names), "statistic", "v").select(
        "trial", "side", "statistic", F.exp("v").alias("v"), F.lit("pooled requests").alias("aggregate")
    )
    ratio = med.unionByName(pool).groupBy("trial", "statistic", "aggregate").agg(
        F.log(F.max(F.when(F.col("side") == other, F.col("v"))) / F.max(F.when(F.col("side") == base, F.col("v")))).alias("lr")
    )
    return ratio.groupBy("statistic", "aggregate").agg(
        F.stddev_samp("lr").alias("sd_log_ratio"), (F.expm1(F.max(F.abs("lr"))) * 100).alias("max_abs_change_pct")
    )


def subset_characteristics(run_logs: DataFrame, base: str, other: str, k: int, policy: GatePolicy = GatePolicy()) -> DataFrame:
    """Verdict shares over all k-run subsets of each trial: C(runs, k) rows per trial, whatever the number of runs."""
    w = Window.partitionBy("trial", "side").orderBy("run")
    runs = run_logs.where(F.col("side").isin(base, other)).withColumn("_i", F.row_number().over(w) - 1)
    subsets = runs.groupBy("trial").agg((F.max("_i") + 1).alias("_n")).where(F.col("_n") >= k).withColumn("subset", F.expr("array()").cast("array<int>"))
    for j in range(k):  # ascending positions, each with room for those that follow
        after = F.coalesce(F.element_at("subset", -1) + 1, F.lit(0)) if j else F.lit(0)
        grown = subsets.select("trial", "_n", "subset", F.explode(F.sequence(after, F.col("_n") - k + j)).alias("_i"))
        subsets = grown.select("trial", "_n", F.array_append("subset", F.col("_i")).alias("subset"))
    chosen = subsets.select("trial", "subset", F.explode("subset").alias("_i")).join(runs, ["trial", "_i"])
    pairs = pair_sides(side_stats(chosen, "log_mean", ["trial", "subset"]), base, [other], ["trial", "subset"])
    label = F.when(F.col("ci_hi") <= policy.warn_pct, "pass").when(F.col("ci_lo") > policy.warn_pct, "fail").otherwise("inconclusive")
    v = with_welch(pairs, policy.confidence).select(
        F.lit(k).alias("runs_per_side"), label.alias("label"), (F.col("ci_hi") - F.col("ci_lo")).alias("width"))
    share = lambda x: F.avg((F.col("label") == x).cast("double")).alias(x)
    shares = v.agg(F.lit(k).alias("runs_per_side"), F.count("*").alias("subsets"), share("pass"), share("inconclusive"), share("fail"))
    width = exact_quantiles(v, ["runs_per_side"], "width", {"median_width_pts": 0.5}).select("runs_per_side", "median_width_pts")
    return shares.join(width, "runs_per_side", "left")


def effect_sizes(run_logs: DataFrame, main: str) -> DataFrame:
    """Geometric mean of every variant and its change against ``main``, per trial."""
    s = run_logs.groupBy("trial", "side").agg(F.avg("log_mean").alias("m"), F.count("log_mean").alias("runs"))
    ref = s.where(F.col("side") == main).select("trial", F.col("m").alias("_ref"))
    return s.join(ref, "trial").select(
        "trial", F.col("side").alias("variant"), F.exp("m").alias("geomean_ms"),
        percent_change(F.col("m") - F.col("_ref")).alias("change_pct"), "runs",
    )


def slowest_positions(samples: DataFrame, keys: Sequence[str] = RUN_KEYS, top: int = 4, width: float | None = None) -> DataFrame:
    """Send position of the ``top`` slowest requests of each run (a top-k report)."""
    keys = list(keys)
    placed = position(samples, keys, [F.col("seq"), F.col("ttft_ms")], order_bucket(samples, keys, ["seq", "ttft_ms"], width), "position")
    w = Window.partitionBy(*keys).orderBy(F.col("ttft_ms").desc(), F.col("seq"))
    return placed.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def trial_summary(trials: DataFrame, affected: DataFrame) -> DataFrame:
    """Per set: verdict counts, coverage and spread, without the affected trials and with them.

    Medians come from counted values, so a set may hold any number of trials.
    """
    clean = trials.join(affected.select("set", "trial").distinct(), ["set", "trial"], "left_anti")
    both = clean.withColumn("affected_included", F.lit(False)).unionByName(trials.withColumn("affected_included", F.lit(True)))
    both = written(both.withColumn("_width", F.col("ci_hi") - F.col("ci_lo")), "trials")
    is_ = lambda v: F.count_if(F.col("verdict") == v)
    keys = ["set", "affected_included"]
    counts = both.groupBy(*keys).agg(
        F.count("*").alias("trials"), is_("pass").alias("n_pass"), is_("inconclusive").alias("n_inconclusive"),
        is_("warn").alias("n_warn"), is_("block").alias("n_block"),
        F.count_if((F.col("ci_lo") <= 0) & (F.col("ci_hi") >= 0)).alias("covers_zero"),
        F.min("change_pct").alias("change_min"), F.max("change_pct").alias("change_max"),
    )
    return with_medians(counts, both, keys, {"change_median": "change_pct", "width_median": "_width"})


def with_medians(groups: DataFrame, rows: DataFrame, keys: Sequence[str], medians: dict[str, str]) -> DataFrame:
    """The groups with the exact median of each named column of their rows (NULL where all are)."""
    for name, value in medians.items():
        q = exact_quantiles(rows, keys, value, {name: 0.5}).select(*[F.col(k).alias(f"_q_{k}") for k in keys], name)
        groups = groups.join(q, [F.col(k).eqNullSafe(F.col(f"_q_{k}")) for k in keys], "left").drop(*[f"_q_{k}" for k in keys])
    return groups


def tail_summary(tail: DataFrame, tol: float = 10.0) -> DataFrame:
    """How often the advisory interval rules a tail regression out, establishes one, or neither."""
    out, est = F.col("ci_hi") <= tol, F.col("ci_lo") > tol
    rows = written(tail.withColumn("_width", F.col("ci_hi") - F.col("ci_lo")), "tail")
    counts = rows.groupBy("other").agg(
        F.count("*").alias("n"), F.count_if(out).alias("ruled_out"), F.count_if(est).alias("established"),
        F.count_if(~(out | est)).alias("unresolved"),
        F.min("change_pct").alias("change_min"), F.max("change_pct").alias("change_max"),
    )
    return with_medians(counts, rows, ["other"], {"change_median": "change_pct", "width_median": "_width"})
