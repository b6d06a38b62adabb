"""Quality-constrained configuration choice, for many grids of configurations in one job."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracegauge.functions.stats import percent_change, t_quantile, welch
from tracegauge.operators.ordered import splitters
from tracegauge.session import written


@dataclass(frozen=True)
class ChoicePolicy:
    quality_tol_pts: float = 5.0
    confidence: float = 0.90
    max_failure_rate: float = 0.01
    slo_ttft_p95_ms: float = 500.0


def config_medians(runs: DataFrame) -> DataFrame:
    """Medians and ranges over the runs of each (grid, config); a config has a handful of runs."""
    return runs.groupBy("grid", "config").agg(
        F.count("*").alias("runs"),
        F.median("goodput_rps").alias("goodput_rps"), F.min("goodput_rps").alias("goodput_lo"), F.max("goodput_rps").alias("goodput_hi"),
        F.median("ttft_p95_ms").alias("ttft_p95_ms"), F.median("failure_rate").alias("failure_rate"),
    )


def paired_difference(quality: DataFrame, baseline: str, policy: ChoicePolicy = ChoicePolicy()) -> DataFrame:
    """Mean per-question difference to the baseline config in points, with a paired t interval.

    One question gives an infinite interval, equal differences give a point.
    """
    base = quality.where(F.col("config") == baseline).select("grid", "metric", "question", F.col("share").alias("_b"))
    d = quality.join(base, ["grid", "metric", "question"]).groupBy("grid", "config", "metric").agg(
        F.count("*").alias("questions"),
        F.avg(100.0 * (F.col("share") - F.col("_b"))).alias("diff_pts"),
        F.stddev_samp(100.0 * (F.col("share") - F.col("_b"))).alias("sd"),
    )
    p = F.lit(1 - (1 - policy.confidence) / 2)
    q = d.withColumn("_q", t_quantile(p, F.when(F.col("questions") > 1, (F.col("questions") - 1).cast("double"))))
    half = (
        F.when(F.col("questions") == 1, F.lit(float("inf")))
        .when(F.col("sd") == 0, F.lit(0.0))
        .otherwise(F.col("_q") * F.col("sd") / F.sqrt("questions"))
    )
    return q.select(
        "grid", "config", "metric", "questions", "diff_pts", "sd",
        (F.col("diff_pts") - half).alias("lo_pts"), (F.col("diff_pts") + half).alias("hi_pts"),
    )


def feasibility(runs: DataFrame, quality: DataFrame, baseline: str, policy: ChoicePolicy) -> DataFrame:
    """Medians plus why a config is not feasible: failures, latency, quality not shown within tolerance.

    Runs and quality shares are written once, since each is read several times; so is the result.
    """
    runs, quality = written(runs, "runs"), written(quality, "quality")
    m = config_medians(runs)
    diffs = paired_difference(quality, baseline, policy)
    missed = (F.col("config") != baseline) & (F.col("lo_pts") < -policy.quality_tol_pts)
    q = diffs.groupBy("grid", "config").agg(F.count_if(missed).alias("_missed"))
    known = quality.where(F.col("config") == baseline).select("grid", "metric").distinct()
    orphan = quality.join(known, ["grid", "metric"], "left_anti").groupBy("grid", "config").agg(F.count("*").alias("_orphan"))
    mean = quality.groupBy("grid", "config").agg((100 * F.avg("share")).alias("quality_pct"))
    j = m.join(mean, ["grid", "config"], "left").join(q, ["grid", "config"], "left").join(orphan, ["grid", "config"], "left")
    too_slow = F.col("ttft_p95_ms") > policy.slo_ttft_p95_ms
    fails = F.col("failure_rate") > policy.max_failure_rate
    bad_quality = (F.coalesce("_missed", F.lit(0)) > 0) | (F.coalesce("_orphan", F.lit(0)) > 0)
    return written(j.withColumns({
        "fails": fails, "too_slow": too_slow, "quality_not_shown": bad_quality,
        "feasible": ~(fails | too_slow | bad_quality), "baseline": F.col("config") == baseline,
    }).drop("_missed", "_orphan"), "feasible")


#: Distinct points of a piece of the Pareto sweep, on the average.
FRONT_ROWS = 50_000


def _undominated(x: np.ndarray, y: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Which of distinct points (smaller is better) no other one dominates: a sweep in the order of x with a staircase of (y, z).

    A dominating point comes earlier in the order (x, y, z). The staircase holds the lowest z so far for every y.
    """
    ys: list[float] = []
    zs: list[float] = []
    keep = np.zeros(len(x), bool)
    for i in np.lexsort((z, y, x)).tolist():
        at = bisect_right(ys, y[i])
        if at and zs[at - 1] <= z[i]:
            continue
        keep[i] = True
        at = end = bisect_left(ys, y[i])
        while end < len(zs) and zs[end] >= z[i]:
            end += 1
        ys[at:end], zs[at:end] = [y[i]], [z[i]]
    return keep


def _swept(points: DataFrame, piece: str, order: Sequence[str]) -> DataFrame:
    def sweep(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf[_undominated(*(pdf[c].to_numpy(float) for c in order))]

    return points.groupBy("grid", piece).applyInPandas(sweep, points.schema)


def pareto_front(configs: DataFrame, rows: int | None = None) -> DataFrame:
    """Configs of a grid that no other config dominates on goodput, p95 and mean quality.

    The points are cut twice into pieces of about ``rows``, wherever they lie: by the order of goodput (``_i``) and by the
    order of p95 (``_j``). A point that dominates another one is in the same ``_i`` piece, where a sweep finds it, in the
    same ``_j`` piece, where another sweep does, or before it in both: there only the best quality of all such
    cells matters, a running minimum over the cells. So no two points are paired, and no group grows with the grid. A config
    with a NULL metric neither dominates nor is dominated; equal ones stay together.
    """
    names = ["goodput_rps", "ttft_p95_ms", "quality_pct"]
    cols = ["grid", "config", *names]
    known = F.lit(True)
    for n in names:
        known = known & F.col(n).isNotNull()
    points = configs.where(known).select("grid", (-F.col(names[0])).alias("a"), F.col(names[1]).alias("b"), (-F.col(names[2])).alias("c")).distinct()
    by_i, by_j = (splitters(points, ["grid"], order, rows or FRONT_ROWS) for order in (["a", "b", "c"], ["b", "c", "a"]))
    cut = by_j.added(by_i.added(points, "_i"), "_j")
    left = _swept(_swept(cut, "_i", ["a", "b", "c"]), "_j", ["b", "c", "a"])
    cells = left.groupBy("grid", "_i", "_j").agg(F.min("c").alias("_m"))
    # every (piece, piece) of a grid: the square of its number of pieces, which is its points by ``rows``
    table = cells.select("grid", "_i").distinct().join(cells.select("grid", "_j").distinct(), "grid").join(cells, ["grid", "_i", "_j"], "left")
    before = lambda key, order: Window.partitionBy("grid", key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    up = table.withColumn("_up", F.min("_m").over(before("_j", "_i")))
    best = up.withColumn("_best", F.min("_up").over(before("_i", "_j"))).where("_m IS NOT NULL AND _best IS NOT NULL").select("grid", "_i", "_j", "_best")
    front = left.join(best, ["grid", "_i", "_j"], "left").where("_best IS NULL OR _best > c")
    front = front.select("grid", (-F.col("a")).alias(names[0]), F.col("b").alias(names[1]), (-F.col("c")).alias(names[2]))
    chosen = configs.where(known).select(*cols).join(front, ["grid", *names], "left_semi")
    return chosen.select(*cols).unionByName(configs.where(~known).select(*cols))


def select_config(feasible: DataFrame) -> DataFrame:
    """Per grid: the feasible config with the highest median goodput, its ties, the recommendation."""
    ok = feasible.where("feasible")
    best = F.struct(F.col("goodput_rps"), F.col("config"))
    top = ok.groupBy("grid").agg(F.max_by(F.struct("config", "goodput_lo", "baseline"), best).alias("t"))
    tied = ok.join(top, "grid").where("config <> t.config AND goodput_hi >= t.goodput_lo")
    ties = tied.groupBy("grid").agg(F.count("*").alias("n_ties"), F.bool_or("baseline").alias("_base_tied"))
    grids = feasible.select("grid").distinct()
    rec = (
        F.when(F.col("t").isNull(), "no config meets the constraints")
        .when(F.col("t.baseline"), "keep: no feasible config has higher median goodput")
        .when(F.coalesce("_base_tied", F.lit(False)), "keep: the winner's range overlaps the baseline's")
        .otherwise("switch")
    )
    return grids.join(top, "grid", "left").join(ties, "grid", "left").select(
        "grid", F.col("t.config").alias("pick"), F.coalesce("n_ties", F.lit(0).cast("long")).alias("n_ties"), rec.alias("recommendation")
    )


def confirmation_target(feasible: DataFrame, selection: DataFrame, baseline: str) -> DataFrame:
    """The pick, or the closest feasible challenger when the baseline itself was picked."""
    challenger = feasible.where("feasible AND NOT baseline").groupBy("grid").agg(
        F.max_by("config", F.struct("goodput_rps", "config")).alias("_c")
    )
    j = selection.join(challenger, "grid", "left")
    target = F.when(F.col("pick") != baseline, F.col("pick")).when(F.col("pick") == baseline, F.col("_c"))
    return j.select("grid", "pick", target.alias("target"))


def _ratio_interval(runs: DataFrame, metric: str, targets: DataFrame, baseline: str, policy: ChoicePolicy, tag: str) -> DataFrame:
    s = runs.groupBy("grid", "config").agg(
        F.count("*").alias("n"), F.avg(F.log(metric)).alias("m"), F.var_samp(F.log(metric)).alias("v"), F.min(metric).alias("lo")
    )
    side = lambda df, t: df.select("grid", *[F.col(c).alias(f"{t}_{c}") for c in ("n", "m", "v", "lo")])
    b = side(s.where(F.col("config") == baseline), "b")
    o = side(s.join(targets.select("grid", F.col("target").alias("config")), ["grid", "config"]), "o")
    j = b.join(o, "grid")
    w = welch(F.col("b_n"), F.col("b_m"), F.col("b_v"), F.col("o_n"), F.col("o_m"), F.col("o_v"), policy.confidence)
    k = j.withColumns({"_d": w["d"], "_se": w["se"], "_df": w["df"]}).withColumn("_q", t_quantile(w["p"], F.col("_df")))
    half = F.when(F.col("_se") == 0, F.lit(0.0)).otherwise(F.col("_q") * F.col("_se"))
    valid = (F.col("b_n") >= 2) & (F.col("o_n") >= 2) & (F.least("b_lo", "o_lo") > 0)
    return k.select(
        "grid", F.when(valid, percent_change(F.col("_d"))).alias(f"{tag}_change"),
        F.when(valid, percent_change(F.col("_d") - half)).alias(f"{tag}_lo"),
        F.when(valid, percent_change(F.col("_d") + half)).alias(f"{tag}_hi"),
    )


def confirm(runs: DataFrame, quality: DataFrame, targets: DataFrame, baseline: str, policy: ChoicePolicy = ChoicePolicy()) -> DataFrame:
    """Outcome of an independent rerun: confirmed, no improvement, constraints, or inconclusive."""
    runs, quality = written(runs, "runs"), written(quality, "quality")
    t = targets.where("target IS NOT NULL")
    g = _ratio_interval(runs, "goodput_rps", t, baseline, policy, "goodput")
    p = _ratio_interval(runs, "ttft_p95_ms", t, baseline, policy, "ttft")
    f = feasibility(runs, quality, baseline, policy).select("grid", F.col("config").alias("target"), "feasible")
    j = t.select("grid", "target").join(g, "grid").join(p, "grid").join(f, ["grid", "target"])
    outcome = (
        F.when(F.col("goodput_lo").isNull(), "inconclusive")
        .when(F.col("goodput_hi") <= 0, "not confirmed: no improvement")
        .when((F.col("goodput_lo") > 0) & F.col("feasible"), "confirmed")
        .when(F.col("goodput_lo") > 0, "not confirmed: constraints")
        .otherwise("inconclusive")
    )
    return j.withColumn("outcome", outcome)


def repeat_summary(metrics: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """median, min, max and n of every metric over the repeats of a (config, level)."""
    long = metrics.select(*keys, *names).unpivot(keys, names, "metric", "value")
    return long.groupBy(*keys, "metric").agg(
        F.median("value").alias("median"), F.min("value").alias("min"), F.max("value").alias("max"), F.count("value").alias("n")
    )


def paired_effect(pairs: DataFrame, keys: list[str], on: Column, off: Column) -> DataFrame:
    """Percent change off vs on per pair: median, min, max, n and whether all signs agree."""
    d = F.when(on != 0, (off - on) / on * 100)
    return pairs.withColumn("_d", d).groupBy(*keys).agg(
        F.count("_d").alias("n_pairs"), F.median("_d").alias("median_pct"), F.min("_d").alias("min_pct"), F.max("_d").alias("max_pct"),
        ((F.count("_d") > 0) & ((F.min("_d") > 0) | (F.max("_d") < 0))).alias("consistent_sign"),
    )
