import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tracegauge.functions import stats as ST
from tracegauge.operators import calibration as K
from tracegauge.operators import gate as G
from tracegauge.operators import optimizer as OP
from tracegauge.operators import resample as RS


def one(spark, col):
    return spark.range(1).select(col).first()[0]


@pytest.mark.parametrize("p,df,q", [(0.95, 3, 2.3534), (0.95, 10, 1.8125), (0.975, 2, 4.3027), (0.95, 1, 6.3138), (0.975, 30, 2.0423), (0.95, 4, 2.1318)])
def test_t_quantile_table(spark, p, df, q):
    assert one(spark, ST.t_quantile(F.lit(p), F.lit(float(df)))) == pytest.approx(q, abs=2e-4)
    assert one(spark, ST.t_quantile(F.lit(1 - p), F.lit(float(df)))) == pytest.approx(-q, abs=2e-4)


def test_t_quantile_without_df_is_null(spark):
    assert one(spark, ST.t_quantile(F.lit(0.95), F.lit(None).cast("double"))) is None


@pytest.mark.parametrize("a,want", [((2, 34, 5, 34), 0.2135), ((0, 10, 0, 10), 1.0)])
def test_fisher_known_values(spark, a, want):
    assert one(spark, ST.fisher_less(*[F.lit(x) for x in a])) == pytest.approx(want, abs=1e-3)


def test_fisher_against_the_hypergeometric_sum(spark):
    for k1, n1, k0, n0 in [(5, 34, 20, 34), (5, 34, 5, 34), (30, 34, 1, 40), (0, 5, 5, 5), (7, 7, 3, 9)]:
        t, n = k1 + k0, n1 + n0
        want = sum(math.comb(n1, k) * math.comb(n0, t - k) for k in range(max(0, t - n0), k1 + 1)) / math.comb(n, t)
        assert one(spark, ST.fisher_less(F.lit(k1), F.lit(n1), F.lit(k0), F.lit(n0))) == pytest.approx(want, rel=1e-9)


def test_clopper_pearson_known_values(spark):
    df = spark.createDataFrame([(0, 36), (5, 20), (4, 4)], "k int, n int").withColumn("c", ST.clopper_pearson("k", "n"))
    got = {r.k: (r.c.lo, r.c.hi) for r in df.collect()}
    assert got[0][0] == 0.0 and got[0][1] == pytest.approx(1 - 0.025 ** (1 / 36), abs=1e-6)
    assert got[5] == (pytest.approx(0.0866, abs=1e-3), pytest.approx(0.4910, abs=1e-3))
    assert got[4][1] == 1.0


def test_wilson_is_null_without_data(spark):
    assert one(spark, ST.wilson(F.lit(0), F.lit(0))) is None


SAMPLE = "trial int, side string, run int, ttft_ms double, failed boolean"


def ramp(side, run_levels, n=40, width=0.05, failing=0, trial=1, slow_last=0):
    """Evenly spaced latencies around each run's level, then failed requests; the last ``slow_last`` take five times as long."""
    out = []
    for run, level in enumerate(run_levels):
        for i in range(n):
            v = level * (1 + width * (2 * i / max(1, n - 1) - 1)) * (5 if i >= n - slow_last else 1)
            out.append((trial, side, run, v, False))
        out += [(trial, side, run, 0.0, True)] * failing
    return out


STEADY = (200.0, 201.0, 199.0)


def times(levels, factor):
    return tuple(x * factor for x in levels)


def gate(spark, base, other, **kw):
    return G.gate(spark.createDataFrame(base + other, SAMPLE), "base", ["head"], **kw).first()


@pytest.mark.parametrize("base,factor,verdict", [
    (STEADY, 1.01, "pass"), (STEADY, 0.6, "pass"), (STEADY, 1.16, "warn"), (STEADY, 1.9, "block"), ((150.0, 200.0, 265.0), 1.12, "inconclusive"),
])
def test_interval_verdicts(spark, base, factor, verdict):
    g = gate(spark, ramp("base", base), ramp("head", times(base, factor)))
    assert g.rule == "interval" and g.verdict == verdict
    assert g.change_pct == pytest.approx((factor - 1) * 100, abs=1e-6) and g.ci_lo < g.change_pct < g.ci_hi
    assert g.separated == (min(times(base, factor)) > max(base))


def test_two_runs_a_side_leave_no_interval(spark):
    g = gate(spark, ramp("base", STEADY[:2]), ramp("head", times(STEADY[:2], 4)))
    assert (g.verdict, g.ci_lo, g.ci_hi) == ("inconclusive", None, None)


@pytest.mark.parametrize("factor,failing,verdict", [(1.0, 0, "pass"), (3.0, 0, "block"), (0.7, 12, "block")])
def test_runs_without_enough_samples_go_to_the_point_rule(spark, factor, failing, verdict):
    g = gate(spark, ramp("base", STEADY), ramp("head", times(STEADY, factor), n=12, failing=failing))
    assert (g.rule, g.verdict, g.ci_lo) == ("point", verdict, None) and g.failed_more == (failing > 0)


def test_a_side_without_success_is_an_error_and_keeps_its_row(spark):
    g = gate(spark, ramp("base", STEADY), ramp("head", STEADY, n=0, failing=25))
    assert g.verdict == "error" and g.value is None and g.failed_more
    # one dead run of three: the others are judged, and the failures block
    dead = [(1, "head", 2, 0.0, True)] * 25
    g = gate(spark, ramp("base", STEADY), ramp("head", STEADY[:2]) + dead)
    assert g.rule == "point" and g.o_runs == 3 and g.verdict == "block"


def test_more_failures_block_a_faster_side(spark):
    g = gate(spark, ramp("base", STEADY), ramp("head", times(STEADY, 0.8), failing=8))
    assert g.rule == "interval" and g.change_pct < 0 and g.failed_more and g.verdict == "block"


def test_a_slow_tail_shows_in_the_advisory(spark):
    s = spark.createDataFrame(ramp("base", STEADY, n=200) + ramp("head", STEADY, n=200, slow_last=12), SAMPLE)
    assert G.tail_advisory(s, "base", ["head"]).first().ci_lo > 200
    assert G.gate(s, "base", ["head"]).first().verdict in ("pass", "inconclusive", "warn")


def test_more_requests_do_not_narrow_the_interval(spark):
    spread = (180.0, 200.0, 225.0)
    widths = [g.ci_hi - g.ci_lo for n in (25, 1000) for g in [gate(spark, ramp("base", spread, n=n), ramp("head", times(spread, 1.03), n=n))]]
    assert widths[1] == pytest.approx(widths[0], rel=0.01)


def test_welch_hand_computed(spark):
    rows = [(1, "base", i, v) for i, v in enumerate((0.0, 0.1, -0.1))] + [(1, "head", i, v) for i, v in enumerate((0.1, 0.2, 0.0))]
    s = G.side_stats(spark.createDataFrame(rows, "trial int, side string, run int, log_mean double"), "log_mean")
    r = G.with_welch(G.pair_sides(s, "base", ["head"]), 0.90).first()
    half = 2.1318 * (0.02 / 3) ** 0.5
    assert r.change_pct == pytest.approx((math.exp(0.1) - 1) * 100, abs=1e-6) and r.df == pytest.approx(4)
    assert (r.ci_lo, r.ci_hi) == (pytest.approx((math.exp(0.1 - half) - 1) * 100, abs=0.02), pytest.approx((math.exp(0.1 + half) - 1) * 100, abs=0.02))


@pytest.mark.parametrize("base,head,verdict,separated", [
    ((50.0, 52.0, 54.0), (90.0, 95.0, 99.0), "block", True), ((50.0, 70.0, 90.0), (75.0, 100.0, 140.0), "warn", False), ((50.0, 70.0, 90.0), (52.0, 71.0, 95.0), "pass", False),
])
def test_point_rule_blocks_only_separated_runs(spark, base, head, verdict, separated):
    rows = [(1, side, i, x, False) for side, xs in (("base", base), ("head", head)) for i, x in enumerate(xs)]
    r = G.point_rule(spark.createDataFrame(rows, SAMPLE), "base", ["head"]).first()
    assert (r.verdict, r.separated) == (verdict, separated)


def test_equal_sides_never_block(spark):
    levels = [(100.0 + 7 * t, 104.0 + 3 * t, 97.0 + 5 * t) for t in range(6)]
    rows = [r for t, ls in enumerate(levels) for side in ("base", "head") for r in ramp(side, ls, trial=t)]
    got = G.gate(spark.createDataFrame(rows, SAMPLE), "base", ["head"]).collect()
    assert len(got) == 6 and {g.verdict for g in got} <= {"pass", "inconclusive"}


def test_trimmed_mean_and_percentiles_match_numpy(spark):
    x = np.random.default_rng(7).lognormal(4, 1, 57).round(1)
    s = spark.createDataFrame([(1, "base", 0, float(v)) for v in x], "trial int, side string, run int, ttft_ms double")
    r = G.run_statistics(s).first()
    k = max(1, int(len(x) * 0.1))
    assert r.trim == pytest.approx(math.log(np.sort(x)[k:-k].mean())) and r.p75 == pytest.approx(math.log(np.percentile(x, 75)))


# ------------------------------------------------------------------ calibration

def pairs(spark, **n):
    pick = {"tp": ("FAIL", "FAIL"), "fn": ("FAIL", "PASS"), "tn": ("PASS", "PASS"), "fp": ("PASS", "FAIL"), "err": ("FAIL", "ERROR"), "skip": ("PASS", "SKIP")}
    return spark.createDataFrame([pick[k] for k, c in n.items() for _ in range(c)], "human string, judge string")


def test_confusion_and_trust(spark):
    c = K.trusted(K.confusion(pairs(spark, tp=8, fn=2, tn=27, fp=3))).first()
    assert (c.tp, c.fn, c.tn, c.fp, c.n) == (8, 2, 27, 3, 40)
    assert (c.recall, c.tnr, c.precision) == (pytest.approx(0.8), pytest.approx(0.9), pytest.approx(8 / 11)) and c.trusted
    assert not K.trusted(K.confusion(pairs(spark, tp=5, fn=5, tn=30))).first().trusted
    assert not K.trusted(K.confusion(pairs(spark, tp=4, tn=4))).first().trusted
    e = K.confusion(pairs(spark, err=1, skip=1, tp=1)).first()
    assert (e.n, e.tp) == (1, 1)


def test_rogan_gladen(spark):
    assert one(spark, ST.rogan_gladen(F.lit(0.24), F.lit(0.8), F.lit(0.9))) == pytest.approx(0.2)
    assert one(spark, ST.rogan_gladen(F.lit(0.3), F.lit(0.5), F.lit(0.5))) is None


def test_corrected_rate_interval_brackets_the_point(spark):
    df = spark.createDataFrame([(24, 100, 16, 4, 36, 4)], "fails int, n int, tp int, fp int, tn int, fn int")
    r = df.select(RS.corrected_rate_ci("fails", "n", "tp", "fp", "tn", "fn", F.lit(7)).alias("c")).first().c
    assert r.lo < 0.2 < r.hi and r.hi - r.lo < 0.6


def test_prf_empty_cases(spark):
    df = spark.createDataFrame([(2, 4, 2), (0, 0, 3), (0, 0, 0)], "tp int, n_pred int, n_truth int")
    a, b, c = K.prf(df).collect()
    assert (a.precision, a.recall, a.f1) == (0.5, 1.0, pytest.approx(2 / 3))
    assert b.recall == 0.0 and b.precision is None and c.f1 is None


def test_reliability(spark):
    df = spark.createDataFrame([(0.9, True)] * 9 + [(0.9, False)], "confidence double, correct boolean")
    assert K.reliability(df).agg(F.sum("gap")).first()[0] == pytest.approx(0.0)
    assert K.reliability(spark.createDataFrame([(1.0, False)], df.schema)).first().bin == 4


def test_split_sizes_and_stability(spark):
    ids = spark.range(53)
    a = K.split_items(ids, "id", seed=3)
    assert {r.split: r["count"] for r in a.groupBy("split").count().collect()} == {"train": 11, "dev": 21, "test": 21}
    b = K.split_items(ids.repartition(9), "id", seed=3)
    assert sorted(map(tuple, a.select("id", "split").collect())) == sorted(map(tuple, b.select("id", "split").collect()))


# ------------------------------------------------------------------ configuration choice

Q = [f"q{i}" for i in range(20)]


def grid(spark, *cfgs):
    runs_, qual = [], []
    for name, goodput, p95, fail, flip in cfgs:
        runs_ += [("g", name, i, float(x), float(p95), float(fail)) for i, x in enumerate(goodput)]
        qual += [("g", name, "facts", q, 0.0 if i < flip else 1.0) for i, q in enumerate(Q)]
    return (
        spark.createDataFrame(runs_, "grid string, config string, run int, goodput_rps double, ttft_p95_ms double, failure_rate double"),
        spark.createDataFrame(qual, "grid string, config string, metric string, question string, share double"),
    )


def choose(spark, *cfgs):
    r, q = grid(spark, *cfgs)
    f = OP.feasibility(r, q, "base", OP.ChoicePolicy())
    return {x.config: x for x in f.collect()}, OP.select_config(f).first(), f, r, q


def test_selection_rules(spark):
    _, s, *_ = choose(spark, ("base", [5, 5.1, 5.2], 200, 0, 0), ("fast", [8, 8.1, 8.2], 200, 0, 0))
    assert (s.pick, s.n_ties, s.recommendation) == ("fast", 0, "switch")
    _, s, *_ = choose(spark, ("base", [5, 6, 7], 200, 0, 0), ("fast", [6.5, 7.2, 8], 200, 0, 0))
    assert (s.pick, s.n_ties) == ("fast", 1) and s.recommendation.startswith("keep")
    rows, s, *_ = choose(spark, ("base", [5, 5, 5], 200, 0, 0), ("small", [9, 9, 9], 200, 0, 6), ("slow", [9, 9, 9], 900, 0, 0), ("flaky", [9, 9, 9], 200, 0.05, 0))
    assert not rows["small"].feasible and rows["small"].quality_not_shown and rows["slow"].too_slow and rows["flaky"].fails
    assert s.pick == "base"


def test_paired_interval_hand_computed(spark):
    rows = [("g", "base", "m", k, 0.0) for k in "abcd"] + [("g", "o", "m", k, v) for k, v in zip("abcd", (0.1, 0.0, -0.1, 0.2))] + [("g", "one", "m", "a", 0.5)]
    p = OP.paired_difference(spark.createDataFrame(rows, "grid string, config string, metric string, question string, share double"), "base")
    got = {r.config: r for r in p.collect()}
    half = 2.3534 * 12.909944487358056 / 2
    assert got["o"].diff_pts == pytest.approx(5.0) and got["o"].lo_pts == pytest.approx(5 - half, abs=1e-3)
    assert (got["one"].lo_pts, got["one"].hi_pts) == (float("-inf"), float("inf"))
    assert got["base"].lo_pts == got["base"].hi_pts == 0.0


def test_confirmation(spark):
    _, s, f, r, q = choose(spark, ("base", [9, 9.1, 9.2], 200, 0, 0), ("a", [5, 5.1], 200, 0, 0), ("b", [7, 7.1], 200, 0, 0))
    assert OP.confirmation_target(f, OP.select_config(f), "base").first().target == "b"

    def outcome(goodput, p95=200, flip=0):
        r, q = grid(spark, ("base", [5.0, 5.1, 4.9, 5.0], 200, 0, 0), ("c", goodput, p95, 0, flip))
        return OP.confirm(r, q, spark.createDataFrame([("g", "c")], "grid string, target string"), "base").first().outcome

    assert outcome([8.0, 8.1, 7.9, 8.0]) == "confirmed"
    assert outcome([4.0, 4.1, 3.9, 4.0]) == "not confirmed: no improvement"
    assert outcome([4.0, 6.5, 5.5, 4.5]) == "inconclusive"
    assert outcome([8.0, 8.1, 7.9, 8.0], flip=6) == outcome([8.0, 8.1, 7.9, 8.0], p95=900) == "not confirmed: constraints"
    assert outcome([8.0]) == outcome([0.0, 8.0]) == "inconclusive"


GRID = "grid string, config string, goodput_rps double, ttft_p95_ms double, quality_pct double"


@pytest.mark.parametrize("piece", [7, 60, None])
def test_pareto_front_against_brute_force(spark, piece):
    rng = np.random.default_rng(3)
    rows = [("g", f"c{i}", *map(float, rng.integers(0, 12, 3))) for i in range(300)]
    got = {r.config for r in OP.pareto_front(spark.createDataFrame(rows, GRID), piece).collect()}
    v = {c: np.array([g, -p, q]) for _, c, g, p, q in rows}
    want = {c for c, x in v.items() if not any((y >= x).all() and (y > x).any() for y in v.values())}
    assert got == want


def test_pareto_fronts_of_nulls_ties_and_several_grids(spark):
    rows = [("g", "a", 1.0, 5.0, 9.0), ("g", "b", 1.0, 5.0, 9.0), ("g", "c", 1.0, 5.0, 8.0), ("g", "n", None, 5.0, 8.0), ("h", "x", 0.0, 9.0, 0.0), ("h", "y", 0.0, 9.0, -0.0)]
    assert sorted(r.config for r in OP.pareto_front(spark.createDataFrame(rows, GRID), 2).collect()) == ["a", "b", "n", "x", "y"]
    assert OP.pareto_front(spark.createDataFrame([], GRID)).count() == 0


def test_pareto_front_of_a_hundred_thousand_configs(spark):
    """Pieces stay small and nothing is paired, also where much of the grid is undominated."""
    rng = np.random.default_rng(5)
    x = rng.random((100_000, 3))
    x[:4000] /= np.linalg.norm(x[:4000], axis=1)[:, None]  # a shell
    x[4000:] /= 2
    pdf = pd.DataFrame({"grid": "g", "config": [f"c{i}" for i in range(len(x))], "goodput_rps": x[:, 0], "ttft_p95_ms": -x[:, 1], "quality_pct": x[:, 2]})
    got = {r.config for r in OP.pareto_front(spark.createDataFrame(pdf), 4000).collect()}
    assert got == {f"c{i}" for i in np.nonzero(OP._undominated(-x[:, 0], -x[:, 1], -x[:, 2]))[0]} and len(got) > 1000
    some = rng.choice(len(x), 300)
    for i in some:  # the sweep itself, point by point
        beaten = ((x >= x[i]).all(1) & (x > x[i]).any(1)).any()
        assert (f"c{i}" in got) == (not beaten)


# ------------------------------------------------------------------ bootstrap

def test_order_statistic_bootstrap_matches_resampling(spark):
    x = np.random.default_rng(1).lognormal(3, 0.6, 150)
    df = spark.createDataFrame([("a", float(v)) for v in x], "k string, v double")
    got = {r.quantile: r for r in RS.percentile_ci(df, ["k"], "v", {"p50": 0.5, "p95": 0.95}, reps=3000).collect()}
    s = x[np.random.default_rng(0).integers(0, len(x), (6000, len(x)))]
    for name, q in (("p50", 50), ("p95", 95)):
        b = np.percentile(s, q, axis=1)
        width = np.percentile(b, 97.5) - np.percentile(b, 2.5)
        assert got[name].lo == pytest.approx(np.percentile(b, 2.5), abs=0.15 * width)
        assert got[name].hi == pytest.approx(np.percentile(b, 97.5), abs=0.15 * width)


def test_bootstrap_needs_twenty_samples_and_ignores_partitioning(spark):
    df = spark.createDataFrame([("few", float(i)) for i in range(19)] + [("many", float(i)) for i in range(40)], "k string, v double")
    a = RS.percentile_ci(df, ["k"], "v", {"p95": 0.95}, reps=100).collect()
    b = RS.percentile_ci(df.repartition(9), ["k"], "v", {"p95": 0.95}, reps=100).collect()
    assert [r.k for r in a] == ["many"] and a == b


def test_subsets_of_a_trial_with_many_runs(spark):
    rng = np.random.default_rng(5)
    rows = [(t, side, r, float(rng.normal(4.6 + (side == "head") * 0.02, 0.03)))
            for t, n in (("few", 2), ("some", 5), ("many", 14)) for side in ("base", "head") for r in range(n)]
    df = spark.createDataFrame(rows, "trial string, side string, run int, log_mean double")
    for k in (3, 4):
        got = G.subset_characteristics(df, "base", "head", k).first()
        assert got.subsets == math.comb(5, k) + math.comb(14, k)
        assert got["pass"] + got.inconclusive + got.fail == pytest.approx(1)
        assert got.median_width_pts > 0
