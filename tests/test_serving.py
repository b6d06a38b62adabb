import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tracegauge.functions.serving import SLO, counter_delta, slo_ok, tpot_ms
from tracegauge.operators import ordered as O
from tracegauge.operators import serving as S
from tracegauge.operators import telemetry as T
from tracegauge.operators import quantiles as Q
from tracegauge.operators.quantiles import average_ranks, exact_quantiles, values_at_ranks


def test_percentiles_of_1_to_100(spark):
    df = spark.range(1, 101).select(F.lit("a").alias("k"), F.col("id").cast("double").alias("v"))
    r = exact_quantiles(df, ["k"], "v", {"p50": 0.5, "p95": 0.95, "p99": 0.99}, mean="mean").first()
    assert (r.n, r.mean) == (100, 50.5)
    assert (r.p50, r.p95, r.p99) == (pytest.approx(50.5), pytest.approx(95.05), pytest.approx(99.01))


def test_percentiles_of_nothing_and_of_nulls(spark):
    df = spark.createDataFrame([("a", None), ("b", 3.0), ("b", None)], "k string, v double")
    rows = exact_quantiles(df, ["k"], "v", {"p95": 0.95}).collect()
    assert [(r.k, r.n, r.p95) for r in rows] == [("b", 1, 3.0)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_quantiles_match_numpy_on_skewed_groups(spark, seed):
    rng = np.random.default_rng(seed)
    vals = np.concatenate([rng.lognormal(3, 2, 300), -rng.lognormal(1, 1, 50), np.repeat(7.0, 200), [0.0, 1e9, -1e9]])
    keys = np.where(np.arange(len(vals)) % 3 == 0, "hot", "cold")
    df = spark.createDataFrame([(k, float(v)) for k, v in zip(keys, vals)], "k string, v double").repartition(7)
    got = {r.k: r for r in exact_quantiles(df, ["k"], "v", {"a": 0.1, "b": 0.5, "c": 0.99}).collect()}
    for k in ("hot", "cold"):
        want = np.percentile(vals[keys == k], [10, 50, 99])
        assert [got[k].a, got[k].b, got[k].c] == pytest.approx(list(want), rel=1e-12)


def test_values_at_ranks(spark):
    vals = [5.0, 1.0, 1.0, 9.0, -3.0]
    df = spark.createDataFrame([("a", v) for v in vals], "k string, v double")
    ranks = spark.createDataFrame([("a", i) for i in range(5)], "k string, rank long")
    got = {r["rank"]: r.x for r in values_at_ranks(df, ["k"], "v", ranks).collect()}
    assert [got[i] for i in range(5)] == sorted(vals)


def test_average_ranks_share_ties(spark):
    df = spark.createDataFrame([("a", 10.0), ("a", 20.0), ("a", 20.0), ("a", 30.0)], "k string, v double")
    assert {r.v: r.r for r in average_ranks(df, ["k"], "v", "r").collect()} == {10.0: 1.0, 20.0: 2.5, 30.0: 4.0}


def crowded(spark):
    """One key holds half of the rows, and all its values lie within 0.1 %; a few values repeat."""
    rng = np.random.default_rng(11)
    hot = 1000.0 * (1 + rng.beta(0.3, 2, 20_000) * 1e-3)
    hot[:500] = hot[500]
    cold = rng.lognormal(3, 1, 20_000)
    rows = [("hot", float(v)) for v in hot] + [(f"k{i % 9}" if i % 50 else None, float(v)) for i, v in enumerate(cold)]
    return spark.createDataFrame(rows, "k string, v double").repartition(6), rows


def test_a_crowded_value_range_is_divided(spark):
    df, rows = crowded(spark)
    counts = Q.counted(df, ["k"], "v", crowded=200)[0]
    pieces = counts.withColumnRenamed(O.BUCKET, "b").groupBy("k", "b").agg(F.count("*").alias("n"), F.min("_x").alias("lo"), F.max("_x").alias("hi"))
    hot = sorted((r for r in pieces.collect() if r.k == "hot"), key=lambda r: r.b)
    sizes = [r.n for r in hot]
    assert len(sizes) > 60 and max(sizes) <= 3 * np.median(sizes) and sum(sizes) == len({v for k, v in rows if k == "hot"})
    assert all(a.hi < b.lo for a, b in zip(hot, hot[1:]))


def test_quantiles_and_ranks_of_a_crowded_value_range(spark, monkeypatch):
    df, rows = crowded(spark)
    monkeypatch.setattr(Q, "CROWDED", 200)
    got = {r.k: r for r in exact_quantiles(df, ["k"], "v", {"a": 0.01, "b": 0.5, "c": 0.999}).collect()}
    ranks = {(r.k, r.v): r.r for r in average_ranks(df, ["k"], "v", "r").collect()}
    for k in ("hot", "k3", None):
        own = np.array([v for key, v in rows if key == k])
        assert [got[k].a, got[k].b, got[k].c] == pytest.approx(list(np.percentile(own, [1, 50, 99.9])), rel=1e-12)
        place = np.sort(own)
        for v in own[:: len(own) // 40]:
            lo, hi = np.searchsorted(place, [v, np.nextafter(v, np.inf)])
            assert ranks[k, float(v)] == (lo + 1 + hi) / 2


def events(spark, n=400, seed=0):
    rnd = random.Random(seed)
    rows = [("hot" if rnd.random() < 0.7 else f"k{rnd.randrange(4)}", round(rnd.uniform(-50, 500), 2), i, rnd.choice([None, 1, 2, 3])) for i in range(n)]
    return spark.createDataFrame(rows, "k string, t double, seq int, v int")


@pytest.mark.parametrize("width", [0.5, 13.0, 1000.0])
def test_bucketed_windows_equal_plain_windows(spark, width):
    df = events(spark)
    order = [F.col("t"), F.col("seq")]
    w = Window.partitionBy("k").orderBy("t", "seq")
    up = w.rowsBetween(Window.unboundedPreceding, 0)
    b = O.time_bucket(F.col("t"), width)
    want = df.select(
        "k", "seq", F.sum(F.coalesce("v", F.lit(0))).over(up).alias("s"), F.last("v", True).over(up).alias("l"),
        F.lag("v").over(w).alias("p"), F.lead("v").over(w).alias("n"), F.row_number().over(w).alias("rn"),
    )
    got = O.running_sum(df, ["k"], order, b, F.coalesce("v", F.lit(0)), "s")
    got = O.last_known(got, ["k"], order, b, {"l": F.col("v")})
    got = O.neighbour(got, ["k"], order, b, F.col("v"), "p")
    got = O.neighbour(got, ["k"], order, b, F.col("v"), "n", following=True)
    got = O.position(got, ["k"], order, b, "rn").select("k", "seq", "s", "l", "p", "n", "rn")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_bucket_size_follows_the_rows(spark, monkeypatch):
    monkeypatch.setattr(O, "ROWS_PER_BUCKET", 20)
    df = events(spark, 600, 9)
    b = O.with_bucket(df, O.order_bucket(df, ["k"], ["t", "seq"])).withColumnRenamed(O.BUCKET, "b")
    most = b.groupBy("k", "b").count().agg(F.max("count")).first()[0]
    assert most < 160 and b.select("b").distinct().count() > 12
    order = [F.col("t"), F.col("seq")]
    got = O.neighbour(df, ["k"], order, O.order_bucket(df, ["k"], "t"), F.col("v"), "p").select("k", "seq", "p")
    want = df.select("k", "seq", F.lag("v").over(Window.partitionBy("k").orderBy("t", "seq")).alias("p"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    monkeypatch.setattr(O, "ROWS_PER_BUCKET", 10**9)
    assert O.with_bucket(df, O.order_bucket(df, ["k"], "t")).select(O.BUCKET).distinct().count() == 1


def test_a_burst_is_cut_and_idle_time_is_not(spark):
    """Half of the rows of one key stand in a thousandth of its time, many at one instant."""
    rows = [("hot", 500.0 + (i % 400) / 1000, i) for i in range(8000)] + [("hot", i / 8.0, 10_000 + i) for i in range(8000)] + [(None, i * 1.0, i) for i in range(50)]
    df = spark.createDataFrame(rows, "k string, t double, seq int")
    b = O.splitters(df, ["k"], ["t", "seq"], 200).added(df).groupBy("k", O.BUCKET).agg(F.count("*").alias("n"), F.min(F.struct("t", "seq")).alias("lo"), F.max(F.struct("t", "seq")).alias("hi"))
    pieces = sorted((r for r in b.collect() if r.k == "hot"), key=lambda r: r[O.BUCKET])
    assert len(pieces) > 40 and max(r.n for r in pieces) < 2000 and all(tuple(x.hi) < tuple(y.lo) for x, y in zip(pieces, pieces[1:]))


def test_tpot(spark):
    df = spark.createDataFrame([(100.0, 1090.0, 100), (100.0, 200.0, 1), (None, 200.0, 5), (1.0, 2.0, None)], "a double, b double, n int")
    assert [r[0] for r in df.select(tpot_ms(F.col("a"), F.col("b"), F.col("n"))).collect()] == [10.0, None, None, None]


def test_slo_null_rules(spark):
    df = spark.createDataFrame([(None, 1.0, 1.0), (1.0, None, 1.0), (1.0, 1.0, None), (9.0, 1.0, 1.0)], "a double, b double, c double")
    slo = SLO(ttft_ms=5, tpot_ms=5, e2e_ms=5)
    assert [r[0] for r in df.select(slo_ok(F.col("a"), F.col("b"), F.col("c"), slo)).collect()] == [False, True, False, False]


REQ = "run_id string, level double, repeat int, ok boolean, error string, send_ts double, ttft_ms double, e2e_ms double, input_tokens int, output_tokens int, n_chunks int, slo_ok boolean"


def test_summary_of_four_records(spark):
    rows = [
        ("r", 2.0, 0, True, None, 0.0, 100.0, 1000.0, 10, 11, 11, True),
        ("r", 2.0, 0, True, None, 1.0, 100.0, 1000.0, 10, 11, 11, True),
        ("r", 2.0, 0, True, None, 2.0, 900.0, 2000.0, 10, 11, 11, False),
        ("r", 2.0, 0, False, "ttft_timeout", 2.5, None, 500.0, None, None, 0, False),
    ]
    s = S.summarize_level(spark.createDataFrame(rows, REQ)).first()
    assert (s.n, s.n_ok, s.window_s) == (4, 3, 4.0)
    assert (s.request_throughput_rps, s.slo_goodput_rps, s.goodput_ratio) == (0.75, 0.5, 0.5)
    assert (s.failure_rate, s.timeout_rate) == (0.25, 0.25)
    assert s.output_tok_s == pytest.approx(33 / 4) and s.tokens_per_chunk == 1.0


def test_one_missing_count_voids_the_rate_and_no_slo_means_no_goodput(spark):
    rows = [("r", 1.0, 0, True, None, 0.0, 1.0, 1000.0, 10, 5, 5, True), ("r", 1.0, 0, True, None, 1.0, 1.0, 1000.0, None, 5, 5, True)]
    s = S.summarize_level(spark.createDataFrame(rows, REQ), slo_set=False).first()
    assert s.input_tok_s is None and s.total_tok_s is None and s.output_tok_s == 5.0 and s.slo_goodput_rps is None


def test_concurrency_peak_and_touching_intervals(spark):
    df = spark.createDataFrame([("a", 0.0, 1.0), ("a", 0.5, 1.5), ("a", 3.0, 4.0), ("b", 0.0, 1.0), ("b", 1.0, 2.0)], "k string, s double, e double")
    st = S.concurrency_steps(df, ["k"], F.col("s"), F.col("e"), 1.0)
    assert {r.k: r.peak_concurrency for r in S.peak_concurrency(st, ["k"]).collect()} == {"a": 2, "b": 1}
    h = {(r.k, r.concurrency): r.share for r in S.concurrency_histogram(st, ["k"]).collect()}
    assert h[("a", 0)] == pytest.approx(1.5 / 4) and h[("a", 2)] == pytest.approx(0.5 / 4)


def test_distribution_of_one_value_is_one_bin(spark):
    df = spark.createDataFrame([("a", 4.0)] * 3, "k string, v double")
    assert [tuple(r) for r in S.distribution_histogram(df, ["k"], "v").collect()] == [("a", 4.0, 3)]


def test_distribution_matches_numpy(spark):
    rng = np.random.default_rng(4)
    v = np.round(rng.gamma(2, 30, 500), 1)
    df = spark.createDataFrame([("a", float(x)) for x in v], "k string, v double")
    edges = np.unique(np.quantile(v, np.linspace(0, 1, 13)))
    want, _ = np.histogram(v, edges)
    got = {round(r.upper, 6): r["count"] for r in S.distribution_histogram(df, ["k"], "v").collect()}
    assert got == {round(float(e), 6): int(c) for e, c in zip(edges[1:], want) if c}


def test_as_of_state_at_send(spark):
    samples = spark.createDataFrame([("r", 0, 0.0, 0.0), ("r", 1, 1.0, 3.0), ("r", 2, 2.0, None)], "run_id string, seq int, t double, waiting double")
    req = spark.createDataFrame(
        [("r", 8.0, 0.5, 50.0), ("r", 8.0, 1.0, 90.0), ("r", 8.0, 2.5, 70.0), ("r", 8.0, -0.1, 60.0)], "run_id string, level double, send_ts double, ttft_ms double"
    )
    got = T.state_at_send(req, samples, ["waiting"], width=0.75).where("waiting IS NOT NULL")
    assert sorted((r.level, r.waiting, r.ttft_ms) for r in got.collect()) == [(8.0, 0.0, 50.0), (8.0, 3.0, 90.0)]


@pytest.mark.parametrize("x,y,rho", [([0, 0, 1, 2], [1, 2, 3, 4], 0.9486833), ([1, 1, 1], [1, 2, 3], None), ([1, 2], [1, 2], None)])
def test_spearman(spark, x, y, rho):
    df = spark.createDataFrame([("a", float(a), float(b)) for a, b in zip(x, y)], "k string, x double, y double")
    got = T.spearman(df, ["k"], "x", "y").first().rho
    assert got is None if rho is None else got == pytest.approx(rho, abs=1e-7)


def test_counter_reset_gives_null(spark):
    df = spark.createDataFrame([(5.0, 3.0), (1.0, 3.0), (None, 3.0), (3.0, None)], "a double, b double")
    assert [r[0] for r in df.select(counter_delta(F.col("a"), F.col("b"))).collect()] == [2.0, None, None, None]


def test_window_gauges_equal_a_plain_interval_join(spark):
    tel = events(spark, 600, 3).select(F.lit("r").alias("run_id"), F.lit("m").alias("metric"), "t", F.coalesce("v", F.lit(0)).cast("double").alias("value"))
    win = spark.createDataFrame([("r", f"w{i}", i * 11.0, i * 11.0 + 5 * (i + 1) ** 2) for i in range(9)], "run_id string, window_id string, t0 double, t1 double")
    got = T.window_gauges(win, tel, width=20.0)
    want = win.join(tel, "run_id").where("t BETWEEN t0 AND t1").groupBy("run_id", "window_id", "metric").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.max("value").alias("max"))
    f = lambda d: sorted((r.window_id, r.n, round(r.mean, 9), r.max) for r in d.collect())
    assert f(got) == f(want)


def test_sliding_count_equals_a_range_window(spark):
    df = events(spark, 300, 5)
    w = Window.partitionBy("k").orderBy("t").rangeBetween(-30, 0)
    want = df.select("k", "seq", F.count("*").over(w).alias("n"))
    got = T.sliding_count(df, ["k"], "t", 30, "n").select("k", "seq", "n")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("rows", [None, 25])
def test_sliding_count_of_a_burst(spark, rows):
    """One client sends all of its requests within a single window, many of them at one instant."""
    data = [("burst", 100.0 + (i % 60) / 10, i) for i in range(900)] + [("calm", i * 20.0, i) for i in range(60)] + [(None, 7.0, 1), ("calm", None, 99)]
    df = spark.createDataFrame(data, "k string, t double, seq int")
    got = {(r.k, r.t, r.seq): r.n for r in T.sliding_count(df, ["k"], "t", 30, "n", rows).collect()}
    for k, t, seq in data:
        assert got[k, t, seq] == (None if t is None else sum(1 for a, b, _ in data if a == k and b is not None and t - 30 <= b <= t))


def test_results_do_not_depend_on_partitioning(spark, sf):
    from tracegauge.plans import views as V

    r = V.requests(spark, sf)
    a = sorted(map(str, S.latency_percentiles(r.repartition(1)).collect()))
    b = sorted(map(str, S.latency_percentiles(r.repartition(13, "ttft_ms")).collect()))
    strip = lambda rows: [x.split("mean=")[0] for x in rows]  # noqa: E731  the mean's last digit follows the sum order
    assert strip(a) == strip(b)
