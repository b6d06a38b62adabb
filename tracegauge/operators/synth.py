"""Synthetic workloads from measured distributions; every draw is a hash of the row, not of its partition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracegauge.functions.stats import keyed_normal, keyed_uniform
from tracegauge.operators.calibration import hash_order


def uniform(*parts: Column, seed: int = 0) -> Column:
    """Uniform number in (0, 1) of the given columns."""
    return keyed_uniform(F.lit(seed), *parts)


def sample_lengths(rows: DataFrame, id_col: str, histogram: DataFrame, low: float, out: str = "length", seed: int = 0) -> DataFrame:
    """A length per row from a histogram (upper, count): bin by weight, uniform inside.

    The histogram is the short summary of a distribution (a dozen bins): one sorted array, a scalar subquery, so nothing
    is collected while the plan is built.
    """
    u, v = uniform(F.col(id_col), F.lit("bin"), seed=seed), uniform(F.col(id_col), F.lit("in"), seed=seed)
    bins = histogram.agg(F.array_sort(F.collect_list(F.struct(F.col("upper").cast("double").alias("upper"), F.col("count").cast("long").alias("n")))).alias("b"))
    total = F.aggregate("b", F.lit(0).cast("long"), lambda a, x: a + x["n"])
    upto = F.transform("b", lambda x, i: F.struct(
        (F.aggregate(F.slice("b", F.lit(1), i + 1), F.lit(0).cast("long"), lambda a, y: a + y["n"]) / total).alias("share"),
        F.when(i > 0, F.get("b", i - 1)["upper"]).otherwise(F.lit(float(low))).alias("lo"), x["upper"].alias("hi")))
    table = bins.select(upto.alias("t")).scalar()
    held = rows.withColumn("_bins", table).withColumns({"_u": u, "_v": v})
    own = F.coalesce(F.get(F.filter("_bins", lambda x: F.col("_u") <= x["share"]), F.lit(0)), F.element_at("_bins", -1))
    drawn = held.withColumn("_bin", own).withColumn(out, F.greatest(F.lit(1), F.round(F.col("_bin.lo") + F.col("_v") * (F.col("_bin.hi") - F.col("_bin.lo")))).cast("int"))
    return drawn.drop("_bins", "_u", "_v", "_bin")


def log_normal_lengths(rows: DataFrame, id_col: str, p50: float, p95: float, out: str = "length", seed: int = 0) -> DataFrame:
    """A length per row from the log-normal through p50 and p95 (constant when they coincide)."""
    import math

    if p95 <= p50:
        return rows.withColumn(out, F.lit(max(1, round(p50))))
    sigma = (math.log(p95) - math.log(p50)) / 1.6448536269514722
    z = keyed_normal(F.lit(seed), F.col(id_col), F.lit("length"))
    return rows.withColumn(out, F.greatest(F.lit(1), F.round(F.exp(F.lit(math.log(p50)) + sigma * z))).cast("int"))


def generate_requests(rows: DataFrame, id_col: str, groups: Sequence[tuple[str, float, int]], words: Sequence[str], seed: int = 0) -> DataFrame:
    """Requests with a prefix group chosen by share and text of the wanted length.

    ``rows`` carries ``length`` tokens; ``groups`` is (name, share, shared tokens). The shared part
    repeats for a group, the rest is unique to the row.
    """
    u = uniform(F.col(id_col), F.lit("group"), seed=seed)
    acc, name, shared = 0.0, None, None
    for g, share, n in groups:
        acc += share
        name = F.when(u < acc, g) if name is None else name.when(u < acc, g)
        shared = F.when(u < acc, n) if shared is None else shared.when(u < acc, n)
    vocab = F.array(*[F.lit(w) for w in words])
    word = lambda *p: F.get(vocab, F.floor(uniform(*p, seed=seed) * len(words)).cast("int"))
    r = rows.withColumns({"prefix_group": name, "_s": F.least(F.coalesce(shared, F.lit(0)), F.col("length"))})
    head = F.transform(F.when(F.col("_s") > 0, F.sequence(F.lit(1), F.col("_s"))).otherwise(F.array().cast("array<int>")), lambda i: word(F.col("prefix_group"), i))
    left = F.col("length") - F.col("_s")
    tail = F.transform(F.when(left > 0, F.sequence(F.lit(1), left)).otherwise(F.array().cast("array<int>")), lambda i: word(F.col(id_col), F.lit("tail"), i))
    return r.withColumn("prompt", F.array_join(F.concat(head, tail), " ")).drop("_s")


def replay_cycle(rows: DataFrame, id_col: str, cycles: int, seed: int = 0) -> DataFrame:
    """The rows in a seeded order, repeated ``cycles`` times: columns plus ``seq`` (0-based)."""
    o = hash_order(rows, id_col, seed)
    rep = o.withColumn("_r", F.explode(F.sequence(F.lit(0), F.lit(cycles - 1))))
    return rep.withColumn("seq", F.col("_r") * F.col("n_total") + F.col("position")).drop("_r", "n_total", "position")
