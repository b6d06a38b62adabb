"""Bootstrap intervals without materializing resamples.

The k-th order statistic of a resample of n values is the value at rank floor(n*U), U the k-th
smallest of n uniforms, which is Beta(k, n-k+1) distributed; the next one follows from it in closed
form. So a replicate of an interpolated quantile needs two Beta draws and two rank lookups, however
many samples a run holds. Draws are functions of the key and the replicate's number (``functions.stats``), so
neither partitioning nor the engine changes a result.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tracegauge.functions import stats as ST
from tracegauge.operators.quantiles import values_at_ranks
from tracegauge.session import written

MIN_SAMPLES = 20


def quantile_replicates(df: DataFrame, keys: Sequence[str], value: str, prob: float, reps: int, seed: int = 0) -> DataFrame:
    """Bootstrap replicates of one quantile: keys, rep, v."""
    keys = list(keys)
    n = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") >= MIN_SAMPLES)
    each = n.select(*keys, F.col("_n").cast("double").alias("_n"), F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep"))
    key = [F.lit(seed), F.lit(prob), *[F.col(k) for k in keys], F.col("rep")]
    pos = F.lit(prob) * (F.col("_n") - 1)
    k = F.floor(pos) + 1.0  # 1-based order statistic
    u = each.select(*keys, "rep", "_n", k.alias("_k"), (pos - F.floor(pos)).alias("frac"), ST.keyed_beta(k, F.col("_n") - k + 1, *key).alias("_u"))
    above = F.col("_n") - F.col("_k")
    # the next order statistic of the uniforms, given this one
    v = F.when(above > 0, 1 - (1 - F.col("_u")) * F.pow(ST.keyed_uniform(*key, F.lit("next")), 1.0 / above)).otherwise(F.col("_u"))
    rank = lambda x: F.least(F.floor(x * F.col("_n")), F.col("_n").cast("long") - 1)
    d = written(u.select(*keys, "rep", "frac", rank(F.col("_u")).alias("lo"), rank(v).alias("hi")), "replicates")
    need = d.select(*keys, F.explode(F.array("lo", "hi")).alias("rank")).distinct()
    at = values_at_ranks(df, keys, value, need)
    lo = at.withColumnsRenamed({"rank": "lo", "x": "_a"})
    hi = at.withColumnsRenamed({"rank": "hi", "x": "_b"})
    return d.join(lo, [*keys, "lo"]).join(hi, [*keys, "hi"]).select(
        *keys, "rep", (F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("frac")).alias("v")
    )


def percentile_ci(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float], reps: int = 1000, seed: int = 0) -> DataFrame:
    """95 % percentile-bootstrap interval per quantile; groups below 20 samples have none."""
    keys = list(keys)
    out = None
    for name, q in probs.items():
        r = quantile_replicates(df, keys, value, q, reps, seed)
        p = r.groupBy(*keys).agg(F.percentile("v", F.array(F.lit(0.025), F.lit(0.975))).alias("_p"))
        ci = p.select(*keys, F.lit(name).alias("quantile"), F.get("_p", F.lit(0)).alias("lo"), F.get("_p", F.lit(1)).alias("hi"))
        out = ci if out is None else out.unionByName(ci)
    return out


def hierarchical_change_ci(samples: DataFrame, base: str, other: str, reps: int = 500, seed: int = 0) -> DataFrame:
    """Interval of the change in the median of run p95: runs are resampled, and requests inside each."""
    s = samples.where(F.col("side").isin(base, other))
    r = quantile_replicates(s, ["trial", "side", "run"], "ttft_ms", 0.95, reps, seed)
    runs = r.select("trial", "side", "run").distinct()
    listed = runs.groupBy("trial", "side").agg(F.array_sort(F.collect_set("run")).alias("runs"))  # a handful of runs
    draw = listed.select("trial", "side", "runs", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("out_rep")).select(
        "trial", "side", "out_rep", "runs", F.posexplode("runs").alias("slot", "_r")
    )
    h = lambda tag, m: F.floor(ST.keyed_uniform(F.lit(seed), F.lit(tag), F.col("trial"), F.col("side"), F.col("out_rep"), F.col("slot")) * m)
    pick = draw.select(
        "trial", "side", "out_rep", F.get("runs", h("run", F.size("runs")).cast("int")).alias("run"), h("rep", F.lit(reps)).alias("rep")
    )
    med = pick.join(r, ["trial", "side", "run", "rep"]).groupBy("trial", "side", "out_rep").agg(F.median("v").alias("m"))
    at = lambda x: F.max(F.when(F.col("side") == x, F.col("m")))
    change = med.groupBy("trial", "out_rep").agg(((at(other) - at(base)) / at(base) * 100).alias("c"))
    p = change.groupBy("trial").agg(F.percentile("c", F.array(F.lit(0.025), F.lit(0.975))).alias("_p"))
    return p.select("trial", F.get("_p", F.lit(0)).alias("lo"), F.get("_p", F.lit(1)).alias("hi"))


INTERVAL = StructType([StructField("lo", DoubleType()), StructField("hi", DoubleType())])


@F.pandas_udf(INTERVAL)
def corrected_rate_ci(fails: pd.Series, n: pd.Series, tp: pd.Series, fp: pd.Series, tn: pd.Series, fn: pd.Series, seed: pd.Series) -> pd.DataFrame:
    """Interval of the bias-corrected failure rate: verdicts and label pairs are resampled as counts.

    NULL when fewer than half of the replicates give a defined rate.
    """
    reps, rows = 2000, []
    for f, m, a, b, c, d, s in zip(fails, n, tp, fp, tn, fn, seed):
        total = a + b + c + d
        if not m or not total:
            rows.append((None, None))
            continue
        rng = np.random.default_rng(np.uint64(int(s) & (2**64 - 1)))
        p = rng.binomial(int(m), f / m, reps) / m
        k = rng.multinomial(int(total), np.array([a, b, c, d]) / total, reps)
        with np.errstate(divide="ignore", invalid="ignore"):
            tpr, tnr = k[:, 0] / (k[:, 0] + k[:, 3]), k[:, 2] / (k[:, 2] + k[:, 1])
            est = np.clip((p + tnr - 1) / (tpr + tnr - 1), 0, 1)
        est = np.sort(est[np.isfinite(est) & (tpr + tnr > 1)])
        ok = len(est) >= reps / 2
        rows.append((est[int(0.025 * (len(est) - 1))], est[int(0.975 * (len(est) - 1))]) if ok else (None, None))
    return pd.DataFrame(rows, columns=["lo", "hi"])
