"""Detector calibration against human labels, scores, reliability and reproducible splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracegauge.functions.serving import ratio
from tracegauge.functions.stats import rogan_gladen
from tracegauge.operators.ordered import BUCKET

TRUST_RATE, TRUST_N = 0.8, 20


def f1(p: Column, r: Column) -> Column:
    """Harmonic mean; 0 when either side is 0, NULL when a side is undefined otherwise."""
    return F.when((p > 0) & (r > 0), 2 * p * r / (p + r)).when((p == 0) | (r == 0), 0.0)


def confusion(pairs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Counts and rates with FAIL as the positive class; pairs with ERROR or SKIP are left out."""
    usable = pairs.where(F.col("human").isin("PASS", "FAIL") & F.col("judge").isin("PASS", "FAIL"))
    cell = lambda h, j: F.count_if((F.col("human") == h) & (F.col("judge") == j))
    c = usable.groupBy(*keys).agg(
        F.count("*").alias("n"), cell("FAIL", "FAIL").alias("tp"), cell("PASS", "FAIL").alias("fp"),
        cell("PASS", "PASS").alias("tn"), cell("FAIL", "PASS").alias("fn"),
    )
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return c.withColumns({"precision": p, "recall": r, "tnr": ratio(F.col("tn"), F.col("tn") + F.col("fp"))}).withColumn(
        "f1", f1(F.col("precision"), F.col("recall"))
    )


def trusted(cal: DataFrame) -> DataFrame:
    ok = (F.col("n") >= TRUST_N) & (F.col("recall") >= TRUST_RATE) & (F.col("tnr") >= TRUST_RATE)
    return cal.withColumn("trusted", F.coalesce(ok, F.lit(False)))


def corrected_rate(verdicts: DataFrame, cal: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Observed and bias-corrected failure rate of unlabeled verdicts."""
    obs = verdicts.where(F.col("judge").isin("PASS", "FAIL")).groupBy(*keys).agg(
        F.avg((F.col("judge") == "FAIL").cast("double")).alias("observed")
    )
    return obs.join(cal, list(keys)).withColumn("corrected", rogan_gladen(F.col("observed"), F.col("recall"), F.col("tnr")))


def prf(counts: DataFrame) -> DataFrame:
    """precision/recall/F1 from columns tp, n_pred, n_truth; NULL where undefined."""
    p, r = ratio(F.col("tp"), F.col("n_pred")), ratio(F.col("tp"), F.col("n_truth"))
    return counts.withColumns({"precision": p, "recall": r}).withColumn("f1", f1(F.col("precision"), F.col("recall")))


def reliability(points: DataFrame, bins: int = 5) -> DataFrame:
    """Per confidence bin: n, mean confidence, accuracy and the bin's weighted gap."""
    b = F.least(F.floor(F.col("confidence") * bins), F.lit(bins - 1))
    t = points.groupBy(b.alias("bin")).agg(
        F.count("*").alias("n"), F.avg("confidence").alias("mean_conf"), F.avg(F.col("correct").cast("double")).alias("accuracy")
    )
    share = F.col("n") / F.sum("n").over(Window.partitionBy())
    return t.withColumn("gap", share * F.abs(F.col("mean_conf") - F.col("accuracy")))


def hash_order(df: DataFrame, id_col: str, seed: int) -> DataFrame:
    """Dense 0-based position in a seeded order, without one global sort task.

    The order key is md5(seed:id); rows are ranked inside its leading 16 bits and offset by the
    counts of the buckets before (a table of at most 65,536 rows).
    """
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))
    rows = df.withColumn("_k", key).withColumn(BUCKET, F.conv(F.substring("_k", 1, 4), 16, 10).cast("int"))
    sizes = rows.groupBy(BUCKET).agg(F.count("*").alias("_c"))
    before = Window.orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    offs = sizes.select(
        BUCKET, F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off"), F.sum("_c").over(Window.partitionBy()).alias("n_total")
    )
    inner = F.row_number().over(Window.partitionBy(BUCKET).orderBy("_k", id_col))
    return rows.withColumn("_rn", inner).join(offs, BUCKET).withColumn(
        "position", F.col("_off") + F.col("_rn") - 1
    ).drop("_k", BUCKET, "_rn", "_off")


def split_items(df: DataFrame, id_col: str, *, seed: int = 0, train: float = 0.2, dev: float = 0.4) -> DataFrame:
    """Deterministic train/dev/test assignment with rounded sizes."""
    o = hash_order(df, id_col, seed)
    n_train, n_dev = F.round(F.col("n_total") * train), F.round(F.col("n_total") * dev)
    return o.withColumn(
        "split", F.when(F.col("position") < n_train, "train").when(F.col("position") < n_train + n_dev, "dev").otherwise("test")
    )


def few_shot(train: DataFrame, id_col: str, human: str = "human", max_items: int = 4) -> DataFrame:
    """Up to ``max_items`` examples alternating FAIL, PASS while both classes last (a top-k report)."""
    w = Window.partitionBy(human).orderBy(id_col)
    per = train.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= max_items)
    turn = F.struct("_rn", F.when(F.col(human) == "FAIL", 0).otherwise(1))
    return per.withColumn("pick", F.row_number().over(Window.orderBy(turn))).where(F.col("pick") <= max_items).drop("_rn")


def stratified_sample(df: DataFrame, id_col: str, stratum: Sequence[str], n: int, seed: int) -> DataFrame:
    """Proportional sample: max(1, round(n * share)) of each stratum by seeded order, at most n in all."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))
    sizes = df.groupBy(*stratum).agg(F.count("*").alias("_c"))
    total = Window.partitionBy()
    k = sizes.withColumn("_k", F.greatest(F.lit(1), F.round(F.lit(n) * F.col("_c") / F.sum("_c").over(total)))).drop("_c")
    w = Window.partitionBy(*stratum).orderBy("_h", id_col)
    # no stratum can contribute more than n rows, so each task keeps at most n per stratum before the shuffle
    top = df.withColumn("_h", key).withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)
    return top.join(k, list(stratum)).where(F.col("_rn") <= F.col("_k")).drop("_h", "_rn", "_k").orderBy(id_col).limit(n)
