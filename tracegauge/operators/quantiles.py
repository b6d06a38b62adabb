"""Exact quantiles and ranks without holding a group in one buffer or one task.

``percentile()`` keeps every distinct value of a group in one aggregation buffer. For groups that
may hold a third of all rows the functions here count equal values first (map-side combined),
locate the wanted ranks in a value histogram of bounded size, and sort only the buckets that hold
those ranks. A bucket with too many distinct values is divided at the cut points of a quantile
sketch of its key (``divided``), so values that lie close together spread like any others. The counts and the histogram
are written while the plan is built: these functions are actions, and their results read small tables.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracegauge.operators.ordered import BUCKET, log_bucket, place
from tracegauge.session import written

#: Distinct values of a log bucket beyond which it is divided, about so many to a piece.
CROWDED = 1_000_000
#: Cut points a sketch yields at most; each bucket uses one per CROWDED values.
SKETCH = 1024


def counted(df: DataFrame, keys: Sequence[str], value: str, count: Column | None = None, crowded: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(keys, _x, _c, bucket), a row per distinct key and value with its count, and (keys, bucket, _bc, _bs), a row per bucket.

    Both are written: every later step reads them, and none computes the rows again. The bucket never decreases with the
    value. It is the log bucket, divided where that holds more than ``crowded`` distinct values. The cut points come
    from a quantile sketch of those buckets alone; they are one sorted array, a scalar subquery with one entry per
    ``crowded`` values, and a value's piece is the number of cut points up to it, found by halving.
    """
    crowded, keys = crowded or CROWDED, list(keys)
    held = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_x")).agg((F.count("*") if count is None else F.sum(count)).alias("_c"))
    counts = written(held.withColumn(BUCKET, log_bucket(F.col("_x"))), "counts")
    parts = lambda c: c.groupBy(*keys, BUCKET).agg(F.count("*").alias("_d"), F.sum("_c").alias("_bc"), F.sum(F.col("_x") * F.col("_c")).alias("_bs"))
    hist = written(parts(counts), "buckets")
    full = hist.where(F.col("_d") > crowded)
    if not full.isEmpty():
        counts = divided(counts, full, keys, crowded)
        hist = parts(counts)
    return counts, hist


def divided(counts: DataFrame, full: DataFrame, keys: Sequence[str], crowded: int) -> DataFrame:
    """The counts with the buckets in ``full`` cut at quantiles of their values."""
    full = full.select(*[F.col(k).alias(f"_f_{k}") for k in keys], F.col(BUCKET).alias("_fb"), "_d")
    same = [F.col(k).eqNullSafe(F.col(f"_f_{k}")) for k in keys] + [F.col(BUCKET) == F.col("_fb")]
    sketch = F.percentile_approx("_x", [i / SKETCH for i in range(1, SKETCH)], 16 * SKETCH)
    cuts = counts.join(full, same).groupBy(*keys, BUCKET).agg(F.max("_d").alias("_d"), sketch.alias("_q"))
    step = F.greatest(F.lit(1), F.floor(F.lit(SKETCH) / F.ceil(F.col("_d") / crowded))).cast("int")
    some = F.filter("_q", lambda q, i: (i + 1) % step == 0)
    points = written(cuts.select(*keys, F.explode(some).alias("_x")).distinct(), "cuts").agg(F.array_sort(F.collect_list(F.struct(*keys, "_x"))))
    piece = place(F.col("_cuts"), F.struct(*keys, "_x"))
    return counts.withColumn("_cuts", points.scalar()).withColumn(BUCKET, F.col(BUCKET) * (1 << 32) + piece).drop("_cuts")


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float], *, mean: str | None = None,
    held: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """Linear-interpolated quantiles per key: one row per key, one column per entry of ``probs``.

    The rank of probability q among n values is q*(n-1); the value is interpolated between the
    two neighbouring order statistics. NULL values are ignored; ``n`` is the non-NULL count.
    """
    keys = list(keys)
    counts, parts = held or counted(df, keys, value)
    up_to = Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    hist = parts.select(
        *keys,
        BUCKET,
        (F.sum("_bc").over(up_to) - F.col("_bc")).alias("_before"),
        "_bc",
        F.sum("_bc").over(whole).alias("n"),
        F.sum("_bs").over(whole).alias("_sum"),
    )
    wanted = F.array_distinct(
        F.flatten(
            F.array(*[
                F.array(F.floor(F.lit(q) * (F.col("n") - 1)), F.ceil(F.lit(q) * (F.col("n") - 1)))
                for q in probs.values()
            ])
        )
    )
    hit = hist.withColumn(
        "_ranks",
        F.filter(wanted, lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_bc"))),
    ).where(F.size("_ranks") > 0).withColumnRenamed(BUCKET, "_hb")
    hit = hit.select(*[F.col(k).alias(f"_h_{k}") for k in keys], "_hb", "_before", "n", "_sum", "_ranks")
    cond = [F.col(k).eqNullSafe(F.col(f"_h_{k}")) for k in keys] + [F.col(BUCKET) == F.col("_hb")]
    in_bucket = Window.partitionBy(*keys, BUCKET).orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)
    found = (
        counts.join(hit, cond)
        .withColumn("_to", F.col("_before") + F.sum("_c").over(in_bucket))
        .withColumn("_from", F.col("_to") - F.col("_c"))
        .select(
            *keys, "n", "_sum", "_x",
            F.explode(F.filter("_ranks", lambda r: (r >= F.col("_from")) & (r < F.col("_to")))).alias("_r"),
        )
    )

    def at(rank):
        return F.max(F.when(F.col("_r") == rank, F.col("_x")))

    picks = []
    for name, q in probs.items():
        pos = F.lit(q) * (F.col("n") - 1)
        picks += [at(F.floor(pos)).alias(f"_lo_{name}"), at(F.ceil(pos)).alias(f"_hi_{name}")]
    per_key = found.groupBy(*keys, "n", "_sum").agg(*picks)
    out = [F.col(k) for k in keys] + [F.col("n")]
    for name, q in probs.items():
        pos = F.lit(q) * (F.col("n") - 1)
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        out.append((lo + (hi - lo) * (pos - F.floor(pos))).alias(name))
    if mean:
        out.append((F.col("_sum") / F.col("n")).alias(mean))
    return per_key.select(*out)


def ranks_upto(keys: Sequence[str], held: tuple[DataFrame, DataFrame]) -> DataFrame:
    """(keys, _x, _c, _upto): every distinct value of ``counted`` with its count and the rows up to it."""
    counts, parts = held
    before = Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    carry = parts.select(*[F.col(k).alias(f"_h_{k}") for k in keys], F.col(BUCKET).alias("_hb"), F.coalesce(F.sum("_bc").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys, BUCKET).orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)
    local = counts.withColumn("_upto", F.sum("_c").over(inside))
    cond = [F.col(k).eqNullSafe(F.col(f"_h_{k}")) for k in keys] + [F.col(BUCKET) == F.col("_hb")]
    return local.join(carry, cond).select(*keys, "_x", "_c", (F.col("_upto") + F.col("_before")).alias("_upto"))


def average_ranks(df: DataFrame, keys: Sequence[str], value: str, out: str, count: Column | None = None) -> DataFrame:
    """One row per distinct (key, value) with its 1-based rank, ties sharing their mean rank."""
    kind = df.select(value).schema[0].dataType
    rank = F.col("_upto") - (F.col("_c") - 1).cast("double") / 2.0
    return ranks_upto(keys, counted(df, keys, value, count)).select(*keys, F.col("_x").cast(kind).alias(value), rank.alias(out), "_c")


def values_at_ranks(df: DataFrame, keys: Sequence[str], value: str, ranks: DataFrame) -> DataFrame:
    """Order statistics: ``ranks`` (keys, rank; 0-based, below the group's count) with their value ``x``.

    Two as-of steps: a rank finds its histogram bucket, then its value inside the bucket.
    """
    keys = list(keys)
    counts, parts = counted(df, keys, value)
    prior = Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    hist = parts.select(
        *keys, F.coalesce(F.sum("_bc").over(prior), F.lit(0)).alias("_pos"), F.lit(0).alias("_side"), F.col(BUCKET).alias("_hb")
    )
    r = ranks.select(*keys, F.col("rank").cast("long").alias("_pos")).distinct().withColumn("_side", F.lit(1))
    seen = Window.partitionBy(*keys).orderBy("_pos", "_side").rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        hist.unionByName(r, allowMissingColumns=True)
        .withColumns({
            BUCKET: F.last("_hb", ignorenulls=True).over(seen),
            "_base": F.last(F.when(F.col("_side") == 0, F.col("_pos")), ignorenulls=True).over(seen),
        })
        .where("_side = 1")
        .select(*keys, BUCKET, (F.col("_pos") - F.col("_base")).alias("_pos"), F.lit(1).alias("_side"), F.col("_pos").alias("rank"))
    )
    inside = Window.partitionBy(*keys, BUCKET).orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)
    placed = written(placed, "placed")
    wanted = placed.select(*[F.col(k).alias(f"_w_{k}") for k in keys], F.col(BUCKET).alias("_wb")).distinct()
    cond = [F.col(k).eqNullSafe(F.col(f"_w_{k}")) for k in keys] + [F.col(BUCKET) == F.col("_wb")]
    start = counts.join(wanted, cond, "left_semi").select(*keys, BUCKET, (F.sum("_c").over(inside) - F.col("_c")).alias("_pos"), F.lit(0).alias("_side"), "_x")
    asof = Window.partitionBy(*keys, BUCKET).orderBy("_pos", "_side").rowsBetween(Window.unboundedPreceding, 0)
    return (
        start.unionByName(placed, allowMissingColumns=True)
        .withColumn("x", F.last("_x", ignorenulls=True).over(asof))
        .where("_side = 1")
        .select(*keys, "rank", "x")
    )
