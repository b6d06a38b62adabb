"""Ordered operators that stay parallel when one key holds most of the rows.

A plain ``Window.partitionBy(key).orderBy(t)`` sends a hot key to one task. Here every key is
cut into consecutive *buckets* of its order column. Rows are processed inside ``(key, bucket)``;
one small row per ``(key, bucket)`` carries the state across bucket borders and is joined back.
``bucket`` must be a non-decreasing function of the order columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET = "_bucket"
CARRY = "_carry"


def time_bucket(t: Column, width: float) -> Column:
    """Bucket number of a numeric time: ``floor(t / width)``."""
    return F.floor(t / F.lit(float(width))).cast("long")


#: Rows of a bucket on the average, where its size follows from the data.
ROWS_PER_BUCKET = 2_000_000


def place(table: Column, own: Column) -> Column:
    """How many entries of a sorted array are not above ``own``, found by halving (up to 2**25 entries)."""
    halving = F.lit([1 << i for i in range(24, -1, -1)])

    def count(below: Column, jump: Column) -> Column:
        return F.when(F.get(table, below + jump - 1) <= own, below + jump).otherwise(below)

    return F.when(F.size(table) > 0, F.aggregate(halving, F.lit(0), count)).otherwise(0)


class Splitters:
    """Buckets between cut points: one sorted array of (keys, order), a scalar subquery with one entry per bucket."""

    def __init__(self, cuts: DataFrame, keys: Sequence[str], order: Sequence[str]):
        self.cuts, self.own = cuts, F.struct(*keys, *order)

    def added(self, df: DataFrame, out: str = BUCKET) -> DataFrame:
        held = df.withColumn("_cuts", self.cuts.scalar())
        return held.withColumn(out, place(F.col("_cuts"), self.own).cast("long")).drop("_cuts")


def splitters(df: DataFrame, keys: Sequence[str], order: Sequence[str], rows: int) -> Splitters:
    """Cut points at every ``rows``-th row on the average, wherever the rows are.

    A row is a cut point if a hash of its numbers says so. Busy keys and busy times so get many cut points and idle ones
    none, no minimum or maximum is needed, and every copy of the plan and every retried task finds the same ones. Rows
    that agree in all of ``order`` are never parted.
    """
    plain = [n for n, t in df.dtypes if n not in (*keys, *order) and not t.startswith(("array", "map", "struct", "string", "binary", "variant"))]
    cut = F.pmod(F.xxhash64(*keys, *order, *plain), F.lit(rows)) == 0
    cuts = df.where(cut).agg(F.array_sort(F.collect_set(F.struct(*keys, *order))))
    return Splitters(cuts, keys, order)


Bucket = Column | Splitters


def order_bucket(df: DataFrame, keys: Sequence[str], t: str | Sequence[str], width: float | None = None) -> Bucket:
    """Bucket of the order columns ``t``: of a given width (one numeric column), or sized from the data."""
    order = [t] if isinstance(t, str) else list(t)
    if width is not None:
        return time_bucket(F.col(order[0]), width)
    return splitters(df, list(keys), order, ROWS_PER_BUCKET)


def with_bucket(df: DataFrame, bucket: Bucket) -> DataFrame:
    return bucket.added(df) if isinstance(bucket, Splitters) else df.withColumn(BUCKET, bucket)


def log_bucket(v: Column, per_e: int = 256) -> Column:
    """Monotone bucket of any finite double with about 1/per_e relative width, sign kept.

    Needs no pass over the data, and heavy tails do not crowd one bucket as fixed widths would.
    """
    return (F.signum(v) * F.floor(F.log1p(F.abs(v) * 1000.0) * per_e)).cast("long")


def _carry_join(rows: DataFrame, carry: DataFrame, keys: Sequence[str]) -> DataFrame:
    cond = [rows[k].eqNullSafe(carry[k]) for k in keys] + [rows[BUCKET] == carry[BUCKET]]
    return rows.join(carry, cond, "left").drop(*[carry[k] for k in keys], carry[BUCKET])


def running_sum(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], bucket: Bucket, value: Column, out: str
) -> DataFrame:
    """Inclusive running sum of ``value`` per key in ``order``."""
    rows = with_bucket(df, bucket).withColumn("_v", value)
    inner = Window.partitionBy(*keys, BUCKET).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        rows.groupBy(*keys, BUCKET)
        .agg(F.sum("_v").alias("_part"))
        .select(*keys, BUCKET, F.sum("_part").over(before).alias(CARRY))
    )
    local = rows.withColumn("_local", F.sum("_v").over(inner))
    joined = _carry_join(local, carry, keys)
    # a sum over no earlier bucket is NULL; keep the value's own type so integers stay integers
    total = F.col("_local") + F.coalesce(F.col(CARRY), F.col("_v") - F.col("_v"))
    return joined.withColumn(out, total).drop("_v", "_local", CARRY, BUCKET)


def last_known(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], bucket: Bucket, values: dict[str, Column]
) -> DataFrame:
    """Latest non-NULL value at or before each row (the as-of carry), for all of ``values`` (name: value) at once."""
    names = list(values)
    rows = with_bucket(df, bucket).withColumns({f"_v{i}": v for i, v in enumerate(values.values())})
    inner = Window.partitionBy(*keys, BUCKET).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    newest = lambda v: F.max_by(v, F.when(F.col(v).isNotNull(), F.struct(*order)))
    carry = (
        rows.groupBy(*keys, BUCKET)
        .agg(*[newest(f"_v{i}").alias(f"_part{i}") for i in range(len(names))])
        .select(*keys, BUCKET, *[F.last(f"_part{i}", ignorenulls=True).over(before).alias(f"{CARRY}{i}") for i in range(len(names))])
    )
    local = rows.withColumns({f"_local{i}": F.last(f"_v{i}", ignorenulls=True).over(inner) for i in range(len(names))})
    joined = _carry_join(local, carry, keys).withColumns({n: F.coalesce(f"_local{i}", f"{CARRY}{i}") for i, n in enumerate(names)})
    return joined.drop(BUCKET, *[f"{tag}{i}" for tag in ("_v", "_local", CARRY) for i in range(len(names))])


def neighbour(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    bucket: Bucket,
    value: Column,
    out: str,
    *,
    following: bool = False,
) -> DataFrame:
    """``lag`` (or ``lead`` when ``following``) of ``value`` by one row within the key."""
    rows = with_bucket(df, bucket).withColumn("_v", F.struct(value.alias("v")))
    inner = Window.partitionBy(*keys, BUCKET).orderBy(*order)
    across = Window.partitionBy(*keys).orderBy(BUCKET)
    if following:
        edge, shift, local = F.min_by, F.lead, F.lead("_v").over(inner)
    else:
        edge, shift, local = F.max_by, F.lag, F.lag("_v").over(inner)
    carry = (
        rows.groupBy(*keys, BUCKET)
        .agg(edge(F.col("_v"), F.struct(*order)).alias("_part"))
        .select(*keys, BUCKET, shift("_part").over(across).alias(CARRY))
    )
    joined = _carry_join(rows.withColumn("_local", local), carry, keys)
    return joined.withColumn(out, F.coalesce("_local", CARRY)["v"]).drop("_v", "_local", CARRY, BUCKET)


def position(df: DataFrame, keys: Sequence[str], order: Sequence[Column], bucket: Bucket, out: str) -> DataFrame:
    """1-based ``row_number`` per key."""
    return running_sum(df, keys, order, bucket, F.lit(1).cast("long"), out)
