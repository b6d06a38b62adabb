"""Interval, diff and matching joins that keep an equality key, so nothing becomes a nested loop."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracegauge.operators.ordered import order_bucket, position
from tracegauge.session import written


def overlaps(start: Column, end: Column, lo: Column, n: Column) -> Column:
    """Does span [start, end] touch n changed lines from ``lo``? With n = 0 the change sits before ``lo``."""
    e = F.coalesce(end, start)
    return F.when(n == 0, (start < lo) & (lo <= e)).otherwise((start <= lo + n - 1) & (lo <= e))


def overlap_join(
    spans: DataFrame, hunks: DataFrame, keys: Sequence[str], lo: str, n: str, *, width: int = 64
) -> DataFrame:
    """Spans x hunks of the same file that overlap.

    Both sides are cut into line blocks of ``width``; a pair is reported only in the first block
    both share, so it appears once, and a huge file is spread over its blocks.
    """
    return overlap_any_join(spans, hunks, keys, [(lo, n)], width=width)


def overlap_any_join(
    spans: DataFrame, hunks: DataFrame, keys: Sequence[str], sides: Sequence[tuple[str, str]], *, width: int = 64
) -> DataFrame:
    """Spans x hunks of the same file that overlap on any of the hunk's ``sides`` (first line, number of lines).

    The sides of a hunk mostly lie in one block, so the hunk moves once for all of them. A pair is
    reported in the first block that the span and a side share, at most once per side.
    """
    first = lambda c: F.floor(c / width)
    none = F.array().cast("array<bigint>")
    s = spans.withColumn("_s0", first(F.col("line_start"))).withColumn(
        "_b", F.explode(F.sequence("_s0", first(F.coalesce("line_end", "line_start"))))
    )
    ends = [(first(F.col(lo)), first(F.col(lo) + F.greatest(F.col(n) - 1, F.lit(0)))) for lo, n in sides]
    blocks = [F.coalesce(F.sequence(a, b), none) for a, b in ends]
    low, high = (F.least(*[a for a, _ in ends]), F.greatest(*[b for _, b in ends])) if len(ends) > 1 else ends[0]
    several = blocks[0]
    for more in blocks[1:]:
        several = F.array_union(several, more)
    h = hunks.withColumn("_b", F.explode_outer(F.when(low == high, F.array(low)).otherwise(several)))
    pair = F.lit(False)
    for (a, _), (lo, n) in zip(ends, sides, strict=True):
        pair = pair | ((F.col("_b") == F.greatest(F.col("_s0"), a)) & overlaps(F.col("line_start"), F.col("line_end"), F.col(lo), F.col(n)))
    return s.join(h, [*keys, "_b"]).where(pair).drop("_b", "_s0")


def tree_diff(base: DataFrame, head: DataFrame, keys: Sequence[str], digest: str) -> DataFrame:
    """added / removed / modified by path and content digest; equal files are left out."""
    b = base.select(*keys, F.col(digest).alias("_b"))
    h = head.select(*keys, F.col(digest).alias("_h"))
    status = F.when(F.col("_b").isNull(), "added").when(F.col("_h").isNull(), "removed").otherwise("modified")
    j = b.join(h, list(keys), "full_outer")
    return j.where(~F.col("_b").eqNullSafe(F.col("_h"))).select(*keys, status.alias("status"))


def line_changes(base: DataFrame, head: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """Added and removed lines per file by a line-hash multiset difference."""
    lines = lambda df, tag: (
        df.select(*keys, F.explode_outer(F.split(text, "\n")).alias("_l")).where("_l IS NOT NULL").groupBy(*keys, F.md5("_l").alias("_lh")).agg(F.count("*").alias(tag))
    )
    j = lines(base, "_b").join(lines(head, "_h"), [*keys, "_lh"], "full_outer")
    b, h = F.coalesce("_b", F.lit(0)), F.coalesce("_h", F.lit(0))
    return j.groupBy(*keys).agg(
        F.sum(F.greatest(h - b, F.lit(0))).alias("added"), F.sum(F.greatest(b - h, F.lit(0))).alias("removed")
    ).where("added > 0 OR removed > 0")


# Attributes that describe a position, not behavior.
POSITIONAL = ("line", "path")


def attribute_diff(base: DataFrame, head: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Changed attributes per node as map attr -> struct(base, head), and whether the node exists on each side."""
    b = base.select(*keys, F.col("attrs").alias("_b"), F.lit(True).alias("_in_b"))
    h = head.select(*keys, F.col("attrs").alias("_h"), F.lit(True).alias("_in_h"))
    j = b.join(h, list(keys), "full_outer")
    empty = F.create_map().cast("map<string,string>")
    both = F.map_zip_with(
        F.coalesce("_b", empty), F.coalesce("_h", empty), lambda k, x, y: F.struct(x.alias("base"), y.alias("head"))
    )
    changed = F.map_filter(both, lambda k, v: ~k.isin(*POSITIONAL) & ~v["base"].eqNullSafe(v["head"]))
    d = j.select(
        *keys, F.coalesce("_in_b", F.lit(False)).alias("in_base"), F.coalesce("_in_h", F.lit(False)).alias("in_head"),
        F.when(F.col("_in_b") & F.col("_in_h"), changed).otherwise(F.create_map().cast("map<string,struct<base:string,head:string>>")).alias("changes"),
    )
    return d.where(~F.col("in_base") | ~F.col("in_head") | (F.size("changes") > 0))


def match_one_to_one(truth: DataFrame, pred: DataFrame, keys: Sequence[str], id_col: str, width: float | None = None) -> DataFrame:
    """Pair the n-th truth of a key with its n-th prediction; the rest is missed or extra.

    Ids are numeric; numbering runs inside id blocks, so one frequent key does not fill a task.
    """
    number = lambda df, tag: position(df.select(*keys, id_col), keys, [F.col(id_col)], order_bucket(df, keys, id_col, width), "_n").select(
        *keys, "_n", F.col(id_col).alias(f"{tag}_id")
    )
    j = number(truth, "truth").join(number(pred, "pred"), [*keys, "_n"], "full_outer")
    outcome = F.when(F.col("pred_id").isNull(), "missed").when(F.col("truth_id").isNull(), "extra").otherwise("matched")
    return j.select(*keys, "truth_id", "pred_id", outcome.alias("outcome"))


def match_greedy(candidates: DataFrame) -> DataFrame:
    """Each truth, in order, takes its first unused prediction among the candidate pairs (t, p).

    A pair is certain when p is the first remaining choice of t and t the first remaining taker of
    p. All certain pairs are taken per round, at least that of the first remaining t; each round is written,
    so a lost executor does not replay the rounds before.
    """
    left = written(candidates.select("t", "p").distinct(), "candidates")
    taken = None
    while not left.isEmpty():
        best_p = left.groupBy("t").agg(F.min("p").alias("p"))
        best_t = left.groupBy("p").agg(F.min("t").alias("t"))
        sure = written(best_p.join(best_t, ["t", "p"]), "sure")
        taken = sure if taken is None else taken.unionByName(sure)
        left = written(left.join(sure.select("t"), "t", "left_anti").join(sure.select("p"), "p", "left_anti"), "candidates")
    return candidates.select("t", "p").limit(0) if taken is None else taken


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Newest row per key as one combined aggregate (no sort of a long key)."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def keep_recent(df: DataFrame, keys: Sequence[str], id_col: str, order: str, n: int) -> DataFrame:
    """Last ``n`` distinct ids per key; the later duplicate wins (retention is the feature)."""
    last = latest(df, [*keys, id_col], [order])
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc(), F.col(id_col).desc())
    return last.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")
