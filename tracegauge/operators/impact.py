"""Which suite items does a change need? Touched nodes, fallbacks and selection for many scans."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracegauge.functions.change import classify_file
from tracegauge.operators.joins import overlap_any_join
from tracegauge.operators.rules import glob_match


@dataclass(frozen=True)
class SuiteItem:
    """One item of a test suite; a suite is a short configuration list, compiled into expressions."""

    key: str
    kind: str
    binds: tuple[str, ...]
    triggers: tuple[str, ...]
    always: bool = False


HUNK_SIDES = (("new_start", "new_lines"), ("old_start", "old_lines"))


def hunk_hits(spans: DataFrame, hunks: DataFrame) -> DataFrame:
    """(scan, path, key, hunk_id): spans under a hunk on its new or old side; a pair may come once per side."""
    h = hunks.select("scan", "path", "hunk_id", *[c for side in HUNK_SIDES for c in side])
    s = spans.select("scan", "path", "key", "line_start", "line_end")
    return overlap_any_join(s, h, ["scan", "path"], HUNK_SIDES).select("scan", "path", "key", "hunk_id")


def touched_by_hunks(spans: DataFrame, hunks: DataFrame, hits: DataFrame | None = None) -> DataFrame:
    """Span keys a hunk touches on its new or old side, each once. ``hits``: ``hunk_hits`` where they are known already."""
    return (hunk_hits(spans, hunks) if hits is None else hits).select("scan", "key").distinct()


def unmapped_hunks(spans: DataFrame, hunks: DataFrame, hits: DataFrame | None = None) -> DataFrame:
    """Hunks of application files that touch no known span on either side. ``hits``: ``hunk_hits`` of all hunks where they are known already."""
    is_app = classify_file(F.col("path")) == "app"
    app = hunks.where(is_app)
    hit = hunk_hits(spans, app) if hits is None else hits.where(is_app)
    return app.join(hit.select("scan", "hunk_id").distinct(), ["scan", "hunk_id"], "left_anti")


def hunk_fallbacks(spans: DataFrame, hunks: DataFrame, hits: DataFrame | None = None) -> DataFrame:
    """Changed application code that maps to no known span, with the reason."""
    h = unmapped_hunks(spans, hunks, hits)
    return h.select("scan", "path", F.concat("path", F.lit(":"), F.col("new_start").cast("string"), F.lit(" changes code that maps to no graph node")).alias("reason"))


def app_reads(code: DataFrame, changed: DataFrame) -> DataFrame:
    """(scan, path, at): changed files whose name application code quotes, and where it first does."""
    name = F.element_at(F.split("path", "/"), -1)
    named = changed.select("scan", "path", name.alias("name")).distinct()
    return mentions(code, named.select("scan", "name").distinct()).join(named, ["scan", "name"]).select("scan", "path", "at")


def file_fallbacks(changed: DataFrame, modelled: DataFrame, reads: DataFrame | None = None, unparsed: DataFrame | None = None) -> DataFrame:
    """Changed files the analysis cannot account for, with the reason.

    ``reads`` (scan, path, at): files that application code reads. ``unparsed`` (scan, path): head files that do not parse.
    """
    c = classify_file(F.col("path"))
    none = F.lit(None).cast("string")
    known = changed.withColumns({"at": none, "bad": F.lit(False)})
    if reads is not None:
        known = known.drop("at").join(reads.select("scan", "path", "at"), ["scan", "path"], "left")
    if unparsed is not None:
        known = known.drop("bad").join(unparsed.select("scan", "path").distinct().withColumn("bad", F.lit(True)), ["scan", "path"], "left")
    broken = F.coalesce("bad", F.lit(False)) & (c == "app") & (F.col("status") != "removed")
    read = F.col("at").isNotNull() & c.isin("other_source", "unknown", "docs")
    reason = (
        F.when(broken, F.concat("path", F.lit(" does not parse as Python")))
        .when(read, F.concat("path", F.lit(" is read by application code ("), "at", F.lit(") and maps to no graph node")))
        .when(c == "other_source", F.concat("path", F.lit(": source the analysis does not parse")))
        .when(c == "unknown", F.concat("path", F.lit(": a file the analysis does not model")))
        .when((c == "app") & F.col("status").isin("added", "removed"), F.concat("path", F.lit(" was "), "status", F.lit(" and maps to no graph node")))
    )
    rows = known.withColumns({"reason": reason, "_broken": broken}).where("reason IS NOT NULL")
    seen = modelled.select("scan", "path").distinct().withColumn("_known", F.lit(True))
    kept = rows.join(seen, ["scan", "path"], "left").where("_broken OR _known IS NULL")  # spans of the base do not excuse a broken head
    return kept.select("scan", "path", "reason")


def touched_keys(
    spans: DataFrame, hunks: DataFrame, base_nodes: DataFrame, head_nodes: DataFrame, owners: DataFrame, hits: DataFrame | None = None
) -> DataFrame:
    """(scan, key, via) of what a change touches: spans under a hunk, the functions that own them, and nodes whose attributes differ.

    ``base_nodes``, ``head_nodes``: scan, key, digest of the attributes that are no positions. ``owners``: scan, key, owner.
    ``hits``: ``hunk_hits`` where they are known already.
    """
    by_hunk = touched_by_hunks(spans, hunks, hits)
    owned = by_hunk.join(owners, ["scan", "key"]).select("scan", F.col("owner").alias("key"))
    both = base_nodes.select("scan", "key", F.col("digest").alias("_b")).join(head_nodes.select("scan", "key", F.col("digest").alias("_h")), ["scan", "key"], "full_outer")
    differ = both.where(~F.col("_b").eqNullSafe(F.col("_h"))).select("scan", "key")
    tagged = [df.withColumn("via", F.lit(v)) for df, v in ((by_hunk, "hunk"), (owned, "owner"), (differ, "attributes"))]
    return tagged[0].unionByName(tagged[1]).unionByName(tagged[2]).groupBy("scan", "key").agg(F.min("via").alias("via"))


def lost_prefix(base: DataFrame, head: DataFrame) -> DataFrame:
    """(scan, key, path) of system messages whose start was stable on the base and is not on the head (dynamic_head false to true)."""
    was = base.where("NOT dynamic_head").select("scan", "key")
    return head.where("dynamic_head").join(was, ["scan", "key"], "left_semi").select("scan", "key", "path")


def mentions(files: DataFrame, names: DataFrame) -> DataFrame:
    """First ``path:line`` of each scan where application source quotes a file or directory name.

    Quoted words of every line are cut into path segments, so the lookup is an equality join.
    """
    src = files.where(F.col("path").endswith(".py")).select("scan", "path", F.posexplode_outer(F.split("text", "\n")).alias("i", "l"))
    quoted = src.select("scan", "path", "i", F.explode_outer(F.regexp_extract_all("l", F.lit(r"[\"']([^\"'\n]*)[\"']"), F.lit(1))).alias("q"))
    seg = quoted.select("scan", "path", (F.col("i") + 1).alias("line"), F.explode_outer(F.split("q", r"[/\\]")).alias("name")).distinct()
    return seg.join(names, ["scan", "name"]).groupBy("scan", "name").agg(F.min(F.struct("path", "line")).alias("at")).select(
        "scan", "name", F.concat("at.path", F.lit(":"), F.col("at.line").cast("string")).alias("at")
    )


def first_hits(affected: DataFrame, suite: Sequence[SuiteItem]) -> DataFrame:
    """Per scan and suite item the first affected key its patterns match (pattern order, then key).

    One pass over the affected nodes: every pattern is one ``min`` combined before the shuffle.
    """
    mins, picks = [], []
    for i, item in enumerate(suite):
        names = []
        for j, p in enumerate(item.binds):
            mins.append(F.min(F.when(glob_match(F.col("key"), p), F.struct("key", "path"))).alias(f"m{i}_{j}"))
            names.append(F.col(f"m{i}_{j}"))
        none = F.lit(None).cast("struct<key:string,path:array<string>>")
        picks.append(F.struct(F.lit(item.key).alias("item"), F.coalesce(*names, none).alias("hit")))
    return affected.groupBy("scan").agg(*mins).select("scan", F.explode(F.array(*picks)).alias("x")).select("scan", "x.item", "x.hit")


def select_items(
    scans: DataFrame, suite: Sequence[SuiteItem], affected: DataFrame, categories: DataFrame, changed: DataFrame,
    fallbacks: DataFrame, unstable: DataFrame,
) -> DataFrame:
    """One row per scan and suite item: selected or skipped, why, and the graph path.

    ``categories``: scan, category. ``fallbacks``: scan, reason. ``unstable``: scan, key of prompts
    that lost their stable prefix.
    """
    cats = categories.groupBy("scan").agg(F.array_sort(F.collect_set("category")).alias("cats"))
    fall = fallbacks.groupBy("scan").agg(F.min("reason").alias("fallback"))
    lost = unstable.groupBy("scan").agg(F.min("key").alias("lost"))
    meta = F.array(*[
        F.struct(
            F.lit(s.key).alias("item"), F.lit(s.kind).alias("kind"), F.lit(s.always).alias("always"),
            F.array(*[F.lit(t) for t in s.triggers]).cast("array<string>").alias("triggers"),
            F.lit(s.key.split(":", 1)[1] if s.kind == "unit" and ":" in s.key else None).cast("string").alias("test_path"),
        )
        for s in suite
    ])
    rows = scans.select("scan", F.explode(meta).alias("s")).select("scan", "s.*")
    tests = changed.select("scan", F.col("path").alias("test_path")).distinct().withColumn("_changed", F.lit(True))
    j = (
        rows.join(cats, "scan", "left").join(fall, "scan", "left").join(lost, "scan", "left")
        .join(first_hits(affected, suite), ["scan", "item"], "left")
        .join(tests, ["scan", "test_path"], "left")
        .withColumn("cats", F.coalesce("cats", F.array().cast("array<string>")))
    )
    both = F.array_sort(F.array_intersect("triggers", "cats"))
    star = F.array_contains("triggers", "*")
    trig = star | (F.size(both) > 0)
    has = lambda t: F.array_contains("cats", t) & F.array_contains("triggers", t)
    named = F.array_join(F.when(star, F.col("cats")).otherwise(both), ", ")
    hit = F.col("hit").isNotNull()
    steps: list[tuple[Column, bool, Column]] = [
        (F.col("fallback").isNotNull(), True, F.concat(F.lit("full suite: "), F.col("fallback"))),
        (F.col("always"), True, F.lit("always runs")),
        (F.coalesce("_changed", F.lit(False)), True, F.lit("the test file itself changed")),
        (has("dependency"), True, F.lit("a dependency manifest changed")),
        (has("llm_sdk"), True, F.lit("a serving dependency changed")),
        (hit & trig, True, F.concat(named, F.lit(" change reaches "), F.col("hit.key"))),
        ((F.col("kind") == "benchmark") & F.col("lost").isNotNull() & F.array_contains("triggers", "prompt"), True, F.concat("lost", F.lit(" lost its stable prefix"))),
        (hit, False, F.concat(F.lit("exercises "), F.col("hit.key"), F.lit(", but the change is not one it detects"))),
    ]
    chosen, why = None, None
    for cond, sel, reason in steps:
        chosen = F.when(cond, sel) if chosen is None else chosen.when(cond, sel)
        why = F.when(cond, reason) if why is None else why.when(cond, reason)
    return j.select(
        "scan", "item", chosen.otherwise(False).alias("selected"), why.otherwise("exercises nothing this change touches").alias("reason"),
        F.when(hit & trig, F.col("hit.path")).alias("path"),
    )


def localize(hunks: DataFrame, unstable: DataFrame) -> DataFrame:
    """Hunks in the file of a prompt that lost its stable prefix; larger hunks score higher."""
    u = unstable.select("scan", "key", "path").distinct()
    return hunks.join(u, ["scan", "path"]).select(
        "scan", "key", "path", "hunk_id", F.when(F.col("new_lines") > 1, 1.0).otherwise(0.6).alias("score")
    )


def selection_report(selection: DataFrame, results: DataFrame) -> DataFrame:
    """Cost and recall of a targeted selection against the full suite, per scan.

    ``results``: scan, item, verdict, seconds of the full run.
    """
    j = results.join(selection.select("scan", "item", "selected"), ["scan", "item"])
    v = F.col("verdict")
    sev = F.when(v == "fail", 2).when(v.isin("warn", "error"), 1).otherwise(0)
    return j.groupBy("scan").agg(
        F.count("*").alias("items"), F.count_if("selected").alias("items_run"),
        F.sum("seconds").alias("full_seconds"), F.sum(F.when(F.col("selected"), F.col("seconds")).otherwise(0.0)).alias("targeted_seconds"),
        F.count_if(v == "fail").alias("fails"), F.count_if((v == "fail") & F.col("selected")).alias("fails_caught"),
        F.count_if(v == "warn").alias("warns"), F.count_if((v == "warn") & F.col("selected")).alias("warns_caught"),
        (F.max(sev) == F.coalesce(F.max(F.when(F.col("selected"), sev)), F.lit(0))).alias("same_conclusion"),
    )
