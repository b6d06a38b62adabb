"""URL filters as a sort-merge range join.

A host's labels are reversed (``www.example.com`` -> ``com.example.www.``), so a host and all its subdomains
form one interval of the sorted keys. URLs and rules are cut into ranges of that order, a rule goes to every
range its interval meets, and one sorted sweep per range keeps the rules whose interval is open on a stack.
A rule fits if also the URL's path starts with the rule's; the longest rule (host and path) wins, the
smaller text among equals.

Range bounds are ``BOUNDS`` keys spread evenly over a hash-ordered sample of the URLs (they only place rows, each
row is judged). A key that fills several ranges is dealt out over all of them, so one hot host or URL is no single task.

Null URLs, and URLs without ``://``, have an empty host and path and fit no rule; what fits no rule gets the
default verdict. Ids may be null or repeated.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracegauge.llm.common import partitions

#: Keys sampled for the range bounds, and the characters kept of each.
SAMPLE, BOUND_LENGTH = 4096, 200
DEFAULT = "allow"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _after_scheme(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    """Labels reversed, each with a stop behind it; the empty host has the empty key."""
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url: str = "url", default: str = DEFAULT) -> DataFrame:
    """(id, host, path, rule, verdict) for every row of ``pages``; ``rules`` has columns host, path, verdict."""
    spark = pages.sparkSession
    n = partitions(spark)
    split = pages.select(F.col(id_col), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    keyed = split.withColumn("key", F.concat(host_key(F.col("host")), F.lit(" "), F.col("path")))
    # by hash, and only hashes below a bound that leaves about 4 * SAMPLE rows in all, whatever the number of tasks
    share = min(1.0, 4 * SAMPLE / max(1, pages.count()))
    hashed = keyed.select(F.substring("key", 1, BOUND_LENGTH).alias("k"), F.xxhash64("key", id_col).alias("h"))
    sample = hashed.where(F.pmod("h", F.lit(1 << 32)) < int(share * (1 << 32))).orderBy("h").limit(SAMPLE)
    keys = sorted((r.k for r in sample.collect()), key=str.encode)
    bounds = [keys[i * len(keys) // n].encode() for i in range(1, n)] if keys else []

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for key, salt in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                k = key.encode()
                lo, hi = bisect_left(bounds, k), bisect_right(bounds, k)
                out.append(lo + salt % (hi - lo + 1))
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(out, pa.int32())], names=[*b.schema.names[:4], "range"])

    kind = pages.select(id_col).schema[0].dataType.simpleString()
    row = f"`{id_col}` {kind}, host string, path string, key string, range int"
    salted = keyed.withColumn("salt", F.pmod(F.xxhash64(F.col(id_col), F.lit(1)), F.lit(1 << 20)))
    placed = salted.mapInArrow(place, row).select(F.col(id_col).alias("id"), "host", "path", "key", "range", F.lit(1).alias("what"), F.lit(None).cast("string").alias("verdict"))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, ranges = [], []
            for i, key in enumerate(b.column(2).to_pylist()):
                k = key.encode()
                first, last = bisect_left(bounds, k), bisect_right(bounds, k + b"\xff")
                rows += [i] * (last - first + 1)
                ranges += range(first, last + 1)
            if rows:
                t = b.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([*t.columns, pa.array(ranges, pa.int32())], names=[*b.schema.names, "range"])

    # a rule without a host would fit no host; null hosts and paths count as empty
    named = rules.select(F.coalesce(F.translate("host", _UPPER, _LOWER), F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").where("host != ''")
    spans = named.select("host", "path", host_key(F.col("host")).alias("key"), "verdict")
    dealt = spans.mapInArrow(spread, "host string, path string, key string, verdict string, range int").select(
        F.lit(None).cast(kind).alias("id"), "host", "path", "key", "range", F.lit(0).alias("what"), "verdict")

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[tuple[str, dict[str, tuple[str, str]], list[int]]] = []  # key, path -> (rule, verdict), lengths of paths
        at = None
        for b in batches:
            ids, hosts, paths, found, verdicts = [], [], [], [], []
            for i, (host, path, key, where, what, verdict) in enumerate(zip(*(c.to_pylist() for c in b.columns[1:]), strict=True)):
                if where != at:
                    stack, at = [], where
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                if what == 0:
                    if not stack or stack[-1][0] != key:
                        stack.append((key, {}, []))
                    _, known, lengths = stack[-1]
                    if path not in known or verdict < known[path][1]:
                        known[path] = (host + path, verdict)
                    if len(path) not in lengths:
                        lengths.append(len(path))
                    continue
                best: tuple[str, str] | None = None
                for _, known, lengths in stack:
                    for size in lengths:
                        rule = known.get(path[:size]) if size <= len(path) else None
                        if rule and (best is None or (-len(rule[0]), rule[0]) < (-len(best[0]), best[0])):
                            best = rule
                ids.append(i)
                hosts.append(host)
                paths.append(path)
                found.append(best and best[0])
                verdicts.append(best[1] if best else default)
            if ids:
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(ids)), *(pa.array(c, pa.string()) for c in (hosts, paths, found, verdicts))],
                    names=[id_col, "host", "path", "rule", "verdict"])

    events = placed.unionByName(dealt).repartition(n, "range").sortWithinPartitions("range", "key", "what")
    return events.mapInArrow(sweep, f"`{id_col}` {kind}, host string, path string, rule string, verdict string")
