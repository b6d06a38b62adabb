"""Benchmark decontamination: one Aho-Corasick automaton over the word windows of all test items.

Texts are read as words (ASCII letters and digits and all non-ASCII, A-Z lower-cased). A window is
``WINDOW`` consecutive words of an item, or a whole shorter item. The automaton runs over the document's
word numbers once and reports every window; offsets go back to the original text.

Null or wordless documents have no words and are clean; null or wordless items have no windows. Repeated
items and ids count once. A null item id is listed as ``null``. An item table above ``block_chars``
characters is handled in blocks, one automaton and one pass each, with the hits of all passes united.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable
from math import ceil

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracegauge.llm.common import WORDS, map_batches, materialize

WINDOW = 13
#: A document is contaminated if at least one word in this many is hit.
ONE_IN = 20
#: Items of one automaton, in characters: the size bound of what is sent to each task.
BLOCK_CHARS = 8_000_000
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(WORDS).split()


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        return 0


class Scanner:
    """The automaton: per document the merged word intervals that are hit, and the items seen."""

    def __init__(self, items: list[tuple[str, str]]):
        self.numbers = _Numbers()
        owners: dict[tuple[int, ...], set[str]] = defaultdict(set)
        for item, text in items:
            ids = tuple(self.numbers.setdefault(w, len(self.numbers) + 1) for w in words_of(text))
            for i in range(max(1, len(ids) - WINDOW + 1) if ids else 0):
                owners[ids[i:i + WINDOW]].add(item)
        self.automaton = None
        if owners:
            self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
            for window, who in owners.items():
                self.automaton.add_word(window, (len(window), who))
            self.automaton.make_automaton()

    def __call__(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        hits: list[tuple[int, int]] = []
        seen: set[str] = set()
        if self.automaton is None or not words:
            return hits, seen
        for end, (n, who) in self.automaton.iter(tuple(map(self.numbers.__getitem__, words))):
            seen |= who
            hits.append((end + 1 - n, end + 1))
        return merged(hits), seen


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def item_blocks(items: DataFrame, id_col: str, text: str, block_chars: int) -> list[list[tuple[str, str]]]:
    """The items on the driver, at most about ``block_chars`` characters at a time."""
    named = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("i"), F.col(text).alias("t")).where(F.col("t").isNotNull())
    total = named.agg(F.sum(F.length("t"))).first()[0] or 0
    n = max(1, ceil(total / block_chars))
    for b in range(n):
        part = named if n == 1 else named.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b)
        yield [(r.i, r.t) for r in part.collect()]


SPANS = "array<struct<start: bigint, end: bigint>>"


def annotate(docs: DataFrame, items: DataFrame, text: str = "text", into: str = "hits", item_id: str = "item_id",
             item_text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` with a struct column ``into``: n_words, hit word intervals, item ids (as strings, sorted), spans in the original text.

    A column of that name is replaced.
    """
    out, first = docs, True
    for block in item_blocks(items, item_id, item_text, block_chars):
        out = _pass(out if first else materialize(out, "decontaminate"), block, text, into, first)
        first = False
    return out


def _pass(docs: DataFrame, items: list[tuple[str, str]], text: str, into: str, first: bool) -> DataFrame:
    pair = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    kind = pa.struct([("n_words", pa.int64()), ("hit", pair), ("items", pa.list_(pa.string())), ("spans", pair)])
    names = [c for c in docs.columns if c != into]

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        scanner = Scanner(items)

        def one(body: str | None, old: dict | None) -> dict:
            words = words_of(body)
            hits, seen = scanner(words)
            if old:
                hits = merged(hits + [(x["start"], x["end"]) for x in old["hit"]])
                seen |= set(old["items"])
            where = [m.span() for m in _WORD.finditer(body)] if hits else []
            return {"n_words": len(words), "hit": [{"start": a, "end": b} for a, b in hits], "items": sorted(seen),
                    "spans": [{"start": where[a][0], "end": where[b - 1][1]} for a, b in hits]}

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            olds = [None] * len(texts) if first else batch.column(batch.schema.get_field_index(into)).to_pylist()
            kept = [batch.column(batch.schema.get_field_index(c)) for c in names]
            return pa.RecordBatch.from_arrays([*kept, pa.array(map(one, texts, olds), kind)], names=[*names, into])

        return step

    pairs = F.expr(f"CAST(NULL AS struct<n_words: bigint, hit: {SPANS}, items: array<string>, spans: {SPANS}>)")
    schema = docs.select(*(f"`{c}`" for c in names)).withColumn(into, pairs).schema
    return docs.mapInArrow(_runner(make), schema)


def _runner(make: Callable) -> Callable:
    def run(batches):
        step = make()
        for batch in batches:
            if batch.num_rows:
                yield step(batch)

    return run


def n_hit(hits: Column) -> Column:
    return F.aggregate(hits["hit"], F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["start"])


def contaminated(hits: Column) -> Column:
    return (n_hit(hits) > 0) & (n_hit(hits) * ONE_IN >= hits["n_words"])


def clean(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """The documents that are not contaminated, unchanged."""
    into = "_".join(["hits", *docs.columns])
    marked = annotate(docs, items, text, into)
    return marked.where(~contaminated(F.col(into))).drop(into)
