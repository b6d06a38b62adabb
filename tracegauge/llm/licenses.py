"""Licence notices in text, found with a bounded number of edits.

A notice of *k* allowed edits is cut into *k + 1* pieces: by the pigeonhole principle one of them stands
unedited in every match, so exact searches for the pieces locate all candidates. The ``regex`` library's
bounded-error matching then decides each candidate window and gives its span and its edits.

Texts are compared as words (ASCII letters and digits and all non-ASCII, A-Z lower-cased) joined by one
space. Null or wordless text has no words and no matches; ids may be null or repeated, each row is judged alone.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tracegauge.llm.common import WORDS, map_batches


@dataclass(frozen=True)
class Notice:
    phrase: str
    label: str
    edits: int
    #: Exact places of base phrases are counted and listed.
    base: bool = False


NOTICES = (
    Notice("mit license", "mit", 1, base=True),
    Notice("apache license", "apache", 1, base=True),
    Notice("general public license", "gpl", 2, base=True),
    Notice("permission is hereby granted free of charge to any person obtaining a copy", "mit", 7),
    Notice("you may not use this file except in compliance with the license", "apache", 6),
    Notice("this program is free software you can redistribute it and or modify it", "gpl", 7),
    Notice("lesser general public license", "lgpl", 3),
    Notice("affero general public license", "agpl", 3),
    Notice("mozilla public license", "mpl", 2),
    Notice("redistribution and use in source and binary forms", "bsd", 5),
    Notice("bsd license", "bsd", 1),
    Notice("licensed under cc by nc", "cc-by-nc", 2),
    Notice("licensed under cc by sa", "cc-by-sa", 2),
    Notice("licensed under cc by 4 0", "cc-by", 2),
    Notice("creative commons attribution", "cc", 3),
    Notice("all rights reserved", "reserved", 2),
)

MATCH = "array<struct<label: string, base: boolean, first_word: bigint, last_word: bigint, start: bigint, end: bigint, edits: int>>"
SCHEMA = f"n_words bigint, base_words array<bigint>, base_labels array<string>, matches {MATCH}, score double"
_WORD_ANY_CASE = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


class _Searcher:
    def __init__(self, notices: tuple[Notice, ...]):
        self.plans = []
        for n in notices:
            body = n.phrase.encode()
            cuts = [round(i * len(body) / (n.edits + 1)) for i in range(n.edits + 2)]
            seeds = [(body[a:b], a) for a, b in zip(cuts, cuts[1:], strict=False)]
            fuzzy = regex.compile(rf"(?<= )(?:{regex.escape(n.phrase, literal_spaces=True)}){{e<={n.edits}}}(?= )", regex.BESTMATCH)
            self.plans.append((n, body, seeds, fuzzy))

    def __call__(self, text: str | None) -> tuple[int, list[int], list[str], list[dict], float]:
        words = (text or "").encode().translate(WORDS).split()
        line = b" " + b" ".join(words) + b" "
        exact: list[tuple[int, str]] = []
        found = []
        for n, body, seeds, fuzzy in self.plans:
            starts: set[int] = set()
            for seed, offset in seeds:
                at = line.find(seed)
                while at >= 0:
                    starts.add(at - offset)
                    at = line.find(seed, at + 1)
            if not starts:
                continue
            if n.base:
                exact += ((s, n.label) for s in starts if s > 0 and line.startswith(b" " + body + b" ", s - 1))
            done = 0
            for lo, hi in _windows(starts, len(body), n.edits):
                if hi <= done:
                    continue
                lo, hi = max(lo, done), min(len(line), hi)
                # whole words only, so that no character is cut
                lo, hi = line.rfind(b" ", 0, lo + 1), line.find(b" ", max(0, hi - 1)) + 1
                m = fuzzy.search(window := line[lo:hi].decode())
                if m is None:
                    continue
                done = lo + len(window[:m.end()].encode())
                first = line.count(b" ", 0, lo) + window.count(" ", 0, m.start()) - 1
                last = first + window.count(" ", m.start(), m.end())
                edits = sum(m.fuzzy_counts)
                found.append({"label": n.label, "base": n.base and edits == 0, "first_word": first, "last_word": last,
                              "edits": edits, "score": 1 - edits / len(n.phrase)})
        if found:
            spans = [m.span() for m in _WORD_ANY_CASE.finditer(text)]
            for m in found:
                m["start"], m["end"] = spans[m["first_word"]][0], spans[m["last_word"]][1]
            found.sort(key=lambda m: (m["first_word"], m["last_word"], m["label"]))
        return (len(words), sorted(line.count(b" ", 0, s) - 1 for s, _ in exact), sorted({x for _, x in exact}), found,
                max((m["score"] for m in found), default=0.0))


def _windows(starts: set[int], length: int, edits: int) -> Iterator[tuple[int, int]]:
    """A window around each candidate, from left to right: any match of its seed lies inside, however the edits fall.

    The best match of a window is taken and the search goes on behind it, so two notices next to each other both come
    back, and a text of nothing but notices costs one short search each.
    """
    for s in sorted(starts):
        yield s - 2 * edits - 1, s + length + 2 * edits + 1


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text", notices: tuple[Notice, ...] = NOTICES) -> DataFrame:
    """One row per row of ``docs``: id, number of words, places (first words) of exact base phrases, every match with its span."""

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        search = _Searcher(notices)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            n, places, labels, matches, scores = zip(*map(search, batch.column(1).to_pylist()), strict=True)
            keys = ("label", "base", "first_word", "last_word", "start", "end", "edits")
            kinds = (pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
            match = pa.list_(pa.struct(list(zip(keys, kinds, strict=True))))
            return pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(n, pa.int64()), pa.array(places, pa.list_(pa.int64())), pa.array(labels, pa.list_(pa.string())),
                pa.array([[{k: m[k] for k in keys} for m in ms] for ms in matches], match), pa.array(scores, pa.float64()),
            ], names=[batch.schema.names[0], "n_words", "base_words", "base_labels", "matches", "score"])

        return step

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return map_batches(docs.select(id_col, text), make, f"`{id_col}` {kind}, {SCHEMA}")
