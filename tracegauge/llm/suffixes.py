"""Long repeated byte strings by an enhanced suffix array.

``maximal_repeats`` sorts the suffixes of a block of strings, scans the common-prefix lengths with a stack
(the intervals form a tree), and outputs every interval of at least the wanted depth whose occurrences differ in the
character on their left: those groups of occurrences that can be extended neither way, each with all its
occurrences, not just neighbours in the array. ``remove_repeats`` runs it over the surroundings that may hold repeats
(``repeats``) and takes out every byte of a document that a string of ``LENGTH`` bytes from a document with a smaller id covers.

Null text counts as empty. Documents without an id come after all others; of rows that repeat an id none is
smaller than the other. Texts are judged as UTF-8 bytes; what remains may cut a character and is binary.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tracegauge.llm.decontaminate import merged
from tracegauge.llm.repeats import Shape, covered, gram_hashes, repeats

LENGTH = 50
GRAM = 16
SHAPE = Shape(lambda text: np.frombuffer((text or "").encode(), np.uint8), LENGTH, GRAM)


def repeat_intervals(strings: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(owner, offset, depth, first, last, sizes): the suffix array's string numbers and offsets, and its left-diverse intervals.

    Only suffixes whose first ``length`` bytes stand twice are in the array. They come in classes by the hash of those
    bytes; within a class they are in order of what follows, which is all that has to be compared.
    """
    sizes = np.array([len(s) for s in strings], np.int64)
    none = np.zeros(0, np.int64)
    if not len(sizes) or sizes.max() < length:
        return none, none, none, none, none, sizes
    text = np.frombuffer(b"".join(strings), np.uint8)
    starts = np.cumsum(np.r_[0, sizes[:-1]])
    owner = np.repeat(np.arange(len(strings)), sizes)
    room = np.repeat(starts + sizes, sizes) - np.arange(len(text))
    h = gram_hashes(text, length)
    whole = np.nonzero(room[:len(h)] >= length)[0]
    order = whole[np.argsort(h[whole], kind="stable")]
    cls = h[order]
    heads = np.r_[0, np.nonzero(cls[1:] != cls[:-1])[0] + 1] if len(order) else none
    # the byte on the left; a string's first byte has a left of its own. If all lefts are equal in a class, so they are
    # in every interval inside: only the other classes are sorted
    left = np.where(order > starts[owner[order]], text[order - 1].astype(np.int64), 256 + np.arange(len(order)))
    kept = np.minimum.reduceat(left, heads) != np.maximum.reduceat(left, heads) if len(order) else np.zeros(0, bool)
    n = np.diff(np.r_[heads, len(order)])
    held = np.repeat(kept, n)
    suffix, left, n = order[held], left[held], n[kept]
    if not len(suffix):
        return none, none, none, none, none, sizes
    heads = np.cumsum(np.r_[0, n[:-1]])
    ends = heads + n
    rest = room[suffix] - length
    width = int(rest.max())
    width += -width % 8 or (8 if not width else 0)
    padded = np.r_[text, np.zeros(width + length, np.uint8)]
    table = np.lib.stride_tricks.sliding_window_view(padded, width)[suffix + length]
    table[np.arange(width) >= rest[:, None]] = 0
    # the order of two suffixes does not matter
    many = np.nonzero(np.repeat(n > 2, n))[0]
    words = table[many].view(">u8").astype(np.uint64)
    array = np.arange(len(suffix))
    array[many] = many[np.lexsort((rest[many], *words.T[::-1], np.repeat(np.arange(len(n)), n)[many]))]
    suffix, left, table, rest = suffix[array], left[array], table[array], rest[array]
    differ = table[1:] != table[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    common = np.minimum(common, np.minimum(rest[1:], rest[:-1])) + length
    two = n == 2  # such a class is one interval
    depth, first, last = [common[heads[two]]], [heads[two]], [heads[two] + 1]
    more = []
    for lo, hi in zip(heads[~two].tolist(), ends[~two].tolist(), strict=True):
        more += [(d, lo + a, lo + b) for d, a, b in _intervals(common[lo:hi - 1].tolist(), left[lo:hi].tolist())]
    if more:
        for out, column in zip((depth, first, last), np.array(more, np.int64).T, strict=True):
            out.append(column)
    return owner[suffix], suffix - starts[owner[suffix]], *(np.concatenate(x) for x in (depth, first, last)), sizes


def members(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in the array of all members of the intervals, one interval after the other, and the intervals' starts therein."""
    n = last - first + 1
    at = np.cumsum(np.r_[0, n[:-1]])
    return np.repeat(first - at, n) + np.arange(int(n.sum())), at


def maximal_repeats(strings: list[bytes], length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(depth, string numbers, offsets) of every left-diverse group of suffixes that share ``depth`` >= ``length`` bytes and no more."""
    owner, offset, depth, first, last, _ = repeat_intervals(strings, length)
    for d, a, b in zip(depth.tolist(), first.tolist(), last.tolist(), strict=True):
        yield d, owner[a:b + 1], offset[a:b + 1]


def _intervals(common: list[int], left: list[int]) -> Iterator[tuple[int, int, int]]:
    """(depth, first, last) of the common-prefix intervals with more than one left byte; ``left`` -1 stands for several."""
    stack: list[list[int]] = []  # depth, first, left
    for i, depth in enumerate([*common, 0]):
        first, seen = i, left[i]
        while stack and stack[-1][0] > depth:
            d, first, l = stack.pop()
            if l != seen:
                seen = -1
            if seen == -1:
                yield d, first, i
        if stack and stack[-1][0] == depth:
            if stack[-1][2] != seen:
                stack[-1][2] = -1
        elif depth:
            stack.append([depth, first, seen])


def solve(strings: list[bytes], least: list[int]) -> list[tuple[int, int, int]]:
    """Of each string, what its repeats with strings of smaller ids cover: all occurrences of a group but those of its smallest id."""
    owner, offset, depth, first, last, sizes = repeat_intervals(strings, LENGTH)
    if not len(depth):
        return []
    place, at = members(first, last)
    number = owner[place]
    own = np.array(least)[number]
    n = last - first + 1
    later = own > np.repeat(np.minimum.reduceat(own, at), n)
    number, start = number[later], offset[place[later]]
    if not len(number):
        return []
    return covered(np.cumsum(np.r_[0, sizes[:-1]]), int(sizes.sum()), number, start, start + np.repeat(depth, n)[later])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, spans, kept): maximal removed byte runs, and the bytes that remain."""
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            sizes, removed, spans, kept = [], [], [], []
            for body, whole, found in zip(*(c.to_pylist() for c in b.columns[1:]), strict=True):
                raw = body.encode()
                gone = [(0, len(raw))] if whole and len(raw) >= LENGTH else [] if whole or not found else merged([(f["start"], f["end"]) for f in found])
                at, rest = 0, []
                for lo, hi in gone:
                    rest.append(raw[at:lo])
                    at = hi
                rest.append(raw[at:])
                sizes.append(len(raw))
                removed.append(sum(hi - lo for lo, hi in gone))
                spans.append([{"start": lo, "end": hi} for lo, hi in gone])
                kept.append(b"".join(rest))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())],
                names=[id_col, "n_bytes", "n_removed", "spans", "kept"])

    schema = f"`{id_col}` {kind}, n_bytes bigint, n_removed bigint, spans array<struct<start: bigint, end: bigint>>, kept binary"
    return repeats(docs, SHAPE, solve, id_col, text).mapInArrow(run, schema)
