"""Duplicate passages by relative Lempel-Ziv parsing, in words.

``parse`` factors a sequence greedily against an indexed reference: at each place the longest stretch that the
reference holds from there on becomes a factor; only factors of ``LENGTH`` words matter, so the index holds runs of that
length. A run that crosses the end of a factor may match elsewhere, so the runs that end behind it are looked up as well.
References of a block are the surroundings (``repeats``) of all documents with smaller ids; every block is indexed.

Null text has no words. Documents without an id come after all others; of rows that repeat an id none is smaller.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from tracegauge.llm.decontaminate import merged
from tracegauge.llm.repeats import Shape, gram_hashes, repeats

LENGTH = 50
GRAM = 20
#: Words whose hashes a worker remembers, and the longest such word.
MEMO_WORDS, MEMO_LENGTH = 300_000, 64


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(word) <= MEMO_LENGTH and len(self) < MEMO_WORDS:
            self[word] = h
        return h


_HASHES = _Hashes()


def word_units(text: str | None) -> np.ndarray:
    words = (text or "").encode().split()
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


SHAPE = Shape(word_units, LENGTH, GRAM)


class Reference:
    """Indexed runs of ``length`` units of the sequences added so far; the first to hold a run stands for it."""

    def __init__(self, length: int):
        self.length = length
        self.index: dict[int, tuple[np.ndarray, int, int]] = {}

    def add(self, seq: np.ndarray, runs: list[tuple[int, int]], name: int) -> None:
        for at, h in runs:
            self.index.setdefault(h, (seq, at, name))

    def parse(self, seq: np.ndarray, runs: list[tuple[int, int]]) -> Iterator[tuple[int, int, int]]:
        """(start, end, name) of the sufficiently long factors; ``runs`` are the (place, hash) pairs to look up, in order."""
        upto = 0
        for at, h in runs:
            if at < upto or (hit := self.index.get(h)) is None:
                continue
            other, there, name = hit
            n = min(len(seq) - at, len(other) - there)
            differ = np.nonzero(seq[at:at + n] != other[there:there + n])[0]
            size = int(differ[0]) if len(differ) else n
            if size >= self.length:
                yield at, at + size, name
                # the boundary: the first run that reaches past this factor
                upto = at + size - self.length + 1


def solve(strings: list[bytes], least: list[int]) -> list[tuple[int, int, int]]:
    seqs = [np.frombuffer(s, np.uint64) for s in strings]
    sizes = np.array([len(s) for s in seqs])
    starts = np.cumsum(np.r_[0, sizes[:-1]])
    h = gram_hashes(np.concatenate(seqs), LENGTH)
    owner = np.repeat(np.arange(len(seqs)), sizes)[:len(h)]
    whole = np.nonzero(np.arange(len(h)) + LENGTH <= (starts + sizes)[owner])[0]
    order = whole[np.argsort(h[whole], kind="stable")]
    same = h[order][1:] == h[order][:-1]
    twice = np.sort(order[np.r_[same, False] | np.r_[False, same]])
    runs: dict[int, list[tuple[int, int]]] = {}
    for i, at, v in zip(owner[twice].tolist(), (twice - starts[owner[twice]]).tolist(), h[twice].tolist(), strict=True):
        runs.setdefault(i, []).append((at, v))
    reference, out, waiting = Reference(LENGTH), [], []
    for i in sorted(runs, key=lambda i: (least[i], i)):
        if waiting and least[waiting[0]] < least[i]:
            for j in waiting:
                reference.add(seqs[j], runs[j], least[j])
            waiting = []
        waiting.append(i)  # sequences of one document are no reference for each other
        out += ((i, a, b) for a, b, _ in reference.parse(seqs[i], runs[i]))
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_words, n_removed, spans, kept): maximal removed word runs, and the words that remain, joined by one space."""
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            sizes, removed, spans, kept = [], [], [], []
            for body, whole, found in zip(*(c.to_pylist() for c in b.columns[1:]), strict=True):
                words = body.encode().split()
                gone = [(0, len(words))] if whole and len(words) >= LENGTH else [] if whole or not found else merged([(f["start"], f["end"]) for f in found])
                at, rest = 0, []
                for lo, hi in gone:
                    rest += words[at:lo]
                    at = hi
                rest += words[at:]
                sizes.append(len(words))
                removed.append(sum(hi - lo for lo, hi in gone))
                spans.append([{"start": lo, "end": hi} for lo, hi in gone])
                kept.append(b" ".join(rest).decode())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, span), pa.array(kept, pa.string())],
                names=[id_col, "n_words", "n_removed", "spans", "kept"])

    schema = f"`{id_col}` {kind}, n_words bigint, n_removed bigint, spans array<struct<start: bigint, end: bigint>>, kept string"
    return repeats(docs, SHAPE, solve, id_col, text).mapInArrow(run, schema)
