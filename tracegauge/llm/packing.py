"""Best-fit packing of token sequences: a configuration linear program over the histogram of lengths.

Documents are tokenized once; pieces longer than a sequence are cut. The program asks for the fewest
sequences such that the chosen configurations (multisets of lengths that fit together) hold every piece.
Multiplicative weights price the lengths, a knapsack dynamic program finds the best configuration at
those prices, and the averaged solution is rounded down; what is left over goes through the same rounds
and at last into the tightest open sequence. All of that sees the histogram only, of at most ``CAPACITY`` rows.

Pieces find their places without a global sort: every piece has a number within its (task, length), a prefix
sum over tasks makes it a rank within its length, and the plan maps (length, rank) to sequence and offset by
arithmetic. So a length that a third of all pieces have stays spread over all tasks.

Null text counts as empty (one end token). Ids may be null or repeated; each row is packed.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracegauge.llm.common import materialize

CAPACITY = 2048
END = 0
VOCABULARY = "word_bpe_49k.json"
#: Distinct words whose ids a worker remembers, and the longest such word.
MEMO_WORDS, MEMO_LENGTH = 600_000, 48
ITERATIONS = (160, 60, 30)
#: The step of the price updates, and what larger pieces are worth beyond their share of a sequence.
ETA, LARGE = 0.01, 0.3


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


@lru_cache(maxsize=2)
def _tokenizer(vocabulary: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary)


def _byte_letters() -> dict[int, str]:
    """The vocabulary's letter for every byte: printable Latin-1 stands for itself, the rest follows from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder(dict):
    """Text -> little-endian 32-bit ids. White space separates tokens in this vocabulary, so words are encoded alone and remembered.

    A word of letters below U+0250, perhaps with a full stop or comma behind it, needs no normalizing but
    lower case and no splitting: the tokenizer's merge model alone gives its ids. Any other word takes the whole tokenizer.
    """

    def __init__(self, vocabulary: str):
        self.tokenizer = _tokenizer(vocabulary)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()

    def __missing__(self, word: str) -> bytes:
        core = word[:-1] if word[-1:] in (".", ",") else word
        if core.isalpha() and max(core) < "\u0250" and "\u0130" not in core:
            low = core.lower()
            if len(core) < len(word):
                ids = self[low] + self[word[-1]]
            elif low != word:
                return self[low]
            else:
                form = low if low.isascii() else low.encode().decode("latin-1").translate(self.letters)
                ids = np.array([t.id for t in self.model.tokenize(form)], "<u4").tobytes()
        else:
            ids = np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        if len(word) <= MEMO_LENGTH and len(self) < MEMO_WORDS:
            self[word] = ids
        return ids

    def __call__(self, text: str | None) -> bytes:
        words = (text or "").replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        return b"".join(map(self.__getitem__, words))


@lru_cache(maxsize=2)
def encoder(vocabulary: str) -> Encoder:
    """One per worker process, so that tasks share what it remembers."""
    return Encoder(vocabulary)


PIECES = "piece int, start bigint, length bigint, ids_crc32 bigint, task int, number bigint"


def pieces(docs: DataFrame, id_col: str = "doc_id", text: str = "text", capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """Tokenize and cut: one row per piece, numbered within its task and length."""
    vocabulary = vocabulary or default_vocabulary()
    end = np.array([END], "<u4").tobytes()
    step = capacity * 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = encoder(vocabulary), TaskContext.get().partitionId()
        seen = [0] * (capacity + 1)
        for batch in batches:
            row, cut = [], []
            for r, body in enumerate(batch.column(1).to_pylist()):
                ids = encode(body) + end
                for p, at in enumerate(range(0, len(ids), step)):
                    part = ids[at:at + step]
                    n = len(part) // 4
                    row.append(r)
                    cut.append((p, at // 4, n, zlib.crc32(part), task, seen[n]))
                    seen[n] += 1
            if row:
                types = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
                cols = [pa.array(c, t) for c, t in zip(zip(*cut, strict=True), types, strict=True)]
                names = [batch.schema.names[0], "piece", "start", "length", "ids_crc32", "task", "number"]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), *cols], names=names)

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return docs.select(id_col, text).mapInArrow(run, f"`{id_col}` {kind}, {PIECES}")


# --- the linear program --------------------------------------------------------------------------

Config = tuple[tuple[int, int], ...]


def knapsack(lengths: np.ndarray, values: np.ndarray, capacity: int) -> Counter:
    """The most valuable multiset of lengths that fits: a dynamic program over the filled space."""
    best = np.zeros(capacity + 1)
    pick = np.full(capacity + 1, -1)
    ends = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for c in range(int(lengths[0]), capacity + 1):
        k = ends[c]
        gain = values[:k] + best[c - lengths[:k]]
        i = int(gain.argmax())
        if gain[i] > best[c - 1]:
            best[c], pick[c] = gain[i], i
        else:
            best[c] = best[c - 1]
    out: Counter = Counter()
    c = capacity
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            out[int(lengths[pick[c]])] += 1
            c -= int(lengths[pick[c]])
    return out


def fractional(need: dict[int, int], capacity: int, iterations: int) -> dict[Config, float]:
    """Multiplicative weights for the covering program: lengths that are covered less cost more in the next pricing."""
    lengths = np.array(sorted(need))
    want = np.array([need[int(x)] for x in lengths], float)
    index = {int(x): i for i, x in enumerate(lengths)}
    covered = np.zeros(len(lengths))
    used: Counter = Counter()
    for _ in range(iterations):
        values = lengths / capacity * (1 + LARGE * lengths / capacity) * np.exp(-ETA * (covered - covered.mean()) / max(covered.std(), 1e-12))
        config = knapsack(lengths, values, capacity)
        config = Counter({x: min(n, need[x]) for x, n in config.items()})
        row = np.zeros(len(lengths))
        for x, n in config.items():
            row[index[x]] = n
        size = float((want[row > 0] / row[row > 0]).min())
        used[tuple(sorted(config.items(), reverse=True))] += size
        covered += row * size / want
    scale = max(float(covered.mean()), 1e-12)
    return {c: x / scale for c, x in used.items()}


def plan(histogram: dict[int, int], capacity: int = CAPACITY, iterations: tuple[int, ...] = ITERATIONS) -> list[tuple[Config, int]]:
    """Configurations and how often each is used; together they hold the histogram exactly."""
    left = Counter({x: n for x, n in histogram.items() if n})
    out: list[tuple[Config, int]] = []
    for rounds in iterations:
        if sum(left.values()) <= len(left):
            break  # too few of each length for a fraction to round to anything
        for config, amount in sorted(fractional(left, capacity, rounds).items(), key=lambda x: (-sum(a * b for a, b in x[0]), -x[1])):
            times = min(int(amount), *(left[x] // n for x, n in config))
            if times > 0:
                out.append((config, times))
                for x, n in config:
                    left[x] -= n * times
        left = +left
    return out + best_fit(left, capacity)


def best_fit(left: Counter, capacity: int) -> list[tuple[Config, int]]:
    """Longest first, each into the open sequence with the least room that holds it; equal sequences move together."""
    room: dict[int, Counter] = {}
    for x in sorted(left, reverse=True):
        k = left[x]
        while k:
            r = min((r for r in room if r >= x), default=0)
            if not r:
                r, group, bins = capacity, (), k
            else:
                group, bins = next(iter(room[r].items()))
            each = min(r // x, k)
            moved = min(bins, k // each)
            if r < capacity or group:
                room[r][group] -= moved
                if not room[r][group]:
                    del room[r][group]
                if not room[r]:
                    del room[r]
            room.setdefault(r - x * each, Counter())[(*group, (x, each))] += moved
            k -= moved * each
    return [(c, n) for groups in room.values() for c, n in groups.items()]


def places(configs: list[tuple[Config, int]]) -> tuple[np.ndarray, ...]:
    """Blocks of consecutive ranks of a length: (length, first rank), pieces per sequence, first sequence, offset of the first piece."""
    rows, taken, base = [], Counter(), 0
    for config, times in configs:
        offset = 0
        for x, n in config:
            rows.append((x, taken[x], n, base, offset))
            taken[x] += n * times
            offset += x * n
        base += times
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 5)
    return (table[:, 0] << 44) + table[:, 1], table[:, 1], table[:, 2], table[:, 3], table[:, 4]


def pack(docs: DataFrame, id_col: str = "doc_id", text: str = "text", capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """One row per piece with its sequence and its offset there."""
    cut = materialize(pieces(docs, id_col, text, capacity, vocabulary), "pieces")
    counts = materialize(cut.groupBy("task", "length").agg(F.count("*").alias("n")), "lengths")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    key, first, each, base, offset = places(plan(histogram, capacity))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            length, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            i = np.searchsorted(key, (length << 44) + rank, side="right") - 1
            copy, slot = np.divmod(rank - first[i], each[i])
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:5], pa.array(base[i] + copy), pa.array(offset[i] + slot * length)], names=[*b.schema.names[:5], "sequence_id", "offset"])

    ranked = cut.join(starts, ["task", "length"]).select(
        F.col(id_col), "piece", "start", "length", "ids_crc32", (F.col("number") + F.col("before")).alias("rank"))
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return ranked.mapInArrow(run, f"`{id_col}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
