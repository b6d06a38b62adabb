"""SimHash near-duplicates by multi-index hashing.

A fingerprint's bit is the majority of that bit over the XXH64 hashes of the text's word shingles. Two
fingerprints within ``RADIUS`` = 3 bits differ in at most one bit in one of their two 32-bit segments, so each
fingerprint stands in a table under both segment values, and looks up the Hamming ball of radius one around
each. Only the half of the ball that clears a bit is looked up: of two values one bit apart, one has that bit.
Complete distances are then verified.

Equal fingerprints are one entry, so groups of exact copies cost one. A segment value under which more than
``HOT`` entries meet is divided once more, by the same method over the two 16-bit quarters of the other segment
(distance 3 or less leaves one quarter with one or none); such a table place holds at most 65,536 values.
Within a place entries are linked into stars, not pairs; components of the links follow.

Null text counts as empty (fingerprint zero, linked like any other); null ids never name a component unless
all ids in it are null; repeated rows are linked like copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracegauge.llm.common import LOWER, map_batches, materialize, partitions
from tracegauge.llm.components import components

SHINGLE = 3
RADIUS = 3
SEED = 42
#: Entries of one table place that are compared at once; beyond it the place is divided (nothing is dropped).
HOT = 4096
_LANES = np.uint64(0x0101010101010101)


def shingle_hashes(text: str | None, width: int = SHINGLE) -> np.ndarray:
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    line, ends, at = b" ".join(words), [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends[:-1])]
    digest = xxhash.xxh64_intdigest
    n = max(1, len(words) - width + 1)
    last = ends[width - 1:] if len(words) >= width else ends[-1:]
    return np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts[:n], last, strict=True)), np.uint64, n)


def majority(h: np.ndarray) -> int:
    """Bits set in over half of the hashes. Bits of like rank in their byte are counted eight at a time."""
    if not len(h):
        return 0
    counts = np.zeros((8, 8), np.int64)  # place in the byte, byte
    rows = -(-len(h) // 255)
    padded = np.zeros(rows * 255, np.uint64)
    padded[:len(h)] = h
    for k in range(8):
        sums = ((padded >> np.uint64(k)) & _LANES).reshape(rows, 255).sum(axis=1, dtype=np.uint64)
        counts[k] = sums.astype("<u8").view(np.uint8).reshape(rows, 8).sum(axis=0, dtype=np.int64)
    return sum(1 << (8 * byte + k) for k in range(8) for byte in range(8) if 2 * counts[k, byte] > len(h))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, key, fp): one row per row of ``docs``; ``key`` is a hash of the text, ``fp`` the fingerprint as a signed long."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            memo: dict[bytes, int] = {}
            values = []
            for key, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if key not in memo:
                    memo[key] = majority(shingle_hashes(t))
                values.append(memo[key])
            fp = pa.array(np.array(values, np.uint64).view(np.int64))
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), fp], names=[batch.schema.names[0], "key", "fp"])

        return step

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    rows = docs.select(F.col(id_col), text_key(F.col(text)).alias("key"), F.col(text))
    return map_batches(rows, make, f"`{id_col}` {kind}, key binary, fp bigint")


def text_key(text):
    """A 128-bit name of the text."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


# --- the tables ----------------------------------------------------------------------------------
#
# A place is a 64-bit value: segment number in the top bit's stead, then the segment. ``home`` marks the entry
# whose own value this is; others look it up from one bit away. Links are found between homes, and between
# homes and visitors.

_BITS32 = [1 << i for i in range(32)]
_BITS16 = [1 << i for i in range(16)]


def _seats(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, home) of every fingerprint in the two tables."""
    rows, seats, homes = [], [], []
    everyone = np.arange(len(fps))
    for half, seg in enumerate((fps & np.uint64(0xFFFFFFFF), fps >> np.uint64(32))):
        mark = np.uint64(half << 32)
        rows.append(everyone)
        seats.append(seg | mark)
        homes.append(np.ones(len(fps), bool))
        for bit in _BITS32:
            has = np.nonzero(seg & np.uint64(bit))[0]
            rows.append(has)
            seats.append((seg[has] ^ np.uint64(bit)) | mark)
            homes.append(np.zeros(len(has), bool))
    return np.concatenate(rows), np.concatenate(seats).view(np.int64), np.concatenate(homes)


def _finer(fps: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, finer place, home) of the members of hot places: the quarters of their other segment, with one bit cleared or none."""
    half = (place >> np.int64(32)) & np.int64(1)
    other = np.where(half == 0, fps >> np.uint64(32), fps & np.uint64(0xFFFFFFFF))
    rows, seats, homes = [], [], []
    everyone = np.arange(len(fps))
    for quarter in range(2):
        q = (other >> np.uint64(16 * quarter)) & np.uint64(0xFFFF)
        mark = quarter << 16
        rows.append(everyone)
        seats.append(q.astype(np.int64) | mark)
        homes.append(np.ones(len(fps), bool))
        for bit in _BITS16:
            has = np.nonzero(q & np.uint64(bit))[0]
            rows.append(has)
            seats.append((q[has] ^ np.uint64(bit)).astype(np.int64) | mark)
            homes.append(np.zeros(len(has), bool))
    return np.concatenate(rows), np.concatenate(seats), np.concatenate(homes)


def _stars(fps: np.ndarray, home: np.ndarray) -> list[tuple[int, int]]:
    """Links of one place: every pair of a home and another entry within the radius, thinned to a spanning forest."""
    order = np.argsort(~home, kind="stable")
    fps, n_home = fps[order], int(home.sum())
    if n_home == 0 or len(fps) < 2:
        return []
    parent = list(range(len(fps)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for i in range(n_home):
        near = np.nonzero(np.bitwise_count(fps[i + 1:] ^ fps[i]) <= RADIUS)[0] + i + 1
        for j in near.tolist():
            a, b = root(i), root(j)
            if a != b:
                parent[b] = a
                if fps[i] != fps[j]:
                    out.append((int(fps[i]), int(fps[j])))
    return out


def _link_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by place (columns place, finer, fp, home): links of each (place, finer)."""
    held: list[np.ndarray] = []

    def solve(t: np.ndarray) -> list[tuple[int, int]]:
        cut = np.nonzero((t[1:, 0] != t[:-1, 0]) | (t[1:, 1] != t[:-1, 1]))[0] + 1
        bounds = np.r_[0, cut, len(t)]
        sizes = np.diff(bounds)
        links = []
        for k in np.nonzero(sizes > 1)[0]:
            g = t[bounds[k]:bounds[k + 1]]
            if g[:, 3].any():
                links += _stars(g[:, 2].copy().view(np.uint64), g[:, 3].astype(bool))
        return links

    def batch_of(links: list[tuple[int, int]]) -> pa.RecordBatch:
        pairs = np.array(links, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["x", "y"])

    for b in batches:
        if not b.num_rows:
            continue
        t = np.column_stack([c.cast(pa.int64()).to_numpy(zero_copy_only=False) for c in b.columns])
        if held:
            t = np.concatenate([*held, t])
        # the last group may go on in the next batch
        tail = int(np.nonzero((t[:, 0] != t[-1, 0]) | (t[:, 1] != t[-1, 1]))[0].max(initial=-1)) + 1
        held = [t[tail:]]
        if tail and (links := solve(t[:tail])):
            yield batch_of(links)
    if held and (links := solve(held[0])):
        yield batch_of(links)


def near_links(fps: DataFrame) -> DataFrame:
    """(x, y): links between distinct fingerprints (column fp) that connect all pairs within the radius."""
    spark = fps.sparkSession
    n = partitions(spark)

    def seat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = b.column(0).to_numpy().view(np.uint64)
            for lo in range(0, len(f), 4096):
                part = f[lo:lo + 4096]
                rows, places, homes = _seats(part)
                yield pa.RecordBatch.from_arrays([pa.array(places), pa.array(part[rows].view(np.int64)), pa.array(homes)], names=["place", "fp", "home"])

    def refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            places, f = b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64)
            homes = b.column(2).to_numpy(zero_copy_only=False)
            for lo in range(0, len(f), 4096):
                p, part, h = places[lo:lo + 4096], f[lo:lo + 4096], homes[lo:lo + 4096]
                rows, finer, own = _finer(part, p)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(p[rows]), pa.array(finer), pa.array(part[rows].view(np.int64)), pa.array(own)], names=["place", "finer", "fp", "home"])

    seats = fps.select("fp").mapInArrow(seat, "place bigint, fp bigint, home boolean")
    # places where many meet, and those that their entries visit; counts are summed before the shuffle
    crowded = (
        fps.select(F.explode(F.array(F.col("fp").bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned("fp", 32).bitwiseOR(1 << 32))).alias("place"))
        .groupBy("place").count().where(F.col("count") > HOT).select("place"))
    hot = materialize(crowded.select(F.explode(F.expr(
        "transform(sequence(-1, 31), i -> if(i < 0, place, place & ~shiftleft(1L, i)))")).alias("place")).distinct(), "hot")
    schema = "place bigint, finer bigint, fp bigint, home boolean"
    link = "x bigint, y bigint"

    def linked(rows: DataFrame) -> DataFrame:
        return rows.repartition(n, "place", "finer").sortWithinPartitions("place", "finer").mapInArrow(_link_groups, link)

    if hot.isEmpty():
        return linked(seats.select("place", F.lit(-1).cast("long").alias("finer"), "fp", "home"))
    cool = seats.join(hot, "place", "left_anti").select("place", F.lit(-1).cast("long").alias("finer"), "fp", "home")
    warm = seats.join(hot, "place", "left_semi").select("place", "fp", "home").mapInArrow(refine, schema)
    return linked(cool.unionByName(warm))


def classes(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, key, fp, component): the component is the smallest id that links of ``RADIUS`` bits or fewer reach."""
    rows = materialize(fingerprints(docs, id_col, text), "fingerprints")
    entries = materialize(rows.groupBy("fp").agg(F.min(id_col).alias("least")), "entries")
    roots = components(near_links(entries).select(F.col("x").alias("a"), F.col("y").alias("b")))
    labelled = entries.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    names = labelled.groupBy("root").agg(F.min("least").alias("component"))
    named = labelled.join(names, "root").select("fp", "root", "component")
    return rows.join(named, "fp", "left").select(id_col, "key", "fp", "root", "component")


def clean(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each component: the smallest id, then the smallest text key; repeated rows of it once."""
    return keep_one(docs, classes(docs, id_col, text), id_col, text)


def keep_one(docs: DataFrame, found: DataFrame, id_col: str, text: str) -> DataFrame:
    """The chosen document of each root in ``found`` (id, key, root)."""
    return keep_chosen(docs, chosen_rows(found, id_col), id_col, text)


def chosen_rows(found: DataFrame, id_col: str) -> DataFrame:
    """(kept_id, kept_key) of each root: the smallest id, nulls last, then the smallest key."""
    chosen = found.groupBy("root").agg(F.min(F.struct(F.col(id_col).isNull().alias("n"), F.col(id_col).alias("i"), F.col("key").alias("k"))).alias("s"))
    return chosen.select(F.col("s.i").alias("kept_id"), F.col("s.k").alias("kept_key"))


def keep_chosen(docs: DataFrame, kept: DataFrame, id_col: str, text: str) -> DataFrame:
    key = "_".join(["key", *docs.columns])
    marked = docs.withColumn(key, text_key(F.col(text)))
    joined = marked.join(kept, F.col(id_col).eqNullSafe(F.col("kept_id")) & (F.col(key) == F.col("kept_key")), "left_semi")
    return joined.dropDuplicates([id_col, key]).select(*(f"`{c}`" for c in docs.columns))
