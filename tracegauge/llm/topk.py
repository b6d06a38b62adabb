"""Exact top-k inner products by a three-phase uniform threshold over dimension blocks.

A vector's score for a query is the sum of its partial scores in ``BLOCKS`` blocks of dimensions. A task sees one block
only: a cell holds that block of some candidates and of some queries.

1. Every cell lists the best partial scores of each query; the lists of a block are merged. The full scores of what they
   name give each query a cutoff: its k-th best score so far, which the final k-th best cannot be below.
2. The cutoff goes to all cells. A vector that reaches it has a partial score of at least cutoff / BLOCKS in some block,
   so the cells report exactly those entries. The ones that all blocks report are complete and may raise the cutoff;
   those that cannot reach it, with the most that silent blocks may hold, go.
3. Blocks that were silent about a remaining vector are asked for its partial score, and full scores are ranked.

Equal vectors are one class, as candidate and as query: of a class at most k + 1 ids, the smallest ones, can be among
the answers. Nothing is sampled, capped or estimated; a cell's size is bounded, and their number follows the data.

Rows without an id, and vectors that are null or hold null or non-finite components, take no part. Repeated rows count
once; of an id with several vectors the best score counts. Shorter vectors are as if padded with zeros. Partial
scores beyond +-2^60 count as that. Ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracegauge.llm.common import discard, materialize, partitions
from tracegauge.llm.vectors import integers, matrix, products

BLOCKS = 2
#: Candidates and queries of a cell, at most on the average.
CELL_ROWS, CELL_QUERIES = 1 << 17, 1 << 16
#: Partial scores held at once.
SCORES = 1 << 22
MOST = 1 << 60
_PARTIAL = "q bigint, c bigint, j int, s bigint"


def classes(vectors: DataFrame, k: int, every: int) -> tuple[DataFrame, DataFrame]:
    """(cls, x, ids, asks), one row per distinct vector with its k + 1 smallest ids; and (query_id, cls) of the queries."""
    rows = vectors.where("id is not null").select("id", "x", F.xxhash64("x").alias("h"), F.xxhash64(F.lit(1), "x").alias("h2"))
    names = ["h", "h2"]
    first = Window.partitionBy(*names).orderBy("id")
    ids = rows.select("id", *names).distinct().withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1)
    ids = ids.groupBy(*names).agg(F.array_sort(F.collect_list("id")).alias("ids"))
    asks = F.col("id") % every == 0
    kept = rows.groupBy(*names).agg(F.first("x").alias("x"), F.max(asks).alias("asks")).join(ids, names)
    made = materialize(kept.select(F.monotonically_increasing_id().alias("cls"), *names, "x", "ids", "asks"), "classes")
    queries = rows.where(asks).select(F.col("id").alias("query_id"), *names).distinct().join(made.select("cls", *names), names)
    return made, queries.select("query_id", "cls")


class Cells:
    """The layout: class c lies in row group g(c), query q in group h(q); cell (g, h, j) holds their slices of block j."""

    def __init__(self, made: DataFrame):
        n, q, width = made.agg(F.count("*"), F.count_if("asks"), F.coalesce(F.max(F.size("x")), F.lit(0))).first()
        spread = min(-(-partitions(made.sparkSession) // BLOCKS), -(-n // 64))
        self.made, self.n, self.q = made, n, q
        self.groups, self.sides = max(1, spread, -(-n // CELL_ROWS)), max(1, -(-q // CELL_QUERIES))
        self.width = max(1, -(-width // BLOCKS))

    def _at(self, c: str, q: str, j) -> Column:
        g, h = F.pmod(F.xxhash64(c), F.lit(self.groups)), F.pmod(F.xxhash64(q, F.lit(1)), F.lit(self.sides))
        return ((g * self.sides + h) * BLOCKS + j).cast("int")

    def _slice(self) -> Column:
        return F.expr(f"slice(x, j * {self.width} + 1, {self.width})")

    def ask(self, work: Callable, cuts: DataFrame | None = None, requests: DataFrame | None = None) -> DataFrame:
        """(q, c, j, s) that ``work`` makes of every cell; ``cuts`` (q, cut) and ``requests`` (q, c, j) go to the cells concerned."""
        blocks = F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))).alias("j")
        null = F.lit(None).cast("bigint")
        held = self.made.select("cls", "x", blocks).withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(self.sides - 1))))
        g = F.pmod(F.xxhash64("cls"), F.lit(self.groups))
        cands = held.select(((g * self.sides + F.col("h")) * BLOCKS + F.col("j")).cast("int").alias("cell"), F.lit(0).alias("kind"),
                            F.col("cls").alias("a"), null.alias("b"), self._slice().alias("x"))
        asking = self.made.where("asks").select(F.col("cls").alias("q"), "x")
        asking = asking.withColumn("cut", null) if cuts is None else asking.join(cuts, "q", "left")
        sent = asking.select("q", "x", "cut", blocks).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(self.groups - 1))))
        h = F.pmod(F.xxhash64("q", F.lit(1)), F.lit(self.sides))
        queries = sent.select(((F.col("g") * self.sides + h) * BLOCKS + F.col("j")).cast("int").alias("cell"), F.lit(1).alias("kind"),
                              F.col("q").alias("a"), F.col("cut").alias("b"), self._slice().alias("x"))
        rows = cands.union(queries)
        if requests is not None:
            rows = rows.union(requests.select(self._at("c", "q", F.col("j")).alias("cell"), F.lit(2).alias("kind"),
                                              F.col("q").alias("a"), F.col("c").alias("b"), F.lit(None).cast("array<bigint>").alias("x")))
        placed = rows.repartitionById(self.groups * self.sides * BLOCKS, "cell").sortWithinPartitions("cell", "kind", "a")
        return placed.mapInArrow(_cells(work, self.width), _PARTIAL)


def _cells(work: Callable, width: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, asked = -1, [], []
        for batch in batches:
            where, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.nonzero((np.diff(where) != 0) | (np.diff(kind) != 0))[0] + 1
            for lo, hi in zip(np.r_[0, cuts], np.r_[cuts, len(where)], strict=True):
                part = batch.slice(lo, hi - lo)
                if not part.num_rows:
                    continue
                if where[lo] != cell:
                    cell, held, asked = where[lo], [], []
                if kind[lo] < 2:
                    entry = (part.column(2).to_numpy(), part.column(3), matrix(part.column(4), width))
                    (held if kind[lo] == 0 else asked).append(entry)
                if kind[lo] == 1 and held:
                    held = _joined(held)
                    for q, c, s in work.listed(held[0][0], held[0][2], entry[0], entry[1], entry[2]):
                        yield _rows(q, c, cell % BLOCKS, s)
                    if not work.replies:
                        asked = []
                if kind[lo] == 2:
                    asked = _joined(asked)
                    q, c = part.column(2).to_numpy(), part.column(3).to_numpy()
                    s = work.replied(held[0][0], held[0][2], asked[0][0], asked[0][2], c, q)
                    yield _rows(q, c, cell % BLOCKS, s)

    return run


def _joined(entries: list[tuple]) -> list[tuple]:
    """One entry (ids, cutoffs, rows) of several; ids arrive in order."""
    if len(entries) == 1:
        return entries
    return [(np.concatenate([e[0] for e in entries]), None, np.concatenate([e[2] for e in entries]))]


def _rows(q: np.ndarray, c: np.ndarray, j: int, s: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(q), pa.array(c), pa.array(np.full(len(q), j, np.int32)), pa.array(s)], names=["q", "c", "j", "s"])


class Best:
    """Phase 1: the ``k`` best partial scores of each query."""

    replies = False

    def __init__(self, k: int):
        self.k = k

    def listed(self, ids, held, q_ids, _cut, asked):
        step = max(1, SCORES // len(ids))
        for lo in range(0, len(q_ids), step):
            s = products(asked[lo:lo + step], held.T, MOST)
            top = np.argpartition(s, -self.k, axis=1)[:, -self.k:] if s.shape[1] > self.k else np.broadcast_to(np.arange(s.shape[1]), s.shape)
            yield np.repeat(q_ids[lo:lo + step], top.shape[1]), ids[top.ravel()], np.take_along_axis(s, top, axis=1).ravel()


class Reaching:
    """Phase 2: the entries whose partial score is at least the cutoff's share; all of a query without a cutoff."""

    replies = False

    def listed(self, ids, held, q_ids, cut, asked):
        step = max(1, SCORES // len(ids))
        # the least partial score that, times BLOCKS, reaches the cutoff
        least = np.array([-MOST if x is None else -(-x // BLOCKS) for x in cut.to_pylist()], np.int64)
        for lo in range(0, len(q_ids), step):
            s = products(asked[lo:lo + step], held.T, MOST)
            q, c = np.nonzero(s >= least[lo:lo + step, None])
            yield q_ids[lo:lo + step][q], ids[c], s[q, c]


class Replying:
    """Phase 3: the partial scores of the pairs asked for."""

    replies = True

    def listed(self, *_):
        return ()

    def replied(self, ids, held, q_ids, asked, c, q):
        out = np.empty(len(c), np.int64)
        a, b = np.searchsorted(q_ids, q), np.searchsorted(ids, c)
        step = max(1, SCORES // held.shape[1])
        for lo in range(0, len(c), step):
            x, y = asked[a[lo:lo + step]], held[b[lo:lo + step]]
            big = float(np.abs(x).max(initial=0)) * float(np.abs(y).max(initial=0)) * x.shape[1] >= MOST
            s = (x.astype(object) * y.astype(object)).sum(axis=1) if big else (x * y).sum(axis=1)
            out[lo:lo + step] = np.clip(s, -MOST, MOST).astype(np.int64)
        return out


def known(entries: DataFrame) -> DataFrame:
    """(q, c, s, seen): the sum of the reported partial scores, and the blocks that reported."""
    return entries.groupBy("q", "c").agg(F.sum("s").alias("s"), F.collect_set("j").alias("seen"))


def complete(cells: Cells, parts: DataFrame) -> DataFrame:
    """(q, c, s) with the full scores of ``known`` rows (a written table): silent blocks are asked."""
    every = F.array(*map(F.lit, range(BLOCKS)))
    requests = parts.select("q", "c", F.explode(F.array_except(every, "seen")).alias("j"))
    replies = cells.ask(Replying(), requests=requests)
    return parts.select("q", "c", "s").union(replies.select("q", "c", "s")).groupBy("q", "c").agg(F.sum("s").alias("s"))


def ranked(cells: Cells, exact: DataFrame, k: int) -> DataFrame:
    """(q, vec_id, s, rank): the ``k`` best ids of each query among the exact rows."""
    named = exact.join(cells.made.select(F.col("cls").alias("c"), "ids"), "c").select("q", F.explode("ids").alias("vec_id"), "s")
    best = named.groupBy("q", "vec_id").agg(F.max("s").alias("s"))
    order = Window.partitionBy("q").orderBy(F.desc("s"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def cutoffs(cells: Cells, exact: DataFrame, k: int) -> DataFrame:
    """(q, cut): the k-th best score; null where fewer ids are known."""
    return ranked(cells, exact, k).groupBy("q").agg(F.max(F.when(F.col("rank") == k, F.col("s"))).alias("cut"))


def search(rows: DataFrame, k: int = 10, every: int = 100, scale: int = 1024, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best other ids of every row whose id is divisible by ``every``."""
    made, queries = classes(integers(rows, id_col, vector, scale), k, every)
    cells, most = Cells(made), k + 1  # one more, since a query's own id is left out only at the end
    best = Window.partitionBy("q", "j").orderBy(F.desc("s"), "c")
    lists = cells.ask(Best(most)).withColumn("r", F.row_number().over(best)).where(F.col("r") <= most)
    first = materialize(known(lists), "lists")
    sure = materialize(complete(cells, first), "sure")
    cuts = materialize(cutoffs(cells, sure, most), "cuts")
    reported = materialize(known(cells.ask(Reaching(), cuts)), "reported")
    whole = reported.where(F.size("seen") == BLOCKS).select("q", "c", "s")
    higher = materialize(cutoffs(cells, sure.union(whole), most).withColumnRenamed("cut", "higher"), "higher")
    silent = F.lit(BLOCKS) - F.size("seen")
    reach = F.col("s") + silent * F.expr(f"(cut - 1 - pmod(cut - 1, {BLOCKS})) div {BLOCKS}")
    limits = cuts.join(higher, "q")
    partly = reported.where(F.size("seen") < BLOCKS).join(limits, "q").where(reach >= F.col("higher")).select("q", "c", "s", "seen")
    left = materialize(partly, "left")
    found = whole.union(complete(cells, left))
    answers = materialize(ranked(cells, found, most).select("q", "vec_id", "s"), "answers")
    discard(first, sure, cuts, reported, higher, left)
    pairs = queries.withColumnRenamed("cls", "q").join(answers, "q").where("query_id <> vec_id")
    scores = pairs.groupBy("query_id", "vec_id").agg(F.max("s").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
