"""Centroid clustering with the dimensions in shards (Lloyd's rounds in exact integers).

The vectors are written once as slices: ``PACK`` rows of one block of ``WIDTH`` dimensions to a record. In a round, tasks on
slices compute partial squared distances to the same slices of the centroids; a record's blocks meet by its key, are
added, and the smallest sum is the assignment. That goes back to the slices, each of which sums its own
columns by cluster; the new centroid slices are the only thing the driver sees (clusters x dimensions numbers).

Vectors of another length than ``dims``, null ones, and those with null or non-finite components take no part. A null id is
assigned, but starts no centroid unless ids are too few; repeated rows count each; equal ids start in the order of their
vectors. Components beyond +-2^27 after scaling count as that, so that distances stay exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracegauge.llm.common import discard, materialize
from tracegauge.llm.vectors import integers

PACK, WIDTH = 256, 16
LIMIT = 1 << 27


def kept(rows: DataFrame, id_col: str, vector: str, scale: int, dims: int) -> DataFrame:
    held = F.transform("x", lambda c: F.greatest(F.least(c, F.lit(LIMIT)), F.lit(-LIMIT)))
    return integers(rows.where(F.size(vector) == dims), id_col, vector, scale).select("id", held.alias("x"))


def starts(x: DataFrame, k: int) -> np.ndarray:
    """The vectors with the ``k`` smallest hashes of ``1:<id>``, in that order.

    Only ids below a hash bound come to the driver: about eight times ``k`` of them, whatever the number of rows. The bound
    rises until enough are below it.
    """
    n = x.count()
    named = x.withColumn("h", F.sha2(F.concat(F.lit("1:"), F.col("id").cast("string")), 256))
    share = 8 * k / max(n, 1)
    while True:
        bound = f"{int(min(1.0, share) * (1 << 52)):013x}" + "0" * 51
        low = named if share >= 1 else named.where(F.col("h") < bound)
        found = low.orderBy(F.col("h").asc_nulls_last(), "x").limit(k).select("x").collect()
        if len(found) == min(k, n) or share >= 1:
            return np.array([r.x for r in found], np.int64)
        share *= 8


def slices(x: DataFrame, dims: int) -> DataFrame:
    """(pack, block, rows, x, ids): ids with block -1, columns of up to ``WIDTH`` dimensions with the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId() << 40, 0
        for b in batches:
            for lo in range(0, b.num_rows, PACK):
                ids = b.column(0).slice(lo, PACK)
                m = b.column(1).slice(lo, PACK).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
                blocks = [np.ascontiguousarray(m[:, a:a + WIDTH]).tobytes() for a in range(0, dims, WIDTH)]
                out = len(blocks) + 1
                named = pa.ListArray.from_arrays(pa.array([0] + [len(ids)] * out, pa.int32()), ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(out, part + at)), pa.array(range(-1, out - 1), pa.int32()), pa.array([len(ids)] * out, pa.int32()),
                     pa.array([None, *blocks], pa.binary()), named], names=["pack", "block", "n", "x", "ids"])
                at += 1

    kind = x.schema["id"].dataType.simpleString()
    return x.mapInArrow(run, f"pack bigint, block int, n int, x binary, ids array<{kind}>")


def assignments(cut: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(pack, cluster, distance): arrays as bytes, one entry per row of the pack; ties go to the smaller number."""
    k = len(centroids)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for pack, block, n, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                own = np.frombuffer(raw, np.int64).reshape(n, -1)
                c = centroids[:, block * WIDTH:(block + 1) * WIDTH]
                d = np.stack([((own - c[i]) ** 2).sum(axis=1) for i in range(k)], axis=1)
                yield pa.RecordBatch.from_arrays([pa.array([pack]), pa.array([d.tobytes()])], names=["pack", "d"])

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, total = None, None

        def done() -> pa.RecordBatch:
            d = total.reshape(-1, k)
            best = d.argmin(axis=1)
            least = np.take_along_axis(d, best[:, None], axis=1)
            return pa.RecordBatch.from_arrays(
                [pa.array([pack]), pa.array([best.astype(np.int32).tobytes()]), pa.array([least.tobytes()])], names=["pack", "cluster", "distance"])

        for b in batches:
            for p, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                d = np.frombuffer(raw.as_buffer(), np.int64)
                if p == pack:
                    total = total + d
                    continue
                if pack is not None:
                    yield done()
                pack, total = p, d
        if pack is not None:
            yield done()

    parts = cut.where("block >= 0").select("pack", "block", "n", "x").mapInArrow(partial, "pack bigint, d binary")
    return parts.repartition("pack").sortWithinPartitions("pack").mapInArrow(nearest, "pack bigint, cluster binary, distance binary")


def updated(cut: DataFrame, assigned: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Every non-empty centroid replaced by the floor of its mean, slice by slice."""
    k = len(centroids)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for block, n, raw, cluster in zip(*(c.to_pylist() for c in b.columns), strict=True):
                own, to = np.frombuffer(raw, np.int64).reshape(n, -1), np.frombuffer(cluster, np.int32)
                part = total.setdefault(block, np.zeros((k, own.shape[1] + 1), np.int64))
                for i in np.unique(to):
                    part[i, :-1] += own[to == i].sum(axis=0)
                    part[i, -1] += int((to == i).sum())
        for block, part in total.items():
            i, j = np.nonzero(np.ones(part.shape, bool))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(i), block, np.int32)), pa.array(i), pa.array(j), pa.array(part.ravel())], names=["block", "i", "j", "s"])

    held = cut.where("block >= 0").join(assigned, "pack").select("block", "n", "x", "cluster")
    out = centroids.copy()
    rows = held.mapInArrow(sums, "block int, i bigint, j bigint, s bigint").groupBy("block", "i", "j").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    table = {(r.block, r.i, r.j): int(r.s) for r in rows}
    for c in range(centroids.shape[1]):
        block, j = divmod(c, WIDTH)
        last = min(WIDTH, centroids.shape[1] - block * WIDTH)
        for i in range(k):
            if count := table.get((block, i, last), 0):
                out[i, c] = table[block, i, j] // count
    return out


def cluster(
    rows: DataFrame, k: int = 16, rounds: int = 3, scale: int = 64, dims: int = 64, id_col: str = "vec_id", vector: str = "embedding",
) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that takes part."""
    spark = rows.sparkSession
    kind = rows.select(id_col).schema[0].dataType.simpleString()
    schema = f"`{id_col}` {kind}, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    x = kept(rows, id_col, vector, scale, dims)
    centroids = starts(x, k)
    if not len(centroids):
        return spark.createDataFrame([], schema)
    cut = materialize(slices(x, dims), "slices")
    for _ in range(rounds):
        assigned = materialize(assignments(cut, centroids), "assigned")
        centroids = updated(cut, assigned, centroids)
        discard(assigned)
    assigned = materialize(assignments(cut, centroids), "assigned")

    def by_cluster(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(centroids), np.int64)
        for b in batches:
            for to, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                np.add.at(total, np.frombuffer(to, np.int32), np.frombuffer(d, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], names=["i", "s"])

    inertia = dict(assigned.select("cluster", "distance").mapInArrow(by_cluster, "i int, s bigint").groupBy("i").agg(F.sum("s")).collect())
    inertias = np.array([inertia.get(i, 0) for i in range(len(centroids))], np.int64)
    whole = int(inertias.sum())
    names = pa.array([hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                ids = b.column(0).slice(r, 1).flatten()
                to, d = np.frombuffer(b.column(1)[r].as_buffer(), np.int32), np.frombuffer(b.column(2)[r].as_buffer(), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(to), pa.array(d), pa.array(inertias[to]), pa.array(np.full(len(to), whole)), names.take(pa.array(to))],
                    names=[id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    return cut.where("block = -1").select("pack", "ids").join(assigned, "pack").select("ids", "cluster", "distance").mapInArrow(unpack, schema)
