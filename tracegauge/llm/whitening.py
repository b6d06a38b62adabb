"""Whitening of vectors by their leading principal components, found by contour integration (FEAST).

Sums and the covariance are exact: vectors become whole numbers, are centred by a whole number near the mean before they
are multiplied, and the rest of the mean is taken off in rational arithmetic, so no result depends on the order of
rows or tasks. Tasks return sums of the size of the covariance, which is all that the driver gets.

The eigenvalues wanted are cut into intervals by inertia counts (pivots of the factored shifted matrix). In each interval
the projector onto its eigenvectors is the contour integral of (zI - V)^-1, by quadrature over complex shifted solves,
one task per shift; Rayleigh-Ritz in the projected space gives the components, and the rounds go on until the residuals
are at rounding level and as many Ritz values lie in the interval as the inertia says. A larger space is tried otherwise.

Vectors that are null or hold null or non-finite entries are dropped; shorter vectors are as if padded with zeros; entries
beyond +-2^53 after scaling count as that. A null id is kept, repeated rows count each. ``whitened`` is null for a
component without variance, ``explained`` where all vectors are equal, ``deviation`` where it exceeds a long.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracegauge.llm.vectors import EXACT, integers, largest, matrix

OFFSET = 100_000
#: Quadrature nodes on the upper half of a contour, and rounds before a larger space is tried.
NODES, ROUNDS = 12, 12
_SUM = pa.decimal128(38, 0)


def shifted(rows: DataFrame, id_col: str, vector: str, scale: int) -> DataFrame:
    """(id, x) with x = floor(scale * entry), without the offset, which no centred value depends on."""
    held = F.transform("x", lambda c: F.greatest(F.least(c, F.lit(EXACT)), F.lit(-EXACT)))
    return integers(rows, id_col, vector, scale).select("id", held.alias("x"))


def exact_gram(y: np.ndarray) -> np.ndarray:
    """y' y as Python integers, by products of blocks that doubles hold exactly."""
    most = max(1, largest(y)) ** 2
    if most >= EXACT:
        return y.astype(object).T @ y.astype(object)
    total = np.zeros((y.shape[1], y.shape[1]), object)
    step = EXACT // most
    for lo in range(0, len(y), step):
        part = y[lo:lo + step].astype(np.float64)
        total += (part.T @ part).astype(np.int64).astype(object)
    return total


def task_sums(rows: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], None]]) -> list:
    """(i, s) summed over all tasks: ``make`` gives a function that takes batches and has a dict ``sums`` of integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for b in batches:
            step(b)
        if step.sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(step.sums), pa.int64()), pa.array([Decimal(int(v)) for v in step.sums.values()], _SUM)], names=["i", "s"])

    return rows.mapInArrow(run, "i bigint, s decimal(38,0)").groupBy("i").agg(F.sum("s").alias("s")).collect()


class Columns:
    """Per-dimension sums, under 2i, and numbers of vectors that reach it, under 2i + 1; the count under -1."""

    def __init__(self):
        self.sums: dict[int, int] = {}

    def __call__(self, batch: pa.RecordBatch) -> None:
        x = batch.column(1)
        sizes = np.diff(x.offsets.to_numpy())
        m = matrix(x, int(sizes.max(initial=0)))
        add = {-1: len(sizes)}
        for i in range(m.shape[1]):
            col = m[:, i]
            add[2 * i] = int(col.sum()) if largest(col) * len(col) < 1 << 62 else sum(col.tolist())
            add[2 * i + 1] = int((sizes > i).sum())
        for key, v in add.items():
            self.sums[key] = self.sums.get(key, 0) + v


class Gram:
    """Sums of products of the centred entries: (i, j), i <= j, under i * d + j."""

    def __init__(self, near: np.ndarray):
        self.near, self.total = near, None

    def __call__(self, batch: pa.RecordBatch) -> None:
        g = exact_gram(matrix(batch.column(1), len(self.near)) - self.near)
        self.total = g if self.total is None else self.total + g

    @property
    def sums(self) -> dict[int, int]:
        d = len(self.near)
        return {} if self.total is None else {i * d + j: self.total[i, j] for i in range(d) for j in range(i, d)}


@dataclass
class Moments:
    n: int
    near: np.ndarray  # whole numbers near the mean
    rest: list[Fraction]  # the mean less those
    rests: list[int]  # n times the rest
    covariance: np.ndarray


def moments(x: DataFrame) -> Moments | None:
    """Count, mean and covariance (divisor n) of (id, x), rounded once at the end."""
    sums = {r.i: int(r.s) for r in task_sums(x, Columns)}
    n, d = sums.get(-1, 0), sum(1 for k in sums if k >= 0) // 2
    if not n:
        return None
    near = [round(Fraction(sums[2 * i], n)) for i in range(d)]
    rests = [sums[2 * i] - n * near[i] for i in range(d)]
    at = np.array(near, np.int64)
    gram = {r.i: int(r.s) for r in task_sums(x, lambda: Gram(at))}
    v = np.zeros((d, d))
    for key, s in gram.items():
        i, j = divmod(key, d)
        v[i, j] = v[j, i] = Fraction(n * s - rests[i] * rests[j], n * n)
    return Moments(n, at, [Fraction(r, n) for r in rests], rests, v)


# --- eigenvalue intervals ------------------------------------------------------------------------


def tridiagonal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and off-diagonal of a matrix with the same inertia under every shift (Householder reflections)."""
    a, d = v.copy(), len(v)
    for k in range(d - 2):
        u = a[k + 1:, k].copy()
        length = np.linalg.norm(u)
        if length == 0:
            continue
        u[0] += math.copysign(length, u[0])
        u /= np.linalg.norm(u)
        a[k + 1:, :] -= 2 * np.outer(u, u @ a[k + 1:, :])
        a[:, k + 1:] -= 2 * np.outer(a[:, k + 1:] @ u, u)
    return np.diag(a).copy(), np.diag(a, -1).copy()


def above(diag: np.ndarray, off: np.ndarray, shift: float) -> int:
    """Inertia: the eigenvalues above the shift are the positive pivots of the shifted matrix."""
    tiny = np.finfo(float).tiny ** 0.5
    pivot, count = 1.0, 0
    for i, x in enumerate(diag):
        pivot = x - shift - (off[i - 1] ** 2 / pivot if i else 0.0)
        if pivot == 0:
            pivot = -tiny
        count += pivot > 0
    return count


def intervals(v: np.ndarray, k: int) -> list[tuple[float, float, int]]:
    """(low, high, eigenvalues inside) that cover the k largest eigenvalues, cut at wide gaps."""
    diag, off = tridiagonal(v)
    size = float(np.abs(v).sum(axis=1).max())
    d = len(v)

    def largest_from(i: int) -> float:
        """The i-th largest eigenvalue, roughly, by bisection of inertia counts."""
        lo, hi = -size, size * (1 + 1e-9)
        while hi - lo > size * 1e-9:
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if above(diag, off, mid) >= i else (lo, mid)
        return (lo + hi) / 2

    near = [largest_from(i + 1) for i in range(min(d, k + 4))]
    gaps = [a - b for a, b in zip(near, near[1:], strict=False)] + ([near[-1] + size] if len(near) == d else [])
    last = max(range(min(k - 1, len(gaps) - 1), len(gaps)), key=lambda i: gaps[i]) if gaps else 0
    inner = [i for i in range(last) if gaps[i] > 1e-6 * size]
    cuts = sorted({max(inner, key=lambda i: gaps[i])} if inner else set()) + [last]
    out, top, before = [], size * 1.01 + 1e-300, 0
    for i in cuts:
        low = near[i] - gaps[i] / 2 if i < len(gaps) else near[i] - size
        inside = above(diag, off, low) - before
        out.append((low, top, inside))
        top, before = low, before + inside
    return out


# --- contour integration -------------------------------------------------------------------------


def quadrature(low: float, high: float) -> list[tuple[float, float, float, float]]:
    """(re z, im z, re w, im w): nodes on the upper half circle over the interval; the lower half is the mirror image."""
    t, w = np.polynomial.legendre.leggauss(NODES)
    ray = (high - low) / 2 * np.exp(1j * np.pi / 2 * (1 + t))
    z, weight = (high + low) / 2 + ray, ray * w / 2
    return [(float(a.real), float(a.imag), float(b.real), float(b.imag)) for a, b in zip(z, weight, strict=True)]


def project(spark: SparkSession, v: np.ndarray, spaces: list[tuple[float, float, np.ndarray]]) -> list[np.ndarray]:
    """The spectral projector of every (low, high, space) applied to its space; each shifted solve is a row of one job."""
    nodes = [(i, k, *node) for i, (low, high, _) in enumerate(spaces) for k, node in enumerate(quadrature(low, high))]
    ys = [y for _, _, y in spaces]

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, k, zr, zi, wr, wi in zip(*(c.to_pylist() for c in b.columns), strict=True):
                part = (complex(wr, wi) * np.linalg.solve(complex(zr, zi) * np.eye(len(v)) - v, ys[i].astype(complex))).real
                yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([k]), pa.array([part.tobytes()])], names=["i", "k", "part"])

    frame = spark.createDataFrame(nodes, "i int, k int, zr double, zi double, wr double, wi double").repartition(min(len(nodes), NODES))
    parts = sorted(frame.mapInArrow(solve, "i bigint, k bigint, part binary").collect(), key=lambda r: (r.i, r.k))
    return [sum(np.frombuffer(r.part).reshape(y.shape) for r in parts if r.i == i) for i, y in enumerate(ys)]


def leading(spark: SparkSession, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues, falling, and unit eigenvectors as columns."""
    size = float(np.abs(v).sum(axis=1).max()) if v.size else 0.0
    if size == 0:
        return np.zeros(k), np.eye(len(v))[:, :k]
    # scaled, so that tolerances hold for any unit
    u, d = v / size, len(v)
    todo = [(low, high, count) for low, high, count in intervals(u, k) if count]
    rng = np.random.default_rng(42)
    spaces = [rng.standard_normal((d, min(d, max(2 * c, c + 4)))) for _, _, c in todo]
    found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    turn = 0
    while len(found) < len(todo):
        turn += 1
        open_ = [i for i in range(len(todo)) if i not in found]
        projected = project(spark, u, [(*todo[i][:2], spaces[i]) for i in open_])
        for i, q in zip(open_, projected, strict=True):
            low, high, count = todo[i]
            basis = np.linalg.qr(q)[0]
            ritz, inner = np.linalg.eigh(basis.T @ u @ basis)
            vectors = basis @ inner
            inside = (ritz > low) & (ritz < high)
            residual = np.linalg.norm(u @ vectors[:, inside] - vectors[:, inside] * ritz[inside], axis=0).max(initial=0)
            whole = basis.shape[1] == d  # the space is everything: Rayleigh-Ritz is exact
            if inside.sum() == count and (residual <= 4e-15 * math.sqrt(d) or whole):
                found[i] = ritz[inside][::-1], vectors[:, inside][:, ::-1]
            else:
                spaces[i] = vectors
                if turn % ROUNDS == 0 and not whole:
                    spaces[i] = np.hstack([vectors, rng.standard_normal((d, min(d, 2 * basis.shape[1]) - basis.shape[1]))])
                if whole and turn > 3 * ROUNDS:
                    raise ArithmeticError(f"{inside.sum()} eigenvalues found where inertia counts {count}")
    values = np.concatenate([found[i][0] for i in range(len(todo))])[:k] * size
    return values, np.hstack([found[i][1] for i in range(len(todo))])[:, :k]


# --- whitening -----------------------------------------------------------------------------------


class Spread:
    """Products of whitened values, as whole multiples of 2^-80, and their sums: the exact sum of what tasks computed."""

    def __init__(self, whitened: Callable[[np.ndarray], np.ndarray], d: int):
        self.whitened, self.d, self.sums = whitened, d, {}

    def __call__(self, batch: pa.RecordBatch) -> None:
        w = self.whitened(matrix(batch.column(1), self.d))
        k = w.shape[1]
        first = np.hstack([w.T @ w, w.sum(axis=0)[:, None]])
        for i in range(k):
            for j in range(k + 1):
                key = i * (k + 1) + j
                self.sums[key] = self.sums.get(key, 0) + int(Fraction(float(first[i, j])) * (1 << 60))


def whiten(rows: DataFrame, k: int = 8, scale: int = 1024, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) per row and component up to ``k``."""
    spark = rows.sparkSession
    kind = rows.select(id_col).schema[0].dataType.simpleString()
    schema = f"`{id_col}` {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    x = shifted(rows, id_col, vector, scale)
    m = moments(x)
    if m is None or not len(m.near):
        return spark.createDataFrame([], schema)
    n, d = m.n, len(m.near)
    k = min(k, d)
    values, vectors = leading(spark, m.covariance, k)
    trace = float(np.trace(m.covariance))
    real = values > trace * d * np.finfo(float).eps * 8
    root = np.where(real, np.sqrt(np.where(real, values, 1.0)), np.nan)
    near, rest, rests = m.near, np.array([float(r) for r in m.rest]), np.array(m.rests, object)

    def whitened(x: np.ndarray) -> np.ndarray:
        return ((x - near) - rest) @ vectors / root

    spread = {r.i: float(Fraction(int(r.s), 1 << 60)) / n for r in task_sums(x, lambda: Spread(lambda a: whitened(a)[:, real], d))}
    kept = int(real.sum())
    square = np.array([[spread[i * (kept + 1) + j] for j in range(kept + 1)] for i in range(kept)]).reshape(kept, kept + 1)
    off = square[:, :kept] - np.outer(square[:, kept], square[:, kept]) - np.eye(kept)
    error = float(np.abs(off).max()) if kept else 0.0

    def deviations(x: np.ndarray) -> list[int | None]:
        y = x - near
        if (n * largest(y) + n) ** 2 * d < 1 << 62:
            z = n * y - rests.astype(np.int64)
            return (z * z).sum(axis=1).tolist()
        z = n * y.astype(object) - rests
        return [s if s < 1 << 63 else None for s in (z * z).sum(axis=1)]

    shares = [float(e) / trace if trace else None for e in values]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b.column(1), d)
            w, rows_ = whitened(x), len(x)
            repeat = pa.array(np.repeat(np.arange(rows_), k))
            yield pa.RecordBatch.from_arrays([
                b.column(0).take(repeat), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows_)), pa.array(np.full(rows_ * k, n)),
                pa.array(deviations(x), pa.int64()).take(repeat), pa.array(w.ravel(), from_pandas=True), pa.array(shares * rows_, pa.float64()),
                pa.array(np.full(rows_ * k, error)),
            ], names=[id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return x.mapInArrow(run, schema)
