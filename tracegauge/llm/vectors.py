"""Vectors as integers: cleaning of a vector column, and exact products and sums in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Whole numbers up to here are exact as doubles.
EXACT = 1 << 53


def sound(vector: str) -> Column:
    """True where the vector is not null and holds neither nulls nor non-finite components."""
    v = F.col(vector).cast("array<double>")
    ok = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return F.coalesce(ok, F.lit(False))


def scaled(vector: str, scale: int) -> Column:
    """floor(scale * component), the component as double; beyond the range of a long its ends."""
    return F.transform(F.col(vector).cast("array<double>"), lambda c: F.floor(F.lit(float(scale)) * c).cast("long"))


def integers(rows: DataFrame, id_col: str, vector: str, scale: int) -> DataFrame:
    """(id, x) of the sound rows: x is the scaled vector as longs."""
    return rows.where(sound(vector)).select(F.col(id_col).alias("id"), scaled(vector, scale).alias("x"))


def matrix(lists: pa.Array, width: int) -> np.ndarray:
    """The lists as rows of longs, shorter ones padded with zeros."""
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(lists.offsets.to_numpy()) if len(lists) else np.zeros(0, np.int64)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def largest(a: np.ndarray) -> int:
    return max(abs(int(a.max())), abs(int(a.min()))) if a.size else 0


def products(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """a @ b of long matrices, exact; a value beyond +-``most`` becomes that. Doubles where they are exact, else longs, else Python's integers."""
    bound = largest(a) * largest(b) * a.shape[1]
    if bound < EXACT:
        out = (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    elif bound < 1 << 63:
        out = a @ b
    else:
        return np.clip(a.astype(object) @ b.astype(object), -most, most).astype(np.int64)
    return np.clip(out, -most, most) if bound > most else out
