"""Vectors of whole numbers, and their exact products."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

LONG = np.iinfo(np.int64)


def finite(vector: str) -> Column:
    """True for an array without null or non-finite components, null for a null array."""
    return F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def scaled(vector: str, scale: int) -> Column:
    """floor(scale * x) of each component as a long; beyond the range of longs, the nearest long."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))


def most(x: np.ndarray) -> int:
    """The largest absolute value."""
    return max(int(x.max()), -int(x.min())) if x.size else 0


def kind_for(bound: int) -> type:
    """The quickest number type in which sums below ``bound`` are exact."""
    for kind, bits in ((np.float32, 24), (np.float64, 53), (np.int64, 63)):
        if bound < 1 << bits:
            return kind
    return object


def as_longs(x: np.ndarray) -> np.ndarray:
    """Exact numbers as 64-bit integers; beyond their range, the nearest."""
    if x.dtype == object:
        return np.array([min(max(int(v), LONG.min), LONG.max) for v in x.ravel()], dtype=np.int64).reshape(x.shape)
    return x.astype(np.int64)


def squared_distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Exact squared distances (rows of x, rows of centres) of integer matrices."""
    kind = kind_for(2 * x.shape[1] * (most(x) + most(centres)) ** 2)
    a, b = x.astype(kind), centres.astype(kind)
    return (a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)[None]


class Rows:
    """The rows of an integer matrix, kept once in each number type that exact products have needed."""

    def __init__(self, x: np.ndarray):
        self.x, self.most, self._as = x, most(x), {}

    def products(self, vector: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
        """Exact products of the rows (or those at ``at``) with an integer vector."""
        kind = kind_for(self.x.shape[1] * self.most * most(vector) + 1)
        if kind not in self._as:
            self._as[kind] = self.x.astype(kind)
        rows = self._as[kind]
        return (rows if at is None else rows[at]) @ vector.astype(kind)
