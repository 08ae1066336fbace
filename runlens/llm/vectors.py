"""Integer vectors for the vector operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Quantised components must stay below this size, so that squares and their sums are exact.
LIMIT = 1 << 23


def usable(vec: Column) -> Column:
    """Whether a vector is there, has components, and none of them is null or not finite."""
    limit = F.lit(float("inf"))
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < limit))
    return F.coalesce(vec.isNotNull() & (F.size(vec) > 0) & fine, F.lit(False))


def quantised(vec: Column, scale: int) -> Column:
    """floor(scale * x) of every component as long; one of ``LIMIT`` or more in size is an error."""
    ints = F.transform(vec, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))
    wide = F.exists(vec, lambda x: F.abs(x.cast("double")) * scale >= LIMIT)
    return F.when(wide, F.raise_error(F.lit(f"a component reaches {LIMIT} after scaling by {scale}"))).otherwise(ints)


def matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """The lists of a column as rows; lists of other lengths than ``width`` are filled up with zeros."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = pa.compute.list_value_length(column).to_numpy(zero_copy_only=False)
    n = len(column)
    if not n:
        return np.zeros((0, width or 0), np.int64)
    width = int(sizes.max()) if width is None else width
    if (sizes == width).all():
        return flat.reshape(n, width)
    out = np.zeros((n, width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of ``a`` with all rows of ``b``.

    Doubles are exact as long as no partial sum reaches 2**53.
    """
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < 2.0**53:
        return a.astype(np.float64) @ b.T.astype(np.float64)
    return a @ b.T


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of ``a`` to all rows of ``b``, as whole numbers."""
    dots = products(a, b)
    own = np.einsum("ij,ij->i", a, a)[:, None] + np.einsum("ij,ij->i", b, b)[None, :]
    if dots.dtype == np.float64 and own.max(initial=0) < 1 << 51:
        return own - 2.0 * dots
    return own - 2 * dots.astype(np.int64)


def lists(rows: np.ndarray, kind: pa.DataType = pa.int64()) -> pa.ListArray:
    """A matrix as a list column."""
    n, width = rows.shape
    offsets = np.arange(0, n * width + 1, width, dtype=np.int32) if width else np.zeros(n + 1, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.ascontiguousarray(rows).reshape(-1)).cast(kind))


def totals(rows: DataFrame) -> dict[tuple[int, int], int]:
    """Sums of (slot, pos, s) rows by slot and position; as many as slots and positions, whatever the rows."""
    return {(r["slot"], r["pos"]): r["s"] for r in rows.groupBy("slot", "pos").agg(F.sum("s").alias("s")).collect()}


def partial_totals(slots: np.ndarray, rows: np.ndarray, sign: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(slots, sums with the count in front) of the rows of each slot."""
    found, place = np.unique(slots, return_inverse=True)
    sums = np.zeros((len(found), rows.shape[1] + 1), np.int64)
    np.add.at(sums, place, np.concatenate([np.ones((len(rows), 1), np.int64), rows], axis=1) * sign)
    return found, sums


class Totals:
    """Counts and sums per slot over the batches of one task."""

    def __init__(self) -> None:
        self.sums: dict[int, np.ndarray] = {}

    def add(self, slots: np.ndarray, rows: np.ndarray, sign: int = 1) -> None:
        for slot, s in zip(*partial_totals(slots, rows, sign)):
            self.put(int(slot), s)

    def put(self, slot: int, s: np.ndarray) -> None:
        self.sums[slot] = self.sums[slot] + s if slot in self.sums else s

    def batch(self) -> pa.RecordBatch:
        """Rows (slot, pos, s); the count is at position 0."""
        width = len(next(iter(self.sums.values()))) if self.sums else 0
        slot = np.repeat(np.array(list(self.sums), np.int64), width)
        pos = np.tile(np.arange(width, dtype=np.int32), len(self.sums))
        s = np.concatenate(list(self.sums.values())) if self.sums else np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(slot), pa.array(pos), pa.array(s)], ["slot", "pos", "s"])


TOTALS = "slot long, pos int, s long"
