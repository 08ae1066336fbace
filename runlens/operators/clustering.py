"""K-means on array columns.

Distances are computed on whole Arrow batches, by matrix products.  A step reduces
every task to k rows of counts and sums before anything is shuffled; only the
centroids pass through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runlens.operators.sizing import attach

#: Centroids compared at once, and distances held at once.
BLOCK = 10_000
_CELLS = 1 << 22
#: Vectors in a packed matrix.
_PACKED = 4_096
#: Rounding of a distance from a matrix product, relative to the squares in it.
_ROUNDING = 1e-12
_ASSIGNED = T.StructType(
    [T.StructField("cluster", T.IntegerType()), T.StructField("d2", T.DoubleType())]
)


def as_matrix(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column as a matrix, and which rows had a vector."""
    present = np.asarray(vectors.is_valid())
    kept = vectors.drop_null()
    flat = kept.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(kept), -1) if len(kept) else flat.reshape(0, 0), present


def nearest(points: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest centroid, the lowest among equals, and its d².

    One matrix product for each block of points gives all distances up to rounding;
    those that rounding can't tell apart are computed from the differences.
    """
    best = np.zeros(len(points), dtype=np.int32)
    best_d2 = np.full(len(points), np.inf)
    if not len(points) or not len(centroids):
        return best, best_d2
    sizes = np.einsum("ij,ij->i", centroids, centroids)
    step = max(1, _CELLS // len(centroids))
    for start in range(0, len(points), step):
        x = points[start : start + step]
        own = np.einsum("ij,ij->i", x, x)
        d2 = own[:, None] + sizes[None, :] - 2.0 * (x @ centroids.T)
        close = d2 <= d2.min(axis=1, keepdims=True) + _ROUNDING * (own[:, None] + sizes.max())
        chosen = close.argmax(axis=1)
        gap = x - centroids[chosen]
        chosen_d2 = np.einsum("ij,ij->i", gap, gap)
        several = np.flatnonzero(close.sum(axis=1) > 1)
        if len(several):
            row, k = np.nonzero(close[several])  # in the order of rows, then of centroids
            gap = x[several[row]] - centroids[k]
            exact = np.einsum("ij,ij->i", gap, gap)
            order = np.lexsort((k, exact, row))
            first = order[np.searchsorted(row[order], np.arange(len(several)))]
            chosen[several], chosen_d2[several] = k[first], exact[first]
        best[start : start + step], best_d2[start : start + step] = chosen, chosen_d2
    return best, best_d2


def _centroid_blocks(centroids: DataFrame) -> Iterator[np.ndarray]:
    """The centroids 0 to k - 1 in blocks of ``BLOCK``; one block is in the driver at a time."""
    facts = centroids.agg(F.count(F.lit(1)), F.min("cluster"), F.max("cluster"), F.count_distinct("cluster")).first()
    if facts[0] and (facts[1], facts[2], facts[3]) != (0, facts[0] - 1, facts[0]):
        raise ValueError("centroids must be numbered 0..k-1")
    for start in range(0, facts[0], BLOCK):
        block = centroids.filter(F.col("cluster").between(start, start + BLOCK - 1)).orderBy("cluster")
        yield np.array([r["centroid"] for r in block.select("cluster", "centroid").collect()], dtype=np.float64)


def kmeans_assign(points: DataFrame, centroids: DataFrame, vec: str = "vec") -> DataFrame:
    """Adds ``cluster`` and the squared distance ``d2``; no shuffle.

    Many centroids are compared block by block, each keeping the better of its own
    nearest and the one so far.
    """
    out = points.withColumn("__a", F.lit(None).cast(_ASSIGNED))
    start = 0
    for matrix in _centroid_blocks(centroids):
        out = out.withColumn("__a", _better(matrix, start)(vec, "__a"))
        start += len(matrix)
    return out.select(*points.columns, F.col("__a.cluster").alias("cluster"), F.col("__a.d2").alias("d2"))


def _better(matrix: np.ndarray, start: int):
    """A function of (vector, best so far) for the centroids from number ``start`` on."""

    @F.arrow_udf(_ASSIGNED)
    def assign(vectors: pa.Array, so_far: pa.Array) -> pa.Array:
        x, present = as_matrix(vectors)
        cluster = np.zeros(len(present), dtype=np.int32)
        d2 = np.full(len(present), np.inf)
        if len(x):
            found, d2[present] = nearest(x, matrix)
            cluster[present] = found + start
        if start:
            old = so_far.field("d2").fill_null(np.inf).to_numpy(zero_copy_only=False)
            keep = old <= d2  # the lower number of equals
            cluster = np.where(keep, so_far.field("cluster").fill_null(0).to_numpy(zero_copy_only=False), cluster).astype(np.int32)
            d2 = np.where(keep, old, d2)
        return pa.StructArray.from_arrays(
            [pa.array(cluster, mask=~present), pa.array(d2, mask=~present)], names=["cluster", "d2"]
        )

    return assign


# A position below zero in the long rows carries the count of the cluster.
_COUNT = -1
_TOTALS = "cluster int, pos int, s double"


def _sums(x: np.ndarray, cluster: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The clusters that have rows, ascending, and the sums of their rows."""
    order = np.argsort(cluster, kind="stable")  # so that each cluster is one run of rows
    found, start = np.unique(cluster[order], return_index=True)
    return found, np.add.reduceat(x[order], start, axis=0)


class _Totals:
    """Sums per cluster over the batches of one task."""

    def __init__(self) -> None:
        self.sums: dict[int, np.ndarray] = {}
        self.counts: dict[int, int] = {}

    def add(self, x: np.ndarray, cluster: np.ndarray) -> None:
        found, sums = _sums(x, cluster)
        for k, row, n in zip(found.tolist(), sums, np.unique(cluster, return_counts=True)[1].tolist()):
            self.sums[k] = self.sums[k] + row if k in self.sums else row
            self.counts[k] = self.counts.get(k, 0) + n

    def batch(self) -> pa.RecordBatch:
        """Rows (cluster, position, sum), with the counts."""
        rows = [(k, pos, s) for k, row in self.sums.items() for pos, s in enumerate(row.tolist())]
        rows += [(k, _COUNT, float(n)) for k, n in self.counts.items()]
        cluster, pos, s = zip(*rows) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays(
            [pa.array(cluster, pa.int32()), pa.array(pos, pa.int32()), pa.array(s, pa.float64())],
            names=["cluster", "pos", "s"],
        )


def kmeans_update(assigned: DataFrame, centroids: DataFrame | None = None, vec: str = "vec") -> DataFrame:
    """Mean of every cluster's members; an empty cluster keeps its centroid."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = _Totals()
        for batch in batches:
            x, _ = as_matrix(batch.column(1))
            if len(x):
                totals.add(x, batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64))
        yield totals.batch()

    rows = assigned.select("cluster", vec).filter(F.col("cluster").isNotNull() & F.col(vec).isNotNull())
    cells = rows.mapInArrow(partial, _TOTALS).groupBy("cluster", "pos").agg(F.sum("s").alias("s"))
    # one array per cluster, as long as a vector
    packed = F.array_sort(F.collect_list(F.when(F.col("pos") >= 0, F.struct("pos", "s"))))
    means = (
        cells.groupBy("cluster")
        .agg(F.max(F.when(F.col("pos") == _COUNT, F.col("s"))).alias("n"), packed.alias("sums"))
        .select(
            "cluster",
            F.col("n").cast("bigint").alias("n"),
            F.transform("sums", lambda e: e["s"] / F.col("n")).alias("centroid"),
        )
    )
    if centroids is None:
        return means
    old = centroids.select("cluster", F.col("centroid").alias("__old"))
    return attach(old, means, ["cluster"]).select(
        "cluster", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("centroid", "__old").alias("centroid")
    )


def kmeans_inertia(assigned: DataFrame, centroids: DataFrame, vec: str = "vec") -> DataFrame:
    """Sum of squared distances from members to the given (updated) centroids.

    Members meet their centroid in a join, whatever the number of centroids.
    """
    rows = assigned.filter(F.col("cluster").isNotNull() & F.col(vec).isNotNull()).select("cluster", F.col(vec).alias("__vec"))
    own = centroids.select(F.col("cluster"), F.col("centroid").alias("__own"))
    gap = F.zip_with("__vec", "__own", lambda a, b: (a.cast("double") - b) * (a.cast("double") - b))
    return rows.join(own, "cluster").select(F.aggregate(gap, F.lit(0.0), lambda s, g: s + g).alias("d2")).agg(F.sum("d2").alias("inertia"))


def initial_centroids(points: DataFrame, k: int, seed: int, key: str, vec: str = "vec") -> np.ndarray:
    """k seeded draws of a row, with replacement.

    Every draw takes the row with the smallest hash of (seed, draw, key), so all
    draws are one aggregate and the outcome does not depend on the partitions.
    """
    draw = lambda j: F.min_by(vec, F.xxhash64(F.lit(seed), F.lit(j), F.col(key)))
    row = points.filter(F.col(vec).isNotNull()).agg(*[draw(j).alias(f"c{j}") for j in range(k)]).first()
    if row[0] is None:
        raise ValueError("no vectors to draw centroids from")
    return np.array([row[j] for j in range(k)], dtype=np.float64)


def kmeans_fit(
    points: DataFrame,
    k: int,
    key: str,
    max_iter: int = 500,
    seed: int = 0,
    vec: str = "vec",
    start: Sequence[Sequence[float]] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Centroids and the inertia of every step, with ``converged`` in its rows.

    A step assigns every row once and gives counts, sums and squared distances per
    cluster; the inertia around the moved centroids follows from those.  Steps stop
    when no row changes its cluster, that is when counts and centroids stay as
    they are; only centroids pass through the driver.
    """
    spark = points.sparkSession
    rows = points.select(vec).filter(F.col(vec).isNotNull())
    current = np.array(start, dtype=np.float64) if start is not None else initial_centroids(points, k, seed, key, vec)
    rows = _packed(rows, current.shape[1]).persist(StorageLevel.MEMORY_AND_DISK)
    counts: np.ndarray | None = None
    history: list[tuple[int, float]] = []
    converged, inertia = False, 0.0
    for step in range(max_iter + 1):
        n, sums, d2 = _step(rows, current)
        updated = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], current)
        # sums of the same rows may differ in their last bits
        still = np.abs(updated - current).max(initial=0.0) <= 1e-12 * np.abs(current).max(initial=0.0)
        converged = counts is not None and bool((n == counts).all()) and bool(still)
        if counts is not None and not converged:
            history.append((step, inertia))
        if converged or step == max_iter:
            break
        inertia = float(d2 - (n * ((updated - current) ** 2).sum(axis=1)).sum())
        counts, current = n, updated
    rows.unpersist()
    centroids = spark.createDataFrame(
        [(i, [float(v) for v in c]) for i, c in enumerate(current)], "cluster int, centroid array<double>"
    )
    return centroids, spark.createDataFrame(
        [(*h, converged) for h in history], "step int, inertia double, converged boolean"
    )


def _packed(rows: DataFrame, width: int) -> RDD:
    """The vectors as the bytes of matrices, one a batch, so that a step copies bytes and no single numbers."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, _ = as_matrix(batch.column(0))
            if len(x) and x.shape[1] != width:
                raise ValueError(f"vectors must have the {width} components of the centroids")
            for start in range(0, len(x), _PACKED):
                part = np.ascontiguousarray(x[start : start + _PACKED])
                yield pa.RecordBatch.from_arrays([pa.array([part.tobytes()], pa.binary())], names=["block"])

    return rows.mapInArrow(pack, "block binary").rdd.map(lambda r: bytes(r[0]))


def _step(blocks: RDD, current: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Rows and sums per cluster, and the sum of the squared distances.

    One job without a shuffle, or with one where there are many tasks; a plan for each
    step would cost more than the step.
    """

    def partial(items: Iterator[bytes]) -> Iterator[tuple]:
        n, sums, d2 = np.zeros(len(current)), np.zeros_like(current), 0.0
        for block in items:
            x = np.frombuffer(block, dtype=np.float64).reshape(-1, current.shape[1])
            cluster, gaps = nearest(x, current)
            found, part = _sums(x, cluster)
            n += np.bincount(cluster, minlength=len(current))
            sums[found] += part
            d2 += float(gaps.sum())
        yield n, sums, d2

    add = lambda a, b: (a[0] + b[0], a[1] + b[1], a[2] + b[2])
    zero = (np.zeros(len(current)), np.zeros_like(current), 0.0)
    return blocks.mapPartitions(partial).treeAggregate(zero, add, add, depth=1 if blocks.getNumPartitions() <= 64 else 2)
