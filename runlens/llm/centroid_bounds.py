"""Exact Lloyd clustering with heap-ordered bounds.

A vector that was compared with all centroids knows its distance u to its own
one and l to the next best.  Until the centroids have moved so far that l - u is
used up, its cluster can't change.  Every cluster adds up how fast that gap may
shrink, its own movement and the largest of the others, in its *drift*; a vector
is filed under gap + drift at that time, and expires when the drift of its
cluster reaches this key.  So no bound is ever updated: a cluster's vectors wait
in the order of their keys, and a round takes those off the front whose keys lie
between the drift before and now.

The heaps are runs of rows, sorted by cluster and key, in the shared folder.
What a round pops is compared exactly with all centroids and filed anew in a run
of its own; the old row needs no deletion, since its key lies below the drift
from then on.  A round therefore reads the front of each run (sorted keys let the
Parquet reader skip the rest), and sums of clusters change by the rows that moved
only.  All sums are whole numbers, so the result doesn't depend on how rows are
spread.  The driver holds centroids, sums and drifts, never rows.

Defined cases.  A vector takes part if it has exactly ``width`` components, none
null or not finite; others have no row in the result.  Every row is a vector,
also one whose id is repeated or null; rows with a null id aren't drawn as
starts while others are left.  With fewer than k vectors there are as many
clusters as vectors; without any the result is empty.  Other columns don't
matter, whatever they are called.  A component of 2**23 or more after scaling is
an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved
from .vectors import TOTALS, Totals, lists, matrix, quantised, squared_distances, totals, usable

#: Rows compared with all centroids at a time.
BLOCK = 1 << 14
#: Share by which bounds are widened against rounding.
SLACK = 1e-9

_FILED = "id long, x array<long>, cluster int, was int, key double"


def _filed(rows: DataFrame, centroids: np.ndarray, drift: np.ndarray) -> DataFrame:
    """Rows (id, x, was) compared with all centroids and filed under their new keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(start, BLOCK)
                x = matrix(batch.column("x"), centroids.shape[1])
                d2 = squared_distances(x, centroids)
                best = d2.argmin(axis=1).astype(np.int32)  # the first, so the smaller number, of equals
                u = np.sqrt(d2[np.arange(len(x)), best].astype(np.float64))
                if len(centroids) > 1:
                    l = np.sqrt(np.partition(d2, 1, axis=1)[:, 1].astype(np.float64))
                    key = (l - u) - SLACK * (l + u) + drift[best]
                    # a tie has no gap; its key lies just above the drift, so that any movement pops it
                    key = np.maximum(key, np.nextafter(drift[best], np.inf))
                else:
                    key = np.full(len(x), np.inf)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), lists(x), pa.array(best), batch.column("was"), pa.array(key)],
                    ["id", "x", "cluster", "was", "key"],
                )

    return saved(rows.select("id", "x", "was").mapInArrow(run, _FILED).sortWithinPartitions("cluster", "key"), "heap")


def _moved(run_of_heap: DataFrame, width: int) -> dict[tuple[int, int], int]:
    """Changes of counts (position 0) and sums (from 1) by the rows that changed their cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Totals()
        for batch in batches:
            x = matrix(batch.column("x"), width)
            to, was = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("cluster", "was"))
            if len(x):
                found.add(to, x)
                left = was >= 0
                found.add(was[left], x[left], -1)
        yield found.batch()

    return totals(run_of_heap.where("cluster <> was").select("x", "cluster", "was").mapInArrow(run, TOTALS))


def _of_cluster(values: np.ndarray) -> Column:
    """The value of a row's cluster."""
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), F.col("cluster") + 1)


def _waiting(runs: list[DataFrame], drift: np.ndarray) -> list[DataFrame]:
    """The rows of each run that have not been popped."""
    return [r.where((F.col("key") > float(drift.min())) & (F.col("key") > _of_cluster(drift))) for r in runs]


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def cluster(
    df: DataFrame,
    k: int = 40,
    rounds: int = 5,
    scale: int = 256,
    width: int = 64,
    seed: str = "2",
    id_col: str = "vec_id",
    vec_col: str = "embedding",
) -> tuple[DataFrame, np.ndarray, list[int]]:
    """(id, cluster, distance) of every vector, the final centroids, and how many vectors each step rescanned.

    Components become floor(scale * x).  The k vectors with the smallest SHA-256 of
    ``seed:id`` are the first centroids.  Each round assigns every vector to its
    nearest centroid, the smaller number among equals, and moves non-empty centroids
    to the floor of their mean; after the rounds vectors are assigned once more.
    """
    vec = F.col(f"`{vec_col}`")
    there = df.where(usable(vec) & (F.size(vec) == width))
    rows = there.select(F.col(f"`{id_col}`").alias("id"), quantised(vec, scale).alias("x"))
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    starts = rows.orderBy(mark.asc_nulls_last(), "x").limit(k).collect()
    schema = "id long, cluster int, distance long"
    if not starts:
        return df.sparkSession.createDataFrame([], schema), np.zeros((0, width), np.int64), []
    centroids = np.array([r["x"] for r in starts], np.int64)
    counts, sums = np.zeros(len(centroids), np.int64), np.zeros_like(centroids)
    drift = np.zeros(len(centroids))
    runs = [_filed(rows.withColumn("was", F.lit(-1)), centroids, drift)]
    scanned = [runs[0].count()]
    for _ in range(rounds):
        for (c, pos), s in _moved(runs[-1], width).items():
            if pos:
                sums[c, pos - 1] += s
            else:
                counts[c] += s
        updated = np.where(counts[:, None] > 0, sums // np.maximum(counts, 1)[:, None], centroids)
        step = np.sqrt(((updated - centroids).astype(np.float64) ** 2).sum(axis=1))
        order = np.argsort(step)
        others = np.full(len(step), step[order[-1]])
        others[order[-1]] = step[order[-2]] if len(step) > 1 else 0.0
        before, drift, centroids = drift, drift + (step + others) * (1 + SLACK), updated
        popped = [
            r.where((F.col("key") <= float(drift.max())) & (F.col("key") <= _of_cluster(drift))) for r in _waiting(runs, before)
        ]
        fresh = _union(popped).select("id", "x", F.col("cluster").alias("was"))
        runs.append(_filed(fresh, centroids, drift))
        scanned.append(runs[-1].count())
    return _measured(_union(_waiting(runs, drift)), centroids, schema), centroids, scanned


def _measured(rows: DataFrame, centroids: np.ndarray, schema: str) -> DataFrame:
    """The distance of each row to its own centroid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("cluster").to_numpy(zero_copy_only=False)
            gap = matrix(batch.column("x"), centroids.shape[1]) - centroids[own]
            d2 = np.einsum("ij,ij->i", gap, gap)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("cluster"), pa.array(d2)], ["id", "cluster", "distance"])

    return saved(rows.select("id", "x", "cluster").mapInArrow(run, schema), "distances")


def centroid_digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()
