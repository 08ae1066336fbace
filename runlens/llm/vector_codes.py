"""Compression of vectors to short codes: product quantisation by cover-tree Lloyd.

A vector is cut into equal consecutive parts, and a codebook is learnt for each
position by Lloyd's algorithm.  Rows are taken in chunks, and the parts of a chunk
are put into one cover tree for each position: a node covers its points within a
radius, its children are chosen greedily, at most half that radius wide and with
their centres further apart than that, down to nodes whose points are all equal.
Each node also holds the number and the sum of its points.  The trees are built once and written, one
row for each chunk and position.

A round walks each tree from its root.  Points of a node lie within its radius r
of its centre, so if the best codebook entry is nearer to the centre than any other by
more than 2 r, it is the nearest entry for all of them: the node's count and sum go
to that entry at once.  Only the children of the other nodes are looked at; a
node of equal points is compared exactly.  Tasks add up counts and sums, which are
whole numbers; the driver holds the codebooks only.

Defined cases.  A row takes part if its vector is there, not empty, and no
component is null or not finite.  The codebooks' width is that of the vector with
the smallest id; a vector of another width, or all of them if that width can't be
cut into equal parts, has no row in the result.  Every row counts, also one whose id is repeated or
null; null ids come last when entries are drawn.  With fewer vectors than entries
there are as many entries as vectors, and without any the result is empty.  Null
labels are equal to each other.  A component of 2**23 or more after scaling is an
error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved
from .vectors import TOTALS, Totals, lists, matrix, quantised, squared_distances, totals, usable

#: Rows of a chunk; its distances take eight bytes times the square of this.
CHUNK = 1 << 10
#: Share by which bounds are widened against rounding.
SLACK = 1e-9


@dataclass
class CoverTree:
    """Nodes in breadth-first order; ``begin`` to ``end`` are their points in ``order``, ``first`` to ``last`` their children."""

    order: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    first: np.ndarray
    last: np.ndarray
    sums: np.ndarray

    @staticmethod
    def build(points: np.ndarray) -> CoverTree:
        apart = np.sqrt(np.maximum(squared_distances(points, points), 0).astype(np.float64))
        order = np.arange(len(points))
        centre, radius = [0], [float(apart[0].max())]
        begin, end, first, last = [0], [len(points)], [], []
        at = 0
        while at < len(centre):
            first.append(len(centre))
            if radius[at] > 0:
                low, high = begin[at], end[at]
                left, cover = order[low:high].copy(), radius[at] / 2
                place, c = low, centre[at]
                while len(left):
                    near = apart[c, left] <= cover
                    mine = left[near]
                    order[place : place + len(mine)] = mine
                    centre.append(int(c))
                    radius.append(float(apart[c, mine].max()))
                    begin.append(place)
                    place += len(mine)
                    end.append(place)
                    left = left[~near]
                    c = left[0] if len(left) else c
            last.append(len(centre))
            at += 1
        upto = np.concatenate([np.zeros((1, points.shape[1]), np.int64), np.cumsum(points[order], axis=0)])
        b, e = np.array(begin), np.array(end)
        return CoverTree(order, points[centre], np.array(radius), b, e, np.array(first), np.array(last), upto[e] - upto[b])

    def assign(self, entries: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(nodes, entry of each) level by level: nodes all of whose points are nearest to one entry; together they hold every point once."""
        front = np.zeros(1, np.int64)
        while len(front):
            d2 = squared_distances(self.centre[front], entries)
            best = d2.argmin(axis=1)  # the first, so the lower index, of equals
            radius = self.radius[front]
            sure = radius == 0
            if len(entries) > 1:
                two = np.sqrt(np.partition(d2, 1, axis=1)[:, :2].astype(np.float64))
                sure |= two[:, 1] - two[:, 0] > 2 * radius + SLACK * (two[:, 1] + radius)
            else:
                sure[:] = True
            yield front[sure], best[sure]
            open_ = front[~sure]
            sizes = self.last[open_] - self.first[open_]
            starts = np.repeat(self.first[open_] - np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(open_) else np.zeros(0, np.int64), sizes)
            front = starts + np.arange(int(sizes.sum()))

    def codes(self, entries: np.ndarray) -> np.ndarray:
        """The entry of each point, in the points' own order."""
        out = np.zeros(len(self.order), np.int64)
        for nodes, best in self.assign(entries):
            sizes = self.end[nodes] - self.begin[nodes]
            shift = np.repeat(self.begin[nodes] - np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(nodes) else np.zeros(0, np.int64), sizes)
            out[self.order[shift + np.arange(int(sizes.sum()))]] = np.repeat(best, sizes)
        return out


_FIELDS = {"order": "<i4", "centre": "<i8", "radius": "<f8", "begin": "<i4", "end": "<i4", "first": "<i4", "last": "<i4", "sums": "<i8"}
_TREES = "part int, width int, " + ", ".join(f"{name} binary" for name in _FIELDS)


def _packed(part: int, tree: CoverTree) -> list:
    return [part, tree.centre.shape[1], *(getattr(tree, name).astype(kind).tobytes() for name, kind in _FIELDS.items())]


def _unpacked(row: dict) -> CoverTree:
    arrays = {name: np.frombuffer(row[name], kind) for name, kind in _FIELDS.items()}
    arrays = {name: a.astype(np.int64) if a.dtype.kind == "i" else a for name, a in arrays.items()}
    for name in ("centre", "sums"):
        arrays[name] = arrays[name].reshape(-1, row["width"])
    return CoverTree(**arrays)


def _trees(rows: DataFrame, parts: int, width: int) -> DataFrame:
    """One row for each chunk: its ids and labels, its vectors, and a tree for each part."""
    step = width // parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, CHUNK):
                batch = whole.slice(start, CHUNK)
                x = matrix(batch.column("x"), width)
                trees = [_packed(p, CoverTree.build(x[:, p * step : (p + 1) * step])) for p in range(parts)]
                names = ["part", "width", *_FIELDS]
                packed = pa.array([[dict(zip(names, t)) for t in trees]], pa.list_(pa.struct([("part", pa.int32()), ("width", pa.int32()), *((n, pa.binary()) for n in _FIELDS)])))
                one = lambda c: pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), c)
                yield pa.RecordBatch.from_arrays(
                    [one(batch.column("id")), one(batch.column("label")), pa.array([x.astype("<i8").tobytes()], pa.binary()), packed],
                    ["ids", "labels", "x", "trees"],
                )

    label = rows.schema["label"].dataType.simpleString()
    schema = f"ids array<long>, labels array<{label}>, x binary, trees array<struct<{_TREES.replace(' int', ':int').replace(' binary', ':binary')}>>"
    return saved(rows.mapInArrow(run, schema), "trees")


def _summed(trees: DataFrame, books: list[np.ndarray]) -> dict[tuple[int, int], int]:
    """Counts (position 0) and sums (from 1) of the parts of each entry; slot = part * entries + entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Totals()
        for batch in batches:
            for trees_of_chunk in batch.column("trees").to_pylist():
                for row in trees_of_chunk:
                    tree, book = _unpacked(row), books[row["part"]]
                    for nodes, best in tree.assign(book):
                        if len(nodes):
                            slots, place = np.unique(best, return_inverse=True)
                            sums = np.zeros((len(slots), row["width"] + 1), np.int64)
                            sizes = (tree.end[nodes] - tree.begin[nodes])[:, None]
                            np.add.at(sums, place, np.concatenate([sizes, tree.sums[nodes]], axis=1))
                            for slot, s in zip(slots.tolist(), sums):
                                found.put(row["part"] * len(book) + slot, s)
        yield found.batch()

    return totals(trees.select("trees").mapInArrow(run, TOTALS))


def _coded(trees: DataFrame, books: list[np.ndarray], label: str) -> DataFrame:
    """(id, label, code, error) of each vector."""
    parts, step = len(books), books[0].shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, trees_of_chunk in enumerate(batch.column("trees").to_pylist()):
                x = np.frombuffer(batch.column("x")[i].as_py(), "<i8").reshape(-1, parts * step)
                codes = np.zeros((len(x), parts), np.int64)
                error = np.zeros(len(x), np.int64)
                for row in trees_of_chunk:
                    p = row["part"]
                    codes[:, p] = _unpacked(row).codes(books[p])
                    gap = x[:, p * step : (p + 1) * step] - books[p][codes[:, p]]
                    error += np.einsum("ij,ij->i", gap, gap)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("ids")[i].values, batch.column("labels")[i].values, lists(codes, pa.int32()), pa.array(error)],
                    ["id", "label", "codes", "error"],
                )

    return saved(trees.mapInArrow(run, f"id long, label {label}, codes array<int>, error long"), "codes")


def compress(
    df: DataFrame,
    parts: int = 4,
    entries: int = 256,
    rounds: int = 4,
    scale: int = 1024,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str = "label",
) -> tuple[DataFrame, list[np.ndarray]]:
    """(id, label, codes, error) of every vector, and the codebook of each part.

    Components become floor(scale * x).  The parts of the vectors with the smallest
    ids are the first entries.  Each round assigns every part to the nearest entry,
    the lower index among equals, and moves used entries to the floor of their
    parts' mean; after the rounds parts are assigned once more.
    """
    vec = F.col(f"`{vec_col}`")
    rows = df.where(usable(vec)).select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label"), quantised(vec, scale).alias("x")
    )
    label = rows.schema["label"].dataType.simpleString()
    least = rows.orderBy(F.col("id").asc_nulls_last(), "x").limit(1).collect()
    width = len(least[0]["x"]) if least else 0
    if not width or width % parts:
        return df.sparkSession.createDataFrame([], f"id long, label {label}, codes array<int>, error long"), []
    rows = rows.where(F.size("x") == width)
    starts = rows.orderBy(F.col("id").asc_nulls_last(), "x").limit(entries).select("x").collect()
    first = np.array([r["x"] for r in starts], np.int64)
    step = width // parts
    books = [first[:, p * step : (p + 1) * step] for p in range(parts)]
    trees = _trees(rows, parts, width)
    for _ in range(rounds):
        found = _summed(trees, books)
        updated = []
        for p, book in enumerate(books):
            both = np.array([[found.get((p * len(book) + e, pos), 0) for pos in range(step + 1)] for e in range(len(book))], np.int64)
            counts = both[:, :1]
            updated.append(np.where(counts > 0, both[:, 1:] // np.maximum(counts, 1), book))
        books = updated
    return _coded(trees, books, label), books
