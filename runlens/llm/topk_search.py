"""Exact top-k search by inner product: norm-bucketed retrieval.

Rows are put in the order of their length and cut into buckets of at most
``BUCKET`` rows; queries are cut into blocks in the same way.  A block meets a
bucket in one task, so work and memory of a task are bounded, and nothing but
the list of buckets goes through the driver.

First every query meets the few buckets of the longest vectors; its k-th best score
there is a threshold that its result reaches at least.  A bucket whose longest
vector, times the query's length, stays below the threshold is not sent to the
query's block.  In a bucket that is sent the threshold over both lengths gives
each query the cosine that a vector needs there, and with it the way to look:

- above 1: nothing in the bucket can do;
- high (from ``COORDINATE``): a vector of that cosine must lie, once divided by
  its length, close to the query in the query's largest coordinates; those outside
  are left out;
- lower: only the vectors whose own length suffices are looked at.

What remains is verified by exact products.  Thresholds only grow, and a score
equal to the threshold is kept, so results are exact, ties included.

Defined cases.  A row takes part if its vector is there, not empty, and no
component is null or not finite.  Vectors of different widths are compared as if
filled up with zeros.  Every row counts, also one whose id is repeated: a repeated
query gets its own result, and a query's own row is left out, not rows that repeat it.
Rows with a null id are candidates only and come last among equal scores.  An
empty table gives an empty result.  A component of 2**23 or more after scaling is
an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import saved
from .vectors import matrix, products, quantised, usable

#: Rows of a bucket and queries of a block.
BUCKET = 1 << 13
BLOCK = 1 << 12
#: Products worked on at once.
CELLS = 1 << 22
#: Cosine from which coordinates are looked at, and how many of them.
COORDINATE = 0.6
FOCUS = 4
SLACK = 1e-9
_LAST = (1 << 63) - 1  # null ids sort last


def _numbered(rows: DataFrame, size: int, name: str) -> DataFrame:
    """Rows in descending length, with the number of their bucket and of the row.

    Tasks hold ranges of lengths; a task numbers its buckets by itself.
    """
    schema = rows.schema.add("bucket", "long").add("row", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        task = TaskContext.get().partitionId()
        for batch in batches:
            row = (np.int64(task) << np.int64(40)) + seen + np.arange(batch.num_rows, dtype=np.int64)
            seen += batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array((row >> 40 << 24) + (row & ((1 << 40) - 1)) // size), pa.array(row)],
                [*batch.schema.names, "bucket", "row"],
            )

    order = [F.desc("norm"), F.asc("id"), F.asc("y")]
    return saved(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, schema), name)


def _directory(rows: DataFrame) -> list:
    """(bucket, high, n) in descending length: one entry for each bucket."""
    return rows.groupBy("bucket").agg(F.max("norm").alias("high"), F.count(F.lit(1)).alias("n")).orderBy(F.desc("high"), "bucket").collect()


def best_in_bucket(q: dict, c: dict, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query place, candidate place, score) of at most k candidates of each query.

    ``q``: y, norm, row, threshold; ``c``: y, norm, id, row, sorted by descending norm.
    """
    high = float(c["norm"][0])
    ask = np.where(q["threshold"] > 0, q["threshold"] / np.maximum(q["norm"], 1e-300), -np.inf)  # the length a vector needs
    cosine = ask / max(high, 1e-300)
    alive = np.flatnonzero(cosine <= 1 + SLACK)
    upto = np.searchsorted(-c["norm"], -ask * (1 - SLACK), side="right")  # those long enough
    near = cosine[alive] >= COORDINATE
    found = []
    for i in alive[near]:
        places = _coordinates(q["y"][i] / q["norm"][i], cosine[i], c["unit"][: upto[i]])
        if len(places):
            score = products(q["y"][i : i + 1], c["y"][places])[0]
            found.append((np.full(len(places), i), places, score))
    far = alive[~near]
    far = far[np.argsort(upto[far])]  # queries that look equally far go together
    step = max(1, CELLS // max(1, len(c["norm"])))
    for start in range(0, len(far), step):
        some = far[start : start + step]
        n = int(upto[some].max())
        if not n:
            continue
        scores = products(q["y"][some], c["y"][:n])
        least = q["threshold"][some]
        if n > k + 1:  # the k-th best, own row aside
            least = np.maximum(least, np.partition(scores, n - k - 1, axis=1)[:, n - k - 1])
        a, b = np.nonzero(scores >= least[:, None])
        found.append((some[a], b, scores[a, b]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    a, b, s = (np.concatenate(x) for x in zip(*found))
    keep = (s >= q["threshold"][a]) & (q["row"][a] != c["row"][b])
    a, b, s = a[keep], b[keep], s[keep]
    order = np.lexsort((c["row"][b], c["id"][b], -s, a))
    a, b, s = a[order], b[order], s[order]
    place = np.arange(len(a)) - np.searchsorted(a, a)
    return a[place < k], b[place < k], s[place < k]


def _coordinates(q: np.ndarray, cosine: float, unit: np.ndarray) -> np.ndarray:
    """Rows of ``unit`` that can have the cosine with ``q``, by the query's largest coordinates."""
    cosine = min(cosine, 1.0)
    fit = np.arange(len(unit))
    for f in np.argsort(-np.abs(q))[:FOCUS]:
        reach = np.sqrt(max(0.0, (1 - cosine * cosine) * (1 - q[f] * q[f]))) + 1e-6
        x = unit[fit, f]
        fit = fit[(x >= q[f] * cosine - reach) & ((x <= q[f] * cosine + reach) | (x * np.sign(q[f]) >= abs(q[f]) * cosine))]
    return fit


def _met(queries: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """(query, query_id, row, vec_id, score): per block and bucket the k best of each query.

    ``queries`` has block, row, id, y, norm, threshold; ``candidates`` bucket, block, row, id, y, norm.
    """
    pairs = candidates.select(F.col("block").alias("to_block"), F.col("bucket").alias("to_bucket")).distinct()
    sent = queries.join(pairs, F.col("block") == F.col("to_block")).drop("block")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        width = max((matrix(t.column("y").combine_chunks()).shape[1] for t in (left, right) if t.num_rows), default=0)
        side = lambda t, n: t.column(n).to_numpy()
        y = {id(t): matrix(t.column("y").combine_chunks(), width) for t in (left, right)}
        q = {"y": y[id(left)], "norm": side(left, "norm"), "row": side(left, "row"), "threshold": side(left, "threshold").astype(np.float64)}
        norm = side(right, "norm")
        order = np.argsort(-norm, kind="stable")
        ids = right.column("id").combine_chunks()
        c = {"norm": norm[order], "row": side(right, "row")[order], "y": y[id(right)][order]}
        c["id"] = pa.compute.fill_null(ids, _LAST).to_numpy(zero_copy_only=False)[order]
        c["unit"] = c["y"] / np.maximum(c["norm"], 1e-300)[:, None]
        a, b, s = best_in_bucket(q, c, k) if left.num_rows and right.num_rows else (np.zeros(0, np.int64),) * 3
        return pa.table(
            {
                "query": pa.array(q["row"][a]),
                "query_id": left.column("id").combine_chunks().take(pa.array(a)),
                "row": pa.array(c["row"][b]),
                "vec_id": ids.take(pa.array(order[b])),
                "score": pa.array(s.astype(np.int64)),
            }
        )

    schema = "query long, query_id long, row long, vec_id long, score long"
    return sent.groupBy("to_block", "to_bucket").cogroup(candidates.groupBy("block", "bucket")).applyInArrow(meet, schema)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(
    df: DataFrame,
    is_query: Column,
    k: int = 20,
    scale: int = 64,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of each query with all other rows.

    Components become floor(scale * x).  Ties go to the smaller id.  ``is_query`` is a
    condition on the rows of ``df``.
    """
    vec = F.col(f"`{vec_col}`")
    rows = df.where(usable(vec)).select(
        F.col(f"`{id_col}`").alias("id"), F.coalesce(is_query, F.lit(False)).alias("asks"), quantised(vec, scale).alias("y")
    )
    norm = F.sqrt(F.aggregate("y", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    rows = _numbered(rows.withColumn("norm", norm), BUCKET, "buckets")
    asked = rows.where("asks").select("id", "y", "norm", F.col("row").alias("own"))
    queries = _numbered(asked, BLOCK, "queries").select(
        "id", "y", "norm", F.col("own").alias("row"), F.col("bucket").alias("block")
    )
    candidates = rows.select("id", "y", "norm", "bucket", "row")
    buckets = _directory(rows)
    longest, there = [], 0
    for b in buckets:
        longest.append(b["bucket"])
        there += b["n"]
        if there > k:
            break
    blocks = [r["bucket"] for r in _directory(queries.withColumnRenamed("block", "bucket"))]
    if not blocks:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    everywhere = F.explode(F.array(*[F.lit(b) for b in blocks]))
    seeds = candidates.where(F.col("bucket").isin(longest)).withColumn("block", everywhere)
    none = F.lit(-float("inf"))
    first = saved(_ranked(_met(queries.withColumn("threshold", none), seeds, k), k), "first")
    reached = first.where(F.col("rank") == k).select(F.col("query").alias("row"), F.col("score").cast("double").alias("reached"))
    queries = saved(queries.join(reached, "row", "left").select("*", F.coalesce("reached", none).alias("threshold")).drop("reached"), "asking")
    # a block needs the buckets that are long enough for one of its queries
    need = F.when(F.col("threshold") > 0, F.col("threshold") / F.col("norm")).otherwise(F.lit(0.0))
    needs = [(r["block"], r["need"]) for r in queries.groupBy("block").agg(F.min(need).alias("need")).collect()]
    rest = candidates.where(~F.col("bucket").isin(longest))
    highs = F.create_map(*[x for b in buckets for x in (F.lit(b["bucket"]), F.lit(float(b["high"])))])
    wanted = F.filter(
        F.array(*[F.struct(F.lit(b).alias("block"), F.lit(float(n)).alias("need")) for b, n in needs]),
        lambda e: e["need"] * (1 - SLACK) <= F.element_at(highs, F.col("bucket")),
    )
    sent = rest.withColumn("block", F.explode(F.transform(wanted, lambda e: e["block"])))
    found = first.drop("rank").unionByName(_met(queries, sent, k))
    return _ranked(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
