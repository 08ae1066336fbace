"""Dense sigmoid networks: batch scoring, and training on all rows to a bound."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runlens.operators.clustering import as_matrix
from runlens.operators.optimise import Point, descend

Weights = Sequence[np.ndarray]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-x))


def _forward(x: np.ndarray, weights: Weights) -> list[np.ndarray]:
    layers = [x]
    for w in weights:
        layers.append(_sigmoid(layers[-1] @ w))
    return layers


def mlp_score(df: DataFrame, weights: Weights, cut: float = 0.6, vec: str = "vec") -> DataFrame:
    """Adds the network's output and the class 1 where it exceeds ``cut``."""
    fixed = [np.asarray(w, dtype=np.float64) for w in weights]

    @F.arrow_udf(T.DoubleType())
    def output(vectors: pa.Array) -> pa.Array:
        x, present = as_matrix(vectors)
        out = np.zeros(len(present))
        if len(x):
            out[present] = _forward(x, fixed)[-1][:, 0]
        return pa.array(out, mask=~present)

    return df.withColumn("score", output(vec)).withColumn(
        "predicted", (F.col("score") > cut).cast("int")
    )


def start_weights(layers: Sequence[int], seed: int) -> list[np.ndarray]:
    """Seeded uniform weights in [0, 1) for consecutive layer sizes."""
    rng = np.random.default_rng(seed)
    return [rng.random((a, b)) for a, b in zip(layers, layers[1:])]


def mlp_fit(
    df: DataFrame,
    hidden: Sequence[int],
    epochs: int = 500,
    tolerance: float = 0.0,
    flat: float = 1e-4,
    decay: float = 0.0,
    seed: int = 0,
    vec: str = "vec",
    label: str = "label",
) -> tuple[list[np.ndarray], DataFrame]:
    """Weights, and the mean squared error and largest slope after every epoch.

    An epoch is one quasi-Newton step on the mean squared error of all complete rows,
    plus half of ``decay`` times the squared length of the weights.
    Training has converged when the error is ``tolerance`` or less or no slope is above
    ``flat``; ``converged`` says whether the last epoch got there within ``epochs``.
    Epoch 0 are the start weights.  Every evaluation is one job: batches add up their
    gradient, Spark adds up the batches, and only gradients and weights pass through
    the driver.
    """
    rows = df.select(vec, F.col(label).cast("double").alias("__y")).dropna().persist()
    try:
        first = rows.select(F.size(vec)).first()
        if first is None:
            raise ValueError("no complete rows to fit on")
        start = start_weights([first[0], *hidden, 1], seed)

        def evaluate(x: np.ndarray) -> Point:
            ascent, error, n = _gradient(rows, _layers(x, start))
            return Point(x, error / n + decay / 2 * float(x @ x), decay * x - ascent / n, {"mse": error / n})

        def done(p: Point) -> bool:
            return p.extra["mse"] <= tolerance or float(np.abs(p.gradient).max()) <= flat

        flat_start = np.concatenate([w.ravel() for w in start])
        history = []
        for epoch, here in enumerate(descend(evaluate, flat_start, done, epochs)):
            history.append((epoch, here.extra["mse"], float(np.abs(here.gradient).max()), done(here)))
    finally:
        rows.unpersist()
    schema = "epoch int, mse double, slope double, converged boolean"
    return _layers(here.x, start), df.sparkSession.createDataFrame(history, schema)


def _layers(x: np.ndarray, like: Weights) -> list[np.ndarray]:
    ends = np.cumsum([w.size for w in like])[:-1]
    return [part.reshape(w.shape) for part, w in zip(np.split(x, ends), like)]


def _gradient(rows: DataFrame, weights: Weights) -> tuple[np.ndarray, float, int]:
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, error, n = np.zeros(sum(w.size for w in weights)), 0.0, 0
        for batch in batches:
            x, _ = as_matrix(batch.column(0))
            if not len(x):
                continue
            y = batch.column(1).to_numpy(zero_copy_only=False)[:, None]
            layers = _forward(x, weights)
            gap = y - layers[-1]
            error += float((gap * gap).sum())
            n += len(x)
            delta = 2.0 * gap * layers[-1] * (1.0 - layers[-1])
            parts = []
            for depth in range(len(weights) - 1, -1, -1):
                parts.append(layers[depth].T @ delta)
                if depth:
                    delta = (delta @ weights[depth].T) * layers[depth] * (1.0 - layers[depth])
            total += np.concatenate([p.ravel() for p in reversed(parts)])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.arange(len(total) + 2, dtype=np.int32)),
                pa.array(np.concatenate([total, [error, float(n)]])),
            ],
            names=["pos", "g"],
        )

    summed = (
        rows.mapInArrow(partial, "pos int, g double").groupBy("pos").agg(F.sum("g").alias("g")).collect()
    )
    flat = np.zeros(len(summed))
    for r in summed:
        flat[r["pos"]] = r["g"]
    return flat[:-2], float(flat[-2]), int(flat[-1])
