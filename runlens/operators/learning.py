"""Discriminant analysis, scaling, accuracy, linear SVM and sampling."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.functions.scalars import draw, no_nan
from runlens.operators.clustering import as_matrix
from runlens.operators.optimise import Point, descend
from runlens.operators.sizing import attach_row


# -- one-feature linear discriminant ----------------------------------------
def lda_fit(df: DataFrame, label: str, x: str) -> DataFrame:
    """Per class: size, mean, prior and the variance pooled over all classes."""
    v = no_nan(F.col(x).cast("double"))
    classes = (
        df.filter(F.col(label).isNotNull() & v.isNotNull())
        .groupBy(label)
        .agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.var_samp(v).alias("__var"))
    )
    within = F.coalesce(F.col("__var"), F.lit(0.0)) * (F.col("n") - 1)
    total = classes.agg(
        F.sum("n").alias("__n"),
        F.try_divide(F.sum(within), F.sum("n") - F.count(F.lit(1))).alias("variance"),
    )
    return attach_row(classes, total).select(
        label, "n", "mean", (F.col("n") / F.col("__n")).alias("prior"), "variance"
    )


def lda_predict(df: DataFrame, model: DataFrame, label: str, x: str) -> DataFrame:
    """Adds ``predicted``; the lowest class wins among equal scores.

    Without variance inside the classes nothing can be predicted: null.

    The model has one row per class and travels as one array, so rows are
    neither joined nor multiplied.
    """
    packed = model.agg(
        F.array_sort(F.collect_list(F.struct(label, "mean", "variance", "prior"))).alias("__model")
    )
    v = F.col(x).cast("double")

    def score(m, i):
        pull = F.try_divide(v * m["mean"], m["variance"]) - F.try_divide(m["mean"] * m["mean"], m["variance"] * 2)
        value = pull + F.ln(m["prior"])
        return F.struct(value.alias("score"), (-i).alias("order"), m[label].alias("label"))

    best = F.array_max(F.transform("__model", score))
    return (
        attach_row(df, packed)
        .withColumn("predicted", F.when(v.isNotNull() & best["score"].isNotNull(), best["label"]))
        .drop("__model")
    )


def accuracy(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Rows, correct and incorrect predictions and the percentage correct."""
    same = F.coalesce(F.col(actual) == F.col(predicted), F.lit(False))
    return df.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(same).alias("correct"),
        F.count_if(~same).alias("incorrect"),
        (F.avg(same.cast("double")) * 100).alias("pct"),
    )


# -- scaling ----------------------------------------------------------------
def minmax_scale(train: DataFrame, df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Scale ``df`` by the ranges of ``train``; a feature without range gives null."""
    ranges = train.agg(
        *[F.min(c).alias(f"__min_{c}") for c in columns], *[F.max(c).alias(f"__max_{c}") for c in columns]
    )
    low, high = (lambda c: F.col(f"__min_{c}")), (lambda c: F.col(f"__max_{c}"))
    return (
        attach_row(df, ranges)
        .withColumns({c: F.try_divide(F.col(c) - low(c), high(c) - low(c)) for c in columns})
        .drop(*ranges.columns)
    )


# -- linear SVM -------------------------------------------------------------
def linear_svm_fit(
    df: DataFrame, label: str, columns: Sequence[str], cost: float = 1.0, max_iter: int = 2000, tolerance: float = 1e-3
) -> DataFrame:
    """Coefficients of the max-margin classifier on labels -1 and 1.

    The objective is half the squared length of the weights, the intercept being one
    of them, plus ``cost`` times the sum of max(0, 1 - margin) over all complete rows.
    The corner of the loss is rounded; the rounded objective is minimised by quasi-Newton
    steps, and the rounding shrinks until the duality gap, which bounds the distance to
    the true optimum, is below ``tolerance`` of the objective.  The gap needs no state
    for each row: the slopes of the rounded loss are feasible multipliers, and their
    sums come from the same job as the gradient.

    ``objective`` and ``gap`` are those of the coefficients returned, ``steps`` the
    quasi-Newton steps, and ``converged`` whether the gap got there in ``max_iter``.
    """
    names = list(columns)
    rows = df.select(
        F.array(*[F.col(c).cast("double") for c in names], F.lit(1.0)).alias("vec"),
        F.when(F.col(label) > 0, 1.0).when(F.col(label) <= 0, -1.0).alias("y"),
    ).filter(F.col("y").isNotNull() & F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v)))
    rows = rows.persist()
    try:
        n = rows.count()
        if n == 0:
            raise ValueError("no complete rows to fit on")
        best, width, steps = None, 1.0, 0
        x = np.zeros(len(names) + 1)
        while steps < max_iter:
            def evaluate(w, width=width):
                return _svm_point(rows, w, cost, width)

            def close(p, width=width):
                # a row's rounding is cost * width / 2 at most; solving much finer than that is waste
                return p.extra["gap"] <= tolerance * p.extra["objective"] or np.abs(p.gradient).max() <= 1e-2 * tolerance * width * cost * n

            for k, here in enumerate(descend(evaluate, x, close, max_iter - steps)):
                if best is None or here.extra["gap"] < best.extra["gap"]:
                    best = here
            steps, x, width = steps + max(k, 1), here.x, width / 4
            if best.extra["gap"] <= tolerance * best.extra["objective"] or width < 1e-9:
                break
    finally:
        rows.unpersist()
    objective, gap = best.extra["objective"], best.extra["gap"]
    terms = [
        (t, float(w), objective, gap, steps, bool(gap <= tolerance * objective)) for t, w in zip([*names, "(intercept)"], best.x)
    ]
    schema = "term string, weight double, objective double, gap double, steps int, converged boolean"
    return df.sparkSession.createDataFrame(terms, schema)


def _svm_point(rows: DataFrame, w: np.ndarray, cost: float, width: float) -> Point:
    """The rounded objective with its gradient, the true objective and the duality gap at ``w``."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(w) + 3)
        for batch in batches:
            x, _ = as_matrix(batch.column(0))
            if not len(x):
                continue
            y = batch.column(1).to_numpy(zero_copy_only=False)
            short = 1.0 - y * (x @ w)
            slope = np.clip(short / width, 0.0, 1.0)
            total[:-3] += (slope * y) @ x
            total[-3] += (slope * short - slope * slope * width / 2).sum()
            total[-2] += np.maximum(short, 0.0).sum()
            total[-1] += slope.sum()
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["pos", "v"]
        )

    summed = rows.mapInArrow(partial, "pos int, v double").groupBy("pos").agg(F.sum("v").alias("v")).collect()
    total = np.zeros(len(w) + 3)
    for r in summed:
        total[r["pos"]] = r["v"]
    total *= cost
    pull, length = total[:-3], float(w @ w) / 2
    objective = length + total[-2]
    dual = total[-1] - float(pull @ pull) / 2
    return Point(w, length + total[-3], w - pull, {"objective": float(objective), "gap": float(objective - dual)})


def linear_svm_predict(df: DataFrame, coefficients: Sequence[tuple[str, float]]) -> DataFrame:
    """Classes -1 and 1 from fitted coefficients, as one expression."""
    score = sum(
        (F.col(t) * w if t != "(intercept)" else F.lit(w)) for t, w in coefficients
    )
    return df.withColumn("predicted", F.when(score > 0, 1).otherwise(-1))


# -- sampling ---------------------------------------------------------------
def normal_sample(
    rows: DataFrame, key: str, mean: float, sd: float, label: int, seed: int
) -> DataFrame:
    """One normal value per row of a class; every class should get its own seed.

    Two digests of (seed, key) make the value (Box-Muller), so it does not change
    with the partitions or when a lost task runs again.
    """
    radius, angle = (draw(F.lit(seed), F.lit(part), F.col(key)) for part in ("r", "a"))
    z = F.sqrt(F.ln(radius) * -2) * F.cos(angle * 2 * math.pi)
    return rows.select(F.lit(label).alias("label"), key, (z * sd + mean).alias("x"))
