"""Vector arithmetic on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def squared_distance(a: Column, b: Column) -> Column:
    return _sum(
        F.zip_with(
            a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))
        )
    )


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


# The accepted kernel names.
KERNELS = ("linear", "poly", "rbf")


def kernel(name: str, a: Column, b: Column, degree: float = 1.0, coef0: float = 0.0, gamma: float = 1.0) -> Column:
    """Kernel value of two vectors."""
    if name not in KERNELS:
        raise ValueError(f"unknown kernel {name!r}; expected one of {', '.join(KERNELS)}")
    if name == "linear":
        return dot(a, b) + coef0
    if name == "poly":
        return F.pow(dot(a, b) * gamma + coef0, F.lit(float(degree)))
    if gamma < 0:
        raise ValueError("the rbf kernel needs gamma >= 0")
    return F.exp(squared_distance(a, b) * (-gamma))
