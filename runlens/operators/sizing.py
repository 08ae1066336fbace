"""Joins of grouped results."""


from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attach(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    how: str = "left",
    null_safe: bool = True,
) -> DataFrame:
    """Join on ``keys``, keeping the left key columns.

    Null keys are equal to each other.  ``null_safe=False`` gives an ordinary
    equality, which can reuse how the sides are already partitioned.
    """
    if not keys:
        raise ValueError("attach needs at least one key")
    renamed = right.withColumnsRenamed({k: f"__right_{k}" for k in keys})
    condition = None
    for k in keys:
        own, other = left[f"`{k}`"], renamed[f"`__right_{k}`"]
        term = own.eqNullSafe(other) if null_safe else own == other
        condition = term if condition is None else condition & term
    return left.join(renamed, condition, how).drop(*[f"__right_{k}" for k in keys])


def attach_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a one-row aggregate to every row.

    The aggregate runs as a scalar subquery, so there is no join at all and a
    second row is an error by construction.
    """
    packed = one_row.select(F.struct(*[F.col(f"`{c}`") for c in one_row.columns]).alias("r"))
    return df.withColumn("__row", packed.scalar()).select(
        *[F.col(f"`{c}`") for c in df.columns],
        *[F.col("__row").getField(c).alias(c) for c in one_row.columns],
    )
