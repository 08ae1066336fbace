"""Convolution and pooling on long grids (id, r, c, value)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.functions.vectors import sigmoid


def conv2d_grid(
    grid: DataFrame,
    kernel: Sequence[Sequence[float]],
    rows: int,
    cols: int,
    stride: int = 1,
    bias: float = 0.0,
) -> DataFrame:
    """Valid convolution, minus a bias, through the sigmoid.

    ``rows`` and ``cols`` are the grid's size; cells without a row count as
    zero.  Each cell adds to the outputs that cover it, and sums are combined
    before the shuffle.
    """
    height, width = len(kernel), len(kernel[0])
    taps = F.array(
        *[
            F.struct(F.lit(i).alias("dr"), F.lit(j).alias("dc"), F.lit(float(w)).alias("w"))
            for i, line in enumerate(kernel)
            for j, w in enumerate(line)
        ]
    )
    top, left = F.col("r") - F.col("dr"), F.col("c") - F.col("dc")
    on_grid = (
        (top >= 0)
        & (left >= 0)
        & (top <= rows - height)
        & (left <= cols - width)
        & (top % stride == 0)
        & (left % stride == 0)
    )
    nets = (
        grid.select("id", "r", "c", "value", F.inline(taps))
        .filter(on_grid)
        .select(
            "id",
            F.expr(f"(r - dr) div {stride}").alias("out_r"),
            F.expr(f"(c - dc) div {stride}").alias("out_c"),
            (F.col("value") * F.col("w")).alias("net"),
        )
    )
    every = _places(grid, (rows - height) // stride + 1, (cols - width) // stride + 1).withColumn("net", F.lit(0.0))
    return (
        nets.unionByName(every)
        .groupBy("id", "out_r", "out_c")
        .agg(F.sum("net").alias("net"))
        .select("id", "out_r", "out_c", sigmoid(F.col("net") - bias).alias("value"))
    )


def _places(grid: DataFrame, rows: int, cols: int) -> DataFrame:
    """(id, out_r, out_c): every place of the output of every grid."""
    line = lambda n: F.sequence(F.lit(0), F.lit(n - 1)) if n > 0 else F.array().cast("array<int>")
    return (
        grid.select("id")
        .distinct()
        .select("id", F.explode(line(rows)).alias("out_r"))
        .select("id", F.col("out_r").cast("bigint"), F.explode(line(cols)).alias("out_c"))
        .select("id", "out_r", F.col("out_c").cast("bigint"))
    )


def pool_grid(grid: DataFrame, size: int, rows: int, cols: int, how: str = "average") -> DataFrame:
    """Average or maximum over blocks that do not overlap.

    ``rows`` and ``cols`` are the grid's size; cells without a row count as zero.
    Blocks at the lower and right edge have the cells that lie on the grid.
    """
    if how not in ("average", "max"):
        raise ValueError("how must be 'average' or 'max'")
    block = lambda c: F.expr(f"{c} div {size}").cast("bigint")
    on_grid = (F.col("r") >= 0) & (F.col("c") >= 0) & (F.col("r") < rows) & (F.col("c") < cols)
    cells = grid.filter(on_grid).select("id", block("r").alias("out_r"), block("c").alias("out_c"), "value")
    every = _places(grid, -(-rows // size), -(-cols // size)).withColumn("value", F.lit(None).cast("double"))
    sums = (
        cells.unionByName(every)
        .groupBy("id", "out_r", "out_c")
        .agg(F.sum("value").alias("sum"), F.max("value").alias("max"), F.count("value").alias("n"))
    )
    extent = lambda at, n: F.least(F.lit(size), n - F.col(at) * size)
    in_block = extent("out_r", rows) * extent("out_c", cols)
    highest = F.when(F.col("n") < in_block, F.greatest(F.coalesce("max", F.lit(0.0)), F.lit(0.0))).otherwise(F.col("max"))
    value = F.coalesce("sum", F.lit(0.0)) / in_block if how == "average" else highest
    return sums.select("id", "out_r", "out_c", value.alias("value"))
