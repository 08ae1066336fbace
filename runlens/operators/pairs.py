"""Rows against a set of reference rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.functions.scalars import is_finite
from runlens.functions.vectors import kernel, squared_distance
from runlens.operators.sequences import distance
from runlens.operators.sizing import attach, attach_row
from runlens.session import staged

# A block of reference rows is held as one array next to a row.
BLOCK_ROWS = 2_000
# Pairs that a task of a cell join compares, the most tasks of one join, and rows in a slice of a cell's side.
PAIRS_PER_TASK = 4_000_000
MAX_TASKS = 4_000
SLICE_ROWS = 1_000


def with_reference_blocks(
    rows: DataFrame, reference: DataFrame, block_rows: int = BLOCK_ROWS, salts: int = 16
) -> DataFrame:
    """Adds ``__ref``, an array of reference rows of at most about ``block_rows``.

    The reference side is counted.  When it fits in one block it is read as a
    scalar subquery and no row of the large side moves.  Otherwise it is cut
    into blocks, each row meets each block through an equality join on the
    block number, and a salt spreads every block over several tasks.
    """
    ref = reference
    n = ref.count()
    packed = F.struct(*ref.columns)
    if n <= block_rows:
        return attach_row(rows, ref.agg(F.collect_list(packed).alias("__ref")))
    blocks = -(-n // block_rows)
    numbered = ref.select(
        F.pmod(F.xxhash64(*ref.columns), F.lit(blocks)).alias("__block"), packed.alias("__r")
    )
    arrays = numbered.groupBy("__block").agg(F.collect_list("__r").alias("__ref"))
    arrays = arrays.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    spread = rows.withColumns(
        {
            "__block": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))),
            "__salt": F.pmod(F.xxhash64(*rows.columns), F.lit(salts)),
        }
    )
    return attach(
        spread.withColumn("__block", F.col("__block").cast("bigint")),
        arrays.withColumn("__salt", F.col("__salt").cast("bigint")),
        ["__block", "__salt"],
        "inner",
    ).drop("__block", "__salt")


def all_pairs(
    rows: DataFrame,
    reference: DataFrame,
    value: Callable[[Column], Column],
    keep: Sequence[str],
    reference_id: str,
    name: str = "value",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """One row per (row, reference row) with ``value`` of the two.

    ``value`` gets the reference row as a struct and may use any column of the
    row.
    """
    blocks = with_reference_blocks(rows, reference, block_rows)
    pair = F.transform(
        "__ref", lambda r: F.struct(r[reference_id].alias(reference_id), value(r).alias(name))
    )
    return blocks.select(*keep, F.inline(pair))


def pairwise_distance(
    a: DataFrame, b: DataFrame, a_id: str = "i", b_id: str = "j", block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Euclidean distance between the points (x, y) of two sets."""
    gap = lambda r: distance(F.col("x"), F.col("y"), r["x"], r["y"])
    return all_pairs(a, b, gap, [a_id], b_id, "d", block_rows)


def pairs_within(a: DataFrame, b: DataFrame, radius: float, a_id: str = "i", b_id: str = "j") -> DataFrame:
    """(a_id, b_id, d) of the points (x, y) of two sets that are at most ``radius`` apart.

    Points lie in square cells as wide as the radius.  A point of ``b`` is sent to its
    cell and the eight around it, a point of ``a`` to its own only, so partners meet in
    an equality join and nothing else is compared.  Cells are counted first: one with
    many rows is cut into slices on both sides, and tasks follow the pairs, not the bytes.
    Points with a missing or infinite coordinate are near nothing.
    """
    if not 0 < radius < float("inf"):
        raise ValueError(f"radius must be positive and finite, not {radius}")
    # a little wider, so that rounding never puts partners two cells apart
    width = radius * (1 + 1e-6)
    cell = lambda c: F.floor(F.col(c) / width)
    around = lambda c: F.explode(F.sequence(cell(c) - 1, cell(c) + 1))
    points = lambda df, name, x, y: df.select(
        F.col(name), F.col("x").cast("double").alias(x), F.col("y").cast("double").alias(y)
    ).filter(is_finite(x) & is_finite(y))
    left = points(a, a_id, "__ax", "__ay").withColumns({"__cx": cell("__ax"), "__cy": cell("__ay")})
    right = points(b, b_id, "__bx", "__by").withColumn("__cx", around("__bx")).withColumn("__cy", around("__by"))
    cells = staged(_cell_slices(left, right), "cells")
    tasks = -(-(cells.agg(F.sum("__work")).first()[0] or 0) // PAIRS_PER_TASK)
    # a row falls into one slice of its side and meets all slices of the other
    one = lambda column, n: F.pmod(F.xxhash64(column), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    keys = ["__cx", "__cy", "__as", "__bs"]
    left = left.join(cells, keys[:2]).withColumn("__as", one(a_id, "__an")).withColumn("__bs", every("__bn"))
    right = right.join(cells, keys[:2]).withColumn("__as", every("__an")).withColumn("__bs", one(b_id, "__bn"))
    left, right = left.select(a_id, "__ax", "__ay", *keys), right.select(b_id, "__bx", "__by", *keys)
    if tasks > 1:
        # a stated number of tasks, else rows of few bytes that make many pairs end up in one
        tasks = min(tasks, MAX_TASKS)
        left, right = left.repartition(tasks, *keys), right.repartition(tasks, *keys).hint("merge")
    dx, dy = F.col("__ax") - F.col("__bx"), F.col("__ay") - F.col("__by")
    square = dx * dx + dy * dy
    return (
        left.join(right, keys)
        .filter(square <= float(radius) * float(radius))
        .select(a_id, b_id, F.sqrt(square).alias("d"))
    )


def _cell_slices(left: DataFrame, right: DataFrame) -> DataFrame:
    """(__cx, __cy, __work, __an, __bn): pairs compared in each cell, and the slices of either side."""
    count = lambda df, name: df.groupBy("__cx", "__cy").agg(F.count(F.lit(1)).alias(name))
    slices = lambda n: F.ceil(F.col(n) / SLICE_ROWS)
    return count(left, "__a").join(count(right, "__b"), ["__cx", "__cy"]).select(
        "__cx", "__cy", (F.col("__a") * F.col("__b")).alias("__work"), slices("__a").alias("__an"), slices("__b").alias("__bn")
    )


def vector_distance(
    a: DataFrame, b: DataFrame, a_id: str = "i", b_id: str = "j", block_rows: int = BLOCK_ROWS
) -> DataFrame:
    gap = lambda r: F.sqrt(squared_distance(F.col("vec"), r["vec"]))
    return all_pairs(a, b, gap, [a_id], b_id, "d", block_rows)


def kernel_matrix(
    a: DataFrame,
    b: DataFrame,
    name: str,
    degree: float = 1.0,
    coef0: float = 0.0,
    gamma: float = 1.0,
    a_id: str = "i",
    b_id: str = "j",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Kernel values of all rows of ``a`` against the rows of ``b``."""
    value = lambda r: kernel(name, F.col("vec"), r["vec"], degree, coef0, gamma)
    kernel(name, F.lit(None), F.lit(None), degree, coef0, gamma)  # checks the arguments
    return all_pairs(a, b, value, [a_id], b_id, "k", block_rows)


def kernel_svm_score(
    rows: DataFrame,
    support: DataFrame,
    b: float,
    name: str,
    row_id: str = "i",
    degree: float = 1.0,
    coef0: float = 0.0,
    gamma: float = 1.0,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Score and class of every row.

    ``support`` has ``vec``, ``alpha`` and ``y``.  A block is summed where it
    meets the row, so only one number per row and block is shuffled.
    """
    blocks = with_reference_blocks(rows, support, block_rows)
    part = F.aggregate(
        "__ref",
        F.lit(0.0),
        lambda acc, s: acc + s["alpha"] * s["y"] * kernel(name, F.col("vec"), s["vec"], degree, coef0, gamma),
    )
    score = blocks.select(row_id, part.alias("part")).groupBy(row_id).agg(
        (F.sum("part") + float(b)).alias("score")
    )
    return score.withColumn("predicted", F.when(F.col("score") > 0, 1).otherwise(-1))


def pairwise_interaction(
    entities: DataFrame,
    entity_id: str,
    softening: float,
    weight: float = 1.0,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Sum over all other entities of ``weight * mass * delta / (d2 + softening)^1.5``.

    Entities at one position pull alike and do not pull each other, so masses
    are summed per position first, the sums run over positions only, and every
    entity takes the result of its position.
    """
    positions = entities.groupBy("x", "y").agg(F.sum("mass").alias("mass"))
    blocks = with_reference_blocks(positions.select("x", "y"), positions, block_rows)

    def add(acc: Column, p: Column) -> Column:
        dx, dy = p["x"] - F.col("x"), p["y"] - F.col("y")
        d2 = dx * dx + dy * dy
        pull = F.when(d2 > 0, p["mass"] * weight / F.pow(d2 + softening, F.lit(1.5))).otherwise(0.0)
        return F.struct((acc["fx"] + pull * dx).alias("fx"), (acc["fy"] + pull * dy).alias("fy"))

    zero = F.struct(F.lit(0.0).alias("fx"), F.lit(0.0).alias("fy"))
    force = blocks.select("x", "y", F.aggregate("__ref", zero, add).alias("f"))
    per_position = force.groupBy("x", "y").agg(F.sum("f.fx").alias("fx"), F.sum("f.fy").alias("fy"))
    return attach(entities.select(entity_id, "x", "y"), per_position, ["x", "y"]).select(
        entity_id, "fx", "fy"
    )
