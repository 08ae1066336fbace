"""Neighbours in order, without putting a large group on one task.

Groups are cut into chunks of the order key.  Inside a chunk a window finds the
neighbour; the last row of a chunk takes the first row of the next chunk, found
on a table with one row per chunk.
"""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from runlens.functions.scalars import draw
from runlens.operators.sizing import attach, attach_row
from runlens.session import staged


def with_next(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    columns: Sequence[str],
    chunk: Column,
    name: str = "next",
    first: str | None = None,
) -> DataFrame:
    """Adds a struct with the following row's ``columns``; null for the last row.

    ``first`` names a second struct with the columns of the group's first row.
    ``chunk`` must not decrease along ``order``.
    """
    return _next_by_chunk(df, list(keys), order, columns, chunk, name, first)


def _next_by_chunk(
    df: DataFrame,
    keys: list[str],
    order: Sequence[str],
    columns: Sequence[str],
    chunk: Column,
    name: str,
    first: str | None,
) -> DataFrame:
    cells = df.withColumn("__chunk", chunk)
    head = F.struct(*columns)
    by_chunk = W.partitionBy(*keys).orderBy("__chunk")
    found = {"__next_head": F.lead("__head").over(by_chunk)}
    if first:
        found[first] = F.first("__head").over(by_chunk)
    heads = (
        cells.groupBy(*keys, "__chunk")
        .agg(F.min_by(head, F.struct(*order)).alias("__head"))
        .withColumns(found)
        .drop("__head")
    )
    inside = F.lead(head).over(W.partitionBy(*keys, "__chunk").orderBy(*order))
    return (
        attach(cells.withColumn(name, inside), heads, [*keys, "__chunk"])
        .withColumn(name, F.coalesce(name, "__next_head"))
        .drop("__chunk", "__next_head")
    )


def distance(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0))


# -- routes -----------------------------------------------------------------
def route_legs(
    stops: DataFrame,
    route: str,
    order: Sequence[str],
    chunk: Column,
    closed: bool = True,
) -> DataFrame:
    """One row per leg with both ends and its length.

    A closed route also has the leg from its last stop back to its first.
    """
    columns = ["node", "x", "y", *order]
    linked = with_next(
        stops, [route], order, columns, chunk, first="first" if closed else None
    )
    if closed:
        alone = F.lit(True)
        for c in order:
            alone &= F.col(c).eqNullSafe(F.col("first").getField(c))
        # the last stop leads to the first one, unless it is the only stop
        linked = linked.withColumn("next", F.coalesce("next", F.when(~alone, F.col("first"))))
    legs = linked.filter(F.col("next").isNotNull())
    return legs.select(
        route,
        F.col("node").alias("from_node"),
        F.col("next.node").alias("to_node"),
        distance(F.col("x"), F.col("y"), F.col("next.x"), F.col("next.y")).alias("length"),
    )


def route_length(legs: DataFrame, route: str) -> DataFrame:
    return legs.groupBy(route).agg(F.count(F.lit(1)).alias("n_legs"), F.sum("length").alias("length"))


def shortest_route(lengths: DataFrame, route: str) -> DataFrame:
    """The shortest route, the lowest id among equals."""
    return lengths.agg(
        F.min(F.struct("length", route)).alias("m")
    ).select(F.col(f"m.{route}").alias(route), F.col("m.length").alias("length"))


def edge_weights(
    edges: DataFrame, legs: DataFrame, lengths: DataFrame, route: str, decay: float, q: float
) -> DataFrame:
    """Decay every edge, then add ``q / length`` per travelled leg, both ways alike."""
    low, high = F.least("from_node", "to_node"), F.greatest("from_node", "to_node")
    # legs per route and edge are summed first, so few rows meet the lengths
    travelled = legs.groupBy(route, low.alias("a"), high.alias("b")).agg(
        F.count(F.lit(1)).alias("times")
    )
    added = (
        attach(travelled, lengths.select(route, "length"), [route], "inner", null_safe=False)
        .groupBy("a", "b")
        .agg(F.sum(F.try_divide(F.lit(float(q)), F.col("length")) * F.col("times")).alias("added"))
    )
    keyed = edges.withColumns({"a": F.least("from_node", "to_node"), "b": F.greatest("from_node", "to_node")})
    return attach(keyed, added, ["a", "b"]).select(
        "from_node",
        "to_node",
        (F.col("weight") * decay + F.coalesce("added", F.lit(0.0))).alias("weight"),
    )


def transition_probability(
    candidates: DataFrame, source: str, target: str, alpha: float = 1.0, beta: float = 5.0
) -> DataFrame:
    """Attraction ``weight^alpha * (1/distance)^beta``, normalised per source."""
    score = F.pow("weight", F.lit(float(alpha))) * F.pow(
        F.try_divide(F.lit(1.0), F.col("distance")), F.lit(float(beta))
    )
    scored = candidates.select(source, target, score.alias("score"))
    totals = scored.groupBy(source).agg(F.sum("score").alias("total"))
    return attach(scored, totals, [source]).select(
        source, target, F.try_divide("score", "total").alias("prob")
    )


def weighted_pick(probabilities: DataFrame, source: str, target: str, seed: int) -> DataFrame:
    """One target per source with its probability as weight; repeatable by seed.

    The largest ``ln(u) / weight`` wins, ``u`` being drawn from the row, so a
    pick is an ordinary aggregate and does not depend on how rows are spread.
    """
    u = draw(F.lit(seed), F.col(source), F.col(target))
    key = F.when(F.col("prob") > 0, F.ln(u) / F.col("prob"))
    return probabilities.groupBy(source).agg(F.max_by(target, key).alias(target))


# -- bounds among breakpoints -----------------------------------------------
def neighbour_bounds(values: DataFrame, value: str, breakpoints: DataFrame, point: str) -> DataFrame:
    """Adds the greatest breakpoint <= value and the smallest >= value.

    Values and breakpoints are put in one order and cut into ranges by a sample of
    both, so that a range has as many rows wherever they lie; equal values may
    fall into several ranges.  The ranges are written.  Inside one, windows look
    both ways; what lies beyond comes from the first and last breakpoint of the
    other ranges, of which there are as many as tasks.  A null value has no bounds.
    """
    points = breakpoints.select(F.col(point).cast("double").alias("__point")).filter(F.col("__point").isNotNull()).distinct()
    rows = (
        values.withColumn("__v", F.col(value).cast("double"))
        .unionByName(points.withColumn("__v", F.col("__point")), allowMissingColumns=True)
        .withColumn("__tie", F.monotonically_increasing_id())
        .repartitionByRange("__v", "__tie")
        .withColumn("__range", F.spark_partition_id())
        .drop("__tie")
    )
    rows = staged(rows, "ranges")
    known = F.col("__v").isNotNull()
    # each window grows by a row at a time; one that shrinks would be read again for every row
    at_or_below = W.partitionBy("__range").orderBy("__v").rangeBetween(W.unboundedPreceding, W.currentRow)
    at_or_above = W.partitionBy("__range").orderBy(F.desc("__v")).rangeBetween(W.unboundedPreceding, W.currentRow)
    here = {"__low": F.max("__point").over(at_or_below), "__high": F.min("__point").over(at_or_above)}
    # ties with a breakpoint of a neighbouring range come from there, others too
    bounds = {
        "lower": F.when(known, F.greatest("__low", "__before")),
        "upper": F.when(known, F.least("__high", "__after")),
    }
    return (
        attach(rows.withColumns(here).filter(F.col("__point").isNull()), _beside(rows), ["__range"])
        .withColumns(bounds)
        .select(*[F.col(f"`{c}`") for c in values.columns], "lower", "upper")
    )


def _beside(rows: DataFrame) -> DataFrame:
    """(__range, __before, __after): the nearest breakpoints outside of each range, one row a range."""
    ends = rows.groupBy("__range").agg(F.min("__point").alias("low"), F.max("__point").alias("high"))
    packed = ends.agg(F.collect_list(F.struct("__range", "low", "high")).alias("__ends"))
    at = F.col("__range")
    return attach_row(ends, packed).select(
        "__range",
        F.array_max(F.transform(F.filter("__ends", lambda e: e["__range"] < at), lambda e: e["high"])).alias("__before"),
        F.array_min(F.transform(F.filter("__ends", lambda e: e["__range"] > at), lambda e: e["low"])).alias("__after"),
    )


def divisible_by_one_bound(df: DataFrame, value: str) -> DataFrame:
    """Values divisible by exactly one of the roots of their two bounds; a missing bound or zero divides nothing."""
    root = lambda c: F.nullif(F.round(F.sqrt(c)).cast("bigint"), F.lit(0).cast("bigint"))
    divides = lambda c: F.coalesce(F.col(value) % root(c) == 0, F.lit(False))
    return df.filter(divides("lower") != divides("upper"))


#: Multiples that one row strikes out.
_STRUCK = 10_000


def primes_upto(numbers: DataFrame, column: str) -> DataFrame:
    """The numbers from 2 on that no smaller one of them divides: the primes, if none is missing.

    Multiples of a number are struck out in blocks, which are dealt over tasks.
    """
    own = numbers.select(F.col(f"`{column}`").cast("bigint").alias("__n")).filter(F.col("__n") >= 2).distinct()
    own = staged(own, "numbers")
    last = F.expr(f"(__top div __n - 2) div {_STRUCK}")  # block of the last multiple; the first is twice the number
    blocks = (
        attach_row(own, own.agg(F.max("__n").alias("__top")))
        .filter(F.expr("__top div __n >= 2"))
        .withColumn("__block", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
        .repartition("__n", "__block")
    )
    start = F.col("__block") * _STRUCK + 2
    end = F.least(start + (_STRUCK - 1), F.expr("__top div __n"))
    n = F.col("__n")
    multiples = blocks.select(F.explode(F.sequence(start * n, end * n, n)).alias("__n")).distinct()
    return own.join(multiples, "__n", "left_anti").select(F.col("__n").alias(column))


# -- ratios -----------------------------------------------------------------
def gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor; 92 steps suffice for any two 64-bit numbers."""
    start = F.struct(F.abs(a).cast("bigint").alias("a"), F.abs(b).cast("bigint").alias("b"))
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(
        F.struct(s["b"].alias("a"), (s["a"] % F.nullif(s["b"], F.lit(0))).alias("b"))
    )
    return F.aggregate(F.sequence(F.lit(1), F.lit(92)), start, step)["a"]


def canonical_ratio_distinct(df: DataFrame, num: str, den: str) -> DataFrame:
    """Distinct ratios in lowest terms.  Equal pairs are removed before reducing."""
    pairs = (
        df.select(F.col(num).cast("bigint").alias("num"), F.col(den).cast("bigint").alias("den"))
        .filter(F.col("den") != 0)
        .distinct()
    )
    g = gcd(F.col("num"), F.col("den")) * F.signum(F.col("den")).cast("bigint")
    return pairs.withColumn("__g", g).select(
        F.expr("num div __g").alias("num"), F.expr("den div __g").alias("den")
    ).distinct()


_FRACTIONS = "part int, num string, den string, n bigint"
_PARTS = (64, 8, 1)


def _add_fractions(batches):
    """One fraction from all of a task's; integers have no size limit here."""
    total, n = Fraction(0), 0
    for batch in batches:
        for num, den, count in zip(*(batch.column(c).to_pylist() for c in ("num", "den", "n"))):
            total += Fraction(int(num), int(den))
            n += count
    yield pa.RecordBatch.from_pydict(
        {"part": [0], "num": [str(total.numerator)], "den": [str(total.denominator)], "n": [n]},
        pa.schema([("part", pa.int32()), ("num", pa.string()), ("den", pa.string()), ("n", pa.int64())]),
    )


def ratio_total(ratios: DataFrame) -> DataFrame:
    """Exact sum of ratios in lowest terms, with their number.

    Numerators are summed per denominator; fractions are added in tasks and
    merged in a tree, whatever their number.
    """
    text = lambda c: F.col(c).cast("string").alias(c)
    parts = (
        ratios.groupBy("den")
        .agg(F.sum(F.col("num").cast("decimal(38,0)")).alias("num"), F.count(F.lit(1)).alias("n"))
        .select(F.pmod(F.xxhash64("den"), F.lit(_PARTS[0])).cast("int").alias("part"), text("num"), text("den"), "n")
    )
    nothing = parts.sparkSession.createDataFrame([(0, "0", "1", 0)], _FRACTIONS)  # no ratios add up to 0
    parts = parts.unionByName(nothing)
    for k, size in enumerate(_PARTS):
        parts = parts.repartition(size, "part" if k == 0 else F.rand(k)).mapInArrow(_add_fractions, _FRACTIONS)
    value = F.col("num").cast("double") / F.col("den").cast("double")
    return parts.select("num", "den", value.alias("total"), F.col("n").alias("n_ratios"))


# -- power over time --------------------------------------------------------
def energy_integral(
    samples: DataFrame,
    keys: Sequence[str],
    time: str,
    power: str,
    width_seconds: int = 3600,
) -> DataFrame:
    """Trapezoid of power over time per run (an added cross-check of the log value)."""
    seconds = F.unix_micros(F.col(time).cast("timestamp")) / 1e6
    rows = samples.select(*keys, seconds.alias("t"), F.col(power).alias("w")).filter(
        F.col("t").isNotNull() & F.col("w").isNotNull()
    )
    chunk = F.floor(F.col("t") / width_seconds)
    linked = with_next(rows, keys, ["t", "w"], ["t", "w"], chunk)
    area = (F.col("next.t") - F.col("t")) * (F.col("next.w") + F.col("w")) / 2
    return linked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_samples"), F.coalesce(F.sum(area), F.lit(0.0)).alias("joules")
    )

