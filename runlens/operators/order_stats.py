"""Exact quantiles, ranks and moments for groups of any size, from one scan.

The input is scanned once and reduced, first in the map tasks, to the distinct
values of each group with their counts.  That reduced table is written, and
everything else reads it:

- A value lies in a *cell* that depends on nothing else: ``STEPS`` equal steps
  between one power of two and the next.  One row for each cell holds its count,
  its distinct values, its ends and its sum; moments are summed around the mean
  that follows.
- Counts per cell say which cell holds a wanted rank.  A cell with more than
  ``LIMIT`` distinct values is cut into ``SPLIT`` equal steps between its own
  ends, counted again, and so on until the cells that matter are small: a radix
  selection that follows the data.  Only then are values sorted, those of one
  small cell at a time.

So a day of timestamps, which lies in a single step of any fixed scale, is
spread like any other range.  Choosing the cells to cut needs their counts, so
jobs run while such a result is built; the input itself isn't read again.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from runlens.functions.scalars import no_nan
from runlens.session import staged

#: Steps of a fine bucket between one power of two and the next.
CELLS = 1 << 14
#: Those of a first, coarse cell.
STEPS = 64
#: Distinct values that one task may sort together.
LIMIT = 1_000
#: Parts that a cell with more of them is cut into.
SPLIT = 1_024
#: Above the exponents of all doubles.
_EXPONENTS = 1_100
_HUGE = 1.7e308


@dataclass(frozen=True)
class Tally:
    """A count that comes from the same scan: ``rows``, rows ``where`` a condition holds, ``distinct`` values."""

    kind: str
    what: str = ""

    def column(self) -> Column:
        if self.kind == "rows":
            return F.count(F.lit(1))
        return F.count_if(F.expr(self.what)) if self.kind == "where" else F.count_distinct(F.col(self.what))


ROWS = Tally("rows")


def quantile_name(column: str, p: float) -> str:
    return f"{column}__q{p:g}".replace(".", "_")


def bucket_of(t: Column, low: Column, high: Column, buckets: int) -> Column:
    """Order-preserving bucket of ``t`` between two bounds."""
    share = F.coalesce(F.try_divide(t - low, high - low), F.lit(0.0))
    share = F.when(F.isnan(share), F.when(t == low, 0.0).otherwise(1.0)).otherwise(share)
    return F.least(F.floor(share * buckets), F.lit(buckets - 1)).cast("int")


def value_bucket(v: Column, steps: int | None = None) -> Column:
    """Order-preserving bucket of a number, whatever the others are; null stays null.

    A rounded logarithm may name the power of two beside a value's own; the step
    is clamped then, so that order is kept.
    """
    steps = CELLS if steps is None else steps
    size = F.least(F.abs(v), F.lit(_HUGE))
    exponent = F.floor(F.log2(size))
    step = F.floor((size / F.pow(F.lit(2.0), exponent) - 1) * steps)
    step = F.greatest(F.lit(0), F.least(step, F.lit(steps - 1)))
    number = (exponent + _EXPONENTS) * steps + step + 1
    return F.when(v == 0, F.lit(0)).when(v < 0, -number).otherwise(number).cast("bigint")


def _group(keys: Sequence[str]) -> Column:
    """The group as one struct, which is never null itself: null keys are equal to each other."""
    return F.struct(F.lit(0).alias("__all"), *[F.col(f"`{k}`").alias(k) for k in keys])


def _keys_of(keys: Sequence[str]) -> list[Column]:
    return [F.col("__g").getField(k).alias(k) for k in keys]


# -- one scan ---------------------------------------------------------------
def _reduced(df: DataFrame, keys: Sequence[str], columns: Sequence[str], exact: set[str], tallies: Sequence[Tally]) -> DataFrame:
    """(__g, m, base, cell, v, c, total, lo, hi): the written counts of one scan.

    ``m`` numbers the columns from 0; a column outside ``exact`` keeps no values,
    only its cells.  -1 counts the rows, and tallies follow downwards.
    """

    # columns side by side, then one row for each: Spark expands those in place, without arrays
    wide, texts = {"-1": F.lit(0.0)}, {}
    for i, c in enumerate(columns):
        wide[str(i)] = no_nan(F.col(f"`{c}`").cast("double"))
    for j, t in enumerate(tallies):
        if t.kind == "distinct":
            texts[-2 - j] = F.col(f"`{t.what}`").cast("string")
        if t.kind != "rows":
            there = texts[-2 - j].isNotNull() if t.kind == "distinct" else F.expr(t.what)
            wide[str(-2 - j)] = F.when(there, 0.0)
    flat = [F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(keys)]
    by = [f"__k{i}" for i in range(len(keys))]
    side = df.select(*flat, *[t.alias(f"__t{m}") for m, t in texts.items()], *[w.alias(n) for n, w in wide.items()])
    long = side.unpivot([*by, *[f"`__t{m}`" for m in texts]], [f"`{n}`" for n in wide], "m", "w").where("w IS NOT NULL")
    kept = F.col("m").isin([str(i) for i, c in enumerate(columns) if c in exact])
    text = F.lit(None).cast("string")
    for m in texts:
        text = F.when(F.col("m") == str(m), F.col(f"`__t{m}`")).otherwise(text)
    long = long.select(
        *by, F.col("m").cast("int").alias("m"), "w", value_bucket(F.col("w"), STEPS).alias("cell"),
        F.when(kept, F.col("w")).alias("v"), text.alias("s"),
    )
    loose = {"total": F.sum("w"), "lo": F.min("w"), "hi": F.max("w")} if exact != set(columns) else {}
    if any(t.kind == "distinct" for t in tallies):
        by.append("s")
    counts = long.groupBy(*by, "m", "cell", "v").agg(F.count(F.lit(1)).alias("c"), *[c.alias(n) for n, c in loose.items()])
    group = F.struct(F.lit(0).alias("__all"), *[F.col(f"__k{i}").alias(k) for i, k in enumerate(keys)])
    ends = {n: F.lit(None).cast("double") for n in ("total", "lo", "hi") if n not in loose}
    return staged(
        counts.withColumns({"__g": group, "base": F.lit(0).cast("bigint"), **ends}).drop(*[f"__k{i}" for i in range(len(keys))], "s"),
        "values",
    )


def _nodes(counts: DataFrame) -> DataFrame:
    """One written row for each cell: its counts, ends and total, the rows before it, and the size of its group."""
    whole = W.partitionBy("__g", "m")
    cells = counts.groupBy("__g", "m", "base", "cell").agg(
        F.sum("c").alias("c"),
        F.count(F.lit(1)).alias("d"),
        F.min(F.coalesce("v", "lo")).alias("lo"),
        F.max(F.coalesce("v", "hi")).alias("hi"),
        F.sum(F.coalesce(F.col("v") * F.col("c"), "total")).alias("total"),
    )
    return staged(cells.withColumns({"n": F.sum("c").over(whole), "before": _before()}), "cells")


def _before() -> Column:
    """Rows of a group in the cells below, given those before all of them."""
    upto = W.partitionBy("__g", "m", "base").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    return F.col("base") + F.coalesce(F.sum("c").over(upto), F.lit(0).cast("bigint"))


def _selected(counts: DataFrame, nodes: DataFrame, ranks: Callable[[Column], Sequence[Column]]) -> DataFrame:
    """(__g, m, v, ties, before, n): the distinct values beside the wanted ranks, which follow from the size ``n``.

    Cells that hold no wanted rank are left out; of the others, those with too
    many values are cut again.
    """
    found = []
    while True:
        here = [(r >= F.col("before")) & (r < F.col("before") + F.col("c")) for r in ranks(F.col("n"))]
        wanted = here[0]
        for h in here[1:]:
            wanted = wanted | h
        hit = nodes.where((F.col("m") >= 0) & wanted)
        key = ["__g", "m", "base", "cell"]
        # a cell of one value needs no look at the values
        found.append(hit.where("d = 1").select("__g", "m", F.col("lo").alias("v"), F.col("c").alias("ties"), "before", "n"))
        small = counts.select(*key, "v", F.col("c").alias("ties")).join(
            hit.where(f"d > 1 AND d <= {LIMIT}").select(*key, "before", "n"), key
        )
        inside = W.partitionBy(*key).orderBy("v").rowsBetween(W.unboundedPreceding, -1)
        found.append(
            small.select(
                "__g", "m", "v", "ties", (F.col("before") + F.coalesce(F.sum("ties").over(inside), F.lit(0))).alias("before"), "n"
            )
        )
        large = hit.where(f"d > {LIMIT}").select(*key, "lo", "hi", "before", "n")
        if not large.agg(F.count(F.lit(1))).first()[0]:
            break
        step = bucket_of(F.col("v"), F.col("lo"), F.col("hi"), SPLIT).cast("bigint")
        counts = staged(
            counts.select(*key, "v", "c").join(large, key).select(
                "__g", "m", F.col("before").alias("base"), step.alias("cell"), "v", "c", "n"
            ),
            "values",
        )
        cells = counts.groupBy("__g", "m", "base", "cell").agg(
            F.sum("c").alias("c"), F.count(F.lit(1)).alias("d"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.max("n").alias("n")
        )
        nodes = staged(cells.withColumn("before", _before()), "cells")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _quantile_ranks(probs: Sequence[float]) -> Callable[[Column], list[Column]]:
    def ranks(n: Column) -> list[Column]:
        return [end((n - 1) * F.lit(float(p))) for p in probs for end in (F.floor, F.ceil)]

    return ranks


def _quantile_rows(counts: DataFrame, nodes: DataFrame, probs: Sequence[float]) -> DataFrame:
    """(__g, m, q): an array of quantiles for each group and column, linear between two ranks."""
    near = _selected(counts, nodes, _quantile_ranks(probs))
    picks, out = [], []
    for j, p in enumerate(probs):
        at = (F.col("n") - 1) * F.lit(float(p))
        for end, rank in ((0, F.floor(at)), (1, F.ceil(at))):
            holds = (rank >= F.col("before")) & (rank < F.col("before") + F.col("ties"))
            picks.append(F.max(F.when(holds, F.col("v"))).alias(f"q{j}_{end}"))
        w, low, high = F.col("n") - 1, F.col(f"q{j}_0"), F.col(f"q{j}_1")
        w = w * F.lit(float(p)) - F.floor(w * F.lit(float(p)))
        out.append(F.when(w == 0, low).otherwise((1 - w) * low + w * high))
    return near.groupBy("__g", "m").agg(F.max("n").alias("n"), *picks).select("__g", "m", F.array(*out).alias("q"))


def _centres(nodes: DataFrame) -> DataFrame:
    """(__g, m, n, d, lo, hi, mean) of each group and column."""
    return nodes.groupBy("__g", "m").agg(
        F.sum("c").alias("n"),
        F.sum("d").alias("d"),
        F.min("lo").alias("lo"),
        F.max("hi").alias("hi"),
        (F.sum("total") / F.sum("c")).alias("mean"),
    )


def _moments(counts: DataFrame, centres: DataFrame, powers: int) -> DataFrame:
    """(__g, m, m2 ..): sums of powers of the deviations from the mean."""
    means = centres.where("m >= 0 AND lo < hi").select("__g", "m", "mean")
    away = counts.where("v IS NOT NULL").select("__g", "m", "v", "c").join(means, ["__g", "m"])
    away = away.select("__g", "m", "c", (F.col("v") - F.col("mean")).alias("x"))
    return away.groupBy("__g", "m").agg(*[F.sum(F.expr(" * ".join(["c", *["x"] * k]))).alias(f"m{k}") for k in range(2, powers + 1)])


# -- descriptions -----------------------------------------------------------
#: What a measure is computed from: sums up to that power.
POWERS = {"n": 0, "min": 0, "max": 0, "mean": 0, "sd": 2, "variance": 2, "cv": 2, "skewness": 4, "kurtosis": 4}
QUANTILES = {"q25": 0.25, "median": 0.5, "q75": 0.75, "iqr": None}


def described(
    df: DataFrame,
    keys: Sequence[str],
    spec: Mapping[str, tuple[str, Sequence[str]]],
    tallies: Mapping[str, Tally],
    outside: tuple[str, Mapping[str, float]] | None = None,
) -> DataFrame:
    """One row per group: tallies, then ``prefix_measure`` of ``{prefix: (column, measures)}``; one scan of ``df``.

    ``outside`` = (column, {name: k}) adds the number of rows of the column beyond
    q1 - k * iqr or q3 + k * iqr of their group.
    """
    keys = list(keys)
    columns = list(dict.fromkeys([c for c, _ in spec.values()] + ([outside[0]] if outside else [])))
    needs_values = lambda measures: any(m in QUANTILES or POWERS[m] for m in measures)
    exact = {c for c, measures in spec.values() if needs_values(measures)} | ({outside[0]} if outside else set())
    powers = max((POWERS.get(m, 0) for _, measures in spec.values() for m in measures), default=0)
    counts = _reduced(df, keys, columns, exact, list(tallies.values()))
    nodes = _nodes(counts)
    probs = [p for p in QUANTILES.values() if p is not None]
    rows = _centres(nodes)
    if powers:
        rows = rows.unionByName(_moments(counts, rows, powers), allowMissingColumns=True)
    quantiles = _quantile_rows(counts, nodes, probs)
    if outside:
        quantiles = staged(quantiles, "quantiles")
        rows = rows.unionByName(_outside_rows(counts, quantiles, columns.index(outside[0]), outside[1]), allowMissingColumns=True)
    rows = rows.unionByName(quantiles, allowMissingColumns=True)

    def of(m: int, c: str | Column) -> Column:
        return F.max(F.when(F.col("m") == m, F.col(c) if isinstance(c, str) else c))

    zero = F.lit(0).cast("bigint")
    out = []
    for j, (name, t) in enumerate(tallies.items()):
        counted = {"rows": of(-1, "n"), "where": of(-2 - j, "n"), "distinct": of(-2 - j, "d")}[t.kind]
        out.append(F.coalesce(counted, zero).alias(name))
    if outside:
        out += [F.coalesce(of(-1_000, f"beyond_{name}"), zero).alias(name) for name in outside[1]]
    for prefix, (column, measures) in spec.items():
        for m in measures:
            out.append(_measured(columns.index(column), m, of).alias(f"{prefix}_{m}"))
    by = _keys_of(keys)
    final = rows.groupBy(*by).agg(*out)
    return staged(final, "described")


def _measured(i: int, measure: str, of: Callable[..., Column]) -> Column:
    n = F.coalesce(of(i, "n"), F.lit(0).cast("bigint"))
    constant = of(i, "lo") == of(i, "hi")
    mean = F.when(constant, of(i, "lo")).otherwise(of(i, "mean"))
    variance = F.when(n > 1, F.when(constant, 0.0).otherwise(of(i, "m2") / (n - 1))) if measure in POWERS and POWERS[measure] else None
    q = lambda j: of(i, F.try_element_at(F.col("q"), F.lit(j + 1)))
    if measure == "n":
        return n
    if measure in ("min", "max"):
        return of(i, "lo" if measure == "min" else "hi")
    if measure in ("q25", "median", "q75"):
        return q(("q25", "median", "q75").index(measure))
    if measure == "iqr":
        return q(2) - q(0)
    if measure == "mean":
        return mean
    if measure == "variance":
        return variance
    sd = F.sqrt(variance)
    if measure == "sd":
        return sd
    if measure == "cv":
        return F.try_divide(sd, mean) * 100
    if measure == "skewness":
        return F.when((n > 2) & (sd > 0), of(i, "m3") / (n * sd * variance))
    if measure == "kurtosis":
        return F.when((n > 3) & (sd > 0), of(i, "m4") / (n * variance * variance) - 3)
    raise ValueError(f"unknown measure {measure}")


def _outside_rows(counts: DataFrame, quantiles: DataFrame, m: int, limits: Mapping[str, float]) -> DataFrame:
    """(__g, m = -1000, beyond_..): rows of one column beyond the fences of their group."""
    fences = quantiles.where(F.col("m") == m).select("__g", F.element_at("q", 1).alias("q1"), F.element_at("q", 3).alias("q3"))
    v, q1, q3 = F.col("v"), F.col("q1"), F.col("q3")
    beyond = [
        F.sum(F.when((v < q1 - k * (q3 - q1)) | (v > q3 + k * (q3 - q1)), F.col("c"))).alias(f"beyond_{name}")
        for name, k in limits.items()
    ]
    values = counts.where(F.col("m") == m).select("__g", "v", "c")
    return values.join(fences, "__g").groupBy("__g").agg(*beyond).withColumn("m", F.lit(-1_000))


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str], probs: Sequence[float]
) -> DataFrame:
    """One row per group; ``quantile_name(column, p)`` names the values, linear between two ranks."""
    keys = list(keys)
    counts = _reduced(df, keys, columns, set(columns), [])
    nodes = _nodes(counts)
    rows = nodes.where("m = -1").select("__g", "m").unionByName(_quantile_rows(counts, nodes, probs), allowMissingColumns=True)
    out = [
        F.max(F.when(F.col("m") == i, F.try_element_at(F.col("q"), F.lit(j + 1)))).alias(quantile_name(c, p))
        for i, c in enumerate(columns)
        for j, p in enumerate(probs)
    ]
    return staged(rows.groupBy(*_keys_of(keys)).agg(*out), "quantiles")


# -- ranks of all values ----------------------------------------------------
def value_positions(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    carry: Mapping[str, Column] | None = None,
    weight: Column | None = None,
) -> DataFrame:
    """Distinct values per group with their count and how many come before.

    Columns: keys, ``value``, ``ties`` (rows equal to it), ``before`` (smaller
    rows), ``distinct_before`` (smaller distinct values) and one column per
    ``carry`` aggregate over the rows that share the value.  A row counts ``weight``
    times, once by default.  Cells with too many
    values are cut until none is left, so that no task sorts a whole group.
    """
    keys, carry = list(keys), dict(carry or {})
    number = no_nan(F.col(f"`{value}`").cast("double"))
    rows = df.withColumn(value, number).filter(F.col(f"`{value}`").isNotNull()).withColumn("__g", _group(keys))
    v = F.col(f"`{value}`")
    counts = (
        rows.groupBy("__g", F.array(value_bucket(v, STEPS)).alias("__path"), value)
        .agg(F.sum(F.lit(1) if weight is None else weight).alias("ties"), *[c.alias(n) for n, c in carry.items()])
    )
    counts = staged(counts, "positions")
    while True:
        cells = staged(
            counts.groupBy("__g", "__path").agg(
                F.sum("ties").alias("c"), F.count(F.lit(1)).alias("d"), F.min(value).alias("lo"), F.max(value).alias("hi")
            ),
            "cells",
        )
        large = cells.where(f"d > {LIMIT}")
        if not large.agg(F.count(F.lit(1))).first()[0]:
            break
        deeper = F.concat("__path", F.array(bucket_of(v, F.col("lo"), F.col("hi"), SPLIT).cast("bigint")))
        counts = staged(
            counts.join(large.select("__g", "__path", "lo", "hi"), ["__g", "__path"], "left")
            .withColumn("__path", F.when(F.col("lo").isNotNull(), deeper).otherwise(F.col("__path")))
            .drop("lo", "hi"),
            "positions",
        )
    upto = W.partitionBy("__g").orderBy("__path").rowsBetween(W.unboundedPreceding, -1)
    inside = W.partitionBy("__g", "__path").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")
    starts = cells.select(
        "__g",
        "__path",
        F.coalesce(F.sum("c").over(upto), zero).alias("__rows"),
        F.coalesce(F.sum("d").over(upto), zero).alias("__values"),
    )
    return counts.join(starts, ["__g", "__path"]).select(
        *_keys_of(keys),
        value,
        "ties",
        *carry,
        (F.col("__rows") + F.coalesce(F.sum("ties").over(inside), zero)).alias("before"),
        (F.col("__values") + F.count(value).over(inside)).alias("distinct_before"),
    )


def first_n_threshold(df: DataFrame, key: str, n: int) -> DataFrame:
    """One row: the ``n``-th smallest value of a unique numeric key, the largest if there are fewer; null without rows."""
    counts = _reduced(df, [], [key], {key}, [])
    at = lambda size: F.least(F.lit(n), size) - 1
    near = _selected(counts, _nodes(counts), lambda size: [at(size)])
    holds = (at(F.col("n")) >= F.col("before")) & (at(F.col("n")) < F.col("before") + F.col("ties"))
    return staged(near.agg(F.max(F.when(holds, F.col("v"))).alias("threshold")), "threshold")
