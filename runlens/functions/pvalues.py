"""Tail probabilities of the three tests as column expressions.

Tails are integrals over w > 0, by the trapezoid rule after w = scale * exp(pi / 2 * sinh(x)),
which makes any density that decays at least like an exponential vanish doubly
exponentially at both ends: a fixed number of nodes serves every size and statistic.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Nodes to one unit of x, and the ends of x.
STEPS = 32
FIRST, LAST = -4, 3
#: Samples of this size and more, or with ties or zeros, use the normal probability.
EXACT_BELOW = 50

# Wichura's 1988 rational functions (algorithm AS 241), low power first,
# for the middle and for tails down to exp(-25).
MIDDLE_TOP = (
    3.387132872796366608, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4,
    4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3,
)
MIDDLE_BOTTOM = (
    1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
    2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3,
)
TAIL_TOP = (
    1.42343711074968357734, 4.63033784615654529590, 5.76949722146069140550, 3.64784832476320460504,
    1.27045825245236838258, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4,
)
TAIL_BOTTOM = (
    1.0, 2.05319162663775882187, 1.67638483018380384940, 6.89767334985100004550e-1,
    1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9,
)

# Royston's 1995 polynomials (algorithm AS R94), low power first.
LAST_WEIGHT = (0.0, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056)
NEXT_WEIGHT = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
SMALL_GAMMA = (-2.273, 0.459)
SMALL_MEAN = (0.544, -0.39978, 0.025054, -6.714e-4)
SMALL_LOG_SD = (1.3822, -0.77857, 0.062767, -0.0020322)
LARGE_MEAN = (-1.5861, -0.31082, -0.083751, 0.0038915)
LARGE_LOG_SD = (-0.4803, -0.082676, 0.0030302)

# gamma(z + 1/2) / gamma(z) over the root of z, in powers of 1 / z.
HALF_STEP = (1.0, -1 / 8, 1 / 128, 5 / 1024, -21 / 32768, -399 / 262144, 869 / 4194304)


def polynomial(coefficients: Sequence[float], x: Column) -> Column:
    out = F.lit(coefficients[-1])
    for c in coefficients[-2::-1]:
        out = out * x + c
    return out


def integral(log_density: Callable[[Column], Column], scale: Column) -> Column:
    """Integral of ``exp(log_density(w))`` over w > 0; ``scale`` is about the width of the density."""

    def add(total: Column, k: Column) -> Column:
        x = k / F.lit(float(STEPS))
        w = scale * F.exp(F.sinh(x) * (math.pi / 2))
        return total + F.exp(log_density(w)) * w * F.cosh(x)

    nodes = F.sequence(F.lit(FIRST * STEPS), F.lit(LAST * STEPS))
    return F.aggregate(nodes, F.lit(0.0), add) * (math.pi / 2 / STEPS)


def normal_upper(z: Column) -> Column:
    """Probability that a standard normal exceeds z."""
    size = F.abs(z)
    tail = F.exp(-size * size / 2) / math.sqrt(2 * math.pi) * integral(lambda w: -size * w - w * w / 2, 1 / (size + 1))
    return F.when(z >= 0, tail).otherwise(1 - tail)


def normal_quantile(p: Column) -> Column:
    """The value that a standard normal stays below with probability p, for tails of exp(-25) and more."""
    q = p - 0.5
    middle = 0.180625 - q * q
    tail = F.sqrt(-F.ln(F.least(p, 1 - p))) - 1.6
    return F.when(
        F.abs(q) <= 0.425, q * polynomial(MIDDLE_TOP, middle) / polynomial(MIDDLE_BOTTOM, middle)
    ).otherwise(F.signum(q) * polynomial(TAIL_TOP, tail) / polynomial(TAIL_BOTTOM, tail))


def gamma_half_step(z: Column) -> Column:
    """gamma(z + 1/2) / gamma(z) for z > 0: the series, 20 steps further up."""
    down = F.aggregate(F.sequence(F.lit(0), F.lit(19)), F.lit(1.0), lambda f, i: f * (z + i) / (z + i + 0.5))
    return down * F.sqrt(z + 20) * polynomial(HALF_STEP, 1 / (z + 20))


def t_p_value(t: Column, df: Column) -> Column:
    """Two-sided probability of Student's t; the density is a power of cosh of asinh(t / sqrt(df))."""
    size = F.abs(t)
    slope = size / F.sqrt(df + size * size)
    capped = lambda w: F.least(w, F.lit(700.0))
    log_density = lambda w: -df * F.log1p(
        2 * F.pow(F.sinh(capped(w) / 2), F.lit(2.0)) + slope * F.sinh(capped(w))
    )
    tail = integral(log_density, 1 / (df * slope + F.sqrt(df)))
    front = gamma_half_step(df / 2) * F.exp(-df / 2 * F.log1p(size * size / df))
    return F.when(t.isNotNull() & df.isNotNull(), F.least(F.lit(1.0), front * tail * (2 / math.sqrt(math.pi))))


def signed_rank_exact(v: Column, n: Column) -> Column:
    """Two-sided exact probability, for n below ``EXACT_BELOW``: the subsets of 1..n, counted by their sum."""
    few = F.least(n, F.lit(EXACT_BELOW - 1)).cast("int")
    none = F.concat(F.array(F.lit(1.0)), F.array_repeat(F.lit(0.0), (few * (few + 1) / 2).cast("int")))
    with_rank = lambda ways, rank: F.transform(
        ways, lambda w, total: w + F.coalesce(F.get(ways, total - rank), F.lit(0.0))
    )
    ways = F.aggregate(F.sequence(F.lit(1), few), none, with_rank)
    zero = F.struct(F.lit(0).alias("total"), F.lit(0.0).alias("low"), F.lit(0.0).alias("high"))
    split = lambda s, w: F.struct(
        (s["total"] + 1).alias("total"),
        (s["low"] + F.when(s["total"] <= v, w).otherwise(0.0)).alias("low"),
        (s["high"] + F.when(s["total"] >= v, w).otherwise(0.0)).alias("high"),
    )
    least = lambda s: F.least(F.lit(1.0), 2 * F.least(s["low"], s["high"]) / F.pow(F.lit(2.0), few))
    return F.aggregate(ways, zero, split, least)


def signed_rank_normal(v: Column, n: Column, tie_sum: Column) -> Column:
    """Two-sided normal probability with tie variance and continuity correction."""
    size = n.cast("double")
    variance = size * (size + 1) * (2 * size + 1) / 24 - tie_sum / 48
    gap = v - size * (size + 1) / 4
    z = F.abs(gap - F.signum(gap) * 0.5) / F.sqrt(variance)
    return F.when(variance > 0, F.least(F.lit(1.0), 2 * normal_upper(z)))


def signed_rank_p_value(v: Column, n: Column, tie_sum: Column, zeros: Column) -> Column:
    exact = (n < EXACT_BELOW) & (tie_sum == 0) & (zeros == 0)
    return F.when(v.isNotNull() & (n > 0), F.when(exact, signed_rank_exact(v, n)).otherwise(signed_rank_normal(v, n, tie_sum)))


def shapiro_p_value(w: Column, n: Column) -> Column:
    size = n.cast("double")
    three = F.greatest(F.lit(0.0), 6 / math.pi * (F.asin(F.sqrt(w)) - math.asin(math.sqrt(0.75))))
    y, ln = F.ln(1 - w), F.ln(size)
    gamma = polynomial(SMALL_GAMMA, size)
    small = (-F.ln(gamma - y) - polynomial(SMALL_MEAN, size)) / F.exp(polynomial(SMALL_LOG_SD, size))
    large = (y - polynomial(LARGE_MEAN, ln)) / F.exp(polynomial(LARGE_LOG_SD, ln))
    return (
        F.when(size == 3, three)
        .when(w >= 1, 1.0)
        .when((size <= 11) & (y >= gamma), 1e-99)
        .otherwise(normal_upper(F.when(size <= 11, small).otherwise(large)))
    )


def with_shapiro(df: DataFrame, ordered: str) -> DataFrame:
    """Adds ``w`` and ``p`` for arrays of 3 to 5000 ascending values; null if all are equal."""
    x = F.col(ordered)
    n, half = F.col("__n"), F.col("__half")
    total = lambda a, f=lambda v: v: F.aggregate(a, F.lit(0.0), lambda s, v: s + f(v))
    square = lambda v: v * v
    m, many = F.col("__m"), n > 5
    first, second = F.get(m, F.lit(0)), F.get(m, F.lit(1))
    one, two = F.col("__one"), F.col("__two")
    scores = F.transform(F.sequence(F.lit(0), half - 1), lambda i: normal_quantile((n - i - 0.375) / (n + 0.25)))
    weight = lambda v, i: (
        F.when(n == 3, math.sqrt(0.5)).when(i == 0, one).when((i == 1) & many, two).otherwise(v / F.sqrt("__phi"))
    )
    gaps = F.zip_with(F.slice(F.reverse(x), 1, half), F.slice(x, 1, half), lambda high, low: high - low)
    contrast = total(F.zip_with(F.transform(m, weight), gaps, lambda a, gap: a * gap))
    spread = total(x, lambda v: square(v - F.col("__mean")))
    wide = F.element_at(x, -1) - F.element_at(x, 1) >= 1e-19
    return (
        df.withColumns({"__n": F.size(x).cast("double"), "__half": F.floor(F.size(x) / 2).cast("int")})
        .withColumns({"__m": scores, "__mean": total(x) / n})
        .withColumn("__norm", 2 * total(m, square))
        .withColumns(
            {
                "__one": first / F.sqrt("__norm") + polynomial(LAST_WEIGHT, 1 / F.sqrt(n)),
                "__two": F.when(many, second / F.sqrt("__norm") + polynomial(NEXT_WEIGHT, 1 / F.sqrt(n))).otherwise(0.0),
            }
        )
        .withColumn(
            "__phi",
            (F.col("__norm") - 2 * square(first) - F.when(many, 2 * square(second)).otherwise(0.0))
            / F.nullif(1 - 2 * square(one) - 2 * square(two), F.lit(0.0)),
        )
        .withColumn("w", F.when(wide, F.least(F.lit(1.0), square(contrast) / F.nullif(spread, F.lit(0.0)))))
        .withColumn("p", F.when(F.col("w").isNotNull(), shapiro_p_value(F.col("w"), n)))
        .drop("__n", "__half", "__m", "__mean", "__norm", "__one", "__two", "__phi")
    )
