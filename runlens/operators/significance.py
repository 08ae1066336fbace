"""One-sample significance tests per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.functions import pvalues as P
from runlens.functions.scalars import no_nan, significance_label
from runlens.operators.aggregates import grouped_stats
from runlens.operators.order_stats import ROWS, value_positions
from runlens.session import staged
from runlens.operators.sizing import attach

SHAPIRO_MAX = 5000


def t_test_one_sample(df: DataFrame, by: Sequence[str], x: str, mu: float = 0.0) -> DataFrame:
    """Two-sided t-test.  Fewer than two values or a constant sample give null."""
    v = no_nan(F.col(x).cast("double"))
    stats = df.groupBy(*by).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd")
    )
    se = F.col("sd") / F.sqrt(F.col("n").cast("double"))
    usable = (F.col("n") >= 2) & (se > 10 * 2.220446049250313e-16 * F.abs("mean"))
    return (
        stats.withColumn("t", F.when(usable, (F.col("mean") - mu) / se))
        .withColumn("df", F.when(usable, (F.col("n") - 1).cast("double")))
        .withColumn("p", P.t_p_value(F.col("t"), F.col("df")))
        .select(*by, "n", "t", "df", "p")
    )


def wilcoxon_signed_rank(
    df: DataFrame, by: Sequence[str], x: str, mu: float = 0.0
) -> DataFrame:
    """Two-sided signed-rank test with average ranks; zeros are dropped.

    One scan gives the distinct sizes of the differences with their counts; ranks
    and zeros come from those.
    """
    diff = no_nan(F.col(x).cast("double")) - mu
    rows = df.select(*by, F.abs(diff).alias("size"), (diff > 0).alias("up"))
    sizes = staged(
        rows.groupBy(*by, "size").agg(F.count(F.lit(1)).alias("__rows"), F.count_if("up").alias("__up")), "sizes"
    )
    totals = sizes.groupBy(*by).agg(F.coalesce(F.sum(F.when(F.col("size") == 0, F.col("__rows"))), F.lit(0)).alias("zeros"))
    ranks = value_positions(
        sizes.filter(F.col("size") > 0), by, "size", {"n_up": F.sum("__up")}, F.col("__rows")
    )
    middle = F.col("before") + (F.col("ties") + 1) / 2
    cube = F.col("ties").cast("double")
    stats = ranks.groupBy(*by).agg(
        F.sum("ties").alias("n"),
        F.sum(F.col("n_up") * middle).alias("v"),
        F.sum(cube * cube * cube - cube).alias("tie_sum"),
    )
    joined = attach(totals, stats, by)
    p = P.signed_rank_p_value(F.col("v"), F.col("n"), F.col("tie_sum"), F.col("zeros"))
    return joined.withColumn("p", p).select(
        *by, F.coalesce("n", F.lit(0)).alias("n"), "v", "p"
    )


def shapiro_wilk(df: DataFrame, by: Sequence[str], x: str) -> DataFrame:
    """Normality test for 3 to 5000 values; other sizes give null.

    Sizes are counted first, so a sample is only brought together when it is
    known to hold at most 5000 values.
    """
    values = df.select(*by, no_nan(F.col(x).cast("double")).alias("x"))
    sizes = values.groupBy(*by).agg(F.count("x").alias("n"))
    fitting = sizes.filter(F.col("n").between(3, SHAPIRO_MAX))
    ordered = (
        attach(values.filter(F.col("x").isNotNull()), fitting, by, "inner")
        .groupBy(*by)
        .agg(F.array_sort(F.collect_list("x")).alias("ordered"))
    )
    return attach(sizes, P.with_shapiro(ordered, "ordered").select(*by, "w", "p"), by)


def choose_test(df: DataFrame, by: Sequence[str], x: str, alpha: float = 0.05) -> DataFrame:
    """Signed-rank test where normality is rejected, otherwise the t-test."""
    df = df.select(*by, x)
    spec = {"x": (x, ("median", "mean", "sd"))}
    centre = grouped_stats(df, by, spec, {"n": ROWS})
    centre = centre.withColumnsRenamed({"x_median": "median", "x_mean": "mean", "x_sd": "sd"})
    parts = {
        "shapiro_p": shapiro_wilk(df, by, x),
        "wilcox_p": wilcoxon_signed_rank(df, by, x),
        "ttest_p": t_test_one_sample(df, by, x),
    }
    out = centre
    for name, part in parts.items():
        out = attach(out, part.select(*by, F.col("p").alias(name)), by)
    rejected = F.col("shapiro_p") < 0.05
    return (
        out.withColumns(
            {
                "test_used": F.when(rejected, "Wilcoxon").when(~rejected, "t-test"),
                "p_value": F.when(rejected, F.col("wilcox_p")).when(~rejected, F.col("ttest_p")),
            }
        )
        .withColumns(
            {
                "significant": F.col("p_value") < alpha,
                "significance_label": significance_label("p_value"),
            }
        )
    )


def verdict(tests: DataFrame) -> DataFrame:
    """Direction of every significant change."""
    direction = F.when(F.col("median") < 0, "REDUCTION").otherwise("INCREASE")
    return tests.withColumn("verdict", F.when(F.col("significant"), direction))
