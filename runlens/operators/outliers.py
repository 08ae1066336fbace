"""Outlier flags.  Group limits are aggregated first and joined back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.functions.scalars import no_nan
from runlens.operators.order_stats import exact_quantiles, quantile_name
from runlens.operators.sizing import attach


def fences(
    runs: DataFrame,
    keys: Sequence[str] = ("benchmark", "variant"),
    column: str = "energy_joules",
) -> DataFrame:
    """Quartiles per group."""
    q = exact_quantiles(runs, keys, [column], [0.25, 0.75])
    return q.select(
        *keys,
        F.col(quantile_name(column, 0.25)).alias("q1"),
        F.col(quantile_name(column, 0.75)).alias("q3"),
    )


def outlier_iqr(
    runs: DataFrame,
    keys: Sequence[str] = ("benchmark", "variant"),
    column: str = "energy_joules",
    moderate: float = 1.5,
    extreme: float = 3.0,
) -> DataFrame:
    """Flags values outside q1 - k*iqr and q3 + k*iqr of their group."""
    limits = fences(runs, keys, column)
    x, q1, q3 = no_nan(F.col(column)), F.col("q1"), F.col("q3")

    def outside(k: float):
        return (x < q1 - k * (q3 - q1)) | (x > q3 + k * (q3 - q1))

    return (
        attach(runs, limits, list(keys))
        .withColumns({"is_outlier_moderate": outside(moderate), "is_outlier_extreme": outside(extreme)})
        .drop("q1", "q3")
    )


def outlier_zscore(
    runs: DataFrame,
    keys: Sequence[str] = ("benchmark",),
    column: str = "energy_joules",
    limits: tuple[float, float] = (2.5, 3.0),
    source: DataFrame | None = None,
) -> DataFrame:
    """Distance from the group mean in standard deviations, with two flags.

    ``source`` gives the same rows without columns added earlier, so that the
    group means do not depend on those columns being computed.
    """
    x = no_nan(F.col(column))
    centre = (runs if source is None else source).groupBy(*keys).agg(
        F.avg(x).alias("__mean"), F.stddev_samp(x).alias("__sd")
    )
    z = F.try_divide(x - F.col("__mean"), F.col("__sd"))
    return (
        attach(runs, centre, list(keys))
        .withColumn("energy_z_score", z)
        .withColumns(
            {
                "is_outlier_zscore": F.abs("energy_z_score") > limits[0],
                "is_outlier_extreme_zscore": F.abs("energy_z_score") > limits[1],
            }
        )
        .drop("__mean", "__sd")
    )


def flag_outliers(runs: DataFrame) -> DataFrame:
    """All outlier columns of a cleaned run table."""
    return outlier_zscore(outlier_iqr(runs), source=runs)


def outliers_detailed(flagged: DataFrame) -> DataFrame:
    return (
        flagged.filter(F.col("is_outlier_moderate"))
        .select(
            "results_set",
            "run_id",
            "benchmark",
            "variant",
            "energy_joules",
            "power_watts",
            "cpu_usage_avg",
            "memory_usage_avg",
            "energy_z_score",
            "is_outlier_extreme",
        )
        .orderBy("benchmark", "variant", F.desc(F.abs("energy_z_score")))
    )


def exclude_extreme(
    long: DataFrame,
    limit: float = 1000.0,
    value: str = "delta_pct",
    benchmark: str = "benchmark",
    variant: str = "variant",
) -> tuple[DataFrame, DataFrame]:
    """Rows within the limit, and the variants that exceeded it somewhere."""
    beyond = F.abs(F.col(value)) > limit
    offending = long.filter(beyond).select(benchmark, variant).distinct()
    kept = long.filter(~F.coalesce(beyond, F.lit(False)))
    return kept, offending
