"""Best, worst and top-n reports over aggregated groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from runlens import schema as S
from runlens.operators.aggregates import grouped_stats
from runlens.operators.compare import variant_performance
from runlens.operators.order_stats import ROWS, value_positions
from runlens.operators.sizing import attach


def _extreme_variant(performance: DataFrame, baseline: str, order: Column) -> DataFrame:
    ranked = performance.filter(F.col("variant") != baseline).withColumn(
        "__rank", F.rank().over(W.partitionBy("benchmark").orderBy(order))
    )
    return ranked.filter((F.col("__rank") == 1) & F.col("median_energy").isNotNull()).select(
        "benchmark", "variant", "median_energy", "pct_change"
    )


def best_variant(runs: DataFrame, baseline: str = S.BASELINE, performance: DataFrame | None = None) -> DataFrame:
    """Lowest median per benchmark; ties are all kept.  ``performance`` is ``variant_performance(runs)`` if it is there."""
    performance = variant_performance(runs, baseline) if performance is None else performance
    return _extreme_variant(performance, baseline, F.col("median_energy").asc_nulls_last())


def worst_variant(runs: DataFrame, baseline: str = S.BASELINE, performance: DataFrame | None = None) -> DataFrame:
    """Highest median per benchmark; ties are all kept.  ``performance`` as for ``best_variant``."""
    performance = variant_performance(runs, baseline) if performance is None else performance
    return _extreme_variant(performance, baseline, F.col("median_energy").desc_nulls_last())


def best_worst(best: DataFrame, worst: DataFrame) -> DataFrame:
    """Best next to worst; ties multiply rows."""
    names = {"variant": "variant", "median_energy": "energy", "pct_change": "pct"}
    left = best.withColumnsRenamed({k: f"best_{v}" for k, v in names.items()})
    right = worst.withColumnsRenamed({k: f"worst_{v}" for k, v in names.items()})
    return attach(left, right, ["benchmark"]).orderBy("benchmark")


def best_and_worst(runs: DataFrame, baseline: str = S.BASELINE) -> DataFrame:
    """``best_worst`` of medians that are computed once."""
    performance = variant_performance(runs, baseline)
    return best_worst(
        best_variant(runs, baseline, performance), worst_variant(runs, baseline, performance)
    )


def rank_global(df: DataFrame, order: Sequence[Column | str], n: int) -> DataFrame:
    """The first ``n`` rows with their rank.

    The limit comes first, so the window without a partition only ever sees
    those ``n`` rows.
    """
    return df.orderBy(*order).limit(n).withColumn("rank", F.row_number().over(W.orderBy(*order)))


def _pair_table(runs: DataFrame) -> DataFrame:
    spec = {
        "energy": ("energy_joules", ("median", "mean", "sd")),
        "power": ("power_watts", ("mean",)),
        "cpu": ("cpu_usage_avg", ("mean",)),
    }
    return grouped_stats(
        runs, ["benchmark", "variant"], spec, {"n": ROWS}
    )


def top10_efficient(runs: DataFrame, n: int = 10) -> DataFrame:
    """Smallest medians, compared after rounding to three decimals."""
    order = [F.round("energy_median", 3).asc_nulls_last(), F.col("benchmark"), F.col("variant")]
    return rank_global(_pair_table(runs), order, n)


def top10_inefficient(runs: DataFrame, n: int = 10) -> DataFrame:
    """Largest medians, compared after rounding to two decimals."""
    order = [F.round("energy_median", 2).desc_nulls_last(), F.col("benchmark"), F.col("variant")]
    return rank_global(_pair_table(runs), order, n)


def multi_key_sort(df: DataFrame, keys: Sequence[Column | str]) -> DataFrame:
    return df.orderBy(*keys)


def reorder_by_median(df: DataFrame, category: str, column: str) -> DataFrame:
    """Categories with the dense rank of their median as explicit sort key."""
    medians = grouped_stats(df, [category], {"m": (column, ("median",))})
    places = value_positions(medians, [], "m_median")
    return attach(medians, places.select("m_median", "distinct_before"), ["m_median"]).select(
        category,
        F.col("m_median").alias("median"),
        (F.col("distinct_before") + 1).alias("sort_key"),
    )
