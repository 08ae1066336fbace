"""Wide and long forms.  Pivots take their values, so the schema is stable."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens import schema as S
from runlens.functions.scalars import is_finite, metric_label
from runlens.operators.compare import variant_performance


def pivot_matrix(df: DataFrame, rows: str, columns: str, value: str, values: Sequence[str]) -> DataFrame:
    """One row per ``rows`` key, one column per listed value; absent cells null."""
    return df.groupBy(rows).pivot(columns, list(values)).agg(F.first(value))


def energy_matrix(runs: DataFrame, variants: Sequence[str] = tuple(S.VARIANTS)) -> DataFrame:
    """Benchmark by variant: median energy."""
    return pivot_matrix(variant_performance(runs), "benchmark", "variant", "median_energy", variants)


def pct_change_matrix(
    runs: DataFrame,
    variants: Sequence[str] = tuple(S.VARIANTS),
    baseline: str = S.BASELINE,
) -> DataFrame:
    """Benchmark by variant: change of the median against the baseline median."""
    return pivot_matrix(
        variant_performance(runs, baseline), "benchmark", "variant", "pct_change", variants
    )


def pivot_multi(
    df: DataFrame, key: str, pivot: str, pivot_values: Sequence[str], values: Sequence[str]
) -> DataFrame:
    """Several value columns per pivot value, named ``value_PIVOT``."""
    return df.groupBy(key).agg(
        *[
            F.max(F.when(F.col(pivot) == p, F.col(v))).alias(f"{v}_{p}")
            for v in values
            for p in pivot_values
        ]
    )


def delta_long(delta: DataFrame, key: str = "benchmark") -> DataFrame:
    """Change columns to (metric, delta_pct) rows with display names."""
    names = [c for c in delta.columns if c.startswith("delta_")]
    return (
        delta.unpivot([key], names, "metric", "delta_pct")
        .withColumn("metric", metric_label("metric"))
    )


def metrics_long_ci(
    stats: DataFrame, keys: Sequence[str], metrics: Sequence[str] = ("energy", "cpu", "memory", "power")
) -> DataFrame:
    """Means to rows, each with its own interval; missing and infinite dropped."""
    rows = [
        F.struct(
            F.lit(S.METRIC_LABELS[f"{m}_mean"]).alias("metric"),
            F.lit(i).alias("metric_order"),
            F.col(f"{m}_mean").alias("delta_pct"),
            F.col(f"{m}_ci_lower").alias("ci_lower"),
            F.col(f"{m}_ci_upper").alias("ci_upper"),
        )
        for i, m in enumerate(metrics)
    ]
    return stats.select(*keys, F.inline(F.array(*rows))).filter(is_finite("delta_pct"))


def stat_wide(long: DataFrame, stats: Sequence[str], key: str = "metric") -> DataFrame:
    """(metric, stat, value) rows to one column per statistic."""
    return pivot_matrix(long, key, "stat", "value", stats)


def heatmap_data(pair_stats: DataFrame) -> DataFrame:
    return pair_stats.select("benchmark", "variant", "energy_mean")


def unnest_struct(df: DataFrame, column: str) -> DataFrame:
    """Fields of a struct column, or of an array of structs, become columns."""
    rest = [c for c in df.columns if c != column]
    if df.schema[column].dataType.typeName() == "array":
        return df.select(*rest, F.inline_outer(column))
    return df.select(*rest, f"{column}.*")
