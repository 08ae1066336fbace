"""Comparisons with a baseline and between treatments.

A run's percent change is a linear function of the run's value, so the mean and
standard deviation of the changes follow from those of the values.  One grouped
aggregate is enough; runs are never joined to their baseline row by row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from runlens import schema as S
from runlens.functions.scalars import exclude_pair, improved_label, no_nan, normal_ci, pct_change
from runlens.operators.aggregates import grouped_stats
from runlens.operators.order_stats import ROWS, Tally
from runlens.operators.sizing import attach


def _baseline_of(column: str, baseline: str) -> Column:
    """The baseline row's value, seen from every row of the same benchmark."""
    return F.max(F.when(F.col("variant") == baseline, F.col(column))).over(W.partitionBy("benchmark"))


def stats_vs_baseline(pair_stats: DataFrame, baseline: str = S.BASELINE) -> DataFrame:
    """Statistics per pair with the change against the benchmark's baseline.

    The baseline is one of the aggregated rows, so it is read from the
    aggregate (one row per variant) and the runs are scanned once.
    """
    compared = pair_stats.withColumns(
        {
            f"__{c}": _baseline_of(c, baseline)
            for c in ("energy_mean", "energy_median", "power_mean", "time_mean")
        }
    )
    return compared.select(
        "benchmark",
        "variant",
        "n_runs",
        "energy_mean",
        "energy_median",
        "energy_sd",
        "energy_iqr",
        "energy_cv",
        F.col("__energy_mean").alias("baseline_energy_mean"),
        pct_change("energy_mean", "__energy_mean").alias("energy_pct_vs_baseline"),
        pct_change("energy_median", "__energy_median").alias("energy_median_pct_vs_baseline"),
        "power_mean",
        pct_change("power_mean", "__power_mean").alias("power_pct_vs_baseline"),
        "time_mean",
        pct_change("time_mean", "__time_mean").alias("time_pct_vs_baseline"),
        "cpu_mean",
        "memory_mean",
        "outlier_rate",
    )


def baseline_left_join(stats: DataFrame, base: DataFrame, on: Sequence[str] = ("benchmark",)) -> DataFrame:
    """Left join of aggregated rows to separately computed baseline rows."""
    return attach(stats, base, list(on))


def variant_performance(runs: DataFrame, baseline: str = S.BASELINE) -> DataFrame:
    """Median energy per pair and its change against the baseline median."""
    stats = grouped_stats(
        runs, ["benchmark", "variant"], {"energy": ("energy_joules", ("median", "mean"))}
    )
    return (
        stats.withColumn("baseline_median", _baseline_of("energy_median", baseline))
        .withColumn("pct_change", pct_change("energy_median", "baseline_median"))
        .withColumnsRenamed({"energy_median": "median_energy", "energy_mean": "mean_energy"})
    )


# -- confidence intervals of percent changes --------------------------------
def delta_ci(
    runs: DataFrame,
    variants: Sequence[str],
    by: Sequence[str] = ("benchmark", "variant"),
    metrics: Mapping[str, str] = S.DELTA_METRICS,
    baseline: str = S.BASELINE,
    exclude: Sequence[tuple[str, str]] = (),
) -> DataFrame:
    """Mean percent change per group with standard error and 95 % interval.

    The standard error divides by all rows of the group, also those without a
    reading.
    """
    by = list(by)
    rest = [k for k in by if k != "benchmark"]
    if "benchmark" not in by:
        raise ValueError("delta_ci compares within a benchmark")
    kept = exclude_pair(runs, exclude).filter(F.col("variant").isin([baseline, *variants]))
    is_base = F.col("variant") == baseline
    side = kept.withColumn("__base", is_base).withColumns(
        {k: F.when(~is_base, F.col(k)) for k in rest}
    )
    aggs = [F.count(F.lit(1)).alias("n")]
    for name, column in metrics.items():
        x = no_nan(F.col(column))
        aggs += [F.avg(x).alias(f"{name}_m"), F.stddev_samp(x).alias(f"{name}_s")]
    grouped = side.groupBy(*by, "__base").agg(*aggs)
    base_row = {
        f"{name}_b": F.max(F.when(F.col("__base"), F.col(f"{name}_m"))).over(W.partitionBy("benchmark"))
        for name in metrics
    }
    out = grouped.withColumns(base_row).filter(~F.col("__base"))
    means = {
        **{f"{n}_mean": pct_change(f"{n}_m", f"{n}_b") for n in metrics},
        **{
            f"{n}_se": F.try_divide(F.col(f"{n}_s"), F.abs(f"{n}_b")) * 100 / F.sqrt("n")
            for n in metrics
        },
    }
    out = out.withColumns(means)
    columns: list = [*by, "n"]
    for name in metrics:
        low, high = normal_ci(f"{name}_mean", f"{name}_se")
        columns += [
            f"{name}_mean",
            f"{name}_se",
            low.alias(f"{name}_ci_lower"),
            high.alias(f"{name}_ci_upper"),
        ]
    return out.select(*columns)


def guideline_summary(deltas: DataFrame) -> DataFrame:
    """Per variant: medians of the per-benchmark mean changes."""
    spec = {
        "energy": ("energy_mean", ("median", "mean")),
        "time": ("time_mean", ("median",)),
        "cpu": ("cpu_mean", ("median",)),
        "memory": ("memory_mean", ("median",)),
        "power": ("power_mean", ("median",)),
    }
    return grouped_stats(deltas, ["variant"], spec, {"n_benchmarks": ROWS}).withColumnRenamed("energy_mean", "energy_mean_overall")


# -- paired comparison ------------------------------------------------------
def paired_delta(
    runs: DataFrame, baseline: str = S.BASELINE, treated: str = S.OPTIMIZED
) -> DataFrame:
    """Both means side by side and their percent change, in one pass."""
    aggs = [F.count_if(F.col("variant") == baseline).alias("__n")]
    for name, column in S.DELTA_METRICS.items():
        for side, variant in (("baseline", baseline), ("opt", treated)):
            aggs.append(
                F.avg(F.when(F.col("variant") == variant, no_nan(F.col(column)))).alias(f"{side}_{name}")
            )
    wide = runs.filter(F.col("variant").isin([baseline, treated])).groupBy("benchmark").agg(*aggs)
    return (
        wide.filter(F.col("__n") > 0)
        .drop("__n")
        .withColumns(
            {f"delta_{n}_pct": pct_change(f"opt_{n}", f"baseline_{n}") for n in S.DELTA_METRICS}
        )
    )


def paired_join(left: DataFrame, right: DataFrame, on: Sequence[str] = ("benchmark",)) -> DataFrame:
    """Left join of two treatments' rows on their key."""
    return attach(left, right, list(on))


def delta_summary_matrix(delta: DataFrame) -> DataFrame:
    """Seven statistics for each of the five change columns."""
    from runlens.operators.reshape import delta_long

    spec = {"v": ("delta_pct", ("median", "mean", "sd", "min", "max", "q25", "q75"))}
    stats = grouped_stats(delta_long(delta), ["metric"], spec)
    return stats.withColumnsRenamed({c: c[2:] for c in stats.columns if c.startswith("v_")})


# -- treatments -------------------------------------------------------------
def family_average(
    runs: DataFrame,
    family: Sequence[str],
    label: str,
    exclude: Sequence[tuple[str, str]] = (),
) -> DataFrame:
    """Average of a family's variants per benchmark and repetition."""
    return (
        exclude_pair(runs.filter(F.col("variant").isin(list(family))), exclude)
        .groupBy("benchmark", "results_set")
        .agg(F.avg(no_nan("energy_joules")).alias("energy_joules"))
        .withColumn("treatment", F.lit(label))
    )


def slope_stats(df: DataFrame, treatment: str = "treatment") -> DataFrame:
    """Mean energy and its standard error per benchmark and treatment."""
    x = no_nan("energy_joules")
    return df.groupBy("benchmark", treatment).agg(
        F.avg(x).alias("energy_mean"),
        (F.stddev_samp(x) / F.sqrt(F.count(F.lit(1)))).alias("energy_se"),
    )


def overall_means(slopes: DataFrame, treatment: str = "treatment") -> DataFrame:
    return slopes.groupBy(treatment).agg(
        F.avg("energy_mean").alias("overall_mean"),
        (F.stddev_samp("energy_mean") / F.sqrt(F.count(F.lit(1)))).alias("overall_se"),
    )


def treatment_delta(
    slopes: DataFrame, control: str, treated: str, treatment: str = "treatment"
) -> DataFrame:
    """Both treatments' means per benchmark, matched by key, and the change."""
    from runlens.operators.reshape import pivot_multi

    wide = pivot_multi(slopes, "benchmark", treatment, [control, treated], ["energy_mean"])
    return wide.withColumn(
        "delta_energy_pct", pct_change(f"energy_mean_{treated}", f"energy_mean_{control}")
    )


def median_delta(deltas: DataFrame, column: str = "delta_energy_pct") -> DataFrame:
    return grouped_stats(deltas, [], {"x": (column, ("median",))}).withColumnRenamed(
        "x_median", "median_delta"
    )


def treatment_summary(slopes: DataFrame, treatment: str = "treatment") -> DataFrame:
    """Centre and spread of the benchmark means per treatment."""
    return grouped_stats(
        slopes,
        [treatment],
        {"energy": ("energy_mean", ("median", "mean", "sd"))},
        {"n_benchmarks": Tally("where", "energy_mean IS NOT NULL")},
    )


def improvement_flags(
    slopes: DataFrame, control: str, treated: str, treatment: str = "treatment"
) -> DataFrame:
    """Whether the treated mean is below the control mean, per benchmark."""
    from runlens.operators.reshape import pivot_multi

    wide = pivot_multi(slopes, "benchmark", treatment, [control, treated], ["energy_mean", "energy_se"])
    flags = improved_label(f"energy_mean_{treated}", f"energy_mean_{control}")
    return wide.select("benchmark", *[c.alias(n) for n, c in flags.items()])


def flag_join_back(long: DataFrame, flags: DataFrame, on: Sequence[str] = ("benchmark",)) -> DataFrame:
    return attach(long, flags, list(on))
