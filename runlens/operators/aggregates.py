"""Grouped descriptive statistics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens import schema as S
from runlens.functions.scalars import memory_pct, no_nan, row_mean, stability_4, stability_5
from runlens.functions.scalars import variant_type as variant_type_of
from runlens.operators.order_stats import QUANTILES, ROWS, Tally, described
from runlens.operators.sizing import attach, attach_row

FULL = ("mean", "median", "sd", "variance", "min", "max", "q25", "q75", "iqr", "cv")
SHORT = ("mean", "median", "sd", "min", "max")
CENTER = ("mean", "median", "sd")
WITH_VARIANCE = ("mean", "median", "sd", "variance")

_NEEDS = {"cv": ("mean", "sd"), "skewness": ("n", "sd"), "kurtosis": ("n", "sd")}

Spec = Mapping[str, tuple[str, Sequence[str]]]


def _quoted(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


# Measures of a column without NaN.
_SIMPLE = {
    "n": F.count,
    "mean": F.avg,
    "sd": F.stddev_samp,
    "variance": F.var_samp,
    "min": F.min,
    "max": F.max,
    "skewness": F.skewness,
    "kurtosis": F.kurtosis,
}


def _measure(prefix: str, measure: str) -> Column:
    """A measure from the aggregates of the same group.

    Spark's moments use the population sd and are rescaled to the sample sd.
    """
    a = lambda m: F.col(_quoted(f"{prefix}_{m}"))
    share = F.try_divide(a("n") - 1, a("n"))
    if measure == "cv":
        return F.try_divide(a("sd"), a("mean")) * 100
    if measure == "skewness":
        return F.when((a("n") > 2) & (a("sd") > 0), a("skewness") * F.pow(share, F.lit(1.5)))
    if measure == "kurtosis":
        return F.when((a("n") > 3) & (a("sd") > 0), (a("kurtosis") + 3) * F.pow(share, F.lit(2.0)) - 3)
    return a(measure)


def grouped_stats(
    df: DataFrame,
    keys: Sequence[str],
    spec: Spec,
    extra: Mapping[str, Tally | Column | str] | None = None,
    outside: tuple[str, Mapping[str, float]] | None = None,
) -> DataFrame:
    """Aggregate ``{prefix: (column, measures)}`` to columns ``prefix_measure``.

    ``extra`` adds named counts (``Tally``) or other aggregates.  Without quantiles
    this is one plain aggregate.  With them everything comes from the distinct
    values and their counts, which one scan gives (see ``order_stats``); only
    aggregates other than counts then read ``df`` once more.  ``outside`` =
    (column, {name: k}) counts the rows beyond k interquartile ranges.
    """
    keys, extra = list(keys), dict(extra or {})
    by = [F.col(_quoted(k)) for k in keys]
    names = [F.col(_quoted(n)) for n in [*extra, *(outside[1] if outside else ())]]
    final = [F.col(_quoted(f"{prefix}_{m}")) for prefix, (_, measures) in spec.items() for m in measures]
    if outside or any(m in QUANTILES for _, measures in spec.values() for m in measures):
        tallies = {n: e for n, e in extra.items() if isinstance(e, Tally)}
        others = {n: e for n, e in extra.items() if n not in tallies}
        base = described(df, keys, spec, tallies, outside)
        if others:
            more = df.groupBy(*by).agg(*[(F.expr(e) if isinstance(e, str) else e).alias(n) for n, e in others.items()])
            base = attach(base, more, keys) if keys else attach_row(base, more)
        return base.select(*by, *names, *final)
    aggs = [(e.column() if isinstance(e, Tally) else F.expr(e) if isinstance(e, str) else e).alias(n) for n, e in extra.items()]
    for prefix, (column, measures) in spec.items():
        needed = set(measures)
        for m in measures:
            needed.update(_NEEDS.get(m, ()))
        c = no_nan(F.col(_quoted(column)))
        aggs += [how(c).alias(f"{prefix}_{m}") for m, how in _SIMPLE.items() if m in needed]
    if not aggs and not keys:
        aggs.append(F.count(F.lit(1)).alias("__rows"))  # one row, also for empty input
    base = df.groupBy(*by).agg(*aggs) if aggs else df.select(*by).distinct()
    return base.select(
        *by,
        *names,
        *[
            _measure(prefix, m).alias(f"{prefix}_{m}")
            for prefix, (_, measures) in spec.items()
            for m in measures
        ],
    )


# -- general description ----------------------------------------------------
DESCRIBE = ("n", "mean", "median", "sd", "variance", "min", "max", "q25", "q75", "iqr", "cv", "skewness", "kurtosis")


def describe_metric(
    df: DataFrame,
    columns: Mapping[str, str] | Sequence[str],
    by: Sequence[str] = (),
) -> DataFrame:
    """Thirteen measures per column over finite values: one row per metric.

    The columns are aggregated side by side in one pass and turned into rows
    afterwards, so the input rows are not multiplied.
    """
    labels = dict(columns) if isinstance(columns, Mapping) else {c: c for c in columns}
    keys = [F.col(_quoted(k)) for k in by]
    limit = F.lit(float("inf"))
    finite = df.select(
        *keys,
        *[
            F.when(~F.isnan(_quoted(c)) & (F.abs(F.col(_quoted(c))) < limit), F.col(_quoted(c))).alias(f"__{i}")
            for i, c in enumerate(labels)
        ],
    )
    wide = grouped_stats(finite, list(by), {f"m{i}": (f"__{i}", DESCRIBE) for i in range(len(labels))})
    rows = [
        F.struct(F.lit(label).alias("metric"), *[F.col(f"m{i}_{m}").alias(m) for m in DESCRIBE])
        for i, label in enumerate(labels.values())
    ]
    return wide.select(*keys, F.inline(F.array(*rows)))


def overall_stats(runs: DataFrame) -> DataFrame:
    return describe_metric(runs, S.OVERALL_METRICS)


# -- statistics per benchmark, variant and pair -----------------------------
def stats_by_benchmark(runs: DataFrame) -> DataFrame:
    spec = {
        "energy": ("energy_joules", FULL),
        "time": ("exec_time_sec", SHORT),
        "power": ("power_watts", SHORT),
        "cpu": ("cpu_usage_avg", CENTER),
        "memory": ("memory_usage_avg", CENTER),
    }
    extra = {"n_runs": ROWS, "n_variants": Tally("distinct", "variant")}
    return grouped_stats(runs, ["benchmark"], spec, extra)


def stats_by_variant(runs: DataFrame) -> DataFrame:
    spec = {
        "energy": ("energy_joules", FULL),
        "power": ("power_watts", CENTER),
        "cpu": ("cpu_usage_avg", CENTER),
        "memory": ("memory_usage_avg", CENTER),
    }
    extra = {"n_runs": ROWS, "n_benchmarks": Tally("distinct", "benchmark")}
    return grouped_stats(runs, ["variant"], spec, extra).orderBy(F.desc("energy_mean"), "variant")


#: Interquartile ranges beyond the quartiles.
FENCES = {"n_outliers_moderate": 1.5, "n_outliers_extreme": 3.0}


def _outliers(runs: DataFrame) -> dict:
    """How outliers are counted: by the flags of the rows, else by the fences of each pair.

    Missing flags do not count; a group without flags has zero outliers.
    """
    flags = {"n_outliers_moderate": "is_outlier_moderate", "n_outliers_extreme": "is_outlier_extreme"}
    if set(flags.values()) <= set(runs.columns):
        return {"extra": {n: Tally("where", f) for n, f in flags.items()}}
    return {"outside": ("energy_joules", FENCES)}


def _with_outliers(runs: DataFrame, spec: Spec, extra: Mapping[str, Tally]) -> DataFrame:
    how = _outliers(runs)
    return grouped_stats(runs, ["benchmark", "variant"], spec, {**extra, **how.get("extra", {})}, how.get("outside"))


def stats_by_benchmark_variant(runs: DataFrame) -> DataFrame:
    """Statistics per (benchmark, variant) with its outliers.

    Runs without outlier flags are counted by the fences of their pair, from the
    same scan as everything else; flags that are there are used.
    """
    spec = {
        "energy": ("energy_joules", FULL),
        "time": ("exec_time_sec", WITH_VARIANCE),
        "power": ("power_watts", WITH_VARIANCE),
        "cpu": ("cpu_usage_avg", WITH_VARIANCE),
        "memory": ("memory_usage_avg", WITH_VARIANCE),
    }
    return _with_outliers(runs, spec, {"n_runs": ROWS}).withColumn(
        "outlier_rate", F.col("n_outliers_moderate") / F.col("n_runs") * 100
    )


def baseline_stats(runs: DataFrame, baseline: str = S.BASELINE) -> DataFrame:
    """Baseline centre per benchmark; the one helper behind every comparison."""
    spec = {
        "baseline_energy": ("energy_joules", ("mean", "median")),
        "baseline_power": ("power_watts", ("mean",)),
        "baseline_time": ("exec_time_sec", ("mean",)),
        "baseline_cpu": ("cpu_usage_avg", ("mean",)),
        "baseline_memory": ("memory_usage_avg", ("mean",)),
    }
    return grouped_stats(runs.filter(F.col("variant") == baseline), ["benchmark"], spec)


def data_quality(runs: DataFrame) -> DataFrame:
    """Missing readings, outliers (as in ``stats_by_benchmark_variant``) and stability per pair."""
    missing = {
        f"missing_{name}": Tally("where", f"{c} IS NULL OR isnan({c})")
        for name, c in (
            ("energy", "energy_joules"),
            ("power", "power_watts"),
            ("cpu", "cpu_usage_avg"),
            ("memory", "memory_usage_avg"),
        )
    }
    stats = _with_outliers(runs, {"energy": ("energy_joules", ("cv",))}, {"n_runs": ROWS, **missing})
    return stats.withColumns(
        {
            "outlier_rate_pct": F.col("n_outliers_moderate") / F.col("n_runs") * 100,
            "stability": stability_5("energy_cv"),
        }
    )


# -- report tables ----------------------------------------------------------
def table1_overall(runs: DataFrame) -> DataFrame:
    spec = {
        "energy": ("energy_joules", ("mean", "median", "sd", "iqr")),
        "power": ("power_watts", ("mean", "median")),
        "cpu": ("cpu_usage_avg", ("mean",)),
        "memory": ("memory_usage_avg", ("mean",)),
    }
    stats = grouped_stats(runs, [], spec, {"n": ROWS})
    return stats.select(F.lit("All Data").alias("metric"), "*")


def table2_by_variant(runs: DataFrame) -> DataFrame:
    spec = {
        "energy": ("energy_joules", ("mean", "median", "sd", "min", "max", "iqr", "cv")),
        "power": ("power_watts", ("mean",)),
        "cpu": ("cpu_usage_avg", ("mean",)),
        "memory": ("memory_usage_avg", ("mean",)),
    }
    stats = grouped_stats(runs, ["variant"], spec, {"n": ROWS})
    return stats.orderBy(F.round("energy_median", 2), "variant")


def table3_by_benchmark(runs: DataFrame) -> DataFrame:
    spec = {
        "energy": ("energy_joules", ("mean", "median", "sd", "min", "max", "cv")),
        "power": ("power_watts", ("mean",)),
        "cpu": ("cpu_usage_avg", ("mean",)),
    }
    extra = {"n": ROWS, "variants_tested": Tally("distinct", "variant")}
    stats = grouped_stats(runs, ["benchmark"], spec, extra)
    return stats.orderBy(F.desc(F.round("energy_median", 2)), "benchmark")


def table7_quality_matrix(runs: DataFrame) -> DataFrame:
    stats = _with_outliers(runs, {"energy": ("energy_joules", ("cv",))}, {"n": ROWS})
    return stats.withColumns(
        {
            "outlier_rate": F.col("n_outliers_moderate") / F.col("n") * 100,
            "stability": stability_4("energy_cv"),
        }
    )


def table10_guideline(
    runs: DataFrame, guidelines: Sequence[str] = tuple(S.ALL_GUIDELINES)
) -> DataFrame:
    """Guidelines against the median of all baseline runs pooled together."""
    spec = {
        "energy": ("energy_joules", ("median", "mean", "cv")),
        "power": ("power_watts", ("median",)),
        "cpu": ("cpu_usage_avg", ("mean",)),
    }
    extra = {"n_runs": ROWS, "n_benchmarks": Tally("distinct", "benchmark")}
    stats = grouped_stats(
        runs.filter(F.col("variant").isin(list(guidelines))), ["variant"], spec, extra
    )
    pooled = pooled_baseline(runs)
    return (
        attach_row(stats, pooled.select("pooled_energy_median"))
        .withColumn(
            "vs_baseline_pct",
            F.try_divide(F.col("energy_median") - F.col("pooled_energy_median"), F.col("pooled_energy_median")) * 100,
        )
        .drop("pooled_energy_median")
        .withColumnRenamed("variant", "guideline")
        .orderBy(F.round("energy_median", 2), "guideline")
    )


def pooled_baseline(runs: DataFrame, baseline: str = S.BASELINE) -> DataFrame:
    spec = {
        "pooled_energy": ("energy_joules", ("median",)),
        "pooled_power": ("power_watts", ("median",)),
    }
    return grouped_stats(runs.filter(F.col("variant") == baseline), [], spec)


# -- telemetry --------------------------------------------------------------
def sample_measures(
    samples: DataFrame,
    power: str = "SYSTEM_POWER (Watts)",
    cpu_prefix: str = "CPU_USAGE_",
    used: str = "USED_MEMORY",
    total: str = "TOTAL_MEMORY",
) -> dict[str, Column]:
    """Per-sample power, mean core usage and memory share."""
    return {
        "power": no_nan(F.col(f"`{power}`").cast("double")),
        "cpu_pct": row_mean(samples, cpu_prefix),
        "mem_pct": memory_pct(F.col(used).cast("double"), F.col(total).cast("double")),
    }


def run_rollup(samples: DataFrame, keys: Sequence[str], measures: Mapping[str, Column] | None = None) -> DataFrame:
    """Samples to one row per run.  Missing readings are skipped, never zero."""
    m = measures or sample_measures(samples)
    return (
        samples.select(*keys, *[c.alias(f"__{n}") for n, c in m.items()])
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("n_samples"),
            F.avg("__power").alias("avg_power_watts"),
            F.max("__power").alias("max_power_watts"),
            F.min("__power").alias("min_power_watts"),
            F.avg("__cpu_pct").alias("cpu_usage_avg"),
            F.avg("__mem_pct").alias("memory_usage_avg"),
        )
    )


# -- small summaries --------------------------------------------------------
def type_comparison(pair_stats: DataFrame) -> DataFrame:
    """Mean of means and median of medians per benchmark and variant type."""
    typed = pair_stats.withColumn("variant_type", variant_type_of("variant"))
    spec = {"of_mean": ("energy_mean", ("mean",)), "of_median": ("energy_median", ("median",))}
    return grouped_stats(typed, ["benchmark", "variant_type"], spec).select(
        "benchmark",
        "variant_type",
        F.col("of_mean_mean").alias("energy_mean"),
        F.col("of_median_median").alias("energy_median"),
    )


def count_flags(df: DataFrame, flags: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """How many rows carry each flag; missing flags do not count."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(f)).alias(f"n_{f}") for f in flags]
    )


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def before_after_count(df: DataFrame, predicate: Column) -> DataFrame:
    """Rows before and after a filter, in one pass."""
    return df.agg(F.count(F.lit(1)).alias("n_before"), F.count_if(predicate).alias("n_after"))


def file_inventory(files: DataFrame, group: str = "experiment", name: str = "file") -> DataFrame:
    """Every file of an experiment in order, with the experiment's file count.

    The sorted list stays one row per file and is ordered by a range sort, so an
    experiment with very many files is spread over tasks.
    """
    counts = files.groupBy(group).agg(F.count(F.lit(1)).alias("n_files"))
    return attach(files.select(group, name), counts, [group]).orderBy(group, name)
