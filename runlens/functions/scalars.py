"""Scalar expressions over run columns.  All are built-in functions, no UDFs."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens import schema as S


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# -- numbers ----------------------------------------------------------------
def draw(*parts: Column) -> Column:
    """A uniform number between 0 and 1, both excluded, from the md5 of the parts' text.

    52 bits of the digest count; any engine with md5 gives the same number.
    """
    bits = F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 13), 16, 10)
    return (bits.cast("bigint").cast("double") + 0.5) / 2.0**52


def safe_numeric(c: Column | str) -> Column:
    """Text to double; malformed text and NaN become null."""
    value = col(c).try_cast("double")
    return F.when(~F.isnan(value), value)


def no_nan(c: Column | str) -> Column:
    """NaN to null, so that aggregates skip it like any missing value."""
    return F.when(~F.isnan(col(c)), col(c))


def is_finite(c: Column | str) -> Column:
    value = col(c)
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))


def finite_only(df: DataFrame, column: str) -> DataFrame:
    return df.filter(is_finite(column))


def pct_change(x: Column | str, base: Column | str) -> Column:
    """Percent change of ``x`` against ``base``; null when the base is zero."""
    return F.try_divide(col(x) - col(base), col(base)) * 100


def coalesce_sources(
    primary: Column | str, fallback: Column | str, repair_zero: bool = False
) -> Column:
    """Prefer the run table, fall back to the log.

    Failed measurements are stored as zero.  ``repair_zero`` treats that zero
    as missing, so that the log value is used.
    """
    first = F.nullif(col(primary), F.lit(0.0)) if repair_zero else col(primary)
    return F.coalesce(first, col(fallback))


def derive_power(power: Column | str, energy: Column | str, seconds: Column | str) -> Column:
    """Power as measured, otherwise energy over time where time is positive."""
    e, s = col(energy), col(seconds)
    return F.when(col(power).isNull() & (s > 0), F.try_divide(e, s)).otherwise(col(power))


def memory_pct(used: Column | str, total: Column | str) -> Column:
    return F.try_divide(col(used), col(total)) * 100


def row_mean(df: DataFrame, prefix: str) -> Column:
    """Mean over all columns that start with ``prefix``, missing cells skipped."""
    names = [c for c in df.columns if c.startswith(prefix)]
    if not names:
        return F.lit(None).cast("double")
    cells = F.filter(
        F.array(*[F.col(f"`{n}`").cast("double") for n in names]),
        lambda v: v.isNotNull() & ~F.isnan(v),
    )
    total = F.aggregate(cells, F.lit(0.0), lambda acc, v: acc + v)
    return F.try_divide(total, F.size(cells))


def round_metrics(df: DataFrame, columns: Iterable[str], digits: int = 3) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def winsorize(x: Column | str, limit: float, label_gap: float = 8) -> dict[str, Column]:
    """Clamp to ±limit and describe what was cut off."""
    value = col(x)
    over = F.abs(value) > limit
    return {
        "is_truncated": over,
        "label_text": F.when(
            over, F.format_string("%+.0f%%", F.round(value).cast("double"))
        ).otherwise(""),
        "label_y": F.when(value > limit, F.lit(float(limit - label_gap))).when(
            value < -limit, F.lit(float(label_gap - limit))
        ),
        "display_value": clamp(value, limit),
    }


def clamp(x: Column | str, limit: float) -> Column:
    value = col(x)
    bounded = F.greatest(F.lit(-float(limit)), F.least(F.lit(float(limit)), value))
    return F.when(value.isNotNull(), bounded)


def clamp_interval(
    lower: Column | str, upper: Column | str, limit: float
) -> tuple[Column, Column]:
    """Clip the lower bound at -limit and the upper bound at +limit."""
    low = F.when(col(lower).isNotNull(), F.greatest(col(lower), F.lit(-float(limit))))
    high = F.when(col(upper).isNotNull(), F.least(col(upper), F.lit(float(limit))))
    return low, high


def normal_ci(
    mean: Column | str, se: Column | str, z: float = 1.96
) -> tuple[Column, Column]:
    return col(mean) - z * col(se), col(mean) + z * col(se)


# -- names and paths --------------------------------------------------------
def parse_variant(path: Column | str) -> dict[str, Column]:
    """Benchmark and variant from ``folder/benchmark_VARIANT.py``."""
    text, end = col(path), F.lit(".py")
    # plain searches: a pattern and a split would be evaluated again wherever a column is used
    name = (
        F.when(F.endswith(text, end), F.substr(text, F.lit(1), F.length(text) - 3))
        .when(F.contains(text, end), F.regexp_replace(text, r"\.py$", ""))
        .otherwise(text)
    )
    stem = F.substring_index(name, "/", -1)
    folder = F.substring_index(F.substring_index(name, "/", -2), "/", 1)
    nested = F.contains(text, F.lit("/"))
    benchmark = F.when(nested, folder).otherwise(stem)
    # without a folder the stem is the benchmark
    marked = nested & F.startswith(stem, F.concat(folder, F.lit("_")))
    variant = F.when(marked, F.substr(stem, F.length(folder) + 2)).otherwise(S.BASELINE)
    return {"benchmark": benchmark, "variant": F.when(col(path).isNotNull(), variant)}


def derive_log_path(
    root: str, results_set: Column | str, subdir: str, run_id: Column | str, name: str
) -> Column:
    return F.concat_ws(
        "/", F.lit(root), col(results_set), F.lit(subdir), col(run_id), F.lit(name)
    )


def split_last_token(name: Column | str) -> dict[str, Column]:
    """Split at the last underscore."""
    pattern = r"^(.*)_([^_]+)$"
    matched = col(name).rlike(pattern)
    return {
        "head": F.when(matched, F.regexp_extract(col(name), pattern, 1)).otherwise(col(name)),
        "tail": F.when(matched, F.regexp_extract(col(name), pattern, 2)),
    }


def clean_column_names(
    df: DataFrame, renames: Mapping[str, str], keep: Iterable[str] | None = None
) -> DataFrame:
    renamed = df.withColumnsRenamed(dict(renames))
    return renamed.select(*[F.col(f"`{c}`") for c in keep]) if keep is not None else renamed


# -- predicates -------------------------------------------------------------
def exclude_variants(
    df: DataFrame, variants: Iterable[str] = tuple(S.EXCLUDED_VARIANTS), column: str = "variant"
) -> DataFrame:
    """Drop the named variants; rows without a variant stay."""
    return df.filter(F.col(column).isNull() | ~F.col(column).isin(list(variants)))


def exclude_pair(
    df: DataFrame, pairs: Iterable[tuple[str, str]], columns=("benchmark", "variant")
) -> DataFrame:
    """Drop the named (benchmark, variant) combinations."""
    first, second = columns
    for a, b in pairs:
        df = df.filter(~(F.col(first).eqNullSafe(a) & F.col(second).eqNullSafe(b)))
    return df


# -- labels -----------------------------------------------------------------
def stability_5(cv: Column | str) -> Column:
    c = col(cv)
    return (
        F.when(c < 5, "Very Stable")
        .when(c < 10, "Stable")
        .when(c < 20, "Moderate")
        .when(c < 30, "Variable")
        .otherwise("Highly Variable")
    )


def stability_4(cv: Column | str) -> Column:
    c = col(cv)
    return (
        F.when(c < 10, "Stable")
        .when(c < 20, "Moderate")
        .when(c < 30, "Variable")
        .otherwise("High Var")
    )


def variant_type(variant: Column | str) -> Column:
    v = col(variant)
    return (
        F.when(v == S.BASELINE, "Baseline").when(v == S.OPTIMIZED, "Optimized").otherwise("Guideline")
    )


def guideline_family(variant: Column | str) -> Column:
    v = col(variant)
    return F.when(v.isin(S.CODE_FAMILY), "CODE_OPTIMIZATION").when(
        v.isin(S.PARALLEL_FAMILY), "MULTITHREADING"
    )


def significance_label(p: Column | str) -> Column:
    c = col(p)
    return F.when(c < 0.001, "***").when(c < 0.01, "**").when(c < 0.05, "*").otherwise("ns")


def improved_label(treated: Column | str, control: Column | str) -> dict[str, Column]:
    improved = col(treated) < col(control)
    return {
        "improved": improved,
        "improvement_label": F.when(improved, "Improved").when(~improved, "Worsened"),
    }


def metric_label(name: Column | str, labels: Mapping[str, str] = S.METRIC_LABELS) -> Column:
    """Display name of a metric column; unknown names pass through."""
    pairs = [F.lit(x) for item in labels.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), col(name)), col(name))


# -- report text ------------------------------------------------------------
def fixed(c: Column | str, digits: int = 2, sign: bool = False) -> Column:
    """Number as text with fixed decimals, null stays null."""
    value = F.round(col(c).cast("double"), digits)
    return F.when(
        value.isNotNull(), F.format_string(f"%{'+' if sign else ''}.{digits}f", value)
    )


def span(low: Column | str, high: Column | str, digits: int = 2) -> Column:
    return F.concat(fixed(low, digits), F.lit(" - "), fixed(high, digits))


def percent_text(c: Column | str, digits: int = 1, sign: bool = True) -> Column:
    return F.concat(fixed(c, digits, sign), F.lit("%"))
