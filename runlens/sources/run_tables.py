"""Run tables and other CSV inputs."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runlens import schema as S
from runlens.functions.scalars import (
    coalesce_sources,
    derive_log_path,
    derive_power,
    exclude_variants,
    parse_variant,
    safe_numeric,
)
from runlens.operators.order_stats import first_n_threshold
from runlens.operators.sizing import attach, attach_row


def path_component(path: Column, depth: int) -> Column:
    """The ``depth``-th component of a path from its end, 1 being the file.

    A ``key=value`` folder gives its value.
    """
    return F.regexp_replace(F.try_element_at(F.split(path, "/"), F.lit(-depth)), "^[^=]*=", "")


def scan_run_tables(
    spark: SparkSession,
    pattern: str,
    schema: T.StructType = S.RUN_TABLE_SCHEMA,
    set_depth: int = 3,
) -> DataFrame:
    """All run tables under a glob, tagged with the folder they came from.

    A declared schema avoids an inference pass.  Files that are missing or
    unreadable contribute no rows.
    """
    return (
        scan_tolerant(spark, pattern, schema)
        .withColumn("results_set", path_component(F.col("_metadata.file_path"), set_depth))
    )


def scan_tolerant(spark: SparkSession, pattern: str, schema: T.StructType) -> DataFrame:
    """CSV that skips unreadable files and keeps malformed rows as nulls; `scan_quarantine` tells which."""
    return _csv(spark, schema).option("enforceSchema", False).csv(pattern)


def _csv(spark: SparkSession, schema: T.StructType) -> DataFrameReader:
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("mode", "PERMISSIVE")
        .option("ignoreCorruptFiles", True)
        .option("ignoreMissingFiles", True)
        .option("recursiveFileLookup", True)
    )


def scan_quarantine(spark: SparkSession, pattern: str, schema: T.StructType) -> DataFrame:
    """What `scan_tolerant` leaves out or can't fill: one row for each bad line and for each file without rows.

    (path, reason, line): ``malformed line`` with the text of a line that has another
    number of cells than the header, or ``no rows`` with a null line for a file that is
    unreadable or only a header.  The files are listed without reading them; Spark's
    readers don't see files of zero bytes, so those are not named.
    """
    wide = T.StructType([*schema.fields, T.StructField("__line", T.StringType())])
    rows = _csv(spark, wide).option("columnNameOfCorruptRecord", "__line").csv(pattern)
    path = F.col("_metadata.file_path").alias("path")
    # always true; Spark counts the cells of a line only where all of them are wanted
    all_cells = F.length(F.concat_ws("", *[F.col(f"`{f.name}`").cast("string") for f in schema.fields])) >= 0
    bad = rows.filter(F.col("__line").isNotNull() & all_cells).select(path, "__line")
    listed = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(pattern).select(F.col("_metadata.file_path").alias("path"))
    )
    read = _csv(spark, schema).csv(pattern).select(path).groupBy("path").agg(F.count(F.lit(1)).alias("__rows"))
    return bad.select("path", F.lit("malformed line").alias("reason"), F.col("__line").alias("line")).unionByName(
        listed.join(read, "path", "left_anti").select("path", F.lit("no rows").alias("reason"), F.lit(None).cast("string").alias("line"))
    )


def require_columns(df: DataFrame, columns: Iterable[str] = tuple(S.RUN_KEYS)) -> DataFrame:
    """The same DataFrame, or an error naming what is absent.  Runs no job."""
    absent = [c for c in columns if c not in df.columns]
    if absent:
        raise ValueError(f"run table is missing required columns: {', '.join(absent)}")
    return df


def union_by_name(*frames: DataFrame) -> DataFrame:
    """All rows; columns absent from one input are null there."""
    out = frames[0]
    for other in frames[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    return out


def clean_runs(
    raw: DataFrame,
    logs: DataFrame | None = None,
    root: str = "",
    subdir: str = "",
    log_name: str = "run.log",
    repair_zero: bool = False,
) -> DataFrame:
    """Typed runs with benchmark, variant and measures filled in from the logs.

    ``logs`` has one row per (results_set, run_id) with ``energy_joules_log``
    and ``exec_time_sec_log``.
    """
    runs = require_columns(raw).withColumnRenamed("__run_id", "run_id")
    runs = runs.withColumns({c: safe_numeric(c) for c in S.RUN_METRICS})
    # made into a row of its own, so that the names are found once a run: a filter on plain
    # columns would be pushed below them, with a copy of their expressions for every use
    names = F.struct(*[c.alias(n) for n, c in parse_variant("python_file").items()])
    runs = exclude_variants(runs.select("*", F.inline(F.array(names))))
    runs = runs.withColumn("log_path", derive_log_path(root, "results_set", subdir, "run_id", log_name))
    if logs is None:
        none = F.lit(None).cast("double")
        runs = runs.withColumns({"energy_joules_log": none, "exec_time_sec_log": none})
    else:
        runs = runs_with_log(runs, logs)
    return runs.withColumns(
        {
            "energy_joules": coalesce_sources("total_energy_joules", "energy_joules_log", repair_zero),
            "exec_time_sec": coalesce_sources("execution_time_seconds", "exec_time_sec_log", repair_zero),
        }
    ).withColumn("power_watts", derive_power("avg_power_watts", "energy_joules", "exec_time_sec"))


def runs_with_log(runs: DataFrame, logs: DataFrame) -> DataFrame:
    """Logs joined on the run's key; runs without a log keep null readings."""
    return attach(
        runs,
        logs.select("results_set", "run_id", "energy_joules_log", "exec_time_sec_log"),
        ["results_set", "run_id"],
        null_safe=False,
    )


def scan_labelled_csv(
    spark: SparkSession,
    path: str,
    names: Sequence[str],
    label: str,
    id_column: str,
    labels: Mapping[str, int] | None = None,
) -> DataFrame:
    """Headerless labelled rows: id dropped, incomplete rows dropped, label to number."""
    values = labels or {"M": 1, "B": -1}
    schema = T.StructType(
        [
            T.StructField(n, T.StringType() if n in (label, id_column) else T.DoubleType())
            for n in names
        ]
    )
    mapping = F.create_map(*[F.lit(x) for item in values.items() for x in item])
    rows = spark.read.schema(schema).option("header", False).csv(path).drop(id_column)
    return rows.dropna("any").withColumn(label, F.try_element_at(mapping, F.col(label)))


def positional_split(df: DataFrame, n: int, key: str) -> tuple[DataFrame, DataFrame]:
    """First ``n`` rows by a unique numeric key, and the rest.

    Only the key at position ``n`` is determined; both parts are then plain
    filters, whatever ``n`` is.
    """
    marked = attach_row(df, first_n_threshold(df, key, n))
    first = F.coalesce(F.col(key) <= F.col("threshold"), F.lit(False))
    return marked.filter(first).drop("threshold"), marked.filter(~first).drop("threshold")


def hash_split(df: DataFrame, percent: int, key: str) -> tuple[DataFrame, DataFrame]:
    """About ``percent`` of the rows by a hash of the key, and the rest."""
    bucket = F.pmod(F.xxhash64(F.col(key)), F.lit(100))
    return df.filter(bucket < percent), df.filter(bucket >= percent)
