"""Incremental ingest of telemetry files."""

from __future__ import annotations

import posixpath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Sums and counts of a run can be added up, averages cannot; the sink keeps the
# former so that a run may arrive in several files and batches.
_PARTS = {
    "n_samples": "sum",
    "power_n": "sum",
    "power_sum": "sum",
    "power_max": "max",
    "power_min": "min",
    "cpu_n": "sum",
    "cpu_sum": "sum",
    "mem_n": "sum",
    "mem_sum": "sum",
}


def _partial_rollup(batch: DataFrame, keys: list[str], measures: dict[str, Column]) -> DataFrame:
    rows = batch.select(*keys, *[c.cast("double").alias(f"__{n}") for n, c in measures.items()])
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.count("__power").alias("power_n"),
        F.sum("__power").alias("power_sum"),
        F.max("__power").alias("power_max"),
        F.min("__power").alias("power_min"),
        F.count("__cpu_pct").alias("cpu_n"),
        F.sum("__cpu_pct").alias("cpu_sum"),
        F.count("__mem_pct").alias("mem_n"),
        F.sum("__mem_pct").alias("mem_sum"),
    )


def merge_rollups(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Partial rows of all batches to one row per run."""
    merged = parts.groupBy(*keys).agg(
        *[(F.sum(c) if how == "sum" else F.max(c) if how == "max" else F.min(c)).alias(c) for c, how in _PARTS.items()]
    )
    return merged.select(
        *keys,
        "n_samples",
        F.try_divide("power_sum", "power_n").alias("avg_power_watts"),
        F.col("power_max").alias("max_power_watts"),
        F.col("power_min").alias("min_power_watts"),
        F.try_divide("cpu_sum", "cpu_n").alias("cpu_usage_avg"),
        F.try_divide("mem_sum", "mem_n").alias("memory_usage_avg"),
    )


def sample_stream(
    spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", files_per_batch: int = 1000, **options
) -> DataFrame:
    """New files below a path as a stream."""
    reader = spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_batch)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load(path)


def ingest_runs_incremental(
    stream: DataFrame, keys: list[str], measures: dict[str, Column], sink: str, checkpoint: str
) -> DataFrame:
    """Take in everything that has arrived; returns one row per run so far.

    Each batch is reduced to one partial row per run and written to its own
    folder, which a repeated batch overwrites, so a restart neither loses nor
    doubles rows.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        _partial_rollup(batch, keys, measures).write.mode("overwrite").parquet(
            posixpath.join(sink, f"batch_id={batch_id}")
        )

    query = (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    # with the declared columns, so that no arrival yet means no rows
    parts = _partial_rollup(stream, keys, measures).schema
    spark = stream.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(sink)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return merge_rollups(spark.createDataFrame([], parts), keys)
    return merge_rollups(spark.read.schema(parts).option("recursiveFileLookup", True).parquet(sink), keys)


def telemetry_windows(
    stream: DataFrame,
    time: str,
    keys: list[str],
    value: str,
    sink: str,
    checkpoint: str,
    width: str = "10 seconds",
    delay: str = "1 minute",
    unique: list[str] | None = None,
) -> DataFrame:
    """Closed event-time windows with late data up to ``delay`` (an addition).

    ``unique`` drops repeated samples that arrive within the delay.
    """
    timed = stream.withWatermark(time, delay)
    if unique:
        timed = timed.dropDuplicatesWithinWatermark([*unique])
    windows = (
        timed.groupBy(F.window(time, width), *keys)
        .agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.max(value).alias("highest"))
        .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *keys, "n", "mean", "highest")
    )
    query = (
        windows.writeStream.format("parquet")
        .outputMode("append")
        .option("path", sink)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(windows.schema).parquet(sink)
