"""Telemetry samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runlens import schema as S
from runlens.functions.scalars import no_nan


def scan_telemetry(
    spark: SparkSession, pattern: str, schema: T.StructType | None = None
) -> DataFrame:
    """Wide sample rows with NaN readings as null, the source file and a timestamp."""
    df = (
        spark.read.schema(schema or S.telemetry_schema())
        .option("header", True)
        .option("nanValue", "NaN")
        .option("recursiveFileLookup", True)
        .csv(pattern)
    )
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)]
    return df.select(
        F.col("_metadata.file_path").alias("path"),
        F.timestamp_millis("Time").alias("event_time"),
        *[
            no_nan(F.col(f"`{c}`")).alias(c) if c in doubles else F.col(f"`{c}`")
            for c in df.columns
        ],
    )


def core_usage_long(samples: DataFrame, keys: list[str], prefix: str = "CPU_USAGE_") -> DataFrame:
    """One row per core and sample."""
    names = [c for c in samples.columns if c.startswith(prefix)]
    return samples.unpivot(keys, names, "core", "usage")
