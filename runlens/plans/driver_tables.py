"""The run table and other inputs derived from the star-schema tables."""

from __future__ import annotations

import posixpath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Line number to variant.
VARIANT_OF_LINE = {
    1: "BASELINE",
    2: "OPTIMIZED",
    3: "G1",
    4: "G3",
    5: "G9",
    6: "G12",
    7: "G14",
}
VARIANTS = list(VARIANT_OF_LINE.values())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(posixpath.join(sf_dir, f"{name}.parquet"))


def variant_column() -> Column:
    pairs = [F.lit(x) for item in VARIANT_OF_LINE.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), F.col("l_linenumber"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run per line item."""
    text = lambda c: F.col(c).cast("string")
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("results_"), F.month("l_shipdate").cast("string")).alias("results_set"),
        F.concat(F.lit("run_"), text("l_orderkey"), F.lit("_"), text("l_linenumber")).alias("run_id"),
        F.concat(F.lit("b"), (F.col("l_suppkey") % 10).cast("string")).alias("benchmark"),
        variant_column().alias("variant"),
        F.col("l_extendedprice").alias("energy_joules"),
        F.col("l_quantity").alias("exec_time_sec"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("power_watts"),
        (F.nullif(F.col("l_discount"), F.lit(0.0)) * 100).alias("cpu_usage_avg"),
        (F.col("l_tax") * 100).alias("memory_usage_avg"),
    )


def python_file() -> Column:
    """A program path for a run, as the experiment runner would name it."""
    suffix = F.when(F.col("variant") == "BASELINE", F.lit("")).otherwise(
        F.concat(F.lit("_"), F.col("variant"))
    )
    return F.concat("benchmark", F.lit("/"), "benchmark", suffix, F.lit(".py"))
