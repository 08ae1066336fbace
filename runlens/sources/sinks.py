"""Writers for results and the cleaned run table."""

from __future__ import annotations

import posixpath
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame


def write_outputs(
    results: Mapping[str, DataFrame], folder: str, fmt: str = "csv"
) -> dict[str, str]:
    """One folder per result table; returns where each one was written."""
    written = {}
    for name, df in results.items():
        path = posixpath.join(folder, name)
        writer = df.write.mode("overwrite")
        if fmt == "csv":
            writer.option("header", True).csv(path)
        else:
            writer.format(fmt).save(path)
        written[name] = path
    return written


def materialise_clean(
    runs: DataFrame, path: str, partition_by: Sequence[str] = ("benchmark",)
) -> DataFrame:
    """Write the cleaned runs once as Parquet and read them back.

    Every later result then scans only its own columns, and a filter on the
    partition column skips whole folders.
    """
    # rows of a folder meet in few tasks, and AQE splits the large ones: not tasks x folders files
    placed = runs.hint("rebalance", *partition_by) if partition_by else runs
    placed.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return runs.sparkSession.read.schema(runs.schema).parquet(path)
