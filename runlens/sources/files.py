"""File listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def discover_files(
    spark: SparkSession, root: str, include: str = "*", exclude: str | None = None
) -> DataFrame:
    """Paths below a folder.  Only the listing is used, contents are not read."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", include)
        .load(root)
        .select("path", "length")
    )
    return files.filter(~F.col("path").rlike(exclude)) if exclude else files
