"""Session defaults and the shared working folder."""

from __future__ import annotations

import posixpath
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = "*", memory: str = "12g") -> SparkSession:
    """A session for tests and benchmarks on one machine.

    On a cluster the caller brings a session.  AQE and the broadcast threshold
    keep Spark's defaults; splitting skewed joins is worth forcing, so that it
    also happens where an aggregate on the same key follows the join.
    """
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("runlens")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def setting(spark: SparkSession, key: str, default: str | None = None) -> str | None:
    """A value from the session, then from the context, then the default."""
    value = spark.conf.get(key, None)
    if value is None:
        value = spark.sparkContext.getConf().get(key, None)
    return default if value is None else value


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as named in ``spark.checkpoint.dir``.

    Only a local session without that setting falls back to a temporary folder;
    a cluster session without it is an error, because a machine-local folder
    would be lost with its machine.
    """
    configured = setting(spark, "spark.checkpoint.dir")
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    return _local_folder(spark.sparkContext.applicationId)


@lru_cache(maxsize=8)
def _local_folder(application: str) -> str:
    """One temporary folder for each local application; the caller's settings stay as they are."""
    return tempfile.mkdtemp(prefix="runlens-")


def work_path(spark: SparkSession, *parts: str) -> str:
    """A path below the shared folder that belongs to this application."""
    return posixpath.join(
        shared_dir(spark), "runlens", spark.sparkContext.applicationId, *parts
    )


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table to the shared folder and read it again.

    Several later passes then read the reduced rows, not their inputs, and a lost
    executor costs no more than its tasks.
    """
    path = work_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
