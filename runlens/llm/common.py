"""Helpers that several operators share."""

from __future__ import annotations

import posixpath
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.session import shared_dir

#: Characters that separate words and may be collapsed: space and U+0009 to U+000D.
BLANK = r"[\x20\x09-\x0D]"
#: Seconds until the JVM knows what Python has let go of.
TOLD = 1.2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(posixpath.join(sf_dir, f"{name}.parquet"))


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share."""
    return posixpath.join(shared_dir(spark), "runlens-llm", f"{name}-{uuid.uuid4().hex}")


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it again.

    This cuts the lineage: a lost executor costs one task of the write, not the
    whole history, and the parts are the same however often they are read.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of frames that are no longer referenced.

    They go when the driver's JVM collects its garbage, which may otherwise be
    half an hour away; between phases of a long job that is disk held for nothing.
    Python tells the JVM once a second what it has let go of, so this waits for that.
    """
    import gc

    gc.collect()
    time.sleep(TOLD)
    spark._jvm.System.gc()


def ascii_lower(column: Column) -> Column:
    """A-Z to a-z; other letters stay."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def byte_slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose texts have about ``most`` bytes together, one row at least."""
    n = batch.num_rows
    if not n:
        return
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    start = 0
    while start < n:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def list_array(lists: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    """Arrow lists from numpy arrays."""
    offsets = np.zeros(len(lists) + 1, np.int32)
    np.cumsum([len(x) for x in lists], out=offsets[1:])
    values = np.concatenate(lists) if lists else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values).cast(kind))


def joinable(df: DataFrame, row_bytes: int, most_bytes: int = 8 << 20) -> DataFrame:
    """``df`` marked for broadcast if it is small enough, else as it is, for a shuffled join.

    ``df`` must be cheap to count (a table already written); the count is exact.
    """
    return F.broadcast(df) if df.count() * row_bytes <= most_bytes else df
