"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quitanda.session import durable, ensure_checkpoint_dir

__all__ = ["Scratch", "delete_folder", "durable", "given_back", "keep_rows", "release", "row_key", "size_checked"]

#: Rows of a few long columns that may be broadcast: some 16 MB.
BROADCAST_ROWS = 400_000


class Scratch:
    """Frames written to a folder of their own below the shared checkpoint folder.

    Unlike a checkpoint, a frame read back has the size of its files: the estimate that a
    checkpoint keeps is squared by every self-join, which no long iteration survives.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.folder = f"{ensure_checkpoint_dir(spark)}/scratch-{uuid.uuid4().hex}"
        self.frames = 0

    def save(self, df: DataFrame, *parts: str) -> DataFrame:
        """`df` as written and read back, in a folder for each value of `parts`, which must be its last columns."""
        path, self.frames = f"{self.folder}/{self.frames}", self.frames + 1
        df.write.partitionBy(*parts).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        """Delete the folder, once nothing lazy reads from it."""
        delete_folder(self.spark, self.folder)


def delete_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder on whichever file system its path names."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle files of frames that are materialised by now.

    It does so when the driver collects garbage, which a driver with little to do puts off.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def given_back(run: Callable) -> Callable:
    """A task function that hands freed memory back to the system as it ends: workers wait for later tasks."""

    @wraps(run)
    def tidy(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # a C library without it
                pass

    return tidy


def size_checked(small: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """`small`, marked for broadcast if a count proves that it has few narrow rows.

    Beyond the bound Spark shuffles both sides and splits skewed partitions.
    `small` should be materialised, since it is counted here.
    """
    return F.broadcast(small) if small.limit(rows + 1).count() <= rows else small


def row_key(doc_id: str, *columns: str) -> Column:
    """Key of a row by id and content: two hashes beside the id, so no two contents share one by chance; never null."""
    own = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    return F.struct(own.alias("id"), F.xxhash64(doc_id, *columns).alias("h1"), F.xxhash64(F.lit(11), *columns).alias("h2"))


def keep_rows(df: DataFrame, ids: DataFrame, key: str, how: str) -> DataFrame:
    """Semi or anti join of `df` with a materialised set of ids."""
    return df.join(size_checked(ids.select(key)), key, how)
