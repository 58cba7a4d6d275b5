"""Session settings and durable materialisation."""

from __future__ import annotations

import gc
import math
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "quitanda", **conf: str) -> SparkSession:
    """Session for the batch job; cluster settings come from spark-submit.

    AQE is what keeps the joins safe at scale: it coalesces small shuffle
    partitions, splits skewed ones and switches to a broadcast only when the
    measured size of a side allows it.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # Checkpoint files go once nothing refers to their rows any more.
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Checkpoint folder of the session; a temporary one only in local mode."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="quitanda-checkpoint-", dir=os.environ.get("TMPDIR"))
    context.setCheckpointDir(configured)
    return context.getCheckpointDir()


# Rows of a few numbers that one task of an iterative pass takes on.
ROWS_PER_TASK = 200_000


def compacted(df: DataFrame, rows: int, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Materialised ``df`` read by no more tasks than its rows call for.

    Many passes over a small frame would otherwise pay for every empty
    partition of its last shuffle; large frames keep their partitions.
    """
    return df.coalesce(max(1, math.ceil(rows / rows_per_task)))


def durable(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder.

    Rows, their partition and their order inside it are then fixed, whatever
    executors are lost later.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def sweep(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files, cached rows and checkpoints of frames that nobody holds any more.

    It does so when the JVM collects those frames, which a large heap puts off while disks fill up.  What the last
    query held may go with the next sweep only.
    """
    gc.collect()
    spark._jvm.System.gc()
