"""Cutting lineage through storage that every executor can reach."""

from __future__ import annotations

import gc
import math
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Rows for which a second task is not worth its files.
TASK_ROWS = 65_536


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder the session names; a temporary one only where none is named and all runs on this machine."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[.*\])?", context.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors reach")
    context.setCheckpointDir(named or tempfile.mkdtemp(prefix="assayer-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def narrowed(df: DataFrame) -> DataFrame:
    """``df``, checkpointed, in partitions that follow its rows.

    A shuffle leaves files for each partition it reads and a block for each pair of partitions, however few the rows. Up to
    TASK_ROWS rows come in one partition, which joins and aggregates take as it is; more keep every core busy.
    """
    made = checkpointed(df)
    now = made.rdd.getNumPartitions()
    rows = made.count() if now > 1 else 0
    if rows <= TASK_ROWS:
        # written once more, since one task would open every file at each reading
        return (checkpointed(made.coalesce(1)) if now > 1 else made).coalesce(1)
    return made.coalesce(min(now, max(made.sparkSession.sparkContext.defaultParallelism, math.ceil(rows / TASK_ROWS))))


def together(df: DataFrame, *sources: DataFrame) -> DataFrame:
    """``df`` in one partition if each of its narrowed ``sources`` lies in one: unions and inner joins forget that."""
    return df.coalesce(1) if all(x.rdd.getNumPartitions() == 1 for x in sources) else df


def swept(spark: SparkSession) -> None:
    """Let go of the shuffles and checkpoints of earlier rounds of a loop.

    Spark deletes them once their tables are garbage, which on the driver of a long loop is collected late; until then
    every round leaves its files.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
