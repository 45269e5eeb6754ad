"""Giving Python row work enough tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame

SMALL_ROWS = 20_000_000


def spread(df: DataFrame, n_rows: int) -> DataFrame:
    """Small tables often arrive as one split, which leaves heavy row work to a single task.

    Larger ones have splits enough and are not shuffled.
    """
    if n_rows > SMALL_ROWS or n_rows < 10_000:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)
