"""Numpy partial results per task, combined by Spark."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F


def combined(
    df: DataFrame,
    columns: Sequence[str],
    partial: Callable[[np.ndarray], np.ndarray],
    size: int,
    how: str = "sum",
) -> np.ndarray:
    """Fold ``partial(block)`` (a vector of fixed ``size``) over all row blocks by sum or max.

    Each task sends one vector; the result has ``size`` numbers whatever the number of rows.
    """
    columns = list(columns)
    add = np.add if how == "sum" else np.maximum

    def run(batches):
        total = np.zeros(size)
        for batch in batches:
            if len(batch):
                total = add(total, np.asarray(partial(batch[columns].to_numpy(dtype=float))).ravel())
        yield pd.DataFrame({"pos": np.arange(size, dtype=np.int32), "v": total})

    fold = F.sum("v") if how == "sum" else F.max("v")
    rows = df.select(*columns).mapInPandas(run, "pos int, v double").groupBy("pos").agg(fold.alias("v"))
    out = np.zeros(size)
    for row in rows.collect():
        out[row["pos"]] = row["v"]
    return out
