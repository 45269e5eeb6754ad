"""Sufficient statistics for linear models: one aggregate, any grouping."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

WIDE = 24


def gram_by(
    df: DataFrame, columns: Sequence[Column], by: Sequence[str] = ()
) -> DataFrame:
    """Rows (*by, gram ARRAY<DOUBLE>): upper triangle of sum of z z' with z = (1, columns).

    ``columns`` must not be NULL. Sums combine map-side, so a hot group costs one small row per task.
    """
    z = [F.lit(1.0), *columns]
    if len(z) <= WIDE:
        pairs = [(i, j) for i in range(len(z)) for j in range(i, len(z))]
        sums = df.groupBy(*by).agg(
            *(F.sum(z[i] * z[j]).alias(f"g{i}_{j}") for i, j in pairs)
        )
        return sums.select(*by, F.array(*(f"g{i}_{j}" for i, j in pairs)).alias("gram"))

    flat = df.select(*by, F.array(*z[1:]).alias("z"))
    size = len(z)
    upper = np.triu_indices(size)

    def partial(batches):
        import pandas as pd

        keep: dict = {}
        for batch in batches:
            if not len(batch):
                continue
            groups = batch.groupby(list(by), dropna=False) if by else [((), batch)]
            for key, part in groups:
                block = np.vstack(part["z"].to_numpy())
                block = np.hstack([np.ones((len(block), 1)), block])
                key = key if isinstance(key, tuple) else (key,)
                keep[key] = keep.get(key, 0) + (block.T @ block)[upper]
        if keep:
            yield pd.DataFrame(
                [(*key, list(value)) for key, value in keep.items()], columns=[*by, "gram"]
            )

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in flat.schema if f.name in by])
    schema = (schema + ", " if schema else "") + "gram array<double>"
    parts = flat.mapInPandas(partial, schema)
    length = size * (size + 1) // 2
    return (
        parts.select(*by, F.posexplode("gram").alias("pos", "v"))
        .groupBy(*by, "pos")
        .agg(F.sum("v").alias("v"))
        .groupBy(*by)
        .agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("cells"))  # fixed length
        .select(*by, F.col("cells.v").alias("gram"))
        .where(F.size("gram") == length)
    )


def unpack(gram: Sequence[float]) -> np.ndarray:
    """Upper triangle back to the full symmetric matrix."""
    values = np.asarray(gram, dtype=float)
    size = int((np.sqrt(8 * len(values) + 1) - 1) / 2)
    full = np.zeros((size, size))
    full[np.triu_indices(size)] = values
    return full + np.triu(full, 1).T
