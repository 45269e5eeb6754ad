"""Vectors as packed integers, for the operators on embeddings."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from assayer.functions.columns import quoted

#: Integers beyond this are refused: sums of their products would leave the exact range.
LARGEST = 2**40


def usable(vector: str) -> F.Column:
    """True where the vector is not null and has no null, infinite or NaN component."""
    c = quoted(vector)
    good = F.forall(c, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < F.lit(float("inf"))) & ~F.isnan(x.cast("double")))
    return c.isNotNull() & F.coalesce(good, F.lit(False))


def packed(
    df: DataFrame, vector: str, keep: Sequence[tuple[F.Column, str]], scale: int, d: int, kind: str = "<i8", largest: int = LARGEST
) -> DataFrame:
    """``keep`` and x: floor(scale * component) of ``d`` components as integers of ``kind``; missing last ones count as zero."""
    taken = df.select(*(c.alias(n) for c, n in keep), quoted(vector).cast("array<double>").alias("__v"))
    schema = T.StructType([*taken.schema.fields[:-1], T.StructField("x", T.BinaryType())])
    kinds = [to_arrow_type(f.dataType) for f in schema.fields]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells = b.columns[-1]
            sizes = np.diff(cells.offsets.to_numpy())
            flat = cells.flatten().to_numpy(zero_copy_only=False)
            x = np.zeros((b.num_rows, d))
            x[np.repeat(np.arange(b.num_rows), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
            x = np.floor(scale * x)
            if x.size and np.abs(x).max() >= largest:
                raise ValueError(f"components of {vector} leave the range of exact sums")
            made = [*b.columns[:-1], pa.array([r.tobytes() for r in x.astype(kind)], pa.binary())]
            yield pa.RecordBatch.from_arrays([c.cast(k) for c, k in zip(made, kinds)], names=schema.names)

    return taken.mapInArrow(task, schema)


def rows_of(column: pa.Array, d: int, kind: str = "<i8") -> np.ndarray:
    """The packed vectors of a column as a matrix of integers."""
    cells = column.to_pylist()
    return np.frombuffer(b"".join(cells), kind).reshape(len(cells), d)


def dimension(df: DataFrame, vector: str) -> int:
    return df.agg(F.max(F.size(quoted(vector)))).first()[0] or 0
