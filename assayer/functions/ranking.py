"""Row numbers, dense ranks and running maxima without putting a whole group into one task.

Rows are cut into slices, by hash or by ranges of their order. Each slice is worked on by itself, and a table of one row a
slice says what comes before it. The number of slices follows the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from assayer.functions.columns import MIX_MODULUS, mix
from assayer.functions.cutting import checkpointed

#: Rows that one task numbers at a time.
ROWS_A_SLICE = 50_000


def mixed_row_number(
    df: DataFrame,
    key: Column,
    seed: int,
    by: Sequence[str] = (),
    name: str = "rn",
    rows_a_slice: int = ROWS_A_SLICE,
) -> DataFrame:
    """``row_number() OVER (PARTITION BY by ORDER BY mix(key, seed), key)`` as column ``name``.

    The mix is uniform, so equal slices of its range hold equal shares of any group. Each slice is
    numbered on its own; a small table of slice counts gives the numbers that come before it.
    """
    slices = max(1, -(-df.count() // rows_a_slice))
    keyed = df.withColumn("_mix", mix(key, seed)).withColumn("_key", key)
    keyed = keyed.withColumn(
        "_slice", F.floor(F.col("_mix") * slices / MIX_MODULUS).cast("int")
    )
    groups = [*by, "_slice"]
    inside = Window.partitionBy(*groups).orderBy("_mix", "_key")
    # one row a slice and group
    before = Window.partitionBy(*by).orderBy("_slice").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = (
        keyed.groupBy(*groups)
        .agg(F.count("*").alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    renamed = offsets.select(
        *(F.col(g).alias(f"_o_{g}") for g in groups), "_before"
    )
    on = [keyed[g].eqNullSafe(renamed[f"_o_{g}"]) for g in groups]
    return (
        keyed.withColumn(name, F.row_number().over(inside))
        .join(renamed, on=on, how="inner")
        .withColumn(name, F.col(name) + F.col("_before"))
        .drop("_mix", "_key", "_slice", "_before", *(f"_o_{g}" for g in groups))
    )


def _ranged(df: DataFrame, order: str) -> tuple[DataFrame, DataFrame]:
    """``df`` in ranges of ``order`` with _part and _at (place in the part), and (_part, _rows); parts follow the rows."""
    rows = checkpointed(df.repartitionByRange(order).sortWithinPartitions(order).withColumn("_id", F.monotonically_increasing_id()))
    placed = rows.withColumn("_part", F.shiftright("_id", 33)).withColumn("_at", F.col("_id").bitwiseAND(F.lit(2**33 - 1))).drop("_id")
    return placed, placed.groupBy("_part").agg(F.count("*").alias("_rows"))


_BEFORE = (Window.unboundedPreceding, -1)


def sorted_codes(values: DataFrame, column: str, name: str) -> DataFrame:
    """(column, name): the distinct present values with their places in sorted order, from 0."""
    placed, parts = _ranged(values.select(column).where(F.col(column).isNotNull()).distinct(), column)
    before = parts.withColumn("_before", F.coalesce(F.sum("_rows").over(Window.orderBy("_part").rowsBetween(*_BEFORE)), F.lit(0)))
    named = before.select(F.col("_part").alias("_p"), "_before")
    return placed.join(F.broadcast(named), F.col("_part") == F.col("_p")).select(
        column, (F.col("_before") + F.col("_at")).alias(name)
    )


def running_max(df: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """``df`` with the largest ``value`` up to each row of unique ``order``."""
    placed, _ = _ranged(df, order)
    tops = placed.groupBy("_part").agg(F.max(value).alias("_top"))
    before = tops.select(F.col("_part").alias("_p"), F.max("_top").over(Window.orderBy("_part").rowsBetween(*_BEFORE)).alias("_before"))
    inside = F.max(value).over(Window.partitionBy("_part").orderBy("_at"))
    return (
        placed.withColumn(name, inside).join(F.broadcast(before), F.col("_part") == F.col("_p"))
        .withColumn(name, F.greatest(name, "_before")).select(*df.columns, name)
    )
