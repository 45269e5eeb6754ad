"""Column classes, missing-value tests and the keyed hash shared with SQL."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

FLOATING = (T.DoubleType, T.FloatType)

# Range of the keyed hash: ten hexadecimal digits of md5, which any SQL engine has.
MIX_DIGITS = 10
MIX_MODULUS = 16**MIX_DIGITS


def is_numeric(field: T.StructField, booleans: bool = True) -> bool:
    if isinstance(field.dataType, T.BooleanType):
        return booleans
    return isinstance(field.dataType, T.NumericType)


def split_columns(df: DataFrame, booleans: bool = True) -> tuple[list[str], list[str]]:
    """(numeric, other) column names in schema order; booleans count as numeric unless told not to."""
    numeric = [f.name for f in df.schema if is_numeric(f, booleans)]
    other = [f.name for f in df.schema if not is_numeric(f, booleans)]
    return numeric, other


def numeric_columns(df: DataFrame) -> list[str]:
    return split_columns(df)[0]


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def missing(df: DataFrame, name: str) -> Column:
    """True where the cell is NULL or, for floating columns, NaN."""
    col = quoted(name)
    if isinstance(df.schema[name].dataType, FLOATING):
        return col.isNull() | F.isnan(col)
    return col.isNull()


def present(df: DataFrame, name: str) -> Column:
    return ~missing(df, name)


def number(df: DataFrame, name: str) -> Column:
    """The column as DOUBLE with NaN turned into NULL."""
    col = quoted(name)
    if isinstance(df.schema[name].dataType, FLOATING):
        return F.nanvl(col.cast("double"), F.lit(None).cast("double"))
    return col.cast("double")


def nan_to_null(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    names = set(df.columns if columns is None else columns)
    return df.select(
        *(
            F.nanvl(quoted(f.name), F.lit(None).cast(f.dataType)).alias(f.name)
            if f.name in names and isinstance(f.dataType, FLOATING)
            else quoted(f.name)
            for f in df.schema
        )
    )


def mix(key: Column, seed: int = 0) -> Column:
    """Pseudo-random BIGINT in [0, MIX_MODULUS) from a key and a seed; different seeds give unrelated values.

    Three seeds in a row read different digits of one digest, which a projection with several of them makes once.
    """
    digest = F.md5(F.concat(key.cast("string"), F.lit(f":{seed // 3}")))
    return F.conv(F.substring(digest, 1 + seed % 3 * MIX_DIGITS, MIX_DIGITS), 16, 10).cast("bigint")


def melt(df: DataFrame, columns: Sequence[str], keep: Sequence[Column] = ()) -> DataFrame:
    """Long form (column, value DOUBLE): one row per cell of ``columns``, NaN as NULL."""
    cells = F.array(
        *(F.struct(F.lit(c).alias("column"), number(df, c).alias("value")) for c in columns)
    )
    return df.select(*keep, F.inline(cells))
