"""Reading a dataset: the file formats, and the target and feature checks before modelling."""

from __future__ import annotations

import os
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.ml.feature import OneHotEncoder
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from assayer.functions.columns import is_numeric, missing, nan_to_null, number, present, quoted
from assayer.functions.ranking import sorted_codes
from assayer.operators.impute import Imputed, impute_mice, impute_mode, missing_counts
from assayer.operators.profile import infer_task_type
from assayer.settings import ImputeSettings

Reader = Callable[[SparkSession, str, T.StructType | None], DataFrame]


def _csv(spark, path, schema):
    reader = spark.read.option("header", True)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def _plain(kind: str) -> Reader:
    def read(spark, path, schema):
        reader = spark.read.format(kind)
        return (reader.schema(schema) if schema else reader).load(path)

    return read


# File suffix -> reader. Add an entry to support another format.
READERS: dict[str, Reader] = {
    ".csv": _csv,
    ".json": _plain("json"),
    ".orc": _plain("orc"),
    ".parquet": _plain("parquet"),
}


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    suffix = os.path.splitext(path.rstrip("/"))[1].lower()
    if suffix not in READERS:
        raise ValueError(f"cannot read {suffix!r} files ({path}); known: {', '.join(sorted(READERS))}")
    return nan_to_null(READERS[suffix](spark, path, schema))


def with_null_tokens(df: DataFrame, tokens: Sequence[str]) -> DataFrame:
    """Text cells equal to a token become NULL; a column left with only numbers becomes DOUBLE.

    Any number of tokens; whether a column is numeric is decided by one aggregate.
    """
    words = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    if not words:
        return df

    def cleaned(c: str) -> Column:
        return F.when(F.trim(quoted(c)).isin(*tokens), None).otherwise(quoted(c))

    tests = df.agg(
        *(
            F.coalesce(F.bool_and(_as_double(cleaned(c)).isNotNull() | cleaned(c).isNull()), F.lit(False)).alias(f"t{i}")
            for i, c in enumerate(words)
        ),
        *(F.count(cleaned(c)).alias(f"n{i}") for i, c in enumerate(words)),
    ).first()
    numeric = {c for i, c in enumerate(words) if tests[f"t{i}"] and tests[f"n{i}"]}
    return df.select(
        *(
            _as_double(cleaned(c)).alias(c)
            if c in numeric
            else cleaned(c).alias(c)
            if c in words
            else quoted(c)
            for c in df.columns
        )
    )


def _as_double(col: Column) -> Column:
    return F.trim(col).try_cast("double")


@dataclass(frozen=True)
class Dataset:
    df: DataFrame  # feature columns as DOUBLE, then the target
    features: list[str]
    target: str
    task: str
    report: dict[str, Any] = field(default_factory=dict)


def split_target(df: DataFrame, target: str) -> tuple[list[str], str]:
    return [c for c in df.columns if c != target], target


def drop_missing_target(df: DataFrame, target: str) -> DataFrame:
    return df.where(present(df, target))


def encode_label(df: DataFrame, target: str, name: str) -> DataFrame:
    """Adds the code of the label in sorted order, from 0; -1 for a missing label.

    Up to ``IN_PLACE`` labels are looked up in the row. More are numbered by a distributed rank and joined; the table of codes
    is broadcast only while it is small, and nothing of it comes to the driver.
    """
    there = df.where(present(df, target)).select(quoted(target).alias("_l")).distinct()
    first = [r["_l"] for r in there.take(IN_PLACE + 1)]
    if len(first) <= IN_PLACE:
        return df.withColumn(name, _code(quoted(target), sorted(first)))
    codes = sorted_codes(there, "_l", "_c")
    codes = F.broadcast(codes) if len(codes.take(MAX_LEVELS + 1)) <= MAX_LEVELS else codes
    joined = df.join(codes, quoted(target) == F.col("_l"), "left")
    return joined.withColumn(name, F.coalesce("_c", F.lit(-1)).cast("int")).drop("_l", "_c")


def _code(col: Column, listed: Sequence) -> Column:
    if not listed:
        return F.lit(-1)
    array = F.array(*(F.lit(x) for x in listed))
    return F.coalesce(F.array_position(array, col) - 1, F.lit(-1)).cast("int")


IN_PLACE = 64
#: Levels that are broadcast, and the most columns that one-hot coding may add for one column.
MAX_LEVELS = 10_000


def levels_of(df: DataFrame, columns: Sequence[str]) -> dict[str, list]:
    """Sorted present values per column. One-hot width equals their number, so it has a limit."""
    out = {}
    for c in columns:
        rows = (
            df.where(present(df, c)).select(quoted(c).alias("v")).distinct().orderBy("v")
            .limit(MAX_LEVELS + 1).collect()
        )
        if len(rows) > MAX_LEVELS:
            raise ValueError(f"column {c!r} has more than {MAX_LEVELS} levels; too many columns; see one_hot_vector")
        out[c] = [r["v"] for r in rows]
    return out


def one_hot_drop_first(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """0/1 column ``name_level`` per sorted level but the first; the coded columns come last."""
    levels = levels_of(df, columns)
    rest = [quoted(c) for c in df.columns if c not in columns]
    coded = [
        F.coalesce((quoted(c) == F.lit(v)).cast("int"), F.lit(0)).alias(f"{c}_{v}")
        for c in columns
        for v in levels[c][1:]
    ]
    return df.select(*rest, *coded)


def one_hot_vector(df: DataFrame, column: str, name: str) -> DataFrame:
    """Adds the 0/1 coding of ``column`` as a sparse vector, for any number of levels; the first level and missing cells are
    all zero. With n levels after the first, position p stands for level n - p of the sorted order."""
    coded = encode_label(df, column, "_code")
    n = max(0, coded.agg(F.max("_code")).first()[0] or 0)
    if n == 0:
        return coded.withColumn(name, array_to_vector(F.array(F.lit(0.0)))).drop("_code")
    # The encoder leaves the last index out: that is where the first level and missing cells go.
    index = coded.withColumn("_index", F.when(F.col("_code") < 1, F.lit(n)).otherwise(n - F.col("_code")).cast("double"))
    model = OneHotEncoder(inputCol="_index", outputCol=name).fit(index.select("_index").union(df.sparkSession.createDataFrame([(float(n),)], "_index double")))
    return model.transform(index).drop("_code", "_index")


def _resolve(df: DataFrame, target: str | None, path: str) -> str:
    name = target or df.columns[-1]
    if name not in df.columns:
        raise ValueError(f"no target column {name!r} in {path}; columns: {df.columns}")
    return name


def _task_of(df: DataFrame, target: str, task: str | None) -> str:
    return task or infer_task_type(df, [target]).first()["task"]


def _finished(
    df: DataFrame, features: Sequence[str], target: str, task: str, keep: Sequence[str] = ()
) -> DataFrame:
    numeric = is_numeric(df.schema[target])
    if task == "classification" and not numeric:
        df = encode_label(df, target, "_code").drop(target).withColumnRenamed("_code", target)
    elif not numeric:
        raise ValueError(f"target {target!r} is not numeric; regression needs a number")
    return df.select(
        *map(quoted, keep),
        *(number(df, c).alias(c) for c in features),
        number(df, target).alias(target),
    )


def check_dataset(df: DataFrame, target: str | None = None, task: str | None = None, path: str = "the table") -> Dataset:
    """Features must be numeric and complete; anything else is an error that names the columns."""
    if df.isEmpty():
        raise ValueError(f"{path} holds no rows")
    target = _resolve(df, target, path)
    features, _ = split_target(df, target)
    words = [c for c in features if not is_numeric(df.schema[c])]
    if words:
        raise ValueError(f"feature columns must be numeric; encode these first: {words}")
    if features:
        gone = [r["column"] for r in missing_counts(df, features).collect() if r["n_missing"]]
        if gone:
            raise ValueError(f"feature columns have missing cells; impute these first: {gone}")
    kind = _task_of(df, target, task)
    return Dataset(_finished(df, features, target, kind), features, target, kind)


def load_dataset(
    spark: SparkSession, path: str, target: str | None = None, task: str | None = None
) -> Dataset:
    return check_dataset(read_table(spark, path), target, task, path)


def auto_preprocess(
    df: DataFrame,
    target: str | None = None,
    task: str | None = None,
    path: str = "the table",
    settings: ImputeSettings | None = None,
    id_column: str | None = None,
) -> Dataset:
    """Rows without a target are dropped first; features alone are imputed, then one-hot coded."""
    if df.isEmpty():
        raise ValueError(f"{path} holds no rows")
    target = _resolve(df, target, path)
    counts = df.agg(F.count("*").alias("n"), F.count_if(missing(df, target)).alias("m")).first()
    kept = drop_missing_target(df, target)
    features = [c for c in kept.columns if c not in (target, id_column)]
    gaps = {r["column"]: r["n_missing"] for r in missing_counts(kept, features).collect()}
    imputed = [c for c in features if gaps[c]]
    about: dict[str, Any] = {}
    ready = kept
    if imputed:
        done = impute_features(kept, features, settings)
        ready, about = done.df, done.diagnostics
    words = [c for c in features if not is_numeric(ready.schema[c])]
    coded = one_hot_drop_first(ready, words) if words else ready
    names = [c for c in coded.columns if c not in (target, id_column)]
    kind = _task_of(kept, target, task)
    report = {
        "rows_dropped_missing_target": counts["m"],
        "feature_columns_imputed": imputed,
        "feature_columns_one_hot_encoded": words,
        "imputation_diagnostics": about,
    }
    done = _finished(coded, names, target, kind, [id_column] if id_column else [])
    return Dataset(done, names, target, kind, report)


def impute_features(df: DataFrame, features: Sequence[str], settings: ImputeSettings | None) -> Imputed:
    """Impute ``features`` from ``features``; other columns pass through and predict nothing."""
    s = settings or ImputeSettings()
    if s.method != "mice":
        raise ValueError("auto preprocessing imputes by chained equations")
    numeric = [c for c in features if is_numeric(df.schema[c])]
    words = [c for c in features if c not in numeric]
    about: dict[str, Any] = {}
    if numeric:
        done = impute_mice(df, numeric, s.mice_max_iter, s.mice_tol)
        df, about = done.df, {"numeric": done.diagnostics}
    return Imputed(impute_mode(df, words), {}, about)


def load_with_auto_preprocess(
    spark: SparkSession,
    path: str,
    target: str | None = None,
    task: str | None = None,
    na_values: Sequence[str] | None = None,
) -> Dataset:
    df = read_table(spark, path)
    if na_values:
        df = with_null_tokens(df, na_values)
    return auto_preprocess(df, target, task, path)
