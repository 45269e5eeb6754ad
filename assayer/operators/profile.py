"""Dataset profile: five numbers that describe a table, or every segment of it in one job."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from assayer.functions.columns import missing, number, present, quoted, split_columns
from assayer.operators.gates import psi
from assayer.settings import DriftGateSettings

# Bin edges of the discrete state, per profile number.
STATE_EDGES = {
    "missingness_rate": (0.05, 0.2, 0.4),
    "mean_abs_skew": (0.5, 1.5, 3.0),
    "mean_cardinality_ratio": (0.05, 0.3, 0.7),
    "class_imbalance_ratio": (1.5, 3.0, 10.0),
    "drift_score": (0.1, 0.25, 0.5),
}

# When a numeric target counts as a set of classes.
MAX_CLASSES = 20
MAX_CLASS_SHARE = 0.05


def _columns(df: DataFrame, by: Sequence[str], target: str | None):
    numeric, other = split_columns(df.drop(*by, *([target] if target else [])), booleans=False)
    return numeric, other


def missingness_rate(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    cells = [c for c in df.columns if c not in by]
    return df.groupBy(*by).agg(_missing_share(df, cells).alias("missingness_rate"))


def _missing_share(df: DataFrame, cells: Sequence[str]) -> Column:
    if not cells:
        return F.lit(0.0)
    gone = reduce(lambda a, b: a + b, (F.count_if(missing(df, c)) for c in cells))
    return F.coalesce(F.try_divide(gone, F.count("*") * len(cells)), F.lit(0.0))


def _adjusted_skew(v: Column) -> Column:
    """Bias-adjusted skewness; NULL below three values, 0 for a constant column."""
    n = F.count(v).cast("double")
    form = F.skewness(v) * F.sqrt(n * (n - 1)) / (n - 2)
    flat = F.min(v) == F.max(v)
    return F.when(n < 3, None).when(flat, 0.0).otherwise(form)


def _skew_mean(df: DataFrame, numeric: Sequence[str]) -> Column:
    if not numeric:
        return F.lit(0.0)
    skews = F.array(*(F.abs(_adjusted_skew(number(df, c))) for c in numeric))
    kept = F.filter(skews, lambda x: x.isNotNull() & ~F.isnan(x) & (x < math.inf))
    total = F.aggregate(kept, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(kept) > 0, total / F.size(kept)).otherwise(0.0)


def mean_abs_skew(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(_skew_mean(df, _columns(df, by, None)[0]).alias("mean_abs_skew"))


def mean_cardinality_ratio(
    df: DataFrame, by: Sequence[str] = (), target: str | None = None, approximate: bool = False
) -> DataFrame:
    """Mean of distinct present values over rows across the non-numeric columns.

    Distinct values are counted by grouping on (segment, column, value), which combines map-side
    and spreads a hot segment over its values.
    """
    other = _columns(df, by, target)[1]
    name = "mean_cardinality_ratio"
    if not other:
        return df.groupBy(*by).agg(F.lit(0.0).alias(name))
    if approximate:
        ratios = [F.approx_count_distinct(quoted(c)) / F.count("*") for c in other]
        mean = reduce(lambda a, b: a + b, ratios) / len(other)
        return df.groupBy(*by).agg(F.coalesce(mean, F.lit(0.0)).alias(name))
    cells = F.array(
        *(
            F.struct(F.lit(i).alias("_c"), _as_text(df, c).alias("_v"))
            for i, c in enumerate(other)
        )
    )
    values = df.select(*by, F.inline(cells)).groupBy(*by, "_c", "_v").agg(F.count("*").alias("_n"))
    # every row gives one cell per column, so the cells sum to rows x columns
    distinct, cell_count = F.count("_v"), F.sum("_n")
    return values.groupBy(*by).agg(F.coalesce(distinct / cell_count, F.lit(0.0)).alias(name))


def _as_text(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType.typeName()
    col = quoted(name)
    return F.to_json(F.struct(col)) if kind in ("array", "map", "struct") else col.cast("string")


def class_imbalance_ratio(df: DataFrame, target: str, by: Sequence[str] = ()) -> DataFrame:
    """Largest over smallest class count; 1.0 with fewer than two classes."""
    counts = (
        df.where(present(df, target)).groupBy(*by, quoted(target).alias("_y"))
        .agg(F.count("*").alias("_n"))
    )
    ratio = F.when(F.count("*") < 2, 1.0).otherwise(F.max("_n") / F.min("_n"))
    return counts.groupBy(*by).agg(F.coalesce(ratio, F.lit(1.0)).alias("class_imbalance_ratio"))


def drift_score(df: DataFrame, reference: DataFrame | None) -> float:
    """Mean finite stability index over shared numeric columns, default gate settings."""
    if reference is None or reference.isEmpty():
        return 0.0
    shared = [c for c in split_columns(df)[0] if c in reference.columns]
    if not shared:
        return 0.0
    scores = psi(df, reference, shared, DriftGateSettings().psi_bins).values()
    finite = [s for s in scores if math.isfinite(s)]
    return sum(finite) / len(finite) if finite else 0.0


def meta_features(
    df: DataFrame,
    target: str | None = None,
    by: Sequence[str] = (),
    reference: DataFrame | None = None,
) -> DataFrame:
    """The five profile numbers, one row per segment (one row in all without ``by``).

    The target counts only for the class ratio. Drift compares the whole table with the reference.
    """
    numeric, other = _columns(df, by, target)
    features = [c for c in df.columns if c not in by and c != target]
    base = df.groupBy(*by).agg(
        _missing_share(df, features).alias("missingness_rate"),
        _skew_mean(df, numeric).alias("mean_abs_skew"),
    )
    parts = [mean_cardinality_ratio(df, by, target)]
    if target:
        parts.append(class_imbalance_ratio(df, target, by))
    out = base
    for part in parts:
        out = _beside(out, part, by)
    if not target:
        out = out.withColumn("class_imbalance_ratio", F.lit(1.0))
    out = out.withColumn(
        "class_imbalance_ratio", F.coalesce("class_imbalance_ratio", F.lit(1.0))
    )
    return out.withColumn("drift_score", F.lit(drift_score(df, reference)))


def _beside(left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
    if not by:  # one row each
        return left.join(F.broadcast(right), how="left")
    named = right.select(*(F.col(c).alias(f"_r_{c}") for c in by), *[c for c in right.columns if c not in by])
    on = reduce(lambda a, b: a & b, (left[c].eqNullSafe(named[f"_r_{c}"]) for c in by))
    return left.join(named, on, "left").drop(*(f"_r_{c}" for c in by))


def state_bins(profile: DataFrame) -> DataFrame:
    """Each profile number replaced by how many of its edges it has reached (0 to 3)."""
    bins = [
        sum(((quoted(name) >= e).cast("int") for e in edges), F.lit(0)).alias(f"{name}_bin")
        for name, edges in STATE_EDGES.items()
    ]
    rest = [c for c in profile.columns if c not in STATE_EDGES]
    return profile.select(*rest, *bins)


def infer_task_type(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, n_rows, n_distinct, task) for every candidate target in one grouped pass."""
    numeric = set(split_columns(df)[0])
    cells = F.array(
        *(
            F.struct(
                F.lit(c).alias("column"),
                F.lit(c in numeric).alias("numeric"),
                F.when(present(df, c), _as_text(df, c)).alias("value"),
            )
            for c in columns
        )
    )
    values = (
        df.select(F.inline(cells)).groupBy("column", "numeric", "value").agg(F.count("*").alias("n"))
    )
    per = values.groupBy("column", "numeric").agg(
        F.sum("n").alias("n_rows"), F.count("value").alias("n_distinct")
    )
    classes = (
        ~F.col("numeric")
        | (F.col("n_distinct") <= MAX_CLASSES)
        | (F.col("n_distinct") / F.col("n_rows") <= MAX_CLASS_SHARE)
    )
    return per.select(
        "column",
        "n_rows",
        "n_distinct",
        F.when(classes, "classification").otherwise("regression").alias("task"),
    )
