"""Filling missing cells: chained equations, nearest rows, most frequent value, plain mean.

Chained equations need no pass per round. While regressions are refit, every filled cell stays an
affine function of the cells its row does have, and that function is the same for all rows lacking
the same columns. So one aggregate of cross-products per missing-pattern holds all the rounds need:
they run on those small matrices, and one further pass finds the round at which filled values settle.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from assayer.functions.blocks import combined
from assayer.functions.columns import missing, number, present, quoted, split_columns
from assayer.functions.cutting import checkpointed
from assayer.functions.gram import gram_by, unpack
from assayer.functions.spreading import spread
from assayer.operators.neighbors import distinct_points, nearest
from assayer.settings import ImputeSettings

MAX_PATTERNS = 4_096


@dataclass(frozen=True)
class Imputed:
    df: DataFrame
    params: dict[str, Any]
    diagnostics: dict[str, Any] = field(default_factory=dict)


def missing_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, n_missing) from one aggregate."""
    one = df.agg(*(F.count_if(missing(df, c)).alias(f"_m{i}") for i, c in enumerate(columns)))
    cells = (
        F.struct(F.lit(c).alias("column"), F.col(f"_m{i}").alias("n_missing"))
        for i, c in enumerate(columns)
    )
    return one.select(F.inline(F.array(*cells)))


def imputation_diagnostics(before: DataFrame, after: DataFrame) -> DataFrame:
    """(column, missing_before, missing_after, imputed) per column of ``before``."""
    a = missing_counts(before, before.columns).withColumnRenamed("n_missing", "missing_before")
    b = missing_counts(after, before.columns).withColumnRenamed("n_missing", "missing_after")
    return a.join(b, "column").withColumn(
        "imputed", (F.col("missing_before") > 0) & (F.col("missing_after") == 0)
    )


# ---- mean and mode


def modes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value): most frequent present value as text, the smallest on ties.

    Values are counted by grouping first, so no task holds all distinct values of a column.
    """
    cells = F.array(
        *(
            F.struct(
                F.lit(c).alias("column"),
                F.when(present(df, c), quoted(c).cast("string")).alias("value"),
            )
            for c in columns
        )
    )
    counts = (
        df.select(F.inline(cells))
        .where("value IS NOT NULL")
        .groupBy("column", "value")
        .agg(F.count("*").alias("n"))
    )
    # least (-count, value): the largest count, then the smallest value
    best = F.min(F.struct((-F.col("n")).alias("n"), "value"))
    return counts.groupBy("column").agg(best.alias("b")).select("column", "b.value")


def _filled(df: DataFrame, values: dict[str, Any]) -> DataFrame:
    return df.select(
        *(
            F.when(missing(df, c), F.lit(values[c]).cast(df.schema[c].dataType))
            .otherwise(quoted(c))
            .alias(c)
            if c in values
            else quoted(c)
            for c in df.columns
        )
    )


def impute_mode(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    columns = list(columns if columns is not None else split_columns(df)[1])
    if not columns:
        return df
    found = {r["column"]: r["value"] for r in modes(df, columns).collect()}  # one row per column
    _refuse_empty([c for c in columns if c not in found])
    return _filled(df, found)


def impute_mean_mode(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Numeric columns by their mean (as DOUBLE), then the rest by their mode."""
    numeric, other = split_columns(df.select(*map(quoted, columns)) if columns else df)
    if numeric:
        row = df.agg(*(F.avg(number(df, c)).alias(f"m{i}") for i, c in enumerate(numeric))).first()
        means = {c: row[f"m{i}"] for i, c in enumerate(numeric)}
        _refuse_empty([c for c, m in means.items() if m is None])
        df = df.select(
            *(
                F.coalesce(number(df, c), F.lit(means[c])).alias(c) if c in means else quoted(c)
                for c in df.columns
            )
        )
    return impute_mode(df, other)


def _refuse_empty(columns: Sequence[str]) -> None:
    if columns:
        raise ValueError(f"columns without any value cannot be imputed: {list(columns)}")


# ---- chained equations


@dataclass
class _Start:
    """Per-column facts of the present values."""

    mean: np.ndarray
    n_missing: np.ndarray
    largest: float
    rows: int


def _start(df: DataFrame, columns: Sequence[str]) -> _Start:
    pieces = [F.count("*").alias("rows")]
    for i, c in enumerate(columns):
        v = number(df, c)
        pieces += [
            F.avg(v).alias(f"m{i}"),
            F.count(v).alias(f"n{i}"),
            F.max(F.abs(v)).alias(f"x{i}"),
        ]
    row = df.agg(*pieces).first()
    if row["rows"] == 0:
        raise ValueError("cannot impute a table without rows")
    _refuse_empty([c for i, c in enumerate(columns) if row[f"n{i}"] == 0])
    span = range(len(columns))
    return _Start(
        np.array([row[f"m{i}"] for i in span]),
        np.array([row["rows"] - row[f"n{i}"] for i in span]),
        max(row[f"x{i}"] for i in span),
        row["rows"],
    )


def bayesian_ridge(gram: np.ndarray, target: int) -> tuple[np.ndarray, float]:
    """Weights over the other columns and intercept, from cross-products of (1, columns).

    Evidence maximisation for a ridge whose noise and weight precisions are learned, with the usual
    weak priors; needs only the centred second moments.
    """
    prior = 1e-6
    others = [i for i in range(1, len(gram)) if i != target + 1]
    n = gram[0, 0]
    if n < 1:
        return np.zeros(len(others)), 0.0
    mean = gram[0] / n
    centred = gram - n * np.outer(mean, mean)
    xx = centred[np.ix_(others, others)]
    xy = centred[others, target + 1]
    yy = max(centred[target + 1, target + 1], 0.0)
    eigen, basis = np.linalg.eigh(xx)
    eigen = np.clip(eigen, 0.0, None)
    rotated = basis.T @ xy
    noise, weight = 1.0 / (yy / n + np.finfo(float).eps), 1.0

    def solve(noise, weight):
        return basis @ (rotated / (eigen + weight / noise))

    last = None
    for _ in range(300):
        beta = solve(noise, weight)
        residual = max(yy - 2 * beta @ xy + beta @ xx @ beta, 0.0)
        used = np.sum(noise * eigen / (weight + noise * eigen))
        weight = (used + 2 * prior) / (beta @ beta + 2 * prior)
        noise = (n - used + 2 * prior) / (residual + 2 * prior)
        if last is not None and np.abs(last - beta).sum() < 1e-3:
            break
        last = beta
    beta = solve(noise, weight)
    return beta, float(mean[target + 1] - mean[others] @ beta)


def _replay(block: np.ndarray, steps, marks: Sequence[int] = ()):
    """Fill a centred block by the recorded steps; with ``marks`` also the change of each round.

    A step is (column, weights over the other columns, intercept). ``marks`` are the step counts at
    which rounds end; the change of a round is the largest row sum of absolute differences.
    """
    gaps = np.isnan(block)
    full = np.where(gaps, 0.0, block)
    changes, before = [], full.copy()
    for i, (column, beta, intercept) in enumerate(steps, 1):
        rows = gaps[:, column]
        if rows.any():
            full[rows, column] = np.delete(full[rows], column, axis=1) @ beta + intercept
        if i in marks:
            changes.append(np.abs(full - before).sum(axis=1).max() if len(full) else 0.0)
            before = full.copy()
    return full, changes


class _PatternFits:
    """Cross-products of the current fill from per-pattern cross-products of what rows have."""

    def __init__(self, rows, width: int):
        masks = np.array([[b == "1" for b in r["pattern"]] for r in rows])
        self.gaps = masks
        self.sums = np.stack([unpack(r["gram"]) for r in rows])
        size = width + 1
        self.maps = np.zeros((len(rows), size, size))
        self.maps[:, 0, 0] = 1.0
        for j in range(width):
            self.maps[~masks[:, j], j + 1, j + 1] = 1.0

    def gram(self, column: int) -> np.ndarray:
        use = ~self.gaps[:, column]
        m = self.maps[use]
        return np.einsum("pij,pjk,plk->il", m, self.sums[use], m)

    def record(self, column: int, beta: np.ndarray, intercept: float) -> None:
        others = [j for j in range(self.maps.shape[1]) if j not in (0, column + 1)]
        rows = self.gaps[:, column]
        new = np.einsum("j,pjk->pk", beta, self.maps[rows][:, others, :])
        new[:, 0] += intercept
        self.maps[rows, column + 1, :] = new


class _PassFits:
    """The same by one pass per fit: for tables with too many distinct missing-patterns."""

    def __init__(self, centred: DataFrame, width: int):
        self.centred, self.width, self.steps = centred, width, []

    def gram(self, column: int) -> np.ndarray:
        steps, width = list(self.steps), self.width
        size = width + 1

        def partial(block: np.ndarray) -> np.ndarray:
            full, _ = _replay(block, steps)
            full = full[~np.isnan(block[:, column])]
            full = np.hstack([np.ones((len(full), 1)), full])
            return full.T @ full

        return combined(self.centred, self.centred.columns, partial, size * size).reshape(size, size)

    def record(self, column: int, beta: np.ndarray, intercept: float) -> None:
        self.steps.append((column, beta, intercept))


def impute_mice(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    max_iter: int = 25,
    tol: float = 1e-2,
    max_patterns: int = MAX_PATTERNS,
) -> Imputed:
    """Chained equations over numeric columns (returned as DOUBLE).

    Mean start, columns in ascending order of missing cells, each refit on the rows that have it.
    A round is the last one when the largest row sum of changes is below ``tol`` times the largest
    absolute present value.
    """
    columns = list(columns if columns is not None else split_columns(df)[0])
    width = len(columns)
    at = _start(df, columns)
    before = int(at.n_missing.sum())
    info = {"method": "mice", "max_iter": max_iter, "tol": tol, "missing_values_before": before}
    centred = df.select(
        *(
            F.coalesce(number(df, c) - F.lit(float(at.mean[i])), F.lit(float("nan"))).alias(f"x{i}")
            for i, c in enumerate(columns)
        )
    )
    steps: list = []
    rounds = 1
    if before and width > 1:
        order = [int(i) for i in np.argsort(at.n_missing, kind="stable") if at.n_missing[i]]
        fits = _fits(centred, width, max_patterns)
        limit = tol * at.largest
        if isinstance(fits, _PatternFits):
            marks = []
            for _ in range(max_iter):
                _one_round(fits, order, steps)
                marks.append(len(steps))
            changes = _round_changes(spread(centred, at.rows), steps, marks)
            settled = [i for i, c in enumerate(changes) if c < limit]
            rounds = settled[0] + 1 if settled else max_iter
            steps = steps[: marks[rounds - 1]]
        else:
            for rounds in range(1, max_iter + 1):
                done = len(steps)
                _one_round(fits, order, steps)
                marks = [done, len(steps)] if done else [len(steps)]
                if _round_changes(centred, steps, marks)[-1] < limit:
                    break
    info["n_iter"] = rounds
    info["converged"] = rounds < max_iter
    info["missing_values_after"] = 0

    mean = at.mean
    out_type = T.StructType([T.StructField(f"f{i}", T.DoubleType()) for i in range(width)])

    @F.pandas_udf(out_type)
    def fill(block: pd.DataFrame) -> pd.DataFrame:
        full, _ = _replay(block.to_numpy(dtype=float), steps)
        return pd.DataFrame(full + mean, columns=[f"f{i}" for i in range(width)])

    if not before:
        filled = df.select(
            *(number(df, c).alias(c) if c in columns else quoted(c) for c in df.columns)
        )
        return Imputed(filled, {"columns": columns, "steps": []}, info)
    if not steps:  # a single column has nothing to regress on
        means = {c: float(at.mean[i]) for i, c in enumerate(columns)}
        filled = df.select(
            *(
                F.coalesce(number(df, c), F.lit(means[c])).alias(c) if c in means else quoted(c)
                for c in df.columns
            )
        )
        return Imputed(filled, {"columns": columns, "steps": []}, info)
    shifted = F.struct(
        *(
            F.coalesce(number(df, c) - F.lit(float(mean[i])), F.lit(float("nan"))).alias(f"f{i}")
            for i, c in enumerate(columns)
        )
    )
    with_fill = spread(df, at.rows).withColumn("_fill", fill(shifted))
    filled = with_fill.select(
        *(
            # present cells keep their exact value
            F.coalesce(number(df, c), F.col(f"_fill.f{columns.index(c)}")).alias(c)
            if c in columns
            else quoted(c)
            for c in df.columns
        )
    )
    return Imputed(filled, {"columns": columns, "steps": steps}, info)


def _fits(centred: DataFrame, width: int, max_patterns: int):
    names = [f"x{i}" for i in range(width)]
    pattern = F.concat(*(F.isnan(c).cast("int").cast("string") for c in names))
    zeroed = [F.when(F.isnan(c), 0.0).otherwise(F.col(c)) for c in names]
    tagged = centred.withColumn("pattern", pattern)
    seen = tagged.select("pattern").distinct().limit(max_patterns + 1).count()
    if seen > max_patterns:
        return _PassFits(centred, width)
    named = tagged.select("pattern", *(z.alias(n) for z, n in zip(zeroed, names)))
    rows = gram_by(named, [F.col(n) for n in names], ["pattern"]).collect()  # max_patterns at most
    return _PatternFits(sorted(rows, key=lambda r: r["pattern"]), width)


def _one_round(fits, order: Sequence[int], steps: list) -> None:
    for column in order:
        beta, intercept = bayesian_ridge(fits.gram(column), column)
        fits.record(column, beta, intercept)
        steps.append((column, beta, intercept))


def _round_changes(centred: DataFrame, steps, marks) -> list[float]:
    """Largest row change of every round, from one pass that keeps one number per round and task."""
    ends = set(marks)
    changes = combined(
        centred, centred.columns, lambda block: _replay(block, steps, ends)[1], len(marks), "max"
    )
    return list(changes)


# ---- nearest rows


def impute_knn(
    df: DataFrame, id_column: str, columns: Sequence[str] | None = None, k: int = 5, **bounds
) -> Imputed:
    """Missing cells become the mean of the ``k`` nearest rows that have the column.

    Exact for any number of rows; the mean of the column where no row is comparable.
    """
    columns = list(columns if columns is not None else split_columns(df.drop(id_column))[0])
    at = _start(df, columns)
    info = {
        "method": "knn",
        "n_neighbors": k,
        "missing_values_before": int(at.n_missing.sum()),
        "missing_values_after": 0,
    }
    targets = [i for i in range(len(columns)) if at.n_missing[i]]
    plain = df.select(
        *(number(df, c).alias(c) if c in columns else quoted(c) for c in df.columns)
    )
    if not targets:
        return Imputed(plain, {"columns": columns}, info)
    donors = checkpointed(distinct_points(spread(df.select(quoted(id_column), *map(quoted, columns)), at.rows), id_column, columns, k))
    lacking = reduce(lambda a, b: a | b, (F.isnan(F.get("point", F.lit(t))) for t in targets))
    receivers = donors.where(F.col("id") == F.col("rep")).where(lacking).select("id", "point")
    means = (
        nearest(receivers, donors, len(columns), k, targets, n_rows=at.rows, **bounds)
        .groupBy("rid")
        .agg(*(F.avg(F.when(F.col("target") == t, F.col("value"))).alias(f"_k{t}") for t in targets))
    )
    # back to every row with the same coordinates
    points = receivers.join(means, receivers["id"] == means["rid"]).select(
        "point", *(f"_k{t}" for t in targets)
    )
    points = checkpointed(points)  # the search is not made again by every reader of the result
    own = F.array(*(F.coalesce(quoted(c), F.lit(float("nan"))) for c in columns))
    gaps = reduce(lambda a, b: a | b, (quoted(columns[t]).isNull() for t in targets))
    # only rows with a gap are joined; the others are not shuffled
    joined = plain.where(gaps).withColumn("_own", own).join(
        points, F.col("_own") == F.col("point"), "left"
    )
    filled = joined.select(
        *(
            F.coalesce(
                quoted(c), F.col(f"_k{columns.index(c)}"), F.lit(float(at.mean[columns.index(c)]))
            ).alias(c)
            if c in columns and columns.index(c) in targets
            else quoted(c)
            for c in df.columns
        )
    )
    return Imputed(plain.where(~gaps).unionByName(filled), {"columns": columns}, info)


# ---- router


def impute(
    df: DataFrame,
    settings: ImputeSettings | None = None,
    *,
    seed: int | None = None,
    id_column: str | None = None,
    columns: Sequence[str] | None = None,
) -> Imputed:
    """Numeric columns by the chosen method, the rest by mode; params allow a replay.

    ``id_column`` (unique; needed for the nearest-row method) is left as it is. With ``columns``
    only these are filled, from each other; the rest passes through unseen.
    """
    s = settings or ImputeSettings()
    inputs = df.select(*map(quoted, columns)) if columns else df
    numeric, other = split_columns(inputs.drop(id_column) if id_column else inputs)
    if df.isEmpty():
        raise ValueError("cannot impute a table without rows")
    out = df
    about: dict[str, Any] = {"numeric_columns_imputed": 0}
    if numeric:
        if s.method == "mice":
            done = impute_mice(out, numeric, s.mice_max_iter, s.mice_tol)
        elif id_column is None:
            raise ValueError("nearest-row imputation needs id_column to order equal distances")
        else:
            done = impute_knn(out, id_column, numeric, s.knn_n_neighbors)
        out = done.df
        about = {**done.diagnostics, "numeric_columns_imputed": len(numeric)}
    words: dict[str, Any] = {"categorical_columns_imputed": 0}
    if other:
        gone = sum(r["n_missing"] for r in missing_counts(df, other).collect())
        out = impute_mode(out, other)
        words = {
            "categorical_strategy": s.categorical_strategy,
            "categorical_columns_imputed": len(other),
            "missing_values_before": gone,
            "missing_values_after": 0,
        }
    params = {
        "method": s.method,
        "mice_max_iter": s.mice_max_iter,
        "mice_tol": s.mice_tol,
        "knn_n_neighbors": s.knn_n_neighbors,
        "categorical_strategy": s.categorical_strategy,
        "seed": seed,
        "numeric_columns": numeric,
        "categorical_columns": other,
    }
    return Imputed(out, params, {"numeric": about, "categorical": words})
