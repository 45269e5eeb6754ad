"""Measuring methods: masks and synthetic rows to test on, errors, recalls, paired comparisons."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from assayer.functions.columns import MIX_MODULUS, mix, number, quoted
from assayer.functions.ranking import mixed_row_number
from assayer.functions.special import student_t_p


#: Distance between the seeds of a column's order and of its draws.
DRAW_SEED = 1_000


def mcar_mask(key: Column, rate: float, seed: int) -> Column:
    """True for a share ``rate`` of keys, the same ones in every engine."""
    return mix(key, seed) < F.lit(int(rate * MIX_MODULUS) + 1)


def inject_mcar(
    df: DataFrame, key: Column, columns: Sequence[str], rate: float, seed: int, marks: bool = False
) -> DataFrame:
    """Blank cells at random, independently per column (seed + position); ``marks`` adds the masks."""
    masks = {c: mcar_mask(key, rate, seed + i) for i, c in enumerate(columns)}
    out = [
        F.when(masks[c], F.lit(None)).otherwise(quoted(c)).alias(c) if c in masks else quoted(c)
        for c in df.columns
    ]
    if marks:
        out += [masks[c].alias(f"{c}_masked") for c in columns]
    return df.select(*out)


def masked_rmse(
    truth: DataFrame, filled: Mapping[str, DataFrame], id_column: str, columns: Sequence[str], mask: Mapping[str, Column]
) -> DataFrame:
    """(method, n_cells, rmse) over masked cells only."""
    parts = []
    for method, df in filled.items():
        other = df.select(quoted(id_column).alias("_id"), *(number(df, c).alias(f"_f_{c}") for c in columns))
        both = truth.join(other, quoted(id_column) == F.col("_id"))
        errors = F.array(
            *(F.when(mask[c], F.pow(F.col(f"_f_{c}") - quoted(c), 2)) for c in columns)
        )
        parts.append(
            both.select(F.lit(method).alias("method"), F.explode(errors).alias("e"))
            .where("e IS NOT NULL")
            .groupBy("method")
            .agg(F.count("*").alias("n_cells"), F.sqrt(F.avg("e")).alias("rmse"))
        )
    return reduce(DataFrame.unionByName, parts)


def marginal_resample(
    df: DataFrame, key: str, columns: Sequence[str], seed: int, n_rows: int | None = None
) -> DataFrame:
    """``n_rows`` synthetic rows (position, columns), as many as ``df`` has by default.

    Every value is drawn on its own from its real column, with replacement: marginals stay, the joint distribution is
    broken. Position p takes the row whose rank in a hash order is a hash of p, so a draw is a join on ranks.
    """
    n = df.count()
    drawn = df.sparkSession.range(1, (n if n_rows is None else n_rows) + 1).select(F.col("id").alias("position"))
    for i, c in enumerate(columns):
        ranked = mixed_row_number(df.select(key, c), F.col(key), seed + i, name="_rank").select("_rank", c)
        place = F.floor(mix(F.col("position"), seed + DRAW_SEED + i) / F.lit(float(MIX_MODULUS)) * n) + 1
        drawn = drawn.withColumn("_place", place).join(ranked, F.col("_place") == F.col("_rank")).drop("_place", "_rank")
    return drawn


def labelled_union(real: DataFrame, synthetic: DataFrame) -> DataFrame:
    """Real rows (is_outlier false) and synthetic ones (true)."""
    return real.withColumn("is_outlier", F.lit(False)).unionByName(
        synthetic.withColumn("is_outlier", F.lit(True))
    )


def clamped_contamination(n_outliers: int, n_rows: int) -> float:
    return min(0.45, max(0.01, n_outliers / n_rows))


def outlier_recall(df: DataFrame, truth: str, flags: Sequence[str]) -> DataFrame:
    """(method, n_true, recall) for each flag column."""
    cells = F.array(
        *(F.struct(F.lit(f).alias("method"), F.col(f).cast("double").alias("hit")) for f in flags)
    )
    return (
        df.where(F.col(truth)).select(F.inline(cells)).groupBy("method")
        .agg(F.count("*").alias("n_true"), F.avg("hit").alias("recall"))
    )


def paired_t(df: DataFrame, first: str, second: str, by: Sequence[str] = ()) -> DataFrame:
    """(n, mean_difference, t) of paired differences first - second."""
    d = F.col(first) - F.col(second)
    n = F.count(d)
    return df.groupBy(*by).agg(
        n.alias("n"),
        F.avg(d).alias("mean_difference"),
        F.try_divide(F.avg(d), F.stddev_samp(d) / F.sqrt(n)).alias("t"),
    )


@F.pandas_udf(T.DoubleType())
def t_p_value(t: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided p-value for the rows of a comparison table."""
    ok = t.notna() & n.notna() & (n >= 2)
    return pd.Series([student_t_p(float(a), int(b) - 1) if k else None for a, b, k in zip(t, n, ok)], dtype="float64")


def summary_by_group(df: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Mean and sample deviation of each column per group."""
    return df.groupBy(*by).agg(
        *(
            piece
            for c in columns
            for piece in (F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std"))
        )
    )


CLOSE = 0.05  # fixed value: margin within which two scores count as about equal


def win_counts(df: DataFrame, first: str, second: str, by: Sequence[str] = ()) -> DataFrame:
    """How often first beats, matches or nearly matches second."""
    a, b = F.col(first), F.col(second)
    return df.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.count_if(a > b).alias("wins"),
        F.count_if(a >= b).alias("wins_or_ties"),
        F.count_if(a >= b - CLOSE).alias("near_or_better"),
    )


def with_verdict(counts: DataFrame, tests: DataFrame, by: Sequence[str], level: float = 0.05) -> DataFrame:
    """Adds t, p_value and verdict: wins every time and the difference is significant."""
    tested = tests.withColumn("p_value", t_p_value("t", "n")).drop("n")
    return counts.join(tested, list(by)).withColumn(
        "verdict", (F.col("wins") == F.col("n")) & (F.col("p_value") < level)
    )


def score(df: DataFrame, task: str, target: str, prediction: str, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy, or negative root mean squared error; higher is better."""
    return df.groupBy(*by).agg(score_column(task, target, prediction).alias("score"))


def score_column(task: str, target: str, prediction: str) -> Column:
    y, p = F.col(target), F.col(prediction)
    if task == "classification":
        return F.avg((y == p).cast("double"))
    return -F.sqrt(F.avg(F.pow(p - y, 2)))


def prequential_accuracy(
    predictions: DataFrame, strategy: str, batch: str, target: str, prediction: str
) -> DataFrame:
    """(strategy, batch, n, accuracy, running_mean): batches in order, one row per batch."""
    hit = (F.col(target) == F.col(prediction)).cast("double")
    per = predictions.groupBy(strategy, batch).agg(F.count("*").alias("n"), F.avg(hit).alias("accuracy"))
    run = Window.partitionBy(strategy).orderBy(batch)
    return per.withColumn("running_mean", F.avg("accuracy").over(run))
