import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from assayer.operators import impute
from assayer.settings import ImputeSettings


def correlated(n=300, seed=0, rate=0.2):
    """Three readings of two hidden factors with some error of their own."""
    rng = np.random.default_rng(seed)
    factors = rng.normal(size=(n, 2))
    readings = np.array([[1.0, 0.1], [0.9, -0.15], [-1.2, 0.2]])
    truth = factors @ readings.T + rng.normal(scale=0.05, size=(n, 3))
    gaps = rng.random(truth.shape) < rate
    return truth, np.where(gaps, np.nan, truth), gaps


def to_df(spark, block, cat=True):
    pdf = pd.DataFrame(block, columns=["x1", "x2", "x3"])
    pdf.insert(0, "id", np.arange(len(pdf)))
    df = spark.createDataFrame(pdf)
    if cat:
        df = df.withColumn("cat", F.when(F.col("id") % 5 == 0, None).when(F.col("id") % 2 == 0, "b").otherwise("a"))
    return df


def dense_chained(block, max_iter, tol):
    """Chained equations on a dense matrix, row by row state: the reference for the Spark version."""
    gaps = np.isnan(block)
    full = np.where(gaps, np.nanmean(block, axis=0), block)
    order = np.argsort(gaps.sum(axis=0), kind="stable")
    limit = tol * np.nanmax(np.abs(block))
    for rounds in range(1, max_iter + 1):
        before = full.copy()
        for c in order:
            if not gaps[:, c].any():
                continue
            rest = np.delete(np.arange(block.shape[1]), c)
            have = ~gaps[:, c]
            z = np.hstack([np.ones((have.sum(), 1)), full[have]])
            beta, b0 = impute.bayesian_ridge(z.T @ z, c)
            full[gaps[:, c], c] = full[gaps[:, c]][:, rest] @ beta + b0
        if np.abs(full - before).sum(axis=1).max() < limit:
            break
    return full, rounds


@pytest.mark.parametrize("patterns", [4096, 1])
def test_chained_equations_equal_the_dense_computation(spark, patterns):
    _, holed, _ = correlated()
    want, rounds = dense_chained(holed, 10, 1e-2)
    done = impute.impute_mice(to_df(spark, holed, cat=False), ["x1", "x2", "x3"], 10, 1e-2, patterns)
    got = done.df.orderBy("id").toPandas()[["x1", "x2", "x3"]].to_numpy()
    np.testing.assert_allclose(got, want, rtol=1e-6, atol=1e-6)
    assert done.diagnostics["n_iter"] == rounds and done.diagnostics["converged"] == (rounds < 10)


def test_bayesian_ridge_recovers_a_line():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 2))
    y = 3 + x @ [2.0, -1.0] + rng.normal(scale=0.01, size=400)
    z = np.column_stack([np.ones(400), x, y])
    beta, b0 = impute.bayesian_ridge(z.T @ z, 2)
    np.testing.assert_allclose([*beta, b0], [2, -1, 3], atol=5e-3)


def test_chained_beats_mean_and_is_deterministic(spark):
    truth, holed, gaps = correlated(500, 3, 0.25)
    df = to_df(spark, holed, cat=False)
    runs = [impute.impute_mice(df, ["x1", "x2", "x3"]).df.orderBy("id").toPandas().to_numpy()[:, 1:] for _ in range(2)]
    np.testing.assert_array_equal(runs[0], runs[1])
    error = np.sqrt(((runs[0] - truth)[gaps] ** 2).mean())
    plain = np.where(gaps, np.nanmean(holed, axis=0), holed)
    assert error < 0.5 * np.sqrt(((plain - truth)[gaps] ** 2).mean())
    np.testing.assert_array_equal(runs[0][~gaps], truth[~gaps])


def dense_knn(block, k):
    width = block.shape[1]
    out = block.copy()
    for i, row in enumerate(block):
        for c in np.flatnonzero(np.isnan(row)):
            diff = block - row
            ok = ~np.isnan(diff)
            n = ok.sum(axis=1)
            with np.errstate(divide="ignore", invalid="ignore"):
                d = np.where(ok, diff**2, 0).sum(axis=1) * width / n
            usable = (n > 0) & ~np.isnan(block[:, c])
            best = sorted((d[j], j) for j in np.flatnonzero(usable))[:k]
            out[i, c] = np.mean([block[j, c] for _, j in best]) if best else np.nanmean(block[:, c])
    return out


@pytest.mark.parametrize("leaf_rows", [None, 30])
def test_nearest_rows_equal_the_dense_computation(spark, leaf_rows):
    _, holed, _ = correlated(200, 5)
    holed[10:60] = holed[10]  # copies, gaps included
    holed[3] = np.nan
    done = impute.impute_knn(to_df(spark, holed, cat=False), "id", ["x1", "x2", "x3"], 5, leaf_rows=leaf_rows)
    got = done.df.orderBy("id").toPandas()[["x1", "x2", "x3"]].to_numpy()
    np.testing.assert_allclose(got, dense_knn(holed, 5), rtol=1e-9)


def test_mode_takes_the_smallest_on_ties(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "s string")
    assert [r["s"] for r in impute.impute_mode(df).collect()].count("a") == 3


def test_router_fills_everything_and_reports(spark):
    _, holed, gaps = correlated()
    for method in ("mice", "knn"):
        done = impute.impute(to_df(spark, holed), ImputeSettings(method=method), seed=1, id_column="id")
        left = impute.missing_counts(done.df, done.df.columns).agg(F.sum("n_missing")).first()[0]
        assert left == 0 and done.df.count() == 300
        assert done.diagnostics["numeric"]["missing_values_before"] == gaps.sum()
        assert done.diagnostics["categorical"]["missing_values_before"] == 60
        assert done.params["numeric_columns"] == ["x1", "x2", "x3"] and done.params["categorical_columns"] == ["cat"]


def test_refusals(spark):
    empty = spark.createDataFrame([], "a double")
    with pytest.raises(ValueError, match="without rows"):
        impute.impute(empty)
    gone = spark.createDataFrame([(None, 1.0)], "a double, b double")
    with pytest.raises(ValueError, match="'a'"):
        impute.impute(gone)
    with pytest.raises(ValueError):
        ImputeSettings(method="other")
    with pytest.raises(ValueError, match="id_column"):
        impute.impute(spark.createDataFrame([(1.0,)], "a double"), ImputeSettings(method="knn"))


def test_only_numeric_or_only_words(spark):
    words = spark.createDataFrame([("a",), (None,), ("a",)], "s string")
    assert impute.impute(words).df.where("s = 'a'").count() == 3
    one = spark.createDataFrame([(1.0,), (None,), (3.0,)], "x double")
    assert sorted(r["x"] for r in impute.impute(one).df.collect()) == [1.0, 2.0, 3.0]


def test_baseline_is_mean_then_mode(spark):
    df = spark.createDataFrame([(1.0, "a"), (None, None), (3.0, "a")], "x double, s string")
    assert [tuple(r) for r in impute.impute_mean_mode(df).collect()][1] == (2.0, "a")
