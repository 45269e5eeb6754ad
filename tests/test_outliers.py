import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from assayer.operators import outliers
from assayer.settings import OutlierSettings


def mixture(seed=0):
    """280 rows near a ring in the plane z = x + y, and 20 rows far off that plane above or below its middle."""
    rng = np.random.default_rng(seed)
    angle = rng.uniform(0, 2 * np.pi, 280)
    x, y = 2 * np.cos(angle), 2 * np.sin(angle)
    good = np.column_stack([x, y, x + y]) + rng.normal(scale=0.08, size=(280, 3))
    near = rng.uniform(-0.7, 0.7, (20, 2))
    bad = np.column_stack([near, near.sum(axis=1) + rng.choice([-1, 1], 20) * rng.uniform(3.0, 4.0, 20)])
    block = np.vstack([good, bad])
    return block, np.arange(300) >= 280


def to_df(spark, block):
    pdf = pd.DataFrame(block, columns=[f"c{i}" for i in range(block.shape[1])])
    pdf.insert(0, "id", np.arange(len(pdf)))
    return spark.createDataFrame(pdf)


def dense_lof(block, k):
    d = np.sqrt(((block[:, None] - block[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    order = np.argsort(d, axis=1, kind="stable")[:, :k]
    near = np.take_along_axis(d, order, axis=1)
    kd = near[:, -1]
    lrd = 1 / (np.maximum(near, kd[order]).mean(axis=1) + 1e-10)
    return lrd[order].mean(axis=1) / lrd


def recall(out, truth):
    flags = out.orderBy("id").toPandas()[outliers.FLAG].to_numpy()
    return flags[truth].mean(), flags


def test_forest_finds_outliers_keeps_rows_and_is_deterministic(spark):
    block, truth = mixture()
    df = to_df(spark, block)
    s = OutlierSettings(contamination=0.0667)
    first = outliers.detect_outliers(df, s, seed=1, id_column="id")
    again = outliers.detect_outliers(df, s, seed=1, id_column="id")
    hit, flags = recall(first.df, truth)
    assert hit > 0.2 and first.df.count() == 300 and first.diagnostics["n_flagged"] == flags.sum()
    same = first.df.join(again.df.withColumnRenamed(outliers.SCORE, "s"), "id")
    assert same.where(F.col("s") != F.col(outliers.SCORE)).isEmpty()
    assert 0.03 < flags.mean() < 0.1
    # the cut lies at zero
    assert first.df.where((F.col(outliers.SCORE) > 0) != F.col(outliers.FLAG)).isEmpty()
    fences = df.withColumn(outliers.FLAG, outliers.iqr_flag(df, ["c0", "c1", "c2"]))
    assert hit >= recall(fences, truth)[0]


@pytest.mark.parametrize("leaf_rows", [None, 40])
def test_lof_equals_the_dense_computation(spark, leaf_rows):
    block, truth = mixture(1)
    got = outliers.lof_scores(to_df(spark, block), "id", ["c0", "c1", "c2"], 20, leaf_rows=leaf_rows)
    scores = got.orderBy("id").toPandas()[outliers.SCORE].to_numpy()
    np.testing.assert_allclose(scores, dense_lof(block, 20), rtol=1e-9)
    cut = outliers.contamination_cut(got, outliers.SCORE, 0.0667)
    assert recall(cut, truth)[0] > 0.5


def test_lof_with_many_copies(spark):
    rng = np.random.default_rng(2)
    block = rng.normal(size=(90, 2))
    block[:30] = [0.25, 0.5]
    got = outliers.lof_scores(to_df(spark, block), "id", ["c0", "c1"], 5, leaf_rows=15)
    scores = got.orderBy("id").toPandas()[outliers.SCORE].to_numpy()
    np.testing.assert_allclose(scores, dense_lof(block, 5), rtol=1e-6)


def test_lof_neighbours_shrink_with_the_table(spark):
    df = to_df(spark, np.array([[0.0], [1.0], [9.0]]))
    assert outliers.detect_outliers(df, OutlierSettings(method="lof"), id_column="id").df.count() == 3


def test_none_and_no_numeric_columns(spark):
    df = spark.createDataFrame([("a",)], "s string")
    done = outliers.detect_outliers(df)
    assert tuple(done.df.first()) == ("a", 0.0, False) and done.diagnostics["reason"]
    assert outliers.detect_outliers(to_df(spark, np.ones((3, 1))), OutlierSettings(method="none")).diagnostics["n_flagged"] == 0


def test_refusals(spark):
    with pytest.raises(ValueError, match="impute"):
        outliers.detect_outliers(spark.createDataFrame([(1.0,), (None,)], "a double"))
    with pytest.raises(ValueError, match="without rows"):
        outliers.detect_outliers(spark.createDataFrame([], "a double"))
    for bad in ({"contamination": 0.5}, {"contamination": 0.0}, {"method": "x"}):
        with pytest.raises(ValueError):
            OutlierSettings(**bad)


@pytest.mark.parametrize("flagged, kept", [(50, 50), (26, 50), (25, 25), (3, 47)])
def test_too_few_kept_rows_means_all_rows(spark, flagged, kept):
    df = spark.range(50).withColumn(outliers.FLAG, F.col("id") < flagged)
    assert outliers.drop_flagged(df).count() == kept


def test_fences_flag_any_column(spark):
    df = spark.createDataFrame([(float(i % 10), 0.0) for i in range(40)] + [(100.0, 0.0), (5.0, 9.0)], "a double, b double")
    assert df.where(outliers.iqr_flag(df, ["a", "b"])).count() == 2
    assert outliers.iqr_false_positive_rate(df, ["a"]).first()[0] == pytest.approx(1 / 42)
