import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window, functions as F

from assayer.functions import hashing
from assayer.functions.columns import melt, missing, mix, nan_to_null, split_columns
from assayer.functions.gram import gram_by, unpack
from assayer.functions.quantiles import exact_quantiles
from assayer.functions.ranking import mixed_row_number, running_max, sorted_codes
from assayer.functions.special import incomplete_beta, kolmogorov_p, student_t_p

MARKS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 1.0]


@pytest.mark.parametrize("limit", [2_000_000, 40, 1])
def test_quantiles_equal_numpy_in_every_mode(spark, limit):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame(
        {
            "normal": rng.normal(size=1500),
            "heavy": np.exp(rng.normal(size=1500) * 6),
            "hot": np.where(rng.random(1500) < 0.4, 7.0, rng.normal(size=1500) * 1e6),
            "few": rng.integers(0, 4, 1500).astype(float),
            "same": 5.0,
        }
    )
    got = exact_quantiles(spark.createDataFrame(pdf).repartition(5), list(pdf.columns), MARKS, limit)
    for c in pdf.columns:
        np.testing.assert_allclose(got[c], np.quantile(pdf[c], MARKS), rtol=1e-12, err_msg=c)


def test_quantiles_skip_missing_and_report_empty(spark):
    df = spark.createDataFrame([(1.0, None), (float("nan"), None), (3.0, None)], "a double, b double")
    got = exact_quantiles(df, ["a", "b"], [0.5])
    assert got["a"] == [2.0] and got["b"] is None


def test_extreme_values_do_not_overflow(spark):
    df = spark.createDataFrame([(-1.7e308,), (0.0,), (1.7e308,)] * 30, "a double")
    assert exact_quantiles(df, ["a"], [0.0, 0.5, 1.0], 10)["a"] == [-1.7e308, 0.0, 1.7e308]


def test_mixed_row_number_equals_one_window(spark):
    df = spark.range(5000).withColumn("g", F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id") % 5))
    got = mixed_row_number(df, F.col("id"), 9, ["g"])
    want = df.withColumn("w", F.row_number().over(Window.partitionBy("g").orderBy(mix(F.col("id"), 9), "id")))
    both = got.join(want.select("id", "w"), "id")
    assert both.count() == 5000 and both.where("rn <> w").isEmpty()


@pytest.mark.parametrize("width", [3, 30])
def test_gram_both_layouts(spark, width):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, width))
    pdf = pd.DataFrame(x, columns=[f"c{i}" for i in range(width)]).assign(g=np.arange(200) % 2)
    rows = gram_by(spark.createDataFrame(pdf), [F.col(f"c{i}") for i in range(width)], ["g"]).collect()
    for row in rows:
        z = np.hstack([np.ones((100, 1)), x[pdf["g"] == row["g"]]])
        np.testing.assert_allclose(unpack(row["gram"]), z.T @ z, rtol=1e-9, atol=1e-9)
    assert len(rows) == 2


def test_missing_covers_null_and_nan(spark):
    df = spark.createDataFrame([(1.0, "a"), (float("nan"), None), (None, "b")], "x double, s string")
    row = df.agg(F.count_if(missing(df, "x")).alias("x"), F.count_if(missing(df, "s")).alias("s")).first()
    assert (row["x"], row["s"]) == (2, 1)
    assert nan_to_null(df).where("x IS NULL").count() == 2
    assert melt(df, ["x"]).where("value IS NULL").count() == 2


def test_booleans_count_both_ways(spark):
    df = spark.createDataFrame([(True, 1, "a")], "b boolean, n int, s string")
    assert split_columns(df) == (["b", "n"], ["s"])
    assert split_columns(df, booleans=False) == (["n"], ["b", "s"])


def test_tail_probabilities():
    assert student_t_p(2.228, 10) == pytest.approx(0.05, abs=2e-4)
    assert student_t_p(0.0, 5) == pytest.approx(1.0)
    assert incomplete_beta(2, 3, 0.4) == pytest.approx(0.5248, abs=1e-4)
    # 1.3581 is the 5% point of the limiting distribution
    assert kolmogorov_p(1.3581 / math.sqrt(50), 100, 100) == pytest.approx(0.05, abs=1e-3)
    assert kolmogorov_p(0.0, 10, 10) == 1.0


def test_config_hash_is_order_free_and_formatted():
    a = hashing.hash_config({"b": 1, "a": [1, 2]})
    assert a == hashing.hash_config({"a": [1, 2], "b": 1}) and a.startswith("sha256:")
    assert hashing.hash_config(None) == hashing.hash_config({})
    assert a != hashing.hash_config({"b": 2, "a": [1, 2]})


def test_config_hash_in_columns_equals_driver(spark):
    df = spark.createDataFrame([("x", 1, None)], "s string, n int, m double")
    got = df.select(hashing.hash_config_columns({"s": F.col("s"), "n": F.col("n"), "m": F.col("m")}).alias("h"))
    assert got.first()["h"] == hashing.hash_config({"s": "x", "n": 1, "m": None})


def test_frame_hash(spark):
    base = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "a bigint, b string")
    same = hashing.content_hash(base)
    assert same == hashing.content_hash(base.orderBy(F.desc("a")).repartition(3))
    assert same != hashing.content_hash(base.withColumn("b", F.coalesce("b", F.lit("z"))))
    assert same != hashing.content_hash(base.select("b", "a"))
    assert same != hashing.content_hash(base.withColumn("a", F.col("a").cast("int")))
    assert same != hashing.content_hash(base.union(base))
    swapped = spark.createDataFrame([(None, 1)], "a int, b int"), spark.createDataFrame([(1, None)], "a int, b int")
    assert hashing.content_hash(swapped[0]) != hashing.content_hash(swapped[1])
    assert hashing.hash_source(mix) == hashing.hash_source(mix) != hashing.hash_source(melt)


def test_running_max_and_codes_over_many_parts(spark):
    rng = np.random.default_rng(6)
    v = rng.normal(size=700)
    df = spark.createDataFrame([(int(i), float(x)) for i, x in enumerate(v)], "i int, v double").repartition(7)
    got = {r["i"]: r["m"] for r in running_max(df, "i", "v", "m").collect()}
    assert [got[i] for i in range(700)] == np.maximum.accumulate(v).tolist()
    codes = {r["v"]: r["c"] for r in sorted_codes(df.union(df), "v", "c").collect()}
    assert [codes[x] for x in sorted(v.tolist())] == list(range(700))
    assert running_max(df.limit(0), "i", "v", "m").count() == sorted_codes(df.limit(0), "v", "c").count() == 0
