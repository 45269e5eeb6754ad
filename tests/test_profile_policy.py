import inspect
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from assayer import plans
from assayer.operators import outliers, policy, profile
from assayer.settings import PolicySettings


def test_missing_share(spark):
    df = spark.createDataFrame([(1.0, None), (None, 2.0), (3.0, 3.0), (4.0, 4.0)], "a double, b double")
    assert profile.missingness_rate(df).first()[0] == 0.25
    assert profile.missingness_rate(df.limit(0)).first()[0] == 0.0


def test_skew_equals_the_adjusted_form(spark):
    x = np.random.default_rng(0).exponential(size=200)
    n, d = 200, x - x.mean()
    want = (d**3).mean() / (d**2).mean() ** 1.5 * math.sqrt(n * (n - 1)) / (n - 2)
    df = spark.createDataFrame(pd.DataFrame({"a": x, "b": -x, "s": "t"}))
    assert profile.mean_abs_skew(df).first()[0] == pytest.approx(want)
    assert profile.mean_abs_skew(spark.createDataFrame([("a",)], "s string")).first()[0] == 0.0
    assert profile.mean_abs_skew(spark.createDataFrame([(1.0,), (2.0,)], "a double")).first()[0] == 0.0


def test_cardinality_ratio(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), (None, 3), ("a", 4)], "s string, n int")
    assert profile.mean_cardinality_ratio(df).first()[0] == 0.5
    assert profile.mean_cardinality_ratio(df.select("n")).first()[0] == 0.0
    flags = spark.createDataFrame([(True,), (False,)], "b boolean")
    assert profile.mean_cardinality_ratio(flags).first()[0] == 1.0


@pytest.mark.parametrize("counts, want", [((95, 5), 19.0), ((50, 50), 1.0), ((100, 0), 1.0)])
def test_class_ratio(spark, counts, want):
    df = spark.createDataFrame([(0,)] * counts[0] + [(1,)] * counts[1], "y int")
    assert profile.class_imbalance_ratio(df, "y").first()[0] == want


def test_profile_of_segments_equals_profile_of_each(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"g": rng.integers(0, 3, 300), "a": rng.exponential(size=300), "s": rng.integers(0, 20, 300).astype(str), "y": rng.integers(0, 2, 300)})
    df = spark.createDataFrame(pdf)
    whole = {r["g"]: r for r in profile.meta_features(df, "y", ["g"]).collect()}
    for g in range(3):
        one = profile.meta_features(df.where(F.col("g") == g).drop("g"), "y").first()
        for name in profile.STATE_EDGES:
            assert whole[g][name] == pytest.approx(one[name])


def test_drift_score_without_reference(spark):
    df = spark.createDataFrame([(1.0,)], "a double")
    assert profile.drift_score(df, None) == 0.0 and profile.drift_score(df, df.limit(0)) == 0.0
    assert profile.meta_features(df).first()["class_imbalance_ratio"] == 1.0


@pytest.mark.parametrize(
    "values, want",
    [((0, 0, 0, 1, 0), (0,) * 5), ((0.9, 10.0, 0.95, 50.0, 1.0), (3,) * 5), ((0.05, 0.5, 0.05, 1.5, 0.1), (1,) * 5)],
)
def test_state_bins(spark, values, want):
    df = spark.createDataFrame([tuple(map(float, values))], list(profile.STATE_EDGES))
    assert tuple(profile.state_bins(df).first()) == want


def test_task_inference(spark):
    df = spark.range(1000).select(
        F.col("id").cast("double").alias("many"), (F.col("id") % 20).alias("few"), (F.col("id") % 50).alias("share"),
        (F.col("id") % 51).alias("above"), F.col("id").cast("string").alias("text"),
    )
    got = {r["column"]: r["task"] for r in profile.infer_task_type(df, df.columns).collect()}
    assert got == {"many": "regression", "few": "classification", "share": "classification", "above": "regression", "text": "classification"}


def test_actions(spark):
    listed = policy.actions()
    assert len(listed) == len(set(listed)) == 18
    assert all((a[4] is None) == (a[2] == "none") for a in listed)
    grid = policy.action_grid(spark.createDataFrame([("s",), ("t",)], "state string"))
    assert grid.count() == 36
    row = grid.select(policy.action_cost(F.col("imputer"), F.col("outlier_method")).alias("c"), "imputer", "outlier_method")
    assert row.where("imputer = 'mice' AND outlier_method = 'lof'").first()["c"] == pytest.approx(0.03)


def fold(rewards, alpha):
    q = 0.0
    for r in rewards:
        q += alpha * (r - q)
    return q


@pytest.mark.parametrize("chunk", [1_000_000, 7])
def test_q_table_is_the_ordered_fold(spark, chunk):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"n": rng.permutation(200), "s": rng.integers(0, 2, 200), "a": rng.integers(0, 3, 200), "r": rng.normal(size=200)})
    got = policy.q_table(spark.createDataFrame(pdf), ["s"], "a", "n", "r", 0.3, chunk).toPandas()
    for _, row in got.iterrows():
        part = pdf[(pdf.s == row.s) & (pdf.a == row.a)].sort_values("n")
        assert row.q == pytest.approx(fold(part.r, 0.3)) and row.n == len(part)


def test_q_examples(spark):
    one = spark.createDataFrame([(0, 0, 0, 1.0)], "n int, s int, a int, r double")
    assert policy.q_table(one, ["s"], "a", "n", "r", 0.5).first()["q"] == 0.5
    many = spark.range(200).selectExpr("id n", "0 s", "0 a", "2.0D r")
    assert policy.q_table(many, ["s"], "a", "n", "r", 0.3).first()["q"] == pytest.approx(2.0)


def test_best_action_counts_untried_as_zero(spark):
    q = spark.createDataFrame([(0, 1, 0.5), (0, 2, 0.5), (1, 0, -1.0), (2, 3, 0.0)], "s int, a int, q double")
    asked = spark.createDataFrame([(0,), (1,), (2,), (9,)], "s int")
    got = {r["s"]: r["best_action"] for r in policy.best_action(q, asked, ["s"], "a", 4).collect()}
    assert got == {0: 1, 1: 1, 2: 0, 9: 0}


def test_apply_action_drops_flagged_rows_only(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"id": np.arange(120), "x": rng.normal(size=120), "z": rng.normal(size=120), "y": 1.0})
    pdf.loc[::9, "x"] = np.nan
    df = spark.createDataFrame(pdf)
    out = policy.apply_action(df, ["x", "z"], "id", (0, "knn", "lof", 2, 0.10))
    assert out.columns == ["id", "x", "z", "y"] and out.where("isnan(x) OR x IS NULL").isEmpty()
    assert 100 <= out.count() <= 112
    assert policy.apply_action(df, ["x", "z"], "id", (0, "mice", "none", 0, None)).count() == 120


def test_actions_share_fills_and_scores(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"id": np.arange(150), "x": rng.normal(size=150), "z": rng.normal(size=150), "y": 1.0})
    pdf.loc[::8, "x"] = np.nan
    df = spark.createDataFrame(pdf)
    chosen = [a for a in policy.actions() if a[1] == "knn" and a[3] in (0, 3)]
    assert {a[2] for a in chosen} == {"isolation_forest", "lof", "none"}
    for action, rows in zip(chosen, policy.apply_actions(df, ["x", "z"], "id", chosen, 5)):
        alone = policy.apply_action(df, ["x", "z"], "id", action, 5)
        assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, alone.collect()))


def test_all_actions_are_measured_on_all_rows(spark, tmp_path, monkeypatch):
    from assayer.operators import modelling

    rows = [(i, f"part {i}", f"Brand#{i % 5}", "SMALL", i * 7 % 50, None if i == 3 else 900 + i / 10) for i in range(80)]
    spark.createDataFrame(
        rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"
    ).write.parquet(f"{tmp_path}/part.parquet")
    full, asked = modelling.reward_surrogate, []

    def cheap(*args, **settings):
        asked.append(inspect.signature(full).bind(*args, **settings).arguments)
        return lambda df, features, target, task, id_column: float(df.count())

    monkeypatch.setattr(modelling, "reward_surrogate", cheap)
    got = plans.QUERIES["measure_actions"](spark, str(tmp_path)).orderBy("action").collect()
    assert [tuple(r)[:4] for r in got] == [a[:4] for a in policy.actions()]
    assert asked == [{}]  # all folds and trees
    # only the row that has no price is left out
    assert all(r["rows_total"] == r["baseline_score"] == 79 and r["score"] == r["rows_kept"] for r in got)
    assert {r["rows_kept"] for r in got if r["outlier_method"] == "none"} == {79}
    assert all(r["rows_kept"] < 79 for r in got if r["outlier_method"] != "none")


def test_reward_is_gain_minus_cost(spark):
    scores = spark.createDataFrame([("d", 0, "mice", "none", 0.9)], "ds string, action int, imputer string, outlier_method string, score double")
    base = spark.createDataFrame([("d", 0.8)], "ds string, baseline_score double")
    assert policy.action_reward(scores, base, ["ds"]).first()["reward"] == pytest.approx(0.08)


def test_policy_settings():
    for bad in ({"alpha": 0.0}, {"gamma": 1.5}, {"epsilon": -0.1}, {"reward_mode": "x"}):
        with pytest.raises(ValueError):
            PolicySettings(**bad)
    assert outliers.FLAG == "_is_outlier" and outliers.SCORE == "_anomaly_score"
