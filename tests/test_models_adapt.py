import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from assayer.functions.ranking import mixed_row_number
from assayer.functions.special import kolmogorov_p
from assayer.operators import adapt, evaluate, modelling
from assayer.settings import AdaptSettings, DriftGateSettings, MaskSearchSettings, SearchSettings

QUICK = {"n_estimators": (5, 8), "max_depth": (2, 4), "num_leaves": (8, 12)}


def class_rows(spark, n=160, classes=2, seed=0):
    rng = np.random.default_rng(seed)
    y = np.arange(n) % classes
    x = rng.normal(size=(n, 3)) + y[:, None] * [2.0, -1.0, 0.0]
    return spark.createDataFrame(pd.DataFrame(x, columns=["a", "b", "c"]).assign(id=range(n), y=y.astype(float)))


def line_rows(spark, n=200, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 2))
    y = x @ [3.0, -2.0] + 1 + rng.normal(scale=0.1, size=n)
    return spark.createDataFrame(pd.DataFrame(x, columns=["a", "b"]).assign(id=range(n), y=y))


@pytest.fixture(scope="module")
def two(spark):
    return modelling.make_task(class_rows(spark), "id", ["a", "b", "c"], "y", "classification")


@pytest.fixture(scope="module")
def line(spark):
    return modelling.make_task(line_rows(spark), "id", ["a", "b"], "y", "regression")


def test_folds_are_balanced_and_stratified(two):
    sizes = modelling.with_folds(two, 5, 1).groupBy("label", "fold").count().collect()
    assert len(sizes) == 10 and {r["count"] for r in sizes} == {16}
    same = modelling.with_folds(two, 5, 1).join(modelling.with_folds(two, 5, 1).withColumnRenamed("fold", "f"), "id")
    assert same.where("fold <> f").isEmpty()


def test_draws_stay_in_range_and_repeat():
    for family in ("random_forest", "xgboost", "lightgbm", "linear"):
        for kind in ("classification", "regression"):
            a = modelling.draw_params(family, kind, 20, 7)
            assert a == modelling.draw_params(family, kind, 20, 7) != modelling.draw_params(family, kind, 20, 8)
            for p in a:
                for name, (_, low, high) in modelling.param_space(family, kind).items():
                    assert low <= p[name] <= high
    with pytest.raises(ValueError):
        modelling.param_space("other", "regression")


@pytest.mark.parametrize("family", ["random_forest", "xgboost", "lightgbm", "linear"])
def test_each_family_beats_chance(two, line, family):
    s = SearchSettings(n_trials=1, cv_folds=2)
    study = modelling.family_search(two, family, s, {**QUICK, "learning_rate": (0.2, 0.3), "C": (1.0, 2.0)}, refit=False)
    assert study.best_score > 0.7 and len(study.trials) == 1
    low = modelling.family_search(line, family, s, {**QUICK, "learning_rate": (0.2, 0.3), "alpha": (1e-4, 1e-3)}, refit=False)
    assert low.best_score > -3.6  # the spread of the target


def test_more_classes(spark):
    task = modelling.make_task(class_rows(spark, 150, 3), "id", ["a", "b", "c"], "y", "classification")
    params = {"xgboost": {"n_estimators": 3, "max_depth": 2, "learning_rate": 0.3}, "linear": {}}
    stack = modelling.fit_stack(task, params, SearchSettings(stacking_folds=2))
    out = stack.transform(task.df)
    assert evaluate.score(out, "classification", "label", "prediction").first()[0] > 0.6 and out.count() == 150


def test_stack_of_regressions(line):
    s = SearchSettings(n_trials=1, cv_folds=2, stacking_folds=2, families=("random_forest", "linear"))
    result = modelling.run_stacking(line, s, {**QUICK, "alpha": (1e-4, 1e-3)})
    assert result.best_family == max(result.studies.values(), key=lambda x: x.best_score).model_family == "linear"
    assert result.stack_score > -0.5
    assert result.stack.transform(line.df).count() == 200
    assert modelling.default_baseline(line, "linear", s) < result.stack_score
    with pytest.raises(ValueError):
        modelling.fit_stack(line, {})


def test_ridge_choice_equals_leave_one_out(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 2))
    y = x @ [1.0, 2.0] + rng.normal(size=40)
    df = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b"]).assign(y=y))
    intercept, beta = modelling.ridge_cv(df, [F.col("a"), F.col("b")], F.col("y"))

    def fit(x, y, alpha):
        m, c = x.mean(0), y.mean()
        b = np.linalg.solve((x - m).T @ (x - m) + alpha * np.eye(2), (x - m).T @ (y - c))
        return c - m @ b, b

    def loo(alpha):
        keep = ~np.eye(40, dtype=bool)
        return np.mean([(y[i] - (lambda f: f[0] + x[i] @ f[1])(fit(x[keep[i]], y[keep[i]], alpha))) ** 2 for i in range(40)])

    best = min(modelling.ALPHAS, key=loo)
    want = fit(x, y, best)
    np.testing.assert_allclose([intercept, *beta], [want[0], *want[1]], rtol=1e-9)


def test_reward_functions(spark):
    df = line_rows(spark, 80)
    got = modelling.reward_surrogate(folds=2, trees=5)(df, ["a", "b"], "y", "regression")
    assert -3.6 < got < 0


# ---- masks


def informative(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 8))
    return spark.createDataFrame(pd.DataFrame(x, columns=[f"c{i}" for i in range(8)]).assign(y=((x[:, 0] + x[:, 1]) > 0).astype(int)))


def test_search_finds_an_informative_column(spark):
    names = [f"c{i}" for i in range(8)]
    s = MaskSearchSettings(population_size=10, n_generations=5)
    fitness = adapt.sign_sum_fitness(informative(spark).cache(), names, "y")
    found = adapt.feature_subset_search(8, fitness, s, 1)
    assert found.fitness > 0.6 and (found.mask[0] or found.mask[1])
    best = [h["best_fitness"] for h in found.history]
    assert len(best) == 5 and best == sorted(best)  # elitism keeps the best


def test_search_rules():
    def ones(masks):
        return masks.sum(axis=1)

    a = adapt.feature_subset_search(12, ones, seed=3)
    b = adapt.feature_subset_search(12, ones, seed=3)
    assert (a.mask == b.mask).all() and a.fitness == 12
    least = adapt.feature_subset_search(6, lambda m: -m.sum(axis=1), MaskSearchSettings(min_features=3), 0)
    assert least.mask.sum() == 3
    with pytest.raises(ValueError):
        adapt.feature_subset_search(2, ones, MaskSearchSettings(min_features=3))
    for bad in ({"population_size": 1}, {"elitism_count": 30}, {"mutation_rate": 2}, {"n_generations": 0}):
        with pytest.raises(ValueError):
            MaskSearchSettings(**bad)


def test_mask_zeroes_columns(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3)], "a double, b double, y int")
    assert tuple(adapt.apply_feature_mask(df, ["a", "b"], [False, True]).first()) == (0.0, 2.0, 3)


# ---- adaptation


def dense_steps(x, y, head, steps, lr):
    z = np.hstack([np.ones((len(x), 1)), x])
    for _ in range(steps):
        head = head - lr * 2 / len(x) * z.T @ (z @ head - y)
    return head


def test_grouped_steps_equal_dense_gradient_descent(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame(rng.normal(size=(120, 2)), columns=["a", "b"]).assign(g=np.arange(120) % 3, y=rng.normal(size=120))
    start = adapt.start_head(2, 0)
    got = adapt.grouped_fast_adapt(spark.createDataFrame(pdf), ["g"], ["a", "b"], "y", start, 5, 0.05).collect()
    for r in got:
        part = pdf[pdf.g == r["g"]]
        x, y = part[["a", "b"]].to_numpy(), part["y"].to_numpy()
        want = dense_steps(x, y, start, 5, 0.05)
        np.testing.assert_allclose(r["head"], want, rtol=1e-9)
        assert r["loss"] == pytest.approx(np.mean((np.hstack([np.ones((40, 1)), x]) @ want - y) ** 2))


def test_class_steps_equal_dense_softmax(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame(rng.normal(size=(90, 2)), columns=["a", "b"]).assign(g=np.arange(90) % 2, y=rng.integers(0, 2, 90))
    start = adapt.start_classes(2, 0)
    df = spark.createDataFrame(pdf)
    got = {r["g"]: r["head"] for r in adapt.grouped_adapt_classes(df, ["g"], ["a", "b"], "y", start, 4, 0.1).collect()}
    for g in (0, 1):
        part = pdf[pdf.g == g]
        z = np.hstack([np.ones((45, 1)), part[["a", "b"]].to_numpy()])
        hot, head = np.eye(2)[part["y"]], start.copy()
        for _ in range(4):
            logits = np.exp(z @ head.T)
            head = head - 0.1 * ((logits / logits.sum(1, keepdims=True) - hot).T @ z) / 45
        np.testing.assert_allclose(got[g], head.ravel(), rtol=1e-9)
    whole = adapt.grouped_adapt_classes(df, [], ["a", "b"], "y", start, 1, 0.1).first()["head"]
    assert len(whole) == 6


def test_accuracy_fitness_scores_all_masks(spark):
    names = [f"c{i}" for i in range(8)]
    s = AdaptSettings(inner_lr=0.5, adapt_steps=3)
    score = adapt.adapted_accuracy_fitness(informative(spark), names, "y", adapt.start_classes(8, 0), s)
    masks = np.zeros((2, 8), dtype=bool)
    masks[0, :2], masks[1, 5] = True, True
    good, noise = score(masks)
    assert good > 0.85 > noise


def tasks(spark, n=40):
    rng = np.random.default_rng(0)
    parts = []
    for t in range(n):
        w = np.array([1.0, -2.0, 0.5]) + rng.normal(scale=0.2, size=3)
        x = rng.normal(size=(40, 3))
        parts.append(pd.DataFrame(x, columns=["x1", "x2", "x3"]).assign(y=x @ w, task=t, split=["support"] * 20 + ["query"] * 20))
    return spark.createDataFrame(pd.concat(parts))


def test_meta_training_lowers_query_loss_and_beats_a_random_start(spark):
    s = AdaptSettings(n_outer_steps=150, outer_lr=0.05)
    df, names = tasks(spark), ["x1", "x2", "x3"]
    head, history = adapt.meta_train_init(df, "task", "split", names, "y", s)
    assert np.mean(history[-10:]) < 0.2 * np.mean(history[:10])
    fresh = tasks(spark, 3).where("split = 'support'")
    trained = adapt.grouped_fast_adapt(fresh, [], names, "y", head).first()["loss"]
    untrained = adapt.grouped_fast_adapt(fresh, [], names, "y", adapt.start_head(3, 9)).first()["loss"]
    assert trained < untrained
    with pytest.raises(ValueError):
        adapt.meta_train_init(df.limit(0), "task", "split", names, "y", s)
    with pytest.raises(ValueError):
        AdaptSettings(inner_lr=0.0)


def batch(spark, loc, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(loc, 1, (200, 2))
    return spark.createDataFrame(pd.DataFrame(x, columns=["a", "b"]).assign(y=(x.sum(axis=1) > 2 * loc).astype(float)))


def test_adaptive_steps_thread_the_state(spark):
    first = batch(spark, 0, 0)
    start = adapt.start_head(2, 0)
    state = adapt.AdaptState([True, True], list(start), adapt.Reference.of(first, ["a", "b"]))
    masks = MaskSearchSettings(population_size=6, n_generations=3)
    calm = adapt.adaptive_step(batch(spark, 0, 1), ["a", "b"], "y", state, start, masks=masks)
    assert not calm.drift_detected and calm.state.n_batches_seen == 1 and calm.state.n_adaptations == 0
    assert calm.state.head == state.head and calm.state.reference is state.reference
    moved = adapt.adaptive_step(batch(spark, 6, 2), ["a", "b"], "y", calm.state, start, masks=masks)
    assert moved.drift_detected and (moved.state.n_adaptations, moved.state.n_batches_seen) == (1, 2)
    again = adapt.adaptive_step(batch(spark, 6, 3), ["a", "b"], "y", moved.state, start, masks=masks)
    assert not again.drift_detected and again.state.n_batches_seen == 3
    none = adapt.adaptive_step(first, ["a", "b"], "y", adapt.AdaptState([True, True], list(start), None), start, masks=masks)
    assert none.drift_detected


def test_drift_sequence_equals_batch_by_batch(spark):
    rng = np.random.default_rng(0)
    loc = [0, 0, 0, 4, 4, 0, 0, 8]
    pdf = pd.concat([pd.DataFrame({"d": i, "v": rng.normal(m, 1, 300)}) for i, m in enumerate(loc)])
    df = spark.createDataFrame(pdf)
    got = {r["batch"]: (r["reference_batch"], r["drifted"]) for r in adapt.batch_drift_sequence(df, "d", ["v"]).collect()}
    want, reference = {0: (None, True)}, 0
    for d in range(1, 8):
        ref = adapt.Reference.of(df.where(F.col("d") == reference), ["v"])
        drifted = ref.scores(df.where(F.col("d") == d))["v"] > 0.25
        want[d] = (reference, drifted)
        reference = d if drifted else reference
    assert got == want and sum(x for _, x in got.values()) == 4


# ---- evaluation


def test_paired_verdict(spark):
    df = spark.createDataFrame([("g", 1.0 + i / 10, float(i) / 50) for i in range(10)], "g string, a double, b double")
    out = evaluate.with_verdict(evaluate.win_counts(df, "a", "b", ["g"]), evaluate.paired_t(df, "a", "b", ["g"]), ["g"]).first()
    assert out["verdict"] and out["p_value"] < 0.001 and out["wins"] == 10


def test_resample_draws_columns_on_their_own(spark):
    df = spark.range(500).select("id", (F.col("id") * 2).alias("a"), (F.col("id") * 3).alias("b"))
    out = evaluate.marginal_resample(df, "id", ["a", "b"], 1, 2000).toPandas()
    assert len(out) == 2000 and set(out["a"]) <= set(range(0, 1000, 2)) and set(out["b"]) <= set(range(0, 1500, 3))
    assert abs(out["a"].mean() - 499) < 40 and abs(np.corrcoef(out["a"], out["b"])[0, 1]) < 0.08
    assert out["a"].duplicated().any()
    assert evaluate.marginal_resample(df, "id", ["a", "b"], 1).count() == 500
    assert evaluate.clamped_contamination(1, 1000) == 0.01 and evaluate.clamped_contamination(9, 10) == 0.45


def test_masks_and_orders_of_two_seeds_are_unrelated(spark):
    df = spark.range(20_000).select("id", F.lit(1.0).alias("x"), F.lit(1.0).alias("y"))
    both = evaluate.inject_mcar(df, F.col("id"), ["x", "y"], 0.2, 31).where("x IS NULL AND y IS NULL").count()
    assert abs(both / 20_000 - 0.04) < 0.006
    orders = mixed_row_number(mixed_row_number(df.select("id"), F.col("id"), 1, name="p"), F.col("id"), 2, name="q")
    assert abs(orders.agg(F.corr("p", "q")).first()[0]) < 0.03


def test_mask_rate(spark):
    df = spark.range(100_000).select("id", F.lit(1.0).alias("x"))
    out = evaluate.inject_mcar(df, F.col("id"), ["x"], 0.2, 5, marks=True)
    assert abs(out.where("x IS NULL").count() / 1e5 - 0.2) < 0.005
    assert out.where("(x IS NULL) <> x_masked").isEmpty()


def test_ks_is_honoured_by_step_and_sequence(spark):
    start = adapt.start_head(2, 0)
    ks = DriftGateSettings(method="ks", ks_p_value_threshold=1e-4)
    masks = MaskSearchSettings(population_size=4, n_generations=2)
    state = adapt.AdaptState([True, True], list(start), adapt.Reference.of(batch(spark, 0, 0), ["a", "b"], method="ks"))
    calm = adapt.adaptive_step(batch(spark, 0, 1), ["a", "b"], "y", state, start, drift=ks, masks=masks)
    moved = adapt.adaptive_step(batch(spark, 3, 2), ["a", "b"], "y", calm.state, start, drift=ks, masks=masks)
    assert not calm.drift_detected and moved.drift_detected and moved.state.reference.grid is not None
    rng = np.random.default_rng(0)
    pdf = pd.concat([pd.DataFrame({"d": i, "v": rng.normal(m, 1, 300)}) for i, m in enumerate([0, 0, 4, 4])])
    got = adapt.batch_drift_sequence(spark.createDataFrame(pdf), "d", ["v"], ks).orderBy("batch").collect()
    assert [r["drifted"] for r in got] == [True, False, True, False] and got[2]["min_p_value"] < 1e-4


def test_open_verdicts_ask_for_the_exact_distance():
    asked = []

    def exact(columns):
        asked.extend(columns)
        return [(c, 100, 100, 0.5) for c in columns]

    bounds = {"sure": (100, 100, 0.6, 0.7), "calm": (100, 100, 0.0, 0.01), "open": (100, 100, 0.1, 0.6)}
    scores, moved = adapt.ks_verdict(bounds, 0.05, exact)
    assert asked == ["open"] and sorted(moved) == ["open", "sure"] and scores["open"] == kolmogorov_p(0.5, 100, 100)


def test_step_with_two_classes_is_judged_by_accuracy(spark):
    start = adapt.start_classes(2, 0)
    masks = MaskSearchSettings(population_size=4, n_generations=2)
    first = batch(spark, 0, 0)
    done = adapt.adaptive_step(first, ["a", "b"], "y", adapt.AdaptState([True, True], start.ravel().tolist(), None), start, masks=masks)
    head = np.array(done.state.head).reshape(2, 3)
    z = np.column_stack([np.ones(200), *(np.array([r[c] for r in first.collect()]) * m for c, m in zip("ab", done.state.mask))])
    y = np.array([r["y"] for r in first.collect()])
    assert 0 <= done.fitness <= 1 and np.mean((z @ (head[1] - head[0]) > 0) == (y > 0.5)) == pytest.approx(done.fitness)


def test_class_adaptation_neither_sorts_nor_shuffles_the_rows(spark, capsys):
    df = spark.range(1000).selectExpr("id % 3 AS g", "id / 1000 AS a", "cast(id % 2 AS int) AS y")
    start = np.array([[0.0, -0.5], [0.0, 0.5]])
    for steps in (1, 2):
        out = adapt.grouped_adapt_classes(df, ["g"], ["a"], "y", start, steps, 0.1)
        out.explain("formatted")
        plan = capsys.readouterr().out
        assert "Sort" not in plan and plan.count("hashpartitioning") == 1
        assert out.count() == 3
