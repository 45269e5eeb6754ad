"""Model search over families, stacking, and the rewards built on them, with MLlib.

Fits run on the executors; the driver only keeps hyperparameters and scores. Independent fits of a
search are submitted together so that small ones share the cluster.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool
from typing import Any

import numpy as np
from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from assayer.functions.columns import number, quoted
from assayer.functions.gram import gram_by, unpack
from assayer.functions.ranking import mixed_row_number
from assayer.operators.evaluate import score_column
from assayer.settings import SearchSettings

CLASSIFY = "classification"


def fold_assign(
    df: DataFrame, key: Column, folds: int, seed: int, label: str | None = None, name: str = "fold"
) -> DataFrame:
    """Shuffled folds 0..folds-1, stratified by ``label`` when given; sizes differ by one at most."""
    ranked = mixed_row_number(df, key, seed, [label] if label else [], "_fold")
    return ranked.withColumn(name, F.pmod(F.col("_fold") - 1, F.lit(folds)).cast("int")).drop("_fold")


@dataclass(frozen=True)
class Task:
    """Rows (id, features VECTOR, label DOUBLE) ready for fitting."""

    df: DataFrame
    kind: str
    n_classes: int
    n_features: int

    @property
    def n(self) -> int:
        return self.df.count()


def make_task(df: DataFrame, id_column: str, features: Sequence[str], target: str, kind: str) -> Task:
    wide = df.select(
        quoted(id_column).alias("id"),
        *(number(df, c).alias(f"x{i}") for i, c in enumerate(features)),
        number(df, target).alias("label"),
    )
    names = [f"x{i}" for i in range(len(features))]
    ready = VectorAssembler(inputCols=names, outputCol="features").transform(wide)
    ready = ready.select("id", "features", "label").persist(StorageLevel.MEMORY_AND_DISK)
    top = ready.agg(F.max("label")).first()[0] if kind == CLASSIFY else None
    return Task(ready, kind, int(top) + 1 if top is not None else 0, len(features))


# ---- parameter space (fixed values: the ranges searched)

TREES = (50, 400)
SPACE: dict[str, dict[str, tuple]] = {
    "random_forest": {
        "n_estimators": ("int", *TREES), "max_depth": ("int", 2, 20), "min_samples_split": ("int", 2, 20),
        "min_samples_leaf": ("int", 1, 20), "max_features": ("float", 0.3, 1.0),
    },
    "xgboost": {
        "n_estimators": ("int", *TREES), "max_depth": ("int", 2, 10), "learning_rate": ("log", 1e-3, 0.3),
        "subsample": ("float", 0.5, 1.0), "colsample_bytree": ("float", 0.5, 1.0), "reg_lambda": ("log", 1e-3, 10.0),
    },
    "lightgbm": {
        "n_estimators": ("int", *TREES), "num_leaves": ("int", 8, 128), "learning_rate": ("log", 1e-3, 0.3),
        "subsample": ("float", 0.5, 1.0), "colsample_bytree": ("float", 0.5, 1.0), "reg_lambda": ("log", 1e-3, 10.0),
    },
}
LINEAR = {
    True: {"C": ("log", 1e-3, 100.0), "l1_ratio": ("float", 0.0, 1.0)},
    False: {"alpha": ("log", 1e-4, 10.0), "l1_ratio": ("float", 0.0, 1.0)},
}


def param_space(family: str, kind: str) -> dict[str, tuple]:
    if family == "linear":
        return LINEAR[kind == CLASSIFY]
    if family not in SPACE:
        raise ValueError(f"unknown model family: {family!r}")
    return SPACE[family]


def draw_params(
    family: str, kind: str, n: int, seed: int, ranges: Mapping[str, tuple] | None = None
) -> list[dict[str, Any]]:
    """n seeded draws; ``ranges`` narrows single parameters to (low, high)."""
    rng = np.random.default_rng([seed, *map(ord, family)])
    out = []
    for _ in range(n):
        one: dict[str, Any] = {}
        for name, (scale, low, high) in param_space(family, kind).items():
            low, high = (ranges or {}).get(name, (low, high))
            if scale == "int":
                one[name] = int(rng.integers(low, high + 1))
            elif scale == "log":
                one[name] = float(math.exp(rng.uniform(math.log(low), math.log(high))))
            else:
                one[name] = float(rng.uniform(low, high))
        out.append(one)
    return out


def build_estimator(family: str, task: Task, params: Mapping[str, Any], seed: int, n_rows: int = 0):
    """MLlib estimator of a family; boosting stands in for both boosted families.

    Boosting in MLlib has two classes, so more are handled one against the rest. Tree depth has the
    MLlib limit of 30. ``reg_lambda`` and ``min_samples_split`` have no MLlib counterpart.
    """
    param_space(family, task.kind)
    p = dict(params)
    classify = task.kind == CLASSIFY
    if family == "random_forest":
        made = (RandomForestClassifier if classify else RandomForestRegressor)(
            numTrees=p.get("n_estimators", 100),
            maxDepth=min(p.get("max_depth", 15), 30),
            minInstancesPerNode=p.get("min_samples_leaf", 1),
            featureSubsetStrategy=str(float(p["max_features"])) if p.get("max_features", 1.0) < 1.0 else (
                "all" if "max_features" in p else ("sqrt" if classify else "all")
            ),
            seed=seed,
        )
        return made
    if family == "linear":
        ratio = p.get("l1_ratio", 0.0)
        if classify:
            strength = 1.0 / (p.get("C", 1.0) * max(n_rows, 1))
            return LogisticRegression(regParam=strength, elasticNetParam=ratio, maxIter=100)
        return LinearRegression(regParam=p.get("alpha", 1.0), elasticNetParam=p.get("l1_ratio", 0.5), maxIter=100)
    depth = p.get("max_depth") or math.ceil(math.log2(p.get("num_leaves", 31)))
    share = float(p.get("colsample_bytree", 1.0))
    settings = dict(
        maxIter=p.get("n_estimators", 100),
        maxDepth=min(depth, 30),
        stepSize=p.get("learning_rate", 0.1),
        subsamplingRate=p.get("subsample", 1.0),
        featureSubsetStrategy=str(share) if share < 1.0 else "all",
        seed=seed,
    )
    if not classify:
        return GBTRegressor(**settings)
    two = GBTClassifier(**settings)
    return two if task.n_classes <= 2 else OneVsRest(classifier=two)


# ---- cross-validation


def with_folds(task: Task, folds: int, seed: int, name: str = "fold") -> DataFrame:
    label = "label" if task.kind == CLASSIFY else None
    return fold_assign(task.df, F.col("id"), folds, seed, label, name)


def _parallel(jobs: Sequence[Callable[[], Any]], width: int) -> list:
    if width <= 1 or len(jobs) <= 1:
        return [job() for job in jobs]
    with ThreadPool(min(width, len(jobs))) as pool:
        run = inheritable_thread_target(SparkSession.active())(lambda job: job())
        return pool.map(run, jobs)


def cross_validated(task: Task, folded: DataFrame, folds: int, estimator, fold: str = "fold") -> list[Callable]:
    """One job per fold, each returning the score on that fold."""

    def one(i: int) -> Callable[[], float]:
        def run() -> float:
            model = estimator.fit(folded.where(F.col(fold) != i))
            held = model.transform(folded.where(F.col(fold) == i))
            return held.agg(score_column(task.kind, "label", "prediction")).first()[0]

        return run

    return [one(i) for i in range(folds)]


@dataclass(frozen=True)
class Trial:
    model_family: str
    trial_number: int
    params: dict[str, Any]
    score: float


@dataclass(frozen=True)
class Study:
    model_family: str
    best_params: dict[str, Any]
    best_score: float
    trials: list[Trial]
    model: Any = None


def family_search(
    task: Task,
    family: str,
    settings: SearchSettings | None = None,
    ranges: Mapping[str, tuple] | None = None,
    refit: bool = True,
) -> Study:
    """Seeded random search: cross-validated mean score per draw, best draw refit on all rows."""
    s = settings or SearchSettings()
    folded = with_folds(task, s.cv_folds, s.seed).persist(StorageLevel.MEMORY_AND_DISK)
    n = folded.count()
    draws = draw_params(family, task.kind, s.n_trials, s.seed, ranges)
    made = [build_estimator(family, task, p, s.seed, n) for p in draws]
    jobs = [job for e in made for job in cross_validated(task, folded, s.cv_folds, e)]
    scores = np.array(_parallel(jobs, s.parallelism)).reshape(len(draws), s.cv_folds).mean(axis=1)
    folded.unpersist()
    trials = [Trial(family, i, p, float(v)) for i, (p, v) in enumerate(zip(draws, scores))]
    best = max(trials, key=lambda t: t.score)
    model = build_estimator(family, task, best.params, s.seed, n).fit(task.df) if refit else None
    return Study(family, best.params, best.score, trials, model)


def search_all_families(
    task: Task, settings: SearchSettings | None = None, ranges=None, refit: bool = True
) -> dict[str, Study]:
    s = settings or SearchSettings()
    return {f: family_search(task, f, s, ranges, refit) for f in s.families}


def default_baseline(task: Task, family: str = "random_forest", settings: SearchSettings | None = None) -> float:
    s = settings or SearchSettings()
    folded = with_folds(task, s.cv_folds, s.seed).persist(StorageLevel.MEMORY_AND_DISK)
    made = build_estimator(family, task, {}, s.seed, folded.count())
    scores = _parallel(cross_validated(task, folded, s.cv_folds, made), s.parallelism)
    folded.unpersist()
    return float(np.mean(scores))


def trials_df(spark, studies: Sequence[Study]) -> DataFrame:
    import json

    rows = [
        (t.model_family, t.trial_number, json.dumps(t.params, sort_keys=True), t.score)
        for study in studies
        for t in study.trials
    ]
    return spark.createDataFrame(rows, "model_family string, trial_number int, params_json string, score double")


# ---- stacking

ALPHAS = (0.1, 1.0, 10.0)  # fixed values: ridge strengths tried by the meta-learner


@dataclass
class Stack:
    """Fitted base models and the meta-learner on top of them."""

    task: Task
    models: dict[str, Any]
    meta: Any  # LogisticRegressionModel, or (intercept, weights)

    def transform(self, df: DataFrame) -> DataFrame:
        out = df
        for family, model in self.models.items():
            out = _with_base(self.task, family, model, out)
        return _with_meta(self.task, list(self.models), self.meta, out)


def _with_base(task: Task, family: str, model, df: DataFrame) -> DataFrame:
    """Adds the base model's output as array column ``b_family``."""
    out = model.transform(df)
    if task.kind != CLASSIFY:
        value = F.array(F.col("prediction"))
    elif "probability" in out.columns:
        chances = vector_to_array("probability")
        # of two classes one chance says it all
        value = F.slice(chances, 2, 1) if task.n_classes <= 2 else chances
    else:
        value = vector_to_array("rawPrediction")
    return out.select(*df.columns, value.alias(f"b_{family}"))


def _meta_input(families: Sequence[str], df: DataFrame) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return df.withColumn("meta", array_to_vector(F.concat(*(F.col(f"b_{f}") for f in families))))


def _with_meta(task: Task, families, meta, df: DataFrame) -> DataFrame:
    keep = [c for c in df.columns if not c.startswith("b_")]
    if task.kind == CLASSIFY:
        return meta.transform(_meta_input(families, df)).select(*keep, "prediction")
    intercept, weights = meta
    total = F.lit(float(intercept))
    for f, w in zip(families, weights):
        total = total + F.get(f"b_{f}", F.lit(0)) * float(w)
    return df.select(*keep, total.alias("prediction"))


def ridge_cv(df: DataFrame, inputs: Sequence[Column], label: Column) -> tuple[float, np.ndarray]:
    """Ridge whose strength has the least leave-one-out error: two aggregates over the rows."""
    full = unpack(gram_by(df, [*inputs, label]).first()["gram"])
    n = full[0, 0]
    mean = full[0] / n
    centred = full - n * np.outer(mean, mean)
    xx, xy = centred[1:-1, 1:-1], centred[1:-1, -1]
    fits, errors = [], []
    for alpha in ALPHAS:
        inverse = np.linalg.inv(xx + alpha * np.eye(len(xx)))
        beta = inverse @ xy
        fits.append((float(mean[-1] - mean[1:-1] @ beta), beta))
        z = [c - float(m) for c, m in zip(inputs, mean[1:-1])]
        leverage = F.lit(1.0 / n)
        for i in range(len(z)):
            for j in range(len(z)):
                leverage = leverage + z[i] * z[j] * float(inverse[i, j])
        fitted = F.lit(float(mean[-1])) + sum((c * float(b) for c, b in zip(z, beta)), F.lit(0.0))
        errors.append(F.avg(F.pow((label - fitted) / (1.0 - leverage), 2)))
    row = df.agg(*(e.alias(f"e{i}") for i, e in enumerate(errors))).first()
    return fits[int(np.argmin([row[f"e{i}"] for i in range(len(ALPHAS))]))]


def fit_stack(
    task: Task, params: Mapping[str, Mapping], settings: SearchSettings | None = None, rows: DataFrame | None = None
) -> Stack:
    """Base models fit per fold give out-of-fold inputs for the meta-learner, then refit on all rows.

    Held-out rows pass through every family's model of their fold in one plan, so the out-of-fold
    table needs no join.
    """
    if not params:
        raise ValueError("stacking needs at least one base family")
    s = settings or SearchSettings()
    data = rows if rows is not None else task.df
    label = "label" if task.kind == CLASSIFY else None
    k = s.stacking_folds
    folded = fold_assign(data.select("id", "features", "label"), F.col("id"), k, s.seed + 1, label, "inner")
    folded = folded.persist(StorageLevel.MEMORY_AND_DISK)
    n = folded.count()
    made = {f: build_estimator(f, task, p, s.seed, n) for f, p in params.items()}

    def fitter(estimator, i: int | None) -> Callable:
        part = folded if i is None else folded.where(F.col("inner") != i)
        return lambda: estimator.fit(part)

    jobs = [fitter(e, i) for e in made.values() for i in (*range(k), None)]
    models = _parallel(jobs, s.parallelism)
    families = list(made)
    held = None
    for i in range(k):
        part = folded.where(F.col("inner") == i)
        for at, f in enumerate(families):
            part = _with_base(task, f, models[at * (k + 1) + i], part)
        held = part if held is None else held.unionByName(part)
    if task.kind == CLASSIFY:
        meta: Any = LogisticRegression(
            featuresCol="meta", labelCol="label", regParam=1.0 / n, maxIter=200
        ).fit(_meta_input(families, held))
    else:
        meta = ridge_cv(held, [F.get(f"b_{f}", F.lit(0)) for f in families], F.col("label"))
    folded.unpersist()
    return Stack(task, {f: models[at * (k + 1) + k] for at, f in enumerate(families)}, meta)


@dataclass(frozen=True)
class StackResult:
    studies: dict[str, Study]
    stack_score: float
    best_family: str
    best_score: float
    stack: Stack | None = field(default=None, repr=False)


def stack_score(task: Task, params: Mapping[str, Mapping], settings: SearchSettings) -> float:
    """Cross-validated score of the whole stack."""
    folded = with_folds(task, settings.cv_folds, settings.seed).persist(StorageLevel.MEMORY_AND_DISK)
    scores = []
    for i in range(settings.cv_folds):
        fitted = fit_stack(task, params, settings, folded.where(F.col("fold") != i))
        held = fitted.transform(folded.where(F.col("fold") == i))
        scores.append(held.agg(score_column(task.kind, "label", "prediction")).first()[0])
    folded.unpersist()
    return float(np.mean(scores))


def run_stacking(
    task: Task, settings: SearchSettings | None = None, ranges=None, refit: bool = True
) -> StackResult:
    """Tune each family, score the stack of the tuned ones, name the single best family."""
    s = settings or SearchSettings()
    studies = search_all_families(task, s, ranges, refit=False)
    params = {f: study.best_params for f, study in studies.items()}
    score = stack_score(task, params, s)
    best = max(studies.values(), key=lambda x: x.best_score)
    fitted = fit_stack(task, params, s) if refit else None
    return StackResult(studies, score, best.model_family, best.best_score, fitted)


def stack_report(families: DataFrame, stacks: DataFrame, baselines: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per dataset: best family, stack score, default score and who wins.

    families (by, model_family, score), stacks (by, stack_score), baselines (by, baseline_score).
    """
    # least (-score, name): the best score, then the first name
    best = F.min(F.struct((-F.col("score")).alias("s"), F.col("model_family").alias("f")))
    named = families.groupBy(*by).agg(best.alias("_b")).select(
        *by, (-F.col("_b.s")).alias("best_score"), F.col("_b.f").alias("best_family")
    )
    out = named.join(stacks, list(by)).join(baselines, list(by))
    return out.withColumn("beats_baseline", F.col("stack_score") > F.col("baseline_score")).withColumn(
        "matches_best", F.col("stack_score") >= F.col("best_score")
    )


# ---- rewards


def reward_surrogate(folds: int = 3, seed: int = 42, trees: int = 50):
    """Reward: cross-validated default forest, a cheap stand-in for the full stack."""
    s = SearchSettings(cv_folds=folds, seed=seed)

    def reward(df: DataFrame, features: Sequence[str], target: str, kind: str, id_column: str = "id") -> float:
        task = make_task(df, id_column, features, target, kind)
        folded = with_folds(task, s.cv_folds, s.seed).persist(StorageLevel.MEMORY_AND_DISK)
        made = build_estimator("random_forest", task, {"n_estimators": trees}, s.seed)
        made.setCacheNodeIds(True)  # the same trees, which need not travel to the rows at each level
        scores = _parallel(cross_validated(task, folded, s.cv_folds, made), s.parallelism)
        folded.unpersist()
        task.df.unpersist()
        return float(np.mean(scores))

    return reward


def reward_full_stack(settings: SearchSettings | None = None, ranges=None):
    """Reward: cross-validated score of the tuned stack."""

    def reward(df: DataFrame, features: Sequence[str], target: str, kind: str, id_column: str = "id") -> float:
        task = make_task(df, id_column, features, target, kind)
        score = run_stacking(task, settings, ranges, refit=False).stack_score
        task.df.unpersist()
        return score

    return reward
