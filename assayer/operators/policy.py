"""Choosing preprocessing per dataset state from logged or measured rewards, as tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from assayer.functions.cutting import checkpointed, swept
from assayer.operators.impute import impute, impute_mean_mode
from assayer.operators.outliers import detect_at, drop_flagged
from assayer.settings import ImputeSettings, OutlierSettings

# The choices, their contamination steps and relative costs.
IMPUTERS = ("mice", "knn")
DETECTORS = ("isolation_forest", "lof")
CONTAMINATION = (0.02, 0.05, 0.10, 0.20)
IMPUTER_COST = {"mice": 0.02, "knn": 0.005}
DETECTOR_COST = {"isolation_forest": 0.005, "lof": 0.01, "none": 0.0}

ACTION_TYPE = (
    "array<struct<action:int,imputer:string,outlier_method:string,threshold_bin:int,"
    "contamination:double>>"
)


def actions() -> list[tuple]:
    """(action, imputer, outlier_method, threshold_bin, contamination) for every choice."""
    out = []
    for imputer in IMPUTERS:
        cuts = [(d, i, c) for d in DETECTORS for i, c in enumerate(CONTAMINATION)]
        for detector, i, c in [*cuts, ("none", 0, None)]:
            out.append((len(out), imputer, detector, i, c))
    return out


def action_grid(states: DataFrame) -> DataFrame:
    """Every row of ``states`` with each action: the grid a full comparison has to score."""
    listed = F.array(
        *(
            F.struct(
                F.lit(a).cast("int").alias("action"),
                F.lit(i).alias("imputer"),
                F.lit(d).alias("outlier_method"),
                F.lit(b).cast("int").alias("threshold_bin"),
                F.lit(c).cast("double").alias("contamination"),
            )
            for a, i, d, b, c in actions()
        )
    ).cast(ACTION_TYPE)
    return states.select("*", F.inline(listed))


def action_cost(imputer: Column, detector: Column) -> Column:
    def price(col: Column, table: dict[str, float]) -> Column:
        listed = F.create_map(*(F.lit(x) for pair in table.items() for x in pair))
        return F.element_at(listed, col)

    return price(imputer, IMPUTER_COST) + price(detector, DETECTOR_COST)


def apply_action(
    df: DataFrame, features: Sequence[str], id_column: str, action: tuple, seed: int = 0
) -> DataFrame:
    """Impute features, score outliers, drop the flagged rows unless too few would stay.

    Other columns (the target among them) pass through unseen.
    """
    return apply_actions(df, features, id_column, [action], seed)[0]


def apply_actions(
    df: DataFrame, features: Sequence[str], id_column: str, chosen: Sequence[tuple], seed: int = 0
) -> list[DataFrame]:
    """``apply_action`` for each chosen action: a fill serves all actions of its imputer, scores all cuts of their detector."""
    out: dict[tuple, DataFrame] = {}
    for imputer in dict.fromkeys(a[1] for a in chosen):
        own = [a for a in chosen if a[1] == imputer]
        filled = impute(df, ImputeSettings(method=imputer), seed=seed, id_column=id_column, columns=features).df
        detectors = dict.fromkeys(a[2] for a in own)
        if len(own) > 1 or "none" not in detectors:
            filled = checkpointed(filled)  # read by each scoring and for each result
        for detector in detectors:
            cuts = [a for a in own if a[2] == detector]
            if detector == "none":
                out.update(dict.fromkeys(cuts, filled.select(*df.columns)))
                continue
            scored = detect_at(
                filled, OutlierSettings(method=detector), [a[4] for a in cuts], seed=seed, id_column=id_column, columns=features
            )
            out.update((a, drop_flagged(s.df).select(*df.columns)) for a, s in zip(cuts, scored))
    return [out[a] for a in chosen]


def action_reward(scores: DataFrame, baselines: DataFrame, by: Sequence[str]) -> DataFrame:
    """reward = (score - baseline score of the mean/mode fill) - cost.

    ``scores`` has (by, action columns, score), ``baselines`` (by, baseline_score).
    """
    cost = action_cost(F.col("imputer"), F.col("outlier_method"))
    return (
        scores.join(baselines, list(by))
        .withColumn("cost", cost)
        .withColumn("reward", F.col("score") - F.col("baseline_score") - F.col("cost"))
    )


# (df, features, target, task, id_column) -> score
Reward = Callable[[DataFrame, Sequence[str], str, str, str], float]


def measure_actions(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    task: str,
    id_column: str,
    reward: Reward,
    chosen: Sequence[tuple] | None = None,
    seed: int = 0,
) -> DataFrame:
    """Score of each action and of the mean/mode fill on one dataset: a row per action."""
    spark = df.sparkSession
    listed = list(chosen if chosen is not None else actions())
    plain = impute_mean_mode(df.select(*features, target, id_column), features)
    total = df.count()
    left = apply_actions(df.select(id_column, *features, target), features, id_column, listed, seed)

    def score(rows: DataFrame) -> float:
        value = float(reward(rows, features, target, task, id_column))
        swept(spark)  # a forest shuffles at each level
        return value

    # one after another: the driver holds the trees of a reward's fits
    base, scores = score(plain), [score(x) for x in left]
    rows = [(*action, got, base, kept.count(), total) for action, got, kept in zip(listed, scores, left)]
    scored = spark.createDataFrame(
        rows,
        "action int, imputer string, outlier_method string, threshold_bin int, contamination double, "
        "score double, baseline_score double, rows_kept long, rows_total long",
    )
    cost = action_cost(F.col("imputer"), F.col("outlier_method"))
    return scored.withColumn("cost", cost).withColumn(
        "reward", F.col("score") - F.col("baseline_score") - F.col("cost")
    )


CHUNK = 1_000_000


def q_table(
    episodes: DataFrame,
    state: Sequence[str],
    action: str,
    order: str,
    reward: str,
    alpha: float = 0.1,
    chunk: int = CHUNK,
) -> DataFrame:
    """(state, action, n, q): Q <- Q + alpha (reward - Q) over the episodes in order, from 0.

    A stretch of episodes maps Q to keep * Q + gain, and such maps compose. Episodes are folded in
    stretches of ``chunk`` episode numbers, then the stretches of a group, so that a group with a
    large share of the log is spread over many tasks. ``order`` is a unique integer.
    """
    keys = [*state, action]
    parts = episodes.withColumn("_part", F.floor(F.col(order) / chunk))
    later = Window.partitionBy(*keys, "_part").orderBy(F.col(order).desc())
    decay = F.pow(F.lit(1.0 - alpha), F.row_number().over(later) - 1)
    folded = (
        parts.withColumn("_w", decay)
        .groupBy(*keys, "_part")
        .agg(F.count("*").alias("_n"), F.sum(F.col("_w") * F.col(reward) * alpha).alias("_gain"))
    )
    after = (
        Window.partitionBy(*keys).orderBy(F.col("_part").desc())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    rest = F.coalesce(F.sum("_n").over(after), F.lit(0))
    return (
        folded.withColumn("_rest", rest)
        .groupBy(*keys)
        .agg(
            F.sum("_n").alias("n"),
            F.sum(F.col("_gain") * F.pow(F.lit(1.0 - alpha), F.col("_rest"))).alias("q"),
        )
    )


def best_action(q: DataFrame, states: DataFrame, state: Sequence[str], action: str, n_actions: int, first=0) -> DataFrame:
    """(state, best_action, q): the action with the highest Q, the first one on ties.

    Actions never tried have Q 0, so they win over tried ones below 0. A state never seen gets the
    first action.
    """
    tried = q.groupBy(*state).agg(
        F.max(F.struct(F.col("q"), (-F.col(action)).alias("a"))).alias("_top"),
        F.collect_set(F.col(action)).alias("_seen"),  # at most n_actions values
    )
    every = F.sequence(F.lit(first), F.lit(first + n_actions - 1))
    untried = F.array_min(F.array_except(every, F.col("_seen")))
    top_q, top_a = F.col("_top.q"), -F.col("_top.a")
    # an untried action is worth 0; it wins when the best tried one is below, or equal and later
    other = untried.isNotNull() & ((top_q < 0) | ((top_q == 0) & (untried < top_a)))
    picked = tried.select(
        *(F.col(s).alias(f"_s_{s}") for s in state),
        F.when(other, untried).otherwise(top_a).cast("int").alias("_a"),
        F.when(other, 0.0).otherwise(top_q).alias("_q"),
    )
    on = [states[s].eqNullSafe(picked[f"_s_{s}"]) for s in state]
    return states.join(picked, on, "left").select(
        *(states[s] for s in state),
        F.coalesce("_a", F.lit(first)).alias("best_action"),
        F.coalesce("_q", F.lit(0.0)).alias("q"),
    )


def episode_log(
    episodes: DataFrame, order: str, state: Sequence[str], action: str, reward: str,
    epsilon: float = 0.3, decay: float = 0.98, least: float = 0.01,
) -> DataFrame:
    """(episode_number, state, action, reward, epsilon_used); epsilon decays per episode from 0."""
    used = F.greatest(F.lit(least), F.lit(epsilon) * F.pow(F.lit(decay), F.col(order)))
    return episodes.select(
        F.col(order).alias("episode_number"), *state, F.col(action).alias("action"),
        F.col(reward).alias("reward"), used.alias("epsilon_used"),
    )
