"""Model search, feature masks, adaptation and streams over the shared tables."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, functions as F

from assayer.functions.cutting import shared_folder
from assayer.operators import adapt, modelling, policy
from assayer.plans.quality import EARLY, HOLED_EVENTS, EVENTS, LATE, halves
from assayer.plans.registry import psi_sql, query, r6, table
from assayer.settings import AdaptSettings, DriftGateSettings, MaskSearchSettings, SearchSettings
from assayer.streaming import jobs, keyed

# A narrow range of tree counts keeps registered searches short; the library's ranges are wider.
QUICK = {"n_estimators": (5, 10), "max_depth": (2, 5), "num_leaves": (8, 16)}
SMALL = SearchSettings(n_trials=2, cv_folds=2, stacking_folds=2, families=("random_forest", "linear"))
EVERY = SearchSettings(n_trials=1, cv_folds=2, stacking_folds=2)


def part_task(spark, sf) -> modelling.Task:
    """Regression: retail price from key, size and name length."""
    part = table(spark, sf, "part").select(
        "p_partkey", "p_size", F.length("p_name").alias("name_length"), "p_retailprice"
    )
    part = part.withColumn("key", F.col("p_partkey") % 1000)
    return modelling.make_task(part, "p_partkey", ["key", "p_size", "name_length"], "p_retailprice", "regression")


def label_task(spark, sf) -> modelling.Task:
    """Classification: toxic from quality and text length."""
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    both = table(spark, sf, "labels").join(docs, "doc_id")
    both = both.withColumn("log_chars", F.log1p("n_chars"))
    return modelling.make_task(both, "doc_id", ["quality", "log_chars"], "toxic", "classification")


@query("default_baseline")
def default_baseline(spark, sf):
    tasks = {"part": part_task(spark, sf), "labels": label_task(spark, sf)}
    rows = [(n, modelling.default_baseline(t, "linear", SMALL)) for n, t in tasks.items()]
    return spark.createDataFrame(rows, "dataset string, score double")


@query("family_search")
def family_search(spark, sf):
    study = modelling.family_search(part_task(spark, sf), "random_forest", SMALL, QUICK)
    return modelling.trials_df(spark, [study])


@query("search_all_families")
def search_all_families(spark, sf):
    studies = modelling.search_all_families(part_task(spark, sf), EVERY, QUICK, refit=False)
    return modelling.trials_df(spark, list(studies.values()))


@query("stack")
def stack(spark, sf):
    task = label_task(spark, sf)
    params = {"random_forest": {"n_estimators": 10, "max_depth": 4}, "linear": {"C": 1.0}}
    return modelling.fit_stack(task, params, SMALL).transform(task.df).select("id", "label", "prediction")


@query("run_stacking")
def run_stacking(spark, sf):
    result = modelling.run_stacking(part_task(spark, sf), SMALL, QUICK, refit=False)
    rows = [(f, s.best_score, f == result.best_family, result.stack_score) for f, s in result.studies.items()]
    return spark.createDataFrame(rows, "model_family string, best_score double, is_best boolean, stack_score double")


_FAMILIES = """SELECT p_brand, p_type AS model_family, round(avg(p_retailprice), 4) AS score FROM part GROUP BY p_brand, p_type"""
_SIDE = """SELECT p_brand, round(max(p_retailprice) - 700, 4) AS stack_score, round(avg(p_retailprice), 4) AS baseline_score FROM part GROUP BY p_brand"""


@query(
    "stack_report",
    f"""WITH f AS ({_FAMILIES}), s AS ({_SIDE}), b AS (SELECT p_brand, max(score) AS best_score FROM f GROUP BY p_brand)
    SELECT b.p_brand, best_score, (SELECT min(model_family) FROM f WHERE f.p_brand = b.p_brand AND f.score = b.best_score) AS best_family,
    stack_score, baseline_score, stack_score > baseline_score AS beats_baseline, stack_score >= best_score AS matches_best
    FROM b JOIN s USING (p_brand)""",
)
def stack_report(spark, sf):
    part = table(spark, sf, "part")
    families = part.groupBy("p_brand", F.col("p_type").alias("model_family")).agg(r6(F.avg("p_retailprice"), 4).alias("score"))
    stacks = part.groupBy("p_brand").agg(r6(F.max("p_retailprice") - 700, 4).alias("stack_score"))
    base = part.groupBy("p_brand").agg(r6(F.avg("p_retailprice"), 4).alias("baseline_score"))
    return modelling.stack_report(families, stacks, base, ["p_brand"])


@query("reward_surrogate")
def reward_surrogate(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_size", (F.col("p_partkey") % 1000).alias("key"), "p_retailprice")
    score = modelling.reward_surrogate(trees=10)(part, ["key", "p_size"], "p_retailprice", "regression", "p_partkey")
    return spark.createDataFrame([("part", score)], "dataset string, reward double")


@query("reward_full_stack")
def reward_full_stack(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_size", (F.col("p_partkey") % 1000).alias("key"), "p_retailprice")
    chosen = SearchSettings(n_trials=1, cv_folds=2, stacking_folds=2, families=("random_forest", "linear"))
    score = modelling.reward_full_stack(chosen, QUICK)(part, ["key", "p_size"], "p_retailprice", "regression", "p_partkey")
    return spark.createDataFrame([("part", score)], "dataset string, reward double")


@query("measure_actions")
def measure_actions(spark, sf):
    from assayer.plans.quality import holed_part
    from assayer.sources.tables import drop_missing_target

    # the target keeps its values: rows without one cannot be scored
    part = drop_missing_target(holed_part(spark, sf, ["p_size"]).drop("p_type"), "p_retailprice")
    part = part.withColumn("key", (F.col("p_partkey") % 1000).cast("double"))
    return policy.measure_actions(part, ["p_size", "key"], "p_retailprice", "regression", "p_partkey", modelling.reward_surrogate())


# ---- masks

_COLS = ["c0", "c1", "c2", "c3"]
_SHIFT = """(SELECT (l_quantity - 25) / 25 AS c0, (l_extendedprice - 50000) / 50000 AS c1, (l_discount - 0.05) * 20 AS c2, (l_tax - 0.04) * 25 AS c3,
  (l_quantity + l_extendedprice / 2000 > 50)::INT AS y FROM lineitem)"""
MASKS = [[True, False, False, False], [True, True, False, False], [False, False, True, True], [True, True, True, True]]


def shifted(spark, sf) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        ((F.col("l_quantity") - 25) / 25).alias("c0"), ((F.col("l_extendedprice") - 50000) / 50000).alias("c1"),
        ((F.col("l_discount") - 0.05) * 20).alias("c2"), ((F.col("l_tax") - 0.04) * 25).alias("c3"),
        (F.col("l_quantity") + F.col("l_extendedprice") / 2000 > 50).cast("int").alias("y"),
    )


@query(
    "mask_fitness",
    " UNION ALL ".join(
        f"SELECT {i} AS mask, round(avg((({' + '.join(['0.0::DOUBLE', *(c for c, k in zip(_COLS, m) if k)])} > 0)::INT = y)::INT), 6) AS fitness FROM {_SHIFT}"
        for i, m in enumerate(MASKS)
    ),
)
def mask_fitness(spark, sf):
    return adapt.mask_fitness(shifted(spark, sf), _COLS, MASKS, "y").withColumn("fitness", r6("fitness"))


@query("feature_subset_search")
def feature_subset_search(spark, sf):
    names = [f"e{i}" for i in range(64)]
    vectors = table(spark, sf, "embeddings").select(
        *(F.get("embedding", F.lit(i)).cast("double").alias(n) for i, n in enumerate(names)), F.col("label").cast("double").alias("y")
    )
    s = AdaptSettings(inner_lr=0.1)
    fitness = adapt.adapted_mse_fitness(adapt.moments(vectors, names, "y"), adapt.start_head(64, 42), s)
    found = adapt.feature_subset_search(64, fitness, MaskSearchSettings(), 42)
    rows = [(h["generation"], h["best_fitness"], h["mean_fitness"], h["best_mask"]) for h in found.history]
    return spark.createDataFrame(rows, "generation int, best_fitness double, mean_fitness double, best_mask array<boolean>")


@query(
    "generation_history",
    """SELECT event_id // 500 AS generation, round(max(value), 6) AS best_fitness, round(avg(value), 6) AS mean_fitness,
    round(max(max(value)) OVER (ORDER BY event_id // 500), 6) AS best_so_far FROM events GROUP BY event_id // 500""",
)
def generation_history(spark, sf):
    scores = table(spark, sf, "events").select(F.floor(F.col("event_id") / 500).alias("generation"), "value")
    out = adapt.generation_history(scores, "generation", "value")
    return out.select("generation", *(r6(c).alias(c) for c in ("best_fitness", "mean_fitness", "best_so_far")))


# ---- fast adaptation


def _steps_sql(n: int, lr: float) -> str:
    """n gradient steps of one feature and a bias, from (mx, mxx, my, mxy)."""
    inner = "SELECT *, 0.0::DOUBLE AS b, 0.5::DOUBLE AS w FROM m"
    for _ in range(n):
        inner = f"SELECT user_id, mx, mxx, my, mxy, myy, b - {2 * lr} * (b + w * mx - my) AS b, w - {2 * lr} * (b * mx + w * mxx - mxy) AS w FROM ({inner})"
    return inner


@query(
    "grouped_fast_adapt",
    f"""WITH e AS (SELECT user_id, event_id % 100 / 100.0::DOUBLE AS x, value / 100 AS y FROM events),
    m AS (SELECT user_id, avg(x) AS mx, avg(x * x) AS mxx, avg(y) AS my, avg(x * y) AS mxy, avg(y * y) AS myy FROM e GROUP BY user_id)
    SELECT user_id, round(b, 6) AS bias, round(w, 6) AS weight,
    round(b * b + 2 * b * w * mx + w * w * mxx - 2 * (b * my + w * mxy) + myy, 6) AS loss FROM ({_steps_sql(5, 0.1)})""",
)
def grouped_fast_adapt(spark, sf):
    events = table(spark, sf, "events").select("user_id", (F.col("event_id") % 100 / 100.0).alias("x"), (F.col("value") / 100).alias("y"))
    out = adapt.grouped_fast_adapt(events, ["user_id"], ["x"], "y", np.array([0.0, 0.5]), 5, 0.1)
    return out.select("user_id", r6(F.get("head", F.lit(0))).alias("bias"), r6(F.get("head", F.lit(1))).alias("weight"), r6("loss").alias("loss"))


@query(
    "grouped_adapt_classes",
    """WITH e AS (SELECT l_returnflag AS g, (l_quantity - 25) / 25 AS x, (l_linestatus = 'O')::INT AS y FROM lineitem),
    s AS (SELECT g, avg((1 / (1 + exp(-(0.0 + 1.0 * x)))) - y) AS gb, avg(((1 / (1 + exp(-(0.0 + 1.0 * x)))) - y) * x) AS gw FROM e GROUP BY g),
    d AS (SELECT g, -0.2 * gb AS b, 1.0 - 0.2 * gw AS w FROM s)
    SELECT g AS l_returnflag, round(-b / 2, 6) AS b0, round(-0.5 - (w - 1.0) / 2, 6) AS w0, round(b / 2, 6) AS b1, round(0.5 + (w - 1.0) / 2, 6) AS w1 FROM d""",
)
def grouped_adapt_classes(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        "l_returnflag", ((F.col("l_quantity") - 25) / 25).alias("x"), (F.col("l_linestatus") == "O").cast("int").alias("y")
    )
    out = adapt.grouped_adapt_classes(rows, ["l_returnflag"], ["x"], "y", np.array([[0.0, -0.5], [0.0, 0.5]]), 1, 0.1)
    return out.select("l_returnflag", *(r6(F.get("head", F.lit(i))).alias(n) for i, n in enumerate(["b0", "w0", "b1", "w1"])))


@query("meta_train_init")
def meta_train_init(spark, sf):
    line = table(spark, sf, "lineitem").select(
        (F.col("l_suppkey")).alias("task"), F.when(F.col("l_linenumber") % 2 == 0, "support").otherwise("query").alias("split"),
        (F.col("l_quantity") / 50).alias("x"), F.col("l_discount").alias("d"), (F.col("l_extendedprice") / 1e5).alias("y"),
    )
    _, history = adapt.meta_train_init(line, "task", "split", ["x", "d"], "y", AdaptSettings(outer_lr=0.01))
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(history)], "step int, query_loss double")


def _batches(spark, sf):
    early, late = halves(spark, sf)
    made = [df.select((F.col("event_id") % 100 / 100.0).alias("x"), (F.col("value") / 100).alias("v"), (F.col("user_id") / 150.0).alias("y")) for df in (early, late)]
    return made[0], made[1], made[1].withColumn("v", F.col("v") * 3 + 0.5)


@query("adaptive_step")
def adaptive_step(spark, sf):
    first, calm, moved = _batches(spark, sf)
    names = ["x", "v"]
    start = adapt.start_head(2, 42)
    state = adapt.AdaptState([True, True], [float(x) for x in start], adapt.Reference.of(first, names))
    rows = []
    for name, batch in (("calm", calm), ("moved", moved), ("moved_again", moved)):
        done = adapt.adaptive_step(batch, names, "y", state, start, seed=42)
        state = done.state
        rows.append((name, done.drift_detected, state.n_adaptations, state.n_batches_seen, sum(state.mask), done.fitness))
    return spark.createDataFrame(
        rows, "batch string, drift_detected boolean, n_adaptations int, n_batches_seen int, n_features int, fitness double"
    )


_X, _V = "event_id % 100 / 100.0::DOUBLE AS x", "value / 100 AS v"
_FIRST, _CALM = f"(SELECT {_X}, {_V} FROM {EARLY})", f"(SELECT {_X}, {_V} FROM {LATE})"
_MOVED = f"(SELECT {_X}, value / 100 * 3 + 0.5 AS v FROM {LATE})"


def _ks_p_sql(reference: str, current: str, column: str) -> str:
    """SELECT p of one column; both arguments are table expressions."""
    return f"""SELECT CASE WHEN s * d * d < 0.01 THEN 1 ELSE least(1, 2 * list_sum(list_transform(range(1, 101), lambda k: (2 * (k % 2) - 1) * exp(-2 * k * k * s * d * d)))) END AS p
      FROM (SELECT max(nr) * max(nc) / (max(nr) + max(nc)) AS s, max(abs(fr / nr - fc / nc)) AS d FROM (
        SELECT sum(r) OVER w AS fr, sum(c) OVER w AS fc, sum(r) OVER () AS nr, sum(c) OVER () AS nc FROM (
          SELECT v, sum(r) AS r, sum(c) AS c FROM (SELECT {column} AS v, 1 AS r, 0 AS c FROM {reference} UNION ALL SELECT {column}, 0, 1 FROM {current})
          GROUP BY v) WINDOW w AS (ORDER BY v)))"""


def _moved_sql(method: str, reference: str, current: str) -> str:
    if method == "psi":
        return f"(SELECT max(psi) > 0.25 FROM ({psi_sql(reference, current, ['x', 'v'])}))"
    return "(SELECT min(p) < 0.05 FROM (" + " UNION ALL ".join(_ks_p_sql(reference, current, c) for c in "xv") + "))"


@query(
    "adaptive_step_counters",
    " UNION ALL ".join(
        f"""SELECT '{m}' AS method, batch, drift_detected, (sum(drift_detected::INT) OVER (ORDER BY n_batches_seen))::INT AS n_adaptations, n_batches_seen FROM (
      SELECT 'calm' AS batch, {_moved_sql(m, _FIRST, _CALM)} AS drift_detected, 1 AS n_batches_seen
      UNION ALL SELECT 'moved', CASE WHEN {_moved_sql(m, _FIRST, _CALM)} THEN {_moved_sql(m, _CALM, _MOVED)} ELSE {_moved_sql(m, _FIRST, _MOVED)} END, 2
      UNION ALL SELECT 'moved_again', {_moved_sql(m, _MOVED, _MOVED)}, 3)"""
        for m in ("psi", "ks")
    ),
)
def adaptive_step_counters(spark, sf):
    first, calm, moved = _batches(spark, sf)
    names, start, rows = ["x", "v"], adapt.start_head(2, 42), []
    for method in ("psi", "ks"):
        drift = DriftGateSettings(method=method)
        state = adapt.AdaptState([True, True], [float(x) for x in start], adapt.Reference.of(first, names, method=method))
        for name, batch in (("calm", calm), ("moved", moved), ("moved_again", moved)):
            done = adapt.adaptive_step(batch, names, "y", state, start, drift=drift, seed=42)
            state = done.state
            rows.append((method, name, done.drift_detected, state.n_adaptations, state.n_batches_seen))
    return spark.createDataFrame(rows, "method string, batch string, drift_detected boolean, n_adaptations int, n_batches_seen int")


_IN = "d.v >= b.lo AND (d.v < b.hi OR (b.last AND d.v = b.hi))"
_MARKS = ", ".join(str(i / 10) for i in range(11))


@query(
    "batch_drift_sequence",
    f"""WITH RECURSIVE d AS (SELECT day, value * (1 + day // 10) AS v FROM (SELECT date_diff('day', DATE '2024-01-01', ts::DATE)::INT AS day, value FROM events)),
    n AS (SELECT day, count(*)::DOUBLE AS n FROM d GROUP BY day),
    e AS (SELECT r, e, row_number() OVER (PARTITION BY r ORDER BY e) AS i FROM
      (SELECT DISTINCT r, e FROM (SELECT day AS r, unnest(quantile_cont(v, [{_MARKS}])) AS e FROM d GROUP BY day))),
    b AS (SELECT * FROM (SELECT r, i, e AS lo, lead(e) OVER (PARTITION BY r ORDER BY i) AS hi, i = max(i) OVER (PARTITION BY r) - 1 AS last FROM e) WHERE hi IS NOT NULL),
    c AS (SELECT b.r, n.day, b.i, greatest(count(d.v) / max(n.n), 1e-6) AS s FROM b JOIN n ON n.day >= b.r LEFT JOIN d ON d.day = n.day AND {_IN} GROUP BY b.r, n.day, b.i),
    p AS (SELECT c.r, c.day, sum((c.s - o.s) * ln(c.s / o.s)) AS psi FROM c JOIN c o ON o.r = c.r AND o.i = c.i AND o.day = o.r WHERE c.day > c.r GROUP BY c.r, c.day),
    w AS (SELECT 0 AS day, NULL::INT AS ref, NULL::DOUBLE AS psi, true AS drifted, 0 AS cur
      UNION ALL SELECT p.day, w.cur, p.psi, p.psi > 0.25, CASE WHEN p.psi > 0.25 THEN p.day ELSE w.cur END FROM w JOIN p ON p.r = w.cur AND p.day = w.day + 1)
    SELECT day AS batch, ref AS reference_batch, round(psi, 6) AS max_psi, drifted FROM w""",
)
def batch_drift_sequence(spark, sf):
    events = table(spark, sf, "events")
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01"))
    moved = events.select(day.alias("day"), (F.col("value") * (1 + F.floor(day / 10))).alias("value"))
    return adapt.batch_drift_sequence(moved, "day", ["value"]).withColumn("max_psi", r6("max_psi"))


# ---- streams


def _folder(spark, name: str) -> tuple[str, str]:
    root = f"{shared_folder(spark)}/streams/{name}-{uuid.uuid4().hex}"
    return f"{root}/out", f"{root}/checkpoint"


def _events_stream(spark, sf) -> DataFrame:
    schema = table(spark, sf, "events").schema
    return jobs.table_stream(spark, sf, "events.parquet", schema)


def _holed_stream(spark, sf) -> DataFrame:
    from assayer.operators.evaluate import mcar_mask
    from assayer.plans.quality import EVENT_HOLES

    stream = _events_stream(spark, sf)
    masks = {c: mcar_mask(F.col("event_id"), rate, seed) for c, rate, seed in EVENT_HOLES}
    return stream.select(*(F.when(~masks[c], F.col(c)).alias(c) if c in masks else F.col(c) for c in EVENTS))


@query(
    "stream_window_profile",
    f"""WITH h AS ({HOLED_EVENTS}), w AS (SELECT date_trunc('day', ts) AS s, * FROM h)
    SELECT s AS window_start, s + INTERVAL 1 DAY AS window_end, count(*) AS n_rows, round((count(*) - count(value)) / count(*), 6) AS missingness_rate,
    count(DISTINCT event_type) AS n_categories, round(avg(value), 6) AS value_mean,
    round(skewness(value) * (count(value) - 2) / sqrt(count(value) * (count(value) - 1)), 6) AS value_skew
    FROM w GROUP BY s""",
)
def stream_window_profile(spark, sf):
    from assayer.plans.quality import holed_events

    out, check = _folder(spark, "window_profile")
    events = holed_events(spark, sf)
    keyed.stage(events, "ts", f"{out}-in")
    stream = jobs.table_stream(spark, f"{out}-in", "*.parquet", events.schema, files_per_batch=1)
    jobs.to_table(jobs.window_profile(stream, "ts", ["value"], "event_type"), out, check).awaitTermination()
    done = spark.read.parquet(out)
    mean = r6(r6("value_mean", 12))  # what the order of adding leaves in the last digits does not decide a tie
    return done.select(
        F.col("window_start").cast("timestamp_ntz").alias("window_start"), F.col("window_end").cast("timestamp_ntz").alias("window_end"),
        "n_rows", r6("missingness_rate").alias("missingness_rate"), "n_categories", mean.alias("value_mean"), r6("value_skew").alias("value_skew"),
    )


@query(
    "stream_null_gate",
    f"WITH h AS ({HOLED_EVENTS}) " + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) AS n_rows, count(*) - count({c}) AS n_missing,
        round((count(*) - count({c})) / count(*), 6) AS null_rate FROM h""" for c in EVENTS
    ),
)
def stream_null_gate(spark, sf):
    out, check = _folder(spark, "null_gate")
    jobs.per_batch(_holed_stream(spark, sf), jobs.null_gate_job(out), check).awaitTermination()
    per = spark.read.parquet(out).groupBy("column").agg(F.sum("n_rows").alias("n_rows"), F.sum("n_missing").alias("n_missing"))
    return per.withColumn("null_rate", r6(F.col("n_missing") / F.col("n_rows")))


@query("stream_drift_gate", f"""SELECT "column", round(psi, 6) AS psi, psi > 0.25 AS drifted FROM ({psi_sql(EARLY, 'events', ['value', 'user_id'])})""")
def stream_drift_gate(spark, sf):
    early, _ = halves(spark, sf)
    reference = adapt.Reference.of(early, ["value", "user_id"])
    out, check = _folder(spark, "drift_gate")
    jobs.per_batch(_events_stream(spark, sf), jobs.drift_gate_job(out, reference), check).awaitTermination()
    return spark.read.parquet(out).select("column", r6("psi").alias("psi"), "drifted")


# Two named streams of the same events, one of them scaled threefold every ten days.
_NAMED = """SELECT k.key, ts::DATE AS batch, event_id % 100 / 100.0::DOUBLE AS x,
    value / 100 * CASE k.key WHEN 'moved' THEN 3.0 ** (date_diff('day', DATE '2024-01-01', ts::DATE) // 10) ELSE 1 END AS v
    FROM events, (VALUES ('moved'), ('steady')) k(key)"""


@query(
    "stream_adaptive_step",
    f"""WITH RECURSIVE s AS ({_NAMED}), o AS (SELECT DISTINCT key, batch, dense_rank() OVER (PARTITION BY key ORDER BY batch) AS day FROM s),
    d AS (SELECT s.key, o.day, c.c, CASE c.c WHEN 'x' THEN x ELSE v END AS v FROM s JOIN o USING (key, batch), (VALUES ('x'), ('v')) c(c)),
    n AS (SELECT key, day, c, count(*)::DOUBLE AS n FROM d GROUP BY ALL),
    e AS (SELECT key, r, c, e, row_number() OVER (PARTITION BY key, r, c ORDER BY e) AS i FROM
      (SELECT DISTINCT key, r, c, e FROM (SELECT key, day AS r, c, unnest(quantile_cont(v, [{_MARKS}])) AS e FROM d GROUP BY key, day, c))),
    b AS (SELECT * FROM (SELECT key, r, c, i, e AS lo, lead(e) OVER w AS hi, i = max(i) OVER (PARTITION BY key, r, c) - 1 AS last FROM e
      WINDOW w AS (PARTITION BY key, r, c ORDER BY i)) WHERE hi IS NOT NULL),
    t AS (SELECT b.key, b.r, n.day, b.c, b.i, greatest(count(d.v) / max(n.n), 1e-6) AS s FROM b JOIN n ON n.key = b.key AND n.c = b.c AND n.day >= b.r
      LEFT JOIN d ON d.key = n.key AND d.c = n.c AND d.day = n.day AND {_IN} GROUP BY b.key, b.r, n.day, b.c, b.i),
    p AS (SELECT key, r, day, max(psi) AS psi FROM (SELECT t.key, t.r, t.day, t.c, sum((t.s - f.s) * ln(t.s / f.s)) AS psi
      FROM t JOIN t f ON f.key = t.key AND f.c = t.c AND f.r = t.r AND f.i = t.i AND f.day = f.r WHERE t.day > t.r GROUP BY ALL) GROUP BY key, r, day),
    w AS (SELECT key, 1::BIGINT AS day, true AS drifted, 1::BIGINT AS cur, 1 AS adaptations FROM (SELECT DISTINCT key FROM s)
      UNION ALL SELECT w.key, p.day, p.psi > 0.25, CASE WHEN p.psi > 0.25 THEN p.day ELSE w.cur END, w.adaptations + (p.psi > 0.25)::INT
      FROM w JOIN p ON p.key = w.key AND p.r = w.cur AND p.day = w.day + 1)
    SELECT w.key, o.batch, (SELECT count(*) FROM s WHERE s.key = w.key AND s.batch = o.batch) AS n_rows, drifted AS drift_detected,
    adaptations AS n_adaptations, w.day::INT AS n_batches_seen FROM w JOIN o ON o.key = w.key AND o.day = w.day""",
)
def stream_adaptive_step(spark, sf):
    out = adaptive_days(spark, sf)
    return out.select("key", F.to_date("batch").alias("batch"), "n_rows", "drift_detected", "n_adaptations", "n_batches_seen")


def adaptive_days(spark, sf, **settings) -> DataFrame:
    """What the keyed adaptation emits over ``events`` in twelve micro-batches and more."""
    events = table(spark, sf, "events").select("event_id", "ts", "user_id", "value")
    out, check = _folder(spark, "adaptive_step")
    keyed.stage(events, "ts", f"{out}-in")
    stream = jobs.table_stream(spark, f"{out}-in", "*.parquet", events.schema, files_per_batch=1)
    days = F.floor(F.datediff(F.to_date("ts"), F.lit("2024-01-01")) / 10)
    scale = F.when(F.col("key") == "moved", F.pow(F.lit(3.0), days)).otherwise(1.0)
    named = stream.select("*", F.explode(F.array(F.lit("moved"), F.lit("steady"))).alias("key"))
    rows = named.select(
        "key", "ts", (F.col("event_id") % 100 / 100.0).alias("x"), (F.col("value") / 100 * scale).alias("v"), (F.col("user_id") / 150.0).alias("y")
    )
    with keyed.keyed_state(spark):
        made = keyed.adaptive_stream(rows, "ts", "key", ["x", "v"], "y", adapt.start_head(2, 42), seed=42, **settings)
        jobs.to_table(made, out, check).awaitTermination()
    return spark.read.parquet(out)
