"""Method comparisons and the preprocessing policy over the shared tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from assayer.functions.columns import MIX_MODULUS
from assayer.operators import evaluate, impute, outliers, policy
from assayer.plans.registry import holed_sql, mix_sql, query, r6, table

_COLS = ["c_custkey", "c_acctbal", "c_nationkey"]
_MASKS = [("c_acctbal", 0.2, 31), ("c_nationkey", 0.2, 32)]


def numbers(spark, sf) -> DataFrame:
    df = table(spark, sf, "customer")
    return df.select("c_custkey", "c_acctbal", F.col("c_nationkey").cast("double").alias("c_nationkey"))


@query("inject_mcar", holed_sql("(SELECT c_custkey, c_acctbal, c_nationkey::DOUBLE AS c_nationkey FROM customer)", "c_custkey", _MASKS, _COLS))
def inject_mcar(spark, sf):
    return evaluate.inject_mcar(numbers(spark, sf), F.col("c_custkey"), ["c_acctbal", "c_nationkey"], 0.2, 31)


def _gone(c: str, seed: int) -> str:
    return f"{mix_sql('c_custkey', seed)} < {int(0.2 * MIX_MODULUS) + 1}"


@query(
    "masked_rmse",
    f"""WITH t AS (SELECT c_custkey, c_acctbal AS a, c_nationkey::DOUBLE AS n, {_gone('a', 31)} AS ma, {_gone('n', 32)} AS mn FROM customer),
    m AS (SELECT avg(a) FILTER (WHERE NOT ma) AS a, avg(n) FILTER (WHERE NOT mn) AS n FROM t)
    SELECT 'mean' AS method, count(*) AS n_cells, round(sqrt(avg(e)), 6) AS rmse FROM (
      SELECT (m.a - t.a) * (m.a - t.a) AS e FROM t, m WHERE ma UNION ALL SELECT (m.n - t.n) * (m.n - t.n) FROM t, m WHERE mn)
    UNION ALL SELECT 'zero', count(*), round(sqrt(avg(e)), 6) FROM (
      SELECT t.a * t.a AS e FROM t WHERE ma UNION ALL SELECT t.n * t.n FROM t WHERE mn)""",
)
def masked_rmse(spark, sf):
    truth = numbers(spark, sf)
    holed = evaluate.inject_mcar(truth, F.col("c_custkey"), ["c_acctbal", "c_nationkey"], 0.2, 31)
    filled = {"mean": impute.impute_mean_mode(holed, ["c_acctbal", "c_nationkey"]), "zero": holed.fillna(0.0)}
    mask = {
        c: evaluate.mcar_mask(F.col("c_custkey"), 0.2, 31 + i) for i, c in enumerate(["c_acctbal", "c_nationkey"])
    }
    out = evaluate.masked_rmse(truth, filled, "c_custkey", ["c_acctbal", "c_nationkey"], mask)
    return out.withColumn("rmse", r6("rmse"))


# As many synthetic rows as make up 5% of the real ones, each column drawn on its own with replacement.
_N = "(SELECT count(*) FROM customer)"


def _drawn(expression: str, name: str, seed: int) -> str:
    place = f"floor({mix_sql('p', seed + evaluate.DRAW_SEED)} / {float(MIX_MODULUS)} * {_N})::BIGINT + 1"
    return f"""(SELECT p AS "position", {name} FROM (SELECT p, {place} AS place FROM (SELECT unnest(range(1, {_N} // 20 + 1)) AS p)) d
      JOIN (SELECT row_number() OVER (ORDER BY {mix_sql('c_custkey', seed)}, c_custkey) AS r, {expression} AS {name} FROM customer) c
      ON d.place = c.r)"""


_SHUFFLED = f"""(SELECT "position", c_acctbal, c_nationkey FROM {_drawn('c_acctbal', 'c_acctbal', 51)} a
  JOIN {_drawn('c_nationkey::DOUBLE', 'c_nationkey', 52)} b USING ("position"))"""


@query("marginal_resample", f"SELECT * FROM {_SHUFFLED}")
def marginal_resample(spark, sf):
    real = numbers(spark, sf)
    return evaluate.marginal_resample(real, "c_custkey", ["c_acctbal", "c_nationkey"], 51, real.count() // 20)


_UNION = f"""(SELECT c_custkey AS id, c_acctbal, c_nationkey::DOUBLE AS c_nationkey, false AS is_outlier FROM customer
  UNION ALL SELECT -"position", c_acctbal, c_nationkey, true FROM {_SHUFFLED})"""


def union_rows(spark, sf) -> DataFrame:
    real = numbers(spark, sf).withColumnRenamed("c_custkey", "id")
    synthetic = marginal_resample(spark, sf).select((-F.col("position")).alias("id"), "c_acctbal", "c_nationkey")
    return evaluate.labelled_union(real, synthetic)


@query("labelled_union", f"SELECT * FROM {_UNION}")
def labelled_union(spark, sf):
    return union_rows(spark, sf)


@query(
    "outlier_recall",
    f"""WITH u AS (SELECT * FROM {_UNION}), q AS (SELECT quantile_cont(c_acctbal, 0.25) AS a1, quantile_cont(c_acctbal, 0.75) AS a3,
      quantile_cont(c_nationkey, 0.25) AS n1, quantile_cont(c_nationkey, 0.75) AS n3, quantile_cont(abs(c_acctbal), 0.95) AS cut FROM u),
    f AS (SELECT is_outlier, c_acctbal < a1 - 0.4 * (a3 - a1) OR c_acctbal > a3 + 0.4 * (a3 - a1) OR c_nationkey < n1 - 0.4 * (n3 - n1)
      OR c_nationkey > n3 + 0.4 * (n3 - n1) AS iqr, abs(c_acctbal) > cut AS top FROM u, q)
    SELECT 'iqr' AS method, count(*) AS n_true, round(avg(iqr::INT), 6) AS recall FROM f WHERE is_outlier
    UNION ALL SELECT 'top', count(*), round(avg(top::INT), 6) FROM f WHERE is_outlier""",
)
def outlier_recall(spark, sf):
    df = union_rows(spark, sf)
    df = df.withColumn("iqr", outliers.iqr_flag(df, ["c_acctbal", "c_nationkey"], 0.4)).withColumn("size", F.abs("c_acctbal"))
    cut = outliers.contamination_cut(df, "size", 0.05).withColumnRenamed(outliers.FLAG, "top")
    return evaluate.outlier_recall(cut, "is_outlier", ["iqr", "top"]).withColumn("recall", r6("recall"))


# paired scores: per part brand and size, retail price against a shifted copy
_PAIRS = "(SELECT p_brand, p_type, p_retailprice AS a, p_retailprice + (p_size - 25) * 0.5 AS b FROM part)"


def pairs(spark, sf) -> DataFrame:
    return table(spark, sf, "part").select(
        "p_brand", "p_type", F.col("p_retailprice").alias("a"),
        (F.col("p_retailprice") + (F.col("p_size") - 25) * 0.5).alias("b"),
    )


@query(
    "paired_ttest",
    f"""SELECT p_brand, count(*) AS n, round(avg(a - b), 6) AS mean_difference, round(avg(a - b) / (stddev_samp(a - b) / sqrt(count(*))), 6) AS t
    FROM {_PAIRS} GROUP BY p_brand""",
)
def paired_ttest(spark, sf):
    out = evaluate.paired_t(pairs(spark, sf), "a", "b", ["p_brand"])
    return out.withColumn("mean_difference", r6("mean_difference")).withColumn("t", r6("t"))


@query(
    "summary_by_group",
    f"""SELECT p_type, round(avg(a), 6) AS a_mean, round(stddev_samp(a), 6) AS a_std, round(avg(b), 6) AS b_mean,
    round(stddev_samp(b), 6) AS b_std FROM {_PAIRS} GROUP BY p_type""",
)
def summary_by_group(spark, sf):
    out = evaluate.summary_by_group(pairs(spark, sf), ["p_type"], ["a", "b"])
    return out.select("p_type", *(r6(c).alias(c) for c in out.columns if c != "p_type"))


@query(
    "win_counts",
    f"""SELECT p_type, count(*) AS n, count(*) FILTER (WHERE a > b) AS wins, count(*) FILTER (WHERE a >= b) AS wins_or_ties,
    count(*) FILTER (WHERE a >= b - 0.05) AS near_or_better FROM {_PAIRS} GROUP BY p_type""",
)
def win_counts(spark, sf):
    return evaluate.win_counts(pairs(spark, sf), "a", "b", ["p_type"])


_PRED = """(SELECT o_orderpriority, year(o_orderdate) AS batch, o_orderkey % 3 AS y, s AS strategy,
  CASE s WHEN 'static' THEN o_custkey % 3 WHEN 'retrain' THEN (o_orderkey + (o_custkey % 2)) % 3 ELSE (o_orderkey + (o_custkey % 5) // 4) % 3 END AS p
  FROM orders, (SELECT unnest(['static', 'retrain', 'adapt']) AS s))"""


def predictions(spark, sf) -> DataFrame:
    orders = table(spark, sf, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    made = {"static": c % 3, "retrain": (k + c % 2) % 3, "adapt": (k + F.floor(c % 5 / 4)) % 3}
    cells = F.array(*(F.struct(F.lit(n).alias("strategy"), p.cast("bigint").alias("p")) for n, p in made.items()))
    return orders.select("o_orderpriority", F.year("o_orderdate").alias("batch"), (k % 3).alias("y"), F.inline(cells))


@query(
    "score",
    f"""SELECT strategy, round(avg((y = p)::INT), 6) AS accuracy, round(-sqrt(avg((p - y) * (p - y))), 6) AS neg_rmse FROM {_PRED} GROUP BY strategy""",
)
def score(spark, sf):
    p = predictions(spark, sf)
    both = {"accuracy": "classification", "neg_rmse": "regression"}
    return p.groupBy("strategy").agg(*(r6(evaluate.score_column(t, "y", "p")).alias(n) for n, t in both.items()))


@query(
    "prequential_accuracy",
    f"""SELECT strategy, batch::INT AS batch, n, round(accuracy, 6) AS accuracy,
    round(avg(accuracy) OVER (PARTITION BY strategy ORDER BY batch), 6) AS running_mean
    FROM (SELECT strategy, batch, count(*) AS n, avg((y = p)::INT) AS accuracy FROM {_PRED} GROUP BY strategy, batch)""",
)
def prequential_accuracy(spark, sf):
    out = evaluate.prequential_accuracy(predictions(spark, sf), "strategy", "batch", "y", "p")
    return out.withColumn("accuracy", r6("accuracy")).withColumn("running_mean", r6("running_mean"))


# ---- policy


def _lit(v) -> str:
    return "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)


_ACTIONS = "(VALUES " + ", ".join(
    "(" + ", ".join(map(_lit, a)) + ")" for a in policy.actions()
) + ") AS x(action, imputer, outlier_method, threshold_bin, contamination)"
_COST = (
    "(CASE imputer WHEN 'mice' THEN 0.02 ELSE 0.005 END + "
    "CASE outlier_method WHEN 'isolation_forest' THEN 0.005 WHEN 'lof' THEN 0.01 ELSE 0.0 END)::DOUBLE"
)
_STATES = "(SELECT o_orderpriority, avg(o_totalprice) / 1e6 AS level, min(o_totalprice) / 1e6 AS baseline_score FROM orders GROUP BY 1) s"


def states(spark, sf) -> DataFrame:
    return table(spark, sf, "orders").groupBy("o_orderpriority").agg(
        (F.avg("o_totalprice") / 1e6).alias("level"), (F.min("o_totalprice") / 1e6).alias("baseline_score")
    )


@query("action_space", f"SELECT o_orderpriority, action, imputer, outlier_method, threshold_bin, contamination::DOUBLE AS contamination FROM {_STATES}, {_ACTIONS}")
def action_space(spark, sf):
    return policy.action_grid(states(spark, sf).select("o_orderpriority"))


@query("action_cost", f"SELECT o_orderpriority, action, {_COST} AS cost FROM {_STATES}, {_ACTIONS}")
def action_cost(spark, sf):
    grid = policy.action_grid(states(spark, sf).select("o_orderpriority"))
    return grid.select("o_orderpriority", "action", policy.action_cost(F.col("imputer"), F.col("outlier_method")).alias("cost"))


@query(
    "action_reward",
    f"""SELECT o_orderpriority, action, round(level + action / 100.0, 6) AS score, round(baseline_score, 6) AS baseline_score, {_COST} AS cost,
    round(level + action / 100.0 - baseline_score - {_COST}, 6) AS reward FROM {_STATES}, {_ACTIONS}""",
)
def action_reward(spark, sf):
    base = states(spark, sf)
    grid = policy.action_grid(base.select("o_orderpriority", "level"))
    scores = grid.withColumn("score", F.col("level") + F.col("action") / 100.0)
    out = policy.action_reward(scores, base.select("o_orderpriority", "baseline_score"), ["o_orderpriority"])
    return out.select("o_orderpriority", "action", r6("score").alias("score"), r6("baseline_score").alias("baseline_score"), "cost", r6("reward").alias("reward"))


def _nearest_sql(column: str) -> str:
    shared = " + ".join(f"(r.{c} IS NOT NULL AND d.{c} IS NOT NULL)::INT" for c in ("a", "n"))
    total = " + ".join(f"coalesce((r.{c} - d.{c}) * (r.{c} - d.{c}), 0.0)" for c in ("a", "n"))
    return f"""SELECT id, avg(v) AS v FROM (
      SELECT r.id, d.{column} AS v, row_number() OVER (PARTITION BY r.id ORDER BY sqrt(({total}) * (2.0::DOUBLE / ({shared}))), d.id) AS k
      FROM base r JOIN base d ON r.{column} IS NULL AND d.{column} IS NOT NULL WHERE ({shared}) > 0) WHERE k <= 5 GROUP BY id"""


_HOLED = holed_sql("(SELECT c_custkey, c_acctbal, c_nationkey::DOUBLE AS c_nationkey FROM customer)", "c_custkey", _MASKS, _COLS)


@query(
    "apply_action",
    f"""WITH base AS (SELECT c_custkey AS id, c_acctbal AS a, c_nationkey AS n FROM ({_HOLED})),
    ka AS ({_nearest_sql('a')}), kn AS ({_nearest_sql('n')}),
    f AS (SELECT b.id, coalesce(b.a, ka.v, (SELECT avg(a) FROM base)) AS a, coalesce(b.n, kn.v, (SELECT avg(n) FROM base)) AS n
      FROM base b LEFT JOIN ka USING (id) LEFT JOIN kn USING (id)),
    nb AS (SELECT * FROM (SELECT r.id AS i, d.id AS j, sqrt((r.a - d.a) * (r.a - d.a) + (r.n - d.n) * (r.n - d.n)) AS dist,
        row_number() OVER (PARTITION BY r.id ORDER BY dist, d.id) AS k FROM f r JOIN f d ON r.id <> d.id) WHERE k <= 20),
    kd AS (SELECT i, max(dist) AS kdist FROM nb GROUP BY i),
    lrd AS (SELECT nb.i, 1.0 / (avg(greatest(nb.dist, kd.kdist)) + 1e-10) AS lrd FROM nb JOIN kd ON kd.i = nb.j GROUP BY nb.i),
    s AS (SELECT nb.i, avg(b.lrd) / max(a.lrd) AS score FROM nb JOIN lrd b ON b.i = nb.j JOIN lrd a ON a.i = nb.i GROUP BY nb.i)
    SELECT id AS c_custkey, round(a, 6) AS c_acctbal, round(n, 6) AS c_nationkey FROM f JOIN s ON s.i = f.id
    WHERE score <= (SELECT quantile_cont(score, 0.95) FROM s)""",
)
def apply_action(spark, sf):
    df = evaluate.inject_mcar(numbers(spark, sf), F.col("c_custkey"), ["c_acctbal", "c_nationkey"], 0.2, 31)
    chosen = next(a for a in policy.actions() if a[1:4] == ("knn", "lof", 1))
    out = policy.apply_action(df, ["c_acctbal", "c_nationkey"], "c_custkey", chosen)
    return out.withColumn("c_acctbal", r6("c_acctbal")).withColumn("c_nationkey", r6("c_nationkey"))


_EPISODES = "(SELECT event_type, (user_id % 18)::INT AS action, event_id, (value - 50) / 100 AS reward FROM events)"
_Q = f"""q AS (SELECT event_type, action, count(*) AS n, sum(0.1 * power(0.9, k) * reward) AS q FROM (
  SELECT *, row_number() OVER (PARTITION BY event_type, action ORDER BY event_id DESC) - 1 AS k FROM {_EPISODES}) GROUP BY event_type, action)"""


def episodes(spark, sf) -> DataFrame:
    return table(spark, sf, "events").select(
        "event_type", (F.col("user_id") % 18).cast("int").alias("action"), "event_id", ((F.col("value") - 50) / 100).alias("reward")
    )


@query("q_table_update", f"WITH {_Q} SELECT event_type, action, n, round(q, 6) AS q FROM q")
def q_table_update(spark, sf):
    return policy.q_table(episodes(spark, sf), ["event_type"], "action", "event_id", "reward").withColumn("q", r6("q"))


@query(
    "best_action",
    f"""WITH {_Q}, s AS (SELECT DISTINCT event_type FROM events UNION SELECT 'unseen'),
    full_q AS (SELECT s.event_type, a.action, coalesce(q.q, 0.0) AS q FROM s CROSS JOIN (SELECT unnest(range(18))::INT AS action) a
      LEFT JOIN q ON q.event_type = s.event_type AND q.action = a.action)
    SELECT event_type, action AS best_action, round(q, 6) AS q FROM (
      SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY q DESC, action) AS k FROM full_q) WHERE k = 1""",
)
def best_action(spark, sf):
    log = episodes(spark, sf)
    q = policy.q_table(log, ["event_type"], "action", "event_id", "reward")
    seen = log.select("event_type").distinct()
    asked = seen.unionByName(spark.createDataFrame([("unseen",)], "event_type string"))
    return policy.best_action(q, asked, ["event_type"], "action", len(policy.actions())).withColumn("q", r6("q"))


@query(
    "episode_log",
    f"""SELECT event_id AS episode_number, event_type, action, reward, round(greatest(0.01, 0.3 * power(0.98, event_id)), 6) AS epsilon_used FROM {_EPISODES}""",
)
def episode_log(spark, sf):
    out = policy.episode_log(episodes(spark, sf), "event_id", ["event_type"], "action", "reward")
    return out.withColumn("epsilon_used", r6("epsilon_used"))
