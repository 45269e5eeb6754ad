"""Gates, profile and encoders over the shared tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from assayer.functions.columns import MIX_MODULUS, mix
from assayer.operators import evaluate, gates, impute, outliers, profile
from assayer.plans.registry import holed_sql, mix_sql, psi_sql, query, r6, table
from assayer.settings import Settings
from assayer.sources import tables

LINEITEM = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
]
ROW_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
HOLES = [("l_quantity", 0.2, 42), ("l_discount", 0.1, 43), ("l_tax", 0.45, 44), ("l_returnflag", 0.05, 45)]
HOLED = holed_sql("lineitem", "l_orderkey * 7 + l_linenumber", HOLES, LINEITEM)


def holed_lineitem(spark, sf) -> DataFrame:
    df = table(spark, sf, "lineitem")
    key = F.col("l_orderkey") * 7 + F.col("l_linenumber")
    masks = {c: evaluate.mcar_mask(key, rate, seed) for c, rate, seed in HOLES}
    return df.select(
        *(F.when(~masks[c], F.col(c)).alias(c) if c in masks else F.col(c) for c in LINEITEM)
    )


EVENTS = ["event_id", "ts", "user_id", "event_type", "value", "props"]
EVENT_HOLES = [("value", 0.15, 7), ("props", 0.3, 8)]
HOLED_EVENTS = holed_sql("events", "event_id", EVENT_HOLES, EVENTS)
MIDDLE = "2024-01-16"


def holed_events(spark, sf) -> DataFrame:
    masks = {c: evaluate.mcar_mask(F.col("event_id"), rate, seed) for c, rate, seed in EVENT_HOLES}
    return table(spark, sf, "events").select(*(F.when(~masks[c], F.col(c)).alias(c) if c in masks else F.col(c) for c in EVENTS))


EARLY = f"(SELECT * FROM events WHERE ts < TIMESTAMP '{MIDDLE}')"
LATE = f"(SELECT * FROM events WHERE ts >= TIMESTAMP '{MIDDLE}')"
SCALED = f"(SELECT event_id, value * 3 + 50 AS value FROM events WHERE ts >= TIMESTAMP '{MIDDLE}')"


def holed_events(spark, sf) -> DataFrame:
    df = table(spark, sf, "events")
    masks = {c: evaluate.mcar_mask(F.col("event_id"), rate, seed) for c, rate, seed in EVENT_HOLES}
    return df.select(*(F.when(~masks[c], F.col(c)).alias(c) if c in masks else F.col(c) for c in EVENTS))


def halves(spark, sf) -> tuple[DataFrame, DataFrame]:
    df = table(spark, sf, "events")
    cut = F.lit(dt.datetime.fromisoformat(MIDDLE)).cast("timestamp_ntz")
    return df.where(F.col("ts") < cut), df.where(F.col("ts") >= cut)


# ---- null rates

_RATES = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(*) AS n_rows, count(*) - count({c}) AS n_missing,
        round((count(*) - count({c})) / count(*), 6) AS null_rate,
        (count(*) - count({c})) / count(*) > 0.4 AS offending FROM holed"""
    for c in LINEITEM
)


@query("null_rate_gate", f"WITH holed AS ({HOLED}) {_RATES}")
def null_rate_gate(spark, sf):
    rates = gates.null_rates(holed_lineitem(spark, sf))
    return rates.withColumn("offending", F.col("null_rate") > 0.4).withColumn("null_rate", r6("null_rate"))


_CELLS = " + ".join(f"(count(*) - count({c}))" for c in LINEITEM)


@query(
    "null_rate_overall",
    f"""WITH holed AS ({HOLED}) SELECT count(*) AS n_rows, {_CELLS} AS n_missing,
    round(({_CELLS}) / (count(*) * {len(LINEITEM)}), 6) AS null_rate FROM holed""",
)
def null_rate_overall(spark, sf):
    return gates.null_rate_overall(holed_lineitem(spark, sf)).withColumn("null_rate", r6("null_rate"))


# ---- schema

CONTRACTS = {
    "as_stored": {
        "o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double",
        "o_orderdate": "timestamp_ntz", "o_orderpriority": "string",
    },
    "changed": {
        "o_orderkey": "string", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double",
        "o_orderdate": "timestamp_ntz", "o_clerk": "string",
    },
}
_TYPE = """CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string'
    WHEN 'DOUBLE' THEN 'double' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE lower(column_type) END"""
_EXPECTED = " UNION ALL ".join(
    f"SELECT '{k}' AS contract, '{c}' AS c, '{t}' AS t" for k, v in CONTRACTS.items() for c, t in v.items()
)
_CONFORM = f"""
WITH want AS ({_EXPECTED}),
got AS (SELECT k.contract, column_name AS c, {_TYPE} AS t
        FROM (DESCRIBE orders) CROSS JOIN (SELECT DISTINCT contract FROM want) k)
SELECT coalesce(w.contract, g.contract) AS contract, coalesce(w.c, g.c) AS "column",
  CASE WHEN g.c IS NULL THEN 'missing' WHEN w.c IS NULL THEN 'extra' WHEN w.t = g.t THEN 'ok' ELSE 'mismatch' END AS status,
  w.t AS expected_type, g.t AS actual_type, (SELECT count(*) FROM orders) AS n_rows
FROM want w FULL JOIN got g ON w.contract = g.contract AND w.c = g.c"""


@query("schema_gate", _CONFORM)
def schema_gate(spark, sf):
    orders = table(spark, sf, "orders")
    rows = [(k, *d) for k, want in CONTRACTS.items() for d in gates.schema_diff(orders, want)]
    diff = spark.createDataFrame(
        rows, "contract string, column string, status string, expected_type string, actual_type string"
    )
    return diff.crossJoin(F.broadcast(orders.agg(F.count("*").alias("n_rows"))))  # one row


# ---- drift


@query(
    "psi",
    f"""SELECT 'later' AS comparison, "column", round(psi, 6) AS psi FROM ({psi_sql(EARLY, LATE, ['value'])})
    UNION ALL SELECT 'scaled', "column", round(psi, 6) FROM ({psi_sql(EARLY, SCALED, ['value'])})""",
)
def psi(spark, sf):
    early, late = halves(spark, sf)
    scaled = late.withColumn("value", F.col("value") * 3 + 50)
    edges = gates.reference_edges(early, ["value"], 10)
    shares = gates.stability_shares(early, edges)
    rows = [
        (name, c, v)
        for name, df in (("later", late), ("scaled", scaled))
        for c, v in gates.psi_against(df, edges, shares).items()
    ]
    out = spark.createDataFrame(rows, "comparison string, column string, psi double")
    return out.withColumn("psi", r6("psi"))


def _ks_sql(name: str, ref: str, cur: str) -> str:
    return f"""SELECT '{name}' AS comparison, max(nr)::BIGINT AS n_reference, max(nc)::BIGINT AS n_current,
      round(max(abs(fr / nr - fc / nc)), 6) AS ks_d,
      round(least(1, greatest(0, 2 * list_sum(list_transform(range(1, 101), lambda k: (2 * (k % 2) - 1)
        * exp(-2 * k * k * max(nr) * max(nc) / (max(nr) + max(nc)) * max(abs(fr / nr - fc / nc)) ** 2))))), 6) AS ks_p_value FROM (
      SELECT sum(r) OVER w AS fr, sum(c) OVER w AS fc, sum(r) OVER () AS nr, sum(c) OVER () AS nc FROM (
        SELECT v, sum(r) AS r, sum(c) AS c FROM (
          SELECT value AS v, 1 AS r, 0 AS c FROM {ref} UNION ALL SELECT value, 0, 1 FROM {cur}) GROUP BY v)
      WINDOW w AS (ORDER BY v))"""


@query("ks_two_sample", f"{_ks_sql('later', EARLY, LATE)} UNION ALL {_ks_sql('scaled', EARLY, SCALED)}")
def ks_two_sample(spark, sf):
    early, late = halves(spark, sf)
    scaled = late.withColumn("value", F.col("value") * 3 + 50)
    parts = [
        gates.ks_statistics(df, early, ["value"]).select(
            F.lit(name).alias("comparison"), "n_reference", "n_current", r6("ks_d").alias("ks_d"), r6("ks_p_value").alias("ks_p_value")
        )
        for name, df in (("later", late), ("scaled", scaled))
    ]
    return parts[0].unionByName(parts[1])


SHIP_CUT = "1999-01-01"
DRIFT_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_OLD = f"(SELECT * FROM lineitem WHERE l_shipdate < TIMESTAMP '{SHIP_CUT}')"
_NEW = (
    "(SELECT l_quantity * 1.5 AS l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem "
    f"WHERE l_shipdate >= TIMESTAMP '{SHIP_CUT}')"
)


def ship_halves(spark, sf):
    df = table(spark, sf, "lineitem").select("l_shipdate", *DRIFT_COLUMNS)
    cut = F.lit(dt.datetime.fromisoformat(SHIP_CUT)).cast("timestamp_ntz")
    old = df.where(F.col("l_shipdate") < cut).select(*DRIFT_COLUMNS)
    new = df.where(F.col("l_shipdate") >= cut).select(*DRIFT_COLUMNS)
    return old, new.withColumn("l_quantity", F.col("l_quantity") * 1.5)


_DRIFT = psi_sql(_OLD, _NEW, DRIFT_COLUMNS)


@query("drift_gate", f'SELECT "column", round(psi, 6) AS psi, psi > 0.25 AS drifted FROM ({_DRIFT})')
def drift_gate(spark, sf):
    old, new = ship_halves(spark, sf)
    result = gates.DriftGate().evaluate(new, reference=old)
    drifted = set(result.details.get("drifted_columns", []))
    rows = [(c, s["psi"], c in drifted) for c, s in result.details["per_column"].items()]
    return spark.createDataFrame(rows, "column string, psi double, drifted boolean").withColumn("psi", r6("psi"))


_LINE_CONTRACT = {
    "l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int",
    "l_quantity": "double", "l_extendedprice": "double", "l_discount": "double", "l_tax": "double",
    "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "timestamp_ntz",
}
_LINE_WANT = " UNION ALL ".join(f"SELECT '{c}' AS c, '{t}' AS t" for c, t in _LINE_CONTRACT.items())
_LINE_NEW = f"(SELECT * FROM holed WHERE l_shipdate >= TIMESTAMP '{SHIP_CUT}')"
_LINE_NUM = [c for c, t in _LINE_CONTRACT.items() if t in ("bigint", "int", "double")]
_CHAIN = f"""
WITH holed AS ({HOLED}), rates AS ({_RATES}), want AS ({_LINE_WANT}),
got AS (SELECT column_name AS c, {_TYPE} AS t FROM (DESCRIBE lineitem)),
drift AS ({psi_sql(_OLD, _LINE_NEW, _LINE_NUM)}),
chain AS (
  SELECT 'max_null_rate_gate' AS gate_name, NOT bool_or(offending) AS passed FROM rates
  UNION ALL SELECT 'schema_conformance_gate',
    NOT EXISTS (SELECT 1 FROM want FULL JOIN got USING (c) WHERE want.t IS DISTINCT FROM got.t)
  UNION ALL SELECT 'drift_gate', NOT bool_or(psi > 0.25) FROM drift)
"""


def line_chain(spark, sf):
    df = holed_lineitem(spark, sf)
    plain = table(spark, sf, "lineitem")
    cut = F.lit(dt.datetime.fromisoformat(SHIP_CUT)).cast("timestamp_ntz")
    null, schema, drift = gates.build_gates(Settings())
    whole = gates.run_gates([null, schema], df, expected_schema=_LINE_CONTRACT)
    late = gates.run_gates(
        [drift], df.where(F.col("l_shipdate") >= cut), reference=plain.where(F.col("l_shipdate") < cut)
    )
    return gates.ChainResult(whole.results + late.results)


@query("run_gates", _CHAIN + "SELECT gate_name, passed, (SELECT bool_and(passed) FROM chain) AS chain_passed FROM chain")
def run_gates(spark, sf):
    chain = line_chain(spark, sf)
    return chain.as_df(spark).select("gate_name", "passed", F.lit(chain.passed).alias("chain_passed"))


@query("gate_failures", _CHAIN + "SELECT gate_name, passed FROM chain WHERE NOT passed")
def gate_failures(spark, sf):
    return gates.gate_failures(line_chain(spark, sf).as_df(spark)).select("gate_name", "passed")


# ---- profile

_EVENT_CELLS = ["event_id", "ts", "user_id", "value", "props"]
_EVENT_GONE = " + ".join(f"(count(*) - count({c}))" for c in _EVENT_CELLS)


@query(
    "missingness_rate",
    f"""WITH holed AS ({HOLED_EVENTS}) SELECT event_type,
    round(({_EVENT_GONE}) / (count(*) * {len(_EVENT_CELLS)}), 6) AS missingness_rate FROM holed GROUP BY event_type""",
)
def missingness_rate(spark, sf):
    out = profile.missingness_rate(holed_events(spark, sf), ["event_type"])
    return out.withColumn("missingness_rate", r6("missingness_rate"))


_EVENT_SKEW = "(abs(skewness(event_id)) + abs(skewness(user_id)) + abs(skewness(value))) / 3"


@query(
    "mean_abs_skew",
    f"""WITH holed AS ({HOLED_EVENTS}) SELECT event_type, round({_EVENT_SKEW}, 6) AS mean_abs_skew
    FROM holed GROUP BY event_type""",
)
def mean_abs_skew(spark, sf):
    out = profile.mean_abs_skew(holed_events(spark, sf), ["event_type"])
    return out.withColumn("mean_abs_skew", r6("mean_abs_skew"))


_EVENT_CARD = "(count(DISTINCT ts) / count(*) + count(DISTINCT props) / count(*)) / 2"


@query(
    "mean_cardinality_ratio",
    f"""WITH holed AS ({HOLED_EVENTS}) SELECT event_type, round({_EVENT_CARD}, 6) AS mean_cardinality_ratio
    FROM holed GROUP BY event_type""",
)
def mean_cardinality_ratio(spark, sf):
    out = profile.mean_cardinality_ratio(holed_events(spark, sf), ["event_type"])
    return out.withColumn("mean_cardinality_ratio", r6("mean_cardinality_ratio"))


@query(
    "class_imbalance_ratio",
    """SELECT 'toxic' AS target, round(max(n) / min(n), 6) AS class_imbalance_ratio
    FROM (SELECT toxic, count(*) AS n FROM labels GROUP BY toxic)
    UNION ALL SELECT 'quality', round(max(n) / min(n), 6) FROM (SELECT quality, count(*) AS n FROM labels GROUP BY quality)""",
)
def class_imbalance_ratio(spark, sf):
    labels = table(spark, sf, "labels")
    parts = [
        profile.class_imbalance_ratio(labels, y).select(
            F.lit(y).alias("target"), r6("class_imbalance_ratio").alias("class_imbalance_ratio")
        )
        for y in ("toxic", "quality")
    ]
    return parts[0].unionByName(parts[1])


_EVENT_NUM = ["event_id", "user_id", "value"]


@query(
    "drift_score",
    f"SELECT (SELECT count(*) FROM {LATE}) AS n_rows, round(avg(psi), 6) AS drift_score FROM ({psi_sql(EARLY, LATE, _EVENT_NUM)})",
)
def drift_score(spark, sf):
    early, late = halves(spark, sf)
    return late.agg(F.count("*").alias("n_rows")).withColumn(
        "drift_score", r6(F.lit(profile.drift_score(late, early)))
    )


_ORDERS_OLD = "(SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01')"
_META = f"""
WITH base AS (SELECT o_orderpriority AS g, o_orderkey, o_custkey, o_totalprice, o_orderdate, o_orderstatus FROM orders),
p AS (SELECT g, 0.0 AS missingness_rate,
  (abs(skewness(o_orderkey)) + abs(skewness(o_custkey)) + abs(skewness(o_totalprice))) / 3 AS mean_abs_skew,
  count(DISTINCT o_orderdate) / count(*) AS mean_cardinality_ratio FROM base GROUP BY g),
c AS (SELECT g, max(n) / min(n) AS class_imbalance_ratio FROM
  (SELECT g, o_orderstatus, count(*) AS n FROM base GROUP BY g, o_orderstatus) GROUP BY g),
d AS (SELECT avg(psi) AS drift_score FROM ({psi_sql(_ORDERS_OLD, 'orders', ['o_orderkey', 'o_custkey', 'o_totalprice'])}))
"""


def orders_profile(spark, sf):
    orders = table(spark, sf, "orders")
    cut = F.lit(dt.datetime(1998, 1, 1)).cast("timestamp_ntz")
    old = orders.where(F.col("o_orderdate") < cut)
    return profile.meta_features(orders, "o_orderstatus", ["o_orderpriority"], old)


@query(
    "meta_features",
    _META + """SELECT g AS o_orderpriority, round(missingness_rate, 6) AS missingness_rate,
    round(mean_abs_skew, 6) AS mean_abs_skew, round(mean_cardinality_ratio, 6) AS mean_cardinality_ratio,
    round(class_imbalance_ratio, 6) AS class_imbalance_ratio, round(drift_score, 6) AS drift_score
    FROM p JOIN c USING (g), d""",
)
def meta_features(spark, sf):
    out = orders_profile(spark, sf)
    return out.select("o_orderpriority", *(r6(c).alias(c) for c in profile.STATE_EDGES))


def _bin(c: str) -> str:
    return " + ".join(f"({c} >= {e})::INT" for e in profile.STATE_EDGES[c])


@query(
    "state_bins",
    _META + "SELECT g AS o_orderpriority, "
    + ", ".join(f"{_bin(c)} AS {c}_bin" for c in profile.STATE_EDGES)
    + " FROM p JOIN c USING (g), d",
)
def state_bins(spark, sf):
    return profile.state_bins(orders_profile(spark, sf))


def _task(c: str, numeric: bool) -> str:
    rule = (
        f"CASE WHEN count(DISTINCT {c}) <= 20 OR count(DISTINCT {c}) / count(*) <= 0.05 THEN 'classification' ELSE 'regression' END"
        if numeric
        else "'classification'"
    )
    return f"""SELECT '{c}' AS "column", count(*) AS n_rows, count(DISTINCT {c}) AS n_distinct, {rule} AS task FROM part"""


@query("infer_task_type", " UNION ALL ".join([_task("p_size", True), _task("p_retailprice", True), _task("p_brand", False)]))
def infer_task_type(spark, sf):
    return profile.infer_task_type(table(spark, sf, "part"), ["p_size", "p_retailprice", "p_brand"])


# ---- sources, projections, encoders


@query("load_dataset", "SELECT doc_id::DOUBLE AS doc_id, quality::DOUBLE AS quality, toxic::DOUBLE AS toxic, 'classification' AS task FROM labels")
def load_dataset(spark, sf):
    data = tables.load_dataset(spark, f"{sf.rstrip('/')}/labels.parquet")
    return data.df.withColumn("task", F.lit(data.task))


@query(
    "na_values_scan",
    f"""SELECT o_orderkey, CASE WHEN {mix_sql('o_orderkey', 3)} < {MIX_MODULUS // 10} THEN NULL ELSE o_totalprice END AS o_totalprice,
    CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN NULL ELSE o_orderpriority END AS o_orderpriority FROM orders""",
)
def na_values_scan(spark, sf):
    orders = table(spark, sf, "orders")
    text = F.when(mix(F.col("o_orderkey"), 3) < MIX_MODULUS // 10, "?").otherwise(F.col("o_totalprice").cast("string"))
    raw = orders.select("o_orderkey", text.alias("o_totalprice"), "o_orderpriority")
    return tables.with_null_tokens(raw, ["?", "4-NOT SPECIFIED"])


_PART_HOLES = [("p_size", 0.1, 5), ("p_type", 0.1, 6), ("p_retailprice", 0.05, 9)]
_PART = holed_sql("part", "p_partkey", _PART_HOLES, ["p_partkey", "p_size", "p_type", "p_retailprice"])
_TYPES = ["LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


def holed_part(spark, sf, holed: Sequence[str] = ("p_size", "p_type", "p_retailprice")):
    part = table(spark, sf, "part").select("p_partkey", "p_size", "p_type", "p_retailprice")
    masks = {c: evaluate.mcar_mask(F.col("p_partkey"), rate, seed) for c, rate, seed in _PART_HOLES if c in holed}
    return part.select(*(F.when(~masks[c], F.col(c)).alias(c) if c in masks else F.col(c) for c in part.columns))


@query(
    "auto_preprocess",
    f"""WITH kept AS (SELECT * FROM ({_PART}) WHERE p_retailprice IS NOT NULL),
    m AS (SELECT avg(p_size) AS size FROM kept),
    t AS (SELECT p_type AS top FROM kept WHERE p_type IS NOT NULL GROUP BY p_type ORDER BY count(*) DESC, p_type LIMIT 1)
    SELECT p_partkey, round(coalesce(p_size, m.size), 6) AS p_size, """
    + ", ".join(f"(coalesce(p_type, t.top) = '{x}')::INT::DOUBLE AS \"p_type_{x}\"" for x in _TYPES)
    + f""", p_retailprice, (SELECT count(*) FROM ({_PART}) WHERE p_retailprice IS NULL) AS n_dropped FROM kept, m, t""",
)
def auto_preprocess(spark, sf):
    data = tables.auto_preprocess(holed_part(spark, sf), "p_retailprice", id_column="p_partkey")
    out = data.df.withColumn("p_size", r6("p_size"))
    return out.withColumn("n_dropped", F.lit(data.report["rows_dropped_missing_target"]).cast("bigint"))


@query("feature_target_split", "SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate, o_orderpriority FROM orders")
def feature_target_split(spark, sf):
    orders = table(spark, sf, "orders")
    features, _ = tables.split_target(orders, "o_orderstatus")
    return orders.select(*features)


@query(
    "drop_missing_target",
    f"""SELECT * , (SELECT count(*) FROM ({_PART}) WHERE p_retailprice IS NULL) AS n_dropped
    FROM ({_PART}) WHERE p_retailprice IS NOT NULL""",
)
def drop_missing_target(spark, sf):
    df = holed_part(spark, sf)
    dropped = df.agg(F.count_if(F.col("p_retailprice").isNull()).alias("n_dropped"))
    return tables.drop_missing_target(df, "p_retailprice").crossJoin(F.broadcast(dropped))  # one row


@query(
    "encode_label",
    f"""WITH o AS ({holed_sql('orders', 'o_orderkey', [('o_orderpriority', 0.05, 11)], ['o_orderkey', 'o_orderpriority'])}),
    l AS (SELECT o_orderpriority, row_number() OVER (ORDER BY o_orderpriority) - 1 AS code
          FROM (SELECT DISTINCT o_orderpriority FROM o WHERE o_orderpriority IS NOT NULL))
    SELECT o_orderkey, o.o_orderpriority, coalesce(code, -1)::INT AS code FROM o LEFT JOIN l USING (o_orderpriority)""",
)
def encode_label(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    gone = evaluate.mcar_mask(F.col("o_orderkey"), 0.05, 11)
    orders = orders.withColumn("o_orderpriority", F.when(~gone, F.col("o_orderpriority")))
    return tables.encode_label(orders, "o_orderpriority", "code")


_SEGMENTS = ["BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query(
    "one_hot_drop_first",
    "SELECT c_custkey, c_acctbal, "
    + ", ".join(f"(c_mktsegment = '{s}')::INT AS \"c_mktsegment_{s}\"" for s in _SEGMENTS)
    + " FROM customer",
)
def one_hot_drop_first(spark, sf):
    customer = table(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    return tables.one_hot_drop_first(customer, ["c_mktsegment"])


@query("apply_feature_mask", "SELECT l_orderkey, l_linenumber, l_quantity, 0.0::DOUBLE AS l_discount, l_tax, 0.0::DOUBLE AS l_extendedprice FROM lineitem")
def apply_feature_mask(spark, sf):
    from assayer.operators.adapt import apply_feature_mask as masked

    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_extendedprice")
    return masked(df, ["l_quantity", "l_discount", "l_tax", "l_extendedprice"], [True, False, True, False])


# ---- imputation


@query(
    "impute_mode",
    f"""WITH holed AS ({HOLED}), t AS (SELECT l_returnflag AS top FROM holed WHERE l_returnflag IS NOT NULL
      GROUP BY 1 ORDER BY count(*) DESC, l_returnflag LIMIT 1)
    SELECT {', '.join(ROW_KEY)}, coalesce(l_returnflag, top) AS l_returnflag FROM holed, t""",
)
def impute_mode(spark, sf):
    return impute.impute_mode(holed_lineitem(spark, sf), ["l_returnflag"]).select(*ROW_KEY, "l_returnflag")


@query(
    "impute_mean_mode_baseline",
    f"""WITH holed AS ({HOLED}), t AS (SELECT l_returnflag AS top FROM holed WHERE l_returnflag IS NOT NULL
      GROUP BY 1 ORDER BY count(*) DESC, l_returnflag LIMIT 1),
    m AS (SELECT avg(l_quantity) AS q, avg(l_discount) AS d, avg(l_tax) AS x FROM holed)
    SELECT {', '.join(ROW_KEY)}, round(coalesce(l_quantity, q), 6) AS l_quantity, round(coalesce(l_discount, d), 6) AS l_discount,
    round(coalesce(l_tax, x), 6) AS l_tax, coalesce(l_returnflag, top) AS l_returnflag FROM holed, t, m""",
)
def impute_mean_mode_baseline(spark, sf):
    df = holed_lineitem(spark, sf)
    filled = impute.impute_mean_mode(df, ["l_quantity", "l_discount", "l_tax", "l_returnflag"])
    return filled.select(
        *ROW_KEY, r6("l_quantity").alias("l_quantity"), r6("l_discount").alias("l_discount"), r6("l_tax").alias("l_tax"), "l_returnflag"
    )


_BEFORE = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(*) - count({c}) AS missing_before, 0::BIGINT AS missing_after,
    count(*) > count({c}) AS imputed FROM holed"""
    for c in LINEITEM
)


@query("imputation_diagnostics", f"WITH holed AS ({HOLED}) {_BEFORE}")
def imputation_diagnostics(spark, sf):
    df = holed_lineitem(spark, sf)
    return impute.imputation_diagnostics(df, impute.impute_mean_mode(df))


@query("impute_mice")
def impute_mice(spark, sf):
    df = holed_lineitem(spark, sf).select("l_orderkey", "l_linenumber", *DRIFT_COLUMNS)
    return impute.impute_mice(df, DRIFT_COLUMNS).df


_ONE = holed_sql("lineitem", "l_orderkey * 7 + l_linenumber", [("l_extendedprice", 0.2, 42)], ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"])


@query(
    "impute_mice_one_column",
    f"""WITH RECURSIVE h AS ({_ONE}),
    m AS (SELECT count(*)::DOUBLE AS n, avg(l_quantity) AS mx, avg(l_extendedprice) AS my, regr_sxx(l_extendedprice, l_quantity) AS xx,
          regr_sxy(l_extendedprice, l_quantity) AS xy, regr_syy(l_extendedprice, l_quantity) AS yy FROM h WHERE l_extendedprice IS NOT NULL),
    it AS (
      SELECT 0 AS k, 1 / (yy / n + 2.220446049250313e-16) AS a, 1.0::DOUBLE AS w, NULL::DOUBLE AS b, false AS done FROM m
      UNION ALL
      SELECT k + 1, (n - used + 2e-6) / (yy - 2 * nb * xy + nb * nb * xx + 2e-6), (used + 2e-6) / (nb * nb + 2e-6), nb,
        coalesce(abs(b - nb) < 1e-3, false)
      FROM (SELECT it.*, m.*, xy / (xx + w / a) AS nb, a * xx / (w + a * xx) AS used FROM it, m WHERE NOT done AND k < 300)),
    f AS (SELECT xy / (xx + w / a) AS s, my - mx * (xy / (xx + w / a)) AS i FROM it, m WHERE k = (SELECT max(k) FROM it))
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, round(coalesce(l_extendedprice, i + s * l_quantity), 2) AS l_extendedprice FROM h, f""",
)
def impute_mice_one_column(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    gone = evaluate.mcar_mask(F.col("l_orderkey") * 7 + F.col("l_linenumber"), 0.2, 42)
    df = df.withColumn("l_extendedprice", F.when(~gone, F.col("l_extendedprice")))
    filled = impute.impute_mice(df, ["l_quantity", "l_extendedprice"]).df
    return filled.withColumn("l_extendedprice", r6("l_extendedprice", 2))


_CUST_HOLES = [("c_acctbal", 0.2, 21), ("c_nationkey", 0.1, 22), ("c_mktsegment", 0.1, 23)]
_CUST_COLS = ["c_custkey", "c_acctbal", "c_nationkey", "c_mktsegment"]
_CUST = holed_sql("customer", "c_custkey", _CUST_HOLES, _CUST_COLS)


def holed_customer(spark, sf):
    df = table(spark, sf, "customer").select(*_CUST_COLS)
    masks = {c: evaluate.mcar_mask(F.col("c_custkey"), rate, seed) for c, rate, seed in _CUST_HOLES}
    out = df.select(*(F.when(~masks[c], F.col(c)).alias(c) if c in masks else F.col(c) for c in df.columns))
    return out.withColumn("rank", (F.col("c_custkey") * 37 % 1000).cast("double"))


def _knn(column: str) -> str:
    both = {c: f"(r.{c} IS NOT NULL AND d.{c} IS NOT NULL)::INT" for c in ("a", "n", "x")}
    shared = " + ".join(both.values())
    total = " + ".join(f"coalesce((r.{c} - d.{c}) * (r.{c} - d.{c}), 0.0)" for c in both)
    return f"""SELECT id, avg(v) AS v FROM (
      SELECT r.id, d.{column} AS v, row_number() OVER (PARTITION BY r.id ORDER BY sqrt(({total}) * (3.0::DOUBLE / ({shared}))), d.id) AS k
      FROM base r JOIN base d ON r.{column} IS NULL AND d.{column} IS NOT NULL WHERE ({shared}) > 0) WHERE k <= 5 GROUP BY id"""


_KNN = f"""WITH base AS (SELECT c_custkey AS id, c_acctbal AS a, c_nationkey::DOUBLE AS n, (c_custkey * 37 % 1000)::DOUBLE AS x, c_mktsegment AS s
    FROM ({_CUST})), ka AS ({_knn('a')}), kn AS ({_knn('n')})"""


@query(
    "impute_knn",
    _KNN + """SELECT b.id AS c_custkey, round(coalesce(b.a, ka.v, (SELECT avg(a) FROM base)), 6) AS c_acctbal,
    round(coalesce(b.n, kn.v, (SELECT avg(n) FROM base)), 6) AS c_nationkey, b.x AS "rank"
    FROM base b LEFT JOIN ka USING (id) LEFT JOIN kn USING (id)""",
)
def impute_knn(spark, sf):
    df = holed_customer(spark, sf).drop("c_mktsegment")
    filled = impute.impute_knn(df, "c_custkey", ["c_acctbal", "c_nationkey", "rank"]).df
    return filled.withColumn("c_acctbal", r6("c_acctbal")).withColumn("c_nationkey", r6("c_nationkey"))


@query(
    "impute",
    _KNN + """, t AS (SELECT s AS top FROM base WHERE s IS NOT NULL GROUP BY s ORDER BY count(*) DESC, s LIMIT 1)
    SELECT b.id AS c_custkey, round(coalesce(b.a, ka.v, (SELECT avg(a) FROM base)), 6) AS c_acctbal,
    round(coalesce(b.n, kn.v, (SELECT avg(n) FROM base)), 6) AS c_nationkey, b.x AS "rank", coalesce(s, top) AS c_mktsegment
    FROM base b LEFT JOIN ka USING (id) LEFT JOIN kn USING (id), t""",
)
def impute_all(spark, sf):
    from assayer.settings import ImputeSettings

    done = impute.impute(holed_customer(spark, sf), ImputeSettings(method="knn"), id_column="c_custkey")
    return done.df.withColumn("c_acctbal", r6("c_acctbal")).withColumn("c_nationkey", r6("c_nationkey"))


# ---- outliers


@query("outliers_none", "SELECT event_id, value, 0.0::DOUBLE AS _anomaly_score, false AS _is_outlier FROM events")
def outliers_none(spark, sf):
    return outliers.outliers_none(table(spark, sf, "events").select("event_id", "value"))


@query(
    "contamination_cut",
    """SELECT event_id, value, value > (SELECT quantile_cont(value, 0.95) FROM events) AS _is_outlier, value AS _anomaly_score FROM events""",
)
def contamination_cut(spark, sf):
    return outliers.contamination_cut(table(spark, sf, "events").select("event_id", "value"), "value", 0.05)


_FENCE = """WITH q AS (SELECT quantile_cont(l_extendedprice, 0.25) AS a1, quantile_cont(l_extendedprice, 0.75) AS a3,
    quantile_cont(l_quantity, 0.25) AS b1, quantile_cont(l_quantity, 0.75) AS b3 FROM lineitem),
    f AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity,
      l_extendedprice < a1 - 0.5 * (a3 - a1) OR l_extendedprice > a3 + 0.5 * (a3 - a1)
      OR l_quantity < b1 - 0.5 * (b3 - b1) OR l_quantity > b3 + 0.5 * (b3 - b1) AS _is_outlier FROM lineitem, q)"""
_FENCED = ["l_extendedprice", "l_quantity"]


@query("iqr_flags", _FENCE + "SELECT * FROM f")
def iqr_flags(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *_FENCED)
    return df.withColumn(outliers.FLAG, outliers.iqr_flag(df, _FENCED, 0.5))


@query("iqr_false_positive_rate", _FENCE + "SELECT round(avg(_is_outlier::INT), 6) AS false_positive_rate FROM f")
def iqr_false_positive_rate(spark, sf):
    df = table(spark, sf, "lineitem").select(*_FENCED)
    return outliers.iqr_false_positive_rate(df, _FENCED, 0.5).withColumn("false_positive_rate", r6("false_positive_rate"))


@query("drop_flagged_rows", _FENCE + """, c AS (SELECT count(*) AS n, count(*) FILTER (WHERE NOT _is_outlier) AS k FROM f)
    SELECT f.* FROM f, c WHERE NOT _is_outlier OR k < greatest(10, n // 2)""")
def drop_flagged_rows(spark, sf):
    return outliers.drop_flagged(iqr_flags(spark, sf))


@query("isolation_forest")
def isolation_forest(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *DRIFT_COLUMNS)
    return outliers.isolation_forest(df, DRIFT_COLUMNS, seed=42)


@query(
    "lof",
    """WITH nb AS (SELECT * FROM (SELECT r.c_custkey AS i, d.c_custkey AS j,
        sqrt((r.c_acctbal - d.c_acctbal) * (r.c_acctbal - d.c_acctbal) + (r.c_nationkey - d.c_nationkey)::DOUBLE * (r.c_nationkey - d.c_nationkey)) AS dist,
        row_number() OVER (PARTITION BY r.c_custkey ORDER BY dist, d.c_custkey) AS k
      FROM customer r JOIN customer d ON r.c_custkey <> d.c_custkey) WHERE k <= 20),
    kd AS (SELECT i, max(dist) AS kdist FROM nb GROUP BY i),
    lrd AS (SELECT nb.i, 1.0 / (avg(greatest(nb.dist, kd.kdist)) + 1e-10) AS lrd FROM nb JOIN kd ON kd.i = nb.j GROUP BY nb.i),
    s AS (SELECT nb.i, avg(b.lrd) / max(a.lrd) AS score FROM nb JOIN lrd b ON b.i = nb.j JOIN lrd a ON a.i = nb.i GROUP BY nb.i)
    SELECT i AS c_custkey, round(score, 6) AS _anomaly_score, score > (SELECT quantile_cont(score, 0.95) FROM s) AS _is_outlier FROM s""",
)
def lof(spark, sf):
    from assayer.settings import OutlierSettings

    df = table(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_nationkey")
    out = outliers.detect_outliers(df, OutlierSettings(method="lof"), id_column="c_custkey").df
    return out.select("c_custkey", r6(outliers.SCORE).alias(outliers.SCORE), outliers.FLAG)


# ---- folds


@query(
    "fold_assign",
    f"""SELECT o_orderkey, o_orderstatus, ((row_number() OVER (PARTITION BY o_orderstatus
    ORDER BY {mix_sql('o_orderkey', 42)}, o_orderkey) - 1) % 5)::INT AS fold FROM orders""",
)
def fold_assign(spark, sf):
    from assayer.operators.modelling import fold_assign as folds

    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return folds(orders, F.col("o_orderkey"), 5, 42, "o_orderstatus")


