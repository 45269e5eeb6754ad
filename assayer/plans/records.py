"""Lineage, hashing and claim checks over the shared tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from assayer.functions import hashing
from assayer.operators import claims
from assayer.plans.registry import query, r6, table
from assayer.sources import lineage

US = "chr(31)"


def sha(text: str) -> str:
    return f"('sha256:' || sha256({text}))"


def keyed(*parts: str) -> str:
    return f"substr(sha256(concat_ws({US}, {', '.join(parts)})), 1, 32)"


# ---- datasets and runs

_PART_HASH = sha("concat_ws('|', p_brand, p_type, p_size)")


def part_hashes(spark, sf) -> DataFrame:
    """Incoming dataset registrations: one per part row, equal for equal (brand, type, size)."""
    part = table(spark, sf, "part")
    return part.select(
        hashing.sha_column(F.concat_ws("|", "p_brand", "p_type", F.col("p_size").cast("string"))).alias("content_hash"),
        F.to_json(F.struct("p_brand", "p_type")).alias("schema_json"),
        F.lit(None).cast("string").alias("reference_dataset_id"),
        "p_size",
    )


@query(
    "register_dataset",
    f"""SELECT DISTINCT {_PART_HASH} AS content_hash, {keyed("'dataset'", _PART_HASH)} AS id, p_size > 25 AS created FROM part""",
)
def register_dataset(spark, sf):
    rows = part_hashes(spark, sf)
    stored = lineage.dataset_rows(rows.where("p_size <= 25")).dropDuplicates(["content_hash"])
    _, answer = lineage.register_dataset(lineage.dataset_rows(rows), stored)
    return answer


_ORDER_CONTENT = sha("concat_ws('|', 'customer', o_custkey)")
_ORDER_CONFIG = sha("concat_ws('|', 'priority', o_orderpriority)")
_ORDER_KEY = sha(f"{_ORDER_CONTENT} || '|' || {_ORDER_CONFIG} || '|' || o_orderstatus")


def run_requests(spark, sf) -> DataFrame:
    orders = table(spark, sf, "orders")
    content = hashing.sha_column(F.concat_ws("|", F.lit("customer"), F.col("o_custkey").cast("string")))
    return orders.select(
        lineage.keyed_id(F.lit("dataset"), content).alias("dataset_id"),
        content.alias("content_hash"),
        hashing.sha_column(F.concat_ws("|", F.lit("priority"), "o_orderpriority")).alias("config_hash"),
        F.col("o_orderstatus").alias("git_sha"),
        "o_orderdate",
    )


@query(
    "get_or_create_run",
    f"""WITH r AS (SELECT {_ORDER_KEY} AS run_key, min(o_orderdate) AS first_seen FROM orders GROUP BY 1)
    SELECT run_key, {keyed("'run'", 'run_key')} AS id, first_seen >= TIMESTAMP '1998-01-01' AS created FROM r""",
)
def get_or_create_run(spark, sf):
    asked = run_requests(spark, sf)
    before = F.lit(dt.datetime(1998, 1, 1)).cast("timestamp_ntz")
    stored = lineage.run_rows(asked.where(F.col("o_orderdate") < before)).dropDuplicates(["run_key"])
    _, answer = lineage.get_or_create_run(lineage.run_rows(asked), stored)
    return answer


@query("run_key", f"SELECT o_orderkey, {_ORDER_KEY} AS run_key FROM orders")
def run_key(spark, sf):
    orders = table(spark, sf, "orders")
    content = hashing.sha_column(F.concat_ws("|", F.lit("customer"), F.col("o_custkey").cast("string")))
    config = hashing.sha_column(F.concat_ws("|", F.lit("priority"), "o_orderpriority"))
    return orders.select("o_orderkey", hashing.run_key(content, config, F.col("o_orderstatus")).alias("run_key"))


# ---- gates, steps, trials, metrics, episodes as records


@query(
    "record_gate_chain",
    f"""SELECT l_orderkey::VARCHAR AS run_id, count(*) AS n_gates,
    CASE WHEN bool_and(l_quantity > 5) THEN 'gate_chain_passed' ELSE 'gate_chain_rejected' END AS action,
    'validation_gates' AS actor, CASE WHEN bool_and(l_quantity > 5) THEN 'gate-check' ELSE 'failed' END AS status,
    {keyed("'audit'", 'l_orderkey', "'validation_gates'")} AS audit_id FROM lineitem GROUP BY l_orderkey""",
)
def record_gate_chain(spark, sf):
    results = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("run_id"),
        F.concat(F.lit("gate_"), "l_linenumber").alias("gate_name"),
        (F.col("l_quantity") > 5).alias("passed"),
        F.when(F.col("l_quantity") <= 5, "small quantity").alias("reason"),
        F.to_json(F.struct("l_quantity")).alias("details"),
    )
    rows = lineage.gate_chain_rows(results)
    counts = rows["gate_evaluations"].groupBy("run_id").agg(F.count("*").alias("n_gates"))
    audit = rows["audit_log"].select("run_id", F.col("id").alias("audit_id"), "actor", "action")
    return counts.join(audit, "run_id").join(rows["run_status"].select("run_id", "status"), "run_id")


STATUS_OF = {"view": "queued", "click": "running", "signup": "gate-check", "purchase": "done", "error": "failed"}
_STATUS = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STATUS_OF.items()) + " END"


@query(
    "current_run_status",
    f"""SELECT user_id AS run_id, arg_max({_STATUS}, (ts, event_id)) AS status, max(ts) AS updated_at FROM events GROUP BY user_id""",
)
def current_run_status(spark, sf):
    mapping = F.create_map(*(F.lit(x) for pair in STATUS_OF.items() for x in pair))
    events = table(spark, sf, "events").select(
        F.col("user_id").alias("run_id"),
        F.element_at(mapping, F.col("event_type")).alias("status"),
        F.col("ts").alias("updated_at"),
        F.col("event_id").alias("seq"),
    )
    return lineage.current_status(events)


def line_steps(line: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    return line.select(
        F.col("l_orderkey").cast("string").alias("run_id"),
        F.col("l_linenumber").alias("step_seq"),
        F.concat(F.lit("step_"), "l_returnflag").alias("step_type"),
        hashing.sha_column(F.col("l_partkey").cast("string")).alias("input_hash"),
        F.when(F.col("l_returnflag") != "N", hashing.sha_column(F.col("l_suppkey").cast("string"))).alias("output_hash"),
        F.concat(F.lit('{"part":'), "l_partkey", F.lit("}")).alias("params_json"),
        F.col("l_suppkey").alias("seed"),
        hashing.sha_column(F.col("l_linestatus")).alias("transform_code_hash"),
        F.concat(F.lit("line "), "l_linenumber").alias("description"),
        *keep,
    )


_STEP = "concat('step_', l_returnflag)"
_STEP_ID = keyed("'step'", "l_orderkey", "l_linenumber", _STEP)
_OUT = f"CASE WHEN l_returnflag <> 'N' THEN {sha('l_suppkey::VARCHAR')} END"


@query(
    "record_run_step",
    f"""SELECT {_STEP_ID} AS id, l_orderkey::VARCHAR AS run_id, l_linenumber AS step_seq, {_STEP} AS step_type,
    {sha('l_partkey::VARCHAR')} AS input_hash, {_OUT} AS output_hash, '{{"part":' || l_partkey || '}}' AS params_json, l_suppkey AS seed FROM lineitem""",
)
def record_run_step(spark, sf):
    return lineage.step_rows(line_steps(table(spark, sf, "lineitem")))["pipeline_steps"].drop("created_at")


@query(
    "record_transformation",
    f"""SELECT {keyed("'transformation'", _STEP_ID)} AS id, {_STEP_ID} AS step_id, {sha('l_linestatus')} AS transform_code_hash,
    'line ' || l_linenumber AS description FROM lineitem""",
)
def record_transformation(spark, sf):
    return lineage.step_rows(line_steps(table(spark, sf, "lineitem")))["transformations"]


@query(
    "record_trials",
    f"""SELECT {keyed("'trial'", 'p_brand', 'p_type', 'p_partkey')} AS id, p_brand AS run_id, p_type AS model_family, p_partkey::INT AS trial_number,
    '{{"size":' || p_size || '}}' AS params_json, p_retailprice AS score FROM part""",
)
def record_trials(spark, sf):
    part = table(spark, sf, "part")
    return lineage.trial_rows(
        part.select(
            F.col("p_brand").alias("run_id"), F.col("p_type").alias("model_family"),
            F.col("p_partkey").cast("int").alias("trial_number"),
            F.to_json(F.struct(F.col("p_size").alias("size"))).alias("params_json"), F.col("p_retailprice").alias("score"),
        )
    )


# ---- metrics and claims

_METRICS = """metrics AS (SELECT 'price_' || l_returnflag || l_linestatus AS name, avg(l_extendedprice) AS value,
  avg(l_extendedprice) - 1.96 * stddev_samp(l_extendedprice) / sqrt(count(*)) AS ci_low,
  avg(l_extendedprice) + 1.96 * stddev_samp(l_extendedprice) / sqrt(count(*)) AS ci_high FROM lineitem GROUP BY l_returnflag, l_linestatus
  UNION ALL SELECT 'discount_' || l_returnflag || l_linestatus, avg(l_discount), NULL, NULL FROM lineitem GROUP BY l_returnflag, l_linestatus
  UNION ALL SELECT 'spread_' || l_returnflag || l_linestatus, avg(l_tax), avg(l_tax) - stddev_samp(l_tax), avg(l_tax) + stddev_samp(l_tax)
  FROM lineitem GROUP BY l_returnflag, l_linestatus
  UNION ALL SELECT 'medium_' || l_returnflag || l_linestatus, avg(l_quantity), avg(l_quantity) * 0.9, avg(l_quantity) * 1.1
  FROM lineitem GROUP BY l_returnflag, l_linestatus)"""


def line_metrics(spark, sf) -> DataFrame:
    line = table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus")
    price = F.col("l_extendedprice")
    low, high = claims.interval_95(F.avg(price), F.stddev_samp(price), F.count("*"))
    tax, spread, size = F.avg("l_tax"), F.stddev_samp("l_tax"), F.avg("l_quantity")
    none = F.lit(None).cast("double")
    kinds = {
        "price_": (F.avg(price), low, high),
        "discount_": (F.avg("l_discount"), none, none),
        "spread_": (tax, tax - spread, tax + spread),
        "medium_": (size, size * 0.9, size * 1.1),
    }
    wide = line.agg(
        *(F.struct(v.alias("value"), a.alias("ci_low"), b.alias("ci_high")).alias(k) for k, (v, a, b) in kinds.items())
    )
    cells = F.array(
        *(F.struct(F.concat(F.lit(k), "l_returnflag", "l_linestatus").alias("name"), F.col(k).alias("m")) for k in kinds)
    )
    return wide.select(F.inline(cells)).select("name", "m.*")


@query(
    "record_metric",
    f"""WITH {_METRICS} SELECT {keyed("'metric'", "'run_1'", 'name')} AS id, 'run_1' AS run_id, name, round(value, 6) AS value,
    round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high FROM metrics""",
)
def record_metric(spark, sf):
    rows = lineage.metric_rows(line_metrics(spark, sf).withColumn("run_id", F.lit("run_1")))
    return rows.select("id", "run_id", "name", *(r6(c).alias(c) for c in ("value", "ci_low", "ci_high")))


@query(
    "record_episode",
    f"""SELECT {keyed("'episode'", 'event_id', 'user_id')} AS id, event_id::INT AS episode_number,
    '{{"event_type":"' || event_type || '"}}' AS state_json, '{{"user_id":' || user_id || '}}' AS action_json, value AS reward,
    user_id::VARCHAR AS run_id FROM events""",
)
def record_episode(spark, sf):
    events = table(spark, sf, "events").select(
        F.col("event_id").alias("episode_number"), "event_type", "user_id", F.col("value").alias("reward"),
        F.col("user_id").cast("string").alias("run_id"),
    )
    return lineage.episode_rows(events, ["event_type"], ["user_id"]).drop("created_at")


@query(
    "replay_run",
    f"""SELECT o_orderkey::VARCHAR AS run_id, o_custkey::VARCHAR AS dataset_id, o_orderstatus AS git_sha, {_ORDER_CONFIG} AS config_hash,
    {_ORDER_KEY} AS run_key, {_STEP_ID} AS step_id, l_linenumber AS step_seq, {_STEP} AS step_type,
    {sha('l_partkey::VARCHAR')} AS input_hash, {_OUT} AS output_hash, '{{"part":' || l_partkey || '}}' AS params_json, l_suppkey AS seed
    FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey""".replace(
        f"{sha('l_partkey::VARCHAR')} AS input_hash", f"CASE WHEN l_orderkey IS NOT NULL THEN {sha('l_partkey::VARCHAR')} END AS input_hash"
    ).replace(f"{_STEP_ID} AS step_id", f"CASE WHEN l_orderkey IS NOT NULL THEN {_STEP_ID} END AS step_id").replace(
        f"{_STEP} AS step_type", f"CASE WHEN l_orderkey IS NOT NULL THEN {_STEP} END AS step_type"
    ),
)
def replay_run(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_partkey", "l_suppkey", "l_linestatus")

    def run_of(df: DataFrame) -> DataFrame:
        content = hashing.sha_column(F.concat_ws("|", F.lit("customer"), F.col("o_custkey").cast("string")))
        config = hashing.sha_column(F.concat_ws("|", F.lit("priority"), "o_orderpriority"))
        return df.withColumns({
            "run_id": F.col("o_orderkey").cast("string"), "dataset_id": F.col("o_custkey").cast("string"),
            "git_sha": F.col("o_orderstatus"), "config_hash": config,
            "run_key": hashing.run_key(content, config, F.col("o_orderstatus")),
        })

    def step_of(df: DataFrame) -> DataFrame:
        rows = lineage.step_rows(line_steps(df, orders.columns), keep=orders.columns)["pipeline_steps"]
        return rows.withColumnRenamed("id", "step_id")

    return lineage.replay(orders, lines, ("o_orderkey", "l_orderkey"), run_of, step_of)


@query(
    "verify_output_hash",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
    coalesce({_OUT} = {sha("CASE WHEN l_linestatus = 'O' THEN l_suppkey ELSE l_partkey END::VARCHAR")}, false) AS verified FROM lineitem""",
)
def verify_output_hash(spark, sf):
    line = table(spark, sf, "lineitem")
    recorded = F.when(F.col("l_returnflag") != "N", hashing.sha_column(F.col("l_suppkey").cast("string")))
    again = F.when(F.col("l_linestatus") == "O", F.col("l_suppkey")).otherwise(F.col("l_partkey"))
    ok = hashing.verify_output_hash(recorded, hashing.sha_column(again.cast("string")))
    return line.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", ok.alias("verified"))


@query(
    "hash_config",
    f"""SELECT p_partkey, {sha("'[\"brand\",\"' || p_brand || '\",\"size\",' || p_size || ',\"type\",\"' || p_type || '\"]'")} AS config_hash FROM part""",
)
def hash_config(spark, sf):
    part = table(spark, sf, "part")
    parts: dict[str, Column] = {"type": F.col("p_type"), "size": F.col("p_size"), "brand": F.col("p_brand")}
    return part.select("p_partkey", hashing.hash_config_columns(parts).alias("config_hash"))


@query("hash_dataframe")
def hash_dataframe(spark, sf):
    names = ("lineitem", "orders", "customer", "documents")
    parts = [hashing.hash_dataframe(table(spark, sf, n)).select(F.lit(n).alias("table"), "n_rows", "content_hash") for n in names]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_STATS = f"""{_METRICS}, stats AS (SELECT *, ci_high - ci_low AS ci_width,
  CASE WHEN value <> 0 THEN abs((ci_high - ci_low) / value) END AS relative_ci_width FROM metrics)"""


@query(
    "metric_stats",
    f"""WITH {_STATS} SELECT name, round(value, 6) AS value, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high,
    round(ci_width, 6) AS ci_width, round(relative_ci_width, 6) AS relative_ci_width FROM stats""",
)
def metric_stats(spark, sf):
    stats = claims.metric_stats(line_metrics(spark, sf))
    return stats.select("name", *(r6(c).alias(c) for c in ("value", "ci_low", "ci_high", "ci_width", "relative_ci_width")))


@query(
    "grounding_facts",
    f"""WITH {_METRICS} SELECT name AS metric_name, CASE WHEN ci_low IS NULL THEN name || ' = ' || printf('%.6g', value) || ' (no confidence interval available)'
    ELSE name || ' = ' || printf('%.6g', value) || ' (95% CI [' || printf('%.6g', ci_low) || ', ' || printf('%.6g', ci_high) || '])' END AS text FROM metrics""",
)
def grounding_facts(spark, sf):
    return claims.grounding_facts(claims.metric_stats(line_metrics(spark, sf)))


KINDS = ["price_", "discount_", "spread_", "medium_", "other_"]
_KIND = "list_extract([" + ", ".join(f"'{k}'" for k in KINDS) + "], (l_linenumber % 5)::INT + 1)"
_CLAIMS = f"""claims AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {_KIND} || l_returnflag || l_linestatus AS metric_name,
  CASE l_linenumber % 5 WHEN 0 THEN 50000 + l_discount * 40000 WHEN 1 THEN 0.05 + (l_discount - 0.05) / 100
    WHEN 2 THEN 0.04 + (l_discount - 0.05) / 50 WHEN 3 THEN 25.5 + (l_discount - 0.05) * 20 ELSE 1.0 END AS stated_value FROM lineitem)"""


def line_claims(spark, sf) -> DataFrame:
    line = table(spark, sf, "lineitem")
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("l_linenumber") % 5 + 1).cast("int"))
    d, which = F.col("l_discount"), F.col("l_linenumber") % 5
    stated = (
        F.when(which == 0, 50000 + d * 40000).when(which == 1, 0.05 + (d - 0.05) / 100)
        .when(which == 2, 0.04 + (d - 0.05) / 50).when(which == 3, 25.5 + (d - 0.05) * 20).otherwise(1.0)
    )
    return line.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.concat(kind, "l_returnflag", "l_linestatus").alias("metric_name"), stated.alias("stated_value"),
    )


_VERIFIED = f"""{_STATS}, {_CLAIMS}, verified AS (SELECT c.*, s.value AS actual_value, s.relative_ci_width,
  s.name IS NOT NULL AND coalesce(abs(stated_value - s.value) <= 0.02 * greatest(abs(s.value), 1e-9), false) AS verified
  FROM claims c LEFT JOIN stats s ON c.metric_name = s.name)"""
_KEYS = "l_orderkey, l_linenumber, l_partkey, l_suppkey, metric_name"


def line_verified(spark, sf, reasons=False) -> DataFrame:
    stats = claims.metric_stats(line_metrics(spark, sf))
    return claims.verify_claims(line_claims(spark, sf), stats, reasons=reasons)


@query("verify_claims", f"WITH {_VERIFIED} SELECT {_KEYS}, round(stated_value, 6) AS stated_value, round(actual_value, 6) AS actual_value, verified FROM verified")
def verify_claims(spark, sf):
    return line_verified(spark, sf).select(
        *_KEYS.split(", "), r6("stated_value").alias("stated_value"), r6("actual_value").alias("actual_value"), "verified"
    )


_SCORED = f"""{_VERIFIED}, scored AS (SELECT *, CASE WHEN relative_ci_width IS NULL THEN 'unknown' WHEN relative_ci_width <= 0.15 THEN 'high'
  WHEN relative_ci_width >= 0.4 THEN 'inconclusive' ELSE 'moderate' END AS confidence_label, 1 / (1 + relative_ci_width) AS confidence_score
  FROM verified WHERE verified)"""


@query("score_confidence", f"WITH {_SCORED} SELECT {_KEYS}, confidence_label, round(confidence_score, 6) AS confidence_score FROM scored")
def score_confidence(spark, sf):
    scored = claims.score_confidence(line_verified(spark, sf))
    return scored.select(*_KEYS.split(", "), "confidence_label", r6("confidence_score").alias("confidence_score"))


@query(
    "emit_or_flag",
    f"""WITH {_SCORED} SELECT {_KEYS}, confidence_label, CASE WHEN confidence_label IN ('high', 'moderate') THEN 'accepted' ELSE 'flagged' END AS bucket
    FROM scored UNION ALL SELECT {_KEYS}, NULL, 'rejected' FROM verified WHERE NOT verified""",
)
def emit_or_flag(spark, sf):
    return claims.emit_or_flag(line_verified(spark, sf)).select(*_KEYS.split(", "), "confidence_label", "bucket")


_CLAIM = """'{"metric_name":"' || p_type || '","stated_value":' || p_retailprice || ',"statement":"' || p_name || '"}'"""
_TEXT = f"""CASE p_partkey % 9 WHEN 0 THEN '[' || {_CLAIM} || ']' WHEN 1 THEN '```json' || chr(10) || '[' || {_CLAIM} || ', ' || {_CLAIM} || ']' || chr(10) || '```'
  WHEN 2 THEN 'Sorry, ' || p_name WHEN 3 THEN {_CLAIM} WHEN 4 THEN '[' || {_CLAIM} || ', {{"metric_name":"x","stated_value":1}}]'
  WHEN 5 THEN '[' || {_CLAIM} || ', {{"metric_name":"x","stated_value":"many","statement":"s"}}]' WHEN 6 THEN '[]'
  WHEN 7 THEN '[' || {_CLAIM} || ', 7]' ELSE '  [{{"metric_name":"' || p_type || '","stated_value":"' || p_size || '","statement":"size"}}]  ' END"""


@query(
    "parse_claims",
    f"""WITH d AS (SELECT p_partkey, {_TEXT} AS t FROM part),
    c AS (SELECT p_partkey, CASE WHEN regexp_full_match(trim(t, ' ' || chr(10)), '(?s)```(?:json)?\\s*(.*?)\\s*```')
      THEN regexp_extract(trim(t, ' ' || chr(10)), '(?s)^```(?:json)?\\s*(.*?)\\s*```$', 1) ELSE trim(t, ' ' || chr(10)) END AS j FROM d),
    v AS (SELECT p_partkey, CASE WHEN json_valid(j) THEN j END AS j FROM c),
    e AS (SELECT p_partkey, i AS "position", json_extract(j, '$[' || i || ']') AS o FROM (
      SELECT p_partkey, j, unnest(range(0, json_array_length(j)::BIGINT))::INT AS i FROM v WHERE json_type(j) = 'ARRAY')),
    f AS (SELECT p_partkey, "position", o, json_type(o) = 'OBJECT' AND json_exists(o, '$.metric_name') AND json_exists(o, '$.stated_value')
      AND json_exists(o, '$.statement') AND try_cast(json_extract_string(o, '$.stated_value') AS DOUBLE) IS NOT NULL AS good FROM e)
    SELECT p_partkey, "position", json_extract_string(o, '$.metric_name') AS metric_name,
      try_cast(json_extract_string(o, '$.stated_value') AS DOUBLE) AS stated_value, json_extract_string(o, '$.statement') AS statement
    FROM f WHERE p_partkey NOT IN (SELECT p_partkey FROM f WHERE NOT good)""",
)
def parse_claims(spark, sf):
    part = table(spark, sf, "part")
    price = F.col("p_retailprice").cast("string")
    claim = F.concat(
        F.lit('{"metric_name":"'), "p_type", F.lit('","stated_value":'), price, F.lit(',"statement":"'), "p_name", F.lit('"}')
    )
    size = F.concat(F.lit('  [{"metric_name":"'), "p_type", F.lit('","stated_value":"'), "p_size", F.lit('","statement":"size"}]  '))
    texts = [
        F.concat(F.lit("["), claim, F.lit("]")),
        F.concat(F.lit("```json\n["), claim, F.lit(", "), claim, F.lit("]\n```")),
        F.concat(F.lit("Sorry, "), "p_name"),
        claim,
        F.concat(F.lit("["), claim, F.lit(', {"metric_name":"x","stated_value":1}]')),
        F.concat(F.lit("["), claim, F.lit(', {"metric_name":"x","stated_value":"many","statement":"s"}]')),
        F.lit("[]"),
        F.concat(F.lit("["), claim, F.lit(", 7]")),
        size,
    ]
    drafts = part.select("p_partkey", F.element_at(F.array(*texts), (F.col("p_partkey") % 9 + 1).cast("int")).alias("response"))
    return claims.drafted_claims(claims.parse_drafts(drafts), ["p_partkey"])
