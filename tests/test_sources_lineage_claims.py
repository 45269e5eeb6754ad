import hashlib
import itertools
import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Row, functions as F

from assayer import plans
from assayer.functions.hashing import sha_text
from assayer.operators import claims
from assayer.plans.flagship import prepare
from assayer.settings import ClaimSettings, Settings
from assayer.sources import lineage, tables


def write_csv(tmp_path, text, name="data.csv"):
    path = tmp_path / name
    path.write_text(text)
    return str(path)


# ---- sources


def test_load_defaults_to_last_column(spark, tmp_path):
    path = write_csv(tmp_path, "a,b,y\n1,2.5,x\n3,4.5,z\n5,6.5,x\n")
    data = tables.load_dataset(spark, path)
    assert (data.target, data.features, data.task) == ("y", ["a", "b"], "classification")
    assert sorted(r["y"] for r in data.df.collect()) == [0.0, 0.0, 1.0]
    other = tables.load_dataset(spark, write_csv(tmp_path, "a,y\n1,2\n", "U.CSV"), target="a")
    assert other.features == ["y"]


def test_load_refusals(spark, tmp_path):
    with pytest.raises(ValueError, match="known: .csv"):
        tables.load_dataset(spark, str(tmp_path / "x.xlsx"))
    with pytest.raises(ValueError, match="no rows"):
        tables.load_dataset(spark, write_csv(tmp_path, "a,b\n"))
    with pytest.raises(ValueError, match="'zz'"):
        tables.load_dataset(spark, write_csv(tmp_path, "a,b\n1,2\n"), target="zz")
    with pytest.raises(ValueError, match="'a'"):
        tables.load_dataset(spark, write_csv(tmp_path, "a,b\nq,2\n"))
    with pytest.raises(ValueError, match="missing"):
        tables.load_dataset(spark, write_csv(tmp_path, "a,b\n1,2\n,3\n"))


def test_missing_label_is_minus_one(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("c",)], "y string")
    assert [r["k"] for r in tables.encode_label(df, "y", "k").collect()] == [1, 0, -1, 2]


def test_null_tokens_make_a_numeric_column(spark):
    df = spark.createDataFrame([("1.5", "?"), ("?", "w"), (" 3", "-")], "a string, b string")
    got = tables.with_null_tokens(df, ["?", "-"])
    assert got.schema["a"].dataType.simpleString() == "double"
    assert [tuple(r) for r in got.collect()] == [(1.5, None), (None, "w"), (3.0, None)]


def test_preprocess_drops_targets_and_reports(spark):
    rows = [(float(i) if i % 4 else None, "ab"[i % 2], i % 2 if i > 1 else None) for i in range(20)]
    df = spark.createDataFrame(rows, "f1 double, cat string, target int")
    data = tables.auto_preprocess(df, "target")
    assert data.df.count() == 18 and data.features == ["f1", "cat_b"] and data.task == "classification"
    assert data.report["rows_dropped_missing_target"] == 2
    assert data.report["feature_columns_imputed"] == ["f1"]
    assert data.report["feature_columns_one_hot_encoded"] == ["cat"]


def test_target_never_predicts_a_feature(spark):
    """The fill of a feature stays the same whatever the target holds."""
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"f1": rng.normal(size=60), "f2": rng.normal(size=60)})
    pdf.loc[::5, "f1"] = np.nan
    fills = []
    for target in (pdf["f2"] * 0 + 1.0, pdf["f2"] * 100):
        df = spark.createDataFrame(pdf.assign(id=range(60), y=target))
        data = tables.auto_preprocess(df, "y", "regression", id_column="id")
        fills.append(data.df.orderBy("id").toPandas()["f1"].to_numpy())
    np.testing.assert_array_equal(*fills)


def test_complete_table_is_not_imputed(spark):
    df = spark.createDataFrame([(1.0, 0), (2.0, 1)], "f double, y int")
    report = tables.auto_preprocess(df).report
    assert report["feature_columns_imputed"] == [] and report["imputation_diagnostics"] == {}


# ---- lineage


@pytest.fixture
def store(spark, tmp_path):
    return lineage.LineageStore(spark, str(tmp_path / "lineage"))


def one(spark, schema, *row):
    return spark.createDataFrame([row], schema)


def test_registering_twice_returns_the_same_id(spark, store):
    row = one(spark, "content_hash string, schema_json string, reference_dataset_id string", "sha256:1", "{}", None)
    first, again = store.register_dataset(row).first(), store.register_dataset(row).first()
    assert first["created"] and not again["created"] and first["id"] == again["id"]
    assert store.read("datasets").count() == 1


def test_runs_are_keyed_and_statuses_append(spark, store):
    ask = "dataset_id string, content_hash string, config_hash string, git_sha string"
    a = store.get_or_create_run(one(spark, ask, "d", "h", "c", "g")).first()
    b = store.get_or_create_run(one(spark, ask, "d", "h", "c", "g")).first()
    c = store.get_or_create_run(one(spark, ask, "d", "h", "c", "other")).first()
    assert a["id"] == b["id"] != c["id"] and (a["created"], b["created"]) == (True, False)
    state = {r["run_id"]: r["status"] for r in store.status().collect()}
    assert state == {a["id"]: "queued", c["id"]: "queued"}
    gate = "run_id string, gate_name string, passed boolean, reason string, details string"
    store.record_gate_chain(one(spark, gate, a["id"], "g", True, None, "{}"))
    store.record_gate_chain(one(spark, gate, c["id"], "g", False, "bad", "{}"))
    state = {r["run_id"]: r["status"] for r in store.status().collect()}
    assert state == {a["id"]: "gate-check", c["id"]: "failed"}
    assert {r["action"] for r in store.read("audit_log").collect()} == {"gate_chain_passed", "gate_chain_rejected"}
    with pytest.raises(ValueError):
        store.set_status(spark.createDataFrame([("x",)], "run_id string"), "lost", 3)


def test_other_records(spark, store):
    store.record_trials(one(spark, "run_id string, model_family string, trial_number int, params_json string, score double", "r", "linear", 0, "{}", None))
    store.record_metric(one(spark, "run_id string, name string, value double, ci_low double, ci_high double", "r", "m", 1.0, None, None))
    store.record_artifact(one(spark, "run_id string, kind string, storage_uri string, content_hash string", "r", "model", "file:/x", "h"))
    store.record_episode(one(spark, "episode_number int, a int, b string, reward double, run_id string", 1, 2, "x", 0.5, None), ["a"], ["b"])
    assert store.read("hyperparameters").first()["score"] is None
    assert store.read("metrics").first()["ci_low"] is None
    assert store.read("artifacts").count() == 1
    episode = store.read("rl_episodes").first()
    assert json.loads(episode["state_json"]) == {"a": 2} and episode["run_id"] is None


def test_every_record_call_is_kept_and_a_repeated_event_is_not(spark, store):
    metric = "run_id string, name string, value double, ci_low double, ci_high double"
    for value, event in ((1.0, None), (2.0, None), (3.0, "e"), (3.0, "e")):
        store.record_metric(one(spark, metric, "r", "m", value, None, None), event)
    assert sorted(r["value"] for r in store.read("metrics").collect()) == [1.0, 2.0, 3.0]
    gate = "run_id string, gate_name string, passed boolean, reason string, details string"
    for passed in (True, False):
        store.record_gate_chain(one(spark, gate, "r", "g", passed, None, "{}"))
    assert {r["passed"] for r in store.read("gate_evaluations").collect()} == {True, False}
    assert {r["action"] for r in store.read("audit_log").collect()} == {"gate_chain_passed", "gate_chain_rejected"}
    episode = "episode_number int, a int, b string, reward double, run_id string"
    for reward in (0.5, 0.7):
        store.record_episode(one(spark, episode, 1, 2, "x", reward, None), ["a"], ["b"])
    assert store.read("rl_episodes").count() == 2


def test_prepared_run_replays(spark, store):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"id": range(50), "a": rng.normal(size=50), "b": rng.normal(size=50)})
    pdf.loc[::5, "a"] = np.nan
    df = spark.createDataFrame(pdf)
    schema = {"id": "bigint", "a": "double", "b": "double"}
    done = [prepare(df, store, expected_schema=schema, reference=df, git_sha="g", id_column="id") for _ in range(2)]
    assert done[0].chain.passed and done[0].run_id == done[1].run_id and done[0].df.count() == 50
    rows = store.replay(done[0].run_id).collect()
    assert [r["step_type"] for r in rows] == ["imputation", "outlier_detection"]
    assert rows[0]["output_hash"] == rows[1]["input_hash"]
    report = lineage.replay_json(rows)
    assert report["git_sha"] == "g" and report["steps"][0]["params"]["method"] == "mice"
    with pytest.raises(LookupError):
        store.replay("nothing")


def test_rejected_run_stops(spark, store):
    df = spark.createDataFrame([(None,), (None,), (1.0,)], "a double")
    done = prepare(df, store, settings=Settings.of({"drift_gate": {"enabled": False}}), expected_schema={"a": "double"})
    assert done.df is None and store.status().first()["status"] == "failed"
    assert store.read("pipeline_steps").count() == 0


# ---- claims

METRIC = "name string, value double, ci_low double, ci_high double"


def stats(spark, *rows):
    return claims.metric_stats(spark.createDataFrame(list(rows), METRIC))


def test_metric_widths(spark):
    got = {r["name"]: r for r in stats(spark, ("a", 0.9, 0.88, 0.92), ("b", 1.0, None, None), ("z", 0.0, -1.0, 1.0)).collect()}
    assert got["a"]["ci_width"] == pytest.approx(0.04) and got["a"]["relative_ci_width"] == pytest.approx(0.04 / 0.9)
    assert got["b"]["ci_width"] is None and got["z"]["relative_ci_width"] is None and got["z"]["ci_width"] == 2.0


def test_facts_use_six_digits(spark):
    got = {r["metric_name"]: r["text"] for r in claims.grounding_facts(stats(spark, ("a", 0.9, 0.88, 0.92), ("b", 1234567.0, None, None))).collect()}
    assert got["a"] == "a = 0.9 (95% CI [0.88, 0.92])"
    assert got["b"] == "b = 1.23457e+06 (no confidence interval available)"


def verify(spark, rows, *metrics):
    made = spark.createDataFrame(rows, "metric_name string, stated_value double, statement string")
    return claims.verify_claims(made, stats(spark, *metrics))


def test_verification(spark):
    got = verify(spark, [("a", 0.9, "s"), ("a", 0.95, "s"), ("a", 0.9005, "s"), ("q", 1.0, "s")], ("a", 0.9, 0.88, 0.92)).collect()
    by = {(r["metric_name"], r["stated_value"]): r for r in got}
    assert [by[k]["verified"] for k in (("a", 0.9), ("a", 0.95), ("a", 0.9005), ("q", 1.0))] == [True, False, True, False]
    assert "0.95" in by["a", 0.95]["rejection_reason"] and "q" in by["q", 1.0]["rejection_reason"]
    assert by["a", 0.9]["rejection_reason"] is None


def test_buckets(spark):
    rows = [("hi", 1.0, "s"), ("low", 1.0, "s"), ("hi", 9.0, "wrong"), ("none", 2.0, "s"), ("mid", 1.0, "s")]
    checked = verify(spark, rows, ("hi", 1.0, 0.95, 1.05), ("low", 1.0, 0.5, 1.5), ("none", 2.0, None, None), ("mid", 1.0, 0.85, 1.1))
    got = {(r["metric_name"], r["stated_value"]): (r["bucket"], r["confidence_label"], r["confidence_score"]) for r in claims.emit_or_flag(checked).collect()}
    assert got["hi", 1.0][:2] == ("accepted", "high") and got["hi", 1.0][2] == pytest.approx(1 / 1.1)
    assert got["low", 1.0][:2] == ("flagged", "inconclusive") and got["none", 2.0] == ("flagged", "unknown", None)
    assert got["hi", 9.0] == ("rejected", None, None) and got["mid", 1.0][:2] == ("accepted", "moderate")


def test_last_duplicate_metric_counts(spark):
    df = spark.createDataFrame([(0, "a", 1.0), (1, "a", 2.0)], "pos int, name string, value double")
    assert claims.last_by_name(df, "pos").first()["value"] == 2.0


GOOD = '[{"metric_name": "a", "stated_value": 0.9, "statement": "s"}]'


@pytest.mark.parametrize(
    "text, n, error",
    [
        (GOOD, 1, None),
        (f"```json\n{GOOD}\n```", 1, None),
        (f"  ```\n{GOOD}```\n", 1, None),
        (GOOD.replace("0.9", '"0.9"'), 1, None),
        ("[]", 0, None),
        ("no json", 0, "not valid JSON"),
        ('{"metric_name": "a"}', 0, "not a JSON array"),
        ('[{"metric_name": "a", "stated_value": 1}]', 0, "required field"),
        (GOOD.replace("0.9", '"many"'), 0, "not a number"),
        (GOOD.replace("0.9", "null"), 0, "not a number"),
        ("[7]", 0, "not a JSON object"),
        (GOOD[:-1] + ", [1]]", 0, "not a JSON object"),
    ],
)
def test_drafts_are_taken_whole_or_not_at_all(spark, text, n, error):
    row = claims.parse_drafts(spark.createDataFrame([(text,)], "response string")).first()
    assert len(row["claims"]) == n
    assert (row["draft_error"] is None) if error is None else (error in row["draft_error"])


def test_claim_settings():
    for bad in ((0.0, 0.4, 0.02), (0.5, 0.4, 0.02), (0.1, 0.4, 1.0)):
        with pytest.raises(ValueError):
            ClaimSettings(*bad)


def test_settings_files(tmp_path):
    path = tmp_path / "s.json"
    path.write_text(json.dumps({"drift_gate": {"method": "ks"}, "meta_learning": {"maml": {"inner_steps": 2}}, "estimation": {"include_linear_family": False}}))
    s = Settings.load(path)
    assert s.drift_gate.method == "ks" and s.maml.inner_steps == 2 and "linear" not in s.estimation.families
    assert Settings.of(None) == Settings() and s.as_dict()["imputation"]["method"] == "mice"
    with pytest.raises(FileNotFoundError):
        Settings.load(tmp_path / "absent.json")


def test_command_line(spark, tmp_path, capsys):
    from assayer.__main__ import main

    rows = "\n".join(f"{i % 7},{'u' if i % 3 else 'v'},{(i % 7) * 2 + i % 2}.5" for i in range(60))
    path = write_csv(tmp_path, f"a,b,y\n{rows}\n")
    flags = ["--families", "linear", "--n-trials", "1", "--cv-folds", "2", "--stacking-cv-folds", "2"]
    assert main(["fit", path, "--auto-preprocess", "--task", "regression", *flags]) == 0
    report = json.loads(capsys.readouterr().out)
    assert report["features"] == ["a", "b_v"] and report["best_family"] == "linear"
    assert main(["replay", str(tmp_path / "none"), "x"]) == 1


def test_labels_of_any_number_are_coded_in_order(spark):
    n = 100_000
    many = spark.range(n).select(F.concat(F.lit("l"), F.lpad((F.col("id") * 7919 % n).cast("string"), 6, "0")).alias("y"), F.col("id").alias("i"))
    many = many.union(spark.createDataFrame([(None, n)], "y string, i long"))
    wrong = tables.encode_label(many, "y", "k").where("k != coalesce(cast(substr(y, 2) AS int), -1)").count()
    assert wrong == 0
    vectors = tables.one_hot_vector(many, "y", "v").where("i < 3 or i = 100000").collect()
    for r in vectors:
        level = int(r["y"][1:]) if r["y"] else 0
        assert r["v"].size == n - 1 and r["v"].indices.tolist() == ([n - 1 - level] if level else [])
    one = tables.one_hot_vector(spark.createDataFrame([("a",), (None,)], "y string"), "y", "v").collect()
    assert [r["v"].toArray().tolist() for r in one] == [[0.0], [0.0]]


def test_drafts_of_one_split_are_parsed_once_in_many_tasks(spark, capsys):
    claim = F.lit('[{"metric_name":"m","stated_value":1,"statement":"s"}]')
    drafts = spark.range(0, 20_000, 1, 1).select("id", F.when(F.col("id") % 2 == 0, claim).otherwise("[]").alias("response"))
    rows = claims.drafted_claims(claims.parse_drafts(drafts), ["id"])
    rows.explain("formatted")
    plan = capsys.readouterr().out
    assert "RoundRobinPartitioning" in plan and plan.count("parseJson") <= 2
    assert rows.count() == 10_000


def test_packed_hashes_come_back_as_they_were(spark):
    digest = sha_text("x")
    texts = [digest, digest[7:], digest.upper(), digest[:-1], digest + "\n", "0g", "abc", "", "é\u0000", "00", "sha256:", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", lineage._packed(F.col("t")).alias("p")).select("t", lineage._unpacked(F.col("p")).alias("u"), F.length("p").alias("n"))
    got = rows.collect()
    assert [r["u"] for r in got] == texts
    assert got[0]["n"] == 33 and got[1]["n"] == 33 and got[-1]["n"] is None


def test_replay_makes_hashes_after_its_shuffle(spark, tmp_path):
    orders = [(1, 10, "F", "1-URGENT"), (2, 10, None, "5-LOW"), (2, 11, "O", None), (3, 12, "P", "5-LOW"), (None, 13, "O", "5-LOW")]
    lines = [(1, 7, 70, 1, "N", "O"), (1, 7, 70, 1, "N", "O"), (1, None, 71, 2, "A", "F"), (2, 8, None, 1, None, None), (9, 8, 72, 1, "R", "F"), (None, 8, 73, 1, "R", "F")]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(
        lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_returnflag string, l_linestatus string"
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    out = plans.QUERIES["replay_run"](spark, str(tmp_path))
    plan = out._jdf.queryExecution().optimizedPlan().toString().split("\n")
    joins = [i for i, x in enumerate(plan) if "Join " in x]
    assert len(joins) == 2 and any("sha2(" in x for x in plan)
    for i in joins:  # what a join reads stands below it, further in
        depth = len(plan[i]) - len(plan[i].lstrip(" :+-"))
        below = itertools.takewhile(lambda x: len(x) - len(x.lstrip(" :+-")) > depth, plan[i + 1 :])
        assert not any("sha2(" in x for x in below)

    def text(*parts):
        return "|".join(str(p) for p in parts if p is not None)

    def sha(x):
        return sha_text(x) if x is not None else None

    want = []
    for key, customer, status, priority in orders:
        config, run = sha(text("priority", priority)), str(key) if key is not None else None
        head = (run, str(customer), status, config, sha(text(sha(text("customer", customer)), config, status)))
        own = [x for x in lines if key is not None and x[0] == key]
        for _, part, supplier, number, flag, _ in own:
            kind = f"step_{flag}" if flag else None
            made = hashlib.sha256("\u001f".join(["step", run, str(number), kind or ""]).encode()).hexdigest()[:32]
            result = sha(str(supplier)) if flag not in (None, "N") else None
            params = f'{{"part":{part}}}' if part is not None else None
            want.append((*head, made, number, kind, sha(str(part)) if part is not None else None, result, params, supplier))
        if not own:
            want.append((*head, *[None] * 7))
    assert sorted(map(repr, out.collect())) == sorted(repr(Row(**dict(zip(out.columns, w)))) for w in want)
