import math

import numpy as np
import pandas as pd
import pytest

from assayer.functions.distance import Grid, ks_distances
from assayer.operators import gates
from assayer.settings import DriftGateSettings, NullGateSettings, SchemaGateSettings, Settings


def normal(spark, loc, n, seed=0, scale=1.0):
    values = np.random.default_rng(seed).normal(loc, scale, n)
    return spark.createDataFrame(pd.DataFrame({"a": values}))


def test_null_gate_per_column(spark):
    clean = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "a int, b int")
    assert gates.NullRateGate().evaluate(clean).passed
    bad = spark.createDataFrame([(1, 1), (None, 2), (None, 3), (None, 4)], "a int, b int")
    result = gates.NullRateGate().evaluate(bad)
    assert not result.passed and list(result.details["offending_columns"]) == ["a"]
    assert result.details["null_rates"] == {"a": 0.75, "b": 0.0}


def test_null_gate_is_strict_and_refuses_no_rows(spark):
    edge = spark.createDataFrame([(1,), (2,), (3,), (None,), (None,)], "a int")
    assert gates.NullRateGate(NullGateSettings(threshold=0.4)).evaluate(edge).passed
    assert not gates.NullRateGate().evaluate(edge.limit(0)).passed


def test_null_gate_overall(spark):
    df = spark.createDataFrame([(1, 1), (None, 2), (3, 3), (4, 4)], "a int, b int")
    got = gates.NullRateGate(NullGateSettings(threshold=0.5, per_column=False)).evaluate(df)
    assert got.passed and got.details["overall_null_rate"] == 0.125


CONTRACT = {"a": "bigint", "b": "string"}


@pytest.mark.parametrize(
    "schema, settings, ok",
    [
        ("a bigint, b string", {}, True),
        ("b string, a bigint", {}, True),
        ("a bigint", {}, False),
        ("a bigint, b string, c int", {}, False),
        ("a bigint, b string, c int", {"allow_extra_columns": True}, True),
        ("a int, b string", {}, False),
        ("a int, b string", {"strict_dtypes": False}, True),
    ],
)
def test_schema_gate(spark, schema, settings, ok):
    df = spark.createDataFrame([], schema)
    assert gates.SchemaGate(SchemaGateSettings(**settings)).evaluate(df, expected_schema=CONTRACT).passed is ok


def test_schema_gate_without_contract_fails(spark):
    df = spark.createDataFrame([], "a bigint")
    assert not gates.SchemaGate().evaluate(df).passed
    assert not gates.SchemaGate().evaluate(df, expected_schema={}).passed


def test_drift_psi(spark):
    base = normal(spark, 0, 1000)
    assert gates.DriftGate().evaluate(normal(spark, 0, 1000, 1), reference=base).passed
    moved = gates.DriftGate().evaluate(normal(spark, 5, 1000, 1), reference=base)
    assert not moved.passed and moved.details["drifted_columns"] == ["a"]


def test_fully_moved_column_scores_the_known_value(spark):
    base = spark.createDataFrame([(float(i),) for i in range(1000)], "a double")
    away = spark.createDataFrame([(5000.0,)] * 50, "a double")
    score = gates.psi(away, base, ["a"])["a"]
    assert score == pytest.approx(10 * (1e-6 - 0.1) * math.log(1e-6 / 0.1))


def test_psi_equals_numpy_histogram(spark):
    rng = np.random.default_rng(5)
    r, c = rng.integers(0, 30, 700).astype(float), rng.integers(3, 40, 500).astype(float)
    edges = np.unique(np.quantile(r, np.linspace(0, 1, 11)))
    share = [np.maximum(np.histogram(v, edges)[0] / len(v), 1e-6) for v in (r, c)]
    want = np.sum((share[1] - share[0]) * np.log(share[1] / share[0]))
    frames = [spark.createDataFrame(pd.DataFrame({"a": v})) for v in (c, r)]
    assert gates.psi(*frames, ["a"])["a"] == pytest.approx(want, rel=1e-12)


def test_single_valued_reference(spark):
    flat = spark.createDataFrame([(2.0,)] * 5, "a double")
    assert gates.psi(flat, flat, ["a"]) == {"a": 0.0}
    assert gates.psi(spark.createDataFrame([(3.0,)], "a double"), flat, ["a"])["a"] == math.inf


def test_drift_ks(spark):
    ks = gates.DriftGate(DriftGateSettings(method="ks"))
    base = normal(spark, 0, 500)
    assert not ks.evaluate(normal(spark, 3, 500, 1), reference=base).passed
    assert ks.evaluate(base, reference=base).passed


def ks_by_hand(r, c):
    points = np.union1d(r, c)
    return np.abs(np.searchsorted(np.sort(r), points, "right") / len(r) - np.searchsorted(np.sort(c), points, "right") / len(c)).max()


@pytest.mark.parametrize("slices, listed", [(8, 60), (512, 100_000)])
def test_ks_distance_equals_direct_count(spark, slices, listed):
    rng = np.random.default_rng(8)
    cases = [
        (rng.integers(0, 50, 400).astype(float), rng.normal(25, 20, 300)),
        (rng.normal(0, 1, 900), rng.normal(0, 1, 800)),
        (np.repeat(5.0, 300), np.concatenate([np.repeat(5.0, 280), rng.normal(5, 1, 30)])),
        (np.array([1.0, np.inf, -np.inf, 3.0]), np.array([2.0, np.inf, 2.5])),
    ]
    for r, c in cases if slices > 8 else cases[1:3]:
        frames = [spark.createDataFrame(pd.DataFrame({"a": v, "b": 1.0})) for v in (r, c)]
        rows = {x[0]: x[1:] for x in ks_distances(*frames, ["a", "b"], slices, listed)}
        assert rows["a"] == (len(r), len(c), pytest.approx(ks_by_hand(r, c), rel=1e-12))
        assert rows["b"] == (len(r), len(c), 0.0)
    none = spark.createDataFrame([(None, 1.0)], "a double, b double")
    assert [x[0] for x in ks_distances(none, frames[0], ["a", "b"], slices, listed)] == ["b"]


def test_grid_bounds_hold_the_distance(spark):
    rng = np.random.default_rng(9)
    for slices in (4, 200):
        r, c = rng.normal(0, 1, 2000), rng.normal(0.1, 1, 1500)
        first, second = (spark.createDataFrame(pd.DataFrame({"a": v})) for v in (r, c))
        grid = Grid.of(first, ["a"], slices)
        n, m, low, high = grid.bounds(grid.count(second))["a"]
        assert (n, m) == (2000, 1500) and low <= ks_by_hand(r, c) <= high <= low + 4 / slices
        halves = [grid.count(second.where(w)) for w in ("a > 0", "a <= 0")]
        assert np.add(halves[0]["a"], halves[1]["a"]).tolist() == grid.count(second)["a"]


def test_drift_gate_refusals(spark):
    a, x = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([(1,)], "y int")
    assert not gates.DriftGate().evaluate(a, reference=x).passed
    assert not gates.DriftGate().evaluate(a).passed
    assert not gates.DriftGate().evaluate(a, reference=a.limit(0)).passed


def test_skipped_columns_pass_but_are_counted(spark):
    gone = spark.createDataFrame([(None,)], "a double")
    got = gates.DriftGate().evaluate(gone, reference=normal(spark, 0, 10))
    assert got.passed and got.details["n_columns_compared"] == 0


def test_chain_runs_every_gate(spark):
    df = spark.createDataFrame([(1,), (None,), (None,), (None,)], "a int")
    chain = gates.run_gates([gates.NullRateGate(), gates.SchemaGate()], df)
    assert [r.passed for r in chain.results] == [False, False] and not chain.passed
    assert gates.gate_failures(chain.as_df(spark)).count() == 2


def test_only_enabled_gates_in_order():
    s = Settings.of({"schema_conformance_gate": {"enabled": False}})
    assert [g.name for g in gates.build_gates(s)] == ["max_null_rate_gate", "drift_gate"]
    with pytest.raises(ValueError):
        DriftGateSettings(method="other")
