import datetime as dt

import numpy as np
import pandas as pd
import pytest
from oracle import compare, duck
from pyspark.sql import functions as F

import __spark_entry__ as entry
from assayer.operators import adapt
from assayer.settings import DriftGateSettings, MaskSearchSettings
from assayer.streaming import jobs, keyed

SF = "/root/testdata/sf0.001"


def write_batches(spark, folder, locs):
    """One file per batch, in time order."""
    rng = np.random.default_rng(0)
    for i, loc in enumerate(locs):
        x = rng.normal(loc, 1, (200, 2))
        pdf = pd.DataFrame(x, columns=["a", "b"]).assign(
            y=x[:, 0], ts=[dt.datetime(2024, 1, 1 + i) + dt.timedelta(minutes=k) for k in range(200)], c="k"
        )
        pdf.loc[::10, "b"] = np.nan
        df = spark.createDataFrame(pdf)
        df.coalesce(1).write.mode("append").parquet(folder)
    return df.schema


def test_gate_per_batch_and_replay(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = write_batches(spark, source, [0, 0, 0])
    stream = jobs.table_stream(spark, source, "*.parquet", schema, files_per_batch=1)
    work = jobs.null_gate_job(out, 0.05)
    jobs.per_batch(stream, work, str(tmp_path / "check")).awaitTermination()
    got = spark.read.parquet(out)
    assert got.count() == 15 and got.where("NOT passed").select("column").distinct().first()["column"] == "b"
    work(spark.read.schema(schema).parquet(source).limit(200), 2)  # the last batch again
    assert spark.read.parquet(out).count() == 15


@pytest.mark.parametrize("method", ["psi", "ks"])
def test_adaptation_on_a_stream_keeps_its_state(spark, tmp_path, method):
    """Ten files, so ten micro-batches; the query is stopped and started again; files that come twice change nothing."""
    source, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    write_batches(spark, source, [0, 0, 0, 0, 6])
    schema = spark.read.parquet(source).schema
    settings = DriftGateSettings(method=method, ks_p_value_threshold=1e-6)

    def run():
        stream = jobs.table_stream(spark, source, "*.parquet", schema, files_per_batch=1)
        with keyed.keyed_state(spark):
            made = keyed.adaptive_stream(
                stream, "ts", "c", ["a"], "y", adapt.start_head(1, 0), drift=settings, masks=MaskSearchSettings(population_size=4, n_generations=2)
            )
            query = jobs.to_table(made, out, check)
            query.awaitTermination()
        return query.recentProgress

    first = run()
    rows = spark.read.parquet(out).where("key = 'k'").orderBy("batch").collect()
    assert len(first) >= 5 and [r["n_batches_seen"] for r in rows] == [1, 2, 3, 4]
    write_batches(spark, source, [0, 0, 0, 0, 6])  # late: all but the open window's rows have been counted
    late = spark.createDataFrame([(6.0, 6.0, 6.0, dt.datetime(2024, 1, 9), "k")], schema)
    for _ in range(2):
        late.coalesce(1).write.mode("append").parquet(source)
    run()
    rows = spark.read.parquet(out).where("key = 'k'").orderBy("batch").collect()
    assert [r["n_batches_seen"] for r in rows] == [1, 2, 3, 4, 5] and [r["n_rows"] for r in rows][:4] == [200] * 4
    assert [r["drift_detected"] for r in rows] == [True, False, False, False, True]
    assert [r["n_adaptations"] for r in rows] == [1, 1, 1, 1, 2]


def test_summaries_give_the_exact_scores_of_few_values_and_bounds_for_many():
    rng = np.random.default_rng(3)
    for n, m in ((30, 45), (500, 512), (5000, 4000)):
        r, c = np.sort(rng.normal(0, 1, n)), np.sort(rng.normal(0.2, 1.2, m))
        sides = [keyed.Summary(np.quantile(v, np.arange(keyed.MARKS + 1) / keyed.MARKS, method="inverted_cdf"), len(v)) for v in (r, c)]
        edges = np.unique(np.quantile(r, np.linspace(0, 1, 11)))
        shares = [np.maximum(np.histogram(v, edges)[0] / len(v), 1e-6) for v in (r, c)]
        psi = np.sum((shares[1] - shares[0]) * np.log(shares[1] / shares[0]))
        points = np.union1d(r, c)
        d = np.abs(np.searchsorted(r, points, "right") / n - np.searchsorted(c, points, "right") / m).max()
        if n <= keyed.EXACT:
            assert sides[0].psi(sides[1], 10) == pytest.approx(psi) and sides[0].distance(sides[1]) == pytest.approx(d)
        else:
            assert abs(sides[0].psi(sides[1], 10) - psi) < 0.05 and abs(sides[0].distance(sides[1]) - d) <= 2 * keyed.RANK_ERROR


def test_window_profile_emits_every_window(spark, tmp_path):
    source, staged, out = str(tmp_path / "raw"), str(tmp_path / "in"), str(tmp_path / "out")
    write_batches(spark, source, [0, 1, 2])
    rows = spark.read.parquet(source)
    keyed.stage(rows, "ts", staged, slices=5)
    stream = jobs.table_stream(spark, staged, "*.parquet", rows.schema, files_per_batch=1)
    jobs.to_table(jobs.window_profile(stream, "ts", ["b"], "c"), out, str(tmp_path / "check")).awaitTermination()
    got = spark.read.parquet(out).orderBy("window_start").collect()
    assert [r["n_rows"] for r in got] == [200] * 3 and got[0]["missingness_rate"] == pytest.approx(0.1)
    want = rows.groupBy(F.to_date("ts").alias("d")).agg(F.avg(F.nanvl("b", F.lit(None))).alias("m"), F.skewness(F.nanvl("b", F.lit(None))).alias("s"))
    for r, w in zip(got, want.orderBy("d").collect()):
        assert r["b_mean"] == pytest.approx(w["m"]) and r["b_skew"] == pytest.approx(w["s"]) and r["n_categories"] == 1


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    assert compare(spark, con, SF, entry.queries()[name], entry.oracle_sql().get(name)) is None


def test_entry_and_keys(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "_is_outlier" in df.columns
    assert set(entry.oracle_sql()) <= set(entry.queries())
