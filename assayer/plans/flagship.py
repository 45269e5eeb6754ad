"""The chain of a gated, recorded preparation run."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, functions as F

from assayer.functions.cutting import checkpointed
from assayer.functions.hashing import content_hash, hash_config, hash_source
from assayer.operators import gates, impute, outliers
from assayer.plans.quality import ROW_KEY, SHIP_CUT, holed_lineitem
from assayer.settings import Settings
from assayer.sources.lineage import LineageStore


@dataclass(frozen=True)
class Prepared:
    df: DataFrame | None  # None when a gate rejected the table
    chain: gates.ChainResult
    run_id: str
    diagnostics: dict[str, Any]


def prepare(
    df: DataFrame,
    store: LineageStore,
    *,
    settings: Settings | None = None,
    expected_schema: Mapping[str, str] | None = None,
    reference: DataFrame | None = None,
    git_sha: str = "",
    seed: int = 42,
    id_column: str | None = None,
) -> Prepared:
    """Gates, then imputation, then outlier scores; every step is recorded with its hashes.

    A rejected table goes no further and its run is marked failed.
    """
    import json

    spark = df.sparkSession
    s = settings or Settings()
    chain = gates.run_gates(gates.build_gates(s), df, expected_schema=expected_schema, reference=reference)
    source = content_hash(df)
    schema = json.dumps(gates.schema_of(df), sort_keys=True)
    known = spark.createDataFrame(
        [(source, schema, None)], "content_hash string, schema_json string, reference_dataset_id string"
    )
    dataset_id = store.register_dataset(known).first()["id"]
    asked = spark.createDataFrame(
        [(dataset_id, source, hash_config(s.as_dict()), git_sha)],
        "dataset_id string, content_hash string, config_hash string, git_sha string",
    )
    run_id = store.get_or_create_run(asked).first()["id"]
    # One event name for a run: preparing the same table again writes the same rows, as a retry does.
    store.record_gate_chain(chain.as_df(spark).withColumn("run_id", F.lit(run_id)), event=f"prepare:{run_id}")
    if not chain.passed:
        return Prepared(None, chain, run_id, {})
    filled = impute.impute(df, s.imputation, seed=seed, id_column=id_column)
    ready = checkpointed(filled.df)
    middle = content_hash(ready)
    scored = outliers.detect_outliers(ready, s.outlier_detection, seed=seed, id_column=id_column)
    steps = [
        (run_id, 1, "imputation", source, middle, filled.params, seed, hash_source(impute.impute)),
        (run_id, 2, "outlier_detection", middle, content_hash(scored.df), scored.params, seed, hash_source(outliers.detect_outliers)),
    ]
    rows = [(r, n, kind, a, b, json.dumps(p, sort_keys=True), x, code, kind) for r, n, kind, a, b, p, x, code in steps]
    store.record_step(
        spark.createDataFrame(
            rows,
            "run_id string, step_seq int, step_type string, input_hash string, output_hash string, "
            "params_json string, seed bigint, transform_code_hash string, description string",
        ),
        event=f"prepare:{run_id}",
    )
    return Prepared(scored.df, chain, run_id, {**filled.diagnostics, "outliers": scored.diagnostics})


def flagship(spark, sf_dir: str) -> DataFrame:
    """lineitem with blanked cells: gate verdicts, mean/mode fill, fences; rows with their flags."""
    import datetime as dt

    df = holed_lineitem(spark, sf_dir)
    cut = F.lit(dt.datetime.fromisoformat(SHIP_CUT)).cast("timestamp_ntz")
    chain = gates.run_gates(
        gates.build_gates(Settings()), df,
        expected_schema=gates.schema_of(df), reference=df.where(F.col("l_shipdate") < cut),
    )
    filled = impute.impute_mean_mode(df, ["l_quantity", "l_discount", "l_tax", "l_returnflag"])
    columns = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    flagged = filled.withColumn(outliers.FLAG, outliers.iqr_flag(filled, columns))
    verdicts = F.create_map(*(F.lit(x) for r in chain.results for x in (r.gate_name, r.passed)))
    return flagged.select(*ROW_KEY, *columns[:1], *columns[2:], "l_returnflag", outliers.FLAG, verdicts.alias("gates"))
