"""Lineage as append-only tables under one folder.

Nothing is updated in place: a run's status is the latest of its status rows. Inserts keyed on a
hash are anti-joined with what is stored, so repeating one changes nothing. Like any keyed insert
without a transaction log this expects one writer per table.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from assayer.functions.hashing import PREFIX, run_key

# The tables and their columns.
TABLES = {
    "datasets": "id string, content_hash string, schema_json string, reference_dataset_id string, "
    "created_at timestamp",
    "runs": "id string, dataset_id string, git_sha string, config_hash string, run_key string, "
    "created_at timestamp",
    "run_status": "run_id string, status string, updated_at timestamp, seq bigint",
    "pipeline_steps": "id string, run_id string, step_seq int, step_type string, input_hash string, "
    "output_hash string, params_json string, seed bigint, created_at timestamp",
    "transformations": "id string, step_id string, transform_code_hash string, description string",
    "hyperparameters": "id string, run_id string, model_family string, trial_number int, "
    "params_json string, score double",
    "metrics": "id string, run_id string, name string, value double, ci_low double, ci_high double",
    "artifacts": "id string, run_id string, kind string, storage_uri string, content_hash string",
    "audit_log": "id string, run_id string, actor string, action string, timestamp timestamp",
    "gate_evaluations": "id string, run_id string, gate_name string, passed boolean, reason string, "
    "details string, evaluated_at timestamp",
    "rl_episodes": "id string, episode_number int, state_json string, action_json string, "
    "reward double, run_id string, created_at timestamp",
}
STATUSES = ("queued", "running", "gate-check", "optimizing", "done", "failed")


def keyed_id(*parts: Column, event: str = "") -> Column:
    """An id that the same content of the same ``event`` always gets, so a retried task writes the same row."""
    if event:
        parts = (*parts, F.lit(event))
    filled = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return F.substring(F.sha2(F.concat_ws("\u001f", *filled), 256), 1, 32)


# ---- the rows each record consists of


def new_by_key(incoming: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Incoming rows whose key is neither stored nor repeated earlier in the batch (least id wins)."""
    first = incoming.groupBy(key).agg(
        F.min(F.struct(F.col("id"), *[c for c in incoming.columns if c not in ("id", key)])).alias("_r")
    )
    rows = first.select("_r.*", key).select(*incoming.columns)
    return rows.join(stored.select(key), key, "left_anti").select(*incoming.columns)


def dataset_rows(hashes: DataFrame) -> DataFrame:
    """datasets rows from (content_hash, schema_json, reference_dataset_id)."""
    return hashes.select(
        keyed_id(F.lit("dataset"), F.col("content_hash")).alias("id"),
        "content_hash",
        "schema_json",
        F.col("reference_dataset_id").cast("string").alias("reference_dataset_id"),
        F.current_timestamp().alias("created_at"),
    )


def register_dataset(incoming: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to append, (content_hash, id, created) for every distinct incoming hash)."""
    fresh = new_by_key(incoming, stored, "content_hash")
    known = incoming.select("content_hash").distinct().join(
        stored.select("content_hash", "id"), "content_hash"
    )
    answer = known.withColumn("created", F.lit(False)).unionByName(
        fresh.select("content_hash", "id").withColumn("created", F.lit(True))
    )
    return fresh, answer


def run_rows(requests: DataFrame) -> DataFrame:
    """runs rows from (dataset_id, content_hash, config_hash, git_sha)."""
    key = run_key(F.col("content_hash"), F.col("config_hash"), F.col("git_sha"))
    return requests.withColumn("run_key", key).select(
        keyed_id(F.lit("run"), F.col("run_key")).alias("id"),
        F.col("dataset_id").cast("string").alias("dataset_id"),
        "git_sha",
        "config_hash",
        "run_key",
        F.current_timestamp().alias("created_at"),
    )


def get_or_create_run(incoming: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to append, (run_key, id, created) for every distinct requested run)."""
    fresh = new_by_key(incoming, stored, "run_key")
    known = incoming.select("run_key").distinct().join(stored.select("run_key", "id"), "run_key")
    answer = known.withColumn("created", F.lit(False)).unionByName(
        fresh.select("run_key", "id").withColumn("created", F.lit(True))
    )
    return fresh, answer


def gate_chain_rows(results: DataFrame, event: str = "") -> dict[str, DataFrame]:
    """Rows for three tables from gate results (run_id, gate_name, passed, reason, details)."""
    per_run = results.groupBy("run_id").agg(F.bool_and("passed").alias("ok"))
    return {
        "gate_evaluations": results.select(
            keyed_id(F.lit("gate"), F.col("run_id"), F.col("gate_name"), event=event).alias("id"),
            "run_id",
            "gate_name",
            "passed",
            "reason",
            "details",
            F.current_timestamp().alias("evaluated_at"),
        ),
        "audit_log": per_run.select(
            keyed_id(F.lit("audit"), F.col("run_id"), F.lit("validation_gates"), event=event).alias("id"),
            "run_id",
            F.lit("validation_gates").alias("actor"),
            F.when(F.col("ok"), "gate_chain_passed").otherwise("gate_chain_rejected").alias("action"),
            F.current_timestamp().alias("timestamp"),
        ),
        "run_status": per_run.select(
            "run_id",
            F.when(F.col("ok"), "gate-check").otherwise("failed").alias("status"),
            F.current_timestamp().alias("updated_at"),
            F.lit(1).cast("bigint").alias("seq"),
        ),
    }


def current_status(events: DataFrame, by: str = "run_id") -> DataFrame:
    """(run_id, status, updated_at): the latest status row per run, combined before the shuffle."""
    last = F.max_by(F.struct("status", "updated_at"), F.struct("updated_at", "seq"))
    return events.groupBy(by).agg(last.alias("_l")).select(by, "_l.status", "_l.updated_at")


def step_rows(steps: DataFrame, event: str = "", keep: Sequence[str] = ()) -> dict[str, DataFrame]:
    """Step and transformation rows sharing the step id.

    From (run_id, step_seq, step_type, input_hash, output_hash, params_json, seed,
    transform_code_hash, description). Step rows also get the columns to ``keep``.
    """
    step_id = keyed_id(F.lit("step"), F.col("run_id"), F.col("step_seq"), F.col("step_type"), event=event)
    named = steps.withColumn("id", step_id)
    return {
        "pipeline_steps": named.select(
            "id", "run_id", "step_seq", "step_type", "input_hash", "output_hash", "params_json",
            "seed", F.current_timestamp().alias("created_at"), *keep,
        ),
        "transformations": named.select(
            keyed_id(F.lit("transformation"), F.col("id")).alias("id"),
            F.col("id").alias("step_id"), "transform_code_hash", "description",
        ),
    }


def trial_rows(trials: DataFrame, event: str = "") -> DataFrame:
    """hyperparameters rows from (run_id, model_family, trial_number, params_json, score)."""
    key = keyed_id(F.lit("trial"), F.col("run_id"), F.col("model_family"), F.col("trial_number"), event=event)
    return trials.select(
        key.alias("id"), "run_id", "model_family", "trial_number", "params_json", "score"
    )


def metric_rows(metrics: DataFrame, event: str = "") -> DataFrame:
    """metrics rows from (run_id, name, value, ci_low, ci_high)."""
    return metrics.select(
        keyed_id(F.lit("metric"), F.col("run_id"), F.col("name"), event=event).alias("id"),
        "run_id", "name", "value", "ci_low", "ci_high",
    )


def artifact_rows(artifacts: DataFrame) -> DataFrame:
    """artifacts rows from (run_id, kind, storage_uri, content_hash)."""
    return artifacts.select(
        keyed_id(F.lit("artifact"), F.col("run_id"), F.col("kind"), F.col("content_hash")).alias("id"),
        "run_id", "kind", "storage_uri", "content_hash",
    )


def episode_rows(
    episodes: DataFrame, state: Sequence[str], action: Sequence[str], event: str = ""
) -> DataFrame:
    """rl_episodes rows; state and action columns become JSON objects."""
    return episodes.select(
        keyed_id(F.lit("episode"), F.col("episode_number"), F.col("run_id"), event=event).alias("id"),
        F.col("episode_number").cast("int").alias("episode_number"),
        F.to_json(F.struct(*state)).alias("state_json"),
        F.to_json(F.struct(*action)).alias("action_json"),
        F.col("reward").cast("double").alias("reward"),
        F.col("run_id").cast("string").alias("run_id"),
        F.current_timestamp().alias("created_at"),
    )


def _packed(text: Column) -> Column:
    """The text as bytes that ``_unpacked`` turns back: a mark, then the bytes that lower-case hexadecimal digits stand for.

    Hashes and ids take half the room in a shuffle. Any other text follows its mark as it is.
    """
    plain = F.concat(F.lit(b"\x00"), text.cast("binary"))
    rest = F.substring(text, len(PREFIX) + 1, 64)

    def digits(part: Column) -> Column:
        return F.coalesce(F.lower(F.hex(F.unhex(part))) == part, F.lit(False))

    return (
        F.when((F.length(text) == len(PREFIX) + 64) & text.startswith(PREFIX) & digits(rest), F.concat(F.lit(b"\x02"), F.unhex(rest)))
        .when(F.length(text).isin(32, 64) & digits(text), F.concat(F.lit(b"\x01"), F.unhex(text)))
        .otherwise(plain)
    )


def _unpacked(data: Column) -> Column:
    mark, rest = F.hex(F.substring(data, 1, 1)), F.substring(data, 2, 2**31 - 1)
    digits = F.lower(F.hex(rest))
    return (
        F.when(mark == "02", F.concat(F.lit(PREFIX), digits)).when(mark == "01", digits).otherwise(rest.cast("string"))
    )


RUN = ("dataset_id", "git_sha", "config_hash", "run_key")
STEP = ("step_id", "step_seq", "step_type", "input_hash", "output_hash", "params_json", "seed")


def replay(
    runs: DataFrame, steps: DataFrame, keys: tuple[str, str] | None = None,
    run_of: Callable[[DataFrame], DataFrame] | None = None, step_of: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """One row per run and step in recorded order; a run without steps keeps one row.

    Without ``keys`` both are recorded rows. With them the rows still lack their columns, which ``run_of`` (run_id, RUN) and
    ``step_of`` (STEP) add to the rows of both sides joined: a hash takes more room in a shuffle than what it is made of.
    ``keys`` name a column of either side; these are equal just when the run ids are. All other names differ.
    """
    if keys is None:
        hashes = ["config_hash", "run_key", "step_id", "input_hash", "output_hash"]

        def moved(names: Sequence[str]) -> list[Column]:
            return [(_packed(F.col(c)) if c in hashes else F.col(c)).alias(c) for c in names]

        def unpacking(names: Sequence[str]) -> Callable[[DataFrame], DataFrame]:
            return lambda df: df.withColumns({c: _unpacked(F.col(c)) for c in names if c in hashes})

        runs = runs.withColumnRenamed("id", "run_id").select("run_id", *moved(RUN))
        steps = steps.withColumn("step_id", F.col("id")).select(F.col("run_id").alias("_run"), *moved(STEP))
        keys, run_of, step_of = ("run_id", "_run"), unpacking(RUN), unpacking(STEP)
    mine, theirs = map(F.col, keys)
    # an inner join, which can be split when one run holds a large share of the steps; the runs
    # without steps are few rows of their own
    known = runs.where(mine.isNotNull())  # the same on both sides, so that the runs are shuffled once
    done = step_of(known.join(steps, mine == theirs))
    idle = known.join(steps.select(theirs).distinct(), mine == theirs, "left_anti")
    idle = idle.unionByName(runs.where(mine.isNull()))
    rows = run_of(done).select("run_id", *RUN, *STEP)
    return rows.unionByName(run_of(idle).select("run_id", *RUN), allowMissingColumns=True)


# ---- the store


class LineageStore:
    """Parquet tables under ``root``; ``append`` and ``read`` know their schemas."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def read(self, table: str) -> DataFrame:
        schema = TABLES[table]
        path = f"{self.root}/{table}"
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        fs = where.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(where):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(path)

    def append(self, table: str, rows: DataFrame, known: bool = True) -> None:
        """Appends exactly the table's columns; rows whose id is stored already are left out, unless none can be ``known``."""
        shape = self.spark.createDataFrame([], TABLES[table]).schema
        rows = rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in shape))
        if known and "id" in shape.fieldNames():
            rows = rows.join(self.read(table).select("id"), "id", "left_anti").select(
                *shape.fieldNames()
            )
        rows.write.mode("append").parquet(f"{self.root}/{table}")

    def register_dataset(self, incoming: DataFrame) -> DataFrame:
        fresh, answer = register_dataset(dataset_rows(incoming), self.read("datasets"))
        answer = self._settled(answer)
        self.append("datasets", fresh)
        return answer

    def get_or_create_run(self, requests: DataFrame) -> DataFrame:
        fresh, answer = get_or_create_run(run_rows(requests), self.read("runs"))
        answer = self._settled(answer)
        self.append("runs", fresh)
        self.set_status(answer.where("created").select(F.col("id").alias("run_id")), "queued", 0)
        return answer

    def _settled(self, df: DataFrame) -> DataFrame:
        from assayer.functions.cutting import checkpointed

        return checkpointed(df)  # what was new must not change once the rows are stored

    def set_status(self, runs: DataFrame, status: str, seq: int) -> None:
        if status not in STATUSES:
            raise ValueError(f"unknown run status {status!r}; legal: {', '.join(STATUSES)}")
        self.append(
            "run_status",
            runs.select(
                "run_id",
                F.lit(status).alias("status"),
                F.current_timestamp().alias("updated_at"),
                F.lit(seq).cast("bigint").alias("seq"),
            ),
        )

    # Every record call is an event of its own; a caller that repeats a write after a failure passes the event's name
    # again, and rows already stored under it are left out.

    def record_gate_chain(self, results: DataFrame, event: str | None = None) -> None:
        for table, rows in gate_chain_rows(results, event or uuid.uuid4().hex).items():
            self.append(table, rows, event is not None)

    def record_step(self, steps: DataFrame, event: str | None = None) -> None:
        for table, rows in step_rows(steps, event or uuid.uuid4().hex).items():
            self.append(table, rows, event is not None)

    def record_trials(self, trials: DataFrame, event: str | None = None) -> None:
        self.append("hyperparameters", trial_rows(trials, event or uuid.uuid4().hex), event is not None)

    def record_metric(self, metrics: DataFrame, event: str | None = None) -> None:
        self.append("metrics", metric_rows(metrics, event or uuid.uuid4().hex), event is not None)

    def record_artifact(self, artifacts: DataFrame) -> None:
        self.append("artifacts", artifact_rows(artifacts))

    def record_episode(self, episodes: DataFrame, state, action, event: str | None = None) -> None:
        self.append("rl_episodes", episode_rows(episodes, state, action, event or uuid.uuid4().hex), event is not None)

    def status(self) -> DataFrame:
        return current_status(self.read("run_status"))

    def replay(self, run_id: str) -> DataFrame:
        """The run's rows in step order; LookupError for an unknown id."""
        runs = self.read("runs").where(F.col("id") == run_id)
        if runs.isEmpty():
            raise LookupError(f"no run with id {run_id}")
        steps = self.read("pipeline_steps").where(F.col("run_id") == run_id)
        return replay(runs, steps).orderBy("step_seq", "step_id")


def replay_json(rows: Sequence[Mapping]) -> dict:
    """The report of one run from its replay rows."""
    import json

    head = rows[0]
    steps = [
        {
            "id": r["step_id"],
            "step_type": r["step_type"],
            "input_hash": r["input_hash"],
            "output_hash": r["output_hash"],
            "params": json.loads(r["params_json"] or "{}"),
            "seed": r["seed"],
        }
        for r in rows
        if r["step_id"] is not None
    ]
    names = ("run_id", "dataset_id", "git_sha", "config_hash", "run_key")
    return {**{n: head[n] for n in names}, "steps": steps}
