"""The same checks on a stream: windows and per-batch gates; see ``keyed`` for drift-triggered adaptation.

Per-batch results are written to a folder named after the batch id, with overwrite. A batch that is
replayed after a failure writes the same folder again, so every batch counts once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from assayer.functions.columns import missing, quoted
from assayer.operators.adapt import Reference
from assayer.operators.gates import null_rates
from assayer.settings import DriftGateSettings


def table_stream(
    spark: SparkSession, folder: str, glob: str, schema, files_per_batch: int | None = None
) -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def event_time(ts: Column) -> Column:
    """Event time must be TIMESTAMP; stored times without zone are read in the session's zone."""
    return ts.cast("timestamp")


def window_profile(
    stream: DataFrame,
    ts: str,
    columns: Sequence[str],
    category: str,
    width: str = "1 day",
    lateness: str = "1 hour",
) -> DataFrame:
    """Per tumbling window: rows, missing share, mean and skew of each column, distinct categories.

    A first aggregate keeps a row for each window and category, so the categories are counted exactly and no state row
    grows; a second one adds up the power sums of a window once the watermark has passed it. Null is no category.
    """
    cells = [F.when(~missing(stream, c), quoted(c).cast("double")) for c in columns]
    timed = stream.select(
        event_time(quoted(ts)).alias("_ts"), quoted(category).alias("_category"), *(v.alias(f"_c{i}") for i, v in enumerate(cells))
    ).withWatermark("_ts", lateness)
    powers = [F.sum(F.pow(f"_c{i}", F.lit(p))).alias(f"_s{i}_{p}") for i in range(len(columns)) for p in (1, 2, 3)]
    first = timed.groupBy(F.window("_ts", width), "_category").agg(
        F.count("*").alias("_rows"), *(F.count(f"_c{i}").alias(f"_n{i}") for i in range(len(columns))), *powers
    )
    summed = [f"_n{i}" for i in range(len(columns))] + [f"_s{i}_{p}" for i in range(len(columns)) for p in (1, 2, 3)]
    whole = first.groupBy("window").agg(
        F.sum("_rows").alias("n_rows"), F.count("_category").alias("n_categories"), *(F.sum(c).alias(c) for c in summed)
    )
    there = sum((F.col(f"_n{i}") for i in range(len(columns))), F.lit(0))
    out = [
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "n_rows",
        (1 - there / (F.col("n_rows") * len(columns))).alias("missingness_rate"), "n_categories",
    ]
    for i, c in enumerate(columns):
        n = F.col(f"_n{i}")
        mean, square, cube = (F.col(f"_s{i}_{p}") / n for p in (1, 2, 3))
        spread = square - mean * mean
        # far below what rounding leaves of the squares, all values count as equal
        skew = F.when(spread > 1e-13 * square, (cube - 3 * mean * square + 2 * mean * mean * mean) / F.pow(spread, F.lit(1.5)))
        out += [mean.alias(f"{c}_mean"), skew.alias(f"{c}_skew")]
    return whole.select(*out)


def to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    return (
        stream.writeStream.format("parquet").outputMode(mode).option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def per_batch(
    stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str
) -> StreamingQuery:
    return (
        stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def _put(rows: DataFrame, path: str, batch_id: int) -> None:
    rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def null_gate_job(path: str, threshold: float = 0.4) -> Callable[[DataFrame, int], None]:
    """Null counts and verdict per column of every batch."""

    def work(batch: DataFrame, batch_id: int) -> None:
        rates = null_rates(batch).withColumn("passed", F.coalesce(F.col("null_rate") <= threshold, F.lit(False)))
        _put(rates.coalesce(1), path, batch_id)  # one row per column

    return work


def drift_gate_job(
    path: str, reference: Reference, settings: DriftGateSettings | None = None
) -> Callable[[DataFrame, int], None]:
    """PSI, or the p-value of KS, of every batch against what is stored of the reference."""
    s = settings or DriftGateSettings()

    def work(batch: DataFrame, batch_id: int) -> None:
        scores, moved = reference.verdict(batch, s)
        rows = [(c, float(v), c in moved) for c, v in scores.items()]
        score = "psi" if s.method == "psi" else "ks_p_value"
        made = batch.sparkSession.createDataFrame(rows, f"column string, {score} double, drifted boolean")
        _put(made.coalesce(1), path, batch_id)

    return work
