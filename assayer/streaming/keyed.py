"""Drift-triggered adaptation with its state kept by the engine.

Rows of a stream are summarised by event-time window and key inside streaming aggregates: counts, cross-products, and
mergeable quantile sketches that combine over tasks and micro-batches. A window that the watermark has passed goes, as one row, to a
stateful processor of its key, which holds mask, head, counters and the summary of the batch last adapted to. State
is versioned with the micro-batches, so a micro-batch that is run again starts from the state before it. Rows that come
again after their window has closed are late and change nothing; a window not after the last one counted is passed
over. Nothing reads earlier output, and the state of a key has the same size whatever the rows.

Up to ``EXACT`` values a summary gives all of them back, and the verdict is exact. Beyond, the share of rows below a value
is known to within ``RANK_ERROR`` in either summary. A verdict that this much could turn is marked ``uncertain``;
``operators.adapt.adaptive_step`` decides such a batch exactly from its rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StringType, StructField, StructType

from assayer.functions.columns import number, quoted
from assayer.functions.special import kolmogorov_p
from assayer.operators.adapt import Moments, adapted_mse_fitness, feature_subset_search
from assayer.operators.gates import constant_index, stability_index
from assayer.settings import AdaptSettings, DriftGateSettings, MaskSearchSettings

#: Quantiles kept of each column and window.
MARKS = 1024
SKETCH = 4096
#: A step between marks, and the sketch's own rank error at its size.
RANK_ERROR = 1 / MARKS + 0.0007
EXACT = MARKS // 2

OUT = (
    "key string, batch timestamp, n_rows long, drift_detected boolean, uncertain boolean, n_adaptations int, n_batches_seen int, "
    "mask array<boolean>, head array<double>, fitness double"
)
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """The state store that keyed processors need, for queries started inside."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def window_summaries(
    stream: DataFrame, ts: str, key: str, features: Sequence[str], target: str, width: str = "1 day", lateness: str = "1 hour"
) -> DataFrame:
    """(key, batch, n_rows, gram, sketched, n_values): one row for each closed window and key with rows."""
    cells = [number(stream, c).cast("double") for c in (*features, target)]
    named = stream.select(
        quoted(key).cast("string").alias("key"), quoted(ts).cast("timestamp").alias("_ts"), *(c.alias(f"_c{i}") for i, c in enumerate(cells))
    ).withWatermark("_ts", lateness)
    z = [F.lit(1.0), *(F.col(f"_c{i}") for i in range(len(cells)))]
    whole = F.expr(" and ".join(f"_c{i} is not null" for i in range(len(cells))))
    pairs = [(i, j) for i in range(len(z)) for j in range(i, len(z))]
    sums = [F.coalesce(F.sum(F.when(whole, z[i] * z[j])), F.lit(0.0)).alias(f"_g{n}") for n, (i, j) in enumerate(pairs)]
    sketches = [F.kll_sketch_agg_double(f"_c{i}", F.lit(SKETCH)).alias(f"_s{i}") for i in range(len(features))]
    counts = [F.count(f"_c{i}").alias(f"_n{i}") for i in range(len(features))]
    made = named.groupBy("key", F.window("_ts", width).alias("_w")).agg(F.count("*").alias("n_rows"), *sums, *sketches, *counts)
    marks = F.expr("array(" + ", ".join(f"{i / MARKS!r}D" for i in range(MARKS + 1)) + ")")
    empty = F.expr("cast(array() as array<double>)")
    return made.select(
        "key", F.col("_w.start").alias("batch"), "n_rows", F.array(*(f"_g{n}" for n in range(len(pairs)))).alias("gram"),
        F.array(*(
            F.when(F.col(f"_n{i}") > 0, F.kll_sketch_get_quantile_double(f"_s{i}", marks)).otherwise(empty) for i in range(len(features))
        )).alias("sketched"),
        F.array(*(f"_n{i}" for i in range(len(features)))).alias("n_values"),
    )


class Summary:
    """What is known of a column's distribution: ``n`` values by their quantiles."""

    def __init__(self, marks: Sequence[float], n: int):
        self.n, self.exact = n, n <= EXACT
        self.values = np.asarray(marks, float)
        if self.exact:
            self.values = self.values[np.rint((np.arange(n) + 0.5) / n * MARKS).astype(int)]

    def below(self, at: np.ndarray, side: str) -> np.ndarray:
        """Share of the rows below ``at``, or, from the right, at most that."""
        found = np.searchsorted(self.values, at, side)
        return found / self.n if self.exact else np.clip((found - 0.5) / MARKS, 0, 1)

    def edges(self, bins: int) -> np.ndarray:
        return np.unique(np.quantile(self.values, np.linspace(0, 1, bins + 1)))

    def psi(self, now: Summary, bins: int) -> float:
        """Stability index of later rows."""
        edges = self.edges(bins)
        if len(edges) == 1:
            return constant_index(float(edges[0]), float(now.values.mean()))
        shares = []
        for side in (self, now):
            low = side.below(edges, "left")
            low[-1] = side.below(edges[-1:], "right")[0]
            if not side.exact:
                low[0] = 0.0 if side.values[0] >= edges[0] else low[0]
                low[-1] = 1.0 if side.values[-1] <= edges[-1] else low[-1]
            shares.append(np.maximum(np.diff(low), 0))
        return stability_index(shares[0], 1, shares[1], 1)

    def distance(self, now: Summary) -> float:
        """Kolmogorov-Smirnov distance from later rows."""
        points = np.union1d(self.values, now.values)
        return float(np.abs(self.below(points, "right") - now.below(points, "right")).max())


def drift_verdict(before: dict, now: dict, drift: DriftGateSettings) -> tuple[bool, bool]:
    """(drifted, whether the errors of the summaries could turn that) over the columns that have values on both sides."""
    surely, likely, possibly = False, False, False
    for a, n, b, m in zip(before["sketched"], before["n_values"], now["sketched"], now["n_values"]):
        if not n or not m:
            continue
        a, b = Summary(a, n), Summary(b, m)
        error = (not a.exact) * RANK_ERROR + (not b.exact) * RANK_ERROR
        if drift.method == "psi":
            score = a.psi(b, drift.psi_bins)
            # A share is off by ``error`` at both of its ends; the index moves by about the logarithm of the shares' ratio for it.
            off = 2 * error * drift.psi_bins * max(1.0, float(np.sqrt(score))) if np.isfinite(score) else 0.0
            found = [score - off > drift.psi_threshold, score > drift.psi_threshold, score + off > drift.psi_threshold]
        else:
            d = a.distance(b)
            found = [kolmogorov_p(x, n, m) < drift.ks_p_value_threshold for x in (max(0.0, d - error), d, min(1.0, d + error))]
        surely, likely, possibly = surely | found[0], likely | found[1], possibly | found[2]
    return bool(likely), bool(possibly and not surely)


class AdaptiveProcessor(StatefulProcessor):
    """One key's adaptation: a value state with mask, head, counters and the reference summary."""

    def __init__(
        self, features: Sequence[str], start: np.ndarray, drift: DriftGateSettings, masks: MaskSearchSettings, adapt: AdaptSettings, seed: int
    ):
        self.features, self.start, self.seed = list(features), np.asarray(start, float), seed
        self.drift, self.masks, self.adapt = drift, masks, adapt

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("adaptation", StructType([StructField("text", StringType())]))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        parts = [p for p in rows if len(p)]
        if not parts:
            return
        state = json.loads(self.held.get()[0]) if self.held.exists() else None
        out = []
        for row in pd.concat(parts).sort_values("batch", kind="stable").to_dict("records"):
            at = row["batch"].isoformat()
            if state and at <= state["last"]:
                continue
            now = {"sketched": [list(map(float, s)) for s in row["sketched"]], "n_values": [int(n) for n in row["n_values"]]}
            state, line = self._step(state, at, row["gram"], now)
            out.append({"key": key[0], "batch": row["batch"], "n_rows": row["n_rows"], **line})
        if state:
            self.held.update((json.dumps(state),))
        if out:
            yield pd.DataFrame(out)

    def _step(self, state: dict | None, at: str, gram: Sequence[float], now: dict) -> tuple[dict, dict]:
        drifted, uncertain = drift_verdict(state["reference"], now, self.drift) if state else (True, False)
        seen = state["seen"] + 1 if state else 1
        fitness = None
        # A window without one whole row cannot be adapted to; it only counts as seen.
        if drifted and gram[0] > 0:
            m = Moments.of(np.asarray(gram, float))
            found = feature_subset_search(len(self.features), adapted_mse_fitness(m, self.start, self.adapt), self.masks, self.seed)
            head = m.masked(found.mask).step(self.start, self.adapt.inner_lr, self.adapt.adapt_steps)
            fitness = float(found.fitness)
            state = {
                "mask": [bool(x) for x in found.mask], "head": [float(x) for x in head], "reference": now,
                "adaptations": (state["adaptations"] if state else 0) + 1,
            }
        elif state is None:
            state = {"mask": [True] * len(self.features), "head": self.start.tolist(), "reference": now, "adaptations": 0}
        state = {**state, "seen": seen, "last": at}
        line = {
            "drift_detected": drifted, "uncertain": uncertain, "n_adaptations": state["adaptations"], "n_batches_seen": seen,
            "mask": state["mask"], "head": state["head"], "fitness": fitness,
        }
        return state, line

    def close(self) -> None:
        pass


def adaptive_stream(
    stream: DataFrame, ts: str, key: str, features: Sequence[str], target: str, start: np.ndarray, *, width: str = "1 day",
    lateness: str = "1 hour", drift: DriftGateSettings | None = None, masks: MaskSearchSettings | None = None,
    adapt: AdaptSettings | None = None, seed: int = 0,
) -> DataFrame:
    """A row for each closed window of each key, in order; start the query inside ``keyed_state``."""
    if not features:
        raise ValueError("the adaptive step needs at least one numeric column")
    processor = AdaptiveProcessor(features, start, drift or DriftGateSettings(), masks or MaskSearchSettings(), adapt or AdaptSettings(), seed)
    summaries = window_summaries(stream, ts, key, features, target, width, lateness)
    return summaries.groupBy("key").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=OUT, outputMode="Append", timeMode="None"
    )


def stage(df: DataFrame, ts: str, folder: str, slices: int = 12, close_after: str = "3 days") -> None:
    """Write ``df`` as a stream's files: ``slices`` of time, one after the other, and a last one whose single row lies
    ``close_after`` the end, so that every window of the others closes. That row has nulls elsewhere."""
    times = df.select(F.min(ts).alias("a"), F.max(ts).alias("b")).first()
    if times["a"] is None:
        return
    spark = df.sparkSession
    low, span = (F.unix_micros(F.lit(times["a"]).cast("timestamp")), max(1, int((times["b"] - times["a"]).total_seconds() * 1e6) + 1))
    number_ = F.least(F.lit(slices - 1), F.floor((F.unix_micros(quoted(ts).cast("timestamp")) - low) * slices / span)).cast("int")
    df.withColumn("_slice", F.coalesce(number_, F.lit(0))).write.partitionBy("_slice").parquet(f"{folder}-slices")
    for i in range(slices):
        part = spark.read.schema(df.schema).parquet(f"{folder}-slices/_slice={i}") if _there(spark, f"{folder}-slices/_slice={i}") else None
        if part is not None:
            part.coalesce(1).write.mode("append").parquet(folder)
    end = F.lit(times["b"]) + F.expr(f"interval {close_after}")
    last = spark.range(1).select(*(
        (end if f.name == ts else F.lit(None)).cast(f.dataType).alias(f.name) for f in df.schema.fields
    ))
    for _ in range(2):  # the second brings the micro-batch in which what the first closed is emitted
        last.write.mode("append").parquet(folder)


def _there(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
