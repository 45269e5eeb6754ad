"""Quality gates: null rates, schema contract, distribution drift.

A gate reads a DataFrame through one or two aggregates and returns a ``GateResult`` whose size is
bounded by the number of columns. Adding a gate means writing a class with ``name`` and ``evaluate``.
"""

from __future__ import annotations

import json
import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any, Protocol

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from assayer.functions.columns import missing, number, numeric_columns, quoted
from assayer.functions.distance import SLICES, ks_distances
from assayer.functions.quantiles import exact_quantiles
from assayer.functions.special import kolmogorov_p
from assayer.settings import (
    DriftGateSettings,
    NullGateSettings,
    SchemaGateSettings,
    Settings,
)

PSI_FLOOR = 1e-6  # fixed value: smallest share used in the stability index
RESULT_SCHEMA = "gate_name string, passed boolean, reason string, details string"


@dataclass(frozen=True)
class GateResult:
    gate_name: str
    passed: bool
    reason: str | None = None
    details: dict[str, Any] = field(default_factory=dict)

    def as_row(self) -> tuple:
        return (self.gate_name, self.passed, self.reason, json.dumps(self.details, sort_keys=True))


class Gate(Protocol):
    name: str

    def evaluate(
        self,
        df: DataFrame,
        *,
        expected_schema: Mapping[str, str] | None = None,
        reference: DataFrame | None = None,
    ) -> GateResult: ...


# ---- null rates


def null_rates(df: DataFrame) -> DataFrame:
    """(column, n_rows, n_missing, null_rate) from one aggregate over the table."""
    counts = df.agg(
        F.count("*").alias("_rows"),
        *(F.count_if(missing(df, c)).alias(f"_m{i}") for i, c in enumerate(df.columns)),
    )
    long = F.array(
        *(
            F.struct(F.lit(c).alias("column"), F.col(f"_m{i}").alias("n_missing"))
            for i, c in enumerate(df.columns)
        )
    )
    return counts.select(F.col("_rows").alias("n_rows"), F.inline(long)).select(
        "column",
        "n_rows",
        "n_missing",
        F.try_divide(F.col("n_missing"), F.col("n_rows")).alias("null_rate"),
    )


def null_rate_overall(df: DataFrame) -> DataFrame:
    """One row (n_rows, n_missing, null_rate): missing cells over all cells."""
    return null_rates(df).agg(
        F.max("n_rows").alias("n_rows"),
        F.sum("n_missing").alias("n_missing"),
        F.try_divide(F.sum("n_missing"), F.max("n_rows") * F.count("*")).alias("null_rate"),
    )


class NullRateGate:
    name = "max_null_rate_gate"

    def __init__(self, settings: NullGateSettings | None = None):
        self.settings = settings or NullGateSettings()

    def evaluate(self, df, *, expected_schema=None, reference=None) -> GateResult:
        limit = self.settings.threshold
        rows = null_rates(df).collect()  # one row per column
        if not rows or rows[0]["n_rows"] == 0:
            return GateResult(self.name, False, "the dataset holds no rows")
        if self.settings.per_column:
            rates = {r["column"]: r["null_rate"] for r in rows}
            over = {c: v for c, v in rates.items() if v > limit}
            details: dict[str, Any] = {"null_rates": rates}
            if over:
                details["offending_columns"] = over
                reason = f"null rate above {limit} in: {', '.join(over)}"
                return GateResult(self.name, False, reason, details)
            return GateResult(self.name, True, None, details)
        cells = rows[0]["n_rows"] * len(rows)
        rate = sum(r["n_missing"] for r in rows) / cells
        reason = f"overall null rate {rate:.4f} is above {limit}" if rate > limit else None
        return GateResult(self.name, reason is None, reason, {"overall_null_rate": rate})


# ---- schema contract


def schema_of(df: DataFrame) -> dict[str, str]:
    return {f.name: f.dataType.simpleString() for f in df.schema}


def schema_diff(df: DataFrame, expected: Mapping[str, str]) -> list[tuple]:
    """(column, status, expected_type, actual_type); status ok, missing, extra or mismatch."""
    actual = schema_of(df)
    out = []
    for name in sorted(set(expected) | set(actual)):
        want, got = expected.get(name), actual.get(name)
        if got is None:
            status = "missing"
        elif want is None:
            status = "extra"
        else:
            status = "ok" if want == got else "mismatch"
        out.append((name, status, want, got))
    return out


class SchemaGate:
    name = "schema_conformance_gate"

    def __init__(self, settings: SchemaGateSettings | None = None):
        self.settings = settings or SchemaGateSettings()

    def evaluate(self, df, *, expected_schema=None, reference=None) -> GateResult:
        if not expected_schema:
            return GateResult(self.name, False, "no expected schema was given")
        diff = schema_diff(df, expected_schema)
        named = {
            status: [d[0] for d in diff if d[1] == status] for status in ("missing", "extra")
        }
        wrong = {
            d[0]: {"expected": d[2], "actual": d[3]}
            for d in diff
            if d[1] == "mismatch" and self.settings.strict_dtypes
        }
        faults = []
        if named["missing"]:
            faults.append(f"columns not found: {named['missing']}")
        if named["extra"] and not self.settings.allow_extra_columns:
            faults.append(f"columns not in the contract: {named['extra']}")
        if wrong:
            faults.append(f"columns of another type: {sorted(wrong)}")
        details = {
            "missing_columns": named["missing"],
            "extra_columns": named["extra"],
            "dtype_mismatches": wrong,
        }
        return GateResult(self.name, not faults, "; ".join(faults) or None, details)


# ---- drift


def reference_edges(
    reference: DataFrame, columns: Sequence[str], bins: int
) -> dict[str, list[float] | None]:
    """Distinct quantile edges per column; None for a column without values."""
    marks = [i / bins for i in range(bins + 1)]
    found = exact_quantiles(reference, columns, marks)
    return {c: None if q is None else sorted(set(q)) for c, q in found.items()}


def bin_of(v: Column, edges: Sequence[float]) -> Column:
    """Bin of a value: half-open bins from 0, the last one closed; -1 outside, NULL for NULL."""

    def search(low: int, high: int) -> Column:
        """Bin between positions low and high, by bisection over the inner edges."""
        if low == high:
            return F.lit(low)
        mid = (low + high + 1) // 2
        return F.when(v >= F.lit(edges[mid]), search(mid, high)).otherwise(search(low, mid - 1))

    outside = (v < F.lit(edges[0])) | (v > F.lit(edges[-1]))
    return F.when(v.isNull(), None).when(outside, -1).otherwise(search(0, len(edges) - 2))


def bin_counts(
    df: DataFrame, edges: Mapping[str, Sequence[float]], by: Sequence[str] = ()
) -> DataFrame:
    """(*by, column position, bin, n) for present values; combines map-side to columns x bins rows."""
    # a projection of its own, so that each number is made once and not once per edge
    plain = df.select(*map(quoted, by), *(number(df, c).alias(f"_v{i}") for i, c in enumerate(edges)))
    cells = F.array(
        *(
            F.struct(F.lit(i).alias("column"), bin_of(F.col(f"_v{i}"), marks).alias("bin"))
            for i, marks in enumerate(edges.values())
        )
    )
    return (
        plain.select(*map(quoted, by), F.inline(cells))
        .where("bin IS NOT NULL")
        .groupBy(*by, "column", "bin")
        .agg(F.count("*").alias("n"))
    )


def stability_shares(df: DataFrame, edges: Mapping[str, Sequence[float]]) -> dict[str, dict]:
    """Per column: total present values and the count of each bin (bounded by columns x bins)."""
    names = list(edges)
    out = {c: {"total": 0, "bins": [0] * (len(e) - 1)} for c, e in edges.items()}
    for row in bin_counts(df, edges).collect():
        mine = out[names[row["column"]]]
        mine["total"] += row["n"]
        if row["bin"] >= 0:
            mine["bins"][row["bin"]] += row["n"]
    return out


def stability_index(reference: Sequence[int], n_ref: int, current: Sequence[int], n_cur: int):
    total = 0.0
    for r, c in zip(reference, current):
        before = max(r / max(n_ref, 1), PSI_FLOOR)
        now = max(c / max(n_cur, 1), PSI_FLOOR)
        total += (now - before) * math.log(now / before)
    return total


def constant_index(value: float, mean: float) -> float:
    """Index against a reference that holds one value: none if the mean is that value, else infinite."""
    return 0.0 if abs(value - mean) <= 1e-8 + 1e-5 * abs(mean) else math.inf


def psi(
    current: DataFrame, reference: DataFrame, columns: Sequence[str], bins: int = 10
) -> dict[str, float]:
    """Population stability index per column; columns without values on a side are left out."""
    edges = reference_edges(reference, columns, bins)
    usable = {c: e for c, e in edges.items() if e is not None}
    if not usable:
        return {}
    # single-valued columns still need their count and mean
    binned = {c: e if len(e) > 1 else [e[0], e[0]] for c, e in usable.items()}
    return psi_against(current, binned, stability_shares(reference, binned))


def psi_against(current: DataFrame, edges: Mapping, reference_shares: Mapping) -> dict[str, float]:
    """As ``psi``, from stored reference edges and counts: one aggregate over ``current``."""
    now = stability_shares(current, edges)
    flat = [c for c, e in edges.items() if e[0] == e[-1]]
    means = {}
    if flat:
        row = current.agg(
            *(F.avg(number(current, c)).alias(f"m{i}") for i, c in enumerate(flat))
        ).first()
        means = {c: row[f"m{i}"] for i, c in enumerate(flat)}
    out = {}
    for c, e in edges.items():
        before = reference_shares[c]
        if now[c]["total"] == 0 or before["total"] == 0:
            continue
        if c in means:
            out[c] = constant_index(e[0], means[c])
        else:
            out[c] = stability_index(
                before["bins"], before["total"], now[c]["bins"], now[c]["total"]
            )
    return out


def ks_statistics(
    current: DataFrame, reference: DataFrame, columns: Sequence[str], slices: int = SLICES
) -> DataFrame:
    """(column, n_reference, n_current, ks_d, ks_p_value) per column with values on both sides.

    The distance is exact; only rows that may decide it are listed, and no task sees a whole column.
    """
    rows = [
        (c, n, m, d, kolmogorov_p(d, n, m))
        for c, n, m, d in ks_distances(reference, current, list(columns), slices)
    ]
    return current.sparkSession.createDataFrame(
        rows, "column string, n_reference bigint, n_current bigint, ks_d double, ks_p_value double"
    )


class DriftGate:
    name = "drift_gate"

    def __init__(self, settings: DriftGateSettings | None = None):
        self.settings = settings or DriftGateSettings()

    def evaluate(self, df, *, expected_schema=None, reference=None) -> GateResult:
        if reference is None or reference.isEmpty():
            return GateResult(self.name, False, "no reference rows to compare with")
        shared = [c for c in numeric_columns(df) if c in reference.columns]
        if not shared:
            return GateResult(self.name, False, "no numeric column is shared with the reference")
        s = self.settings
        if s.method == "psi":
            scores = psi(df, reference, shared, s.psi_bins)
            drifted = [c for c, v in scores.items() if v > s.psi_threshold]
            per_column = {c: {"psi": v} for c, v in scores.items()}
        else:
            per_column = {}
            for r in ks_statistics(df, reference, shared).collect():  # one row per column
                per_column[r["column"]] = {"ks_p_value": r["ks_p_value"], "ks_d": r["ks_d"]}
            drifted = [
                c
                for c in shared
                if c in per_column and per_column[c]["ks_p_value"] < s.ks_p_value_threshold
            ]
        details = {"per_column": per_column, "n_columns_compared": len(per_column)}
        if drifted:
            details["drifted_columns"] = drifted
            return GateResult(self.name, False, f"{s.method} drift in: {drifted}", details)
        return GateResult(self.name, True, None, details)


# ---- chain


def build_gates(settings: Settings) -> list[Gate]:
    """The enabled gates in their fixed order: null rates, schema, drift."""
    made = [
        (settings.max_null_rate_gate, NullRateGate),
        (settings.schema_conformance_gate, SchemaGate),
        (settings.drift_gate, DriftGate),
    ]
    return [kind(part) for part, kind in made if part.enabled]


@dataclass(frozen=True)
class ChainResult:
    results: list[GateResult]

    @property
    def passed(self) -> bool:
        return all(r.passed for r in self.results)

    @property
    def failures(self) -> list[GateResult]:
        return [r for r in self.results if not r.passed]

    def as_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([r.as_row() for r in self.results], RESULT_SCHEMA)


def run_gates(
    gates: Sequence[Gate],
    df: DataFrame,
    *,
    expected_schema: Mapping[str, str] | None = None,
    reference: DataFrame | None = None,
) -> ChainResult:
    """Every gate is evaluated, also after a failure."""
    return ChainResult(
        [g.evaluate(df, expected_schema=expected_schema, reference=reference) for g in gates]
    )


def gate_failures(results: DataFrame) -> DataFrame:
    return results.where(~F.col("passed"))
