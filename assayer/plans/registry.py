"""Queries over the shared tables, each next to the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from assayer.functions.columns import MIX_DIGITS, MIX_MODULUS
from assayer.functions.shipping import ship

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def r6(col: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(col) if isinstance(col, str) else col, digits)


def mix_sql(key: str, seed: int = 0) -> str:
    return f"('0x' || substr(md5(({key})::VARCHAR || ':{seed // 3}'), {1 + seed % 3 * MIX_DIGITS}, {MIX_DIGITS}))::BIGINT"


def holed_sql(source: str, key: str, rates: Sequence[tuple[str, float, int]], columns: Sequence[str]) -> str:
    """SELECT of ``columns`` with cells of the named ones blanked at the given rate and seed."""
    cut = {c: (int(rate * MIX_MODULUS) + 1, seed) for c, rate, seed in rates}
    cells = [
        f"CASE WHEN {mix_sql(key, cut[c][1])} < {cut[c][0]} THEN NULL ELSE {c} END AS {c}" if c in cut else c
        for c in columns
    ]
    return f"SELECT {', '.join(cells)} FROM {source}"


def psi_sql(reference: str, current: str, columns: Sequence[str], bins: int = 10) -> str:
    """SELECT "column", psi for each column; both arguments are table expressions."""
    marks = ", ".join(str(i / bins) for i in range(bins + 1))
    parts = []
    for c in columns:
        parts.append(f"""
        SELECT '{c}' AS "column", sum((cp - rp) * ln(cp / rp)) AS psi FROM (
          SELECT b.i,
            greatest((SELECT count(*) FROM {reference} r WHERE r.{c} >= b.lo AND (r.{c} < b.hi OR (b.last AND r.{c} = b.hi)))
              / (SELECT count({c}) FROM {reference})::DOUBLE, 1e-6) AS rp,
            greatest((SELECT count(*) FROM {current} r WHERE r.{c} >= b.lo AND (r.{c} < b.hi OR (b.last AND r.{c} = b.hi)))
              / (SELECT count({c}) FROM {current})::DOUBLE, 1e-6) AS cp
          FROM (SELECT i, e AS lo, lead(e) OVER (ORDER BY e) AS hi,
                       i = max(i) OVER () - 1 AS last
                FROM (SELECT e, row_number() OVER (ORDER BY e) AS i
                      FROM (SELECT DISTINCT unnest(quantile_cont({c}, [{marks}])) AS e FROM {reference}))) b
          WHERE b.hi IS NOT NULL)""")
    return " UNION ALL ".join(parts)
