"""Outlier scores that keep every row: isolation forest, local outlier factor, quartile fences."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from assayer.functions.columns import missing, number, numeric_columns, quoted
from assayer.functions.cutting import checkpointed
from assayer.functions.quantiles import exact_quantiles
from assayer.functions.spreading import spread
from assayer.operators.neighbors import distinct_points, nearest
from assayer.settings import OutlierSettings

# Names of the added columns.
SCORE = "_anomaly_score"
FLAG = "_is_outlier"

ROWS_PER_TREE = 256  # fixed value of the method
EULER = 0.5772156649015329


@dataclass(frozen=True)
class Scored:
    df: DataFrame
    params: dict[str, Any]
    diagnostics: dict[str, Any] = field(default_factory=dict)


# ---- quartile fences


def iqr_fences(df: DataFrame, columns: Sequence[str], k: float = 1.5) -> dict[str, tuple]:
    quartiles = exact_quantiles(df, columns, [0.25, 0.75])
    return {
        c: (q[0] - k * (q[1] - q[0]), q[1] + k * (q[1] - q[0]))
        for c, q in quartiles.items()
        if q is not None
    }


def iqr_flag(df: DataFrame, columns: Sequence[str], k: float = 1.5) -> Column:
    """True where any column lies outside its fences."""
    tests = []
    for c, (low, high) in iqr_fences(df, columns, k).items():
        v = number(df, c)
        tests.append(F.coalesce((v < low) | (v > high), F.lit(False)))
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def iqr_false_positive_rate(df: DataFrame, columns: Sequence[str], k: float = 1.5) -> DataFrame:
    return df.agg(F.avg(iqr_flag(df, columns, k).cast("double")).alias("false_positive_rate"))


# ---- thresholds


def contamination_cut(
    df: DataFrame, score: str, contamination: float, shift: bool = False
) -> DataFrame:
    """Flag scores above their (1 - contamination) quantile; optionally move the cut to zero."""
    return contamination_cuts(df, score, [contamination], shift)[0]


def contamination_cuts(df: DataFrame, score: str, contaminations: Sequence[float], shift: bool = False) -> list[DataFrame]:
    """``contamination_cut`` at each of the contaminations; their quantiles are found together."""
    cuts = exact_quantiles(df, [score], [1 - c for c in contaminations])[score]
    if cuts is None:
        raise ValueError(f"no values in score column {score!r}")
    return [
        df.withColumn(FLAG, F.col(score) > F.lit(cut)).withColumn(SCORE, F.col(score) - F.lit(cut) if shift else F.col(score))
        for cut in cuts
    ]


def flag_summary(df: DataFrame) -> DataFrame:
    """One row (n_rows, n_flagged, flag_rate)."""
    return df.agg(
        F.count("*").alias("n_rows"),
        F.count_if(F.col(FLAG)).alias("n_flagged"),
        F.try_divide(F.count_if(F.col(FLAG)), F.count("*")).alias("flag_rate"),
    )


def drop_flagged(df: DataFrame) -> DataFrame:
    """Rows not flagged; all rows when fewer than max(10, half of them) would stay."""
    c = flag_summary(df).first()
    kept = c["n_rows"] - c["n_flagged"]
    if kept < max(10, c["n_rows"] // 2):
        return df
    return df.where(~F.col(FLAG))


# ---- isolation forest


def _usual_depth(n: np.ndarray) -> np.ndarray:
    """Mean path length of an unsuccessful search in a binary tree of n rows."""
    n = np.asarray(n, dtype=float)
    out = np.where(n == 2, 1.0, 0.0)
    big = n > 2
    m = np.where(big, n, 3.0)
    return np.where(big, 2 * (np.log(m - 1) + EULER) - 2 * (m - 1) / m, out)


def _plant(block: np.ndarray, tree: int, seed: int) -> list[tuple]:
    """Nodes (tree, node, dim, cut, low, high, path) of one random tree; leaves have dim -1."""
    rng = np.random.default_rng([seed, tree])
    limit = math.ceil(math.log2(max(len(block), 2)))
    nodes: list = []

    def add(rows: np.ndarray, depth: int) -> int:
        at = len(nodes)
        nodes.append(None)
        spread = np.ptp(rows, axis=0) if len(rows) else np.zeros(block.shape[1])
        open_dims = np.flatnonzero(spread > 0)
        if depth >= limit or len(rows) <= 1 or not len(open_dims):
            nodes[at] = (tree, at, -1, 0.0, -1, -1, depth + float(_usual_depth(len(rows))))
            return at
        dim = int(rng.choice(open_dims))
        low, high = rows[:, dim].min(), rows[:, dim].max()
        cut = float(rng.uniform(low, high))
        left = add(rows[rows[:, dim] <= cut], depth + 1)
        right = add(rows[rows[:, dim] > cut], depth + 1)
        nodes[at] = (tree, at, dim, cut, left, right, 0.0)
        return at

    add(block, 0)
    return nodes


def _levels(low: np.ndarray, high: np.ndarray) -> int:
    depth = np.zeros(len(low), dtype=int)
    for i in range(len(low)):  # children come after their parent
        for child in (low[i], high[i]):
            if child >= 0:
                depth[child] = depth[i] + 1
    return int(depth.max())


def isolation_forest(
    df: DataFrame,
    columns: Sequence[str],
    n_trees: int = 100,
    contamination: float = 0.05,
    seed: int = 0,
    id_column: str | None = None,
) -> DataFrame:
    """Adds the score (0 at the cut, higher is worse) and the flag."""
    return contamination_cut(isolation_scores(df, columns, n_trees, seed, id_column), SCORE, contamination, shift=True)


def isolation_scores(
    df: DataFrame, columns: Sequence[str], n_trees: int = 100, seed: int = 0, id_column: str | None = None
) -> DataFrame:
    """``df`` with the score of every row, before any cut.

    The method grows each tree on at most 256 rows: about twice as many as all trees need pass a
    random filter at the scan, trees are grown in parallel, and the node table (trees x 511 rows at most) goes to every task for scoring.
    """
    wanted = n_trees * ROWS_PER_TREE
    n = df.count()
    # a uniform draw per row: by id hash, the same in every layout, or by a seeded generator
    draw = (
        F.pmod(F.xxhash64(F.col(id_column), F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
        if id_column
        else F.rand(seed)
    )
    pool = (
        df.select(F.array(*(number(df, c) for c in columns)).alias("point"), draw.alias("_h"))
        .where(F.col("_h") < min(1.0, 2.0 * wanted / max(n, 1)))
        .orderBy("_h")
        .limit(wanted)
    )
    pool = checkpointed(pool)
    n_pool = pool.count()
    per_tree = min(ROWS_PER_TREE, n_pool)
    # every pool row tries every tree: bounded by trees x 256 x trees
    share = min(1.0, 4.0 * per_tree / max(n_pool, 1))
    tries = (
        pool.withColumn("_n", F.monotonically_increasing_id())
        .withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(n_trees - 1))))
        .withColumn("_d", F.pmod(F.xxhash64("_h", "tree", F.lit(seed)), F.lit(1 << 30)))
        .where(F.col("_d") < F.lit(int(share * (1 << 30)) + 1))
    )

    def plant(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values(["_d", "_h"]).head(per_tree)
        block = np.vstack(rows["point"].to_numpy())
        return pd.DataFrame(
            _plant(block, int(key[0]), seed),
            columns=["tree", "node", "dim", "cut", "low", "high", "path"],
        )

    nodes = (
        tries.groupBy("tree")
        .applyInPandas(
            plant, "tree int, node int, dim int, cut double, low int, high int, path double"
        )
        .toPandas()  # n_trees x 511 rows at most
    )
    trees = []
    for _, part in nodes.groupby("tree"):
        part = part.sort_values("node")
        dim, low, high = (part[c].to_numpy(dtype=np.int32) for c in ("dim", "low", "high"))
        end = dim < 0
        # a finished row stays at its leaf, so every row takes the same number of steps
        here = np.arange(len(part), dtype=np.int32)
        depth = _levels(low, high)
        trees.append(
            (np.where(end, 0, dim), part["cut"].to_numpy(), np.where(end, here, low),
             np.where(end, here, high), part["path"].to_numpy(), depth)
        )
    forest = df.sparkSession.sparkContext.broadcast(trees)
    norm = float(_usual_depth(np.array([per_tree]))[0]) or 1.0

    @F.pandas_udf(T.DoubleType())
    def score(*values: pd.Series) -> pd.Series:
        n = len(values[0])
        total = np.zeros(n)
        step = 4096  # rows whose state stays in cache
        for start in range(0, n, step):
            cells = np.concatenate([v.to_numpy(dtype=float)[start : start + step] for v in values])
            rows = len(cells) // len(values)
            row = np.arange(rows, dtype=np.int32)
            for dim, cut, low, high, path, depth in forest.value:
                at = np.zeros(rows, dtype=np.int32)
                for _ in range(depth):
                    value = cells.take(dim.take(at) * rows + row)
                    at = np.where(value <= cut.take(at), low.take(at), high.take(at))
                total[start : start + step] += path.take(at)
        return pd.Series(np.power(2.0, -total / (len(forest.value) * norm)))

    scored = spread(df, n).withColumn(SCORE, score(*(number(df, c) for c in columns)))
    return checkpointed(scored)  # scores are read once for the cut and once for the result


# ---- local outlier factor


def lof_scores(
    df: DataFrame, id_column: str, columns: Sequence[str], k: int = 20, **bounds
) -> DataFrame:
    """``df`` with the local outlier factor of every row.

    Rows with equal coordinates have equal factors, so each distinct point is computed once.
    """
    n = df.count()
    k = min(k, n - 1)
    if k < 1:
        raise ValueError("the local outlier factor needs at least two rows")
    donors = checkpointed(distinct_points(spread(df.select(quoted(id_column), *map(quoted, columns)), n), id_column, columns, k + 1))
    receivers = donors.where(F.col("id") == F.col("rep")).select("id", "point")
    # the point itself has the smallest id at distance zero: rank 1
    pairs = checkpointed(
        nearest(receivers, donors, len(columns), k + 1, n_rows=n, **bounds)
        .where(F.col("rank") > 1)
        .select("rid", "rep", "dist")
    )
    reach = pairs.groupBy("rid").agg(F.max("dist").alias("k_dist"))
    density = (
        pairs.join(reach.withColumnRenamed("rid", "rep"), "rep")
        .groupBy("rid")
        .agg((1.0 / (F.avg(F.greatest("dist", "k_dist")) + 1e-10)).alias("density"))
    )
    density = checkpointed(density)
    around = (
        pairs.join(density.withColumnRenamed("rid", "rep"), "rep")
        .groupBy("rid")
        .agg(F.avg("density").alias("around"))
    )
    factor = around.join(density, "rid").select(
        F.col("rid"), (F.col("around") / F.col("density")).alias(SCORE)
    )
    points = receivers.join(factor, receivers["id"] == factor["rid"]).select("point", SCORE)
    own = F.array(*(F.coalesce(number(df, c), F.lit(math.nan)) for c in columns))
    return (
        df.withColumn("_own", own)
        .join(points, F.col("_own") == F.col("point"), "left")
        .drop("_own", "point")
    )


# ---- router


def assert_imputed(df: DataFrame, columns: Sequence[str]) -> None:
    row = df.agg(
        F.count("*").alias("n"), *(F.count_if(missing(df, c)).alias(f"m{i}") for i, c in enumerate(columns))
    ).first()
    if row["n"] == 0:
        raise ValueError("cannot look for outliers in a table without rows")
    gone = [c for i, c in enumerate(columns) if row[f"m{i}"]]
    if gone:
        raise ValueError(f"impute before scoring outliers; cells are missing in: {gone}")


def detect_outliers(
    df: DataFrame,
    settings: OutlierSettings | None = None,
    *,
    seed: int | None = None,
    id_column: str | None = None,
    columns: Sequence[str] | None = None,
) -> Scored:
    """Every row with its score and flag; ``id_column`` is never used as a feature.

    Without ``columns`` all numeric ones are.
    """
    s = settings or OutlierSettings()
    return detect_at(df, s, [s.contamination], seed=seed, id_column=id_column, columns=columns)[0]


def detect_at(
    df: DataFrame,
    s: OutlierSettings,
    contaminations: Sequence[float],
    *,
    seed: int | None = None,
    id_column: str | None = None,
    columns: Sequence[str] | None = None,
) -> list[Scored]:
    """``detect_outliers`` at each of the contaminations instead of the settings' own; rows are scored once."""
    columns = [c for c in numeric_columns(df) if c != id_column and (columns is None or c in columns)]
    assert_imputed(df, columns)
    params = {
        "method": s.method,
        "contamination": s.contamination,
        "n_estimators": s.n_estimators,
        "lof_n_neighbors": s.lof_n_neighbors,
        "seed": seed,
        "numeric_columns": columns,
    }
    about: dict[str, Any] = {"method": s.method, "numeric_columns_used": columns}
    if s.method == "none" or not columns:
        about.update(n_flagged=0, reason=None if columns else "no numeric columns")
        return [Scored(outliers_none(df), params | {"contamination": c}, about) for c in contaminations]
    if s.method == "isolation_forest":
        scored = isolation_scores(df, columns, s.n_estimators, seed or 0, id_column)
    else:
        if id_column is None:
            raise ValueError("the local outlier factor needs id_column to order equal distances")
        scored = checkpointed(lof_scores(df, id_column, columns, s.lof_n_neighbors))
    out = []
    for c, cut in zip(contaminations, contamination_cuts(scored, SCORE, contaminations, shift=s.method == "isolation_forest")):
        row = flag_summary(cut).first()
        flagged = {"contamination": c, "n_flagged": row["n_flagged"], "flag_rate": row["flag_rate"]}
        out.append(Scored(cut, params | {"contamination": c}, about | flagged))
    return out


def outliers_none(df: DataFrame) -> DataFrame:
    return df.withColumn(SCORE, F.lit(0.0)).withColumn(FLAG, F.lit(False))
