"""Kolmogorov-Smirnov distance of two tables' columns, exact, by branch and bound on counts in slices of values.

A mergeable quantile sketch of both sides gives cut points; where they lie does not matter for the result. One pass counts
the rows of each side in every slice. The gap between the distribution functions is then exact at all cuts, and inside
a slice it cannot pass what its own rows allow, so most slices are out. Only the rows of slices that may still hold
the maximum go on: they are cut again, or listed by value once they are few. A slice with rows of one side
alone, or of one value, is done, since the gap moves one way in it.

A ``Grid`` keeps the cuts and counts of one side. Against later rows it bounds the distance from both sides by one pass, its
size does not depend on rows, and grids with the same cuts add up.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window, functions as F

from assayer.functions.columns import number, quoted

SLICES = 2048
LIST_ROWS = 100_000
#: Items a sketch keeps for its largest level; the ranks of cuts are off by less than one in a thousand.
SKETCH = 4096


@dataclass(frozen=True)
class _Slice:
    low: float  # least and greatest value inside
    high: float
    first: int  # rows of each side below the slice, and inside it
    second: int
    inside: tuple[int, int]


def cut_points(df: DataFrame, columns: Sequence[str], slices: int = SLICES) -> list[list[float]]:
    """Increasing cuts for each of the plain double ``columns``, from one sketch a column; none without values."""
    marks = F.expr("array(" + ", ".join(f"{i / slices!r}D" for i in range(1, slices)) + ")")
    made = df.agg(*(F.kll_sketch_agg_double(quoted(c), F.lit(SKETCH)).alias(f"s{i}") for i, c in enumerate(columns)))
    row = made.select(*(
        F.when(F.kll_sketch_get_n_double(f"s{i}") > 0, F.kll_sketch_get_quantile_double(f"s{i}", marks)).alias(f"q{i}")
        for i in range(len(columns))
    )).first()
    out = []
    for i in range(len(columns)):
        found = [q for q in row[f"q{i}"] or [] if math.isfinite(q)]
        # A value that fills whole slices becomes a slice of its own.
        full = {a for a, b in zip(found, found[1:]) if a == b}
        out.append(sorted({*found, *(math.nextafter(a, math.inf) for a in full)}))
    return out


def _sliced(df: DataFrame, columns: Sequence[str], cuts: Sequence[Sequence[float]]) -> DataFrame:
    return Bucketizer(
        splitsArray=[[-math.inf, *(c or [0.0]), math.inf] for c in cuts], inputCols=list(columns),
        outputCols=[f"_slice{i}" for i in range(len(columns))], handleInvalid="keep",
    ).transform(df)


def _cells(sliced: DataFrame, columns: Sequence[str], by: Sequence[str]) -> DataFrame:
    """(*by, column, slice, value) of present values."""
    cells = F.array(*(
        F.struct(F.lit(i).alias("column"), F.col(f"_slice{i}").cast("int").alias("slice"), quoted(c).alias("value"))
        for i, c in enumerate(columns)
    ))
    return sliced.select(*map(quoted, by), F.inline(cells)).where("value IS NOT NULL")


def slice_counts(df: DataFrame, columns: Sequence[str], cuts: Sequence[Sequence[float]], by: Sequence[str] = ()) -> DataFrame:
    """(*by, column, slice, n, a, b): rows of each slice with their least and greatest value, combined before the shuffle."""
    cells = _cells(_sliced(df, columns, cuts), columns, by)
    return cells.groupBy(*by, "column", "slice").agg(F.count("*").alias("n"), F.min("value").alias("a"), F.max("value").alias("b"))


def plain(df: DataFrame, columns: Sequence[str], *more) -> DataFrame:
    """``more`` and the columns as doubles v0, v1, .. with missing cells null."""
    return df.select(*more, *(number(df, c).cast("double").alias(f"v{i}") for i, c in enumerate(columns)))


def _bounds(s: _Slice, n: int, m: int) -> tuple[float, float]:
    """(gap after the slice, what no gap inside can pass)."""
    r, c = s.inside
    after = abs((s.first + r) / n - (s.second + c) / m)
    most = max(abs((s.first + r) / n - s.second / m), abs(s.first / n - (s.second + c) / m))
    return after, most


def ks_distances(
    first: DataFrame, second: DataFrame, columns: Sequence[str], slices: int = SLICES, list_rows: int = LIST_ROWS
) -> list[tuple[str, int, int, float]]:
    """(column, rows of the first side, of the second, distance) for columns that have values on both sides."""
    if not columns:
        return []
    names = [f"v{i}" for i in range(len(columns))]
    both = plain(first, columns, F.lit(0).alias("side")).unionByName(plain(second, columns, F.lit(1).alias("side")))
    cuts = cut_points(both, names, slices)
    sizes, best = {}, {}
    waiting: dict[int, list[_Slice]] = {}
    for i, found in _tables(both, names, cuts).items():
        n, m = sum(c[0] for _, c, *_ in found), sum(c[1] for _, c, *_ in found)
        if n and m:
            sizes[i], best[i] = (n, m), 0.0
            waiting[i] = _walk(found, 0, 0)
    open_ = _narrow(waiting, sizes, best)
    while open_:
        held = sum(sum(s.inside) for part in open_.values() for s in part)
        columns_now = sorted(open_)
        few = [names[i] for i in columns_now]
        # Slices are told apart by their own ends; rows between them fall into slices that are not asked for.
        ends = [sorted({e for s in open_[i] for e in (s.low, math.nextafter(s.high, math.inf))} - {-math.inf, math.inf}) for i in columns_now]
        at = [{_place(ends[k], s.low): s for s in open_[i]} for k, i in enumerate(columns_now)]
        rows = _sliced(both.select("side", *few), few, ends)
        kept = []
        for k, c in enumerate(few):
            taken = [p in at[k] for p in range(len(ends[k]) + 1)] + [False]  # the last is where missing values go
            asked = F.get(F.expr("array(" + ", ".join(map(str, taken)).lower() + ")"), F.col(f"_slice{k}").cast("int"))
            kept.append(F.when(asked, quoted(c)).alias(c))
        inside = rows.select("side", *kept, *(f"_slice{k}" for k in range(len(few)))).where(
            F.coalesce(*(quoted(c) for c in few)).isNotNull()
        )
        if held <= list_rows:
            for k, top in _listed(inside, few, at, {k: sizes[i] for k, i in enumerate(columns_now)}):
                best[columns_now[k]] = max(best[columns_now[k]], top)
            break
        inside = inside.select("side", *few)
        again = cut_points(inside, few, slices)
        again = [sorted({*a, *e, *(math.nextafter(s.low, math.inf) for s in by.values())}) for a, e, by in zip(again, ends, at)]
        waiting = {}
        for k, found in _tables(inside, few, again).items():
            i, parts = columns_now[k], []
            for s in open_[i]:
                low, high = _place(again[k], s.low), _place(again[k], s.high)
                parts += _walk([f for f in found if low <= f[0] <= high], s.first, s.second)
            waiting[i] = parts
        open_ = _narrow(waiting, sizes, best)
    return [(columns[i], *sizes[i], best[i]) for i in sorted(sizes)]


def _place(cuts: Sequence[float], value: float) -> int:
    """The slice of a value: how many cuts do not lie above it."""
    return bisect_right(cuts, value)


def _tables(df: DataFrame, names: Sequence[str], cuts: Sequence[Sequence[float]]) -> dict[int, list]:
    """By column: (slice, rows of each side, least, greatest value) in order; at most a row a slice and side comes here."""
    found: dict[int, dict[int, list]] = {}
    for r in slice_counts(df, names, cuts, ["side"]).collect():
        one = found.setdefault(r["column"], {}).setdefault(r["slice"], [[0, 0], math.inf, -math.inf])
        one[0][r["side"]] = r["n"]
        one[1], one[2] = min(one[1], r["a"]), max(one[2], r["b"])
    return {i: [(s, tuple(c), a, b) for s, (c, a, b) in sorted(per.items())] for i, per in found.items()}


def _walk(found: Sequence[tuple], first: int, second: int) -> list[_Slice]:
    out = []
    for _, counts, a, b in found:
        out.append(_Slice(a, b, first, second, counts))
        first, second = first + counts[0], second + counts[1]
    return out


def _narrow(waiting: Mapping[int, Sequence[_Slice]], sizes: Mapping, best: dict[int, float]) -> dict[int, list[_Slice]]:
    """Raise ``best`` to the gaps at the cuts; the slices that may still pass it."""
    out = {}
    for i, parts in waiting.items():
        bounds = [_bounds(s, *sizes[i]) for s in parts]
        best[i] = max([best[i], *(after for after, _ in bounds)])
        left = [s for s, (_, most) in zip(parts, bounds) if most > best[i] and min(s.inside) and s.low < s.high]
        if left:
            out[i] = left
    return out


def _listed(inside: DataFrame, names: Sequence[str], at: Sequence[Mapping[int, _Slice]], sizes: Mapping[int, tuple[int, int]]) -> list[tuple[int, float]]:
    """(column, largest gap) from the values of few rows; running sums are taken slice by slice."""
    below = F.create_map(*(
        x for k, by in enumerate(at) for p, s in by.items() for x in (F.lit(f"{k}:{p}"), F.array(F.lit(s.first), F.lit(s.second)))
    ))
    share = F.create_map(*(x for k, (n, m) in sizes.items() for x in (F.lit(k), F.array(F.lit(n), F.lit(m)))))
    counted = _cells(inside, names, ["side"]).groupBy("column", "slice", "value").agg(
        F.count_if(F.col("side") == 0).alias("r"), F.count_if(F.col("side") == 1).alias("c")
    )
    run = Window.partitionBy("column", "slice").orderBy("value")
    base = below[F.concat_ws(":", "column", "slice")]
    upto = [(base[j] + F.sum(x).over(run)) / share[F.col("column")][j] for j, x in enumerate("rc")]
    gaps = counted.withColumn("gap", F.abs(upto[0] - upto[1])).groupBy("column").agg(F.max("gap").alias("top"))
    return [(r["column"], r["top"]) for r in gaps.collect()]


@dataclass(frozen=True)
class Grid:
    """Cuts and counts of one side's columns; ``counts`` has a number more than ``cuts`` for each column."""

    cuts: dict[str, list[float]]
    counts: dict[str, list[int]]

    @classmethod
    def of(cls, df: DataFrame, columns: Sequence[str], slices: int = SLICES) -> Grid:
        """Cuts between which about equally many rows of ``df`` lie, and their counts."""
        rows = plain(df, columns)
        names = [f"v{i}" for i in range(len(columns))]
        cuts = cut_points(rows, names, slices)
        made = cls(dict(zip(columns, cuts)), {})
        return cls(made.cuts, made.count(df))

    def count(self, df: DataFrame) -> dict[str, list[int]]:
        """Counts of the rows of ``df`` between the cuts: one pass."""
        columns = [c for c in self.cuts if c in df.columns]
        out = {c: [0] * (len(self.cuts[c]) + 1) for c in columns}
        if columns:
            names = [f"v{i}" for i in range(len(columns))]
            for r in slice_counts(plain(df, columns), names, [self.cuts[c] for c in columns]).collect():
                out[columns[r["column"]]][r["slice"]] = r["n"]
        return out

    def bounds(self, counts: Mapping[str, Sequence[int]]) -> dict[str, tuple[int, int, float, float]]:
        """(own rows, rows of ``counts``, least, greatest distance) for columns with values on both sides."""
        return {c: (sum(self.counts[c]), sum(n), *count_bounds(self.counts[c], n)) for c, n in counts.items() if sum(n) and sum(self.counts[c])}


def count_bounds(first: Sequence[int], second: Sequence[int]) -> tuple[float, float]:
    """The least and the greatest distance that counts in the same slices allow."""
    n, m = sum(first), sum(second)
    low = high = 0.0
    r = c = 0
    for x, y in zip(first, second):
        after, most = _bounds(_Slice(0, 1, r, c, (x, y)), n, m)
        low = max(low, after)
        high = max(high, most if x and y else after)
        r, c = r + x, c + y
    return low, max(low, high)
