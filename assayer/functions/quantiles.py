"""Exact quantiles with bounded state.

``percentile`` would keep every distinct value of a column in one aggregation buffer. Ranks are found by narrowing
instead, at every size: each pass counts the rows of the still-open value ranges in equal-width bins (map-side
combined, one row per bin), keeps only the bins that hold a wanted rank, and repeats until a range is a single value
or holds at most ``list_rows`` rows, which are ordered by their distinct values.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from assayer.functions.columns import number

BINS = 1024


@dataclass
class _Range:
    column: str
    low: float
    high: float
    rows: int
    before: int  # rows of the column that sort below this range
    ranks: list[int]


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probabilities: Sequence[float],
    list_rows: int = 100_000,
) -> dict[str, list[float] | None]:
    """Linear-interpolation quantiles per column; None for a column without values."""
    if not columns:
        return {}
    pieces = []
    for i, c in enumerate(columns):
        v = number(df, c)
        pieces += [F.count(v).alias(f"n{i}"), F.min(v).alias(f"a{i}"), F.max(v).alias(f"b{i}")]
    row = df.agg(*pieces).first()
    found: dict[str, list[float] | None] = {}
    wide = []
    for i, c in enumerate(columns):
        n = row[f"n{i}"]
        if n == 0:
            found[c] = None
        elif row[f"a{i}"] == row[f"b{i}"]:
            found[c] = [row[f"a{i}"]] * len(probabilities)
        else:
            wide.append((c, n, row[f"a{i}"], row[f"b{i}"]))
    if wide:
        found.update(_narrowed(df, wide, probabilities, list_rows))
    return {c: found[c] for c in columns}


def _narrowed(df, wide, probabilities, list_rows):
    wanted = {}
    open_ranges = []
    for c, n, low, high in wide:
        ranks = set()
        for p in probabilities:
            at = p * (n - 1)
            ranks |= {math.floor(at), math.ceil(at)}
        wanted[c] = {}
        open_ranges.append(_Range(c, low, high, n, 0, sorted(ranks)))

    settled = []
    while open_ranges:
        counts = (
            _in_ranges(df, open_ranges)
            .groupBy("range", "bin")
            .agg(F.count("*").alias("n"), F.min("value").alias("a"), F.max("value").alias("b"))
            .collect()  # at most len(open_ranges) * BINS rows
        )
        nxt = []
        for i, r in enumerate(open_ranges):
            below = r.before
            for row in sorted((x for x in counts if x["range"] == i), key=lambda x: x["bin"]):
                ranks = [k for k in r.ranks if below <= k < below + row["n"]]
                if ranks and row["a"] == row["b"]:
                    wanted[r.column].update(dict.fromkeys(ranks, row["a"]))
                elif ranks:
                    part = _Range(r.column, row["a"], row["b"], row["n"], below, ranks)
                    (settled if row["n"] <= list_rows else nxt).append(part)
                below += row["n"]
        open_ranges = nxt

    if settled:
        order = Window.partitionBy("range").orderBy("value")
        listed = (
            _in_ranges(df, settled)
            .groupBy("range", "value")
            .agg(F.count("*").alias("n"))
            .withColumn("upto", F.sum("n").over(order))
        )
        tests = [
            f"(range = {i} AND upto > {k - r.before} AND upto - n <= {k - r.before})"
            for i, r in enumerate(settled)
            for k in r.ranks
        ]
        hit = F.expr(" OR ".join(tests))
        for row in listed.where(hit).collect():  # at most one row per wanted rank
            r = settled[row["range"]]
            for k in r.ranks:
                if row["upto"] - row["n"] <= k - r.before < row["upto"]:
                    wanted[r.column][k] = row["value"]

    out = {}
    for c, n, *_ in wide:
        values = []
        for p in probabilities:
            at = p * (n - 1)
            lo, hi = wanted[c][math.floor(at)], wanted[c][math.ceil(at)]
            values.append(lo + (hi - lo) * (at - math.floor(at)))
        out[c] = values
    return out


def _in_ranges(df: DataFrame, ranges: list[_Range]) -> DataFrame:
    """Cells inside one of the (disjoint) ranges: range number, equal-width bin, value.

    Each column is tested against its own ranges only.
    """
    columns = list(dict.fromkeys(r.column for r in ranges))
    # a projection of its own, so that each number is made once and not once per test
    plain = df.select(*(number(df, c).alias(f"v{i}") for i, c in enumerate(columns)))
    marked, cells = [F.col(f"v{i}") for i in range(len(columns))], []
    for at, c in enumerate(columns):
        v = F.col(f"v{at}")
        which, width = None, None
        for i, r in enumerate(ranges):
            if r.column != c:
                continue
            inside = v.between(r.low, r.high)
            # halves keep the difference finite for values near the ends of the double range
            share = (v / 2 - r.low / 2) / (r.high / 2 - r.low / 2)
            bin_ = F.least(F.lit(BINS - 1), F.floor(share * BINS).cast("int"))
            which = F.when(inside, i) if which is None else which.when(inside, i)
            width = F.when(inside, bin_) if width is None else width.when(inside, bin_)
        marked += [which.alias(f"r{at}"), width.alias(f"b{at}")]
        cells.append(
            F.struct(F.col(f"r{at}").alias("range"), F.col(f"b{at}").alias("bin"), v.alias("value"))
        )
    # narrowed ranges hold few rows; the others go before they are split into cells
    some = F.coalesce(*(F.col(f"r{i}") for i in range(len(columns)))).isNotNull()
    rows = plain.select(*marked).where(some)
    return rows.select(F.inline(F.array(*cells))).where("range IS NOT NULL")
