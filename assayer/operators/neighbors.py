"""Exact nearest rows by partitioning space, without pairing every row with every other.

1. Donors go to the leaves of a space-splitting tree built from a bounded sample. The sample only
   shapes the tree: every donor is assigned, whatever the tree looks like. Oversized leaves are cut
   into chunks by hash, so a (leaf, chunk) block is a bounded unit of work.
2. Each leaf's bounding box and counts form a small table. A receiver first meets the leaves that
   are nearest by box distance and hold k usable donors. Its k-th distance there is an upper bound.
3. A receiver then meets every other leaf whose box is not farther than that bound. Nothing outside
   can be among its k nearest, so the union of both rounds is exact.

Rows with equal coordinates are merged first on both sides: receivers are computed once per distinct
point, and of equal donors only the k with the smallest ids can ever be chosen. Receivers of a busy
leaf are spread over several copies of its blocks.

Distances follow the rule for incomplete rows: squared differences over the coordinates both rows
have, scaled by all coordinates / shared coordinates. With complete rows this is the plain
Euclidean distance.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

from assayer.functions.columns import number, quoted
from assayer.functions.cutting import checkpointed

LEAF_ROWS = 512
MAX_LEAVES = 65_536  # bounds the box table every task holds
SAMPLE_PER_LEAF = 8  # with MAX_LEAVES bounds the sample the driver holds
BLOCK_DONORS = 4_096
BLOCK_RECEIVERS = 2_048
CELLS = 4_000_000  # receivers x leaves looked at in one piece
GROUP = 256  # receivers whose leaves are chosen together
CHOSEN = 20_000  # visits in one frame
NEAR_LEAVES = 32


@dataclass
class _Node:
    dim: int = -1
    cut: float = 0.0
    low: int = -1
    high: int = -1
    gap: int = -1  # rows without the coordinate
    leaf: int = -1


def _grow(sample: np.ndarray, leaf_rows: int) -> list[_Node]:
    nodes: list[_Node] = []
    leaves = 0

    def add(block: np.ndarray, dims: tuple[int, ...]) -> int:
        nonlocal leaves
        at = len(nodes)
        nodes.append(_Node())
        best, spread = -1, 0.0
        if len(block) > leaf_rows:
            for d in dims:
                have = block[:, d][~np.isnan(block[:, d])]
                wide = np.ptp(have) * (len(have) / len(block)) if len(have) > 1 else 0.0
                if wide > spread:
                    best, spread = d, wide
        if best < 0:
            nodes[at].leaf = leaves
            leaves += 1
            return at
        values = block[:, best]
        absent = np.isnan(values)
        have = values[~absent]
        cut = float(np.median(have))
        if cut >= have.max():  # keep both sides non-empty under ties
            cut = float(have[have < have.max()].max())
        nodes[at].dim, nodes[at].cut = best, cut
        nodes[at].low = add(block[~absent & (values <= cut)], dims)
        nodes[at].high = add(block[~absent & (values > cut)], dims)
        nodes[at].gap = add(block[absent], tuple(d for d in dims if d != best))
        return at

    add(sample, tuple(range(sample.shape[1])))
    return nodes


def _assign(nodes: list[_Node], block: np.ndarray) -> np.ndarray:
    out = np.zeros(len(block), dtype=np.int32)
    todo = [(0, np.arange(len(block)))]
    while todo:
        at, rows = todo.pop()
        if not len(rows):
            continue
        node = nodes[at]
        if node.leaf >= 0:
            out[rows] = node.leaf
            continue
        values = block[rows, node.dim]
        absent = np.isnan(values)
        todo.append((node.gap, rows[absent]))
        todo.append((node.low, rows[~absent & (values <= node.cut)]))
        todo.append((node.high, rows[~absent & (values > node.cut)]))
    return out


def _matrix(points: pd.Series, width: int) -> np.ndarray:
    if not len(points):
        return np.empty((0, width))
    return np.vstack(points.to_numpy())


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Scaled distances; infinite where no coordinate is shared."""
    width = a.shape[1]
    total = np.zeros((len(a), len(b)))
    shared = np.zeros((len(a), len(b)))
    for d in range(width):
        diff = a[:, d][:, None] - b[:, d][None, :]
        ok = ~np.isnan(diff)
        total += np.where(ok, diff * diff, 0.0)
        shared += ok
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.sqrt(np.where(shared > 0, total * (width / shared), np.inf))


def distinct_points(df: DataFrame, id_column: str, coords: Sequence[str], keep: int) -> DataFrame:
    """(id, point, rep): of rows with equal coordinates the ``keep`` smallest ids; rep is the least.

    Absent coordinates are NaN in ``point``, which Spark groups as equal.

    The rank filter is also applied before the shuffle, so a hot point never gathers in one task.
    """
    point = F.array(*(F.coalesce(number(df, c), F.lit(math.nan)) for c in coords))
    same = Window.partitionBy("point")
    return (
        df.select(quoted(id_column).alias("id"), point.alias("point"))
        .withColumn("_rank", F.row_number().over(same.orderBy("id")))
        .where(F.col("_rank") <= keep)
        .withColumn("rep", F.min("id").over(same))
        .drop("_rank")
    )


def leaf_count(n_donors: int, leaf_rows: int | None = None) -> int:
    """Leaves of LEAF_ROWS. Receivers look at all boxes a piece at a time, so their number hardly adds to a receiver's work."""
    return max(1, min(math.ceil(n_donors / (leaf_rows or LEAF_ROWS)), MAX_LEAVES))


@dataclass(frozen=True)
class _Boxes:
    """Bounding box and counts of every leaf."""

    label: np.ndarray
    size: np.ndarray
    low: np.ndarray
    high: np.ndarray
    have: np.ndarray  # donors with each coordinate
    always: np.ndarray  # coordinates no donor of the leaf lacks

    @classmethod
    def of(cls, placed: DataFrame, width: int) -> _Boxes:
        at = [F.nanvl(F.get("point", F.lit(d)), F.lit(None).cast("double")) for d in range(width)]
        rows = (
            placed.groupBy("leaf")
            .agg(
                F.count("*").alias("n"),
                F.array(*(F.coalesce(F.min(x), F.lit(0.0)) for x in at)).alias("low"),
                F.array(*(F.coalesce(F.max(x), F.lit(0.0)) for x in at)).alias("high"),
                F.array(*(F.count(x) for x in at)).alias("have"),
            )
            .collect()  # at most MAX_LEAVES rows
        )
        rows = sorted(rows, key=lambda r: r["leaf"])
        size = np.array([r["n"] for r in rows], dtype=float)
        have = np.array([r["have"] for r in rows], dtype=float).reshape(len(rows), width)
        return cls(
            np.array([r["leaf"] for r in rows], dtype=np.int32),
            size,
            np.array([r["low"] for r in rows], dtype=float).reshape(len(rows), width),
            np.array([r["high"] for r in rows], dtype=float).reshape(len(rows), width),
            have,
            have == size[:, None],
        )

    def bounds(self, points: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
        """Squared lower bound of the distance from each point to the rows of each leaf, or of the leaves ``at``.

        Infinite where no row of the leaf has a coordinate that the point has.
        """
        at = slice(None) if at is None else at
        low, high, always, have = self.low[at], self.high[at], self.always[at], self.have[at]
        width = points.shape[1]
        own = ~np.isnan(points)
        out = np.zeros((len(points), len(low)))
        for d in range(width):
            x = np.nan_to_num(points[:, d])[:, None]
            gap = np.maximum(np.maximum(low[None, :, d] - x, x - high[None, :, d]), 0.0)
            gap *= gap
            gap *= always[None, :, d]
            gap *= own[:, d][:, None]
            out += gap
        # the scale of a distance is at least width / (coordinates the receiver has)
        out *= (width / np.maximum(own.sum(axis=1), 1))[:, None]
        out[own.astype(float) @ (have > 0).T.astype(float) == 0] = np.inf
        return out

    def box_bounds(self, points: np.ndarray) -> np.ndarray:
        """A lower bound of ``bounds`` for all of ``points``, which lack the same coordinates: a number a leaf."""
        own = np.flatnonzero(~np.isnan(points[0]))
        low, high = points[:, own].min(axis=0), points[:, own].max(axis=0)
        gap = np.maximum(np.maximum(self.low[:, own] - high, low - self.high[:, own]), 0.0) * self.always[:, own]
        out = (gap * gap).sum(axis=1) * (points.shape[1] / max(len(own), 1))
        out[~(self.have[:, own] > 0).any(axis=1)] = np.inf
        return out


def _pieces(places: np.ndarray, block: np.ndarray, apart: np.ndarray | None = None):
    """Row numbers of points that lie in the same leaf of the tree and lack the same coordinates, at most GROUP at a time.

    They share most of the leaves that matter to them, so all leaves are looked at once for a piece. ``apart`` is a
    further flag that a piece does not mix.
    """
    keys = [places, *np.isnan(block).T, *([] if apart is None else [apart])]
    order = np.lexsort(keys)
    new = np.zeros(len(order), dtype=bool)
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    for rows in np.split(order, np.flatnonzero(new)):
        yield from (rows[i : i + GROUP] for i in range(0, len(rows), GROUP))


def _first_leaves(near: np.ndarray, usable: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf position) of the nearest leaves up to the one that completes k usable donors."""
    total = min(near.shape[1], NEAR_LEAVES)
    left, found = np.arange(len(near)), []
    while len(left):
        here = near[left]
        if total < here.shape[1]:
            part = np.argpartition(here, total - 1, axis=1)[:, :total]
        else:
            part = np.tile(np.arange(here.shape[1]), (len(here), 1))
        inner = np.argsort(np.take_along_axis(here, part, axis=1), axis=1, kind="stable")
        order = np.take_along_axis(part, inner, axis=1)
        count = np.where(np.isfinite(np.take_along_axis(here, order, axis=1)), usable[order], 0)
        got = np.cumsum(count, axis=1)
        done = (got[:, -1] >= k) | (total == here.shape[1])
        r, c = np.nonzero((got - count < k) & (count > 0) & done[:, None])
        found.append((left[r], order[r, c]))
        left, total = left[~done], min(near.shape[1], total * 8)
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, int), np.empty(0, int))


def nearest(
    receivers: DataFrame,
    donors: DataFrame,
    width: int,
    k: int,
    targets: Sequence[int] | None = None,
    n_rows: int | None = None,
    leaf_rows: int | None = None,
) -> DataFrame:
    """(rid, target, did, rep, dist, value, rank): the k nearest donors of every receiver.

    ``receivers`` has (id, point), ``donors`` (id, point, rep). Without ``targets`` every donor
    counts and target is -1. With ``targets`` (positions of incomplete coordinates) a receiver has
    one search per target it lacks, over donors that have it; ``value`` is the donor's value.
    Equal distances are ordered by donor id. ``n_rows`` (at least the number of donors) saves a count.
    """
    spark = donors.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    n = donors.count() if n_rows is None else n_rows
    leaves = leaf_count(n, leaf_rows)
    id_sql = donors.schema["id"].dataType.simpleString()
    keys = ["leaf", "chunk", "copy"]

    def meet(visits: DataFrame, rows: DataFrame, blocks: int) -> DataFrame:
        """Top k of each visit. Both sides have leaf, chunks and copies: a leaf's donors are cut into
        chunks and its visits spread over copies, so a block is bounded before it is grouped."""
        # a name of its own: both sides of a cogroup must not carry the same source column
        left = (
            visits.withColumnRenamed("point", "spot").withColumn("copy", F.pmod(F.xxhash64("rid"), F.col("copies")).cast("int"))
            .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
            .drop("chunks", "copies")
        )
        right = (
            rows.withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
            .withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
            .drop("chunks", "copies")
        )
        # blocks are small in bytes but not in work, so their spread is not left to size-based merging
        parts = max(1, min(blocks, tasks * 4))
        out_schema = (
            f"rid {id_sql}, target int, point array<double>, leaf int, did {id_sql}, rep {id_sql}, "
            "dist double, value double"
        )
        return (
            left.repartition(parts, *keys).groupBy(*keys)
            .cogroup(right.repartition(parts, *keys).groupBy(*keys))
            .applyInPandas(lambda l, r: _block(l, r, width, k), out_schema)
        )

    order = Window.partitionBy("rid", "target").orderBy("dist", "did")
    if leaves == 1:
        chunks, copies = math.ceil(n / BLOCK_DONORS) or 1, math.ceil(n / BLOCK_RECEIVERS) or 1
        # always 0, but not a literal: the optimizer folds a literal key out of the grouping
        leaf = F.pmod(F.xxhash64("id"), F.lit(1)).cast("int")
        shape = [leaf.alias("leaf"), F.lit(chunks).alias("chunks"), F.lit(copies).alias("copies")]
        asked = F.array(*(F.lit(t) for t in ((-1,) if targets is None else targets)))
        visits = receivers.select(F.col("id").alias("rid"), F.explode(asked).alias("target"), "point", *shape)
        if targets is not None:
            visits = visits.where(F.isnan(F.get("point", F.col("target"))))
        met = meet(visits, donors.select("*", *shape), chunks * copies)
        ranked = met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        return ranked.where("did IS NOT NULL").drop("point", "leaf")

    share = min(1.0, max(20_000, leaves * SAMPLE_PER_LEAF) / n)
    picked = F.pmod(F.xxhash64("id"), F.lit(1 << 40)) < F.lit(int(share * (1 << 40)) + 1)
    sample = _matrix(donors.where(picked).select("point").toPandas()["point"], width)
    nodes = _grow(sample, max(1, len(sample) // leaves))

    @F.pandas_udf(T.IntegerType())
    def leaf_of(points: pd.Series) -> pd.Series:
        return pd.Series(_assign(nodes, _matrix(points, width)))

    placed = checkpointed(donors.withColumn("leaf", leaf_of("point")))
    boxes = _Boxes.of(placed, width)

    visit_schema = f"rid {id_sql}, target int, point array<double>, leaf int, bound double"

    def framed(choose):
        """Frames of the visits that ``choose`` yields piece by piece, some CHOSEN rows in one."""

        def frame(parts):
            ids, target, points, at, bound = (np.concatenate(x) for x in zip(*parts))
            return pd.DataFrame(
                {"rid": ids, "target": target.astype(np.int32), "point": points, "leaf": boxes.label[at], "bound": bound}
            )

        def run(batches):
            parts, held = [], 0
            for part in choose(batches):
                parts.append(part)
                held += len(part[0])
                if held >= CHOSEN:
                    yield frame(parts)
                    parts, held = [], 0
            if parts:
                yield frame(parts)

        return run

    def first_visits(batches):
        for batch in batches:
            points, ids = batch["point"].to_numpy(), batch["id"].to_numpy()
            block = _matrix(batch["point"], width)
            for piece in _pieces(batch["place"].to_numpy(), block):
                far = boxes.box_bounds(block[piece])
                reach = np.flatnonzero(np.isfinite(far))
                for t in (-1,) if targets is None else targets:
                    if t >= 0 and not np.isnan(block[piece[0], t]):
                        continue
                    usable = boxes.size if t < 0 else boxes.have[:, t]
                    # any leaves give a bound: those nearest to the piece that hold enough of its donors many times over
                    asked = reach[usable[reach] > 0]
                    if len(asked) > NEAR_LEAVES:
                        asked = asked[np.argsort(far[asked], kind="stable")]
                        enough = int(np.searchsorted(np.cumsum(usable[asked]), 4 * k)) + 1
                        asked = asked[: max(NEAR_LEAVES, enough)]
                    if not len(asked):
                        continue
                    r, at = _first_leaves(boxes.bounds(block[piece], asked), usable[asked], k)
                    r = piece[r]
                    yield ids[r], np.full(len(r), t), points[r], asked[at], np.full(len(r), np.inf)

    def second_visits(batches):
        for batch in batches:
            points, ids = batch["point"].to_numpy(), batch["rid"].to_numpy()
            block = _matrix(batch["point"], width)
            bound = batch["bound"].to_numpy(dtype=float)
            limit = bound**2 * (1 + 1e-9) + 1e-300  # room for rounding, never excludes a tie
            target = batch["target"].to_numpy()
            seen = batch["seen"].to_numpy()
            for piece in _pieces(batch["place"].to_numpy(), block, np.isinf(limit)):
                far = boxes.box_bounds(block[piece])
                asked = np.flatnonzero(np.isfinite(far) & (far <= limit[piece].max() * (1 + 1e-9)))
                known = np.searchsorted(boxes.label, np.concatenate(seen[piece]))
                who = np.repeat(np.arange(len(piece)), [len(x) for x in seen[piece]])
                for step in range(0, len(asked), max(1, CELLS // len(piece))):
                    some = asked[step : step + max(1, CELLS // len(piece))]
                    near = boxes.bounds(block[piece], some)
                    t = target[piece]
                    open_ = (near <= limit[piece][:, None]) & np.isfinite(near)
                    if targets is not None:
                        open_ &= boxes.have.T[t][:, some] > 0
                    was = np.searchsorted(some, known)
                    again = some[np.minimum(was, len(some) - 1)] == known
                    open_[who[again], was[again]] = False
                    r, at = np.nonzero(open_)
                    yield ids[piece][r], t[r], points[piece][r], some[at], bound[piece][r]

    chunks = np.maximum(1, np.ceil(boxes.size / BLOCK_DONORS)).astype(int)

    def planned(visits: DataFrame) -> DataFrame:
        visits = checkpointed(visits)
        load = dict(visits.groupBy("leaf").agg(F.count("*").alias("n")).collect())  # row per leaf
        copies = [max(1, math.ceil(load.get(int(l), 0) / BLOCK_RECEIVERS)) for l in boxes.label]
        plan = spark.createDataFrame(
            [(int(l), int(c), int(m)) for l, c, m in zip(boxes.label, chunks, copies)],
            "leaf int, chunks int, copies int",
        )
        plan = F.broadcast(plan)  # one row per leaf
        return meet(visits.join(plan, "leaf"), placed.join(plan, "leaf"), int(np.dot(chunks, copies)))

    def gathered(rows: DataFrame) -> DataFrame:
        """Points of the same leaf of the tree side by side."""
        return rows.withColumn("place", leaf_of("point")).repartition(tasks, "place").sortWithinPartitions("place")

    receivers = gathered(receivers)
    first = checkpointed(planned(receivers.mapInPandas(framed(first_visits), visit_schema)))
    ranked = first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    # a search has at least one first visit, and few of them
    bounds = ranked.groupBy("rid", "target").agg(
        F.when(F.count("did") >= k, F.max("dist")).otherwise(math.inf).alias("bound"),
        F.first("point").alias("point"),
    )
    visited = first.groupBy("rid", "target").agg(F.collect_set("leaf").alias("seen"))
    searches = gathered(bounds.join(visited, ["rid", "target"]))
    both = first.unionByName(planned(searches.mapInPandas(framed(second_visits), visit_schema)))
    ranked = both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.where("did IS NOT NULL").drop("point", "leaf")


def _block(left: pd.DataFrame, right: pd.DataFrame, width: int, k: int) -> pd.DataFrame:
    columns = ["rid", "target", "point", "leaf", "did", "rep", "dist", "value"]
    if not len(left) or not len(right):
        return pd.DataFrame(columns=columns)
    right = right.sort_values("id", kind="stable").reset_index(drop=True)
    donors = _matrix(right["point"], width)
    ids, reps = right["id"].to_numpy(), right["rep"].to_numpy()
    parts = []
    for start in range(0, len(left), 256):
        part = left.iloc[start : start + 256]
        points = _matrix(part["spot"], width)
        apart = _distances(points, donors)
        target = part["target"].to_numpy()
        for t in np.unique(target[target >= 0]):
            apart[np.ix_(target == t, np.isnan(donors[:, t]))] = np.inf
        # everything up to the k-th distance, then ties by position (donors are in id order)
        many = min(k, apart.shape[1])
        kth = np.partition(apart, many - 1, axis=1)[:, many - 1]
        r, c = np.nonzero((apart <= kth[:, None]) & np.isfinite(apart))
        order = np.lexsort((c, apart[r, c], r))
        r, chosen = r[order], c[order]
        place = np.arange(len(r)) - np.searchsorted(r, r)
        r, chosen = r[place < many], chosen[place < many]
        value = np.where(
            target[r] >= 0, donors[chosen, np.maximum(target[r], 0)], np.nan
        )
        parts.append(
            pd.DataFrame(
                {
                    "rid": part["rid"].to_numpy()[r],
                    "target": target[r],
                    "point": part["spot"].to_numpy()[r],
                    "leaf": part["leaf"].to_numpy()[r],
                    "did": ids[chosen],
                    "rep": reps[chosen],
                    "dist": apart[r, chosen],
                    "value": value,
                }
            )
        )
        # a visit without a usable donor still has to be known to the second round
        empty = np.setdiff1d(np.arange(len(part)), r)
        if len(empty):
            none = part.iloc[empty][["rid", "target", "spot", "leaf"]].rename(columns={"spot": "point"})
            none["did"], none["rep"] = None, None
            none["dist"], none["value"] = np.inf, np.nan
            parts.append(none)
    return pd.concat(parts, ignore_index=True)[columns]
