"""Whitening of vectors by an incremental eigendecomposition of their covariance.

1. *Fit list.* Vectors become integers; each different one counts once. Its size n and the sums S are exact.
2. *Partitions.* A task keeps the spectrum (eigenvalues and eigenvectors) and the mean of the rows it has seen. A row adds
   a centred rank-one update: the new eigenvalues are the roots of the secular equation, the new eigenvectors follow
   from them; components the update does not touch, and equal eigenvalues after a rotation, are deflated and
   stay. Of a block of more rows than dimensions, the triangular factor of the centred block stands in: it has the same
   scatter, so a block costs as many updates as there are dimensions, and one more for its mean.
3. *Combination.* Spectra meet ``FAN_IN`` at a time; one takes in another by a rank-one update for each of its
   eigenpairs and one for the distance of the means. Rounds go on until one spectrum is left.
4. *Refinement.* Each pass takes all rows of the fit list, centred by S / n, into the basis found and sums the products
   there. The eigenvectors of that small matrix turn the basis (Rayleigh-Ritz), until the matrix is diagonal to rounding. The
   eigenvalues and the error against the identity are those that the last pass measured.

A task holds a block of rows and a few matrices of d x d numbers; the driver one such matrix for each of ``FAN_IN`` tasks.

* null vectors and vectors with a null or non-finite component: dropped. Shorter vectors: missing components count as zero.
* null and repeated ids: a row each. Equal vectors: once in the fit list, all in the result. Ties of eigenvalues: any basis.
* components without variance (as all are where n is 1): whitened null, left out of the error; no total variance: explained null.
* no rows or no dimensions: no rows. deviation beyond 64 bits: null. Components of 2**40 and more after scaling: an error.
* other columns are not read, so their names do not matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from assayer.functions.columns import quoted
from assayer.functions.cutting import checkpointed
from assayer.llm.common import query, table
from assayer.llm.vectors import dimension, packed, rows_of, usable

COMPONENTS = 16
SCALE, SHIFT = 64, 1_000_000
BLOCK = 1024
FAN_IN = 16
PASSES = 4
#: Off-diagonal products, relative to the largest eigenvalue, below which a pass is the last.
SETTLED = 1e-14
#: Share of the total variance below which a component counts as having none.
NO_VARIANCE = 1e-13
_EPS = np.finfo(float).eps


def secular_roots(d: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + sum z_i^2 / (d_i - r) for increasing ``d`` and no zero in ``z``, one above each d_i.

    Returned as (index of the pole nearest to the root, offset from that pole), so that differences stay exact.
    """
    k = len(d)
    w = z * z
    upper = np.append(d[1:], d[-1] + w.sum())
    gap = upper - d
    own = np.arange(k)
    if k > 1:
        at = d[:, None] - d[None, :-1] - gap[:-1] / 2
        middle = 1 + (w[:, None] / at).sum(axis=0)
        pole = np.append(np.where(middle >= 0, own[:-1], own[1:]), k - 1)
    else:
        pole = own.copy()
    delta = d[:, None] - d[pole][None, :]
    low = np.where(pole == own, 0.0, -gap / 2)
    high = np.where(pole == own, np.append(gap[:-1] / 2, gap[-1]), 0.0)
    tau = (low + high) / 2
    left = np.tri(k, dtype=bool).T  # row j is at or below the root's own pole
    nxt = np.minimum(own + 1, k - 1)
    tiny = np.finfo(float).tiny
    for _ in range(80):
        gaps = delta - tau
        gaps[gaps == 0] = tiny
        part = w[:, None] / gaps
        slope = part / gaps
        value = 1 + part.sum(axis=0)
        low, high = np.where(value < 0, tau, low), np.where(value >= 0, tau, high)
        below = np.where(left, slope, 0).sum(axis=0)
        above = slope.sum(axis=0) - below
        here, there = gaps[own, own], gaps[nxt, own]
        c = value - here * below - there * above
        a = (here + there) * value - here * there * (below + above)
        b = here * there * value
        root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
        with np.errstate(divide="ignore", invalid="ignore"):
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            step[-1] = here[-1] * value[-1] / (value[-1] - here[-1] * below[-1])
        new = tau + step
        safe = np.isfinite(new) & (new >= low) & (new <= high) & (new != delta[own, own]) & (new != delta[nxt, own])
        new = np.where(safe, new, (low + high) / 2)
        done = np.abs(value) <= _EPS * k * (1 + np.abs(part).sum(axis=0))
        new = np.where(done, tau, new)
        moved = np.abs(new - tau)
        tau = new
        if (moved <= _EPS * np.abs(tau)).all():
            break
    return pole, tau


class Spectrum:
    """Count, mean and eigenpairs of the scatter of the rows seen."""

    def __init__(self, d: int):
        self.n, self.mean = 0, np.zeros(d)
        self.values, self.vectors = np.zeros(d), np.eye(d)

    def update(self, v: np.ndarray) -> None:
        """Add v v^T to the scatter."""
        z = self.vectors.T @ v
        d = self.values
        size = float(z @ z)
        if size == 0:
            return
        limit = 8 * _EPS * max(abs(d[-1]), size)
        active = np.flatnonzero(np.abs(z) * np.sqrt(size) > limit)
        if len(active) > 1 and (np.diff(d[active]) <= limit).any():
            # Of equal eigenvalues a rotation leaves one that the update touches.
            vectors, kept, last = self.vectors.copy(), [], active[0]
            for i in active[1:]:
                if d[i] - d[last] <= limit:
                    r = float(np.hypot(z[last], z[i]))
                    c, s = z[i] / r, z[last] / r
                    vectors[:, [last, i]] = vectors[:, [last, i]] @ np.array([[c, s], [-s, c]])
                    z[last], z[i] = 0.0, r
                else:
                    kept.append(last)
                last = i
            active = np.array([*kept, last])
            self.vectors = vectors
        if not len(active):
            return
        dd, zz = d[active], z[active]
        pole, tau = secular_roots(dd, zz)
        gaps = dd[:, None] - dd[pole][None, :] - tau[None, :]  # d_i - root_j
        gaps[gaps == 0] = np.finfo(float).tiny
        k = len(dd)
        # The update for which these roots are exact: its eigenvectors are orthogonal however close the roots lie.
        between = dd[:, None] - dd[None, :]
        np.fill_diagonal(between, 1.0)
        lower = np.tri(k, k, -1, dtype=bool)  # j < i
        ratio = np.ones((k, k))
        ratio[lower] = (gaps / between)[lower]
        after = np.triu(np.ones((k, k), bool))[:, :-1]  # j >= i, but for the last root
        ratio[:, :-1][after] = (-gaps[:, :-1] / np.where(after, dd[None, 1:] - dd[:, None], 1.0))[after]
        ratio[:, -1] = -gaps[:, -1]
        exact = np.sqrt(np.abs(ratio.prod(axis=1))) * np.sign(zz)
        turn = exact[:, None] / gaps
        turn /= np.sqrt((turn * turn).sum(axis=0))
        values, vectors = d.copy(), self.vectors.copy()
        values[active] = dd[pole] + tau
        vectors[:, active] = self.vectors[:, active] @ turn
        order = np.argsort(values, kind="stable")
        self.values, self.vectors = values[order], vectors[:, order]

    def add(self, rows: np.ndarray) -> None:
        """Take in ``rows``: one by one, or as a block where there are more of them than dimensions."""
        if len(rows) > len(self.mean) + 1:
            center = rows.mean(axis=0)
            whole = Spectrum.__new__(Spectrum)
            whole.n, whole.mean = len(rows), center
            self._meet(whole, np.linalg.qr(rows - center, mode="r"))
            return
        for x in rows:
            off = x - self.mean
            self.n += 1
            self.mean = self.mean + off / self.n
            self.update(np.sqrt((self.n - 1) / self.n) * off)

    def take(self, other: Spectrum) -> None:
        self._meet(other, (other.vectors * np.sqrt(np.maximum(other.values, 0))).T)

    def _meet(self, other: Spectrum, factor: np.ndarray) -> None:
        """Take in rows known by count, mean and a ``factor`` of their centred scatter."""
        off, n = other.mean - self.mean, self.n + other.n
        for v in factor:
            self.update(v)
        self.update(np.sqrt(self.n * other.n / n) * off)
        self.mean = self.mean + off * (other.n / n)
        self.n = n

    def to_bytes(self) -> bytes:
        return np.concatenate([[float(self.n)], self.mean, self.values, self.vectors.ravel()]).tobytes()

    @classmethod
    def from_bytes(cls, data: bytes, d: int) -> Spectrum:
        cells = np.frombuffer(data)
        out = cls(d)
        out.n, out.mean, out.values = int(cells[0]), cells[1 : d + 1].copy(), cells[d + 1 : 2 * d + 1].copy()
        out.vectors = cells[2 * d + 1 :].reshape(d, d).copy()
        return out


def _each_task(df: DataFrame, make: Callable[[Iterator[pa.RecordBatch]], bytes | None]) -> DataFrame:
    """One row ``made`` from each task that has rows."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = make(batches)
        yield pa.RecordBatch.from_arrays([pa.array([] if out is None else [out], pa.binary())], names=["made"])

    return df.mapInArrow(task, "made binary")


def _folded(made: DataFrame, merge: Callable[[Iterator[bytes]], bytes]) -> bytes | None:
    """All rows merged, at most ``FAN_IN`` in a task."""

    def step(batches: Iterator[pa.RecordBatch]) -> bytes | None:
        rows = (cell for b in batches for cell in b.column(0).to_pylist())
        first = next(rows, None)
        if first is None:
            return None
        return merge(c for part in ([first], rows) for c in part)

    made = checkpointed(made)
    count = made.count()
    while count > FAN_IN:
        made = checkpointed(_each_task(made.repartition(-(-count // FAN_IN)), step))
        count = made.count()
    rows = [bytes(r["made"]) for r in made.collect()]
    return merge(iter(rows)) if rows else None


@dataclass
class Whitening:
    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray
    identity_error: float


def fit(distinct: DataFrame, d: int, components: int = COMPONENTS) -> Whitening | None:
    """The model of a table of different packed vectors ``x``."""

    def summed(batches: Iterator[pa.RecordBatch]) -> bytes | None:
        n, total = 0, np.zeros(d, np.int64)
        for b in batches:
            n += b.num_rows
            total += rows_of(b.column(0), d).sum(axis=0)
        return np.array([n, *total], np.int64).tobytes() if n else None

    def added(rows: Iterator[bytes]) -> bytes:
        return sum(np.frombuffer(r, np.int64) for r in rows).tobytes()

    whole = _folded(_each_task(distinct, summed), added)
    if whole is None or not d:
        return None
    n, *sums = np.frombuffer(whole, np.int64).tolist()
    base = np.array([round(s / n) for s in sums], np.int64)
    # S / n less the base, from exact integers.
    mean = np.array([(s - n * b) / n for s, b in zip(sums, base.tolist())])

    def seen(batches: Iterator[pa.RecordBatch]) -> bytes | None:
        out = Spectrum(d)
        for b in batches:
            for s in range(0, b.num_rows, BLOCK):
                out.add((rows_of(b.column(0).slice(s, BLOCK), d) - base).astype(float))
        return out.to_bytes() if out.n else None

    def taken(rows: Iterator[bytes]) -> bytes:
        out = Spectrum.from_bytes(next(rows), d)
        for r in rows:
            out.take(Spectrum.from_bytes(r, d))
        return out.to_bytes()

    start = Spectrum.from_bytes(_folded(_each_task(distinct, seen), taken), d)
    basis = np.linalg.qr(start.vectors[:, ::-1])[0]
    for left in reversed(range(PASSES)):

        def products(batches: Iterator[pa.RecordBatch], basis: np.ndarray = basis) -> bytes | None:
            total, any_rows = np.zeros((d, d)), False
            for b in batches:
                for s in range(0, b.num_rows, BLOCK):
                    y = ((rows_of(b.column(0).slice(s, BLOCK), d) - base) - mean) @ basis
                    total += y.T @ y
                    any_rows = True
            return total.tobytes() if any_rows else None

        def plus(rows: Iterator[bytes]) -> bytes:
            return sum(np.frombuffer(r) for r in rows).tobytes()

        small = np.frombuffer(_folded(_each_task(distinct, products), plus)).reshape(d, d) / n
        small = (small + small.T) / 2
        off = np.abs(small - np.diag(np.diag(small))).max() if d > 1 else 0.0
        falling = (np.diff(np.diag(small)) <= 0).all()
        if not left or (falling and off <= SETTLED * np.abs(small).max()):
            break
        basis = np.linalg.qr(basis @ np.linalg.eigh(small)[1][:, ::-1])[0]
    values, trace = np.diag(small).copy(), float(np.trace(small))
    k = min(components, d)
    some = values[:k] > NO_VARIANCE * trace if trace > 0 else np.zeros(k, bool)
    scale = np.sqrt(values[:k][some])
    kept = small[:k, :k][np.ix_(some, some)]
    error = float(np.abs(kept / np.outer(scale, scale) - np.eye(len(scale))).max()) if len(scale) else 0.0
    explained = np.where(some, values[:k], 0.0) / trace if trace > 0 else np.full(k, np.nan)
    return Whitening(n, sums, np.where(some, values[:k], 0.0), basis[:, :k], explained, error)


_OUT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(df: DataFrame, vector: str = "embedding", key: str = "vec_id", scale: int = SCALE, shift: int = SHIFT, components: int = COMPONENTS) -> DataFrame:
    """A row for each row of ``df`` with a usable vector and each of the first ``components``: key, component, n, deviation,
    whitened, explained, identity_error."""
    good = df.where(usable(vector))
    d = dimension(good, vector)
    rows = packed(good, vector, [(quoted(key), key)], scale, d)
    model = fit(checkpointed(rows.select("x").distinct()), d, components) if d else None
    schema = T.StructType([rows.schema[0], *T._parse_datatype_string(_OUT).fields])
    if model is None:
        return df.sparkSession.createDataFrame([], schema)
    # The shift moves every vector and the sums alike; it leaves deviation, eigenpairs and projections as they are.
    n, k = model.n, len(model.values)
    base = np.array([round(s / n) for s in model.sums], np.int64)
    rest = np.array([s - n * b for s, b in zip(model.sums, base.tolist())], np.int64)
    mean = rest / n
    some = model.values > 0
    project = model.vectors[:, some] / np.sqrt(model.values[some])

    def deviations(x: np.ndarray) -> list[int | None]:
        if float(np.abs(x).max(initial=0)) * n + float(np.abs(rest).max(initial=0)) < 2**31 / np.sqrt(d):
            return ((n * x - rest) ** 2).sum(axis=1).tolist()
        exact = [sum((n * a - b) ** 2 for a, b in zip(row, rest.tolist())) for row in x.tolist()]
        return [e if e < 2**63 else None for e in exact]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for s in range(0, whole.num_rows, BLOCK):
                b = whole.slice(s, BLOCK)
                m = b.num_rows
                x = rows_of(b.column(1), d) - base
                w = np.full((m, k), np.nan)
                w[:, some] = (x - mean) @ project
                take = pa.array(np.repeat(np.arange(m), k))
                cells = [
                    b.column(0).take(take), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)),
                    pa.array(deviations(x), pa.int64()).take(take), pa.array(w.ravel(), from_pandas=True),
                    pa.array(np.tile(model.explained, m), from_pandas=True), pa.array(np.full(m * k, model.identity_error)),
                ]
                yield pa.RecordBatch.from_arrays(cells, names=schema.names)

    return rows.mapInArrow(task, schema)


@query("op12_whitening")
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable embedding projected on the first 16 components of the covariance of the different ones."""
    return whiten(table(spark, sf_dir, "embeddings"))
