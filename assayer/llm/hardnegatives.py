"""Hard negatives: rows of another label whose score lies in a window below that of a positive.

Scores are integer inner products. All rows are lifted on a sphere by one more coordinate, so for one anchor a higher score
is a smaller angle, and a window of scores is an annulus of angles around the anchor.

1. *Rows.* Equal vectors of one label are folded to the ids that can matter, the smallest ``POSITIVES`` + 1.
2. *Tree.* A bounded sample of the folded rows gives split points, at most ``FAN`` a node, chosen far from each other; a
   row goes to the nearest (a hyperplane lies between any two). All rows go down the tree to its leaves, and one
   pass over them stores, for every split point and every subtree beside it, the least and greatest angle between them.
3. *Search.* A need is an anchor, a range of scores and a number of rows. The sample, then the anchor's own leaf, give a
   score that enough rows reach. Going down, a subtree is left out if for any split point the angles of its rows and the
   annulus around the anchor cannot meet. What remains of the leaves is compared exactly.
4. *Exchange.* Needs that visit a leaf travel together, a row a leaf and block of needs; leaves are cut into chunks of
   about ``CHUNK`` rows. A task sorts chunks before their visits, holds one chunk and returns the best rows of each need.

The tree (at most ``SAMPLE`` / ``LEAF`` leaves or so) is broadcast and does not grow with the rows. Anchors of equal vector
and label, and positives of equal score, are one need each. Where angles prune little, as with unrelated vectors of
many dimensions, the search compares the anchors with all rows, in blocks; it stays exact.

* null label, null vector, null or non-finite component: no part. Null ids: no part, since such a row cannot be named.
* rows repeated with id, label and vector: one row. Rows of one id that differ: rows of their own; none is its own positive.
* shorter vectors: missing components count as zero. Ties of score: smaller id first. Empty table: no rows.
* zero vectors and negative scores: as any; a negative positive score has an empty window.
* components too large for exact 53-bit sums: an error. Other columns are not read, so their names do not matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from assayer.functions.columns import quoted
from assayer.functions.cutting import checkpointed
from assayer.llm.common import query, table
from assayer.llm.vectors import dimension, packed, rows_of, usable

SCALE = 256
ANCHOR_STEP = 50
POSITIVES, NEGATIVES = 5, 3
#: A negative's score times 100 lies between these times the positive's.
LOW, HIGH = 50, 95
FAN = 8
#: Rows the tree is grown from, and of those the most in a leaf.
SAMPLE, LEAF = 16_384, 256
DEEPEST = 12
CHUNK = 8_192
#: Needs that travel and are compared at once.
BLOCK, AT_ONCE = 1_024, 256
#: Angles this near to a bound count as within it; far above what rounding does to an angle.
SLACK = 1e-6
_KIND = "<i4"
_FAR = 2**62


@dataclass
class Node:
    """Split points with their lifts, and what lies under each: a node's number, or minus one minus a leaf's."""

    points: np.ndarray
    lifts: np.ndarray
    under: np.ndarray


class Tree:
    def __init__(self, sample: np.ndarray, radius: float):
        """Grown from the rows of ``sample``; ``radius`` is the length of the longest vector."""
        self.radius = radius or 1.0
        self.nodes: list[Node] = []
        self.n_leaves = 0
        self.low = self.high = np.zeros((0, FAN, FAN))
        draw = np.random.default_rng(71)
        x = sample.astype(float)
        lifts = self.lift(x)

        def grow(rows: np.ndarray, depth: int) -> int:
            if len(rows) > LEAF and depth < DEEPEST:
                tried = draw.choice(rows, min(len(rows), 3 * FAN), replace=False)
                near = self.angles(x[tried], lifts[tried], x[tried], lifts[tried])
                taken = [0]
                while len(taken) < min(FAN, len(tried)):
                    far = near[taken].min(axis=0)
                    if far.max() <= SLACK:
                        break
                    taken.append(int(far.argmax()))
                picked = tried[taken]
                own = self.angles(x[rows], lifts[rows], x[picked], lifts[picked]).argmin(axis=1)
                parts = [rows[own == j] for j in range(len(picked))]
                if sum(len(p) > 0 for p in parts) > 1:
                    at = len(self.nodes)
                    self.nodes.append(Node(x[picked], lifts[picked], np.zeros(len(picked), np.int64)))
                    self.nodes[at].under[:] = [grow(p, depth + 1) for p in parts]
                    return at
            self.n_leaves += 1
            return -self.n_leaves

        self.root = grow(np.arange(len(x)), 0)

    def lift(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.radius**2 - (x * x).sum(axis=1), 0))

    def angles(self, x: np.ndarray, lift: np.ndarray, points: np.ndarray, lifts: np.ndarray) -> np.ndarray:
        return np.arccos(np.clip((x @ points.T + np.outer(lift, lifts)) / self.radius**2, -1, 1))

    def place(self, x: np.ndarray, seen: Callable[[int, np.ndarray, np.ndarray], None] | None = None) -> np.ndarray:
        """The leaf of each row; ``seen`` is told of every node: its number, the angles there and the subtrees taken."""
        lift = self.lift(x)
        out = np.zeros(len(x), np.int64)
        waiting = [(self.root, np.arange(len(x)))]
        while waiting:
            at, rows = waiting.pop()
            if at < 0 or not len(rows):
                out[rows] = -at - 1
                continue
            node = self.nodes[at]
            angles = self.angles(x[rows], lift[rows], node.points, node.lifts)
            own = angles.argmin(axis=1)
            if seen:
                seen(at, angles, own)
            waiting.extend((int(u), rows[own == j]) for j, u in enumerate(node.under))
        return out

    def anchors(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Vectors turned to the sphere (no lift), with their lengths; a zero vector stays."""
        length = np.sqrt((x * x).sum(axis=1))
        return x * (self.radius / np.where(length > 0, length, 1))[:, None], length

    def visits(self, x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """(needs, leaves): which leaves may hold rows with scores from ``low`` to ``high``."""
        turned, length = self.anchors(x)
        # A zero vector scores 0 with every row, whatever the angle.
        most = self.radius * np.where(length > 0, length, 1)
        outer = np.arccos(np.clip(np.where(length > 0, low, -most) / most, -1, 1)) + SLACK
        inner = np.arccos(np.clip(np.where(length > 0, high, most) / most, -1, 1)) - SLACK
        out = np.zeros((len(x), self.n_leaves), bool)
        waiting = [(self.root, np.arange(len(x)))]
        while waiting:
            at, rows = waiting.pop()
            if not len(rows):
                continue
            if at < 0:
                out[rows, -at - 1] = True
                continue
            node = self.nodes[at]
            k = len(node.under)
            d = self.angles(turned[rows], np.zeros(len(rows)), node.points, node.lifts)[:, :, None]
            least, most_ = self.low[at, :k, :k][None], self.high[at, :k, :k][None]
            near = np.maximum(d - most_, least - d).max(axis=1) <= outer[rows, None]
            far = (d + most_).min(axis=1) >= inner[rows, None]
            keep = near & far
            waiting.extend((int(u), rows[keep[:, j]]) for j, u in enumerate(node.under))
        return out

    def home(self, x: np.ndarray) -> np.ndarray:
        turned, _ = self.anchors(x)
        out = np.zeros((len(x), self.n_leaves), bool)
        out[np.arange(len(x)), self.place(turned)] = True
        return out


@dataclass
class Index:
    """Rows by leaf and chunk, the tree with its ranges, and the sample with labels."""

    rows: DataFrame
    tree: Tree
    d: int
    chunks: np.ndarray
    sample: np.ndarray
    labels: np.ndarray


def _fold(rows: DataFrame) -> DataFrame:
    """(x, label, ids): different vectors of a label, with their smallest ids."""
    order = Window.partitionBy("x", "label").orderBy("id")
    first = rows.select("id", "x", "label").distinct().withColumn("at", F.row_number().over(order)).where(F.col("at") <= POSITIVES + 1)
    return first.groupBy("x", "label").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def build_index(rows: DataFrame, d: int) -> Index:
    """An index of all ``rows`` (id, label, x)."""
    points = checkpointed(_fold(rows))

    def norms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = rows_of(b.column(0), d, _KIND).astype(float)
            yield pa.RecordBatch.from_arrays([pa.array((x * x).sum(axis=1))], names=["norm"])

    longest = points.select("x").mapInArrow(norms, "norm double").agg(F.max("norm")).first()[0] or 0.0
    taken = points.select("x", "label").orderBy(F.xxhash64("x", "label"), "x", "label").limit(SAMPLE).toPandas()
    sample = np.frombuffer(b"".join(map(bytes, taken["x"])), _KIND).reshape(len(taken), d)
    tree = Tree(sample, float(np.sqrt(longest)))
    sent = points.sparkSession.sparkContext.broadcast(tree)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaf = sent.value.place(rows_of(b.column(0), d, _KIND).astype(float))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf.astype(np.int32))], names=["x", "label", "ids", "leaf"])

    kept = checkpointed(points.mapInArrow(placed, T.StructType([*points.schema.fields, T.StructField("leaf", T.IntegerType())])))

    def ranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = sent.value
        low, high = np.full((len(tree.nodes), FAN, FAN), np.inf), np.full((len(tree.nodes), FAN, FAN), -np.inf)

        def seen(at: int, angles: np.ndarray, own: np.ndarray) -> None:
            k = angles.shape[1]
            for j in np.unique(own):
                part = angles[own == j]
                low[at, :k, j] = np.minimum(low[at, :k, j], part.min(axis=0))
                high[at, :k, j] = np.maximum(high[at, :k, j], part.max(axis=0))

        for b in batches:
            tree.place(rows_of(b.column(0), d, _KIND).astype(float), seen)
        at, i, j = np.nonzero(np.isfinite(low))
        cells = [pa.array(c.astype(np.int32)) for c in (at, i, j)] + [pa.array(low[at, i, j]), pa.array(high[at, i, j])]
        yield pa.RecordBatch.from_arrays(cells, names=["at", "i", "j", "low", "high"])

    # One row a split point and subtree, whatever the rows.
    ranges = kept.select("x").mapInArrow(ranged, "at int, i int, j int, low double, high double")
    found = ranges.groupBy("at", "i", "j").agg(F.min("low").alias("low"), F.max("high").alias("high")).toPandas()
    tree.low, tree.high = np.full((len(tree.nodes), FAN, FAN), np.inf), np.full((len(tree.nodes), FAN, FAN), -np.inf)
    where = tuple(found[c].to_numpy() for c in ("at", "i", "j"))
    tree.low[where], tree.high[where] = found["low"], found["high"]
    sizes = kept.groupBy("leaf").count().toPandas()
    chunks = np.zeros(tree.n_leaves, np.int64)
    chunks[sizes["leaf"].to_numpy()] = -(-sizes["count"].to_numpy() // CHUNK)
    return Index(kept, tree, d, chunks, sample, taken["label"].to_numpy(np.int64))


def _best(need: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first ``k`` of each need by falling score, then id."""
    order = np.lexsort((ids, -score, need))
    sorted_need = need[order]
    start = np.searchsorted(sorted_need, sorted_need, "left")
    return order[np.arange(len(order)) - start < k]


_FOUND = T.StructType([T.StructField("need", T.BinaryType()), T.StructField("score", T.LongType()), T.StructField("id", T.LongType())])


def search(index: Index, needs: DataFrame, k: int, same: bool) -> DataFrame:
    """(need, score, id, rank): the first ``k`` rows with scores from ``low`` to ``high``, of the need's label if ``same``, else
    of another one. ``needs``: need, query (equal for equal vectors), x, label, low, high."""
    spark, d, chunks = needs.sparkSession, index.d, index.chunks
    sent = spark.sparkContext.broadcast((index.tree, index.sample.astype(float), index.labels))
    row = "leaf int, chunk int, kind int, x binary, label long, ids binary"
    points = index.rows.select(
        "leaf", "x", "label", "ids", F.element_at(F.array(*map(F.lit, chunks.tolist() or [0])), F.col("leaf") + 1).alias("of")
    )

    def as_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            ids = [np.array(i, np.int64).tobytes() for i in b.column("ids").to_pylist()]
            cells = [b.column("leaf"), b.column("chunk"), pa.array(np.zeros(n, np.int32)), b.column("x"), b.column("label"), pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays(cells, names=["leaf", "chunk", "kind", "x", "label", "ids"])

    stored = points.withColumn("chunk", F.pmod(F.xxhash64("x", "label"), F.greatest("of", F.lit(1))).cast("int")).drop("of").mapInArrow(as_rows, row)

    def visiting(home: bool):
        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tree, sample, labels = sent.value
            for whole in batches:
                for s in range(0, whole.num_rows, BLOCK):
                    b = whole.slice(s, BLOCK)
                    x = rows_of(b.column("x"), d, _KIND).astype(float)
                    low, high, label = (b.column(c).to_numpy().copy() for c in ("low", "high", "label"))
                    _, first, own = np.unique(np.array(b.column("query").to_pylist(), "S16"), return_index=True, return_inverse=True)
                    if home:
                        _raise(low, high, label, x, sample, labels, k, same)
                    hits = tree.home(x) if home else tree.visits(x, low.astype(float), high.astype(float))
                    names = np.array(b.column("need").to_pylist(), "S16")
                    for leaf in np.flatnonzero(hits.any(axis=0)):
                        rows = np.flatnonzero(hits[:, leaf])
                        queries, at = np.unique(own[rows], return_inverse=True)
                        vectors = x[first[queries]].astype(_KIND).tobytes()
                        meta = np.column_stack([at, low[rows], high[rows], label[rows]]).astype(np.int64).tobytes() + b"".join(n.ljust(16, b"\0") for n in names[rows].tolist())
                        m = int(chunks[leaf])
                        cells = [np.full(m, leaf, np.int32), np.arange(m, dtype=np.int32), np.ones(m, np.int32)]
                        yield pa.RecordBatch.from_arrays(
                            [*map(pa.array, cells), pa.array([vectors] * m, pa.binary()), pa.nulls(m, pa.int64()), pa.array([meta] * m, pa.binary())],
                            names=["leaf", "chunk", "kind", "x", "label", "ids"],
                        )

        return task

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        last, ready = None, None
        for whole in batches:
            for s in range(0, whole.num_rows, 512):
                for r in whole.slice(s, 512).to_pylist():
                    key = (r["leaf"], r["chunk"])
                    if key != last:
                        last, ready = key, None
                        held.clear()
                    if r["kind"] == 0:
                        held.append((r["x"], r["label"], r["ids"]))
                        continue
                    if not held:
                        continue
                    if ready is None:
                        vectors = np.frombuffer(b"".join(h[0] for h in held), _KIND).reshape(-1, d).astype(float)
                        ids = [np.frombuffer(h[2], np.int64) for h in held]
                        counts = np.array([len(i) for i in ids])
                        ready = vectors, np.array([h[1] for h in held]), np.concatenate(ids), np.cumsum(counts) - counts, counts
                    yield from _compared(r["x"], r["ids"], d, ready, k, same)

    def results(rows: DataFrame, home: bool) -> DataFrame:
        visits = rows.select("need", "query", "x", "label", "low", "high").mapInArrow(visiting(home), row)
        dealt = stored.union(visits).repartition("leaf", "chunk").sortWithinPartitions("leaf", "chunk", "kind")
        found = dealt.mapInArrow(compare, _FOUND)
        order = Window.partitionBy("need").orderBy(F.desc("score"), "id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    reached = results(needs, True).where(F.col("rank") == k).select(F.col("need").alias("of"), F.col("score").alias("reached"))
    bounded = needs.join(reached, F.col("need") == F.col("of"), "left").withColumn(
        "low", F.greatest("low", F.coalesce("reached", F.col("low")))
    )
    return checkpointed(results(bounded, False))


def _raise(low, high, label, x, sample, labels, k: int, same: bool) -> None:
    """Raise ``low`` to the k-th best score that rows of the sample reach within the range."""
    for s in range(0, len(x), AT_ONCE):
        scores = x[s : s + AT_ONCE] @ sample.T
        fits = (labels[None, :] == label[s : s + AT_ONCE, None]) == same
        fits &= (scores >= low[s : s + AT_ONCE, None]) & (scores <= high[s : s + AT_ONCE, None])
        scores[~fits] = -np.inf
        if scores.shape[1] >= k:
            kth = np.partition(scores, -k, axis=1)[:, -k]
            good = np.isfinite(kth)
            low[s : s + AT_ONCE][good] = np.maximum(low[s : s + AT_ONCE][good], kth[good].astype(np.int64))


def _compared(vectors: bytes, meta: bytes, d: int, ready: tuple, k: int, same: bool) -> Iterator[pa.RecordBatch]:
    """The best rows of a chunk for each of the needs that visit it."""
    n = len(meta) // 48
    queries = np.frombuffer(vectors, _KIND).reshape(-1, d).astype(float)
    at, low, high, label = np.frombuffer(meta, np.int64, 4 * n).reshape(n, 4).T
    names = [meta[32 * n + 16 * i : 32 * n + 16 * i + 16] for i in range(n)]
    x, labels, ids, first, counts = ready
    for s in range(0, n, AT_ONCE):
        part = slice(s, s + AT_ONCE)
        used, own = np.unique(at[part], return_inverse=True)
        scores = (queries[used] @ x.T)[own]
        fits = (scores >= low[part, None]) & (scores <= high[part, None]) & ((labels[None, :] == label[part, None]) == same)
        need, point = np.nonzero(fits)
        if not len(need):
            continue
        # Every point may stand for several ids.
        many = counts[point]
        need, point, score = np.repeat(need, many), np.repeat(point, many), np.repeat(scores[need, point], many)
        inside = np.arange(len(need)) - np.repeat(np.cumsum(many) - many, many)
        found = ids[first[point] + inside]
        best = _best(need, score, found, k)
        yield pa.RecordBatch.from_arrays(
            [pa.array([names[s + i] for i in need[best].tolist()], pa.binary()), pa.array(score[best].astype(np.int64)), pa.array(found[best])],
            names=["need", "score", "id"],
        )


def _named(*parts: str) -> F.Column:
    """Sixteen bytes that stand for the parts."""
    return F.unhex(F.md5(F.concat_ws("|", *(F.hex(p) if p in ("x", "query") else F.col(p).cast("string") for p in parts))))


def mine(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: F.Column | None = None, anchor: F.Column | None = None, scale: int = SCALE) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for every row where ``anchor`` holds."""
    label = F.col("label") if label is None else label
    anchor = F.pmod(quoted(key), F.lit(ANCHOR_STEP)) == 0 if anchor is None else anchor
    good = df.where(usable(vector) & label.isNotNull() & quoted(key).isNotNull())
    d = dimension(good, vector)
    largest = int((2**53 / max(d, 1)) ** 0.5)
    keep = [(quoted(key).cast("bigint"), "id"), (label.cast("bigint"), "label"), (F.coalesce(anchor, F.lit(False)), "anchor")]
    rows = checkpointed(packed(good, vector, keep, scale, d, _KIND, min(largest, 2**31)))
    index = build_index(rows, d)
    anchors = checkpointed(rows.where("anchor").select("id", "x", "label").distinct().withColumn("query", _named("x", "label")))
    queries = anchors.select("query", "x", "label").distinct()
    first = search(index, queries.withColumns({"need": F.col("query"), "low": F.lit(-_FAR), "high": F.lit(_FAR)}), POSITIVES + 1, True)
    order = Window.partitionBy("anchor_id", "query").orderBy(F.desc("score"), "id")
    positives = checkpointed(
        anchors.select(F.col("id").alias("anchor_id"), "query", "x", "label").join(first.drop("rank"), F.col("query") == F.col("need"))
        .where("id != anchor_id").withColumn("at", F.row_number().over(order)).where(F.col("at") <= POSITIVES)
        .select("anchor_id", "query", "x", "label", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
        .withColumn("need", _named("query", "positive_score"))
    )
    low, high = F.expr(f"({LOW} * positive_score + 99) div 100"), F.expr(f"({HIGH} * positive_score) div 100")
    windows = positives.select("need", "query", "x", "label", low.alias("low"), high.alias("high"), "positive_score").where(
        "positive_score >= 0 and low <= high"
    ).drop("positive_score").dropDuplicates(["need"])
    found = search(index, windows, NEGATIVES, False).select(
        F.col("need").alias("of"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")
    )
    return positives.join(found, F.col("need") == F.col("of")).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"
    )


_SQL = f"""
WITH r AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda c: floor({SCALE} * c::DOUBLE)) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c::DOUBLE))) = 0),
s AS (
  SELECT a.id AS anchor_id, b.id AS id, a.label = b.label AS same, list_inner_product(a.x, b.x)::BIGINT AS score
  FROM r a JOIN r b ON a.id <> b.id WHERE a.id % {ANCHOR_STEP} = 0),
p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= {POSITIVES})
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same
  AND {LOW} * positive_score <= 100 * score AND 100 * score <= {HIGH} * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, s.id)
QUALIFY row_number() OVER w <= {NEGATIVES}
"""


@query("op11_hard_negatives", _SQL)
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every fiftieth embedding, with a seventh of the labels moved on."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(table(spark, sf_dir, "embeddings"), label=label)
