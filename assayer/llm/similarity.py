"""Texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, by a chosen-path join.

1. *Sets.* A text becomes its set of shingle codes; texts with equal sets form one class, and only classes go on. A
   class is embedded as ``COORDINATES`` min-hash values, so sets of any size have equally many tokens.
2. *Paths.* In each run a class follows random paths: at a node, a hash of the node chooses one or two coordinates
   (1 / similarity on average), and the class goes on to the child named by each coordinate's value. Classes meet in
   a child only if they share the chosen token. Nodes with one class end; nodes with up to ``BUCKET`` classes are
   compared by brute force on the embedding; larger nodes are compared with up to ``HEADS`` of their classes and split
   again. The runs go in portions, and each counts on what came before: a class carries a hash of its candidate group, and a node
   whose classes all lie in one group ends by an aggregate, before any join. A pair at the threshold survives to depth
   ``DEEPEST`` in a run with a probability that follows from the branching and from how many of the coordinates the pair
   happens to share; the runs are as many as the target recall needs. Nodes that are still large then are split on
   to ``LAST``, and joined whole if even that does not part them.
3. *Groups.* Pairs that agree well enough on the embedding are joined into candidate groups by connected components.
4. *Exact check.* In each candidate group every pair of classes is compared on the true sets, once, in tiles of at
   most about two blocks. A tile returns a count of links for each class and a spanning forest, never the pairs.
   Components of the verified links are the result.

A pair is found if any run brings it together, or if both sides are linked to one candidate group. No group meets in
one task: equal sets are folded by grouped minima first, large groups go to as many tiles as pairs of blocks.

* null text and text without words: no shingles, no links, class of its own (class id null only if the id is).
* less than five words: one shingle. Upper case and marks do not matter. Repeated rows: one output row each, in one
  class. Null ids: a class's id is its smallest non-null id. Empty table: no rows. Names beginning with ``__`` are taken.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from assayer.functions.columns import quoted
from assayer.functions.cutting import checkpointed, narrowed, swept, together
from assayer.llm.common import coded_words, map_texts, query, shingles, stirred, table
from assayer.llm.components import components

SIMILARITY = 0.8
WIDTH = 5
COORDINATES = 64
RECALL = 0.99
FIRST_DEPTH, DEEPEST, LAST = 3, 8, 12
BUCKET = 64
HEADS = 4
#: Runs taken at once; the last portion goes on to the number that the recall needs.
PORTIONS = (1,)
#: How far below the threshold an estimate from the embedding may lie: four standard errors.
SLACK = 0.2
BLOCK = 1024
BLOCK_SHINGLES = 1_000_000
#: Bound of the broadcast table of hash buckets.
NEAR_BUCKETS = 2**20
SECOND_CHANCE = 0.25  # one coordinate is always chosen, another with this probability: 1.25 = 1 / 0.8

_random = np.random.default_rng(20_170_613)
_FLIP = _random.integers(0, 2**32, COORDINATES, np.uint32)
_TURN = _random.integers(0, 2**32, COORDINATES, np.uint32) | np.uint32(1)


def survival(depth: int, similarity: float = SIMILARITY) -> float:
    """Probability that a pair at the threshold still shares a node at ``depth`` in one run."""
    lost = 0.0
    for _ in range(depth):
        one = 1 - similarity + similarity * lost
        lost = (1 - SECOND_CHANCE) * one + SECOND_CHANCE * one * one
    return 1 - lost


def recall_of(runs: int, depth: int = DEEPEST, similarity: float = SIMILARITY) -> float:
    """Probability that some run brings a pair together at ``depth``. All runs use the same coordinates, of which a pair shares
    a binomial number."""
    n = COORDINATES
    shared = (math.comb(n, k) * similarity**k * (1 - similarity) ** (n - k) for k in range(n + 1))
    return sum(p * (1 - (1 - survival(depth, k / n)) ** runs) for k, p in enumerate(shared))


def runs_for(recall: float = RECALL, depth: int = DEEPEST) -> int:
    runs = 1
    while recall_of(runs, depth) < recall:
        runs += 1
    return runs


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    return np.unique(shingles(coded_words(text.lower())[0], width)) if text else np.zeros(0, np.uint64)


def embed(codes: np.ndarray) -> np.ndarray:
    """Min-hash values of a set, 32 bits each."""
    high = (codes >> np.uint64(32)).astype(np.uint32)
    low = np.full(COORDINATES, np.iinfo(np.uint32).max, np.uint32)
    for s in range(0, len(high), 1024):
        low = np.minimum(low, ((high[s : s + 1024, None] ^ _FLIP) * _TURN).min(axis=0))
    return low


def sketch(df: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` with __set (128-bit name of the shingle set, null if empty), __size and __values."""

    def run(texts: list[str | None]):
        names, sizes, values = [], [], []
        for t in texts:
            codes = shingle_set(t)
            sizes.append(len(codes))
            names.append(xxhash.xxh3_128_digest(codes.tobytes()) if len(codes) else None)
            values.append(embed(codes).tobytes() if len(codes) else None)
        return names, sizes, values

    fields = [
        T.StructField("__set", T.BinaryType()), T.StructField("__size", T.LongType()),
        T.StructField("__values", T.BinaryType()),
    ]
    return map_texts(df, run, fields, keep, text)


def _branch(rows: np.ndarray, nodes: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One level down: (row, child) for every coordinate each node chooses."""
    a = stirred(nodes * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
    b = stirred(a + np.uint64(0xD1B54A32D192ED03))
    first = (a >> np.uint64(40)) % np.uint64(COORDINATES)
    second = (b >> np.uint64(40)) % np.uint64(COORDINATES)
    more = ((b & np.uint64(0xFFFF)) < np.uint64(int(SECOND_CHANCE * 65536))) & (second != first)
    rows = np.concatenate([rows, rows[more]])
    nodes = np.concatenate([nodes, nodes[more]])
    chosen = np.concatenate([first, second[more]]).astype(np.int64)
    token = values[rows, chosen].astype(np.uint64) * np.uint64(COORDINATES) + chosen.astype(np.uint64)
    return rows, stirred(nodes * np.uint64(0xBF58476D1CE4E5B9) + stirred(token + np.uint64(7)))


def _matrix(column: pa.Array) -> np.ndarray:
    cells = column.to_pylist()
    return np.frombuffer(b"".join(cells), np.uint32).reshape(len(cells), COORDINATES)


_PATHS = T.StructType([
    T.StructField("set", T.BinaryType()), T.StructField("group", T.LongType()), T.StructField("node", T.LongType()),
])


def _paths(frame: DataFrame, depth: int, runs: Sequence[int] | None) -> DataFrame:
    """(set, group, node) ``depth`` levels below the roots of ``runs``, or below the rows' own ``node``."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 4096):
                batch = whole.slice(start, 4096)
                values = _matrix(batch.column("values"))
                n = batch.num_rows
                if runs is None:
                    rows, nodes = np.arange(n), batch.column("node").to_numpy().astype(np.int64).view(np.uint64)
                else:
                    rows = np.tile(np.arange(n), len(runs))
                    roots = np.array([r + 1 for r in runs], np.uint64)
                    nodes = np.repeat(stirred(roots * np.uint64(0xD1B54A32D192ED03)), n)
                for _ in range(depth):
                    rows, nodes = _branch(rows, nodes, values)
                at = pa.array(rows)
                cells = [batch.column("set").take(at), batch.column("group").take(at), pa.array(nodes.view(np.int64))]
                yield pa.RecordBatch.from_arrays(cells, names=_PATHS.names)

    return frame.mapInArrow(task, _PATHS)


class Forest:
    """Union by smallest index."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)


_EDGES = T.StructType([T.StructField("a", T.BinaryType()), T.StructField("b", T.BinaryType())])


def _compare_buckets(buckets: DataFrame) -> DataFrame:
    """A spanning forest of the pairs in each bucket that agree well enough on the embedding."""
    need = math.ceil((SIMILARITY - SLACK) * COORDINATES)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for members in batch.column("members").to_pylist():
                names = [m["set"] for m in members]
                v = np.frombuffer(b"".join(m["values"] for m in members), np.uint32).reshape(len(names), -1)
                forest = Forest(len(names))
                for i in range(len(names) - 1):
                    for j in np.flatnonzero((v[i + 1 :] == v[i]).sum(axis=1) >= need).tolist():
                        forest.join(i, i + 1 + j)
                for i in range(len(names)):
                    r = forest.root(i)
                    if r != i:
                        a.append(names[i])
                        b.append(names[r])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    return buckets.mapInArrow(task, _EDGES)


def _match_heads(members: DataFrame) -> DataFrame:
    """Edges from each of ``members`` (set, values, heads) to the heads (set, values) of its node that it agrees with."""
    need = math.ceil((SIMILARITY - SLACK) * COORDINATES)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                heads = batch.column("heads")
                of = np.repeat(np.arange(batch.num_rows), np.diff(heads.offsets.to_numpy()))
                flat = heads.flatten()
                same = (_matrix(batch.column("values"))[of] == _matrix(flat.field("values"))).sum(axis=1) >= need
                found = pa.array(np.flatnonzero(same))
                a, b = batch.column("set").take(pa.array(of)).take(found), flat.field("set").take(found)
                yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pc.not_equal(a, b))

    return members.mapInArrow(task, _EDGES)


def _grouped_with(edges: DataFrame, grouped: DataFrame | None) -> DataFrame | None:
    """``grouped`` (node, component) after ``edges`` have joined groups; as it is if there are none."""
    edges = narrowed(edges.distinct())
    if edges.isEmpty():
        return grouped
    if grouped is not None:
        edges = together(edges.union(grouped.select(F.col("node").alias("a"), F.col("component").alias("b"))), edges, grouped)
    return components(edges)


def _labelled(rows: DataFrame, grouped: DataFrame | None) -> DataFrame:
    """``rows`` with a number for the candidate group of their ``set``; a class of no group is one of its own."""
    if grouped is None:
        return rows.withColumn("group", F.xxhash64("set"))
    known = grouped.select(F.col("node").alias("is"), "component")
    return rows.join(known, F.col("set") == F.col("is"), "left").withColumn("group", F.xxhash64(F.coalesce("component", "set"))).drop("is", "component")


def _with_values(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """``rows`` with the values of their ``set``. Classes outside the hash buckets of ``rows`` are not moved; the broadcast table
    holds at most NEAR_BUCKETS numbers, and once it is full the join decides as before."""
    bucket = F.pmod(F.xxhash64("set"), F.lit(NEAR_BUCKETS))
    near = rows.select(bucket.alias("bucket")).distinct()
    close = classes.select(F.col("set").alias("own"), "values", bucket.alias("__in")).join(
        F.broadcast(near), F.col("__in") == F.col("bucket"), "left_semi"
    )
    return rows.join(close.drop("__in"), F.col("set") == F.col("own")).drop("own")


def _follow(classes: DataFrame, runs: Sequence[int], grouped: DataFrame | None) -> DataFrame | None:
    """The candidate groups after ``runs`` more runs.

    Groups are joined after the first level, where most pairs meet, and at the end; in between, nodes are judged by the groups
    known so far.
    """
    frontier = narrowed(_paths(_labelled(classes.select("set", "values"), grouped), FIRST_DEPTH, runs))
    later: list[DataFrame] = []
    for depth in range(FIRST_DEPTH, LAST + 1):
        sizes = frontier.groupBy("node").agg(
            F.count("*").alias("n"), F.min("set").alias("first"), F.min("group").alias("low"), F.max("group").alias("high")
        ).where("n > 1 and low != high").select(F.col("node").alias("at"), "n", "first")
        found = narrowed(frontier.join(sizes, F.col("node") == F.col("at")).select("set", "node", "n", "first"))
        # Files of tables that are no longer needed go before the next ones are written.
        del frontier, sizes
        swept(classes.sparkSession)
        met = narrowed(_with_values(found, classes))
        del found
        buckets = met.where(F.col("n") <= BUCKET).groupBy("node").agg(
            F.collect_list(F.struct("set", "values")).alias("members")
        )
        large = met.where(F.col("n") > BUCKET)
        heads = (
            large.groupBy("node", F.pmod(F.xxhash64("set"), F.lit(HEADS)).alias("turn")).agg(F.min(F.struct("set", "values")).alias("head"))
            .groupBy(F.col("node").alias("at")).agg(F.collect_list("head").alias("heads"))
        )
        members = large.join(heads, F.col("node") == F.col("at")).select("set", "values", "heads")
        edges = together(_compare_buckets(buckets.select("members")).union(_match_heads(members)), met)
        if depth == FIRST_DEPTH:
            grouped = _grouped_with(edges, grouped)
        else:
            later.append(narrowed(edges.distinct()))
        del met, buckets, heads, members, edges
        if large.isEmpty():
            break
        swept(classes.sparkSession)
        # A large node whose classes all lie in one group needs no splitting: its pairs will be compared exactly.
        label = narrowed(_labelled(large.select("set", "values", "node", "first"), grouped))
        del large
        mixed = label.groupBy("node").agg(F.min("group").alias("low"), F.max("group").alias("high")).where("low != high").select(
            F.col("node").alias("at")
        )
        rest = label.join(mixed, F.col("node") == F.col("at"), "left_semi")
        if depth == LAST:
            later.append(rest.where(F.col("set") != F.col("first")).select(F.col("set").alias("a"), F.col("first").alias("b")))
            break
        frontier = narrowed(_paths(rest.select("set", "group", "values", "node"), 1, None))
        del label, mixed, rest
        if frontier.isEmpty():
            break
    if later:
        grouped = _grouped_with(functools.reduce(DataFrame.union, later), grouped)
    return grouped


def candidate_groups(classes: DataFrame, recall: float = RECALL) -> DataFrame:
    """(node, component): candidate groups among ``classes`` (set, values)."""
    left, grouped = list(range(runs_for(recall))), None
    for size in (*PORTIONS, len(left)):
        now, left = left[:size], left[size:]
        if now:
            grouped = _follow(classes, now, grouped)
            swept(classes.sparkSession)
    if grouped is None:
        return classes.select(F.col("set").alias("node"), F.col("set").alias("component")).where("false")
    return grouped


def _tile(rows: list[dict], within: bool) -> tuple[list[bytes], list[bytes], list[int]]:
    """(class, root in the tile's forest, links) of a tile's ``rows``, side 0 first: side 0 ``within`` itself, or against
    side 1, where either may be empty."""
    if not within and len({r["side"] for r in rows}) < 2:
        return [], [], []
    sets = [np.frombuffer(r["codes"], np.uint64) for r in rows]
    side = np.array([r["side"] for r in rows])
    sizes = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    codes = np.concatenate(sets)
    order = np.argsort(codes, kind="stable")
    codes, owner = codes[order], owner[order]
    fresh = np.concatenate([[True], codes[1:] != codes[:-1]])
    number = np.cumsum(fresh) - 1
    shared = np.bincount(number) > 1
    renumber = np.cumsum(shared) - 1
    keep = shared[number]
    owner, number = owner[keep], renumber[number[keep]]
    left = int((side == 0).sum())
    right = np.arange(len(sets)) if within else np.arange(left, len(sets))
    common = np.zeros((left, len(right)), np.float32)
    step = min(4096, int(shared.sum()) or 1)
    for s in range(0, int(shared.sum()), step):
        lo, hi = np.searchsorted(number, [s, s + step])
        x = np.zeros((len(sets), step), np.float32)
        x[owner[lo:hi], number[lo:hi] - s] = 1
        common += x[:left] @ x[right].T
    common = np.rint(common).astype(np.int64)
    top, whole = round(SIMILARITY * 10), 10
    linked = whole * common >= top * (sizes[:left, None] + sizes[right][None, :] - common)
    if within:
        np.fill_diagonal(linked, False)
    texts = np.array([r["texts"] for r in rows], np.int64)
    links = np.zeros(len(sets), np.int64)
    links[:left] += linked @ texts[right]
    if not within:
        links[left:] += texts[:left] @ linked
    forest = Forest(len(sets))
    for i in range(left):
        for j in np.flatnonzero(linked[i]).tolist():
            forest.join(i, int(right[j]))
    return [r["set"] for r in rows], [rows[forest.root(i)]["set"] for i in range(len(rows))], links.tolist()


def verified(groups: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, links) from the exact comparison within ``groups`` (set, group, size, texts) over ``sets`` (set, codes)."""
    sizes = groups.groupBy("group").agg(
        F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("size") / BLOCK_SHINGLES)).cast("int").alias("blocks")
    ).select(F.col("group").alias("of"), "blocks")
    placed = (
        groups.join(sizes, F.col("group") == F.col("of"))
        .withColumn("block", F.pmod(F.xxhash64("set"), F.col("blocks").cast("bigint")).cast("int"))
        .select(F.col("set").alias("own"), "group", "texts", "block", "blocks")
        .join(sets, F.col("own") == F.col("set"))
        .select("set", "group", "texts", "block", "codes", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    )
    tiles = placed.select(
        "set", "texts", "codes", "group", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
        (F.col("block") > F.col("other")).cast("int").alias("side"),
    )

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come sorted by tile, so only one tile is held at a time.
        held: list[dict] = []
        out: tuple[list, list, list] = ([], [], [])

        def close() -> None:
            if held:
                for column, more in zip(out, _tile(held, last[1] == last[2])):
                    column.extend(more)
                held.clear()

        def made() -> pa.RecordBatch:
            kinds = (pa.binary(), pa.binary(), pa.int64())
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["a", "b", "links"])
            for column in out:
                column.clear()
            return batch

        last = None
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                for row in whole.slice(start, 512).to_pylist():
                    tile = (row["group"], row["i"], row["j"])
                    if tile != last:
                        close()
                        last = tile
                    held.append(row)
            if out[0]:
                yield made()
        close()
        yield made()

    order = ["group", "i", "j"]
    return tiles.repartition(*order).sortWithinPartitions(*order, "side", "set").mapInArrow(
        task, "a binary, b binary, links long"
    )


def join_similar(df: DataFrame, text: str = "text", key: str = "doc_id", recall: float = RECALL) -> DataFrame:
    """A row for each row of ``df``: key, __text (hash of the text), class_id (smallest id among all similar texts),
    set_id (smallest id among texts with the same shingles), n_links (different texts that are similar), is_first
    (the row's id and text represent the class)."""
    hashed = df.select(quoted(key).alias("__key"), quoted(text).alias("__body"), F.xxhash64(quoted(text)).alias("__text"))
    sketched = checkpointed(sketch(hashed, "__body", ["__key", "__text"]))
    texts = sketched.where("__set is not null").groupBy("__set", "__text").agg(
        F.min("__key").alias("key"), F.min("__size").alias("size"), F.min("__values").alias("values")
    )
    classes = narrowed(
        texts.groupBy(F.col("__set").alias("set")).agg(
            F.count("*").alias("texts"), F.min(F.struct(F.col("key").isNull().alias("no"), "key", "__text")).alias("first"),
            F.min("size").alias("size"), F.min("values").alias("values"),
        ).select("set", "texts", "size", "values", F.col("first.key").alias("key"), F.col("first.__text").alias("text"))
    )
    grouped = candidate_groups(classes, recall)
    groups = narrowed(
        grouped.join(classes.drop("values"), F.col("node") == F.col("set"))
        .select("set", F.col("component").alias("group"), "size", "texts", "key", "text")
    )
    # Texts of classes in groups alone: one row each, found again by id and text hash.
    wanted = groups.select(F.col("key").alias("k"), F.col("text").alias("t"))
    # Most texts are not wanted. Their hashes fall outside a table of at most NEAR_BUCKETS numbers, broadcast, so they are
    # not shuffled; once every bucket is taken the filter passes all, and the join decides as before.
    near = wanted.select(F.pmod(F.col("t"), F.lit(NEAR_BUCKETS)).alias("bucket")).distinct()
    close = hashed.join(F.broadcast(near), F.pmod(F.col("__text"), F.lit(NEAR_BUCKETS)) == F.col("bucket"), "left_semi")
    bodies = close.join(wanted, F.col("__key").eqNullSafe(F.col("k")) & (F.col("__text") == F.col("t")), "left_semi")

    def run(found: list[str | None]):
        sets = [shingle_set(t) for t in found]
        return [xxhash.xxh3_128_digest(s.tobytes()) for s in sets], [s.tobytes() for s in sets]

    fields = [T.StructField("set", T.BinaryType()), T.StructField("codes", T.BinaryType())]
    sets = map_texts(bodies, run, fields, [], "__body").dropDuplicates(["set"])
    swept(df.sparkSession)
    links = narrowed(verified(groups.drop("key", "text"), sets))
    swept(df.sparkSession)
    counted = links.groupBy(F.col("a").alias("set")).agg(F.sum("links").alias("links"))
    joined = components(links)
    per = (
        classes.drop("values", "size")
        .join(counted.withColumnRenamed("set", "s1"), F.col("set") == F.col("s1"), "left")
        .join(joined, F.col("set") == F.col("node"), "left")
        .select("set", "texts", "key", "text", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "set").alias("cluster"))
    )
    heads = per.groupBy("cluster").agg(
        F.min(F.struct(F.col("key").isNull().alias("no"), "key", "text")).alias("head")
    ).select(F.col("cluster").alias("c"), F.col("head.key").alias("head_key"), F.col("head.text").alias("head_text"))
    named = per.join(heads, F.col("cluster") == F.col("c")).select(
        "set", "key", "texts", "links", "head_key", "head_text"
    )
    return sketched.join(named, F.col("__set") == F.col("set"), "left").select(
        F.col("__key").alias(key), "__text",
        F.when(F.col("__set").isNull(), F.col("__key")).otherwise(F.col("head_key")).alias("class_id"),
        F.when(F.col("__set").isNull(), F.col("__key")).otherwise(F.col("key")).alias("set_id"),
        F.coalesce(F.col("links") + F.col("texts") - 1, F.lit(0)).alias("n_links"),
        (F.col("__set").isNull() | (F.col("__key").eqNullSafe(F.col("head_key")) & (F.col("__text") == F.col("head_text")))).alias("is_first"),
    )


@query("op5_jaccard_join")
def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class of similar texts and the number of texts it is similar to."""
    return join_similar(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "set_id", "n_links")
