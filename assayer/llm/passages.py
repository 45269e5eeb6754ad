"""Repeated passages across documents: near-equal paragraphs by MinHash banding, and equal runs of words inside them.

Units of a document are its paragraphs (lines of at least ``MIN_WORDS`` words) and, so that a passage set into other
text is found too, runs of ``RUN`` words that start at anchors. An anchor is a word pair whose hash is the least within
``REACH`` places, equal ones included; it depends on the words around it alone, so a passage has the same anchors
wherever it stands. Where ``PASSAGE`` words hold no such run, the least pair that begins a run inside them is an
anchor too, so every passage of ``PASSAGE`` words or more holds a whole run. Of equal runs that follow each other in
periodic text, one in about ``RUN`` words is taken. Verified runs are grown to where the words differ.

0. *Copies.* Equal texts are folded: the document of the smallest id stands for all, and the others are spans from the first
   word to the last. Texts that stand alone are not moved for it.
1. *Bands.* A paragraph's shingle set gives ``bands`` keys of ``rows`` min-hash values each, tuned for the target
   recall at similarity 0.8; a run gives one key. Keys are counted over documents; those in one document alone end.
2. *Collisions.* Documents are read again and only units with a colliding key leave the reader. It knows them by a
   bit map of fixed size (``BITS``); the join with the counted keys is what decides, so a full map costs time only.
3. *Verification.* Paragraphs that share a band form candidate groups, in which every pair of different shingle sets
   is compared exactly (Jaccard of 0.8 or more, in tiles, see ``similarity``). Runs must agree in 128 bits of hashes
   of all their words.
4. *Removals.* Components of the verified links are clusters; of each the unit of the smallest (id, text hash, place)
   stays, and those in other documents go. Overlapping runs of a document make a stretch.
5. *Growth.* A stretch grows on both sides while the words beside its outer run are also beside that run in another document,
   whichever has most of them: a removed stretch in one of a smaller (id, text hash), a kept one in any. It grows by at
   most ``FAR`` words, since within PASSAGE equal words there is a run of their own. Only the places of outer runs take
   their words along. The places of one run are compared in one task up to ``TOGETHER`` of them; a run with more is
   counted by every beginning of the words beside it, which splits over tasks.

Copies of a unit are folded by grouped minima, never paired; a unit in a third of all documents is one key whose
counts combine before the shuffle, and joins on it can be split.

* null or empty text, and texts shorter than a unit: no units. Repeats within one document are left alone. Rows with
  the same id and text count as one document, rows with the same id and other text as two; null ids are ids and come last.
* very long texts: memory in proportion to their words; empty table: no rows. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from assayer.functions.columns import quoted
from assayer.functions.cutting import checkpointed
from assayer.llm.common import coded_words, query, shingles, stirred, table
from assayer.llm.components import components
from assayer.llm.similarity import SIMILARITY, WIDTH, verified

MIN_WORDS = 20
RUN = 20
REACH = 6
#: Equal words that hold a whole run wherever they stand, and how many of them can lie on one side of it.
PASSAGE = 50
FAR = PASSAGE - RUN
RECALL = 0.99
ROWS = 2
BITS = 2**26
_BUCKET_BITS = 32_768
#: Bound of the broadcast tables of hash buckets, and places of one run that are compared in one task.
NEAR_BUCKETS = 2**20
TOGETHER = 50_000

#: Characters worked on at once; a longer text is worked on alone.
AT_ONCE = 1_000_000
_NONE = np.uint64(2**64 - 1)

_random = np.random.default_rng(1_997_0611)
_POWERS = _random.integers(0, 2**64, RUN, np.uint64) | np.uint64(1)
_OTHERS = _random.integers(0, 2**64, RUN, np.uint64) | np.uint64(1)


def bands_for(recall: float = RECALL, similarity: float = SIMILARITY, rows: int = ROWS) -> int:
    """Bands of ``rows`` values that bring a pair at the threshold together with the target probability."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))


BANDS = bands_for()
_FLIP = _random.integers(0, 2**32, BANDS * ROWS, np.uint32)
_TURN = _random.integers(0, 2**32, BANDS * ROWS, np.uint32) | np.uint32(1)


class Units:
    """Words of some texts, one after the other, and their runs at anchors and paragraphs."""

    def __init__(self, texts: Sequence[str | None]):
        whole = "\0".join((t or "").replace("\0", " ") for t in texts).lower()
        self.codes, at, characters = coded_words(whole)
        apart = characters == 0
        text = np.cumsum(apart)[at]  # of each word
        line = np.cumsum(apart | (characters == 10))[at]
        n = len(self.codes)
        self.first = np.searchsorted(text, np.arange(len(texts)))  # word of each text

        pairs = np.full(n, _NONE, np.uint64)
        if n > 1:
            pairs[:-1] = np.where(text[1:] == text[:-1], shingles(self.codes, 2), _NONE)
        ok = pairs != _NONE
        for d in range(1, min(REACH, n - 1) + 1):  # the least within REACH places, with its equals
            other = text[d:] != text[:-d]
            ok[d:] &= (pairs[d:] <= pairs[:-d]) | other
            ok[:-d] &= (pairs[:-d] <= pairs[d:]) | other
        # The anchors from REACH to FAR places behind a word follow from the words of a window that begins there.
        window = FAR + REACH + 1
        if n > window:
            before = np.concatenate([[0], np.cumsum(ok)])
            none = before[FAR + 1 : n - window + FAR + 1] == before[REACH : n - window + REACH]
            bare = np.flatnonzero(none & (text[window:] == text[:-window]))
            if len(bare):  # the least pair that begins a run inside the window; of equal ones the last
                ok[bare + FAR - pairs[bare[:, None] + np.arange(FAR, -1, -1)].argmin(axis=1)] = True
        at = np.flatnonzero(ok)
        at = at[at + RUN <= n]
        self.text = text
        self.runs = at[text[at + RUN - 1] == text[at]]
        self._name_runs()
        if len(self.runs):  # of equal runs that follow each other within REACH places, one in RUN words
            fresh = np.ones(len(self.runs), bool)
            fresh[1:] = (self.run_keys[1:] != self.run_keys[:-1]) | (np.diff(self.runs) > REACH)
            slot = (self.runs - self.runs[fresh][np.cumsum(fresh) - 1]) // RUN
            fresh[1:] |= slot[1:] != slot[:-1]
            self.runs = self.runs[fresh]
            self._name_runs()

        edges = np.concatenate([[0], np.flatnonzero(line[1:] != line[:-1]) + 1, [n]]) if n else np.zeros(1, np.int64)
        long = np.diff(edges) >= MIN_WORDS
        self.starts, self.stops = edges[:-1][long], edges[1:][long]
        self.line_text = text[self.starts]
        self.band_keys = np.zeros((len(self.starts), BANDS), np.uint64)
        if len(self.starts):
            # A paragraph's shingles are a stretch of all shingles, up to WIDTH - 1 before its end.
            self.shingles = shingles(self.codes, WIDTH)
            high = np.append((self.shingles >> np.uint64(32)).astype(np.uint32), np.uint32(0))
            stretch = np.stack([self.starts, self.stops - WIDTH + 1], axis=1).ravel()
            values = [np.minimum.reduceat((high ^ f) * t, stretch)[::2] for f, t in zip(_FLIP, _TURN)]
            values = np.stack(values, axis=1).reshape(len(self.starts), BANDS, ROWS).astype(np.uint64)
            keys = np.full((len(self.starts), BANDS), 0x51ED27, np.uint64) + np.arange(BANDS, dtype=np.uint64)
            for r in range(ROWS):
                keys = stirred(keys * np.uint64(0x9E3779B97F4A7C15) + values[:, :, r])
            self.band_keys = keys

    def _name_runs(self) -> None:
        self.run_text = self.text[self.runs]
        cells = self.codes[self.runs[:, None] + np.arange(RUN)]
        self.run_keys = stirred((cells * _POWERS).sum(axis=1, dtype=np.uint64))
        self.run_checks = stirred((cells * _OTHERS).sum(axis=1, dtype=np.uint64))

    def around(self, runs: np.ndarray) -> np.ndarray:
        """32-bit codes of the FAR words before each run, the nearest first, and of those after it; 0 outside the text."""
        at = runs[:, None] + np.concatenate([-1 - np.arange(FAR), RUN + np.arange(FAR)])
        inside = (at >= 0) & (at < len(self.codes))
        at = np.where(inside, at, runs[:, None])
        inside &= self.text[at] == self.text[runs][:, None]
        return np.where(inside, (self.codes[at] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), np.uint32(0))

    def keys(self) -> np.ndarray:
        """All keys, each once for every text that has it."""
        keys = np.concatenate([self.run_keys, self.band_keys.ravel()])
        text = np.concatenate([self.run_text, np.repeat(self.line_text, BANDS)])
        order = np.lexsort((text, keys))
        keys, text = keys[order], text[order]
        fresh = np.ones(len(keys), bool)
        fresh[1:] = (keys[1:] != keys[:-1]) | (text[1:] != text[:-1])
        return keys[fresh]


def _portions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices whose texts (the last column) have at most AT_ONCE characters, or one text."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1)), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, size in enumerate(sizes.tolist()):
            if held and held + size > AT_ONCE:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if start < batch.num_rows:
            yield batch.slice(start)


def colliding_keys(docs: DataFrame) -> DataFrame:
    """(key) of all units that at least two rows of ``docs`` (.., text) hold."""
    schema = T.StructType([T.StructField("key", T.LongType())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _portions(batches):
            keys = Units(batch.column(0).to_pylist()).keys()
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64))], names=["key"])

    counted = docs.select("__body").mapInArrow(task, schema).groupBy("key").agg(F.count("*").alias("n"))
    return checkpointed(counted.where("n > 1").select("key"))


def bit_map(keys: DataFrame) -> np.ndarray:
    """BITS bits, set where some key falls; gathered in rows of 4 KB, BITS / 8 bytes in all whatever the keys."""
    place = F.pmod(F.col("key"), F.lit(BITS))
    rows = (
        keys.select(F.floor(place / _BUCKET_BITS).alias("bucket"), F.pmod(place, F.lit(_BUCKET_BITS)).alias("bit"))
        .groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")).collect()
    )
    out = np.zeros((BITS // _BUCKET_BITS, _BUCKET_BITS // 8), np.uint8)
    for r in rows:
        out[r["bucket"]] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out.ravel()


def _marked(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the places of ``keys`` are set in a bit map."""
    p = keys & np.uint64(BITS - 1)
    return (bits[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1


def colliding_units(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """(key columns, start, end, key, check, around, set, bands, codes) of units that may hold one of ``keys``."""
    sent = docs.sparkSession.sparkContext.broadcast(bit_map(keys))

    schema = T.StructType([
        docs.schema["__key"], docs.schema["__text"], T.StructField("start", T.LongType()),
        T.StructField("end", T.LongType()), T.StructField("key", T.LongType()), T.StructField("check", T.LongType()),
        T.StructField("around", T.BinaryType()), T.StructField("set", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType())),
        T.StructField("codes", T.BinaryType()),
    ])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _portions(batches):
            u = Units(batch.column(2).to_pylist())
            hit = np.flatnonzero(_marked(sent.value, u.run_keys))
            lines = np.flatnonzero(_marked(sent.value, u.band_keys.ravel()).reshape(u.band_keys.shape).any(axis=1))
            codes = [np.unique(u.shingles[u.starts[i] : u.stops[i] - WIDTH + 1]).tobytes() for i in lines.tolist()]
            text = np.concatenate([u.run_text[hit], u.line_text[lines]])
            start = np.concatenate([u.runs[hit], u.starts[lines]]) - u.first[text]
            end = np.concatenate([u.runs[hit] + RUN, u.stops[lines]]) - u.first[text]
            no_run, no_line = [None] * len(lines), [None] * len(hit)
            own = pa.array(text)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(own), batch.column(1).take(own), pa.array(start), pa.array(end),
                    pa.array(u.run_keys.view(np.int64)[hit].tolist() + no_run, pa.int64()),
                    pa.array(u.run_checks.view(np.int64)[hit].tolist() + no_run, pa.int64()),
                    pa.array([c.tobytes() for c in u.around(u.runs[hit])] + no_run, pa.binary()),
                    pa.array(no_line + [xxhash.xxh3_128_digest(c) for c in codes], pa.binary()),
                    pa.array(no_line + u.band_keys.view(np.int64)[lines].tolist(), pa.list_(pa.int64())),
                    pa.array(no_line + codes, pa.binary()),
                ],
                names=schema.names,
            )

    return checkpointed(docs.select("__key", "__text", "__body").mapInArrow(task, schema))


def _within(rows: DataFrame, few: DataFrame, number: str) -> DataFrame:
    """``rows`` whose ``number`` falls into a bucket of one in ``few`` (of), by a broadcast of at most NEAR_BUCKETS numbers."""
    near = few.select(F.pmod(F.col("of"), F.lit(NEAR_BUCKETS)).alias("__near")).distinct()
    return rows.join(F.broadcast(near), F.pmod(F.col(number), F.lit(NEAR_BUCKETS)) == F.col("__near"), "left_semi")


def _doc() -> Column:
    return F.struct(F.col("__key").isNull().alias("no"), "__key", "__text")


def _folded(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents with different texts, (__key, __text, head): all documents of texts that several rows have)."""
    same = df.groupBy("__text").agg(F.count("*").alias("rows"), F.min(_doc()).alias("head")).where("rows > 1")
    same = checkpointed(same.select(F.col("__text").alias("of"), F.col("head.__key").alias("head")))
    # Of the copies, only rows whose hash of text and key falls to a head's move.
    both = df.withColumn("__both", F.xxhash64("__text", "__key"))
    likely = _within(_within(both, same, "__text"), same.select(F.xxhash64("of", "head").alias("of")), "__both")
    heads = likely.join(same, (F.col("__text") == F.col("of")) & F.col("__key").eqNullSafe(F.col("head")), "left_semi")
    heads = heads.dropDuplicates(["__text"]).select(*df.columns)
    near = same.select(F.pmod(F.col("of"), F.lit(NEAR_BUCKETS)).alias("__near")).distinct()
    outside = df.join(F.broadcast(near), F.pmod(F.col("__text"), F.lit(NEAR_BUCKETS)) == F.col("__near"), "left_anti")
    alone = _within(df, same, "__text").join(same, F.col("__text") == F.col("of"), "left_anti").select(*df.columns)
    copies = df.select("__key", "__text").join(same, F.col("__text") == F.col("of")).select("__key", "__text", "head").distinct()
    return outside.union(alone).union(heads), copies


def _whole(docs: DataFrame, copies: DataFrame) -> DataFrame:
    """Spans over all words of ``copies``, if those make a unit."""
    schema = T.StructType([docs.schema["__text"], T.StructField("end", T.LongType())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _portions(batches):
            sizes = [len(coded_words((t or "").lower())[0]) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["__text", "end"])

    texts = copies.groupBy("__text").agg(F.count("*").alias("ids")).where("ids > 1").select(F.col("__text").alias("of"))
    sized = _within(docs.select("__text", "__body"), texts, "__text").mapInArrow(task, schema).where(F.col("end") >= MIN_WORDS)
    named = sized.select(F.col("__text").alias("is"), "end").join(texts, F.col("is") == F.col("of"), "left_semi")
    return copies.join(named, F.col("__text") == F.col("is")).select(
        "__key", "__text", F.lit(0).cast("long").alias("start"), "end", F.col("head").alias("cluster"),
        (~F.col("__key").eqNullSafe(F.col("head"))).alias("removed"),
    )


def _removals(units: DataFrame, by: list[str]) -> DataFrame:
    """(__key, __text, start, end, cluster, removed, and ``by``) of the ``units`` whose cluster spans documents."""
    place = F.struct(F.col("__key").isNull().alias("no"), "__key", "__text", "start")
    heads = units.groupBy(*by).agg(F.min(place).alias("head"), F.max(_doc()).alias("last")).where(
        (F.col("head.no") != F.col("last.no")) | ~F.col("head.__key").eqNullSafe(F.col("last.__key"))
        | (F.col("head.__text") != F.col("last.__text"))
    )
    named = heads.select(*(F.col(c).alias(f"{c}_h") for c in by), "head")
    on = [F.col(c) == F.col(f"{c}_h") for c in by]
    return units.join(named, on).select(
        "__key", "__text", "start", "end", F.col("head.__key").alias("cluster"),
        (~F.col("__key").eqNullSafe(F.col("head.__key")) | (F.col("__text") != F.col("head.__text"))).alias("removed"), *by,
    )


def _stretches(spans: DataFrame) -> DataFrame:
    """``spans`` with the number, in their document, of the stretch of overlapping ones they belong to."""
    order = Window.partitionBy("__key", "__text", "removed").orderBy("start", "end")
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(F.coalesce(F.col("start") > reached, F.lit(True)), 1).otherwise(0)
    return spans.withColumn("__new", fresh).withColumn(
        "__run", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0))
    ).drop("__new")


_FAR_FIELDS = [T.StructField(c, T.LongType()) for c in ("left", "right", "kept_left", "kept_right")]


def _beside(words: np.ndarray, groups: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many ``words`` (places, FAR) each place has in common with a smaller document's, and with any other's, of its group."""
    n = len(words)
    smaller, other = np.zeros(n, np.int64), np.zeros(n, np.int64)
    name = stirred(groups.astype(np.uint64) + np.uint64(11))
    live = np.arange(n)
    for step in range(FAR):
        live = live[words[live, step] != 0]
        if not len(live):
            break
        name[live] = stirred(name[live] * np.uint64(0x9E3779B97F4A7C15) + words[live, step].astype(np.uint64))
        _, at = np.unique(name[live], return_inverse=True)
        least, most = np.full(at.max() + 1, n), np.zeros(at.max() + 1, np.int64)
        np.minimum.at(least, at, docs[live])
        np.maximum.at(most, at, docs[live])
        less, any_other = least[at] < docs[live], least[at] != most[at]
        smaller[live[less]] = step + 1
        other[live[any_other]] = step + 1
        live = live[any_other]
    return smaller, other


def _growth(places: DataFrame) -> DataFrame:
    """``places`` (__key, __text, start, key, check, around) with the words that each side has in common with other documents."""
    own = ["__key", "__text", "start"]
    counted = places.groupBy("key", "check").count().where(F.col("count") > TOGETHER).select(F.col("key").alias("k"), F.col("check").alias("c"))
    busy = (F.col("key") == F.col("k")) & (F.col("check") == F.col("c"))
    small, large = places.join(counted, busy, "left_anti"), places.join(counted, busy, "left_semi")
    schema = T.StructType([*(places.schema[c] for c in own), *_FAR_FIELDS])

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come sorted by run, then document; whole runs are compared, many at a time.
        held = None

        def compared(table: pa.Table) -> pa.RecordBatch:
            n = table.num_rows
            cells = {c: table.column(c).combine_chunks() for c in table.column_names}
            key, check, text = (cells[c].to_numpy() for c in ("key", "check", "__text"))
            ids = np.unique([repr(k) for k in cells["__key"].to_pylist()], return_inverse=True)[1]
            fresh = np.ones(n, bool)
            fresh[1:] = (key[1:] != key[:-1]) | (check[1:] != check[:-1])
            other = fresh.copy()
            other[1:] |= (ids[1:] != ids[:-1]) | (text[1:] != text[:-1])
            words = np.frombuffer(b"".join(cells["around"].to_pylist()), np.uint32).reshape(n, 2, FAR)
            sides = [_beside(words[:, side], np.cumsum(fresh), np.cumsum(other)) for side in (0, 1)]
            made = [sides[0][0], sides[1][0], sides[0][1], sides[1][1]]
            return pa.RecordBatch.from_arrays([*(cells[c] for c in own), *map(pa.array, made)], names=schema.names)

        for batch in batches:
            new = pa.Table.from_batches([batch])
            held = new if held is None else pa.concat_tables([held, new])
            if held.num_rows < 20_000:
                continue
            key, check = held.column("key").to_numpy(), held.column("check").to_numpy()
            last = np.flatnonzero((key[1:] != key[:-1]) | (check[1:] != check[:-1]))
            if len(last):
                yield compared(held.slice(0, int(last[-1]) + 1))
                held = held.slice(int(last[-1]) + 1)
        if held is not None and held.num_rows:
            yield compared(held)

    order = ["key", "check", F.col("__key").isNull(), "__key", "__text", "start"]
    near = small.repartition("key", "check").sortWithinPartitions(*order).mapInArrow(together, schema)

    begun = T.StructType([
        *(places.schema[c] for c in own), T.StructField("side", T.IntegerType()), T.StructField("step", T.LongType()), T.StructField("name", T.LongType()),
    ])

    def beginnings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for s in range(0, whole.num_rows, 1024):
                b = whole.slice(s, 1024)
                words = np.frombuffer(b.column("around").to_pylist() and b"".join(b.column("around").to_pylist()), np.uint32).reshape(b.num_rows, 2, FAR)
                run = stirred(b.column("key").to_numpy().view(np.uint64) ^ stirred(b.column("check").to_numpy().view(np.uint64)))
                for side in (0, 1):
                    name, live = stirred(run + np.uint64(side + 1)), np.arange(b.num_rows)
                    for step in range(FAR):
                        live = live[words[live, side, step] != 0]
                        name[live] = stirred(name[live] * np.uint64(0x9E3779B97F4A7C15) + words[live, side, step].astype(np.uint64))
                        at, m = pa.array(live), len(live)
                        cells = [b.column(c).take(at) for c in own] + [
                            pa.array(np.full(m, side, np.int32)), pa.array(np.full(m, step + 1)), pa.array(name[live].view(np.int64)),
                        ]
                        yield pa.RecordBatch.from_arrays(cells, names=begun.names)

    rows = large.mapInArrow(beginnings, begun)
    shared = rows.groupBy(F.col("name").alias("is")).agg(F.min(_doc()).alias("least"), F.max(_doc()).alias("most")).where("least != most")
    met = rows.join(shared, F.col("name") == F.col("is")).withColumn("less", F.col("least") < _doc())
    side = lambda s, *more: F.coalesce(F.max(F.when((F.col("side") == s) & F.expr(" and ".join(["true", *more])), F.col("step"))), F.lit(0))
    far = met.groupBy(*own).agg(
        side(0, "less").alias("left"), side(1, "less").alias("right"), side(0).alias("kept_left"), side(1).alias("kept_right")
    )
    return near.union(far)


def _grown(runs: DataFrame, units: DataFrame) -> DataFrame:
    """(__key, __text, start, end, cluster, removed): stretches of ``runs``, grown to where no other document goes on with them."""
    runs = _stretches(runs)
    stretches = checkpointed(
        runs.groupBy("__key", "__text", "removed", "__run").agg(
            F.min("start").alias("start"), F.max("end").alias("end"), F.min("cluster").alias("cluster"),
            F.min(F.struct("start", "key", "check")).alias("first"), F.max(F.struct("end", "start", "key", "check")).alias("last"),
        )
    )
    outer = stretches.select("first.key", "first.check").union(stretches.select("last.key", "last.check")).distinct()
    outer = checkpointed(outer.select(F.col("key").alias("of"), F.col("check").alias("c")))
    # Words travel for places of outer runs alone: a bit map finds them where they lie, and the join decides.
    sent = units.sparkSession.sparkContext.broadcast(bit_map(outer.select(F.col("of").alias("key"))))

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(_marked(sent.value, b.column("key").to_numpy().view(np.uint64))))

    held = units.where("key is not null").select("__key", "__text", "start", "key", "check", "around")
    places = held.mapInArrow(asked, held.schema).join(
        outer, (F.col("key") == F.col("of")) & (F.col("check") == F.col("c")), "left_semi"
    )
    growth = checkpointed(_growth(places)).select(F.col("__key").alias("k"), F.col("__text").alias("t"), F.col("start").alias("s"), *(f.name for f in _FAR_FIELDS))
    doc = F.col("__key").eqNullSafe(F.col("k")) & (F.col("__text") == F.col("t"))
    grown = stretches
    for column, at, kept, gone in (("less", "first.start", "kept_left", "left"), ("more", "last.start", "kept_right", "right")):
        far = growth.select("k", "t", "s", F.col(kept).alias("__kept"), F.col(gone).alias("__gone"))
        grown = grown.join(far, doc & (F.col(at) == F.col("s")), "left").withColumn(
            column, F.coalesce(F.when(F.col("removed"), F.col("__gone")).otherwise(F.col("__kept")), F.lit(0))
        ).drop("k", "t", "s", "__kept", "__gone")
    return grown.select(
        "__key", "__text", (F.col("start") - F.col("less")).alias("start"), (F.col("end") + F.col("more")).alias("end"), "cluster", "removed"
    )


def repeated_passages(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row a span: key, first_word, n_words, cluster (id of the document that keeps it), removed."""
    every = df.select(quoted(key).alias("__key"), F.xxhash64(quoted(text)).alias("__text"), quoted(text).alias("__body"))
    docs, copies = _folded(every)
    keys = colliding_keys(docs)
    units = colliding_units(docs, keys)
    own = keys.select(F.col("key").alias("known"))
    where = ["__key", "__text", "start", "end"]

    runs = units.where("key is not null").select(*where, "key", "check").join(own, F.col("key") == F.col("known"), "left_semi")
    removed_runs = _grown(checkpointed(_removals(runs, ["key", "check"])), units)

    paragraphs = units.where("set is not null")
    sets = checkpointed(
        paragraphs.groupBy("set").agg(F.min("bands").alias("bands"), F.min("codes").alias("codes"))
    )
    banded = sets.select("set", F.explode("bands").alias("band")).join(own, F.col("band") == F.col("known"), "left_semi")
    first = banded.groupBy("band").agg(F.min("set").alias("first"), F.count("*").alias("n")).where("n > 1")
    edges = (
        banded.join(first.select(F.col("band").alias("of"), "first"), F.col("band") == F.col("of"))
        .where(F.col("set") != F.col("first")).select(F.col("set").alias("a"), F.col("first").alias("b"))
    )
    groups = components(edges).join(
        sets.select("set", (F.length("codes") / 8).cast("long").alias("size")), F.col("node") == F.col("set")
    ).select("set", F.col("component").alias("group"), "size", F.lit(1).cast("long").alias("texts"))
    links = checkpointed(verified(groups, sets.select("set", "codes")).select("a", "b"))
    clusters = components(links)
    clustered = paragraphs.select(*where, "set").join(clusters, F.col("set") == F.col("node"), "left").select(
        *where, F.coalesce("component", "set").alias("of")
    )
    removed_paragraphs = _removals(clustered, ["of"]).drop("of")

    both = removed_runs.union(removed_paragraphs).union(_whole(docs, copies))
    return (
        _stretches(both).groupBy("__key", "__text", "removed", "__run")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("cluster").alias("cluster"))
        .select(
            F.col("__key").alias(key), F.col("start").alias("first_word"),
            (F.col("end") - F.col("start")).alias("n_words"), "cluster", "removed",
        )
    )


@query("op10_repeated_passages")
def op10_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages that stand in several documents, with the document that keeps each."""
    return repeated_passages(table(spark, sf_dir, "documents"))
