"""Toxic passages as maximal scoring segments over token log-odds.

1. *Token scores.* In labelled texts, counts of words and of word beginnings, each once a text, give the log-odds of
   toxic against clean, with a Dirichlet prior in proportion to the counts of the same features over the whole
   corpus; a likelihood ratio tells if the shares differ. A word scores its own log-odds if they are significant,
   else those of its longest significant beginning; all other words lower the score by ``DRIFT``.
2. *Segments.* One linear scan finds every maximal scoring segment: all disjoint runs of words that no longer or
   shorter run beats.
3. *Calibration.* The scale of the extreme-value law of the best score by chance comes from the token frequencies of
   clean text, its location from the length of a text, so segments of texts of any length compare. A segment is
   significant if fewer than ``E_VALUE`` as good are expected by chance. The excess of the best one and the sum over
   the significant ones enter a logistic curve fitted on labelled texts that had no part in step 1.

Bounds: labels are taken from at most about ``MAX_LABELLED`` texts of each kind (rows with the smallest hashes), at
most ``MAX_FEATURES`` features are kept, and both are small constants on driver and executors. Feature counts for
the prior cover the whole corpus, are summed before the shuffle and grow with it. Scoring is row by row.

* null or empty text: scores as a text without passages. No toxic or no clean label: score 0 for every text.
* null labels are skipped; a doc with several labels counts as toxic if one says so; repeated texts are learned
  once; repeated rows are scored each; empty table: no rows; other columns pass if named in ``keep``.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from assayer.functions.columns import quoted
from assayer.llm.common import held_out, map_texts, once, query, table, words_of

MAX_LABELLED = 20_000
MAX_FEATURES = 50_000
MIN_COUNT = 3
BEGINNINGS = (6, 5, 4)
Z_SCORE = 4.0
#: Weight of the prior, as a share of the labelled counts.
PRIOR_SHARE = 0.05
DRIFT = 0.25
E_VALUE = 0.05
CUT = 0.3
#: Stands for all words where features are counted; no word is empty.
ALL = ""


@dataclass
class Model:
    """What scoring needs; ``scores`` is bounded by MAX_FEATURES."""

    scores: dict[str, float] = field(default_factory=dict)
    scale: float = 1.0
    offset: float = 0.0
    weights: tuple[float, float, float] | None = None

    def excess(self, score: float, n_words: int) -> float:
        """Minus the logarithm of how many segments as good chance brings in a text of that length."""
        return self.scale * score - self.offset - math.log(max(n_words, 1))

    def probability(self, best: float, total: float) -> float:
        if self.weights is None:
            return 0.0
        a, b, c = self.weights
        return 1.0 / (1.0 + math.exp(-max(-50.0, min(50.0, a + b * best + c * total))))


def features(word: str) -> list[str]:
    """The word and its beginnings, longest first; beginnings carry a mark no word has."""
    return [word, *(word[:k] + "*" for k in BEGINNINGS if len(word) > k)]


def segments(scores: Sequence[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), by the linear-time scan over cumulative sums."""
    stack: list[tuple[int, int, float, float]] = []  # start, end, sum before it, sum through it
    total = 0.0
    for i, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        start, low, end, high = i, before, i + 1, total
        while stack:
            k = len(stack) - 1
            while k >= 0 and stack[k][2] >= low:
                k -= 1
            if k < 0 or stack[k][3] >= high:
                break
            start, low = stack[k][0], stack[k][2]
            del stack[k:]
        stack.append((start, end, low, high))
    return [(a, b, high - low) for a, b, low, high in stack]


class Scorer(dict):
    """Word scores with the back-off to beginnings, remembered up to a limit."""

    def __init__(self, model: Model, limit: int = 300_000):
        super().__init__()
        self.model, self.limit = model, limit

    def __missing__(self, word: str) -> float:
        found = next((self.model.scores[f] for f in features(word) if f in self.model.scores), None)
        value = -DRIFT if found is None else found
        if len(self) >= self.limit:
            self.clear()
        self[word] = value
        return value

    def passages(self, text: str | None) -> tuple[float, float, list[tuple[int, int, float]]]:
        """Excess of the best segment (at least 0), sum over significant ones, and the significant ones."""
        words = words_of(text)
        values = np.fromiter(map(self.__getitem__, words), np.float64, len(words))
        hits = np.flatnonzero(values > 0)
        if not len(hits):
            return 0.0, 0.0, []
        # Between two hits only the sum matters: segments start and end at positive words.
        sums = np.concatenate([[0.0], np.cumsum(values)])
        short: list[float] = []
        places: list[int] = []
        last = 0
        for h in hits.tolist():
            short += [sums[h] - sums[last], values[h]]
            places += [-1, h]
            last = h + 1
        floor = -math.log(E_VALUE)
        found, best = [], 0.0
        for a, b, s in segments(short):
            e = self.model.excess(s, len(words))
            best = max(best, e)
            if e >= floor:
                found.append((places[a] if places[a] >= 0 else places[a + 1], places[b - 1] + 1, float(e)))
        return float(best), float(sum(e for _, _, e in found)), found


def count_features(df: DataFrame, wanted: Sequence[str] | None = None, kinds: int = 1) -> DataFrame:
    """(feature, kind, texts that hold it) over ``df`` (kind, text), summed within tasks first; ``wanted`` limits the
    features, and adds a row ``ALL`` for all words. A beginning counts once for every different word that has it."""
    sent = None if wanted is None else df.sparkSession.sparkContext.broadcast(frozenset(wanted))
    schema = "feature string, kind int, n long"

    def batch(counts: list[Counter]) -> pa.RecordBatch:
        rows = [(f, k, n) for k, c in enumerate(counts) for f, n in c.items()]
        names, kind, n = zip(*rows) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array(kind, pa.int32()), pa.array(n, pa.int64())],
            names=["feature", "kind", "n"],
        )

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only = None if sent is None else sent.value
        words = [Counter() for _ in range(kinds)]
        counts = [Counter() for _ in range(kinds)]

        def spread() -> None:
            for k in range(kinds):
                into = counts[k]
                if only is not None:
                    into[ALL] += sum(words[k].values())
                for w, n in words[k].items():
                    for f in features(w):
                        if only is None or f in only:
                            into[f] += n
                words[k].clear()

        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                part = whole.slice(start, 512)
                for k, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    words[k].update(set(words_of(t)))
                if sum(map(len, words)) > 200_000:
                    spread()
                    if sum(map(len, counts)) > 400_000:
                        yield batch(counts)
                        counts = [Counter() for _ in range(kinds)]
        spread()
        yield batch(counts)

    return df.select("kind", "text").mapInArrow(task, schema).groupBy("feature", "kind").agg(F.sum("n").alias("n"))


def labelled_texts(
    docs: DataFrame, labels: DataFrame, learnable: Column, key: str = "doc_id", text: str = "text",
    label: str = "toxic", most: int = MAX_LABELLED,
) -> tuple[DataFrame, dict[int, float]]:
    """Rows (kind, part, text) for a bounded number of labelled texts, and each kind's chance to be among them."""
    marks = (
        labels.where(quoted(label).isNotNull() & quoted(key).isNotNull())
        .groupBy(quoted(key).alias("__key")).agg(F.max((quoted(label) > 0).cast("int")).alias("kind"))
        .withColumn("__hash", F.xxhash64(F.lit("toxicity"), "__key").bitwiseAND(F.lit(2**40 - 1)) / F.lit(float(2**40)))
    )
    sizes = {r["kind"]: r["n"] for r in marks.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    chance = {k: min(1.0, most / n) for k, n in sizes.items()}
    if set(chance) != {0, 1}:
        return docs.select(F.lit(0).alias("kind"), F.lit(0).alias("part"), quoted(text).alias("text")).limit(0), {}
    few = marks.where(F.col("__hash") < F.when(F.col("kind") == 1, chance[1]).otherwise(chance[0]))
    # About 2 * most keys whatever the table holds: bounded, hence broadcast.
    rows = (
        docs.where(learnable & quoted(text).isNotNull()).select(quoted(key).alias("__key"), quoted(text).alias("text"))
        .join(F.broadcast(few), "__key")
        .select("kind", "text", F.pmod(F.xxhash64("text"), F.lit(3)).alias("part"))
        .groupBy(F.xxhash64("text").alias("__text"))
        .agg(F.max("kind").alias("kind"), F.min("part").alias("part"), F.min("text").alias("text"))
    )
    return rows.drop("__text"), chance


def learn(
    docs: DataFrame, labels: DataFrame, learnable: Column, key: str = "doc_id", text: str = "text",
    label: str = "toxic", most: int = MAX_LABELLED,
) -> Model:
    sample, chance = labelled_texts(docs, labels, learnable, key, text, label, most)
    if not chance:
        return Model()
    sample = sample.persist()
    try:
        first = (
            count_features(sample.where("part < 2"), kinds=2)
            .groupBy("feature").agg(
                F.sum(F.when(F.col("kind") == 1, F.col("n")).otherwise(0)).alias("toxic"),
                F.sum(F.when(F.col("kind") == 0, F.col("n")).otherwise(0)).alias("clean"),
            )
        ).persist()
        totals = first.where(~F.col("feature").contains("*")).agg(F.sum("toxic"), F.sum("clean")).first()
        if not totals[0] or not totals[1]:
            return Model()
        # The test that decides on a feature, run where the counts are: no other feature can get a score.
        sure = _root_column(F.col("toxic"), F.col("clean"), totals[0], totals[1]) >= Z_SCORE * (1 - 1e-9)
        chosen = first.where(F.col("toxic") + F.col("clean") >= MIN_COUNT).where(sure).take(MAX_FEATURES + 1)
        if len(chosen) > MAX_FEATURES:
            raise ValueError(f"more than {MAX_FEATURES} significant features: the model is broadcast")
        first.unpersist()
        counts = {r["feature"]: (r["toxic"], r["clean"]) for r in chosen}
        corpus = docs.select(F.lit(0).alias("kind"), quoted(text).alias("text"))
        everywhere = {r["feature"]: r["n"] for r in count_features(corpus, list(counts)).collect()}
        model = _weigh(counts, everywhere, totals[0], totals[1])
        _calibrate(model, sample.where("part = 2"), chance)
        return model
    finally:
        sample.unpersist()


def _weigh(
    counts: dict[str, tuple[int, int]], everywhere: dict[str, int], n_toxic: int, n_clean: int
) -> Model:
    corpus = max(1, everywhere.get(ALL, 0))
    scores, weight = {}, PRIOR_SHARE * (n_toxic + n_clean)
    for f, (toxic, clean) in counts.items():
        prior = weight * (everywhere.get(f, 0) + 0.5) / corpus
        odds = math.log((toxic + prior) / (n_toxic + weight - toxic - prior)) - math.log(
            (clean + prior) / (n_clean + weight - clean - prior)
        )
        sure = _root(toxic, clean, n_toxic, n_clean) >= Z_SCORE
        if sure and odds > 1.0:
            scores[f] = min(odds, 10.0)
        elif sure and odds < 0 and "*" not in f:
            scores[f] = max(odds, -2.0) - DRIFT
    model = Model(scores)
    # Scale: the root of sum(p * exp(scale * score)) = 1 over the words of clean text.
    share = {f: (counts[f][1] + 0.5) / (n_clean + 1) for f in scores if "*" not in f}
    rest = max(0.0, 1.0 - sum(share.values()))

    def mean(scale: float) -> float:
        return sum(p * math.exp(scale * scores[f]) for f, p in share.items()) + rest * math.exp(-scale * DRIFT)

    low, high = 1e-3, 5.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if mean(middle) < 1 else (low, middle)
    model.scale = low
    return model


def _root(toxic: int, clean: int, n_toxic: int, n_clean: int) -> float:
    """Root of the likelihood ratio of unequal against equal shares; holds where one count is 0."""
    both = (toxic + clean) / (n_toxic + n_clean)
    g = sum(k * math.log(k / (n * both)) for k, n in ((toxic, n_toxic), (clean, n_clean)) if k)
    return math.sqrt(max(0.0, 2 * g))


def _root_column(toxic: Column, clean: Column, n_toxic: int, n_clean: int) -> Column:
    """``_root`` of two columns of counts."""
    both = (toxic + clean) / F.lit(float(n_toxic + n_clean))
    part = lambda k, n: F.when(k > 0, k * F.log(k / (F.lit(float(n)) * both))).otherwise(F.lit(0.0))
    return F.sqrt(F.greatest(F.lit(0.0), 2 * (part(toxic, n_toxic) + part(clean, n_clean))))


def _calibrate(model: Model, sample: DataFrame, chance: dict[int, float]) -> None:
    """Fits the location of the chance law and the logistic curve on at most 2 * MAX_LABELLED small rows."""
    raw = _passages(sample, model, ["kind"]).select("kind", "__best", "__total").collect()
    clean = [r["__best"] for r in raw if r["kind"] == 0 and r["__best"] > 0]
    if len(clean) >= 50:
        # Mean of the extreme-value law is its location plus Euler's constant.
        model.offset = max(0.0, sum(clean) / len(clean) - 0.5772)
        raw = _passages(sample, model, ["kind"]).select("kind", "__best", "__total").collect()
    x = np.array([[1.0, math.log1p(r["__best"]), math.log1p(r["__total"])] for r in raw])
    y = np.array([float(r["kind"]) for r in raw])
    if not len(y) or y.min() == y.max():
        return
    w = np.where(y == 1, 1 / chance[1], 1 / chance[0])
    w = w * len(w) / w.sum()
    beta, ridge = np.zeros(3), np.diag([1e-3, 0.5, 0.5])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (w * (y - p)) - ridge @ beta)
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            break
    model.weights = (float(beta[0]), max(0.0, float(beta[1])), max(0.0, float(beta[2])))


def _passages(df: DataFrame, model: Model, keep: Sequence[str], text: str = "text") -> DataFrame:
    sent = df.sparkSession.sparkContext.broadcast(model)
    found = T.ArrayType(
        T.StructType([
            T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
            T.StructField("excess", T.DoubleType()),
        ])
    )

    ready = once(lambda: Scorer(sent.value))

    def run(texts: list[str | None]):
        scorer = ready()
        out = [[], [], [], []]
        for t in texts:
            best, total, where = scorer.passages(t)
            p = scorer.model.probability(math.log1p(best), math.log1p(total))
            row = (best, total, p, [{"start": a, "end": b, "excess": e} for a, b, e in where])
            for column, value in zip(out, row):
                column.append(value)
        return out

    fields = [
        T.StructField("__best", T.DoubleType()), T.StructField("__total", T.DoubleType()),
        T.StructField("score", T.DoubleType()), T.StructField("passages", found),
    ]
    return map_texts(df, run, fields, keep, text)


def score(df: DataFrame, model: Model, keep: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """Columns ``keep`` with score (0 to 1) and passages: word ranges and their excess over chance."""
    return _passages(df, model, keep, text).drop("__best", "__total")


@query("op1_toxicity")
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from labels of the rows that are not held out."""
    docs, key = table(spark, sf_dir, "documents"), F.col("doc_id")
    model = learn(docs, table(spark, sf_dir, "labels"), ~held_out(key))
    return score(docs, model).select(
        "doc_id", held_out(key).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"),
        F.size("passages").alias("n_passages"),
    )
