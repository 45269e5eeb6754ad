"""Training passages that contain benchmark items, by a BM25 index of the items and block-max WAND.

The items are the index: for every term a posting list in item order with the term's BM25 impact, divided by the
item's score against itself, so that 1 means all of an item's terms; lists are cut into blocks with their largest
impact. Every document is cut into overlapping passages, twice as long as the longest item and half overlapping,
and each passage is a query; all items that reach ``THRESHOLD`` are retrieved. Items of more than ``LONGEST`` words
have indexes of their own, one for each doubling of the length, and passages as long as those items need, so no item
is too long to lie in one passage, and long items do not lengthen the passages of short ones.

Two steps do that without loss. In bulk, for a batch of documents: the commonest terms are set aside as long as
together they add less than half the threshold to any item; a passage can only reach an item if its other terms and
that item's set-aside sum do. The passages that can are queried one by one with block-max WAND: term bounds choose
the pivot, block bounds skip, and only the rest is scored in full.

Retrieved pairs are verified word by word. An item is found if the share of its five-word shingles in the passage reaches
``OVERLAP``, or if that of its question alone does and the question has ``LEAST_QUESTION`` words: such questions stand
in the index once more by themselves, so that they are retrieved whatever the answer weighs. The shares of question and answer are
given beside it; an answer of less than five words must stand there as a whole. Without columns of
their own, an item's last sentence counts as its answer and the rest as its question.

The index is broadcast. Benchmarks are small by nature; ``MAX_ITEMS`` items and ``MAX_WORDS`` words are checked, and
more raise an error. Documents are handled row by row without a shuffle.

* null or empty text, or text without index terms: no hits. Items without words are never found. Items of less than
  five words must occur as a whole. Empty tables on either side: no hits. Repeated items and ids: a hit each.
* repeated rows: the same hits each; very long texts: memory in proportion to their words; other columns pass.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from assayer.functions.columns import quoted
from assayer.llm.common import CODES, map_texts, once, query, shingles, table, words_of

MAX_ITEMS = 100_000
MAX_WORDS = 10_000_000
K1, B = 1.2, 0.75
THRESHOLD = 0.6
OVERLAP = 0.8
WIDTH = 5
#: Words a question needs to give an item away without the answer.
LEAST_QUESTION = 20
BLOCK = 64
#: Words of the longest items in the first length class; each further class holds items of up to twice as many.
LONGEST = 512

_SENTENCE_END = re.compile(r"(?<=[.!?])\s+")


def question_and_answer(text: str | None) -> tuple[str, str]:
    """All sentences but the last, and the last; a single sentence is all question."""
    parts = _SENTENCE_END.split((text or "").strip())
    return (" ".join(parts[:-1]), parts[-1]) if len(parts) > 1 else (parts[0], "")


def length_class(words: int) -> int:
    """0 up to LONGEST words, then one more for each doubling."""
    return max(0, (max(words, 1) - 1) // LONGEST).bit_length()


@dataclass
class Item:
    place: int
    key: int | None
    codes: list[int]
    question: list[int]
    answer: list[int]
    width: int
    answer_width: int
    alone: bool


class Part:
    """Impact-normalised postings in blocks of the items of one length class, and what verification needs of each."""

    def __init__(
        self, rows: Sequence[tuple[int, object, list[str], list[str], bool]], idf: dict[str, float], mean: float, threshold: float
    ):
        """``rows``: (place among all items, key, words of the question, words of the answer, whether the question stands alone)."""
        self.threshold = threshold
        self.items: list[Item] = []
        bags = []
        for place, key, q, a, alone in rows:
            both = CODES.of(q + a)
            width, answer_width = min(WIDTH, len(both)), min(WIDTH, len(a))
            self.items.append(
                Item(
                    place, key, np.unique(shingles(both, width)).tolist(),
                    np.unique(shingles(CODES.of(q), width)).tolist() if len(q) >= width else [],
                    np.unique(shingles(CODES.of(a), answer_width)).tolist() if a else [], width, answer_width, alone,
                )
            )
            bags.append(Counter(q if alone else q + a))
        n = len(bags)
        self.stride = max([32, *(sum(b.values()) for b in bags)])
        found = Counter(t for b in bags for t in b)
        self.term = {t: i for i, t in enumerate(sorted(found, key=lambda t: (-found[t], t)))}
        lists: list[list[tuple[int, float]]] = [[] for _ in self.term]
        for i, bag in enumerate(bags):
            size = sum(bag.values())
            impact = {t: idf[t] * f * (K1 + 1) / (f + K1 * (1 - B + B * size / mean)) for t, f in bag.items()}
            whole = sum(impact.values())
            for t, x in impact.items():
                lists[self.term[t]].append((i, x / whole))
        self.ends = np.cumsum([0, *map(len, lists)])
        self.post_item = np.array([i for p in lists for i, _ in p], np.int64)
        self.post_impact = np.array([x for p in lists for _, x in p], np.float64)
        self.bound = [max(x for _, x in p) for p in lists]
        self.lists = [([i for i, _ in p], [x for _, x in p]) for p in lists]
        self.block_max = [[max(x for _, x in p[s : s + BLOCK]) for s in range(0, len(p), BLOCK)] for p in lists]
        # Terms come commonest first; as many are set aside as leave every item below half the threshold.
        self.aside = np.zeros(n)
        self.first_kept = 0
        for p in lists:
            more = self.aside.copy()
            for i, x in p:
                more[i] += x
            if n and more.max() >= threshold / 2:
                break
            self.aside, self.first_kept = more, self.first_kept + 1

    def reachable(self, terms: np.ndarray, passage: np.ndarray) -> np.ndarray:
        """Numbers of the passages that can reach some item; ``terms`` at the positions that lie in ``passage``."""
        kept = terms >= self.first_kept
        pairs = np.unique(passage[kept] * len(self.term) + terms[kept])
        where, term = pairs // len(self.term), pairs % len(self.term)
        starts, sizes = self.ends[term], self.ends[term + 1] - self.ends[term]
        total = int(sizes.sum())
        if not total:
            return np.zeros(0, np.int64)
        at = np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts, sizes)
        key = np.repeat(where, sizes) * len(self.items) + self.post_item[at]
        order = np.argsort(key, kind="stable")
        key, impact = key[order], self.post_impact[at][order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sums = np.add.reduceat(impact, first) + self.aside[key[first] % len(self.items)]
        return np.unique(key[first][sums >= self.threshold - 1e-9] // len(self.items))

    def retrieve(self, terms: Sequence[int]) -> list[tuple[int, float]]:
        """Block-max WAND: all (item, score) with a score of at least the threshold for the distinct ``terms``."""
        # A cursor: [current item, place, term].
        cursors = [[self.lists[t][0][0], 0, t] for t in terms]
        need, found = self.threshold - 1e-9, []
        while cursors:
            cursors.sort()
            total, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                total += self.bound[c[2]]
                if total >= need:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            ahead = cursors[: pivot + 1]
            # Bounds of the blocks that would hold the pivot item.
            block_total, skip_to = 0.0, len(self.items)
            for c in ahead:
                items = self.lists[c[2]][0]
                b = c[1] // BLOCK
                while b + 1 < len(self.block_max[c[2]]) and items[(b + 1) * BLOCK - 1] < item:
                    b += 1
                block_total += self.block_max[c[2]][b]
                skip_to = min(skip_to, items[min((b + 1) * BLOCK, len(items)) - 1] + 1)
            if block_total < need:
                if pivot + 1 < len(cursors):
                    skip_to = min(skip_to, cursors[pivot + 1][0])
                target = max(skip_to, item + 1)
            elif cursors[0][0] == item:
                score = sum(self.lists[c[2]][1][c[1]] for c in ahead)
                if score >= need:
                    found.append((item, score))
                target = item + 1
            else:
                target = item
            for c in ahead:
                items = self.lists[c[2]][0]
                while c[1] < len(items) and items[c[1]] < target:
                    c[1] += 1
                c[0] = items[c[1]] if c[1] < len(items) else -1
            cursors = [c for c in cursors if c[0] >= 0]
        return found

    def collect(self, words: list[list[str]], hits: list[dict[int, dict]], overlap: float) -> None:
        """Adds to the ``hits`` of each text, by place, this part's verified items with their best passage."""
        if not self.items:
            return
        lengths = np.array([len(w) for w in words], np.int64)
        counts = np.maximum(1, -(-lengths // self.stride) - 1)
        ends = np.cumsum(counts)
        firsts = ends - counts
        get = self.term.get
        terms = [np.fromiter(map(get, w, repeat(-1)), np.int64, len(w)) for w in words]
        flat_terms, flat_passage = [], []
        for t, first, n in zip(terms, firsts.tolist(), counts.tolist()):
            known = np.flatnonzero(t >= 0)
            step = known // self.stride
            for shift in (0, 1):  # a word lies in the passage that starts at its stride and in the one before
                p = step - shift
                ok = (p >= 0) & (p < n)
                flat_terms.append(t[known[ok]])
                flat_passage.append(p[ok] + first)
        for p in self.reachable(np.concatenate(flat_terms), np.concatenate(flat_passage)).tolist():
            d = int(np.searchsorted(ends, p, side="right"))
            start = (p - int(firsts[d])) * self.stride
            inside = np.unique(terms[d][start : start + 2 * self.stride])
            for item, score in self.retrieve(inside[inside >= 0].tolist()):
                self._verify(hits[d], item, score, words[d][start : start + 2 * self.stride], start, overlap)

    def _verify(self, hits: dict, item: int, score: float, words: list[str], start: int, overlap: float) -> None:
        it = self.items[item]
        if len(words) < it.width:
            return
        codes = CODES.of(words)
        there = set(shingles(codes, it.width).tolist())

        def share(wanted: list[int], among: set[int] = there) -> float | None:
            return sum(c in among for c in wanted) / len(wanted) if wanted else None

        whole, asked = share(it.codes), share(it.question)
        reached = asked if it.alone else whole
        best = max(whole, asked or 0.0) if len(it.question) + it.width > LEAST_QUESTION else whole
        if reached is not None and reached >= overlap and (it.place not in hits or hits[it.place]["best"] < best):
            known = there if it.answer_width == it.width else set(shingles(codes, it.answer_width).tolist()) if it.answer else set()
            hits[it.place] = {
                "item_id": it.key, "score": score, "overlap": whole, "question_overlap": asked,
                "answer_overlap": share(it.answer, known), "first_word": start, "best": best,
            }


class Index(Part):
    """The part of the items of up to LONGEST words, with the parts of ``longer`` ones; terms are weighed over all."""

    def __init__(self, rows: Sequence[tuple], threshold: float = THRESHOLD, kind: T.DataType | None = None):
        """``rows``: (key, question, answer), keys of Spark's type ``kind``."""
        self.kind = kind or T.LongType()
        classes: dict[int, list[tuple]] = {0: []}
        found: Counter = Counter()
        n = total = 0
        for key, question, answer in rows:
            q, a = words_of(question), words_of(answer)
            if not q + a:
                continue
            part = classes.setdefault(length_class(len(q) + len(a)), [])
            part.append((n, key, q, a, False))
            if a and len(q) >= LEAST_QUESTION:
                part.append((n, key, q, a, True))
            found.update(set(q + a))
            n, total = n + 1, total + len(q) + len(a)
        idf = {t: math.log(1 + (n - d + 0.5) / (d + 0.5)) for t, d in found.items()}
        mean = total / max(n, 1)
        super().__init__(classes.pop(0), idf, mean, threshold)
        self.longer = [Part(classes[c], idf, mean, threshold) for c in sorted(classes)]

    def scan(self, texts: Sequence[str | None], overlap: float = OVERLAP) -> list[list[dict]]:
        """For each text, its verified items with their best passage."""
        hits: list[dict[int, dict]] = [{} for _ in texts]
        words = [words_of(t) for t in texts]
        for part in (self, *self.longer):
            part.collect(words, hits, overlap)
        return [[{k: v for k, v in h[i].items() if k != "best"} for i in sorted(h)] for h in hits]


def build_index(
    items: DataFrame, key: str = "item_id", text: str = "text", question: str | None = None, answer: str | None = None,
    threshold: float = THRESHOLD,
) -> Index:
    """An index on the driver; raises if the benchmark is larger than what may be broadcast."""
    if question:
        chosen = items.select(quoted(key), quoted(question), quoted(answer) if answer else F.lit(""))
        rows = [tuple(r) for r in chosen.take(MAX_ITEMS + 1)]
    else:
        rows = [(r[0], *question_and_answer(r[1])) for r in items.select(quoted(key), quoted(text)).take(MAX_ITEMS + 1)]
    if len(rows) > MAX_ITEMS or sum(len(q or "") + len(a or "") for _, q, a in rows) > 8 * MAX_WORDS:
        raise ValueError(f"the benchmark has more than {MAX_ITEMS} items or {MAX_WORDS} words; split it")
    kind = items.select(quoted(key)).schema[0].dataType
    ranked = sorted(rows, key=lambda r: (r[0] is None, "" if r[0] is None else str(r[0]), r[1] or "", r[2] or ""))
    return Index(ranked, threshold, kind)


def hit(kind: T.DataType) -> T.StructType:
    return T.StructType([
        T.StructField("item_id", kind), T.StructField("score", T.DoubleType()),
        T.StructField("overlap", T.DoubleType()), T.StructField("question_overlap", T.DoubleType()),
        T.StructField("answer_overlap", T.DoubleType()), T.StructField("first_word", T.LongType()),
    ])


def find_items(
    docs: DataFrame, index: Index, keep: Sequence[str] = ("doc_id",), text: str = "text", overlap: float = OVERLAP
) -> DataFrame:
    """Columns ``keep`` with ``items``: the verified benchmark items in each row's text."""
    sent = docs.sparkSession.sparkContext.broadcast(index)
    ready = once(lambda: sent.value)

    def run(texts: list[str | None]):
        return (ready().scan(texts, overlap),)

    return map_texts(docs, run, [T.StructField("items", T.ArrayType(hit(index.kind)))], keep, text)


@query("op9_benchmark_overlap")
def op9_benchmark_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (document, benchmark item) that overlaps, with its scores."""
    index = build_index(table(spark, sf_dir, "benchmark"))
    return find_items(table(spark, sf_dir, "documents"), index).select("doc_id", F.inline("items"))
