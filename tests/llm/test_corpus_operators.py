"""Similarity join, repeated passages, benchmark overlap, mixture, quality rules and the pipeline."""

import collections
import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from assayer.functions import cutting
from assayer.llm import decontamination, mixing, passages, quality, similarity
from assayer.llm.common import coded_words, words_of
from assayer.llm.components import components

from .conftest import by_id

WORDS = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in ("l", "nt", "rs", "m")]


def prose(rng, n):
    return " ".join(rng.choices(WORDS, k=n))


def edited(rng, text, n):
    words = text.split()
    for k in rng.sample(range(len(words)), n):
        words[k] = rng.choice(WORDS) + "x"
    return " ".join(words)


# Components


def test_few_rows_are_kept_in_one_partition(spark, monkeypatch):
    pairs = [(i + 1, i) for i in range(0, 400) if i % 20]
    edges = spark.createDataFrame(pairs, "a long, b long").repartition(7)
    found = components(edges)
    assert found.rdd.getNumPartitions() == 1
    assert "Exchange" not in found.groupBy("component").count()._jdf.queryExecution().toString()
    want = {x: x - (x - 1) % 20 for pair in pairs for x in pair}
    assert {r["node"]: r["component"] for r in found.collect()} == want
    monkeypatch.setattr(cutting, "TASK_ROWS", 100)
    wide = cutting.narrowed(edges)
    assert 1 < wide.rdd.getNumPartitions() <= 7 and sorted(map(tuple, wide.collect())) == sorted(pairs)
    assert {r["node"]: r["component"] for r in components(edges).collect()} == want


def test_components_of_random_edges(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000, k) for k in range(1001, 1200)]
    edges += [(2000 + k, 2001 + k) for k in range(60)] + [(5, 5)]
    df = spark.createDataFrame(edges + [(None, 3)], "a long, b long")
    up = {x: x for e in edges for x in e if e[0] != e[1]}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components(df).collect()}
    assert got == {x: root(x) for x in up}
    assert components(df.limit(0)).count() == 0


# Similarity join


def linked_by_hand(rows):
    """(class id, links) of each row: brute force over different texts."""
    texts = {}
    for i, t in rows:
        if words_of(t):
            texts.setdefault(t, []).append(i)
    names = list(texts)
    sets = [set(similarity.shingle_set(t).tolist()) for t in names]
    forest = similarity.Forest(len(names))
    links = collections.Counter()
    for x in range(len(names)):
        for y in range(x):
            if 5 * len(sets[x] & sets[y]) >= 4 * len(sets[x] | sets[y]):
                links[x] += 1
                links[y] += 1
                forest.join(x, y)
    least = {}
    for x in range(len(names)):
        ids = [i for i in texts[names[x]] if i is not None]
        r = forest.root(x)
        least[r] = min([*ids, *([least[r]] if least.get(r) is not None else [])], default=None)
    return {(i, t): (least[forest.root(x)], links[x]) for x, t in enumerate(names) for i in texts[t]}


@pytest.mark.parametrize("bucket, block, last", [(8, 16, similarity.LAST), (similarity.BUCKET, similarity.BLOCK, similarity.LAST), (4, 16, 4)])
def test_join_equals_brute_force_with_a_large_group(docs_of, odd, monkeypatch, bucket, block, last):
    monkeypatch.setattr(similarity, "BUCKET", bucket)
    monkeypatch.setattr(similarity, "BLOCK", block)
    monkeypatch.setattr(similarity, "LAST", last)
    rng = random.Random(4)
    rows = [(k, prose(rng, rng.randint(1, 90))) for k in range(60)]
    base = prose(rng, 80)
    rows += [(1000 + k, edited(rng, base, rng.randint(0, 2))) for k in range(90)]
    rows += [(200 + k, edited(rng, rows[k][1], 1)) for k in range(60) if len(rows[k][1].split()) > 40]
    rows += [(300 + k, rows[k][1].upper() + "!") for k in range(20)] + [(400 + k, base) for k in range(30)]
    docs = docs_of(rows).union(odd)
    got = similarity.join_similar(docs).collect()
    assert len(got) == docs.count()
    want = linked_by_hand([(r.doc_id, r.text) for r in docs.collect()])
    texts = {(r.doc_id, r.h): r.text for r in docs.select("doc_id", F.xxhash64("text").alias("h"), "text").collect()}
    for r in got:
        t = texts[(r.doc_id, r["__text"])]
        assert (r.class_id, r.n_links) == want.get((r.doc_id, t), (r.doc_id, 0))
    heads = collections.Counter(r.class_id for r in got if r.is_first and r.class_id is not None)
    assert set(heads) == {r.class_id for r in got if r.class_id is not None}
    assert similarity.join_similar(odd.limit(0)).count() == 0


def test_links_are_counted_once_when_blocks_are_empty(docs_of, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK_SHINGLES", 100)
    rng = random.Random(16)
    rows = []
    for k in range(12):
        base = prose(rng, 150)
        rows += [(10 * k + j, edited(rng, base, 1)) for j in range(2 + k % 3)]
    got = {r.doc_id: (r.class_id, r.n_links) for r in similarity.join_similar(docs_of(rows)).collect()}
    want = linked_by_hand(rows)
    assert got == {i: want[i, t] for i, t in rows} and max(n for _, n in got.values()) == 3


def test_runs_reach_the_recall():
    for recall in (0.5, 0.9, 0.99):
        runs = similarity.runs_for(recall)
        assert similarity.recall_of(runs) >= recall and (runs == 1 or similarity.recall_of(runs - 1) < recall)
    assert similarity.survival(3) == pytest.approx(0.6425, abs=1e-3)


def test_recall_at_the_threshold_among_texts_with_much_in_common(docs_of, monkeypatch):
    """Pairs at 0.80-0.82 between texts that all share a third of their words, so nodes hold more than a bucket."""
    rng = random.Random(41)
    shared, rows, pairs = prose(rng, 100), [], []
    for k in range(160):
        own = shared + " " + prose(rng, 180)
        other = edited(rng, own, 6)
        a, b = (set(similarity.shingle_set(t).tolist()) for t in (own, other))
        rows += [(2 * k, own), (2 * k + 1, other)]
        if 0.8 <= len(a & b) / len(a | b) <= 0.82:
            pairs.append(2 * k)
    assert len(pairs) >= 60
    got = {r.doc_id: r.class_id for r in similarity.join_similar(docs_of(rows)).collect()}
    assert sum(got[p] == got[p + 1] for p in pairs) >= 0.95 * len(pairs)
    assert all(c in (i, i - i % 2) for i, c in got.items())


# Repeated passages


def windows(words, n):
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def covered(words, known, n):
    """Places of ``words`` inside a window of ``n`` that is ``known``."""
    return {k for i in range(len(words) - n + 1) if tuple(words[i : i + n]) in known for k in range(i, i + n)}


def check_removed(rows, got):
    """Brute force over ids and different texts: what is removed stands in a run of an earlier document, and all runs of
    PASSAGE words that do are removed whole."""
    places = collections.defaultdict(set)
    for r in got:
        if r.removed:
            places[r.doc_id] |= set(range(r.first_word, r.first_word + r.n_words))
    short, long = set(), set()
    for i, text in sorted(rows):
        words = words_of(text)
        assert covered(words, long, passages.PASSAGE) <= places[i] <= covered(words, short, passages.RUN), i
        short |= windows(words, passages.RUN)
        long |= windows(words, passages.PASSAGE)


def test_repeated_passages_are_found_and_nothing_else(docs_of, odd):
    rng = random.Random(6)
    shared, paragraph = prose(rng, 55), prose(rng, 70)
    rows = [(k, prose(rng, 200) + "\n" + prose(rng, 30)) for k in range(40)]
    rows += [(100 + k, prose(rng, 50) + " " + shared + " " + prose(rng, 50)) for k in range(25)]
    rows += [(200 + k, prose(rng, 60) + "\n" + edited(rng, paragraph, 1)) for k in range(20)]
    rows += [(300, "again " * 80), (301, prose(rng, 9)), (302, "\n".join([rows[0][1].split("\n")[1]] * 2))]
    docs = docs_of(rows).union(odd)
    got = passages.repeated_passages(docs).collect()
    flagged = {r.doc_id for r in got}
    assert flagged == {*range(100, 125), *range(200, 220), 0, 302}
    spans = [r for r in got if 100 <= r.doc_id < 125]
    check_removed([r for r in rows if 100 <= r[0] < 125], spans)
    assert {r.doc_id for r in spans if r.removed and r.cluster == 100} == set(range(101, 125))
    assert not any(r.removed for r in spans if r.doc_id == 100)
    kept = [r for r in got if 200 <= r.doc_id < 220 and not r.removed]
    assert {r.doc_id for r in kept} >= {200}
    assert {r.doc_id for r in got if 200 <= r.doc_id < 220 and r.removed} == set(range(201, 220))
    assert passages.repeated_passages(odd).count() == 0 and passages.repeated_passages(odd.limit(0)).count() == 0


def test_units_depend_on_the_words_around_them():
    rng = random.Random(8)
    middle, before = prose(rng, 80), (3, 50, 71)
    texts = [prose(rng, n) + " " + middle + " " + prose(rng, 20) for n in before]
    units = passages.Units(texts)
    alone = [passages.Units([t]) for t in texts]
    inner = []
    for k, (n, one) in enumerate(zip(before, alone)):
        own = units.run_text == k
        assert (units.runs[own] - units.first[k]).tolist() == one.runs.tolist()
        assert units.run_keys[own].tolist() == one.run_keys.tolist()
        fits = [int(a) - n for a in one.runs if n + passages.REACH <= a <= n + 80 - passages.RUN - passages.REACH]
        inner.append(fits)
    assert inner[0] == inner[1] == inner[2] != []
    assert len(passages.Units([]).keys()) == len(passages.Units([None, "", "\0 \n"]).keys()) == 0


def test_passages_are_found_from_end_to_end(docs_of):
    rng = random.Random(14)
    fresh = (f"n{i}" for i in range(10**6))  # words that stand nowhere else

    def unique(n):
        return " ".join(next(fresh) for _ in range(n))

    middles = [unique(rng.choice((50, 51, 64, 80, 120, 300))) for _ in range(60)]
    middles += [unique(9) + " " + f"{unique(k)} " * 40 + unique(9) for k in range(1, 8)]
    rows, want = [], set()
    for m, middle in enumerate(middles):
        n = len(middle.split())
        for copy in range(3):  # paragraphs as wholes are not similar
            before, after = ((n, n), (rng.choice((0, 1, 7, 40)), n), (n, rng.choice((0, 3, 40))))[copy]
            rows.append((10 * m + copy, f"{unique(before)} {middle} {unique(after)}"))
            want.add((10 * m + copy, before, n, 10 * m, copy > 0))
    got = passages.repeated_passages(docs_of(rows)).collect()
    assert {(r.doc_id, r.first_word, r.n_words, r.cluster, r.removed) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("together", [passages.TOGETHER, 2])
def test_spans_equal_brute_force_over_common_runs(docs_of, odd, monkeypatch, together):
    """Three documents share a passage, and the later two some words more on either side; many share one; texts are copied."""
    monkeypatch.setattr(passages, "TOGETHER", together)
    rng = random.Random(23)
    fresh = (f"n{i}" for i in range(10**6))

    def unique(n):
        return " ".join(next(fresh) for _ in range(n))

    rows = []
    for g in range(40):
        middle, before, after = unique(rng.choice((50, 60, 90))), unique(rng.randint(0, 28)), unique(rng.randint(2, 28))
        rows.append((10 * g, f"{unique(90)} {middle} {unique(95)}"))
        rows.append((10 * g + 1, f"{unique(95)} {before} {middle} {after} {unique(90)}"))
        rows.append((10 * g + 2, f"{unique(100)} {before} {middle} {after} {unique(85)}"))
        rows.append((10 * g + 3, f"{unique(100)} {unique(3)} {middle} {unique(85)} {before} {middle}"))
    hot = unique(55)
    rows += [(1000 + k, f"{unique(rng.randint(60, 90))} {hot} {unique(80)}") for k in range(60)]
    rows += [(2000 + k, rows[5][1]) for k in range(4)]
    docs = docs_of(rows).union(odd)
    got = passages.repeated_passages(docs.withColumn("start", F.lit("x")).withColumn("key", F.lit(1))).collect()
    assert {r.doc_id for r in got} <= {i for i, _ in rows}
    check_removed(rows, got)
    copies = [r for r in got if r.doc_id >= 2000]
    n = len(words_of(rows[5][1]))
    assert sorted((r.doc_id, r.first_word, r.n_words, r.cluster, r.removed) for r in copies) == [(2000 + k, 0, n, rows[5][0], True) for k in range(4)]
    kept = [r for r in got if 1000 <= r.doc_id < 1060 and not r.removed]
    assert [(r.doc_id, r.n_words) for r in kept] == [(1000, 55)]


def test_every_passage_holds_a_run_of_its_own():
    rng = random.Random(15)
    text = [f"w{rng.randrange(10**9)}" for _ in range(200_000)]
    runs = passages.Units([" ".join(text)]).runs
    assert max(b - a for a, b in zip(runs.tolist(), runs.tolist()[1:])) <= passages.FAR + 1
    for s in range(0, 150_000, 50):
        inner = " ".join(text[s : s + 50])
        alone = set(passages.Units([inner]).run_keys.tolist())
        assert alone & set(passages.Units(["x1 y2 z3 " + inner + " u4 v5 w6"]).run_keys.tolist())
    again = passages.Units(["again " * 80_000]).runs
    assert len(again) <= 80_000 / passages.RUN + 20


def test_word_codes_follow_the_words():
    text = "naïve Café_42, x² — \u4e2d\u6587! \U0001d538 a a\ud800b".lower()
    codes, starts, _ = coded_words(text)
    words = words_of(text)
    assert [text[s:].startswith(w) for s, w in zip(starts, words)] == [True] * len(words) == [True] * len(codes)
    seen = {}
    assert all(seen.setdefault(w, c) == c for w, c in zip(words, codes.tolist())) and len(set(seen.values())) == len(seen)
    many = [f"w{i}" for i in range(200_000)]
    assert len(set(coded_words(" ".join(many))[0].tolist())) == len(many)


# Benchmark overlap


def found_by_hand(docs, items, overlap=decontamination.OVERLAP):
    """Items of which the whole, or a question of enough words, is there to the share asked for."""

    def share(w, k, words):
        grams = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}
        there = {tuple(words[j : j + k]) for j in range(len(words) - k + 1)}
        return len(grams & there) / len(grams) if grams else 0

    out = set()
    for i, text in docs:
        words = words_of(text)
        for key, item in items:
            q, a = map(words_of, decontamination.question_and_answer(item))
            w = q + a
            if w and (share(w, min(5, len(w)), words) >= overlap or (len(q) >= decontamination.LEAST_QUESTION and share(q, 5, words) >= overlap)):
                out.add((i, key))
    return out


def test_questions_alone_and_short_answers(spark, docs_of):
    rng = random.Random(31)
    long, short = prose(rng, 40), prose(rng, 12)
    items = [("a-1", f"{long}? {prose(rng, 30)}"), ("b", f"{short}? {prose(rng, 12)}"), ("c", f"{prose(rng, 30)}? forty two"), (None, f"{prose(rng, 25)}? yes")]
    table = spark.createDataFrame(items, "item_id string, text string")
    docs = [
        (1, prose(rng, 300) + " " + long + " " + prose(rng, 300)), (2, prose(rng, 80) + " " + short), (3, items[2][1].replace("forty two", "forty")),
        (4, items[2][1]), (5, items[3][1]), (6, edited(rng, long, 1)), (7, edited(rng, long, 6)),
    ]
    rows = decontamination.find_items(docs_of(docs), decontamination.build_index(table)).collect()
    got = {(r.doc_id, i["item_id"]) for r in rows for i in r["items"]}
    assert got == found_by_hand(docs, items) and {(1, "a-1"), (3, "c"), (4, "c"), (5, None), (6, "a-1")} <= got and 2 not in {d for d, _ in got}
    answers = {(r.doc_id, i["item_id"]): i["answer_overlap"] for r in rows for i in r["items"]}
    assert answers[4, "c"] == 1 and answers[3, "c"] == 0 and answers[5, None] == 1


def test_benchmark_overlap_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    items = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    got = {(r.doc_id, r.item_id) for r in decontamination.op9_benchmark_overlap(spark, sf).collect()}
    want = found_by_hand([(r.doc_id, r.text) for r in docs], [(r.item_id, r.text) for r in items])
    assert got == want and len(got) > 10


def test_wand_retrieves_all_above_the_threshold():
    rng = random.Random(9)
    items = [(k, prose(rng, rng.randint(1, 40)), prose(rng, 4)) for k in range(150)]
    index = decontamination.Index(items, threshold=0.3)
    for _ in range(60):
        terms = sorted({index.term[w] for w in rng.sample(list(index.term), rng.randint(1, 40))})
        sums = collections.Counter()
        for t in terms:
            for i, x in zip(*index.lists[t]):
                sums[i] += x
        want = {i: s for i, s in sums.items() if s >= 0.3 - 1e-9}
        got = dict(index.retrieve(terms))
        assert set(got) == set(want) and all(abs(got[i] - want[i]) < 1e-9 for i in got)


def test_benchmark_overlap_of_odd_rows(spark, odd, docs_of):
    items = spark.createDataFrame([(1, "same row twice"), (2, None), (3, "?!"), (4, "One id. With two texts to its name.")], "item_id long, text string")
    out = decontamination.find_items(odd.withColumn("items", F.lit(1)), decontamination.build_index(items), ["doc_id", "items"]).collect()
    assert len(out) == odd.count()
    assert [len(r["items"]) for r in out if r.doc_id == 4] == [1, 1] and all(not r["items"] for r in out if r.doc_id in (1, 2, 3))
    empty = decontamination.build_index(items.limit(0))
    assert all(not r["items"] for r in decontamination.find_items(odd, empty).collect())
    long = docs_of([(1, "filler " * 5000 + "the same row twice")])
    assert [h.item_id for h in decontamination.find_items(long, decontamination.build_index(items)).first()["items"]] == [1]


def test_long_items_are_found_wherever_they_stand():
    rng = random.Random(12)
    names = [f"w{k}" for k in range(5000)]
    item = rng.choices(names, k=1500)
    short = rng.choices(names, k=30)
    index = decontamination.Index([(1, " ".join(short), ""), (2, " ".join(item), ""), (3, " ".join(item[:600]), "")])
    filler = rng.choices(names, k=6000)
    cut = item[:1250]  # 83% of the item
    for offset in (0, 1, 333, 511, 512, 700, 1499, 1500, 2300, 6000):
        text = " ".join(filler[:offset] + item + filler[offset:])
        assert [(h["item_id"], h["overlap"]) for h in index.scan([text])[0]] == [(2, 1.0), (3, 1.0)]
        assert [h["item_id"] for h in index.scan([" ".join(filler[:offset] + cut + filler[offset:])])[0]] == [2, 3]
    assert [[h["item_id"] for h in hits] for hits in index.scan([" ".join(filler), " ".join(item[:1000]), " ".join(short), None])] == [[], [3], [1], []]
    assert [decontamination.length_class(n) for n in (0, 1, 512, 513, 1024, 1025, 2048, 2049)] == [0, 0, 0, 1, 1, 2, 2, 3]


# Mixture


def test_raking_reaches_the_margins(spark):
    rng = random.Random(10)
    cells = spark.createDataFrame(
        [(f"s{a}" if a else None, f"l{b}", f"t{c}", rng.randint(1, 5000)) for a in range(6) for b in range(4) for c in range(3)],
        "s string, l string, t string, __mix_tokens long",
    )
    rows = mixing.rake(cells, ("s", "l", "t"), rounds=30).collect()
    whole = sum(r["__mix_tokens"] for r in rows)
    for m in ("s", "l", "t"):
        before, after = collections.Counter(), collections.Counter()
        for r in rows:
            before[r[m]] += r["__mix_tokens"]
            after[r[m]] += r["__mix_fitted"]
        norm = sum(v**mixing.TEMPER for v in before.values())
        for k, v in after.items():
            assert v / whole == pytest.approx(before[k] ** mixing.TEMPER / norm, rel=1e-6)


def test_mixture_meets_its_budget(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mixing.mix(docs).collect()
    whole = sum(r["__mix_tokens"] for r in rows)
    assert len(rows) == docs.count()
    assert sum(r["__mix_tokens"] * r.probability for r in rows) == pytest.approx(mixing.KEEP_SHARE * whole, rel=1e-6)
    assert abs(sum(r["__mix_tokens"] for r in rows if r.chosen) / whole - mixing.KEEP_SHARE) < 0.05


def test_mixture_of_odd_rows(odd):
    rows = mixing.mix(odd.withColumn("weight", F.lit("x")).withColumn("topic", F.lit(None).cast("string"))).collect()
    assert len(rows) == odd.count() and all(0 <= r.probability <= 1 for r in rows)
    assert mixing.mix(odd.limit(0)).count() == 0


# Quality


SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def counts_by_hand(text):
    text = text or ""
    words = SPACE.findall(text)
    lines = [x for x in text.split("\n") if SPACE.search(x)]
    windows = collections.Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_counts_equal_a_count_by_hand(docs_of, odd, real):
    texts = ["a b c", "a a a a", "a b c a b c", "x\n\nx\n x\nx", "a b c d a b c d e a b", "é# \x0b ü|", "  lead and trail \n", "same " * 700]
    docs = docs_of([(500 + i, t) for i, t in enumerate(texts)]).union(odd).union(real.select(odd.columns))
    got = sorted(str((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)) for r in quality.measure(docs).collect())
    assert got == sorted(str((r.doc_id, *counts_by_hand(r.text))) for r in docs.collect())


def test_rules_are_learned_in_order(spark, docs_of):
    rng = random.Random(11)
    rows, marks = [], []
    for i in range(600):
        text = prose(rng, rng.randint(60, 120))
        if i % 3 == 0:
            text = text.replace(" ", "### ") if i % 2 else text.upper()
        rows.append((i, text))
        marks.append((i, int(i % 3 != 0)))
    measured = quality.measure(docs_of(rows))
    labels = spark.createDataFrame(marks + [(3, None), (None, 0)], "doc_id long, quality int")
    rules = quality.learn(measured, labels, F.lit(True))
    out = by_id(measured.select("doc_id", quality.rule_of(rules).alias("rule")))
    assert 2 <= len(rules) <= quality.MAX_RULES and all((r.rule > 0) == (i % 3 == 0) for i, r in out.items())
    assert quality.learn(measured, labels.limit(0), F.lit(True)) == []
    assert quality.learn(measured, labels.where("quality = 1"), F.lit(True)) == []


# Pipeline


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("score", F.lit(1)).withColumn("weight", F.lit(None))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixture", "shards"]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        out.withColumn("weight", F.lit(1)).write.parquet(f"{tmp_path}/{name}")
        after = spark.read.parquet(f"{tmp_path}/{name}")
        assert out.columns == docs.columns + (["slot", "shard"] if name == "shards" else [])
        if name == "near_duplicates":
            rows = docs.select("doc_id", "text").collect()
            want = linked_by_hand([(r.doc_id, r.text) for r in rows])
            assert {r.doc_id for r in after.collect()} == {want.get((r.doc_id, r.text), (r.doc_id, 0))[0] for r in rows}
        if name == "decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            hit = {i for i, _ in found_by_hand([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], items)}
            assert {r.doc_id for r in after.collect()} == {r.doc_id for r in docs.collect()} - hit
        docs = after.drop("slot", "shard")


def test_stages_take_odd_rows(spark, odd):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.withColumn("__own", F.lit(1)).withColumn("first", F.lit(2)), "/root/testdata/sf0.001").count() <= odd.count()
    kept = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, odd, "").collect()
    assert len(kept) == odd.count() - 1
