"""Toxicity, language, shards, token counts and licenses: row by row operators."""

import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from assayer.llm import langid, licenses, sharding, tokencount, toxicity
from assayer.llm.common import held_out, uniform

from .conftest import by_id

SF = "/root/testdata/sf0.001"


def test_held_out_is_crc32_modulo_four(spark):
    rows = spark.range(200).select("id", held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in rows)
    assert spark.range(1).select(held_out(F.lit(None)).alias("h")).first().h is False


def test_uniform_draws_are_even(spark):
    rows = spark.range(4000).select(uniform(F.col("id"), "a").alias("x"), uniform(F.col("id"), "b").alias("y")).collect()
    assert abs(sum(r.x for r in rows) / 4000 - 0.5) < 0.03
    assert abs(sum(r.x < 0.2 and r.y < 0.2 for r in rows) / 4000 - 0.04) < 0.015


# Shards


def test_slots_are_claimed_by_turns():
    shards, slots = ["a", "b", "c"], 13
    owner = sharding.fill(shards, slots)
    taken, want = {}, [sharding.preference(s, slots) for s in shards]
    for turn in range(slots):
        first, stride = want[turn % 3]
        slot = next(s for s in ((first + j * stride) % slots for j in range(slots)) if s not in taken)
        taken[slot] = turn % 3
    assert owner == [taken[s] for s in range(slots)]
    assert {owner.count(i) for i in range(3)} <= {4, 5}


def test_few_slots_move_when_a_shard_leaves():
    shards = [f"s{i}" for i in range(20)]
    before = sharding.fill(shards, 2003)
    after = sharding.fill(shards[:-1], 2003)
    moved = sum(b != a for b, a in zip(before, after) if b != 19)
    assert moved < 0.15 * 2003


@pytest.mark.parametrize("shards, slots", [([], 7), (["a", "a"], 7), (["a"], 8), (["a"] , 1_000_033)])
def test_bad_tables_are_refused(shards, slots):
    with pytest.raises(ValueError):
        sharding.fill(shards, slots)


def test_rows_keep_their_columns_and_clashing_ones_give_way(odd):
    out = sharding.assign_shards(odd.withColumn("shard", F.lit("x")), shards=["a", "b"])
    assert out.columns == [*odd.columns, "slot", "shard"]
    rows = out.collect()
    assert len(rows) == odd.count() and all(r.shard in (0, 1) for r in rows)
    assert len({r.slot for r in rows if r.doc_id == 4}) == 1
    assert sharding.assign_shards(odd.limit(0)).count() == 0


# Token counts


def greedy(word: bytes, start: set[bytes], follow: set[bytes]) -> int:
    n, at, pieces = 0, 0, start
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if word[at:e] in pieces), None)
        if end is None:
            return 1
        n, at, pieces = n + 1, end, follow
    return n


def test_automaton_counts_greedy_pieces():
    rng = random.Random(5)
    for _ in range(60):
        start = {bytes(rng.choices(b"abc", k=rng.randint(1, 4))) for _ in range(rng.randint(1, 12))}
        follow = {bytes(rng.choices(b"abc", k=rng.randint(1, 4))) for _ in range(rng.randint(1, 12))}
        one, two = tokencount.Automaton(start), tokencount.Automaton(start, follow)
        for _ in range(60):
            word = bytes(rng.choices(b"abc", k=rng.randint(0, 12)))
            assert one.count(word) == greedy(word, start, start)
            assert two.count(word) == greedy(word, start, follow)


def test_token_counts_of_whole_table_and_odd_rows(real, odd):
    pieces = tokencount.read_pieces()
    known = set(pieces)
    texts = {r.doc_id: r.text for r in real.collect()}
    for i, r in by_id(tokencount.count_tokens(real, pieces)).items():
        units = tokencount.UNIT.findall(texts[i])
        assert "".join(units) == texts[i] and r.n_units == len(units)
        if i % 10 == 0:
            assert r.n_tokens == sum(greedy(u.encode(), known, known) for u in units)
    rows = tokencount.count_tokens(odd.withColumn("n_tokens", F.lit("x")), pieces, keep=["doc_id", "n_tokens"]).collect()
    assert len(rows) == odd.count() and {r.n_tokens for r in rows if r.doc_id in (1, 2)} == {0}
    assert all(r.doc_id is None or isinstance(r.doc_id, int) for r in rows)
    assert tokencount.count_tokens(odd.limit(0), pieces).count() == 0


# Language


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = langid.op2_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id")
    rows = found.where("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_of_odd_rows(odd, docs_of):
    learned = langid.learn(odd.union(docs_of([(9, "der die das und nicht " * 9, "de")])), F.lit(True))
    rows = langid.classify(odd, learned).collect()
    assert len(rows) == odd.count()
    assert {r.lang_pred for r in rows if r.doc_id in (1, 2, 3, 6)} == {"und"}
    assert {r.lang_pred for r in rows if r.doc_id == 4} <= {"en", "de"}
    assert langid.learn(odd.limit(0), F.lit(True)) == []
    assert {r.lang_pred for r in langid.classify(odd, []).collect()} == {"und"}


def test_copies_do_not_change_what_is_learned(spark, docs_of):
    rng = random.Random(13)
    syllables = {"en": ["the", "ing", "ough", "wh", "ed"], "de": ["der", "sch", "ung", "ein", "icht"]}
    rows = [
        (100 * k + i, " ".join("".join(rng.choices(parts, k=3)) for _ in range(60)), lang)
        for k, (lang, parts) in enumerate(syllables.items()) for i in range(100)
    ] + [(1000 + i, f"{i} ?!", "de") for i in range(900)]  # texts without letters take no one's place
    docs = docs_of(rows)
    copied = docs.crossJoin(spark.range(1000).select(F.lit(1).alias("copy"))).where("doc_id < 1000 or doc_id = 1500").drop("copy")
    once, often = dict(langid.learn(docs, F.lit(True))), dict(langid.learn(copied, F.lit(True)))
    assert once == often and set(once) == {"en", "de"}
    few = dict(langid.learn(copied, F.lit(True), sample_rows=150))
    assert few == once and all(len(d) > 30_000 for d in once.values())


def test_long_text_counts_to_its_end():
    english, german = "the house by the river is old ".encode() * 90, "das haus am fluss ist sehr alt ".encode() * 90
    sizes = langid.Compressors([("en", english), ("de", german)])
    text = "the house by the river is old " * 300 + "das haus am fluss ist sehr alt " * 3000
    assert sizes.classify(text, 0.0)[0] == "de"


# Toxicity


def all_segments(scores):
    """Maximal scoring segments by their recursive definition."""
    best = max(((sum(scores[a:b]), -(b - a), -a, a, b) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)), default=None)
    if best is None or best[0] <= 0:
        return []
    a, b = best[3], best[4]
    left, right = all_segments(scores[:a]), all_segments(scores[b:])
    return left + [(a, b, best[0])] + [(x + b, y + b, s) for x, y, s in right]


def test_segments_equal_the_recursive_definition():
    rng = random.Random(3)
    for _ in range(300):
        scores = [rng.choice([-3.1, -1.7, -0.4, 0.9, 2.3, 4.2]) + rng.random() * 1e-3 for _ in range(rng.randint(0, 14))]
        got, want = toxicity.segments(scores), all_segments(scores)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]


def test_toxic_words_are_learned(spark, docs_of):
    rng = random.Random(1)
    plain = [f"word{i}" for i in range(60)]
    rows, marks = [], []
    for i in range(400):
        words = rng.choices(plain, k=60)
        if i % 4 == 0:
            for k in (10, 12, 14):
                words[k] = rng.choice(["vile", "foul", "rotten"])
        rows.append((i, " ".join(words)))
        marks.append((i, int(i % 4 == 0)))
    docs = docs_of(rows)
    labels = spark.createDataFrame(marks + [(7, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels, ~held_out(F.col("doc_id")))
    out = by_id(toxicity.score(docs, model))
    assert all((r.score >= toxicity.CUT) == (i % 4 == 0) for i, r in out.items())
    assert all(10 <= p.start and p.end <= 15 for i in range(0, 400, 4) for p in out[i].passages)


def test_toxicity_of_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1), (2, 0), (4, 1), (5, 0), (6, None)], "doc_id long, toxic int")
    model = toxicity.learn(odd, labels, F.lit(True))
    rows = toxicity.score(odd.withColumn("score", F.lit("x")), model, ["doc_id", "score"]).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    none = toxicity.learn(odd, labels.limit(0), F.lit(True))
    assert {r.score for r in toxicity.score(odd, none).collect()} == {0.0}
    assert toxicity.score(odd.limit(0), model).count() == 0


# Licenses


def scan_by_hand(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    at = [(i, label) for phrase, label in licenses.PHRASES for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    return (
        len(words), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None),
        ",".join(sorted({x for _, x in at})),
    )


def test_licenses_equal_a_scan_by_hand(docs_of, odd):
    notice = licenses.NOTICES[0][0].split()
    texts = [
        "MIT License, mit-license and the Apache  LICENSE.", "General Public License general public license mit", "mit",
        "MİT license mit licenſe Kit license", " ".join(notice), " ".join([*notice[:20], "odd", "words", *notice[20:]]),
        " ".join(notice[:8]), "mit license " * 300, "É mit License à",
    ]
    docs = docs_of([(100 + i, t) for i, t in enumerate(texts)]).union(odd)
    rows = licenses.scan(docs).collect()
    assert len(rows) == docs.count()
    want = sorted((r.doc_id or -1, *map(str, scan_by_hand(r.text))) for r in docs.collect())
    got = sorted((r.doc_id or -1, *map(str, (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels))) for r in rows)
    assert got == want
    per = {r.doc_id: r for r in rows}
    assert per[104].labels == per[105].labels == "mit-text" and per[106].labels == ""
    assert per[105].score > 0.9 > 0.2 > per[106].score
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in rows)
    assert licenses.scan(odd.limit(0)).count() == 0


def test_texts_without_a_letter_have_no_language(docs_of):
    rows = [(1, "²"), (2, "12 ½"), (3, "① ⅷ ٣"), (4, "___ 9"), (5, "é"), (6, "中文")]
    learned = [("en", b" the and of to in is that it was for " * 20), ("de", b" der die das und nicht ist ein eine zu " * 20)]
    got = {r.doc_id: r.lang_pred for r in langid.classify(docs_of(rows), learned).collect()}
    assert [got[i] for i in (1, 2, 3, 4)] == ["und"] * 4 and "und" not in (got[5], got[6])
