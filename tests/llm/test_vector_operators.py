"""Token files, hard negatives and whitening against brute force."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F, types as T

from assayer.llm import hardnegatives, tokenfiles, whitening
from assayer.llm.eliasfano import EliasFano
from assayer.llm.vectors import packed, usable

public_tokenizers = pytest.importorskip("public_tokenizers")
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")

# Elias-Fano and token files


@pytest.mark.parametrize("top", [0, 1, 9, 10**6, 2**62])
def test_values_come_back_from_their_code(top):
    rng = np.random.default_rng(top % 97)
    for n in (0, 1, 2, 255, 256, 257, 5000):
        values = np.sort(rng.integers(0, top + 1, n).astype(np.uint64))
        code = EliasFano.encode(values)
        again = EliasFano.from_bytes(code.to_bytes())
        ask = rng.permutation(n)
        assert (again.get(ask) == values[ask]).all()
        if n == 5000 and top:
            assert 8 * (code.lower.nbytes + code.upper.nbytes) <= n * (3 + np.log2(max(2, top / n))) + 512
    with pytest.raises(ValueError):
        EliasFano.encode(np.array([2, 1]))
    with pytest.raises(IndexError):
        EliasFano.encode(np.array([1])).get(np.array([1]))


def test_clustered_values_are_selected_over_long_gaps():
    values = np.sort(np.concatenate([np.arange(400), [10**7], 10**7 + np.arange(400), [3 * 10**8]])).astype(np.uint64)
    assert (EliasFano.encode(values).get(np.arange(len(values))) == values).all()


def test_pieces_equal_the_library(monkeypatch):
    run = tokenfiles.Encoder(VOCABULARY)
    rng = random.Random(2)
    pool = [*"abc srtmdvle's\t\n\r\x0b\x1c\x85  _-!?é 　½²Ⅷ١́‍😀中\U00020000﻿", "  ", "'s", "'ll", " '", "'re", "<|endoftext|>"]
    texts = ["".join(rng.choice(pool[:16] if rng.random() < 0.7 else pool) for _ in range(rng.randrange(40))) for _ in range(3000)]
    for at_once, cached in ((tokenfiles.AT_ONCE, tokenfiles.CACHED), (50, 300)):
        monkeypatch.setattr(tokenfiles, "AT_ONCE", at_once)
        monkeypatch.setattr(tokenfiles, "CACHED", cached)
        assert run([*texts, None, ""]) == [*map(run.whole, texts), b"", b""]


def tokens_by_hand(rows):
    """(key, start, tokens, checksum) in order of key, nulls first, from the library alone."""
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(VOCABULARY).encode
    out, start = [], 0
    for key, text in rows:
        ids = np.array([*encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((key, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_files_hold_every_document_in_order(spark, docs_of, odd, real, monkeypatch):
    rng = random.Random(5)
    rows = [(rng.randrange(-40, 200), " ".join(rng.choices(["one", "two", "drei", "vier 5", "!"], k=rng.randrange(60)))) for _ in range(500)]
    rows += [(77, f"hot {k}") for k in range(300)] + [(90, "long " * 20_000)]
    docs = docs_of(rows).union(odd)
    for a_range, a_file in ((tokenfiles.ROWS_A_RANGE, tokenfiles.IDS_A_FILE), (60, 2000)):
        monkeypatch.setattr(tokenfiles, "ROWS_A_RANGE", a_range)
        monkeypatch.setattr(tokenfiles, "IDS_A_FILE", a_file)
        written = tokenfiles.write_files(docs.withColumn("range", F.lit("x")), VOCABULARY)
        assert (len(written.files) > 8) == (a_range == 60)
        got = sorted(map(tuple, tokenfiles.read_files(spark, written).collect()), key=lambda r: r[1])
        by_hash = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()
        order = sorted(by_hash, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.h))
        assert got == tokens_by_hand([(r.doc_id, r.text) for r in order])
    ids = {r.start: r.ids for r in tokenfiles.read_files(spark, written, ids=True).collect()}
    assert all(zlib.crc32(np.array(ids[s], "<u4").tobytes()) == c and len(ids[s]) == n for _, s, n, c in got)
    empty = tokenfiles.write_files(docs.limit(0), VOCABULARY)
    assert empty.files == [] and tokenfiles.read_files(spark, empty).count() == 0
    with pytest.raises(TypeError):
        tokenfiles.write_files(docs.withColumn("doc_id", F.lit("a")), VOCABULARY)


def test_a_document_is_read_by_its_number():
    ids = [np.array(v, "<u2").tobytes() for v in ([5, 2], [2], [7, 8, 9, 2])]
    found = tokenfiles.TokenFile(tokenfiles.pack([None, -3, 10], ids, 2))
    assert found.keys() == [None, -3, 10] and [found.ids(k).tolist() for k in range(3)] == [[5, 2], [2], [7, 8, 9, 2]]
    assert found.offsets(np.array([0, 1, 2, 3])).tolist() == [0, 2, 3, 7]
    with pytest.raises(ValueError):
        tokenfiles.TokenFile(b"x" * 100)


# Vectors

VECTORS = T.StructType([
    T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()),
])


def vectors(n, d, seed, clusters=4, spread=0.3):
    """Clustered vectors with copies, an ever-present vector, zeros and labels that follow the clusters in part."""
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(clusters, d))
    own = rng.integers(0, clusters, n)
    x = centers[own] + spread * rng.normal(size=(n, d))
    x[n // 3 : n // 2] = x[0]
    x[:: max(3, n // 20)] = 0
    labels = np.where(rng.random(n) < 0.7, own, rng.integers(0, 10, n))
    return [(i, [float(v) for v in x[i]], int(labels[i])) for i in range(n)]


ODD_VECTORS = [
    (None, [1.0, 2.0, 3.0], 1), (100_000, None, 1), (100_050, [1.0, None, 2.0], 1), (100_100, [float("nan"), 0.0, 1.0], 2),
    (100_150, [float("inf"), 0.0, 1.0], 2), (100_200, [1.0, 2.0], 3), (100_250, [], 3), (100_300, [0.5, 0.5, 0.5], None),
]


def negatives_by_hand(rows, d):
    kept = {
        (i, tuple([np.floor(256.0 * np.float32(v)) for v in x] + [0.0] * (d - len(x))), (lab + 1) % 10 if i % 7 == 0 else lab)
        for i, x, lab in rows
        if i is not None and lab is not None and x is not None and all(v is not None and np.isfinite(v) for v in x)
    }
    kept = sorted(kept)
    ids, labels = np.array([k[0] for k in kept]), np.array([k[2] for k in kept])
    x = np.array([k[1] for k in kept]).reshape(len(kept), d).astype(np.int64)
    out = set()
    for a in np.flatnonzero(ids % 50 == 0):
        scores = x @ x[a]
        order = np.lexsort((ids, -scores))
        positives = [p for p in order if labels[p] == labels[a] and ids[p] != ids[a]][:5]
        for p in positives:
            fits = [q for q in order if labels[q] != labels[a] and 50 * scores[p] <= 100 * scores[q] <= 95 * scores[p]][:3]
            out |= {(int(ids[a]), int(ids[p]), r + 1, int(ids[q]), int(scores[p]), int(scores[q])) for r, q in enumerate(fits)}
    return out


@pytest.mark.parametrize("leaf, chunk, block", [(hardnegatives.LEAF, hardnegatives.CHUNK, hardnegatives.BLOCK), (8, 20, 3)])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, leaf, chunk, block):
    monkeypatch.setattr(hardnegatives, "LEAF", leaf)
    monkeypatch.setattr(hardnegatives, "CHUNK", chunk)
    monkeypatch.setattr(hardnegatives, "BLOCK", block)
    rows = vectors(900, 3, 3) + ODD_VECTORS + vectors(900, 3, 3)[50:60] + [(50, [0.3, 0.2, 0.1], 2)]
    df = spark.createDataFrame(rows, VECTORS).withColumn("x", F.lit("clash")).withColumn("id", F.lit(1))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = [tuple(r) for r in hardnegatives.mine(df, label=label).collect()]
    assert len(got) == len(set(got)) and set(got) == negatives_by_hand(rows, 3) and len(got) > 50
    assert hardnegatives.mine(df.limit(0), label=label).count() == 0


def test_leaves_left_out_hold_nothing_in_the_window(spark):
    rows = vectors(3000, 6, 5, clusters=12, spread=0.1)
    df = spark.createDataFrame(rows, VECTORS)
    base = packed(df.where(usable("embedding")), "embedding", [(F.col("vec_id"), "id"), (F.col("label").cast("long"), "label")], 256, 6, "<i4")
    index = hardnegatives.build_index(base, 6)
    x = np.array([np.frombuffer(r.x, "<i4") for r in base.collect()]).astype(float)
    leaf = index.tree.place(x)
    rng = np.random.default_rng(1)
    left_out = 0
    for a in rng.choice(len(x), 60, replace=False):
        scores = x @ x[a]
        low, high = np.sort(rng.choice(scores, 2))
        seen = index.tree.visits(x[a : a + 1], np.array([low]), np.array([high]))[0]
        assert set(leaf[(scores >= low) & (scores <= high)]) <= set(np.flatnonzero(seen))
        left_out += (~seen).sum()
    assert left_out > 60


def test_secular_roots_and_spectra_equal_the_dense_solution():
    rng = np.random.default_rng(4)
    for _ in range(300):
        k = int(rng.integers(1, 20))
        d, z = np.sort(rng.random(k)) * 10.0 ** rng.integers(-3, 6), rng.normal(size=k) * 10.0 ** rng.integers(-3, 4, k)
        pole, tau = whitening.secular_roots(d, z)
        want = np.linalg.eigvalsh(np.diag(d) + np.outer(z, z))
        assert np.abs(d[pole] + tau - want).max() <= 1e-13 * want.max()
    for d, rows in ((1, 30), (5, 3), (16, 90)):
        x = np.floor(rng.normal(size=(rows, d)) * 20)
        x[:, d // 2 + 1 :] = 3  # columns without variance
        parts = [whitening.Spectrum(d) for _ in range(3)]
        for i, p in enumerate(parts):
            for s in range(i, rows, 3 * 7):
                p.add(x[s : s + 21 : 3])
        whole = whitening.Spectrum.from_bytes(parts[0].to_bytes(), d)
        for p in parts[1:]:
            whole.take(p)
        off = x - x.mean(axis=0)
        scatter = off.T @ off
        assert whole.n == rows and np.allclose(whole.mean, x.mean(axis=0))
        assert np.abs(whole.vectors * whole.values @ whole.vectors.T - scatter).max() <= 1e-12 * max(1, np.abs(scatter).max())
        assert np.abs(whole.vectors.T @ whole.vectors - np.eye(d)).max() < 1e-12


def whitened_by_hand(rows, d):
    good = [(i, [*x, *[0.0] * (d - len(x))]) for i, x, _ in rows if x is not None and all(v is not None and np.isfinite(v) for v in x)]
    x = np.floor(64 * np.array([np.float32(v) for _, v in good]).astype(float)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    off = fit - s / n
    values, basis = np.linalg.eigh(off.T @ off / n)
    values, basis = values[::-1], basis[:, ::-1]
    return [i for i, _ in good], n, ((n * x - s) ** 2).sum(axis=1), (x - s / n) @ basis / np.sqrt(values), values / values.sum()


@pytest.mark.parametrize("d", [3, 20])
def test_whitening_equals_the_dense_solution(spark, d):
    rows = vectors(500, d, 8) + (ODD_VECTORS if d == 3 else [])
    df = spark.createDataFrame(rows, VECTORS).repartition(40).withColumn("x", F.lit("clash")).withColumn("n", F.lit(1))
    ids, n, deviation, want, explained = whitened_by_hand(rows, d)
    got = {}
    for r in whitening.whiten(df).collect():
        got.setdefault(r.vec_id, {})[r.component] = r
    k = min(16, d)
    assert set(got) == set(ids) and all(set(v) == set(range(1, k + 1)) for v in got.values())
    w = np.array([[got[i][c + 1].whitened for c in range(k)] for i in ids])
    sign = np.sign((w * want[:, :k]).sum(axis=0))
    assert np.abs(w * sign - want[:, :k]).max() < 1e-8
    one = got[ids[0]]
    assert [got[i][1].deviation for i in ids] == deviation.tolist() and one[1].n == n
    assert np.allclose([one[c + 1].explained for c in range(k)], explained[:k], rtol=1e-10) and one[1].identity_error < 1e-10


def test_whitening_without_variance(spark):
    same = spark.createDataFrame([(1, [0.5, 1.0], 0), (2, [0.5, 1.0], 1), (None, [0.5, 1.0], 1)], VECTORS)
    rows = whitening.whiten(same).collect()
    assert len(rows) == 6 and all(r.n == 1 and r.deviation == 0 and r.whitened is None and r.explained is None for r in rows)
    line = spark.createDataFrame([(i, [float(i), 1.0], 0) for i in range(5)], VECTORS)
    rows = {(r.vec_id, r.component): r for r in whitening.whiten(line).collect()}
    assert rows[0, 1].explained == 1.0 and rows[0, 2].whitened is None and rows[0, 1].identity_error < 1e-12
    assert whitening.whiten(same.limit(0)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [], 0)], VECTORS)).count() == 0
