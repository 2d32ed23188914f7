"""Co-occurrences and PPMI by plain counting, singular values by numpy, and L1 models at their optimum."""

from collections import Counter
from math import log

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from lexloom.operators import classify, evaluate, many_models, split, word_vectors


@pytest.fixture(scope="module")
def docs(spark):
    draw = np.random.default_rng(3)
    rows = [(draw.choice(list("abcdefgxy"), draw.integers(0, 30)).tolist(),) for _ in range(60)] + [(None,), ([],), (["a"] * 40,)]
    return spark.createDataFrame(rows, "words array<string>").repartition(4)


@pytest.fixture(scope="module")
def vocab(spark):
    return spark.createDataFrame([(w, i) for i, w in enumerate("abcdefg")], "gram string, term_id int")


def counted(docs, window):
    out = Counter()
    for (words,) in docs.collect():
        for p, a in enumerate(words or []):
            for q in range(max(0, p - window), min(len(words), p + window + 1)):
                if p != q and a in "abcdefg" and words[q] in "abcdefg":
                    out["abcdefg".index(a), "abcdefg".index(words[q])] += 1
    return out


@pytest.mark.parametrize("window", [1, 5])
def test_pairs_and_their_information(docs, vocab, window):
    want = counted(docs, window)
    counts = word_vectors.cooccurrences(docs, "words", vocab, window)
    assert {(r.i, r.j): r.n for r in counts.collect()} == want
    s, whole = Counter(), sum(want.values())
    for (i, _), n in want.items():
        s[i] += n
    positive = {k: v for k, n in want.items() if (v := log(n * whole / s[k[0]] / s[k[1]])) > 0}
    got = {(r.i, r.j): r.value for r in word_vectors.ppmi(counts).collect()}
    assert set(got) == set(positive) and all(abs(got[k] - positive[k]) < 1e-9 for k in got)
    few = word_vectors.cooccurrences(docs, "words", vocab, window, most=3).collect()
    assert {(r.i, r.j): r.n for r in few} == {k: n for k, n in want.items() if max(k) < 3}


def test_singular_values(spark):
    draw = np.random.default_rng(4)
    q = np.linalg.qr(draw.normal(size=(60, 60)))[0]
    a = q @ np.diag(np.concatenate([[50, 30, -20, 10, 5], draw.random(55)])) @ q.T
    a[np.abs(a) < 0.05] = 0
    i, j = np.nonzero(a)
    rows = spark.createDataFrame(list(zip(i.tolist(), j.tolist(), a[i, j].tolist(), strict=True)), "i long, j long, value double")
    u, s = word_vectors.symmetric_svd(rows, 60, 5)
    exact = np.linalg.svd(a)
    assert np.allclose(s, exact[1][:5], rtol=1e-6)
    assert np.allclose(np.abs(np.diag(u.T @ exact[0][:, :5])), 1, atol=1e-6)


def test_vectors_of_words(docs, vocab):
    got = {r.gram: r.vector for r in word_vectors.word_vectors(docs, "words", vocab, rank=3, window=2).collect()}
    assert set(got) == set("abcdefg") and {len(v) for v in got.values()} == {3}
    assert word_vectors.word_vectors(docs, "words", vocab.where("false")).count() == 0
    assert {tuple(r.vector) for r in word_vectors.word_vectors(docs.where("false"), "words", vocab, rank=2).collect()} == {(0.0, 0.0)}


def test_l1_models_are_at_their_optimum(spark):
    draw = np.random.default_rng(7)
    x = draw.normal(size=(200, 8))
    y = (x[:, 0] - 2 * x[:, 1] + 0.3 * draw.normal(size=200) > 0.2).astype(float)
    df = spark.createDataFrame([(i, float(b), Vectors.dense(a)) for i, (a, b) in enumerate(zip(x, y, strict=True))], ["doc_id", "label", "features"])
    rows = many_models.sparse_rows(df.selectExpr("*", "-2 AS fold"), "fold").coalesce(2).persist()
    cs = (0.01, 0.2)
    fitted = many_models.fit_l1(rows, [many_models.Spec(c) for c in cs], 8, tolerance=1e-4)
    for c, point in zip(cs, fitted.points.T, strict=True):
        p = 1 / (1 + np.exp(-(x @ point[:-1] + point[-1])))
        slope, strength = x.T @ (p - y) / 200, 1 / (c * 200)
        at = point[:-1]
        assert np.abs(slope[at != 0] + strength * np.sign(at[at != 0])).max(initial=0) < 2e-4 and (np.abs(slope[at == 0]) - strength).max(initial=0) < 2e-4 and abs((p - y).mean()) < 2e-4
    assert (fitted.points[:-1] == 0).sum(0).tolist()[0] == 8 and 0 < (fitted.points[:-1, 1] == 0).sum() < 8
    vocab = spark.createDataFrame([(f"t{i}", i) for i in range(8)], "gram string, term_id int")
    terms = {r.term: r.zeroed for r in classify.lasso_terms(df, vocab, 0.2, 1e-3).collect()}
    assert len(terms) == 8 and not terms["t1"] and sum(terms.values()) >= 3


def test_ranks_from_ranges(spark, monkeypatch):
    rows = spark.createDataFrame([(f"t{i:02d}", float(i * 37 % 50)) for i in range(50)], "term string, coef double").repartition(5)
    for most in (split.BROADCAST_ROWS, 0):
        monkeypatch.setattr(split, "BROADCAST_ROWS", most)
        got = sorted((r["rank"], r.part, r.coef) for r in evaluate.importance_slices(rows).collect())
        assert got == [(i, "bottom" if i < 5 else "top" if i >= 45 else "middle", float(i)) for i in (*range(5), *range(20, 30), *range(45, 50))]
