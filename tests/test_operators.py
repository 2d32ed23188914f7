from math import log2

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexloom.operators import classify, evaluate, graph, split, vectorize
from lexloom.plans import pipeline, queries
from lexloom.sources import sinks


def test_vocabulary_band_and_weights(spark):
    rows = [(d, g, 1) for g, df in (("low", 4), ("five", 5), ("six", 6), ("b", 5)) for d in range(df)]
    tf = spark.createDataFrame(rows, "doc_id long, gram string, tf long")
    frequencies = vectorize.document_frequencies(tf)
    vocab = vectorize.vocabulary(frequencies, 10, keep=1)
    assert [(r.gram, r.df, r.term_id, r.idf) for r in vocab.collect()] == [("b", 5, 0, log2(2))]
    whole = vectorize.vocabulary(frequencies, 10)
    assert [tuple(r) for r in vectorize.vocabulary(frequencies, 10, keep=None).orderBy("term_id").collect()] == [tuple(r) for r in whole.orderBy("term_id").collect()]
    weights = vectorize.tfidf(tf, whole, "doc_id")
    norms = weights.groupBy("doc_id").agg(F.sum(F.col("weight") ** 2).alias("s")).collect()
    assert all(abs(r.s - 1) < 1e-9 for r in norms)
    arrays = tf.groupBy("doc_id").agg(F.collect_list("gram").alias("grams")).unionByName(spark.createDataFrame([(6, [])], "doc_id long, grams array<string>"))
    assert sorted(map(tuple, vectorize.array_frequencies(arrays, "grams").collect())) == sorted(map(tuple, frequencies.collect()))
    rows = vectorize.vectors(arrays, whole, "grams", 3)
    vectors = {r.doc_id: (r.features, r.n_terms) for r in rows.collect()}
    assert vectors[6][0].numNonzeros() == vectors[6][1] == 0 and vectors[0][0].size == 2 and vectors[0][1] == 2
    both = [sorted((r.doc_id, r.gram, r.term_id, round(r.weight, 12)) for r in x.collect()) for x in (weights, vectorize.weights_of(rows, whole, "doc_id"))]
    assert both[0] == both[1]
    none = vectorize.vectors(arrays, whole.where("false"), "grams", 3)
    assert {r.n_terms for r in none.collect()} == {0}


def test_splits(spark):
    rows = spark.createDataFrame([(i, int(i < 5)) for i in range(16)], "k long, y int")
    parts = {(r.y, r.part): r["count"] for r in split.stratified_split(rows, "y", "k").groupBy("y", "part").count().collect()}
    assert parts == {(1, "train"): 4, (1, "test"): 1, (0, "train"): 8, (0, "test"): 3}
    folds = {(r.y, r.fold): r["count"] for r in split.k_folds(rows, "y", "k", 5, seed=3).groupBy("y", "fold").count().collect()}
    assert [folds[1, i] for i in range(5)] == [1] * 5 and [folds[0, i] for i in range(5)] == [2, 2, 2, 2, 3]
    assert [r.idx for r in split.numbered(rows.select("k"), "k").orderBy("k").collect()] == list(range(16))
    with pytest.raises(ValueError):
        split.k_folds(rows, "y", "k", 1)


def scored(spark, rows):
    return spark.createDataFrame([(str(i), float(y), float(p)) for i, (y, p) in enumerate(rows)], "title string, actual double, predicted double")


def test_thresholds(spark):
    df = scored(spark, [(1, 0.9), (1, 0.2), (0, 0.2), (0, 0.1)])
    at = {round(r.threshold, 2): (r.tp, r.fn, r.fp, r.tn) for r in evaluate.confusion_sweep(df).collect()}
    assert len(at) == 16 and at[0.2] == (1, 1, 0, 2)
    assert df.where(evaluate.over(0.2, inclusive=True)).count() == 3
    assert tuple(evaluate.precision_recall(df, 0.2).head()) == (1.0, 0.5)
    assert tuple(evaluate.precision_recall(df, 0.95).head()) == (0.0, 0.0)
    assert [r.title for r in evaluate.bucket_report(df, 0.2, "FN").collect()] == ["1"]
    assert not scored(spark, [(1, float("nan"))]).where(evaluate.over(0.5)).count()


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 5)), min_size=2, max_size=30).filter(lambda x: 0 < sum(y for y, _ in x) < len(x)))
def test_auc_is_the_share_of_ordered_pairs(spark, rows):
    pos, neg = [p for y, p in rows if y], [p for y, p in rows if not y]
    expected = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg)
    df = scored(spark, rows)
    assert abs(evaluate.roc_auc(df).head()[0] - expected) < 1e-9
    grid = evaluate.roc_grid(df).orderBy("fpr").collect()
    assert len(grid) == 100 and grid[0].tpr == 0 and grid[-1].tpr == 1


def test_places_within_a_frequent_label(spark):
    rows = spark.createDataFrame([(i * 37 % 500, None if i % 50 == 0 else "a" if i % 7 else "b") for i in range(500)], "k long, y string")
    got = split.stratified_split(rows.repartition(7), "y", "k", 0.5)
    for y in ("a", "b", None):
        own = sorted((r.k, r.part) for r in got.collect() if r.y == y)
        assert [p for _, p in own] == ["train"] * (len(own) // 2) + ["test"] * (len(own) - len(own) // 2)
    assert [r.k for r in split.numbered(rows.repartition(7), F.desc("k")).orderBy("idx").collect()] == list(range(499, -1, -1))


def test_ends_of_a_bucket(spark):
    df = scored(spark, [(0, p / 10) for p in range(3, 10)])
    assert [r.title for r in evaluate.bucket_ends(df, 0.2, "FP", 2).collect()] == ["0", "1"]
    assert [r.title for r in evaluate.bucket_ends(df, 0.2, "FP", 2, last=True).collect()] == ["6", "5"]


def test_first_writer_wins(spark):
    rows = spark.createDataFrame([("a", 3, "x"), ("a", 1, "y"), ("b", 2, None), (None, 5, "z"), (None, 4, "z")], "k string, at int, v string")
    assert sorted(((r.k or ""), r.at) for r in sinks.first_by(rows, ["k"], ["at"]).collect()) == [("", 4), ("a", 1), ("b", 2)]


def test_cycles_are_found_in_the_core(spark):
    links = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("x", "a"), ("s", "s"), ("e", "f"), ("f", "g")]
    edges = spark.createDataFrame(links, "parent string, child string")
    assert {(r.parent, r.child) for r in graph.core(edges, 10).collect()} == {("a", "b"), ("b", "c"), ("c", "a"), ("s", "s")}
    assert {r.node for r in graph.in_cycles(edges, 3).collect()} == {"a", "b", "c", "s"} and {r.node for r in graph.in_cycles(edges, 2).collect()} == {"s"}


def test_levels_in_a_cycle(spark):
    edges = spark.createDataFrame([("A", "B"), ("A", "C"), ("B", "D"), ("C", "D"), ("D", "A")], "parent string, child string")
    tree = graph.levels(edges, "A", 5)
    assert {tuple(r) for r in tree.collect()} == {("A", 0), ("B", 1), ("C", 1), ("D", 2)}
    assert {r.node for r in graph.in_cycles(edges, 4).collect()} == {"A", "B", "C", "D"}
    assert [(r.depth, r.upto) for r in graph.depth_counts(tree).orderBy("depth").collect()] == [(0, 1), (1, 3), (2, 4)]


def test_training(spark, tmp_path):
    words = {"m": ("ring", "field", "group"), "x": ("cell", "blood", "heart")}
    rows = [(i, t, f"{words[t][i // 3 % 3]} common{i % 2}") for i in range(60) for t in ("m" if i % 3 == 0 else "x",)]
    docs = spark.createDataFrame(rows, "doc_id long, target string, text string")
    got = pipeline.train(docs, "m", cs=(0.1, 10.0), size=50, n_grams=1)
    assert got.best == 10.0 and got.grid.count() == 2
    assert {r.bucket for r in evaluate.with_buckets(got.evaluation, 0.5).collect()} == {"TP", "TN"}
    new = spark.createDataFrame([(1, "ring group"), (2, "unknown words"), (3, None)], "doc_id long, text string")
    found = {r.doc_id: r.predicted for r in got.final.scored(new).collect()}
    assert found[1] > 0.5 and found[2] == found[3] == 0.0
    assert got.importance().count() > 0
    assert pipeline.target_name("Computer Science") == "computer_science" and pipeline.seed_parts("seed/computer_science_d5.csv") == ("computer_science", 5)
    assert [pipeline.target_name(x) for x in ("Aeronautics", "Arts", "Biology", "Chemistry", "Computer Science", "Engineering", "Mathematics", "Philosophy", "Physics")] == list(pipeline.TARGETS)
    with pytest.raises(ValueError):
        pipeline.target_name("cooking")
    got.final.save(f"{tmp_path}/model")
    again = pipeline.load(spark, f"{tmp_path}/model")
    assert {r.doc_id: r.predicted for r in again.scored(new).collect()} == found and (again.target, again.n_grams) == ("m", 1)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        pipeline.load(spark, f"{tmp_path}/none")


def test_semi_and_anti_joins_in_plans(spark):
    sf = "/root/testdata/sf0.001"
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan(queries.semi_join_titles(spark, sf)) and "LeftAnti" in plan(queries.anti_insert_if_absent(spark, sf))


def test_logistic_regression_is_at_its_optimum(spark):
    """The gradient of c x summed loss + half the squared weights vanishes; the intercept is not penalised."""
    import numpy as np
    from pyspark.ml.linalg import Vectors

    draw = np.random.default_rng(3)
    x = draw.normal(size=(200, 4))
    y = (x @ np.array([1.0, -2.0, 0.0, 0.5]) + draw.normal(size=200) > 0).astype(float)
    rows = spark.createDataFrame([(float(a), Vectors.dense(b)) for a, b in zip(y, x)], ["label", "features"])
    for c in (0.1, 2.0):
        model = classify.logistic_regression(rows, c)
        w, b = model.coefficients.toArray(), model.intercept
        p = 1 / (1 + np.exp(-(x @ w + b)))
        assert np.abs(c * x.T @ (p - y) + w).max() < 0.02 * c and abs((p - y).sum()) < 0.02


def test_logistic_regression_parameter(spark):
    from pyspark.ml.linalg import Vectors

    rows = spark.createDataFrame([(float(i % 2), Vectors.dense([float(i % 2)])) for i in range(8)], ["label", "features"])
    assert classify.logistic_regression(rows, 2.0).getRegParam() == 1 / 16
