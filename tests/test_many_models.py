"""Models of a grid that are trained together against each alone, and against their optimum."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from lexloom.operators import classify, many_models


@pytest.fixture(scope="module")
def data():
    draw = np.random.default_rng(5)
    x = draw.normal(size=(300, 6)) * (draw.random((300, 6)) < 0.5)
    y = (x @ np.array([1.0, -2.0, 0.0, 0.5, 1.5, -0.3]) + draw.normal(size=300) > 0.4).astype(float)
    return x, y, np.arange(300) % 3


@pytest.fixture(scope="module")
def rows(spark, data):
    x, y, fold = data
    sparse = lambda v: Vectors.sparse(6, np.flatnonzero(v).tolist(), v[v != 0].tolist())
    made = [(i, float(b), Vectors.dense(a) if i % 4 == 0 else sparse(a), int(k)) for i, (a, b, k) in enumerate(zip(x, y, fold, strict=True))]
    return many_models.sparse_rows(spark.createDataFrame(made, ["doc_id", "label", "features", "fold"]).repartition(3), "fold").persist()


SPECS = [many_models.Spec(0.05), many_models.Spec(8.0), many_models.Spec(1.0, 0)]


def test_all_models_are_at_their_optimum(data, rows):
    x, y, fold = data
    fitted = many_models.fit_many(rows, SPECS, 6)
    for spec, point in zip(SPECS, fitted.points.T, strict=True):
        own = np.ones(300, bool) if spec.without is None else fold != spec.without
        p = 1 / (1 + np.exp(-(x[own] @ point[:-1] + point[-1])))
        assert np.abs(spec.c * x[own].T @ (p - y[own]) + point[:-1]).max() < 1e-4 and abs((p - y[own]).sum()) < 1e-4


def test_together_is_as_one_by_one_and_scans_do_not_add_up(rows):
    together = many_models.fit_many(rows, SPECS, 6)
    alone = [many_models.fit_many(rows, [s], 6) for s in SPECS]
    assert np.abs(together.points - np.hstack([a.points for a in alone])).max() < 1e-4
    assert together.scans == max(a.scans for a in alone) < sum(a.scans for a in alone)


def test_a_known_solution_is_a_warm_start(rows):
    cold = many_models.fit_many(rows, SPECS, 6)
    warm = many_models.fit_many(rows, SPECS, 6, start=cold.points)
    assert warm.scans == 1 and np.allclose(warm.points, cold.points)


def test_losses_of_folds(data, rows):
    x, y, fold = data
    points = np.random.default_rng(2).normal(size=(7, 3))
    points[:, 2] *= 1000
    want = []
    for k in range(3):
        p = np.clip(1 / (1 + np.exp(-np.clip(x[fold == k] @ points[:-1, k] + points[-1, k], -700, 700))), 1e-15, 1 - 1e-15)
        want.append(-np.mean(np.log(np.where(y[fold == k] > 0, p, 1 - p))))
    assert np.allclose(many_models.log_losses(rows, points, np.arange(3)), want, atol=1e-9)
    assert np.isclose(many_models.log_losses(rows, points)[0], -np.mean(np.log(np.where(y > 0, *(lambda q: (q, 1 - q))(1 / (1 + np.exp(-(x @ points[:-1, 0] + points[-1, 0]))))))))


def test_no_rows_and_blocks_of_terms(spark, rows, monkeypatch):
    none = many_models.fit_many(rows.where("false"), SPECS[:2], 6)
    assert not none.points.any()
    whole = many_models.fit_many(rows, SPECS[:2], 6).points
    monkeypatch.setattr(many_models, "BLOCK", 4)
    monkeypatch.setattr(many_models, "VALUES", 10)
    assert np.allclose(many_models.fit_many(rows, SPECS[:2], 6).points, whole, atol=1e-6)


def test_grid_agrees_with_single_fits(spark, data):
    x, y, _ = data
    made = [(i, float(b), Vectors.dense(a)) for i, (a, b) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(made, ["doc_id", "label", "features"])
    train, test = df.where("doc_id % 5 <> 0"), df.where("doc_id % 5 = 0")
    best, table = classify.grid(train, test, (0.01, 1.0), "test")
    from lexloom.operators.evaluate import log_loss

    for r in table.collect():
        model = classify.logistic_regression(train, r.c)
        want = log_loss(classify.scores(model, test).withColumn("actual", F.col("label"))).head()[0]
        assert abs(r.score - want) < 1e-3
    assert best == min(table.collect(), key=lambda r: r.score).c
    best, table = classify.grid(train, test, (0.01, 1.0), "cv", folds=3)
    assert best == 1.0 and table.count() == 2
    with pytest.raises(ValueError):
        classify.grid(train, test, (1.0,), "other")


def test_models_that_are_done_are_scanned_no_more(rows, monkeypatch):
    widths, scan = [], many_models.scan

    def counted(rows, points, *args, **named):
        widths.append(points.shape[1])
        return scan(rows, points, *args, **named)

    monkeypatch.setattr(many_models, "scan", counted)
    many_models.fit_many(rows, SPECS, 6)
    assert widths[0] == 3 and widths[-1] < 3 and widths == sorted(widths, reverse=True)
