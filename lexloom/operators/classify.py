"""Classifiers of TF-IDF documents: multinomial naive Bayes in closed form, and L2 logistic regression."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import stored
from . import many_models
from .evaluate import best_parameter

#: Inverse regularisation strengths of the grid.
GRID = (0.01, 0.05, 0.1, 0.5, 1.0, 2.0, 4.0, 6.0, 8.0)

#: Largest number of a gradient at which a model of the grid is done; its losses are then right to far more digits.
TOLERANCE = 1e-6


def naive_bayes(weights: DataFrame, labels: DataFrame, vocab: DataFrame, key: str, alpha: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(label, log_prior; label, term_id, log_likelihood): unsmoothed priors, likelihoods smoothed by alpha over the vocabulary.

    Weights that hold their document's label are not joined with the labels.
    """
    n = labels.agg(F.count(F.lit(1)).alias("n"))
    priors = labels.groupBy("label").agg(F.count(F.lit(1)).alias("k")).join(F.broadcast(n)).select("label", F.log(F.col("k") / F.col("n")).alias("log_prior"))
    labelled = weights.where(F.col(key).isNotNull()) if "label" in weights.columns else weights.join(labels, key)
    mass = stored(labelled.groupBy("label", "term_id").agg(F.sum("weight").alias("w")), "mass")
    totals = mass.groupBy("label").agg(F.sum("w").alias("total"))
    size = vocab.agg(F.count(F.lit(1)).alias("v"))
    every = priors.select("label").join(F.broadcast(vocab.select("term_id")))
    likelihoods = every.join(mass, ["label", "term_id"], "left").join(F.broadcast(totals), "label", "left").join(F.broadcast(size))
    value = F.log((F.coalesce("w", F.lit(0.0)) + alpha) / (F.coalesce("total", F.lit(0.0)) + alpha * F.col("v")))
    return priors, likelihoods.select("label", "term_id", value.alias("log_likelihood"))


def naive_bayes_scores(weights: DataFrame, docs: DataFrame, priors: DataFrame, likelihoods: DataFrame, key: str) -> DataFrame:
    """key, predicted: probability of label 1 for every document, also for those without a known term.

    The likelihoods, a row for each label and term of the vocabulary, are broadcast.
    """
    each = weights.select(key, "term_id", "weight").join(F.broadcast(likelihoods), "term_id").groupBy(key, "label").agg(F.sum(F.col("weight") * F.col("log_likelihood")).alias("s"))
    joint = docs.select(key).join(F.broadcast(priors)).join(each, [key, "label"], "left").withColumn("s", F.col("log_prior") + F.coalesce("s", F.lit(0.0)))
    of = lambda y: F.max(F.when(F.col("label") == y, F.col("s")))
    return joint.groupBy(key).agg((F.lit(1.0) / (F.lit(1.0) + F.exp(of(0) - of(1)))).alias("predicted"))


def logistic_regression(train: DataFrame, c: float, iterations: int = 100) -> LogisticRegressionModel:
    """A model of `features` and `label` at inverse regularisation c: c x summed loss + half the squared weights."""
    n = train.count()
    return LogisticRegression(elasticNetParam=0.0, regParam=1.0 / (c * n), standardization=False, maxIter=iterations, tol=1e-6).fit(train)


def scores(model: LogisticRegressionModel, rows: DataFrame) -> DataFrame:
    """rows with `predicted`, the probability of label 1."""
    return model.transform(rows).withColumn("predicted", vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")


def grid(train: DataFrame, test: DataFrame, cs: Sequence[float] = GRID, selection: str = "test", folds: int = 5, key: str = "doc_id") -> tuple[float, DataFrame]:
    """(best c, table of c and score): least log loss on the test rows, or the mean over folds of the training rows.

    All values of c, and all folds, are trained together: each iteration scans the rows once.
    """
    from .split import k_folds

    if selection not in ("test", "cv"):
        raise ValueError("selection is 'test' or 'cv'")
    spark, cs = train.sparkSession, [float(c) for c in cs]
    first = train.select("features").head()
    n_terms = first["features"].size if first else 0
    whole = F.lit(-2).alias("fold")
    if selection == "cv":
        rows = many_models.sparse_rows(k_folds(train, "label", key, folds), "fold")
        specs = [many_models.Spec(c, k) for c in cs for k in range(folds)]
    else:
        rows, specs = many_models.sparse_rows(train, whole), [many_models.Spec(c) for c in cs]
    rows = stored(rows, "grid-rows")
    points = many_models.fit_many(rows, specs, n_terms, tolerance=TOLERANCE).points
    if selection == "cv":
        scores = many_models.log_losses(rows, points, np.array([s.without for s in specs])).reshape(len(cs), folds).mean(1)
    else:
        scores = many_models.log_losses(many_models.sparse_rows(test, whole), points)
    table = spark.createDataFrame(list(zip(cs, map(float, scores), strict=True)), "c double, score double")
    return best_parameter(table).head()["c"], table


def coefficients(model: LogisticRegressionModel, vocab: DataFrame) -> DataFrame:
    """term, coef of every term of the vocabulary."""
    values = [(i, float(x)) for i, x in enumerate(model.coefficients.toArray())]
    return vocab.sparkSession.createDataFrame(values, "term_id int, coef double").join(vocab, "term_id").select(F.col("gram").alias("term"), "coef")


def lasso_terms(rows: DataFrame, vocab: DataFrame, c: float, tolerance: float = 1e-6) -> DataFrame:
    """term, coef, zeroed: the coefficients of an L1 model of `features` and `label`, and whether it left the term out."""
    held = many_models.sparse_rows(rows, F.lit(-2).alias("fold"))
    fitted = many_models.fit_l1(held, [many_models.Spec(c)], vocab.count(), tolerance=tolerance)
    values = [(i, float(x)) for i, x in enumerate(fitted.points[:-1, 0])]
    return vocab.sparkSession.createDataFrame(values, "term_id int, coef double").join(vocab, "term_id").select(F.col("gram").alias("term"), "coef", (F.col("coef") == 0).alias("zeroed"))
