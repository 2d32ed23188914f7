"""Training a topic classifier and scoring a corpus with it, as whole jobs."""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.analyzer import gram_words
from ..operators import classify, evaluate, frequencies, split, vectorize
from ..sources.shared import stored

#: The categories that can be typed.
TARGETS = ("aeronautics", "arts", "biology", "chemistry", "computer_science", "engineering", "mathematics", "philosophy", "physics")


def target_name(text: str, known: Sequence[str] = TARGETS) -> str:
    """A category as typed, in the form that tables use; an unknown one is an error."""
    name = text.strip().lower().replace(" ", "_")
    if name not in known:
        raise ValueError(f"{text!r} is none of {', '.join(known)}")
    return name


def seed_parts(path: str) -> tuple[str, int]:
    """(category, depth) of a seed file's name, such as `computer_science_d5.csv`."""
    stem = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    category, _, depth = stem.rpartition("_d")
    if not category or not depth.isdigit():
        raise ValueError(f"{path!r} names no category and depth")
    return category, int(depth)


@dataclass
class Classifier:
    """Vocabulary and model of one target."""

    target: str
    vocab: DataFrame
    model: LogisticRegressionModel
    size: int
    n_grams: int
    key: str = "doc_id"
    text: str = "text"

    def features(self, docs: DataFrame) -> DataFrame:
        words = docs.withColumn("_words", gram_words(F.col(self.text), stemmed=False))
        return frequencies.term_vectors(words, "_words", self.vocab, self.size, stemmed=True)

    def scored(self, docs: DataFrame) -> DataFrame:
        """docs with predicted; a document without a known term scores 0. Rows that `fit_with_features` made keep their features."""
        made = {"features", "n_terms"} <= set(docs.columns)
        rows = classify.scores(self.model, docs if made else self.features(docs))
        return rows.withColumn("predicted", F.when(F.col("n_terms") > 0, F.col("predicted")).otherwise(F.lit(0.0))).drop("features", "n_terms")

    def predictions(self, docs: DataFrame, threshold: float, title: str = "title") -> DataFrame:
        """title, prediction of documents at or above the threshold, and of those without a known term (0)."""
        rows = self.scored(docs)
        return rows.where((F.col("predicted") == 0.0) | evaluate.over(threshold, inclusive=True)).select(title, F.col("predicted").alias("prediction"))


    def save(self, path: str) -> None:
        """Vocabulary, model and settings below a path, which must be new."""
        spark = self.vocab.sparkSession
        self.vocab.write.parquet(f"{path}/vocabulary")
        self.model.write().save(f"{path}/model")
        settings = [(self.target, self.size, self.n_grams, self.key, self.text)]
        spark.createDataFrame(settings, _SETTINGS).coalesce(1).write.json(f"{path}/settings")


_SETTINGS = "target string, size int, n_grams int, key string, text string"


def load(spark: SparkSession, path: str) -> Classifier:
    """A classifier that was saved. Without one there, this raises."""
    s = spark.read.schema(_SETTINGS).json(f"{path}/settings").head()
    vocab = spark.read.parquet(f"{path}/vocabulary")
    return Classifier(s["target"], vocab, LogisticRegressionModel.load(f"{path}/model"), s["size"], s["n_grams"], s["key"], s["text"])


def _featured(rows: DataFrame, own: Column, text: str, n_grams: int, no_below: int, size: int, *keys: str) -> tuple[DataFrame, DataFrame]:
    """(the vocabulary of the rows that are `own`, stored: the keys, features and n_terms of every row).

    Each text is stemmed once: the own ones before the vocabulary is made, and packed; the others when vectors are made.
    """
    names = ["`" + k.replace("`", "``") + "`" for k in keys]
    words = lambda part: part.select(*names, gram_words(F.col(text), stemmed=False).alias("_words"))
    first = frequencies.packed(words(rows.where(own)), "_words", *keys, stemmed=True)
    n_docs = first.agg(F.sum(F.size(names[0]))).head()[0] or 0
    vocab = stored(frequencies.pruned_vocabulary(first, "_words", n_docs, n_grams, no_below, keep=size), "vocabulary")
    vectors = [frequencies.term_vectors(x, "_words", vocab, size, stemmed=True) for x in (first, words(rows.where(~own)))]
    return vocab, stored(vectors[0].union(vectors[1]), "features")


def fit_with_features(docs: DataFrame, target: str, c: float, *keys: str, size: int = vectorize.KEEP, n_grams: int = 3, label: str = "target", key: str = "doc_id", text: str = "text", no_below: int = vectorize.NO_BELOW) -> tuple[Classifier, DataFrame]:
    """(a classifier as of `fit`, the rows it was fitted to: their keys, label, features and n_terms, stored), which score the same documents without their texts."""
    labelled = docs.withColumn("label", split.is_target(F.col(label), target).cast("double"))
    vocab, features = _featured(labelled, F.col("label") == 1, text, n_grams, no_below, size, *dict.fromkeys((*keys, "label")))
    model = classify.logistic_regression(features.select("label", "features"), c)
    return Classifier(target, vocab, model, size, n_grams, key, text), features


def fit(docs: DataFrame, target: str, c: float, size: int = vectorize.KEEP, n_grams: int = 3, label: str = "target", key: str = "doc_id", text: str = "text", no_below: int = vectorize.NO_BELOW) -> Classifier:
    """A classifier whose vocabulary and document frequencies come from the target's own documents."""
    return fit_with_features(docs, target, c, size=size, n_grams=n_grams, label=label, key=key, text=text, no_below=no_below)[0]


@dataclass
class Trained:
    """Result of a training run: grid, best parameter, and, made when first asked for, evaluation rows and the model of all documents."""

    grid: DataFrame
    best: float
    evaluate_best: Callable[[], DataFrame]
    fit_best: Callable[[], Classifier]

    @functools.cached_property
    def evaluation(self) -> DataFrame:
        return self.evaluate_best()

    @functools.cached_property
    def final(self) -> Classifier:
        return self.fit_best()

    def confusion(self) -> DataFrame:
        return evaluate.confusion_sweep(self.evaluation)

    def importance(self) -> DataFrame:
        return evaluate.importance_slices(classify.coefficients(self.final.model, self.final.vocab))


def train(docs: DataFrame, target: str, cs: Sequence[float] = classify.GRID, size: int = vectorize.KEEP, n_grams: int = 3, label: str = "target", key: str = "doc_id", text: str = "text", title: str = "doc_id", selection: str = "test", no_below: int = vectorize.NO_BELOW) -> Trained:
    """Splits 80:20 by label, fits the grid, evaluates the best parameter, and fits it to all documents."""
    rows = split.stratified_split(docs.withColumn("label", split.is_target(F.col(label), target).cast("double")), "label", key)
    own = (F.col("part") == "train") & (F.col("label") == 1)
    _, found = _featured(rows, own, text, n_grams, no_below, size, *dict.fromkeys((key, title, "label", "part")))
    training, test = found.where(F.col("part") == "train"), found.where(F.col("part") == "test")
    best, table = classify.grid(training, test, cs, selection, key=key)

    def evaluation() -> DataFrame:
        scored = classify.scores(classify.logistic_regression(training, best), test)
        return scored.select(F.col(title).cast("string").alias("title"), F.col("label").alias("actual"), "predicted")

    return Trained(table, best, evaluation, lambda: fit(docs, target, best, size, n_grams, label, key, text, no_below))
