"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are the distinct hashes of its words, word pairs and pairs with one word between, lower-case letters
and digits only. Training follows labelled documents one by one: each coordinate has its own learning rate, and the L1
term leaves most weights at zero, so that the few others make a compact broadcast (at most `2**BITS` of them).

The model learns from at most `SAMPLE` labelled documents of either class, those of least id hash, and of these as many
as have `SAMPLE_BYTES` of feature hashes together; these are the documented bounds of the classifier's sample. Their
whole texts' feature hashes, not their texts, come to the driver. Scores cover every whole text.

Defined cases: null and empty texts have no features and get the score of the bias; labels without a document and
documents without a label are left out of training; of several labels the largest counts; without any label of either
class all scores are 0; repeated rows get equal scores; other columns of the input are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Bounded, documents, mapped_rows, stored, text_chunks, worker_keeps

#: Bits of a feature hash, passes over the sample, words whose hashes a worker keeps.
BITS, PASSES, KEPT_WORDS = 20, 5, 300_000
#: Most documents of label 1 and of label 0 that are learned from.
SAMPLE = (3_000, 6_000)
#: Most bytes of feature hashes (4 each) that come to the driver.
SAMPLE_BYTES = 128_000_000
#: FTRL-proximal: learning rate, its offset, L1 and L2 terms. Value of a pair's feature; a word's is 1.
ALPHA, BETA, L1, L2, PAIR = 3.0, 1.0, 3.0, 0.01, 0.25
_WORD = re.compile(r"[^\W_]+")


def _words() -> Bounded:
    """Hashes of words by word, bounded, in a Python worker."""
    return worker_keeps("toxicity", lambda: Bounded(lambda w: xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")), KEPT_WORDS))


def feature_hashes(text: str | None, bits: int = BITS) -> np.ndarray:
    """Distinct hashes of a text's words (lower half of the range), pairs of neighbours and pairs with one word between."""
    words = _WORD.findall((text or "").lower())
    h = np.fromiter(map(_words().__getitem__, words), np.uint64, len(words))
    pair = lambda a, b, kind: (a * np.uint64(0x9E3779B97F4A7C15) ^ b) * np.uint64(kind)
    pairs = np.concatenate([pair(h[:-1], h[1:], 0xC2B2AE3D27D4EB4F), pair(h[:-2], h[2:], 0x165667B19E3779F9)])
    half = np.uint64(1 << (bits - 1))
    fold = lambda x: np.unique((x >> np.uint64(65 - bits)).astype(np.uint32))
    return np.concatenate([fold(h), fold(pairs) + np.uint32(half)])


@dataclass
class Model:
    """Non-zero weights of a trained model."""

    index: np.ndarray
    weight: np.ndarray
    bias: float
    bits: int = BITS

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << self.bits)
        out[self.index] = self.weight
        return out


def train(rows: list[tuple[np.ndarray, int]], bits: int = BITS, passes: int = PASSES, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2) -> Model | None:
    """FTRL-proximal over the rows (features, label) in their order, again and again; the last coordinate is the bias."""
    if len({y for _, y in rows}) < 2:
        return None
    z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
    penalty = np.full((1 << bits) + 1, l1)
    penalty[-1] = 0.0

    def weights(at) -> np.ndarray:
        over = np.abs(z[at]) - penalty[at]
        return np.where(over > 0, -np.sign(z[at]) * over / ((beta + np.sqrt(n[at])) / alpha + l2), 0.0)

    size = np.ones((1 << bits) + 1)
    size[1 << (bits - 1) : -1] = PAIR
    last = slice(1 << bits, None)  # the bias, apart from the features, so that these are never copied
    for _ in range(passes):
        for x, y in rows:
            w, bias = weights(x), weights(last)
            error = 1.0 / (1.0 + np.exp(-np.clip((w * size[x]).sum() + bias[0], -35, 35))) - y
            for at, own, g in ((x, w, error * size[x]), (last, bias, np.array([error]))):
                step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
                z[at] += g - step * own
                n[at] += g * g
    w = weights(slice(None)) * size
    index = np.flatnonzero(w[:-1])
    return Model(index, w[index], float(w[-1]), bits)


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from training: crc32 of its id as text is divisible by 5."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def _digest(features: pa.BinaryScalar) -> int:
    return xxhash.xxh3_64_intdigest(features.as_buffer())


def learn(docs: DataFrame, labels: DataFrame, sample: tuple[int, int] = SAMPLE, bits: int = BITS) -> Model | None:
    """A model from the labelled rows that are not held out. labels: doc_id, toxic."""
    known = labels.select("doc_id", "toxic").where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).withColumn("order", F.xxhash64("doc_id"))
    first = lambda of, most: known.where(of).orderBy("order", "doc_id").limit(most)
    chosen = stored(first(F.col("toxic") > 0, sample[0]).unionByName(first(F.col("toxic") <= 0, sample[1])), "toxicity-sample")
    # At most the sample's bound of rows of three numbers.
    found = documents(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "order", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([feature_hashes(t, bits).tobytes() for t in texts], pa.binary())], names=["doc_id", "toxic", "order", "features"])

    made = stored(found.mapInArrow(run, "doc_id long, toxic int, order long, features binary"), "toxicity-features")
    last, size = None, 0
    for r in made.groupBy("order").agg(F.sum(F.length("features")).alias("size")).orderBy("order").collect():  # a row for each document of the sample
        size += r["size"]
        if size > SAMPLE_BYTES and last is not None:
            break
        last = r["order"]
    if last is None:
        return None
    found = made.where(F.col("order") <= last).toArrow().combine_chunks()
    features = found["features"].cast(pa.binary()).combine_chunks()
    features = features.chunk(0) if isinstance(features, pa.ChunkedArray) else features
    ends = np.frombuffer(features.buffers()[1], np.int32)[features.offset :][: len(features) + 1] // 4
    data = np.frombuffer(features.buffers()[2] or b"", np.uint32)
    keys = sorted(zip(found["order"].to_pylist(), found["doc_id"].to_pylist(), map(_digest, features), range(len(features)), strict=True))
    toxic = found["toxic"].to_pylist()
    return train([(data[ends[i] : ends[i + 1]], int(toxic[i] > 0)) for *_, i in keys], bits)  # views, no copies


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, score, predicted of every text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    state: dict = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches):
            known = shared.value
            if known is None:
                values = np.zeros(len(texts))
            else:
                dense = state.setdefault("dense", known.dense())
                sums = np.array([dense[feature_hashes(t, known.bits)].sum() for t in texts]) + known.bias
                values = 1.0 / (1.0 + np.exp(-np.clip(sums, -35, 35)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values), pa.array((values >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    plain = documents(docs, "doc_id", "text").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return plain.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame, sample: tuple[int, int] = SAMPLE) -> DataFrame:
    return score(docs, learn(docs, labels, sample))


def not_toxic(docs: DataFrame, labels: DataFrame, sample: tuple[int, int] = SAMPLE) -> DataFrame:
    """The documents, with all their columns, that a model learned from them does not reject."""
    model = learn(docs, labels, sample)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    state: dict = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches):
            known = shared.value
            if known is not None:
                dense = state.setdefault("dense", known.dense())
                batch = batch.filter(pa.array([dense[feature_hashes(t, known.bits)].sum() + known.bias < 0 for t in texts]))
            yield batch

    return mapped_rows(docs, run)
