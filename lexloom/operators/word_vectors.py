"""Word vectors from co-occurrences: positive pointwise mutual information, and its singular vectors by random blocks.

Pairs are counted by tasks, from the documents' arrays of words and a vocabulary that is broadcast (at most `most` terms),
and summed and stored by pair in one order; the other order is made when they are read. The matrix of their PPMI is symmetric; it is stored dealt by its rows, of which the largest has an
entry for each term at most. Each product with a block of columns is one job: the block is broadcast, tasks multiply
their rows, and a row of numbers for each term comes back. The driver holds blocks of (terms x (rank + extra)) numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import stored
from .frequencies import slices

#: Words on either side that a word occurs with; terms of the vocabulary; columns of a block beyond the rank; its powers.
WINDOW, MOST, EXTRA, POWERS = 5, 100_000, 10, 3


def cooccurrences(docs: DataFrame, words: str, vocab: DataFrame, window: int = WINDOW, most: int = MOST) -> DataFrame:
    """i, j, n: how often terms i and j stand at most `window` words apart in a document, in either order.

    words: a column of arrays of words, or of `frequencies.packed` words. vocab: term_id, gram. Words that are no terms keep their places but count for nothing; a word occurs with another
    place of the same word, too. Null arrays have no words.
    """
    known = vocab.where(F.col("term_id") < most).select("term_id", "gram").toArrow()
    sent = docs.sparkSession.sparkContext.broadcast((known["gram"].combine_chunks(), known["term_id"].to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, ids = sent.value
        for _, grams in slices(batches):
            at = pc.fill_null(pc.index_in(grams.words, terms), -1).to_numpy(zero_copy_only=False)
            term = np.where(at < 0, -1, np.append(ids, -1)[at]).astype(np.int64)[grams.codes]
            doc, found = grams.doc, []
            for d in range(1, window + 1):
                ok = (doc[:-d] == doc[d:]) & (term[:-d] >= 0) & (term[d:] >= 0)
                a, b = term[:-d][ok], term[d:][ok]
                found.append(np.minimum(a, b) * most + np.maximum(a, b))
            pairs, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n.astype(np.int64))], names=["pair", "n"])

    counted = stored(docs.select(words).mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "pair-counts")
    once, n = counted.select(F.expr(f"pair div {most}").alias("i"), (F.col("pair") % most).alias("j"), "n"), F.col("n")
    same = F.col("i") == F.col("j")
    orders = F.when(same, F.array(F.struct("i", "j", (n * 2).alias("n")))).otherwise(F.array(F.struct("i", "j", "n"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"), "n")))
    return once.select(F.inline(orders))


def ppmi(counts: DataFrame) -> DataFrame:
    """i, j, n, value: ln(n x all / (n of i x n of j)) of the pairs for which it is positive.

    counts: i, j, n with each pair in both orders, read twice. The terms' sums, as few as the vocabulary's terms, are broadcast.
    """
    sums = stored(counts.groupBy("i").agg(F.sum("n").alias("s")), "pair-sums")
    whole = sums.agg(F.sum("s").alias("whole"))
    both = counts.join(F.broadcast(sums), "i").join(F.broadcast(sums.select(F.col("i").alias("j"), F.col("s").alias("t"))), "j").join(F.broadcast(whole))
    value = F.log(F.col("n") * F.col("whole") / F.col("s") / F.col("t"))
    return both.select("i", "j", "n", value.alias("value")).where(F.col("value") > 0)


def _times(matrix: DataFrame, block: np.ndarray) -> np.ndarray:
    """The matrix (i, j, value; all of an i in one task) times a block of columns."""
    sent = matrix.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b, rows = sent.value, {}
        for batch in batches:
            i, j, v = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            for at in range(0, len(i), 50_000):
                part = slice(at, at + 50_000)
                own, place = np.unique(i[part], return_inverse=True)
                order = np.argsort(place, kind="stable")
                starts = np.searchsorted(place[order], np.arange(len(own)))
                sums = np.add.reduceat(b[j[part][order]] * v[part][order][:, None], starts, axis=0)
                for k, x in zip(own.tolist(), sums, strict=True):
                    rows[k] = rows[k] + x if k in rows else x
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.int64()), pa.array([x.tolist() for x in rows.values()], pa.list_(pa.float64()))], names=["i", "x"])

    out = np.zeros(block.shape)
    got = matrix.mapInArrow(run, "i long, x array<double>").toArrow()  # a row for each term
    if got.num_rows:
        out[got["i"].to_numpy()] = np.stack(got["x"].to_numpy(zero_copy_only=False))
    return out


def symmetric_svd(matrix: DataFrame, n: int, rank: int, extra: int = EXTRA, powers: int = POWERS, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(vectors, singular values): the leading singular vectors (a column each) of a symmetric n x n matrix of i, j, value rows.

    A random block is multiplied by the matrix and made orthogonal, `powers` times more, so that it spans the leading
    vectors; what the matrix does within that span is small enough for the driver.
    """
    dealt = stored(matrix.select("i", "j", "value").repartition("i"), "matrix").persist()
    width = min(n, rank + extra)
    try:
        block = np.linalg.qr(_times(dealt, np.random.default_rng(seed).normal(size=(n, width))))[0]
        for _ in range(powers):
            block = np.linalg.qr(_times(dealt, block))[0]
        u, s, _ = np.linalg.svd(_times(dealt, block), full_matrices=False)
    finally:
        dealt.unpersist()
    return u[:, :rank], s[:rank]


def word_vectors(docs: DataFrame, words: str, vocab: DataFrame, rank: int = 100, window: int = WINDOW, most: int = MOST) -> DataFrame:
    """gram, vector: the terms' singular vectors, weighted by the roots of the singular values. A term without pairs has zeros."""
    n = min(most, vocab.count())
    if not n:
        return vocab.select("gram", F.array().cast("array<double>").alias("vector"))
    u, s = symmetric_svd(ppmi(cooccurrences(docs, words, vocab, window, most)), n, min(rank, n))
    rows = pa.table({"term_id": pa.array(np.arange(n), pa.int64()), "vector": pa.array((u * np.sqrt(s)).tolist(), pa.list_(pa.float64()))})
    return docs.sparkSession.createDataFrame(rows).join(vocab.select("term_id", "gram"), "term_id").select("gram", "vector")
