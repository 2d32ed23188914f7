"""Token counts of whole texts without encoding them whole: two tiers of lookups on the map side, and no shuffle of pre-tokens.

A pre-token is what follows one blank, up to the next (`pieces`). The most frequent pre-tokens of a sample and their
numbers of tokens are broadcast as a compact table: two Arrow buffers of words and an array of numbers, at most
`ENTRIES` entries, which Arrow hashes for the lookup of a slice's distinct pre-tokens. What misses is looked up in the
worker's cache (two bounded generations), and only what is new there is encoded by the library, a slice's misses at
once. The sample decides how fast counts are made, never what they are.

The sample is read by one pass over the texts in which the JVM drops all rows but some `SAMPLE` of them; every task
counts in a table of bounded size. Vocabularies of the `tokenizers` library have a worker cache of their own (`tokenise`).

Defined cases: a null or empty text has no bytes and no tokens; a text of any length is counted whole; repeated rows
are counted each, with equal results; an empty table gives an empty result; other columns are ignored, whatever their
names; a null doc_id stays null.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, slices, worker_keeps
from .pieces import LONGEST, SLICE_BYTES, Cut, PieceEncoder
from .tokenise import encoder, vocabulary_path

VOCABULARY, LIMIT = "piece_bpe_32k.model", 4096
#: Documents of the sample (expected), tasks that count it, and entries of the broadcast table.
SAMPLE, TASKS, ENTRIES = 20_000, 8, 65_536


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pre-tokens that occur most in a task's rows, with their counts. The table is cut back when it has four times the entries."""
    seen: Counter[str] = Counter()
    for batch in slices(batches, limit=SLICE_BYTES):
        cut = Cut(pc.fill_null(batch.column(0), ""))
        short = pc.less_equal(pc.utf8_length(cut.distinct), LONGEST).to_numpy(zero_copy_only=False)
        counts = np.bincount(cut.place, minlength=len(cut.distinct))
        at = np.flatnonzero(short & (counts > 0))
        seen.update(dict(zip(cut.distinct.take(pa.array(at)).to_pylist(), counts[at].tolist(), strict=True)))
        if len(seen) > 4 * ENTRIES:
            seen = Counter(dict(seen.most_common(2 * ENTRIES)))
    top = seen.most_common(ENTRIES)
    yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], names=["part", "n"])


class Lengths:
    """Numbers of tokens of frequent pre-tokens: `words` and `sizes`, in the same order."""

    def __init__(self, words: pa.StringArray, sizes: np.ndarray):
        self.words, self.sizes = words, sizes

    def of(self, parts: pa.StringArray) -> np.ndarray:
        """The number of each part, or -1."""
        at = pc.fill_null(pc.index_in(parts, self.words), -1).to_numpy(zero_copy_only=False)
        return np.where(at < 0, -1, np.append(self.sizes, 0)[at])


def frequent_lengths(docs: DataFrame, path: str, sample: int = SAMPLE, entries: int = ENTRIES) -> Lengths:
    """The table of the pre-tokens that are most frequent in a sample of the texts."""
    n = docs.count()
    share = min(1.0, sample / max(n, 1))
    texts = documents(docs, "text")
    picked = (texts.where(F.rand(11) < share) if share < 1 else texts).repartition(TASKS)
    each = picked.mapInArrow(_counted, "part string, n long").toArrow()  # TASKS x ENTRIES rows at most
    summed = each.group_by("part").aggregate([("n", "sum")]).sort_by([("n_sum", "descending"), ("part", "ascending")])
    words = pc.cast(summed["part"], pa.string()).slice(0, entries).combine_chunks()
    sizes = [len(x) for x in PieceEncoder(path).part_ids(words.to_pylist())] if len(words) else []
    return Lengths(words, np.array(sizes, np.uint16))


class PieceCounter(PieceEncoder):
    """Counts a text's tokens by the broadcast table, the worker's cache and the library, in this order."""

    def __init__(self, path: str, frequent: Lengths):
        super().__init__(path)
        self.frequent = frequent

    def counts(self, texts: pa.StringArray) -> np.ndarray:
        """Tokens of each text. No text is null."""
        if not self.cuts:
            return np.fromiter(map(len, self.model.encode(texts.to_pylist(), num_threads=1)), np.int64, len(texts))
        cut = Cut(texts)
        each = self.frequent.of(cut.distinct).astype(np.int64)
        misses = np.flatnonzero(each < 0)
        each[misses] = self.cache.of(cut.distinct.take(pa.array(misses)).to_pylist(), lambda parts: list(map(len, self.part_ids(parts))))
        out = cut.sums(each)
        for i in cut.whole:
            out[i] = len(self.model.encode(texts[i].as_py()))
        return out


def token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row. A `.model` file is a sentencepiece model, others are of the `tokenizers` library."""
    path = path or vocabulary_path(VOCABULARY)
    rows = documents(docs, "doc_id", "text")
    if path.endswith(".model"):
        found = frequent_lengths(docs, path)
        table, name = docs.sparkSession.sparkContext.broadcast((found.words, found.sizes)), uuid.uuid4().hex

        def counts(texts: pa.StringArray) -> np.ndarray:
            return worker_keeps(("counts", name), lambda: PieceCounter(path, Lengths(*table.value))).counts(texts)
    else:

        def counts(texts: pa.StringArray) -> np.ndarray:
            return np.array([len(x) // 2 for x in encoder(path).encode(texts)], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=SLICE_BYTES):
            texts = pc.fill_null(batch.column(1), "")
            yield pa.RecordBatch.from_arrays([batch.column(0), pc.cast(pc.binary_length(texts), pa.int64()), pa.array(counts(texts), pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
