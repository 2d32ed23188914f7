"""Alignment of two tokenizers' tokens by the bytes at which they end.

Both tokenizers' ids of a blank and the text stand for the same bytes. Every byte gets a letter: none, a token of A
ends here, one of B, or both. An expression scans the string of letters for spans up to each `both`; the letters in a
span say how many tokens of A and of B its group has. A group's last tokens end together: they are its link.

How often a pair of ids is linked is counted over the whole corpus: each task counts its links, and the counts are
summed by pair. Links are looked up in two tiers: the most frequent pairs (at most `FREQUENT`, whatever the corpus) are
broadcast as sorted arrays; other links are joined with the counts, and since such pairs are infrequent, none is a hot
key. So neither texts nor frequent links are shuffled, and texts are encoded once: a table in the shared folder keeps
four bytes for each link.

Defined cases: texts that are null or empty, and those whose tokens do not stand for the text's own bytes (as of a text
that has the mark which stands for a blank), have no tokens: zeros, and an empty digest. Repeated rows count each. A
null doc_id stays null. A text of any length is aligned whole. An empty table gives an empty result; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, documents, slices, stored, worker_keeps
from .pieces import BLANK, PieceEncoder
from .tokenise import WordwiseEncoder, byte_characters, vocabulary_path

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Letters of the label string, by 1 for an end of A and 2 for an end of B.
LABELS = np.frombuffer(b"NABC", np.uint8)
#: Pairs of the broadcast tier; links that a task counts at once.
FREQUENT, COUNTED = 250_000, 1_000_000
_DIGITS = 5


def bytes_of_a(encoder: WordwiseEncoder) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary."""
    back = {c: b for b, c in byte_characters().items()}
    words = encoder.library.get_vocab(with_added_tokens=True)
    out = [b""] * (max(words.values()) + 1)
    for word, i in words.items():
        out[i] = bytes(back[c] for c in word) if all(c in back for c in word) else word.encode()
    return out


def bytes_of_b(encoder: PieceEncoder) -> list[bytes]:
    """The bytes of each id of a sentencepiece model."""
    m = encoder.model
    return [bytes([int(m.id_to_piece(i)[3:5], 16)]) if m.is_byte(i) else m.id_to_piece(i).replace(BLANK, " ").encode() for i in range(m.get_piece_size())]


def label_string(n: int, ends_a: np.ndarray, ends_b: np.ndarray) -> bytes:
    """A letter for each of n bytes: N none, A or B if a token of that tokenizer ends with it, C if tokens of both do."""
    at = np.zeros(n, np.uint8)
    at[ends_a - 1] += 1
    at[ends_b - 1] += 2
    return LABELS[at].tobytes()


def scanned(labels: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of A and B tokens of each group: of each span of the label string up to a `C`."""
    spans = pc.split_pattern_regex(pa.array([labels.decode()]), "C").flatten()[:-1]
    counts = lambda c: pc.count_substring(spans, c).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    return counts("A"), counts("B")


def _written(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, last: np.ndarray) -> tuple[bytes, np.ndarray]:
    """(the groups' ids as `a1,a2|b1;a3|b2,b3`, without a mark behind the groups numbered `last`; each group's end in it)."""
    sizes = n_a + n_b
    ends = np.cumsum(sizes)
    ids, is_a = np.empty(int(sizes.sum()), np.int64), np.zeros(int(sizes.sum()), bool)
    is_a[np.repeat(ends - sizes, n_a) + np.arange(len(a)) - np.repeat(np.cumsum(n_a) - n_a, n_a)] = True
    ids[is_a], ids[~is_a] = a, b
    marks = np.full(len(ids), ord(","), np.uint8)
    marks[ends - sizes + n_a - 1] = ord("|")
    marks[ends - 1] = ord(";")
    cells = np.empty((len(ids), _DIGITS + 1), np.uint8)
    for k in range(_DIGITS):
        cells[:, k] = ids // 10 ** (_DIGITS - 1 - k) % 10 + 48
    cells[:, _DIGITS] = marks
    kept = np.ones(cells.shape, bool)
    for k in range(_DIGITS - 1):
        kept[:, k] = ids >= 10 ** (_DIGITS - 1 - k)
    kept[ends[last] - 1, _DIGITS] = False
    return cells[kept].tobytes(), np.cumsum(kept.sum(1))[ends - 1]


class Words:
    """The bytes of a vocabulary's ids, one after the other, and their numbers."""

    def __init__(self, words: list[bytes]):
        self.data = np.frombuffer(b"".join(words), np.uint8)
        self.sizes = np.fromiter(map(len, words), np.int64, len(words))
        self.starts = (np.cumsum(self.sizes) - self.sizes).astype(np.int32)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        """The bytes for which ids stand."""
        n = self.sizes[ids]
        ends = np.cumsum(n)
        if not len(ends):
            return self.data[:0]
        return self.data[np.repeat(self.starts[ids] - (ends - n).astype(np.int32), n) + np.arange(ends[-1], dtype=np.int32)]


class Aligner:
    """Aligns texts; `groups` gives what the corpus-wide counts need, too."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = WordwiseEncoder(path_a), PieceEncoder(path_b)
        self.words_a, self.words_b = Words(bytes_of_a(self.a)), Words(bytes_of_b(self.b))
        if max(len(self.words_a.sizes), len(self.words_b.sizes)) > 10**_DIGITS:
            raise ValueError("ids of these vocabularies have too many digits")

    def align(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str], list[bytes]]:
        """n_a, n_b, n_groups, groups as text, and links (an unsigned number of A's id and, above 16 bits, B's) of each text; null is empty."""
        n = len(texts)
        texts = pc.fill_null(texts, "")
        filled = pc.not_equal(texts, "")
        spaced = pc.if_else(filled, pc.binary_join_element_wise("", texts, " "), "")
        each_a = self.a.encode(spaced)
        ids_a, count_a = np.frombuffer(b"".join(each_a), np.uint16), np.fromiter(map(len, each_a), np.int64, n) // 2
        ids_b, count_b = self.b.ids(texts)
        right = filled.to_numpy(zero_copy_only=False) & self._right(spaced, self.words_a, ids_a, count_a) & self._right(spaced, self.words_b, ids_b, count_b)
        ids_a, ids_b = ids_a[np.repeat(right, count_a)], ids_b[np.repeat(right, count_b)]
        count_a, count_b = count_a * right, count_b * right
        ends_a, ends_b = np.cumsum(self.words_a.sizes[ids_a]), np.cumsum(self.words_b.sizes[ids_b])
        if not len(ends_a):
            return count_a, count_b, count_a, [""] * n, [b""] * n
        n_a, n_b = scanned(label_string(int(ends_a[-1]), ends_a, ends_b))
        # A text's last tokens of A and B end together, so no group reaches over texts.
        upto = np.searchsorted(np.cumsum(n_a), np.cumsum(count_a), side="right")
        first = np.append(0, upto[:-1])
        line, ends = _written(ids_a, ids_b, n_a, n_b, upto[upto > first] - 1)
        at = np.append(0, ends)
        links = ids_a[np.cumsum(n_a) - 1].astype(np.uint32) | ids_b[np.cumsum(n_b) - 1].astype(np.uint32) << 16
        groups = [line[at[i] : at[j]].decode() for i, j in zip(first.tolist(), upto.tolist(), strict=True)]
        return count_a, count_b, upto - first, groups, [links[i:j].tobytes() for i, j in zip(first.tolist(), upto.tolist(), strict=True)]

    @staticmethod
    def _right(spaced: pa.StringArray, words: Words, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """True for texts whose ids stand for their bytes."""
        own = np.frombuffer(spaced.buffers()[2] or b"", np.uint8)
        offsets = np.frombuffer(spaced.buffers()[1], np.int32)[spaced.offset : spaced.offset + len(spaced) + 1]
        own, made = own[offsets[0] : offsets[-1]], words.joined(ids)
        if len(own) == len(made) and np.array_equal(own, made):
            return np.ones(len(spaced), bool)
        ends, at = np.append(0, np.cumsum(words.sizes[ids]))[np.append(0, np.cumsum(counts))], offsets - offsets[0]
        return np.array([np.array_equal(own[at[i] : at[i + 1]], made[ends[i] : ends[i + 1]]) for i in range(len(spaced))], bool)


def aligned(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, groups (`a1,a2|b1;a3|b2,b3`), links (four bytes each) of every row."""
    paths = path_a or vocabulary_path(A), path_b or vocabulary_path(B)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=2 * CHUNK_BYTES):
            aligner = worker_keeps(("aligner", *paths), lambda: Aligner(*paths))
            n_a, n_b, n_groups, groups, links = aligner.align(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (n_a, n_b, n_groups)), pa.array(groups, pa.string()), pa.array(links, pa.binary())], names=["doc_id", "n_a", "n_b", "n_groups", "groups", "links"])

    return documents(docs, "doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_a long, n_b long, n_groups long, groups string, links binary")


def pair_counts(rows: DataFrame) -> DataFrame:
    """pair, n, best: how many links of all rows hold a pair of ids, and whether that is the most of its B id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "links", 4 * COUNTED):
            pairs, n = np.unique(np.frombuffer(b"".join(x or b"" for x in batch.column(0).to_pylist()), np.uint32), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pairs.astype(np.int64)), pa.array(n.astype(np.int64))], names=["pair", "n"])

    summed = stored(rows.select("links").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "pair-counts")
    b_id = F.shiftright("pair", 16)
    most = summed.groupBy(b_id.alias("b")).agg(F.max("n").alias("most"))  # a row for each id of B's vocabulary at most
    return summed.join(F.broadcast(most), b_id == F.col("b")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _least_frequent(counts: DataFrame, most: int) -> int:
    """The least count from which on there are at most `most` pairs."""
    upto = counts.groupBy("n").agg(F.count(F.lit(1)).alias("pairs")).withColumn("upto", F.sum("pairs").over(Window.orderBy(F.desc("n"))))
    return upto.where(F.col("upto") <= most).agg(F.coalesce(F.min("n"), F.lit(2**62))).head()[0]


def link_sums(rows: DataFrame, counts: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """Rows of `aligned` with n_best and count_sum, and without groups and links. `row` tells rows apart.

    counts: what `pair_counts` gives for these rows.
    """
    counts = stored(counts, "pair-counts")
    least = _least_frequent(counts, frequent)
    top = counts.where(F.col("n") >= least).toArrow().sort_by("pair")  # at most `frequent` rows
    tier = rows.sparkSession.sparkContext.broadcast(tuple(top[c].to_numpy() for c in ("pair", "n", "best")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n, best = tier.value
        for batch in slices(batches, "links", 4 * COUNTED):
            links = batch.column("links").to_pylist()
            size = np.fromiter(map(len, links), np.int64, len(links)) // 4
            own = np.frombuffer(b"".join(links), np.uint32).astype(np.int64)
            at = np.searchsorted(pairs, own) if len(pairs) else np.zeros(len(own), np.int64)
            hit = np.append(pairs, -1)[at] == own
            value = lambda x, at=at, hit=hit: np.append(0, np.cumsum(np.where(hit, np.append(x, 0)[at], 0)))
            stop = np.cumsum(size)
            sums = [(v := value(x.astype(np.int64)))[stop] - v[stop - size] for x in (best, n)]
            misses = np.append(0, np.cumsum(~hit))
            rest = pa.ListArray.from_arrays(pa.array(np.append(0, misses[stop]), pa.int32()), pa.array(own[~hit]))
            kept = [batch.column(c) for c in ("row", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256")]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(s) for s in sums), rest], names=["row", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "best_hits", "sum_hits", "misses"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    first = stored(rows.mapInArrow(run, f"row long, doc_id {kind}, n_a long, n_b long, n_groups long, groups_sha256 string, best_hits long, sum_hits long, misses array<long>"), "link-hits")
    others = first.select("row", F.explode("misses").alias("pair")).groupBy("row", "pair").agg(F.count(F.lit(1)).alias("times"))
    found = others.join(counts.where(F.col("n") < least), "pair").groupBy("row").agg(F.sum(F.col("times") * F.col("best").cast("long")).alias("best_rest"), F.sum(F.col("times") * F.col("n")).alias("sum_rest"))
    both = lambda hits, rest: F.col(hits) + F.coalesce(rest, F.lit(0))
    return first.drop("misses").join(found, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), both("best_hits", "best_rest").alias("n_best"), both("sum_hits", "sum_rest").alias("count_sum"), "groups_sha256")


def alignment(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row."""
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256")
    rows = stored(aligned(docs, path_a, path_b).select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_a", "n_b", "n_groups", digest, "links"), "alignment")
    return link_sums(rows, pair_counts(rows), frequent)
