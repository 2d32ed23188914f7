"""Similarity join of texts by MinHash banding, verified on full n-gram sets.

A text's n-grams are runs of five lower-case words (parts between ASCII white space); a text of one to four words has
one n-gram, all its words. Texts with equal sets make a class; a class is one row from here on, with its number of
documents. Bands and rows come from the target recall at the threshold. Classes are shuffled on band hashes; buckets
with the same members are kept once. A bucket is cut into blocks, and each pair of blocks is verified in one pass of
bounded size on the full sets: no pair is emitted, only each class's number of linked documents and a link to the
least member of its linked group there. A pair of classes that meets in several buckets counts in the first one.
Links are joined to groups by distributed connected components. Joins on what may be hot (a class of many copies, a
large group) read two plain tables, whose skewed partitions adaptive execution splits.

Defined cases: null, empty and blank texts have no n-grams, link to nothing and are groups of their own; repeated rows
are copies of each other and count as links; rows without a doc_id are linked like others, and a null is a group's id
only if no member has an id; different texts that share a doc_id are told apart by their n-grams; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import ceil, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField

from .common import Bounded, documents, mapped_rows, partitions_for, quoted, stored, text_chunks, worker_keeps
from .components import components

#: Words of an n-gram, least Jaccard similarity of a link, share of links at that similarity that banding must find.
WORDS, THRESHOLD, RECALL = 5, 0.8, 0.9999
#: Rows of a band; classes and n-grams of a block (about); hashes of words that a worker keeps.
ROWS, BLOCK, BLOCK_GRAMS, KEPT_WORDS = 6, 256, 2_000_000, 300_000
_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))


def bands_for(threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS) -> int:
    """Least number of bands of `rows` rows at which a pair of just the threshold's similarity meets with probability `recall`."""
    return ceil(log(1 - recall) / log(1 - threshold**rows))


def _mix(x: np.ndarray) -> np.ndarray:
    for m in _MIX:
        x = (x ^ (x >> np.uint64(33))) * m
    return x ^ (x >> np.uint64(33))


def _words() -> Bounded:
    """Hashes of words by word, bounded, in a Python worker."""
    return worker_keeps("ngram_jaccard", lambda: Bounded(xxhash.xxh3_64_intdigest, KEPT_WORDS))


def ngram_hashes(text: str | None, n: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word n-grams."""
    words = (text or "").lower().encode("utf-8", "surrogatepass").split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_words().__getitem__, words), np.uint64, len(words))
    k = min(n, len(words))
    out = np.full(len(h) - k + 1, np.uint64(k))
    for i in range(k):
        out = _mix(out + h[i : len(h) - k + 1 + i])
    return np.unique(out)


def key_of(grams: np.ndarray) -> int | None:
    return xxhash.xxh3_64_intdigest(grams.tobytes()) - 2**63 if len(grams) else None


@lru_cache(maxsize=4)
def _multipliers(count: int) -> np.ndarray:
    return _mix(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def band_hashes(grams: np.ndarray, bands: int, rows: int = ROWS) -> np.ndarray:
    """One 64-bit hash for each band of the set's minima under bands x rows hash functions."""
    times = _multipliers(bands * rows)
    low = np.full(bands * rows, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(grams), 128):
        product = grams[at : at + 128, None] * times[None, :]
        np.minimum(low, product.view(np.uint32)[:, 1::2].min(axis=0), out=low)
    out = np.arange(1, bands + 1, dtype=np.uint64)
    for column in low.reshape(bands, rows).T.astype(np.uint64):
        out = _mix(out * np.uint64(31) + column)
    return out


def signatures(docs: DataFrame, bands: int, rows: int = ROWS, words: int = WORDS) -> DataFrame:
    """doc_id, key (hash of the n-gram set, null without n-grams), size (of that set), bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches):
            keys, sizes, hashes = [], [], []
            for text in texts:
                grams = ngram_hashes(text, words)
                keys.append(key_of(grams))
                sizes.append(len(grams))
                hashes.append(band_hashes(grams, bands, rows).view(np.int64) if len(grams) else None)
            columns = [batch.column(0), pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.array(hashes, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "key", "size", "bands"])

    return documents(docs, "doc_id", "text").mapInArrow(run, "doc_id long, key long, size long, bands array<long>")


def with_keys(docs: DataFrame, name: str, words: int = WORDS) -> DataFrame:
    """The rows of `docs`, all their columns, and a column `name` with the key of their n-gram set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches):
            yield batch.append_column(name, pa.array([key_of(ngram_hashes(t, words)) for t in texts], pa.int64()))

    return mapped_rows(docs, run, StructField(name, LongType()))


def _gram_sets(rows: DataFrame, words: int) -> DataFrame:
    """key, copies, buckets, grams of the classes, from one document of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches):
            grams = [ngram_hashes(t, words).tobytes() for t in texts]
            same = [xxhash.xxh3_64_intdigest(g) - 2**63 == k for g, k in zip(grams, batch.column(0).to_pylist(), strict=True)]  # not another text of the same doc_id
            out = pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(grams, pa.binary())], names=["key", "copies", "buckets", "grams"])
            yield out.filter(pa.array(same))

    return rows.select("key", "copies", "buckets", "text").mapInArrow(run, "key long, copies long, buckets array<struct<bucket: long, size: long>>, grams binary")


def linked_pairs(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Matrix of which of the sets are linked to which."""
    sizes = np.array([len(s) for s in sets])
    values, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = counts > 1
    column = np.cumsum(shared) - 1
    owner = np.repeat(np.arange(len(sets)), sizes)
    keep = shared[inverse]
    owner, column = owner[keep], column[inverse[keep]]
    by = np.argsort(column, kind="stable")
    owner, column, n = owner[by], column[by], len(sets)
    both, width = np.zeros((n, n), np.float64), max(1, min(4_000_000 // n, int(shared.sum())))
    for at in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(column, (at, at + width))
        x = np.zeros((n, width), np.float32)
        x[owner[a:b], column[a:b] - at] = 1
        both += x @ x.T
    out = both >= threshold * (sizes[:, None] + sizes[None, :] - both) - 1e-9
    np.fill_diagonal(out, False)
    return out


def verify_group(bucket: int, i: int, j: int, keys: np.ndarray, copies: np.ndarray, blocks: np.ndarray, buckets: list, sets: list[np.ndarray], threshold: float) -> list[tuple[int, int, int]]:
    """(class, documents linked to it, least class of its linked group) for the pairs of blocks i and j of a bucket."""
    linked = linked_pairs(sets, threshold)
    if i != j:
        linked &= blocks[:, None] != blocks[None, :]
    earlier: dict[int, list[int]] = {}
    for at, own in enumerate(buckets):
        for b in own:
            if b < bucket:
                earlier.setdefault(b, []).append(at)
    for at in earlier.values():
        if len(at) > 1:
            linked[np.ix_(at, at)] = False
    who = np.flatnonzero(linked.any(axis=1))
    if not len(who):
        return []
    inner = linked[np.ix_(who, who)]
    names, degree = keys[who], inner.astype(np.int64) @ copies[who]
    label = names.copy()
    while True:
        near = np.where(inner, label[None, :], np.iinfo(np.int64).max).min(axis=1)
        new = np.minimum(label, near)
        if (new == label).all():
            break
        label = new
    return list(zip(names.tolist(), degree.tolist(), label.tolist(), strict=True))


def _verified(rows: DataFrame, threshold: float) -> DataFrame:
    """key, links, root of every class and pair of blocks in which it has a link. rows: bucket, i, j, key, copies, block, others, grams."""
    near = rows.repartition(partitions_for(rows.sparkSession), "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        group = None
        found: list = []

        def close() -> None:
            if len(held) > 1:
                keys = np.array(list(held), np.int64)
                copies, blocks, others, grams = zip(*held.values(), strict=True)
                found.extend(verify_group(*group, keys, np.array(copies, np.int64), np.array(blocks), others, [np.frombuffer(g, np.uint64) for g in grams], threshold))

        def out() -> pa.RecordBatch:
            columns = list(zip(*found, strict=True)) or [(), (), ()]
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["key", "links", "root"])

        for batch in batches:
            for bucket, i, j, key, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (bucket, i, j) != group:
                    close()
                    group, held = (bucket, i, j), {}
                held[key] = rest  # a class with repeated rows counts once
            yield out()
        close()
        yield out()

    return near.select("bucket", "i", "j", "key", "copies", "block", "others", "grams").mapInArrow(run, "key long, links long, root long")


def _linked(docs: DataFrame, threshold: float, recall: float, words: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key of every row; key, rep, copies, links, class_id, keeper of every class), keeper being the key of its group's first class."""
    bands = bands_for(threshold, recall, rows)
    signed = stored(signatures(docs, bands, rows, words), "signatures")
    classes = signed.where(F.col("key").isNotNull()).groupBy("key").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.any_value("size").alias("grams"), F.any_value("bands").alias("bands"))
    classes = stored(classes, "classes")
    banded = classes.select("key", "grams", F.explode("bands").alias("bucket"))
    # Blocks of a bucket: by its classes, or by its n-grams where texts are long.
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("grams") / BLOCK_GRAMS))
    buckets = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), blocks.alias("n"), F.bit_xor(F.xxhash64("key")).alias("x"), F.bit_xor(F.xxhash64("key", F.lit(1))).alias("y")).where(F.col("size") > 1)
    once = stored(buckets.groupBy("size", "n", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket", "n"), "buckets")
    # Buckets and candidates grow with the documents, so they are never broadcast.
    members = banded.select("key", "bucket").join(once.hint("merge"), "bucket").groupBy("key").agg(F.collect_list(F.struct("bucket", F.col("n").alias("size"))).alias("buckets"))  # at most one for each band
    asked = stored(classes.select("key", "rep", "copies").join(members, "key"), "candidates")
    plain = documents(docs, "doc_id", "text")
    texts = plain.join(asked.where(F.col("rep").isNotNull()).hint("merge"), F.col("doc_id") == F.col("rep")).select("key", "copies", "buckets", "text")
    # Classes without any doc_id get their texts by key.
    without = with_keys(plain.where(F.col("doc_id").isNull()), "own_key", words).groupBy("own_key").agg(F.any_value("text").alias("text"))
    without = without.join(asked.where(F.col("rep").isNull()), F.col("own_key") == F.col("key")).select("key", "copies", "buckets", "text")
    sets = _gram_sets(texts.unionByName(without), words)
    each = sets.select("key", "copies", "grams", F.transform("buckets", lambda b: b["bucket"]).alias("others"), F.explode("buckets").alias("b"))
    each = each.withColumn("n", F.col("b.size")).withColumn("block", F.pmod(F.xxhash64("key", "b.bucket"), F.col("n")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))
    each = each.withColumn("x", other).select("key", "copies", "grams", "others", F.col("b.bucket").alias("bucket"), "block", F.least("block", "x").alias("i"), F.greatest("block", "x").alias("j"))
    verified = stored(_verified(each, threshold), "verified")
    degrees = verified.groupBy("key").agg(F.sum("links").alias("links"))
    groups = components(verified.select(F.col("key").alias("a"), F.col("root").alias("b"))).withColumnRenamed("a", "key")
    known = classes.select("key", "rep", "copies").join(degrees, "key", "left").join(groups, "key", "left")
    known = stored(known.select("key", "rep", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("b", "key").alias("root")), "classes-linked")
    first = F.min(F.struct(F.col("rep").isNull().alias("no_id"), "rep", "key")).alias("first")  # a null is never before an id
    least = stored(known.groupBy("root").agg(first).select("root", F.col("first.rep").alias("class_id"), F.col("first.key").alias("keeper")), "groups")
    return signed.select("doc_id", "key"), stored(known.join(least, "root").drop("root"), "classes-grouped")


def ngram_jaccard(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, words: int = WORDS, rows: int = ROWS) -> DataFrame:
    """doc_id, class_id (least doc_id of its group of linked documents), copy_id (of its class), n_links, n_class (documents of its class)."""
    signed, known = _linked(docs, threshold, recall, words, rows)
    out = signed.join(known, "key", "left")
    alone = F.col("copies").isNull()
    pick = lambda c, other: F.when(alone, other).otherwise(F.col(c))
    return out.select("doc_id", pick("class_id", F.col("doc_id")).alias("class_id"), pick("rep", F.col("doc_id")).alias("copy_id"), pick("copies", F.lit(1)).cast("long").alias("n_class"), F.when(alone, F.lit(0)).otherwise(F.col("links") + F.col("copies") - 1).cast("long").alias("n_links"))


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, words: int = WORDS, rows: int = ROWS) -> DataFrame:
    """The documents that stay, with all their columns, when one document of each group is kept.

    It is that of the least doc_id (a null comes last), and of one doc_id the text of the least key. Texts without
    n-grams all stay. Rows whose doc_id is null or repeated are judged by their own text, not by the doc_id; of equal
    ones, one stays, which is the one of least content.
    """
    signed, known = _linked(docs, threshold, recall, words, rows)
    keepers = known.where(F.col("keeper") == F.col("key")).select(F.col("key").alias("_lexloom_k_key"), F.col("rep").alias("_lexloom_k_id"))
    stays = F.col("key").isNull() | F.col("_lexloom_k_key").isNotNull()
    judged = signed.where(F.col("doc_id").isNotNull()).join(keepers, (F.col("key") == F.col("_lexloom_k_key")) & (F.col("doc_id") == F.col("_lexloom_k_id")), "left")
    ids = stored(judged.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max(stays).alias("stays")).where("stays").select(F.col("doc_id").alias("_lexloom_kept_id"), "n"), "kept-ids")
    # The ids that stay grow with the documents: they are never broadcast.
    out = docs.join(ids.where("n = 1").drop("n").hint("merge"), F.col("doc_id") == F.col("_lexloom_kept_id")).drop("_lexloom_kept_id")
    special = [docs.where(F.col("doc_id").isNull())] if not signed.where(F.col("doc_id").isNull()).isEmpty() else []
    if not ids.where("n > 1").isEmpty():
        special.append(docs.join(ids.where("n > 1").drop("n"), F.col("doc_id") == F.col("_lexloom_kept_id"), "left_semi"))
    for some in special:
        keyed = with_keys(some, "_lexloom_own_key", words)
        out = out.unionByName(keyed.where(F.col("_lexloom_own_key").isNull()).drop("_lexloom_own_key"))
        own = keyed.join(keepers, (F.col("_lexloom_own_key") == F.col("_lexloom_k_key")) & F.col("doc_id").eqNullSafe(F.col("_lexloom_k_id"))).select("_lexloom_own_key", F.struct(*[quoted(c) for c in docs.columns]).alias("x"))
        out = out.unionByName(own.groupBy("_lexloom_own_key").agg(F.min_by("x", F.xxhash64(F.to_json("x"))).alias("x")).select("x.*"))
    return out
