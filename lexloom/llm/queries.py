"""The registered queries of these operators, each over its whole table, and DuckDB SQL where SQL can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import arrow_sequences, bin_packing, fill_middle, iso_media, license_scan, masked_lm, ngram_jaccard, site_style_tree, source_mixture, token_alignment, token_counts, toxicity, vptree_ann
from .common import table
from .oracles import oracle_sql  # noqa: F401  (part of this module's interface)

Query = Callable[[SparkSession, str], DataFrame]


def op1_vptree_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return vptree_ann.nearest(vectors, vectors.where("vec_id % 100 = 0"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = license_scan.license_scan(license_scan.document_paths(table(spark, sf_dir, "documents")))
    return scanned.withColumnRenamed("file_id", "doc_id")


def op3_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_style_tree.extract(table(spark, sf_dir, "pages"))


def op4_arrow_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arrow_sequences.token_digest(table(spark, sf_dir, "documents"))


def op5_masked_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masked_lm.pseudo_likelihood(table(spark, sf_dir, "documents"))


def op6_source_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mixture.mixture(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_toxicity_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.ngram_jaccard(table(spark, sf_dir, "documents"))


def op9_iso_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iso_media.media_features(table(spark, sf_dir, "documents"))


def op10_bin_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bin_packing.packed_sequences(table(spark, sf_dir, "documents"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.rearranged_digest(table(spark, sf_dir, "documents"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.alignment(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    own = (op1_vptree_ann, op2_license_scan, op3_site_style_tree, op4_arrow_sequences, op5_masked_lm, op6_source_mixture, op7_toxicity_ftrl, op8_ngram_jaccard, op9_iso_media, op10_bin_packing, op11_token_counts, op12_fill_middle, op13_token_alignment)
    return {f.__name__: f for f in own}
