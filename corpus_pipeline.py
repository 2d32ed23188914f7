"""A corpus pipeline: toxic documents go, one document of each near-duplicate group stays, sources are mixed to their
target weights, and the mix is packed into token sequences.

Each stage takes (spark, docs, sf_dir), with docs the whole output of the stage before, and returns a DataFrame. The
mix is carried out: a document stands as many times in that stage's output as the mix takes it.

Defined cases: null and empty texts are not toxic, have no near duplicates and no words for the mix to take; rows
without a doc_id, and different texts that share one, are judged each by its own text; empty tables give no rows. This
module belongs to the training-data operators: without `lexloom.llm` it does not import, and `__spark_entry__` leaves
its query out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexloom.llm.bin_packing import packed_sequences
from lexloom.llm.common import stored, table
from lexloom.llm.ngram_jaccard import one_of_each
from lexloom.llm.source_mixture import mixed
from lexloom.llm.toxicity import not_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return not_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs)


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packed_sequences(docs)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("source_mixture", source_mixture), ("packing", packing)]

#: The toxicity stage learns a model, which SQL cannot express; `tests/llm/test_pipeline.py` holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in their order over the documents; each stage's output is a written table."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, f"pipeline-{name}")
    return docs
