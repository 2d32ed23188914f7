"""Scores pages as their dumps arrive; each title is stored once."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..plans.pipeline import Classifier
from ..sources import dump
from ..sources.store import BUCKETS, Store

#: The columns of a stored prediction.
PREDICTION = "title string, prediction double"


def first_of_each(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The rows of a stream whose key was in no batch before; of a batch's rows with one key, the first by `order` (nulls last).

    The keys seen so far are the query's state, in its checkpoint: what came earlier is not read again. Of a key's rows
    one at a time is held. A null key is a key.
    """

    def first(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best = None
        for frame in frames:
            if not state.exists:
                both = frame if best is None else pd.concat([best, frame])
                best = both.sort_values(order, kind="stable", na_position="last").head(1)
        if best is not None:
            state.update((True,))
            yield best

    return rows.groupBy(key).applyInPandasWithState(first, rows.schema, "seen boolean", "append", GroupStateTimeout.NoTimeout)


def deploy_stream(spark: SparkSession, folder: str, model: Classifier, threshold: float, out: str, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """A query over all dumps that are in the folder now and were not read before: articles are scored and inserted if absent.

    A title that the query has seen is not scored again. Titles that other writers have stored are found by reading
    only the buckets of the collection that a batch's titles fall into.
    """
    pages = dump.articles(dump.stream_pages(spark, folder)).select("title", "timestamp", "text", "raw_xml")
    store = Store(spark, out, PREDICTION, ["title"], buckets)

    def insert(batch: DataFrame, _: int) -> None:
        docs = dump.dissected_pages(batch).select("title", "feature_union")
        store.insert_if_absent(model.predictions(docs, threshold), ["prediction"])

    return first_of_each(pages, "title", "timestamp").writeStream.foreachBatch(insert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def deploy(spark: SparkSession, path: str, model: Classifier, threshold: float) -> DataFrame:
    """title, prediction of the articles of dump files."""
    docs = dump.dissected_pages(dump.articles(dump.read_pages(spark, path))).select("title", "feature_union")
    return model.predictions(docs, threshold)
