"""What the training-data operators share: table reading, shared work folders, bounded batches."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: UTF-8 bytes of text that one Python step handles at once.
CHUNK_BYTES = 1_000_000
#: Bytes of input that a shuffle partition of texts should hold at most.
PARTITION_BYTES = 64 * 2**20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below `spark.checkpoint.dir`, which the driver and all executors share.

    Only where that setting is absent and the master is local (a test) is a temporary folder set as the checkpoint
    folder; a cluster without the setting is refused, since its executors would not share such a folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "local").startswith("local") or spark.conf.get("spark.master", "").startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='lexloom-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/lexloom/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written to a table in the shared folder and read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions_for(spark: SparkSession, least: int = 1) -> int:
    """Shuffle partitions of the session, at least `least`."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def partitions_by_size(df: DataFrame) -> int:
    """Shuffle partitions of the session, or more where the optimizer's estimate of `df` needs more of `PARTITION_BYTES`."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return partitions_for(df.sparkSession, min(1_000_000, -(-size // PARTITION_BYTES)))


#: What a Python worker keeps from task to task: one object, of one operator at a time.
_KEPT: list = [None, None]


def worker_keeps(name: object, make: Callable[[], Any]) -> Any:
    """`make()`, once for each run of tasks with the same name; what other names kept is given up first.

    So a worker that serves one stage after the other holds one operator's tables, not the sum of all.
    """
    if _KEPT[0] != name:
        _KEPT[:] = [None, None]
        gc.collect()
        _KEPT[:] = [name, make()]
    return _KEPT[1]


class Bounded(dict):
    """A dictionary that fills missing keys by `make` and keeps values up to a number of entries and of key characters."""

    def __init__(self, make: Callable[[Any], Any], most: int, most_chars: int = 8_000_000):
        super().__init__()
        self.make, self.most, self.chars = make, most, most_chars

    def __missing__(self, key: Any) -> Any:
        value = self.make(key)
        if len(self) < self.most and self.chars > 0:
            self.chars -= len(key)
            self[key] = value
        return value


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of Arrow batches with at most `limit` UTF-8 bytes of text each; a single longer text makes a slice of its own."""
    for batch in batches:
        at = batch.schema.get_field_index(column)
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            base = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
    pa.default_memory_pool().release_unused()


def text_chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """`slices` with their texts (null: empty). Slices are cut by byte offsets, before any text becomes a Python string; no text is cut."""
    for part in slices(batches, column, limit):
        yield part, [x or "" for x in part.column(part.schema.get_field_index(column)).to_pylist()]


def quoted(name: str) -> Column:
    """The column of that name, which may have dots and quotes in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def documents(docs: DataFrame, *columns: str) -> DataFrame:
    """The named columns of a documents table; other columns may have any names."""
    return docs.select(*map(quoted, columns))


def mapped_rows(docs: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], *added: StructField) -> DataFrame:
    """`docs.mapInArrow` over all columns, and the columns that `run` adds; names with dots or quotes stand aside meanwhile."""
    own = [f"_lexloom_c{i}" if "." in c or "`" in c else c for i, c in enumerate(docs.columns)]
    plain = docs if own == docs.columns else docs.toDF(*own)
    out = plain.mapInArrow(run, StructType([*plain.schema.fields, *added]))
    return out if own == docs.columns else out.toDF(*docs.columns, *[f.name for f in added])
