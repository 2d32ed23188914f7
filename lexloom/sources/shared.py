"""Tables in the folder that driver and executors share, which cut the lineage of long jobs and are read more than once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: For tables whose rows hold megabytes: row groups of a few rows, whose size is looked at after each of them. By itself
#: Parquet looks after the hundredth, and a reader holds all rows of a row group at once.
WIDE_ROWS = {"parquet.block.size": str(8 * 2**20)} | {f"parquet.{of}.size.row.check.{end}": "1" for of in ("block", "page") for end in ("min", "max")}


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below `spark.checkpoint.dir`. Only a local session may do without that setting; it gets a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='lexloom-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/lexloom/{name}-{uuid.uuid4().hex}"


#: The session's setting for bytes of an Arrow batch, and its value where nobody has set it. Spark's own, 64 MiB, is held
#: several times for each core: as vectors that have doubled, and twice by the Python worker.
BATCH_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", str(8 * 2**20))


def small_batches(spark: SparkSession) -> None:
    """From now on Python workers of this session get batches of `BATCH_BYTES`, unless the setting was made."""
    if spark.conf.get(BATCH_BYTES[0], None) is None:
        spark.conf.set(*BATCH_BYTES)


def stored(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """`df` written once, with further options of Parquet, and read again; it survives lost executors."""
    path = shared_folder(df.sparkSession, name)
    df.write.options(compression="zstd", **(options or {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """`df` dealt to all cores if its scan has fewer tasks than the session has cores, as of a small file; else as it is.

    For what is heavy in the stage of the scan. Large tables have more splits than that and are never shuffled by this.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() < cores else df
