"""Collections with a row for each key, as Parquet folders of hash buckets: the first writer of a key wins.

A row's bucket comes from a hash of its key. An insert reads only the key columns of the buckets that its rows fall
into, and adds files to those; an update rewrites only the buckets that hold a changed key (dynamic partition
overwrite). So work grows with what is written, not with what is stored, as long as a batch touches few buckets.

Writers claim the buckets that they touch by files that only one of them can create, in one order, so two inserts of the
same key cannot both find it absent, and inserts into different buckets do not wait for each other. This needs a file
system that creates files atomically (HDFS, POSIX). A claim that a dead writer left behind is named in the error that a
waiting writer raises; removing the file frees the bucket. Readers need no claims: files appear whole.
"""

from __future__ import annotations

import contextlib
import time
import uuid
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import stored
from .sinks import absent, first_by, quoted

#: Buckets of a new collection; the column that holds a row's bucket; seconds that a writer waits for a claim.
BUCKETS, BUCKET, PATIENCE = 256, "_bucket", 600


class Store:
    """A collection at a path. `keys` are the columns that tell rows apart (nulls are equal)."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | str, keys: Sequence[str], buckets: int = BUCKETS, patience: float = PATIENCE):
        self.spark, self.path, self.keys, self.patience = spark, path.rstrip("/"), list(keys), patience
        self.schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        self.buckets = self._settled(buckets)

    def _fs(self, at: str):
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(at)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def _created(self, at: str) -> bool:
        """Creates an empty file; False if it is there."""
        fs, where = self._fs(at)
        try:
            fs.create(where, False).close()
        except Exception as error:  # py4j wraps what Hadoop raises
            if "AlreadyExists" in str(error) or fs.exists(where):
                return False
            raise
        return True

    def _settled(self, buckets: int) -> int:
        """The number of buckets of the collection; the first to come sets it, by a file's name."""
        fs, where = self._fs(f"{self.path}/_buckets")
        while True:
            there = [int(x.getPath().getName()) for x in fs.listStatus(where)] if fs.exists(where) else []
            if there:
                return min(there)
            fs.mkdirs(where)
            self._created(f"{self.path}/_buckets/{buckets:d}")

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*map(quoted, self.keys)), F.lit(self.buckets)).cast("int")

    def _table(self, touched: Sequence[int] | None = None) -> DataFrame:
        """The stored rows, with their bucket; of some buckets only, if they are named."""
        whole = T.StructType([*self.schema.fields, T.StructField(BUCKET, T.IntegerType())])
        rows = self.spark.read.schema(whole).parquet(self.path)
        return rows if touched is None else rows.where(F.col(BUCKET).isin(*touched))

    def read(self) -> DataFrame:
        return self._table().drop(BUCKET)

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The stored rows with one of the keys. Only their buckets are read."""
        wanted = stored(keys.select(*map(quoted, self.keys), self.bucket().alias(BUCKET)).distinct(), "store-keys")
        same = [F.col(f"a.`{k}`").eqNullSafe(F.col(f"b.`{k}`")) for k in (BUCKET, *self.keys)]
        cond = same[0]
        for c in same[1:]:
            cond = cond & c
        return self._table(self._touched(wanted)).alias("a").join(wanted.alias("b"), cond, "left_semi").drop(BUCKET)

    @staticmethod
    def _touched(rows: DataFrame) -> list[int]:
        return sorted(r[0] for r in rows.select(BUCKET).distinct().collect())  # at most a number for each bucket

    @contextlib.contextmanager
    def _claimed(self, touched: Sequence[int]) -> Iterator[None]:
        mine: list[str] = []
        try:
            for k in touched:
                at, until = f"{self.path}/_claims/{k:06d}", time.monotonic() + self.patience
                while not self._created(at):
                    if time.monotonic() > until:
                        raise TimeoutError(f"another writer has claimed {at}; if it is dead, remove that file")
                    time.sleep(0.05)
                mine.append(at)
            yield
        finally:
            for at in mine:
                fs, where = self._fs(at)
                fs.delete(where, False)

    def insert_if_absent(self, rows: DataFrame, order: Sequence[str]) -> None:
        """Adds the first row (by `order`) of each key that is not there yet."""
        fresh = stored(first_by(rows.select(*(quoted(f.name) for f in self.schema.fields)), self.keys, order).withColumn(BUCKET, self.bucket()), "store-insert")
        touched = self._touched(fresh)
        if not touched:
            return
        with self._claimed(touched):
            known = self._table(touched).select(BUCKET, *map(quoted, self.keys))
            new = absent(fresh, known, [BUCKET, *self.keys])
            new.repartition(BUCKET).write.mode("append").partitionBy(BUCKET).parquet(self.path)

    def update(self, changes: DataFrame) -> None:
        """Sets the other columns of `changes` (which has the keys, a row for each) in the rows with its keys. Others stay; none is added."""
        new = [c for c in changes.columns if c not in self.keys]
        told = stored(changes.withColumn(BUCKET, self.bucket()), "store-update")
        touched = self._touched(told)
        if not touched:
            return
        with self._claimed(touched):
            other = told.select(*[quoted(c).alias(f"_new_{i}") for i, c in enumerate([BUCKET, *self.keys, *new])], F.lit(True).alias("_told"))
            rows = self._table(touched)
            cond = F.lit(True)
            for i, k in enumerate([BUCKET, *self.keys]):
                cond = cond & rows[f"`{k}`"].eqNullSafe(other[f"_new_{i}"])
            at = {c: F.col(f"_new_{i + 1 + len(self.keys)}") for i, c in enumerate(new)}
            names = [f.name for f in self.schema.fields]
            kept = [F.when(F.col("_told"), at[c]).otherwise(rows[f"`{c}`"]).alias(c) if c in at else rows[f"`{c}`"] for c in names]
            self._rewrite(rows.join(other, cond, "left").select(*kept, rows[BUCKET]))

    def compact(self, touched: Sequence[int] | None = None) -> None:
        """Rewrites buckets (or all) as one file each, where many inserts have left many."""
        touched = list(range(self.buckets)) if touched is None else touched
        with self._claimed(touched):
            self._rewrite(self._table(touched))

    def _rewrite(self, rows: DataFrame) -> None:
        """Replaces the buckets of the rows. What is read is replaced, so it is stored elsewhere first."""
        safe = stored(rows, f"store-rewrite-{uuid.uuid4().hex[:8]}")
        safe.repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(self.path)
