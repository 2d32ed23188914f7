"""Collections as Parquet folders, with first-writer-wins inserts, updates by rewrite, and tab-separated reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def quoted(name: str) -> Column:
    """The column of that name, which may have dots in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def first_by(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key by the given order, all columns as the tie-break. Aggregated before the shuffle, so a hot key is no load."""
    named = [quoted(c).alias(f"c{i}") for i, c in enumerate(rows.columns)]
    first = rows.groupBy(*[quoted(k).alias(f"k{i}") for i, k in enumerate(keys)]).agg(F.min_by(F.struct(*named), F.struct(*map(quoted, order), F.xxhash64(*map(quoted, rows.columns)))).alias("_first"))
    return first.select(*[F.col(f"_first.c{i}").alias(c) for i, c in enumerate(rows.columns)])


def absent(rows: DataFrame, existing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key (nulls are equal) the existing rows do not have."""
    known = existing.select(*[quoted(k).alias(f"_k_{i}") for i, k in enumerate(keys)]).distinct()
    same = [quoted(k).eqNullSafe(F.col(f"_k_{i}")) for i, k in enumerate(keys)]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    return rows.join(known, cond, "left_anti")


def read_collection(spark: SparkSession, path: str, schema) -> DataFrame:
    """The rows of a collection; one not yet written is empty."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def insert_if_absent(rows: DataFrame, path: str, keys: Sequence[str], order: Sequence[str]) -> None:
    """Appends the first row of each key that the collection does not have."""
    existing = read_collection(rows.sparkSession, path, rows.schema)
    absent(first_by(rows, keys, order), existing, keys).write.mode("append").parquet(path)


def append_edges(edges: DataFrame, path: str) -> None:
    edges.where(F.size("parents") > 0).write.mode("append").parquet(path)


def updated(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """The table with the changes' columns set where the key is in both."""
    new = [c for c in changes.columns if c != key]
    other = changes.select(quoted(key).alias("_key"), *[quoted(c).alias(f"_new_{i}") for i, c in enumerate(new)])
    joined = table.join(other, quoted(key) == F.col("_key"), "left")
    have, at = F.col("_key").isNotNull(), {c: F.col(f"_new_{i}") for i, c in enumerate(new)}
    kept = [F.when(have, at[c]).otherwise(quoted(c)).alias(c) if c in at else quoted(c) for c in table.columns]
    added = [at[c].alias(c) for c in new if c not in table.columns]
    return joined.select(*kept, *added)


def write_tsv(rows: DataFrame, path: str) -> None:
    """One tab-separated file with a header. For reports of bounded size."""
    rows.coalesce(1).write.mode("overwrite").csv(path, sep="\t", header=True, quote="", escape="")


def write_text(rows: DataFrame, column: str, path: str) -> None:
    """A line for each row: the text corpus of a target. Rows without a text, or with the literal text `nan`, are left out."""
    rows.where(F.col(column) != "nan").select(F.translate(column, "\r\n", "  ")).write.mode("overwrite").text(path)


def write_version(table: DataFrame, path: str, version: int) -> str:
    """A whole table as a version of its own; readers of older versions are not disturbed."""
    at = f"{path}/version={version}"
    table.write.mode("errorifexists").parquet(at)
    return at
