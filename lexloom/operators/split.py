"""Deterministic splits by order of a key or of its seeded hash, and binary targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored

#: Ranges and labels in them, a row each, that are broadcast at most; more are joined by a shuffle.
BROADCAST_ROWS = 200_000


def is_target(column: Column, target: str) -> Column:
    """1 for the target, else 0, also for null."""
    return column.eqNullSafe(F.lit(target)).cast("int")


def _order(key: str, seed: int | None) -> list[Column]:
    return [F.col(key)] if seed is None else [F.xxhash64(F.col(key), F.lit(seed)), F.col(key)]


def _placed(rows: DataFrame, by: list[Column], order: list[Column]) -> DataFrame:
    """rows with `_place` (from 0, within `by`) and `_all` (rows of the same `by`).

    Rows are dealt into ranges of (by, order) and stored with their range; the ranges' counts are summed in order, and
    rows are numbered inside their ranges. So no task gets all rows, nor all of a frequent label.
    """
    ranged = stored(rows.repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    names = [f"_by{i}" for i in range(len(by))]
    marked = ranged.select("*", *[c.alias(n) for n, c in zip(names, by, strict=True)])
    sizes = marked.groupBy("_range", *names).agg(F.count(F.lit(1)).alias("_n"))  # a row for each range and label in it
    upto = Window.partitionBy(*names).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("_range", *names, F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy(*names)).alias("_all"))
    same = F.col("_range") == F.col("_r")
    for n in names:
        same = same & F.col(n).eqNullSafe(F.col(f"{n}_r"))
    right = before.select(F.col("_range").alias("_r"), *[F.col(n).alias(f"{n}_r") for n in names], "_before", "_all")
    inside = F.row_number().over(Window.partitionBy("_range", *names).orderBy(*order)) - 1
    right = stored(right, "range-starts")
    few = right.count() <= BROADCAST_ROWS
    placed = marked.withColumn("_inside", inside).join(F.broadcast(right) if few else right, same)
    return placed.withColumn("_place", F.col("_before") + F.col("_inside")).select(*[F.col(f"`{c}`") for c in rows.columns], "_place", "_all")


def stratified_split(rows: DataFrame, label: str, key: str, share: float = 0.8, seed: int | None = None) -> DataFrame:
    """rows with `part`: of each label the first floor(n x share) rows, by key or seeded hash, are 'train', the rest 'test'."""
    placed = _placed(rows, [F.col(label)], _order(key, seed))
    return placed.withColumn("part", F.when(F.col("_place") < F.floor(F.col("_all") * F.lit(share)), "train").otherwise("test")).drop("_place", "_all")


def k_folds(rows: DataFrame, label: str, key: str, k: int = 5, seed: int | None = None) -> DataFrame:
    """rows with `fold`: each row is in the test set of one fold; the last fold takes the remainder."""
    if k < 2:
        raise ValueError("k_folds needs at least 2 folds")
    placed = _placed(rows, [F.col(label)], _order(key, seed))
    size = F.greatest(F.floor(F.col("_all") / k), F.lit(1))
    return placed.withColumn("fold", F.least(F.floor(F.col("_place") / size), F.lit(k - 1)).cast("int")).drop("_place", "_all")


def placed(rows: DataFrame, *order: Column | str) -> DataFrame:
    """rows with `_place` from 0 in the given order, and `_all`, the number of rows."""
    return _placed(rows, [], [F.col(c) if isinstance(c, str) else c for c in order])


def numbered(rows: DataFrame, *order: Column | str) -> DataFrame:
    """rows with `idx` from 0 in the given order."""
    return placed(rows, *order).withColumnRenamed("_place", "idx").drop("_all")
