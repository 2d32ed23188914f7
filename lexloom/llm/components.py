"""Connected components of a link table by rounds of large-star and small-star, all rounds on executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _mark(df: DataFrame) -> tuple:
    return tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a", F.lit(7)))).head())


def components(links: DataFrame) -> DataFrame:
    """a, b: every linked node but the least of its component, and that least one. `links` has node columns a, b.

    Each round replaces the links by as many or fewer, and cuts lineage with a table in the shared folder; rounds end
    when nothing changes. Only a count and two checksums come to the driver.
    """
    e = stored(links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    last = _mark(e)
    while last[0]:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        # Stored, so that the join reads two plain tables: adaptive execution can then split a hub's links over tasks.
        least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = stored(both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b")).distinct(), "large-star")
        low = stored(large.groupBy("a").agg(F.min("b").alias("m")), "low")
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where(F.col("a") != F.col("b"))
        e = stored(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "small-star")
        now = _mark(e)
        if now == last:
            break
        last = now
    return e
