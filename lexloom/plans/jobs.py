"""Ingest and dissection of page dumps as whole jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import dump, sinks
from ..sources.store import Store

#: The columns of a collection of pages.
PAGE = "title string, full_raw_xml string, target string"


def ingest(spark: SparkSession, dumps: str, titles: DataFrame, target: str, collection: str, limit: int | None = None) -> None:
    """Adds the dumps' pages whose title is in the list, with the target, to a collection; the first writer of a title wins.

    titles: the first column has them. limit: most pages that are added; null or 0 is no limit.
    """
    pages = dump.with_titles(dump.read_pages(spark, dumps), titles).select("title", F.col("raw_xml").alias("full_raw_xml"), F.lit(target).alias("target"))
    Store(spark, collection, PAGE, ["title"]).insert_if_absent(pages.limit(limit) if limit else pages, ["full_raw_xml"])


def dissect(spark: SparkSession, collection: str, out: str, version: int) -> str:
    """A new version of a collection of pages, whose rows also have what their markup holds. Gives the version's path."""
    pages = Store(spark, collection, PAGE, ["title"]).read()
    texts = dump.parsed(pages.select(F.col("full_raw_xml").alias("raw_xml")))
    changes = sinks.first_by(dump.dissected_pages(texts), ["title"], ["timestamp"])
    return sinks.write_version(sinks.updated(pages, changes, "title"), out, version)


def library_texts(pages: DataFrame, limit: int | None = None, least: int = 50) -> DataFrame:
    """title, tokens: articles' words as a corpus library reads them: lower case, letters only, 2 to 15 of them.

    Articles of fewer than `least` words are left out. limit: most articles.
    """
    clean = F.lower(dump.plain_text(F.col("text")))
    words = F.filter(F.regexp_extract_all(clean, F.lit(r"(?U)[^\W\d_]+"), F.lit(0)), lambda w: F.length(w).between(2, 15))
    rows = dump.articles(pages).select("title", words.alias("tokens")).where(F.size("tokens") >= least)
    return rows.limit(limit) if limit else rows
