"""Compressed page dumps and lists of titles as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import wikitext

PAGE = "title string, ns string, id long, redirect struct<_title: string>, revision struct<id: long, timestamp: string, text: struct<_VALUE: string>>"
TREE = "url string, depth int"
CLEAN_TREE = "url string, cleaned_url string, depth int"


def lines(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """value: the lines of (compressed) text files; null or 0 is no limit."""
    df = spark.read.text(path)
    return df.limit(limit) if limit else df


def framed(chunks: DataFrame) -> DataFrame:
    """raw_xml: the page fragments of text chunks that end before `</page>`; other chunks are left out."""
    raw = F.regexp_extract("value", r"(?s)<page>(.*)$", 1)
    return chunks.where(F.contains("value", F.lit("<page>"))).select(wikitext.lstrip_lines(raw).alias("raw_xml"))


def parsed(raw: DataFrame) -> DataFrame:
    """page_id, title, ns, redirect, timestamp, text, raw_xml of page fragments. Titles stay text, whatever they look like."""
    page = F.from_xml(F.concat(F.lit("<page>"), F.col("raw_xml"), F.lit("</page>")), F.lit(PAGE), {"valueTag": "_VALUE", "attributePrefix": "_", "mode": "PERMISSIVE", "ignoreSurroundingSpaces": "false"})
    return raw.withColumn("p", page).select(F.col("p.id").alias("page_id"), F.col("p.title").alias("title"), F.col("p.ns").alias("ns"), F.col("p.redirect._title").alias("redirect"), F.col("p.revision.timestamp").alias("timestamp"), F.col("p.revision.text._VALUE").alias("text"), "raw_xml")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages of dump files or folders; compressed files are read by many tasks."""
    return parsed(framed(spark.read.option("lineSep", "</page>").text(path)))


def stream_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages of dump files as they arrive in a folder."""
    return parsed(framed(spark.readStream.option("lineSep", "</page>").text(path)))


def articles(pages: DataFrame, limit: int | None = None) -> DataFrame:
    """Pages that are articles; the limit counts articles."""
    kept = pages.where(wikitext.is_article(F.col("ns"), F.col("text")))
    return kept.limit(limit) if limit else kept


def edge_pages(pages: DataFrame) -> DataFrame:
    """title, categories of the pages that have any."""
    return pages.select("title", wikitext.categories(F.col("raw_xml")).alias("categories")).where(F.size("categories") > 0)


def with_titles(pages: DataFrame, titles: DataFrame, title: str = "title") -> DataFrame:
    """The pages whose title is in the list."""
    return pages.join(titles.select(F.col(titles.columns[0]).alias(title)), title, "left_semi")


def plain_text(c: Column) -> Column:
    """Text without categories, markup and code."""
    return wikitext.strip_code(wikitext.without_categories(wikitext.remove_markup(c)))


def long_pages(pages: DataFrame, target: str | None = None) -> DataFrame:
    """The long form of pages: markup, links of all kinds, categories, tags, descriptions, math."""
    t, raw = F.col("text"), F.col("raw_xml")
    clean = plain_text(t)
    return pages.select(
        "title", "timestamp", F.col("page_id").cast("string").alias("id_"), raw.alias("full_raw_xml"), t.alias("full_markup_text"),
        F.array_join(wikitext.without_prefixed_lines(clean), " ").alias("cleaned_markup_text"), wikitext.article_links(t).alias("links"), F.lit(target).cast("string").alias("target"),
        wikitext.categories_bracketed(raw).alias("categories"), wikitext.tags(t).alias("tags"), wikitext.file_description(t).alias("file_desc"), wikitext.image_description(t).alias("image_desc"),
        wikitext.external_links(t).alias("external_links"), wikitext.simple_links(t).alias("simple_links"), wikitext.interlinks(t).alias("interlinks"), wikitext.math_tags(t).alias("math"),
    )


def dissected_pages(pages: DataFrame) -> DataFrame:
    """title, clean_text, timestamp, headers, clean_links, parent_categories, feature_union of pages."""
    parts = wikitext.dissected(F.col("title"), F.col("raw_xml"), F.coalesce("text", F.lit("")), F.col("timestamp"))
    return pages.select(*[c.alias(n) for n, c in parts.items()])


def read_tree(spark: SparkSession, path: str, cleaned: bool = False) -> DataFrame:
    """A category tree: url, depth, or url, cleaned_url, depth."""
    return spark.read.csv(path, sep="\t", header=True, schema=CLEAN_TREE if cleaned else TREE, quote="", encoding="UTF-8")


def read_titles(spark: SparkSession, path: str) -> DataFrame:
    """title: the first column of a list without a header."""
    return spark.read.csv(path, sep="\t", header=False, quote="").select(F.col("_c0").alias("title"))


def clean_tree(tree: DataFrame) -> DataFrame:
    """url, cleaned_url (null for no internal link), depth."""
    return tree.select("url", wikitext.link_title(F.col("url")).alias("cleaned_url"), "depth")


def target_rows(table: DataFrame, target: str, negate: bool = False) -> DataFrame:
    """Rows of a target, or all others, those without a target too."""
    same = F.col("target").eqNullSafe(F.lit(target))
    return table.where(~same if negate else same)


def require_target(table: DataFrame, target: str) -> None:
    """Raises if no row has the target."""
    if target_rows(table, target).isEmpty():
        raise ValueError(f"no row has target {target!r}")
