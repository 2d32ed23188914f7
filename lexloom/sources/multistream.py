"""Random access to multistream page dumps by title.

Such a dump is many bz2 streams one after the other, each with some pages; an index has a line `offset:page_id:title`
for each page, where offset is the byte at which the page's stream begins. Only the streams that hold a wanted title are
opened: by `indexed_pages` for a table of titles of any size (the index is joined with it), and by the data source
`multistream_dump` for the titles that a query's filter names, which are pushed down to it.

A stream ends itself, so its beginning is all that a task needs; no stream is read by two tasks.
"""

from __future__ import annotations

import bz2
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from .dump import framed, parsed

#: Bytes that are read from a dump at once; streams of a task that reads all pages.
READ_BYTES, STREAMS = 1 << 18, 16
_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&"))


def _opened(uri: str):
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem().open_input_file(uri)
    fs, path = pafs.FileSystem.from_uri(uri.replace("file:///", "file:/").replace("file:/", "file:///", 1))
    return fs.open_input_file(path)


def stream_text(uri: str, offset: int) -> str:
    """The text of the bz2 stream that begins at a byte of a file."""
    out, unpack = [], bz2.BZ2Decompressor()
    with _opened(uri) as file:
        file.seek(offset)
        while not unpack.eof:
            data = file.read(READ_BYTES)
            if not data:
                raise EOFError(f"the stream at byte {offset} of {uri} does not end")
            out.append(unpack.decompress(data))
    return b"".join(out).decode()


def _title(page: str) -> str:
    """The title of a page's fragment, with entities as characters, as the index has it."""
    text = page.partition("<title>")[2].partition("</title>")[0]
    for entity, char in _ENTITIES:
        text = text.replace(entity, char)
    return text


def pages_of(uri: str, offset: int) -> Iterator[tuple[str, str]]:
    """(title, text up to the end of the page) of each page of a stream."""
    for chunk in stream_text(uri, offset).split("</page>"):
        if "<page>" in chunk:
            yield _title(chunk), chunk


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """offset, page_id, title: the lines of an index. Titles may have colons in them."""
    line = F.regexp_extract
    return spark.read.text(path).where(F.rlike("value", F.lit(r"^\d+:\d+:"))).select(
        line("value", r"^(\d+):", 1).cast("long").alias("offset"), line("value", r"^\d+:(\d+):", 1).cast("long").alias("page_id"), line("value", r"^\d+:\d+:(.*)$", 1).alias("title")
    )


def indexed_pages(spark: SparkSession, dump: str, index: str, titles: DataFrame) -> DataFrame:
    """The pages (as of `dump.read_pages`) whose title is in the list's first column. Only streams that have one are opened."""
    wanted = titles.select(F.col(titles.columns[0]).alias("title")).distinct()
    found = read_index(spark, index).join(wanted, "title", "left_semi")
    streams = found.groupBy("offset").agg(F.collect_set("title").alias("titles"))  # a stream has a bounded number of pages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for offset, names in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = set(names)
                rows = [page for title, page in pages_of(dump, offset) if title in own]
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.string())], names=["value"])

    return parsed(framed(streams.select("offset", "titles").mapInArrow(run, "value string")))


@dataclass
class Streams(InputPartition):
    """Streams that one task reads, and the titles that are wanted from them (None: all)."""

    offsets: Sequence[int]
    titles: frozenset[str] | None


class _Reader(DataSourceReader):
    def __init__(self, dump: str, index: str):
        self.dump, self.index, self.titles = dump, index, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("title",):
                own = {f.value}
            elif isinstance(f, In) and f.attribute == ("title",):
                own = set(f.value)
            else:
                yield f
                continue
            self.titles = own if self.titles is None else self.titles & own

    def partitions(self) -> list[Streams]:
        """The index is read line by line; the offsets of the streams that are wanted are all that is kept of it."""
        offsets: set[int] = set()
        with _opened(self.index) as file:
            unpack = pa.CompressedInputStream(file, "bz2") if self.index.endswith(".bz2") else file
            for line in _lines(unpack):
                offset, _, title = line.split(":", 2)
                if self.titles is None or title in self.titles:
                    offsets.add(int(offset))
        ordered, names = sorted(offsets), None if self.titles is None else frozenset(self.titles)
        size = STREAMS if names is None else 1
        return [Streams(ordered[i : i + size], names) for i in range(0, len(ordered), size)] or [Streams([], names)]

    def read(self, partition: Streams) -> Iterator[tuple[str, int, str]]:
        for offset in partition.offsets:
            for title, page in pages_of(self.dump, offset):
                if partition.titles is None or title in partition.titles:
                    yield title, offset, page


def _lines(file) -> Iterator[str]:
    left = b""
    while data := file.read(READ_BYTES):
        *whole, left = (left + data).split(b"\n")
        yield from (x.decode() for x in whole if x)
    if left:
        yield left.decode()


class MultistreamDump(DataSource):
    """`spark.read.format("multistream_dump").option("index", ...).load(dump)`: title, stream (offset), value (the page's text).

    Filters `title = ...` and `title IN (...)` decide which streams are read.
    """

    @classmethod
    def name(cls) -> str:
        return "multistream_dump"

    def schema(self) -> str:
        return "title string, stream long, value string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], self.options["index"])


def register(spark: SparkSession) -> None:
    """Makes the data source known to a session, and lets filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(MultistreamDump)
