"""Multistream dumps: only the streams with wanted titles are opened."""

import bz2

import pytest
from pyspark.sql import functions as F

from lexloom.sources import dump, multistream


def page(i, title):
    return f"  <page>\n    <title>{title}</title>\n    <ns>0</ns>\n    <id>{i}</id>\n    <revision><id>1</id><timestamp>t</timestamp><text>text of {i}</text></revision>\n  </page>\n"


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    folder = tmp_path_factory.mktemp("multistream")
    titles = [f"Page {i}" for i in range(57)] + ["A: b: c", "R&D <x>"]
    data, lines = bz2.compress(b"<mediawiki>\n"), []
    for first in range(0, len(titles), 5):
        own = list(enumerate(titles))[first : first + 5]
        lines += [f"{len(data)}:{i}:{t}" for i, t in own]
        data += bz2.compress("".join(page(i, t.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")) for i, t in own).encode())
    data += bz2.compress(b"</mediawiki>\n")
    (folder / "d.xml.bz2").write_bytes(data)
    (folder / "i.txt.bz2").write_bytes(bz2.compress("\n".join(lines).encode() + b"\n"))
    (folder / "broken.bz2").write_bytes(data[:-20])
    return f"{folder}/d.xml.bz2", f"{folder}/i.txt.bz2", titles, f"{folder}/broken.bz2"


def test_index(spark, files):
    rows = multistream.read_index(spark, files[1]).collect()
    assert sorted(r.title for r in rows) == sorted(files[2]) and len({r.offset for r in rows}) == 12


def test_pages_of_a_table_of_titles(spark, files):
    wanted = ["Page 3", "Page 4", "Page 40", "A: b: c", "R&D <x>", "none", "Page 3"]
    titles = spark.createDataFrame([(t,) for t in wanted] + [(None,)], "t string")
    got = {r.title: r for r in multistream.indexed_pages(spark, files[0], files[1], titles).collect()}
    assert set(got) == set(wanted) - {"none"} and got["Page 40"].text == "text of 40" and got["R&D <x>"].page_id == 58
    whole = {r.title: tuple(r) for r in dump.read_pages(spark, files[0]).collect()}
    assert {t: tuple(r) for t, r in got.items()} == {t: whole[t] for t in got} and len(whole) == 59


def test_pushed_titles_open_their_streams_only(spark, files):
    multistream.register(spark)
    df = spark.read.format("multistream_dump").option("index", files[1]).load(files[0])
    assert df.select(F.count_distinct("stream"), F.count("value")).head() == (12, 59)
    ten = df.where(F.col("title").isin(*[f"Page {i}" for i in range(0, 50, 5)]))
    assert ten.count() == 10 and ten.rdd.getNumPartitions() <= 10
    one = df.where("title = 'Page 7'").where(F.length("value") > 5)
    assert one.rdd.getNumPartitions() == 1 and one.count() == 1
    assert df.where("title = 'none'").count() == 0 and df.where("title = 'Page 1' AND title = 'Page 2'").count() == 0
    reader = multistream._Reader(files[0], files[1])
    assert list(reader.pushFilters([multistream.In(("title",), ("Page 1", "Page 2", "x"))])) == []
    assert [len(p.offsets) for p in reader.partitions()] == [1]
    pages = dump.parsed(dump.framed(df.where("title = 'Page 7'").select("value")))
    assert pages.head().text == "text of 7"


def test_a_broken_stream_is_an_error(files):
    with pytest.raises(EOFError):
        list(multistream.pages_of(files[3], len(open(files[0], "rb").read()) - len(bz2.compress(b"</mediawiki>\n"))))
