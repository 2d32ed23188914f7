import bz2

from lexloom.functions import wikitext
from lexloom.plans import jobs
from lexloom.sources import dump, sinks
from pyspark.sql import functions as F


def page(title, text, ns=0):
    return f"  <page>\n    <title>{title}</title>\n    <ns>{ns}</ns>\n    <id>1</id>\n    <revision>\n<id>1</id><timestamp>t</timestamp><text>{text}</text>\n</revision>\n  </page>\n"


def test_ingest_and_dissect(spark, tmp_path):
    folder, out = tmp_path / "dumps", str(tmp_path / "pages")
    folder.mkdir()
    (folder / "0.xml.bz2").write_bytes(bz2.compress(f"<mediawiki>{page('A', 'x [[Category:M]] [[B|b]]')}{page('C', 'y')}</mediawiki>".encode()))
    (tmp_path / "titles.csv").write_text("A\nB\n")
    titles = dump.read_titles(spark, str(tmp_path / "titles.csv"))
    assert [r.title for r in titles.orderBy("title").collect()] == ["A", "B"]
    jobs.ingest(spark, str(folder), titles, "mathematics", out)
    (folder / "1.xml.bz2").write_bytes(bz2.compress(f"<mediawiki>{page('A', 'changed')}{page('B', '== H ==')}</mediawiki>".encode()))
    jobs.ingest(spark, str(folder), titles, "physics", out)
    found = {r.title: (r.target, "changed" in r.full_raw_xml) for r in spark.read.parquet(out).collect()}
    assert found == {"A": ("mathematics", False), "B": ("physics", False)}
    rows = {r.title: r for r in spark.read.parquet(jobs.dissect(spark, out, str(tmp_path / "dissected"), 1)).collect()}
    assert rows["A"].parent_categories.parents == ["Category:M"] and "B" in rows["A"].clean_links and rows["A"].target == "mathematics"
    assert rows["B"].feature_union.startswith("B")


def test_library_texts(spark):
    rows = [("A", "0", "Some '''Words''' of {{a {{b}}}} 42 text, a x " + "word " * 60), ("B", "14", "word " * 60), ("C", "0", "few words")]
    got = jobs.library_texts(spark.createDataFrame(rows, "title string, ns string, text string")).collect()
    assert [r.title for r in got] == ["A"] and got[0].tokens[:5] == ["some", "words", "of", "text", "word"]


def test_reports_and_texts(spark, tmp_path):
    df = spark.createDataFrame([("a", "one\ntwo"), ("b", "nan"), ("c", None)], "k string, t string")
    sinks.write_text(df, "t", str(tmp_path / "t"))
    assert [r.value for r in spark.read.text(str(tmp_path / "t")).collect()] == ["one two"]
    sinks.write_tsv(df.select("k"), str(tmp_path / "r"))
    assert sorted(r.k for r in spark.read.csv(str(tmp_path / "r"), sep="\t", header=True).collect()) == ["a", "b", "c"]
    sinks.append_edges(spark.createDataFrame([("x", ["p"]), ("y", [])], "child string, parents array<string>"), str(tmp_path / "e"))
    assert [r.child for r in spark.read.parquet(str(tmp_path / "e")).collect()] == ["x"]


def test_markup_is_unnested_however_deep(spark):
    deep = "{{a " * 9 + "}}" * 9
    df = spark.createDataFrame([(f"x {deep}y {{| t {{| u |}} |}}z",), ("{{open",), (None,)], "t string")
    got = [r[0] for r in df.select(wikitext.remove_markup(F.col("t"))).collect()]
    assert got[0].split() == ["x", "y", "z"] and got[1] == "{{open" and got[2] is None
    assert wikitext.label is not None and spark.range(1).select(wikitext.label(F.lit("computer_science"))).head()[0] == "Computer Science"
    url = "/wiki/" + "a" * 2_000
    assert len(spark.range(1).select(wikitext.link_title(F.lit(url))).head()[0]) == 2_000
