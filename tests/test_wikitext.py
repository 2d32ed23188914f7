import bz2

import pytest
from pyspark.sql import functions as F

from lexloom.functions import analyzer, wikitext
from lexloom.functions.porter2 import stem
from lexloom.operators import graph
from lexloom.sources import dump, sinks

MARKUP = "x [[Category:Algebra|*]] [[category:Groups]] [[a|b]] [[c#d]]"


def values(spark, column, text, kind="string"):
    return spark.createDataFrame([(text,)], f"x {kind}").select(column(F.col("x")).alias("y")).head()[0]


def test_article_filter(spark):
    rows = [("Group theory", "0", "normal"), ("Redir", "0", "#REDIRECT [[Group theory]]"), ("redir2", "0", "#redirect [[X]]"), ("About it", "0", "the #REDIRECT keyword"), ("Category:Algebra", "14", "text"), ("Empty", "0", None)]
    df = spark.createDataFrame(rows, "title string, ns string, text string")
    assert {r[0] for r in df.where(wikitext.is_article(F.col("ns"), F.col("text"))).collect()} == {"Group theory", "redir2", "Empty"}


@pytest.mark.parametrize(
    ("column", "expected"),
    [
        (wikitext.categories, ["Category:Algebra|*", "category:Groups"]),
        (wikitext.categories_bracketed, ["[[Category:Algebra|*]]"]),
        (wikitext.interlinks, ["Category:Algebra|*", "category:Groups", "a|b", "c#d"]),
        (wikitext.links, ["Category:Algebra", "category:Groups", "a", "c d"]),
        (wikitext.clean_links, ["category Groups", "a", "c d"]),
        (wikitext.without_categories, "x     [[a|b]] [[c#d]]"),
    ],
)
def test_markup(spark, column, expected):
    assert values(spark, column, MARKUP) == expected


def test_links_and_headers(spark):
    assert values(spark, wikitext.clean_links, "[[World: x]] [[Men: y]] [[A (disambiguation)]] [[R&amp;D]]") == ["A", "R D"]
    assert values(spark, wikitext.headers, "== History ==\n=x=\nplain\n ==no==") == ["History", "x"]
    assert values(spark, wikitext.link_title, "/wiki/A_b") == "A b"
    assert values(spark, wikitext.link_title, "http://x") is None
    for url, text in (("/wiki/C%2B%2B_a", "/wiki/C++_a"), ("/wiki/a+b", "/wiki/a+b"), ("/wiki/100%", "/wiki/100%")):
        assert values(spark, wikitext.unquoted, url) == text


def test_descriptions_and_tags(spark):
    assert values(spark, wikitext.image_description, "[[Image:a.png|thumb|A cat]]") == "A cat"
    assert values(spark, wikitext.file_description, "[[File:a.png|thumb|A dog]]") == "A dog"
    assert values(spark, wikitext.math_tags, "<math>a\nb</math>")[0].body == ">a\nb"
    assert values(spark, wikitext.simple_links, "[a|b] [c|d]")[1].right == "d"
    assert values(spark, wikitext.remove_markup, "a {{x {{y}} z}} [[b|c]] <!-- n --> [http://u t] <b>d</b>").split() == ["a", "c", "t", "d"]
    assert values(spark, wikitext.strip_code, "'''a''' [[b|c]] &lt;").split() == ["a", "c", "<"]


@pytest.mark.parametrize(("word", "expected"), [("summing", "sum"), ("algebraic", "algebra"), ("skies", "sky"), ("dying", "die"), ("generously", "generous"), ("hopping", "hop"), ("hoping", "hope"), ("relational", "relat"), ("conditional", "condit"), ("happy", "happi"), ("say", "say"), ("cries", "cri"), ("ties", "tie"), ("The", "the"), ("national", "nation"), ("controlling", "control"), ("knackeries", "knackeri"), ("by", "by")])
def test_stems(word, expected):
    assert stem(word) == expected


def test_analyzer(spark):
    words = lambda c: analyzer.without_stop_words(analyzer.tokens(c))
    assert values(spark, lambda c: analyzer.ngrams(words(c)), "The cat and the  hat.") == ["The", "cat", "hat.", "The cat", "cat hat.", "The cat hat."]
    assert len(values(spark, lambda c: analyzer.ngrams(analyzer.tokens(c)), "I love spam but not ham")) == 15
    for text, n in (("", 0), (None, 0), ("a", 1), ("a b", 3)):
        assert len(values(spark, lambda c: analyzer.ngrams(analyzer.tokens(c)), text)) == n
    assert values(spark, analyzer.tokens, "a b c\u0085d\x1ce​f") == ["a", "b", "c", "d", "e​f"]
    assert len(set(analyzer.STOP_WORDS)) == 318
    docs = spark.createDataFrame([(1, "summing The sums"), (2, None)], "id long, t string")
    assert {tuple(r) for r in analyzer.grams(docs, "id", "t", 2).collect()} == {(1, "sum", 2), (1, "the", 1), (1, "sum the", 1), (1, "the sum", 1)}


PAGES = """<mediawiki>
  <page>
    <title>1729</title>
    <ns>0</ns>
    <id>7</id>
    <revision><id>9</id><timestamp>2018-07-20T00:00:00Z</timestamp><text>A [[b|c]] &lt;math&gt;x&lt;/math&gt; [[Category:N]]</text></revision>
  </page>
  <page>
    <title>Old</title>
    <ns>0</ns>
    <id>8</id>
    <redirect title="1729" />
    <revision><id>3</id><timestamp>t</timestamp><text>#REDIRECT [[1729]]</text></revision>
  </page>
</mediawiki>
"""


def test_dump(spark, tmp_path):
    (tmp_path / "d.xml.bz2").write_bytes(bz2.compress(PAGES.encode()))
    pages = dump.read_pages(spark, str(tmp_path / "d.xml.bz2"))
    assert pages.count() == 2
    row = dump.articles(pages).head()
    assert (row.title, row.page_id, row.timestamp) == ("1729", 7, "2018-07-20T00:00:00Z") and "<math>x</math>" in row.text
    assert dump.edge_pages(pages).collect()[0].categories == ["Category:N"]
    d = dump.dissected_pages(dump.articles(pages)).head()
    assert d.parent_categories.parents == ["Category:N"] and "Category" not in d.clean_text and d.clean_links == ["b"]
    long = dump.long_pages(pages, "mathematics").where("title = '1729'").head()
    assert long.target == "mathematics" and long.interlinks == ["b|c", "Category:N"] and long.id_ == "7"
    assert dump.lines(spark, str(tmp_path / "d.xml.bz2"), 3).count() == 3
    titles = spark.createDataFrame([("Old",), (None,)], "t string")
    assert [r.title for r in dump.with_titles(pages, titles).collect()] == ["Old"]


def test_trees_and_sinks(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("url\tdepth\n/wiki/A_\"b\"\t0\nhttp://x\t1\n")
    tree = dump.clean_tree(dump.read_tree(spark, str(tmp_path / "t.tsv")))
    assert [tuple(r) for r in tree.orderBy("depth").collect()] == [('/wiki/A_"b"', 'A "b"', 0), ("http://x", None, 1)]
    depths = spark.createDataFrame([(str(i), i) for i in range(5)], "url string, depth int")
    assert graph.limit_depth(depths, 3).count() == 3 and graph.limit_depth(depths, 4).count() == 4
    with pytest.raises(ValueError):
        graph.limit_depth(depths, 5)
    path = str(tmp_path / "c")
    rows = lambda *x: spark.createDataFrame(list(x), "title string, v int")
    sinks.insert_if_absent(rows(("a", 1)), path, ["title"], ["v"])
    sinks.insert_if_absent(rows(("a", 2), ("b", 3), ("b", 4)), path, ["title"], ["v"])
    assert {tuple(r) for r in spark.read.parquet(path).collect()} == {("a", 1), ("b", 3)}
    out = sinks.updated(rows(("a", 1), ("b", 2)), spark.createDataFrame([("b", 9, "n")], "title string, v int, w string"), "title")
    assert {tuple(r) for r in out.collect()} == {("a", 1, None), ("b", 9, "n")}
    targets = spark.createDataFrame([("m",), ("x",), (None,)], "target string")
    assert dump.target_rows(targets, "m", negate=True).count() == 2
    with pytest.raises(ValueError):
        dump.require_target(targets, "y")


def test_nested_marks_are_removed_as_by_repeated_passes():
    import random
    import re
    import time

    from lexloom.functions import nesting

    def repeated(pattern, text):
        while (new := re.sub(pattern, " ", text)) != text:
            text = new
        return text

    draw = random.Random(3)
    for _ in range(20_000):
        text = "".join(draw.choices(["{{", "}}", "{|", "|}", "{", "}", "|", "a"], k=draw.randint(1, 18)))
        assert nesting.without_templates(text) == repeated(r"\{\{[^{}]*\}\}", text)
        assert nesting.without_tables(text) == repeated(r"\{\|[^{}]*\|\}", text)
    for text, left in (("a [[File:x.png|thumb|see [[b|c]] and [http://u t]]] z", "a  z"), ("[[[File:a]]]", "[]"), ("[[File:a [[Image:b]] c", "[[File:a  c"), ("x [[b]] [[File:a|[[b [[c]]]]]] y", "x [[b]]  y"), ("[x] [[File:a|[y]", "[x] [[File:a|[y]")):
        assert nesting.without_file_links(text) == left
    for text in ("{{x " * 500_000, "{{x " * 250_000 + "{{y}}", "{{a " * 250_000 + "}}" * 250_000, "{|a " * 300_000 + "|}" * 300_000, "[[File:" * 250_000 + "]]", "[" * 2_000_000 + "]]"):
        began = time.time()
        nesting.without_nested_marks(text)
        assert time.time() - began < 10  # a quadratic scan of 2 MB takes hours
