"""Registered queries of the engine's operators over the supplied tables, with DuckDB SQL for the same rows.

The tables hold no wiki markup, so both sides make the same markup of each document's whole text and columns; `lang`
stands for a target, and scores are a fixed function of the id.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import analyzer, wikitext
from ..operators import classify, communities, evaluate, frequencies, graph, split, vectorize, word_vectors
from ..sources import dump, sinks
from ..sources.shared import shared_folder, spread, stored

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents")


def _joined(c: Column) -> Column:
    return F.array_join(c, "¦")


#: Markup made of a text: pairs of words around a comma are links, first words of sentences categories, of lines headers.
_MARKS = ((r"([a-z]+), ([a-z]+)", "[[#1|#2]]"), (r"[.] ([A-Z][a-z]+)", ". [[Category:#1]]"), (r"\n([A-Z][a-z]*) ", "\n== #1 ==\n"))


def _marked(text: Column) -> Column:
    for pattern, new in _MARKS:
        text = F.regexp_replace(text, pattern, new.replace("#", "$"))
    return text


def _marked_sql(text: str) -> str:
    for pattern, new in _MARKS:
        new = new.replace("#", "\\").replace("\n", "' || chr(10) || '")
        text = f"regexp_replace({text}, '{pattern}', '{new}', 'g')"
    return text


# Markup of a text, behind one of each kind that is built from columns, in both dialects.
def _markup() -> Column:
    s, g, i = F.col("source"), F.col("lang"), F.col("doc_id").cast("string")
    return F.concat(
        F.lit("x [[Category:"), s, F.lit("|"), g, F.lit("]] [[category:"), g, F.lit("]] [["), s, F.lit("|label "), i, F.lit("]] [[File:"), g, F.lit(".png|thumb]] [[World: x]] [[A (disambiguation)#"), g,
        F.lit("]] [[R&amp;D, "), g, F.lit("]] <math>a_"), i, F.lit("</math> [a|b"), i, F.lit("]\n== History of "), g, F.lit(" ==\n="), s, F.lit("=\nplain\n ==no==\n[[Category:tail]]\nthumb line\n"), _marked(F.coalesce("text", F.lit(""))),
    )


_MARKUP = """'x [[Category:' || source || '|' || lang || ']] [[category:' || lang || ']] [[' || source || '|label ' || doc_id || ']] [[File:' || lang || '.png|thumb]] [[World: x]] [[A (disambiguation)#' || lang ||
 ']] [[R&amp;D, ' || lang || ']] <math>a_' || doc_id || '</math> [a|b' || doc_id || ']' || chr(10) || '== History of ' || lang || ' ==' || chr(10) || '=' || source || '=' || chr(10) || 'plain' || chr(10) || ' ==no==' || chr(10) || '[[Category:tail]]' || chr(10) || 'thumb line' || chr(10) || """ + _marked_sql("coalesce(text, '')")
_W = f"WITH wiki AS (SELECT doc_id, lang, source, {_MARKUP} AS m FROM documents)"
_LINKS = r"regexp_extract_all(m, '\[\[(.*?)\]\]', 1)"
_CATS = r"regexp_extract_all(m, '\[\[([cC]ategory:[^\]\[]*)\]\]', 1)"
_SCRUB = "translate({}, chr(10) || '(),;[]\":', '         ')"


def _wiki(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", "lang", "source", _markup().alias("m"))


# Scans, filters, joins, sinks.
@query("SELECT doc_id AS page_id, lang FROM documents WHERE (CASE WHEN lang = 'es' THEN '14' ELSE '0' END) = '0' AND NOT contains(CASE WHEN source = 'src3' THEN '#REDIRECT ' || text ELSE text END, '#REDIRECT')")
def scan_filter_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    ns = F.when(F.col("lang") == "es", "14").otherwise("0")
    text = F.when(F.col("source") == "src3", F.concat(F.lit("#REDIRECT "), "text")).otherwise(F.col("text"))
    return _docs(spark, sf_dir).where(wikitext.is_article(ns, text)).select(F.col("doc_id").alias("page_id"), "lang")


# Dumps: pages with the documents' markup as their text are written as compressed XML, and read back.
def _escaped(c: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(char), F.lit(entity))
    return c


def _dump_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = F.concat(
        F.lit("  <page>\n    <title>Page "), F.col("doc_id"), F.lit("</title>\n    <ns>"), F.when(F.col("lang") == "es", "14").otherwise("0"), F.lit("</ns>\n    <id>"), F.col("doc_id"),
        F.lit("</id>\n    <revision>\n      <id>1</id>\n      <timestamp>2018-07-20T00:00:00Z</timestamp>\n      <text xml:space=\"preserve\">"), _escaped(F.concat(F.when(F.col("source") == "src3", "#REDIRECT ").otherwise(""), "m")), F.lit("</text>\n    </revision>\n  </page>"),
    )
    folder = shared_folder(spark, "dump")
    _wiki(spark, sf_dir).select(page).write.option("compression", "gzip").text(folder)
    return dump.read_pages(spark, folder)


# Blanks at the beginning of lines go as a dump's lines are read.
_READ = r"regexp_replace(CASE WHEN source = 'src3' THEN '#REDIRECT ' ELSE '' END || m, '(?m)^[ \t\x0B\f\r]+', '', 'g')"


@query(f"{_W} SELECT 'Page ' || doc_id AS title, length(text) AS n_chars, md5(text) AS digest FROM (SELECT doc_id, lang, {_READ} AS text FROM wiki) WHERE (lang = 'es') IS NOT TRUE AND NOT contains(text, '#REDIRECT')")
def dump_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dump.articles(_dump_pages(spark, sf_dir)).select("title", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("digest"))


@query(f"{_W} SELECT 'Page ' || doc_id AS title, array_to_string({_CATS}, '¦') AS found FROM wiki")
def dump_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dump.edge_pages(_dump_pages(spark, sf_dir)).select("title", _joined(F.col("categories")).alias("found"))


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT item_id FROM benchmark)")
def semi_join_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    titles = _table(spark, sf_dir, "benchmark").select("item_id")
    return dump.with_titles(_docs(spark, sf_dir), titles, "doc_id").select("doc_id", "lang")


@query("SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def anti_insert_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.absent(_docs(spark, sf_dir), _table(spark, sf_dir, "labels"), ["doc_id"]).select("doc_id", "lang")


@query("SELECT source, lang, min(doc_id) AS doc_id FROM documents GROUP BY source, lang")
def dedupe_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.first_by(_docs(spark, sf_dir).select("source", "lang", "doc_id"), ["source", "lang"], ["doc_id"])


@query("SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS DISTINCT FROM 1")
def null_safe_not_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir).select("doc_id").join(_table(spark, sf_dir, "labels"), "doc_id", "left").withColumn("target", F.col("quality").cast("string"))
    return dump.target_rows(rows, "1", negate=True).select("doc_id", "quality")


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN NULL ELSE replace('A_b_' || page_id, '_', ' ') END AS title FROM pages")
def link_to_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.concat(F.when(F.col("page_id") % 3 == 0, "http://x/").otherwise("/wiki/"), F.lit("A_b_"), F.col("page_id").cast("string"))
    return _table(spark, sf_dir, "pages").select("page_id", wikitext.link_title(url).alias("title"))


@query("SELECT doc_id, CAST(doc_id % 6 AS INT) AS depth FROM documents WHERE doc_id % 6 < 3")
def depth_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.limit_depth(_docs(spark, sf_dir).select("doc_id", (F.col("doc_id") % 6).cast("int").alias("depth")), 3)


@query("SELECT doc_id, CAST(lang = 'en' AS INT) AS target FROM documents")
def binary_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", split.is_target(F.col("lang"), "en").alias("target"))


@query("SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS idx FROM documents")
def row_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.numbered(_docs(spark, sf_dir).select("doc_id"), "doc_id")


@query("SELECT d.doc_id, d.lang, CASE WHEN l.doc_id IS NULL THEN d.source ELSE 'labelled' END AS source, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def update_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = _table(spark, sf_dir, "labels").select("doc_id", F.lit("labelled").alias("source"), "toxic")
    return sinks.updated(_docs(spark, sf_dir).select("doc_id", "lang", "source"), changes, "doc_id")


@query("SELECT doc_id, {'idx': row_number() OVER (ORDER BY doc_id) - 1, 'target': CAST(lang = 'en' AS INT)}['idx'] AS idx, CAST(lang = 'en' AS INT) AS target FROM documents")
def indexed_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = split.numbered(_docs(spark, sf_dir).select("doc_id", "lang"), "doc_id")
    both = rows.withColumn("idx/target", F.struct("idx", split.is_target(F.col("lang"), "en").alias("target")))
    return both.select("doc_id", F.col("`idx/target`.idx").alias("idx"), F.col("`idx/target`.target").alias("target"))


@query("SELECT DISTINCT source AS title FROM documents UNION SELECT DISTINCT lang FROM documents")
def seed_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    return docs.select(F.col("source").alias("title")).union(docs.select("lang")).distinct()


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 5 = 1)")
def set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).select("doc_id", "lang")
    return docs.join(docs.where("doc_id % 5 = 1").select("doc_id"), "doc_id", "left_anti")


# Wiki markup.
@query(f"{_W} SELECT doc_id, array_to_string({_CATS}, '¦') AS found FROM wiki")
def category_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _wiki(spark, sf_dir).select("doc_id", _joined(wikitext.categories(F.col("m"))).alias("found"))


@query(rf"{_W} SELECT doc_id, array_to_string(regexp_extract_all(m, '\[\[Category:[^\]\[]*\]\]'), '¦') AS found FROM wiki")
def category_extract_bracketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _wiki(spark, sf_dir).select("doc_id", _joined(wikitext.categories_bracketed(F.col("m"))).alias("found"))


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _wiki(spark, sf_dir).select(F.col("doc_id").alias("title"), wikitext.categories(F.col("m")).alias("cats"))
    return graph.category_edges(pages, "title", "cats")


@query(f"{_W} SELECT doc_id AS child, unnest({_CATS}) AS parent FROM wiki")
def category_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir)


@query(f"{_W} SELECT doc_id AS child, array_to_string(list_sort(list_distinct({_CATS})), '¦') AS parents FROM wiki")
def adjacency_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.adjacency(_edges(spark, sf_dir)).select("child", _joined(F.col("parents")).alias("parents"))


@query(f"{_W} SELECT doc_id, array_to_string({_LINKS}, '¦') AS found FROM wiki")
def interlinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _wiki(spark, sf_dir).select("doc_id", _joined(wikitext.interlinks(F.col("m"))).alias("found"))


_NORMAL = f"list_transform({_LINKS}, lambda x: replace(split_part(x, '|', 1), '#', ' '))"
_BAD = "[{}]".format(", ".join(f"'{x}'" for x in wikitext.LINK_NAMESPACES))
_BAD_SHORT = "[{}]".format(", ".join(f"'{x}'" for x in wikitext.LINK_NAMESPACES_SHORT))


@query(f"{_W} SELECT doc_id, array_to_string({_NORMAL}, '¦') AS found FROM wiki")
def links_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _wiki(spark, sf_dir).select("doc_id", _joined(wikitext.links(F.col("m"))).alias("found"))


@query(f"{_W} SELECT doc_id, array_to_string(list_transform(list_filter(list_transform({_NORMAL}, lambda x: replace(x, '(disambiguation)', '')), lambda x: len(list_filter({_BAD}, lambda b: contains(x, b))) = 0), lambda x: {_SCRUB.format("trim(replace(x, '&amp;', ' '))")}), '¦') AS found FROM wiki")
def links_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _wiki(spark, sf_dir).select("doc_id", _joined(wikitext.clean_links(F.col("m"))).alias("found"))


@query(f"{_W} SELECT doc_id, array_to_string(list_filter({_LINKS}, lambda x: len(list_filter({_BAD_SHORT}, lambda b: contains(x, b))) = 0), '¦') AS found FROM wiki")
def article_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _wiki(spark, sf_dir).select("doc_id", _joined(wikitext.article_links(F.col("m"))).alias("found"))


@query(f"{_W} SELECT doc_id, array_to_string(list_transform(list_filter(string_split(m, chr(10)), lambda x: starts_with(x, '=')), lambda x: {_SCRUB.format("trim(replace(x, '=', ''))")}), '¦') AS found FROM wiki")
def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _wiki(spark, sf_dir).select("doc_id", _joined(wikitext.headers(F.col("m"))).alias("found"))


@query(f"SELECT doc_id, {_SCRUB.format('text')} AS scrubbed FROM documents")
def punct_scrub(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", wikitext.scrub(F.col("text")).alias("scrubbed"))


@query(rf"{_W} SELECT doc_id, regexp_replace(m, '\[\[([cC]ategory:[^\]\[]*)\]\]', ' ', 'g') AS stripped FROM wiki")
def category_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _wiki(spark, sf_dir).select("doc_id", wikitext.without_categories(F.col("m")).alias("stripped"))


@query(f"{_W} SELECT doc_id, array_to_string(regexp_extract_all(m, '(?s)<math([> ].*?)(</math>|/>)', 1), '¦') AS body, array_to_string(regexp_extract_all(m, '(?s)<math([> ].*?)(</math>|/>)', 2), '¦') AS ending FROM wiki")
def math_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _wiki(spark, sf_dir).select("doc_id", wikitext.math_tags(F.col("m")).alias("x"))
    return found.select("doc_id", _joined(F.col("x.body")).alias("body"), _joined(F.col("x.end")).alias("ending"))


@query(rf"{_W} SELECT doc_id, array_to_string(regexp_extract_all(m, '\[([^\]\[]*)\|([^\]\[]*)\]', 1), '¦') AS l, array_to_string(regexp_extract_all(m, '\[([^\]\[]*)\|([^\]\[]*)\]', 2), '¦') AS r FROM wiki")
def simplify_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _wiki(spark, sf_dir).select("doc_id", wikitext.simple_links(F.col("m")).alias("x"))
    return found.select("doc_id", _joined(F.col("x.left")).alias("l"), _joined(F.col("x.right")).alias("r"))


@query(f"{_W} SELECT doc_id, array_to_string(list_filter(string_split(m, chr(10)), lambda x: NOT starts_with(x, '[[Category:') AND NOT starts_with(x, 'thumb')), ' ') AS kept FROM wiki")
def line_prefix_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _wiki(spark, sf_dir).select("doc_id", F.array_join(wikitext.without_prefixed_lines(F.col("m")), " ").alias("kept"))


@query(f"{_W} SELECT doc_id, source || ' ' || lang || ' ' || array_to_string(list_concat({_NORMAL}, [lang, source]), ' ') AS joined FROM wiki")
def feature_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = wikitext.feature_union(F.col("source"), F.col("lang"), wikitext.links(F.col("m")), F.array("lang", "source"))
    return _wiki(spark, sf_dir).select("doc_id", both.alias("joined"))


@query("SELECT doc_id, 'C++ ' || lang || ' a+b é' AS decoded FROM documents")
def url_decode_plus(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.concat(F.lit("C%2B%2B%20"), F.col("lang"), F.lit("%20a+b%20%C3%A9"))
    return _docs(spark, sf_dir).select("doc_id", wikitext.unquoted(url).alias("decoded"))


# Text analysis.
_STOP = "[{}]".format(", ".join(f"'{w}'" for w in analyzer.STOP_WORDS))
_T = r"WITH t AS (SELECT doc_id, lang, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS a FROM documents)"
_S = f"{_T}, s AS (SELECT doc_id, lang, list_filter(a, lambda x: NOT list_contains({_STOP}, x)) AS w FROM t)"


def _level(k: int) -> str:
    return f"list_transform(range(1, greatest(len(w) - {k - 1}, 0) + 1), lambda i: array_to_string(w[i : i + {k - 1}], ' '))"


_G = f"{_S}, tf AS (SELECT doc_id, lang, gram, count(*) AS tf FROM (SELECT doc_id, lang, unnest(list_concat({_level(1)}, list_concat({_level(2)}, {_level(3)}))) AS gram FROM s) GROUP BY ALL)"
_V = f"{_G}, df AS (SELECT gram, count(*) AS df FROM tf GROUP BY gram), n AS (SELECT count(*) AS n FROM documents), band AS (SELECT gram, df, n FROM df, n WHERE df >= 5 AND df <= 0.5 * n), vocab AS (SELECT gram, df, log2(n * 1.0 / df) AS idf, row_number() OVER (ORDER BY df DESC, gram) - 1 AS term_id FROM band ORDER BY df DESC, gram LIMIT {vectorize.KEEP})"
_X = f"{_V}, raw AS (SELECT doc_id, lang, gram, term_id, tf, tf * idf AS r FROM tf JOIN vocab USING (gram)), x AS (SELECT doc_id, lang, gram, term_id, tf, r / sqrt(sum(r * r) OVER (PARTITION BY doc_id)) AS weight FROM raw)"


def _tf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyzer.grams(spread(_docs(spark, sf_dir).select("doc_id", "text")), "doc_id", "text", stemmed=False)


def _vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequencies.pruned_vocabulary(_words(spark, sf_dir), "words", _docs(spark, sf_dir).count())


def _words(spark: SparkSession, sf_dir: str, *keys: str, **more: Column) -> DataFrame:
    docs = spread(_docs(spark, sf_dir).withColumns(more).select(*keys, "text"))
    return docs.select(*keys, analyzer.gram_words(F.col("text"), stemmed=False).alias("words"))


def _weights(spark: SparkSession, sf_dir: str, *keys: str, **more: Column) -> tuple[DataFrame, DataFrame]:
    """The vocabulary, and its weights by term_id, with columns of the documents and more that are made of these."""
    keys = (*keys, *more)
    words = frequencies.packed(_words(spark, sf_dir, *keys, **more), "words", *keys)
    vocab = stored(frequencies.pruned_vocabulary(words, "words", _docs(spark, sf_dir).count()), "vocabulary")
    return vocab, frequencies.term_weights(words, "words", vocab, *keys)


@query(f"{_T} SELECT doc_id, len(a) AS n, array_to_string(a, ' ') AS found FROM t")
def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = analyzer.tokens(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", F.size(a).cast("long").alias("n"), F.array_join(a, " ").alias("found"))


@query(f"{_S} SELECT doc_id, len(w) AS n, array_to_string(w, ' ') AS kept FROM s")
def stop_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = analyzer.without_stop_words(analyzer.tokens(F.col("text")))
    return _docs(spark, sf_dir).select("doc_id", F.size(w).cast("long").alias("n"), F.array_join(w, " ").alias("kept"))


@query(f"{_S}, g AS (SELECT doc_id, list_concat({_level(1)}, list_concat({_level(2)}, {_level(3)})) AS g FROM s) SELECT doc_id, len(g) AS n, md5(array_to_string(g, '|')) AS digest FROM g")
def ngrams_123(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = analyzer.ngrams(F.col("w"), 3)
    rows = spread(_docs(spark, sf_dir).select("doc_id", "text")).select("doc_id", analyzer.without_stop_words(analyzer.tokens(F.col("text"))).alias("w")).select("doc_id", g.alias("g"))
    return rows.select("doc_id", F.size("g").cast("long").alias("n"), F.md5(F.array_join("g", "|")).alias("digest"))


@query(f"{_G} SELECT doc_id, gram, tf FROM tf")
def term_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tf(spark, sf_dir)


@query(f"{_G} SELECT gram, count(*) AS df FROM tf GROUP BY gram")
def doc_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorize.document_frequencies(_tf(spark, sf_dir))


@query(f"{_V} SELECT gram, df FROM band")
def vocab_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorize.vocabulary(vectorize.document_frequencies(_tf(spark, sf_dir)), _docs(spark, sf_dir).count(), keep=None).select("gram", "df")


@query(f"{_V} SELECT gram, df, CAST(term_id AS INT) AS term_id FROM vocab")
def vocab_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vocab(spark, sf_dir).select("gram", "df", "term_id")


@query(f"{_V} SELECT gram, round(idf, 6) AS idf FROM vocab")
def idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vocab(spark, sf_dir).select("gram", F.round("idf", 6).alias("idf"))


@query(f"{_V} SELECT doc_id, CAST(term_id AS INT) AS term_id, tf FROM tf JOIN vocab USING (gram)")
def doc2bow_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorize.bag_of_words(_tf(spark, sf_dir), _vocab(spark, sf_dir)).select("doc_id", "term_id", "tf")


@query(f"{_X} SELECT doc_id, gram, round(weight, 6) AS weight FROM x")
def tfidf_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocab, weights = _weights(spark, sf_dir, "doc_id")
    return vectorize.with_grams(weights, vocab).select("doc_id", "gram", F.round("weight", 6).alias("weight"))


@query(f"{_X} SELECT lang, gram, w FROM (SELECT lang, gram, round(sum(weight), 4) AS w, row_number() OVER (PARTITION BY lang ORDER BY round(sum(weight), 4) DESC, gram) AS k FROM x GROUP BY lang, gram) WHERE k <= 10")
def top_grams_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: tokens, stop words, n-grams, vocabulary and TF-IDF of all documents, and each language's top ten."""
    from pyspark.sql import Window

    vocab, weights = _weights(spark, sf_dir, "lang")
    by = weights.groupBy("lang", "term_id").agg(F.round(F.sum("weight"), 4).alias("w"))
    k = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("w"), "gram"))
    return vectorize.with_grams(by, vocab).withColumn("k", k).where(F.col("k") <= 10).select("lang", "gram", "w")


@query()
def stemmed_grams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyzer.grams(spread(_docs(spark, sf_dir).select("doc_id", "text")), "doc_id", "text", 3)


# Word vectors: terms in at least 20 documents, pairs at most two words apart, in both orders.
_PAIRS = f"{_S}, vocab AS (SELECT gram, row_number() OVER (ORDER BY df DESC, gram) - 1 AS term_id FROM (SELECT gram, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(w) AS gram FROM s) GROUP BY gram HAVING count(*) >= 20 AND count(*) <= 0.5 * (SELECT count(*) FROM documents)) ORDER BY df DESC, gram LIMIT {vectorize.KEEP}), tok AS (SELECT row, place, term_id FROM (SELECT row_number() OVER () AS row, w FROM s), unnest(w) WITH ORDINALITY AS x(gram, place) JOIN vocab USING (gram)), one AS (SELECT a.term_id AS i, b.term_id AS j FROM tok a JOIN tok b ON a.row = b.row AND b.place - a.place IN (1, 2)), n AS (SELECT i, j, count(*) AS n FROM (SELECT i, j FROM one UNION ALL SELECT j, i FROM one) GROUP BY i, j), s1 AS (SELECT i, sum(n) AS s FROM n GROUP BY i)"


@query(f"{_PAIRS} SELECT * FROM (SELECT n.i, n.j, CAST(n AS BIGINT) AS n, round(ln(n * (SELECT sum(s) FROM s1)::DOUBLE / a.s / b.s), 6) AS value FROM n JOIN s1 a ON a.i = n.i JOIN s1 b ON b.i = n.j) WHERE value > 0")
def ppmi_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often two terms stand near each other, and their positive pointwise mutual information."""
    docs = _docs(spark, sf_dir)
    words = frequencies.packed(_words(spark, sf_dir), "words")
    vocab = stored(frequencies.pruned_vocabulary(words, "words", docs.count(), n=1, no_below=20), "vocabulary")
    both = word_vectors.ppmi(word_vectors.cooccurrences(words, "words", vocab, window=2))
    return both.select("i", "j", "n", F.round("value", 6).alias("value")).where("value > 0")


# Splits.
@query("SELECT doc_id, lang, CASE WHEN row_number() OVER (PARTITION BY lang ORDER BY doc_id) <= floor(count(*) OVER (PARTITION BY lang) * 0.8) THEN 'train' ELSE 'test' END AS part FROM documents")
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.stratified_split(_docs(spark, sf_dir).select("doc_id", "lang"), "lang", "doc_id")


@query("SELECT doc_id, lang, CAST(least((row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) // greatest(count(*) OVER (PARTITION BY lang) // 5, 1), 4) AS INT) AS fold FROM documents")
def kfold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.k_folds(_docs(spark, sf_dir).select("doc_id", "lang"), "lang", "doc_id", 5)


# Evaluation.
_P = "WITH p AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS title, CAST(lang = 'en' AS DOUBLE) AS actual, (doc_id * 7919 % 1000003) / 1000003.0::DOUBLE AS predicted FROM documents)"
_ROC = f"{_P}, grp AS (SELECT predicted, sum(actual) AS pos, count(*) AS n FROM p GROUP BY predicted), pts AS (SELECT predicted AS threshold, sum(pos) OVER (ORDER BY predicted DESC) AS tp, sum(n - pos) OVER (ORDER BY predicted DESC) AS fp, sum(pos) OVER () AS ap, sum(n - pos) OVER () AS an, pos, n - pos AS neg FROM grp), roc AS (SELECT threshold, tp, fp, tp / ap AS tpr, fp / an AS fpr FROM pts UNION ALL SELECT NULL, 0, 0, 0, 0)"


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = (F.col("doc_id") * 7919 % 1000003) / F.lit(1000003.0)
    return _docs(spark, sf_dir).select("doc_id", F.col("doc_id").cast("string").alias("title"), (F.col("lang") == "en").cast("double").alias("actual"), score.alias("predicted"))


@query(f"{_P} SELECT round(-avg(actual * ln(greatest(least(predicted, 1 - 1e-15), 1e-15)) + (1 - actual) * ln(1 - greatest(least(predicted, 1 - 1e-15), 1e-15))), 6) AS log_loss FROM p")
def log_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.log_loss(_scored(spark, sf_dir)).select(F.round("log_loss", 6).alias("log_loss"))


@query(f"{_ROC} SELECT threshold, CAST(tp AS DOUBLE) AS tp, CAST(fp AS DOUBLE) AS fp, round(tpr, 9) AS tpr, round(fpr, 9) AS fpr FROM roc")
def roc_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.roc_points(_scored(spark, sf_dir)).select("threshold", "tp", "fp", F.round("tpr", 9).alias("tpr"), F.round("fpr", 9).alias("fpr"))


@query(f"{_ROC} SELECT round(sum(neg * (tp - pos / 2)) / (max(ap) * max(an)), 9) AS auc FROM pts")
def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.roc_auc(_scored(spark, sf_dir)).select(F.round("auc", 9).alias("auc"))


@query(f"{_ROC}, c AS (SELECT fpr, min(tpr) AS low, max(tpr) AS high FROM roc GROUP BY fpr), seg AS (SELECT fpr, high, lead(fpr) OVER (ORDER BY fpr) AS nf, lead(low) OVER (ORDER BY fpr) AS nl FROM c), g AS (SELECT i, i / 99.0::DOUBLE AS x FROM range(100) r(i)) SELECT round(x, 9) AS fpr, round(CASE WHEN i = 0 THEN 0 WHEN nf IS NULL THEN high ELSE high + (nl - high) / (nf - fpr) * (x - fpr) END, 6) AS tpr FROM g JOIN seg ON x >= fpr - 1e-11 AND (nf IS NULL OR x < nf - 1e-11)")
def roc_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.roc_grid(_scored(spark, sf_dir)).select(F.round("fpr", 9).alias("fpr"), F.round("tpr", 6).alias("tpr"))


@query(f"{_P}, th AS (SELECT i / 100.0::DOUBLE AS threshold FROM range(10, 90, 5) r(i)) SELECT threshold, count(*) FILTER (predicted <= threshold AND actual = 0) AS tn, count(*) FILTER (predicted > threshold AND actual = 0) AS fp, count(*) FILTER (predicted <= threshold AND actual = 1) AS fn, count(*) FILTER (predicted > threshold AND actual = 1) AS tp FROM p, th GROUP BY threshold")
def confusion_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.confusion_sweep(_scored(spark, sf_dir))


@query(f"{_P} SELECT round(count(*) FILTER (predicted > 0.2 AND actual = 1) / count(*) FILTER (predicted > 0.2), 9) AS precision, round(count(*) FILTER (predicted > 0.2 AND actual = 1) / count(*) FILTER (actual = 1), 9) AS recall FROM p")
def precision_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.precision_recall(_scored(spark, sf_dir), 0.2).select(F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))


_BUCKET = "CASE WHEN predicted > 0.2 THEN CASE WHEN actual = 1 THEN 'TP' ELSE 'FP' END WHEN actual = 1 THEN 'FN' ELSE 'TN' END"


@query(f"{_P} SELECT title, predicted, actual, predicted > 0.2 AS threshold_pred, {_BUCKET} AS bucket FROM p")
def confusion_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.with_buckets(_scored(spark, sf_dir), 0.2).select("title", "predicted", "actual", "threshold_pred", "bucket")


@query(f"{_P} SELECT title, predicted, actual, predicted > 0.2 AS threshold_pred FROM p WHERE {_BUCKET} = 'FP' ORDER BY predicted, title LIMIT 20")
def fp_titles_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty false positives of least score."""
    return evaluate.bucket_ends(_scored(spark, sf_dir), 0.2, "FP")


@query(f"{_P} SELECT title, predicted, actual, predicted > 0.2 AS threshold_pred FROM p WHERE {_BUCKET} = 'FP' ORDER BY predicted DESC, title DESC LIMIT 20")
def fp_titles_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty false positives of largest score."""
    return evaluate.bucket_ends(_scored(spark, sf_dir), 0.2, "FP", last=True)


@query(f"{_P} SELECT count(*) FILTER (predicted > 0.18) AS over_18, count(*) FILTER (predicted >= 0.2) AS from_20, count(*) AS n FROM p")
def threshold_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).agg(F.count_if(evaluate.over(0.18)).alias("over_18"), F.count_if(evaluate.over(0.2, inclusive=True)).alias("from_20"), F.count(F.lit(1)).alias("n"))


@query(f"{_P} SELECT round(count(*) FILTER (predicted > 0.18) / count(*) * 5800000, 3) AS articles FROM p")
def extrapolated_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).agg(F.round(F.count_if(evaluate.over(0.18)) / F.count(F.lit(1)) * 5800000, 3).alias("articles"))


@query("SELECT CAST(l_discount AS DOUBLE) AS c, score FROM (SELECT l_discount, round(avg(l_tax), 9) AS score FROM lineitem GROUP BY l_discount) ORDER BY score, c LIMIT 1")
def best_c_argmin(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_discount").alias("c")).agg(F.round(F.avg("l_tax"), 9).alias("score"))
    return evaluate.best_parameter(rows)


@query("WITH r AS (SELECT p_name AS term, p_retailprice AS coef, row_number() OVER (ORDER BY p_retailprice, p_name) - 1 AS rank, count(*) OVER () AS n FROM (SELECT p_name, max(p_retailprice) AS p_retailprice FROM part GROUP BY p_name)) SELECT term, coef, CAST(rank AS INT) AS rank, part FROM (SELECT *, CASE WHEN rank < 5 THEN 'bottom' WHEN rank >= n - 5 THEN 'top' WHEN rank >= n // 2 - 5 AND rank < n // 2 + 5 THEN 'middle' END AS part FROM r) WHERE part IS NOT NULL")
def coef_rank_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("term")).agg(F.max("p_retailprice").alias("coef"))
    return evaluate.importance_slices(rows)


# Graphs: regions, nations, customers and orders as a category tree, with links back that make cycles.
_E = "WITH RECURSIVE e AS (SELECT 'root' AS parent, 'r' || r_regionkey AS child FROM region UNION ALL SELECT 'r' || n_regionkey, 'n' || n_nationkey FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION ALL SELECT 'c' || c_custkey, 'r' || (c_custkey % 5) FROM customer WHERE c_custkey % 7 = 0 UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders)"
_B = f"{_E}, walk AS (SELECT 'root' AS url, 0 AS depth UNION SELECT e.child, walk.depth + 1 FROM walk JOIN e ON e.parent = walk.url WHERE walk.depth < 4), tree AS (SELECT url, CAST(min(depth) AS INT) AS depth FROM walk GROUP BY url)"


def _tree_edges(spark: SparkSession, sf_dir: str, orders: bool = True) -> DataFrame:
    t = lambda n: _table(spark, sf_dir, n)
    name = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    customer = t("customer")
    parts = [
        t("region").select(F.lit("root").alias("parent"), name("r", F.col("r_regionkey")).alias("child")),
        t("nation").select(name("r", F.col("n_regionkey")), name("n", F.col("n_nationkey"))),
        customer.select(name("n", F.col("c_nationkey")), name("c", F.col("c_custkey"))),
        customer.where("c_custkey % 7 = 0").select(name("c", F.col("c_custkey")), name("r", F.col("c_custkey") % 5)),
    ]
    if orders:
        parts.append(t("orders").select(name("c", F.col("o_custkey")), name("o", F.col("o_orderkey"))))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


@query(f"{_B} SELECT url, depth FROM tree")
def bfs_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.levels(_tree_edges(spark, sf_dir), "root", 4)


@query(f"{_B} SELECT depth, count(*) AS n, CAST(sum(count(*)) OVER (ORDER BY depth) AS BIGINT) AS upto FROM tree GROUP BY depth")
def depth_cumulative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.depth_counts(graph.levels(_tree_edges(spark, sf_dir), "root", 4))


@query(f"{_B} SELECT l.depth, l.links - coalesce(f.fresh, 0) AS repeats FROM (SELECT tree.depth, count(*) AS links FROM tree JOIN e ON e.parent = tree.url GROUP BY tree.depth) l LEFT JOIN (SELECT depth - 1 AS depth, count(*) AS fresh FROM tree GROUP BY depth) f USING (depth)")
def repeated_link_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _tree_edges(spark, sf_dir)
    return graph.repeated_links(edges, graph.levels(edges, "root", 4))


@query(f"{_E.split(' UNION ALL SELECT ' + chr(39) + 'c' + chr(39) + ' || o_custkey')[0]}), reach AS (SELECT parent AS a, child AS b, 1 AS k FROM e UNION SELECT reach.a, e.child, reach.k + 1 FROM reach JOIN e ON e.parent = reach.b WHERE reach.k < 3) SELECT DISTINCT a AS node FROM reach WHERE a = b")
def cycle_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.in_cycles(_tree_edges(spark, sf_dir, orders=False), 3)


# Components: walks only between nodes that have children, since what has none is in no cycle.
_INNER = f"{_E}, n AS (SELECT parent AS node FROM e UNION SELECT child FROM e), i AS (SELECT DISTINCT e.parent, e.child FROM e WHERE e.child IN (SELECT parent FROM e)), reach AS (SELECT parent AS a, child AS b FROM i UNION SELECT reach.a, i.child FROM reach JOIN i ON i.parent = reach.b)"


@query(f"{_INNER}, scc AS (SELECT x.a AS node, min(x.b) AS least FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a GROUP BY x.a) SELECT node, least(node, coalesce(least, node)) AS component FROM n LEFT JOIN scc USING (node)")
def scc_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongly connected component of every node, orders' too."""
    return graph.components(_tree_edges(spark, sf_dir))


@query(f"{_INNER} SELECT DISTINCT a AS node FROM reach WHERE a = b")
def cycle_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes that reach themselves, however long the way."""
    return graph.in_cycles(_tree_edges(spark, sf_dir))


# Typed links: nations and suppliers are parts, regions are subclasses in cycles, customers are instances, parts have subjects.
_TYPED = """WITH RECURSIVE link AS (
 SELECT 'n' || n_nationkey AS item, 'part' AS relation, 'r' || n_regionkey AS "to" FROM nation UNION ALL SELECT 's' || s_suppkey, 'part', 'n' || s_nationkey FROM supplier
 UNION ALL SELECT 'r' || r_regionkey, 'subclass', 'r' || (r_regionkey * 2 % 5) FROM region UNION ALL SELECT 'n' || n_nationkey, 'subclass', 'r' || n_regionkey FROM nation
 UNION ALL SELECT 'c' || c_custkey, 'instance', 'n' || c_nationkey FROM customer UNION ALL SELECT 'p' || p_partkey, 'subject', 'r' || (p_size % 5) FROM part),
 article AS (SELECT 'c' || c_custkey AS item, c_name AS article FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT 's' || s_suppkey, s_name FROM supplier),
 part AS (SELECT 'r1' AS item UNION SELECT link.item FROM part JOIN link ON link."to" = part.item AND relation = 'part'),
 sub AS (SELECT 'r1' AS item UNION SELECT link.item FROM sub JOIN link ON link."to" = sub.item AND relation = 'subclass'),
 sub0 AS (SELECT 'r0' AS item UNION SELECT link.item FROM sub0 JOIN link ON link."to" = sub0.item AND relation = 'subclass'),
 items AS (SELECT item FROM part UNION SELECT item FROM link WHERE relation = 'part' AND "to" IN (SELECT item FROM sub)
  UNION SELECT item FROM link WHERE relation = 'instance' AND "to" IN (SELECT item FROM sub0) UNION SELECT item FROM link WHERE relation = 'subject' AND "to" IN (SELECT item FROM sub))
"""


def _typed_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: _table(spark, sf_dir, n)
    link = lambda a, k, relation, b, to: (F.concat(F.lit(a), F.col(k).cast("string")).alias("item"), F.lit(relation).alias("relation"), F.concat(F.lit(b), to.cast("string")).alias("to"))
    parts = [
        t("nation").select(*link("n", "n_nationkey", "part", "r", F.col("n_regionkey"))),
        t("supplier").select(*link("s", "s_suppkey", "part", "n", F.col("s_nationkey"))),
        t("region").select(*link("r", "r_regionkey", "subclass", "r", F.col("r_regionkey") * 2 % 5)),
        t("nation").select(*link("n", "n_nationkey", "subclass", "r", F.col("n_regionkey"))),
        t("customer").select(*link("c", "c_custkey", "instance", "n", F.col("c_nationkey"))),
        t("part").select(*link("p", "p_partkey", "subject", "r", F.col("p_size") % 5)),
    ]
    return functools.reduce(DataFrame.union, parts)


@query(f'{_TYPED} SELECT DISTINCT items.item, article, l."to" AS link_to FROM items LEFT JOIN article USING (item) LEFT JOIN link l ON l.item = items.item AND l.relation = \'part\'')
def topic_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of a topic by four kinds of paths, with their articles and what they are part of, where they have any."""
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string")).alias("item")
    articles = _table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(name("c", "c_custkey"), F.col("c_name").alias("article")).union(_table(spark, sf_dir, "supplier").select(name("s", "s_suppkey"), "s_name"))
    at = lambda x: spark.range(1).select(F.lit(x).alias("item"))
    branches = [(None, "part", at("r1")), ("part", "subclass", at("r1")), ("instance", "subclass", at("r0")), ("subject", "subclass", at("r1"))]
    return graph.topic_items(_typed_links(spark, sf_dir), branches, articles, "part")


# Weights: each step of the recursion adds up what all nodes pass on; after 40 steps less than 1e-8 is left here.
@query(f"{_E}, l AS (SELECT DISTINCT parent, child FROM e), fan AS (SELECT parent, count(*) AS k FROM l GROUP BY parent), walk AS (SELECT 'root' AS node, 0.15::DOUBLE AS w, 0 AS step UNION ALL SELECT l.child, sum(walk.w * 0.85 / k), walk.step + 1 FROM walk JOIN fan ON fan.parent = walk.node JOIN l ON l.parent = walk.node WHERE step < 40 GROUP BY l.child, walk.step), n AS (SELECT parent AS node FROM e UNION SELECT child FROM e) SELECT node, round(coalesce(sum(w), 0), 6) AS weight FROM n LEFT JOIN walk USING (node) GROUP BY node")
def depth_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of the root's weight comes down to each node."""
    roots = spark.range(1).select(F.lit("root").alias("node"))
    weights = graph.depth_weights(_tree_edges(spark, sf_dir), roots, tolerance=1e-7)
    return weights.select("node", F.round("weight", 6).alias("weight"))


# Communities: suppliers and parts, linked by their line items.
def _trade_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    edges = _table(spark, sf_dir, "lineitem").select(name("s", "l_suppkey").alias("parent"), name("p", "l_partkey").alias("child"))
    return stored(communities.undirected(edges), "trade-links")


@query("WITH l AS (SELECT l_partkey % 10 AS a, l_suppkey % 10 AS b, count(*) AS w FROM lineitem GROUP BY ALL), d AS (SELECT g, sum(w) AS d FROM (SELECT a AS g, w FROM l UNION ALL SELECT b, w FROM l) GROUP BY g), m AS (SELECT sum(w)::DOUBLE AS m, sum(w) FILTER (a = b)::DOUBLE AS inside FROM l) SELECT round((SELECT inside / m FROM m) - sum((d / (2 * (SELECT m FROM m))) ** 2), 9) AS modularity FROM d")
def partition_modularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The modularity of suppliers and parts dealt to ten groups by their keys."""
    links = _trade_links(spark, sf_dir)
    nodes = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    members = nodes.withColumn("community", F.substring("node", 2, 20).cast("long") % 10)
    value = communities.modularity(links, members)
    return spark.range(1).select(F.round(F.lit(value), 9).alias("modularity"))


@query()
def louvain_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each tree node's community at the last level, with the level's modularity."""
    last = communities.louvain(communities.undirected(_tree_edges(spark, sf_dir)))[-1]
    return last.members.withColumn("modularity", F.lit(last.modularity))


# Classifiers.
_NB = f"{_X}, lab AS (SELECT doc_id, CAST(lang = 'en' AS INT) AS label FROM documents), prior AS (SELECT label, ln(count(*) * 1.0 / (SELECT count(*) FROM lab)) AS log_prior FROM lab GROUP BY label), mass AS (SELECT label, term_id, sum(weight) AS w FROM x JOIN lab USING (doc_id) GROUP BY label, term_id), total AS (SELECT label, sum(w) AS total FROM mass GROUP BY label), lik AS (SELECT p.label, v.term_id, ln((coalesce(w, 0) + 1) / (coalesce(total, 0) + (SELECT count(*) FROM vocab))) AS ll FROM prior p CROSS JOIN vocab v LEFT JOIN mass m ON m.label = p.label AND m.term_id = v.term_id LEFT JOIN total t ON t.label = p.label)"


def _bayes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    label = split.is_target(F.col("lang"), "en")
    vocab, weights = _weights(spark, sf_dir, "doc_id", label=label)
    weights = stored(weights, "weights")
    labels = _docs(spark, sf_dir).select("doc_id", label.alias("label"))
    return weights, labels, *classify.naive_bayes(weights, labels, vocab, "doc_id")


@query(f"{_NB} SELECT label, CAST(term_id AS INT) AS term_id, round(ll, 6) AS log_likelihood, round(log_prior, 6) AS log_prior FROM lik JOIN prior USING (label)")
def nb_priors_and_loglik(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, priors, likelihoods = _bayes(spark, sf_dir)
    return likelihoods.join(priors, "label").select("label", "term_id", F.round("log_likelihood", 6).alias("log_likelihood"), F.round("log_prior", 6).alias("log_prior"))


@query(f"{_NB}, sc AS (SELECT l.doc_id, p.label, p.log_prior + coalesce(sum(x.weight * lik.ll), 0) AS s FROM lab l CROSS JOIN prior p LEFT JOIN x ON x.doc_id = l.doc_id LEFT JOIN lik ON lik.label = p.label AND lik.term_id = x.term_id GROUP BY l.doc_id, p.label, p.log_prior) SELECT doc_id, round(1 / (1 + exp(max(s) FILTER (label = 0) - max(s) FILTER (label = 1))), 6) AS predicted FROM sc GROUP BY doc_id")
def nb_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights, labels, priors, likelihoods = _bayes(spark, sf_dir)
    return classify.naive_bayes_scores(weights, labels, priors, likelihoods, "doc_id").select("doc_id", F.round("predicted", 6).alias("predicted"))


def _training(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(_docs(spark, sf_dir).select("doc_id", "text", F.col("lang").alias("target")))


@query()
def lr_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pipeline import fit_with_features

    model, docs = fit_with_features(_training(spark, sf_dir), "fr", 1.0, "doc_id")
    return model.scored(docs).select("doc_id", "predicted")


@query()
def lr_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pipeline import train

    return train(_training(spark, sf_dir), "fr").grid


@query()
def deploy_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pipeline import fit_with_features

    model, docs = fit_with_features(_training(spark, sf_dir), "fr", 1.0, "doc_id")
    return model.predictions(docs, 0.2, title="doc_id")
