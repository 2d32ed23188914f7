"""Wiki markup as Column expressions: links, categories, headers, tags, and plain text.

All functions take and give Columns, stay in the JVM and use no look-around, so that patterns run in linear time. Only
nested marks, which no pattern can remove in linear time, are removed by one pass in an Arrow UDF (`nesting`).
Null markup gives null strings and null arrays unless stated.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .nesting import nested_marks_removed, templates_removed, templates_removed_each

# Markup patterns, the scrubbed characters, and the namespaces whose links are no article links.
CATEGORY = r"\[\[([cC]ategory:[^\]\[]*)\]\]"
CATEGORY_BRACKETED = r"\[\[Category:[^\]\[]*\]\]"
INTERLINK = r"(?d)\[{2}(.*?)\]{2}"
SIMPLE_LINK = r"\[([^\]\[]*)\|([^\]\[]*)\]"
TAG = r"(?s)<(.*?)>"
MATH = r"(?s)<math([> ].*?)(</math>|/>)"
NOWIKI = r"(?s)<nowiki([> ].*?)(</nowiki>|/>)"
EXTERNAL_LINK = r"\[(\w+):\/\/(.*?)(( (.*?))|())\]"
IMAGE = r"\[\[[iI]mage([^\]]*)\]\]"
FILE = r"\[\[[fF]ile:([^\]]*)\]\]"
SCRUBBED = '\n(),;[]":'
LINK_NAMESPACES = ("File:", "Category:", "Wikipedia:", "en:", "User:", "Template:", "User talk:", "Special:", "Project:", "WP:", "d:", "Image:")
LINK_NAMESPACES_SHORT = ("File:", "Category:", "Wikipedia:", "en:", "Image:")
REDIRECT = "#REDIRECT"


def strip(c: Column) -> Column:
    """Without white space at the sides, as Python's str.strip for ASCII white space."""
    return F.regexp_replace(c, r"^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def lstrip_lines(c: Column) -> Column:
    return F.regexp_replace(c, r"(?m)^[ \t\x0B\f\r]+", "")


def is_article(ns: Column, text: Column) -> Column:
    """A page of namespace 0 whose text nowhere has the redirect keyword (case counts); a page without text is one."""
    return (ns.cast("string") == "0") & ~F.contains(F.coalesce(text, F.lit("")), F.lit(REDIRECT))


def categories(c: Column) -> Column:
    """Category links without brackets; prefix and sort key stay."""
    return F.regexp_extract_all(c, F.lit(CATEGORY), F.lit(1))


def categories_bracketed(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(CATEGORY_BRACKETED), F.lit(0))


def without_categories(c: Column) -> Column:
    """Every category link replaced by a blank, so that no label leaks into the text."""
    return F.regexp_replace(c, CATEGORY, " ")


def interlinks(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(INTERLINK), F.lit(1))


def links(c: Column) -> Column:
    """Targets of interlinks: what stands before the first bar, # as a blank."""
    return F.transform(interlinks(c), lambda x: F.translate(F.substring_index(x, "|", 1), "#", " "))


def scrub(c: Column) -> Column:
    """Each punctuation mark of SCRUBBED as a blank."""
    return F.translate(c, SCRUBBED, " " * len(SCRUBBED))


def _without_namespaces(c: Column, names: tuple[str, ...]) -> Column:
    bad = F.array(*map(F.lit, names))
    return F.filter(c, lambda x: ~F.exists(bad, lambda b: F.contains(x, b)))


def clean_links(c: Column) -> Column:
    """Article links: targets without namespaces' links (substring test), entities and punctuation as blanks."""
    plain = F.transform(links(c), lambda x: F.replace(x, F.lit("(disambiguation)"), F.lit("")))
    kept = _without_namespaces(plain, LINK_NAMESPACES)
    return F.transform(kept, lambda x: scrub(strip(F.replace(x, F.lit("&amp;"), F.lit(" ")))))


def article_links(c: Column) -> Column:
    """Interlinks with their labels, without the short list of namespaces."""
    return _without_namespaces(interlinks(c), LINK_NAMESPACES_SHORT)


def headers(text: Column) -> Column:
    """Texts of lines that begin with an equals sign."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.startswith(x, F.lit("=")))
    plain = templates_removed_each(F.transform(lines, lambda x: F.replace(x, F.lit("="), F.lit(""))))
    return F.transform(plain, lambda x: scrub(strip(_without_code(x))))


def _pairs(c: Column, pattern: str, *names: str) -> Column:
    """An array of structs with a field for each group of the pattern. Each group is extracted once, not once for each match."""
    return F.arrays_zip(*[F.regexp_extract_all(c, F.lit(pattern), F.lit(i + 1)).alias(n) for i, n in enumerate(names)])


def math_tags(c: Column) -> Column:
    return _pairs(c, MATH, "body", "end")


def nowiki_tags(c: Column) -> Column:
    return _pairs(c, NOWIKI, "body", "end")


def tags(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(TAG), F.lit(1))


def simple_links(c: Column) -> Column:
    return _pairs(c, SIMPLE_LINK, "left", "right")


def external_links(c: Column) -> Column:
    return _pairs(c, EXTERNAL_LINK, "protocol", "address", "label")


def _description(c: Column, pattern: str) -> Column:
    """The last bar-separated part of the first image or file link ('' without one)."""
    return F.element_at(F.split(F.regexp_extract(c, pattern, 1), r"\|"), -1)


def image_description(c: Column) -> Column:
    return _description(c, IMAGE)


def file_description(c: Column) -> Column:
    return _description(c, FILE)


def without_prefixed_lines(c: Column, prefixes: tuple[str, ...] = ("[[Category:", "thumb")) -> Column:
    """Lines that begin with none of the prefixes."""
    keep = lambda x: ~F.exists(F.array(*map(F.lit, prefixes)), lambda p: F.startswith(x, p))
    return F.filter(F.split(c, "\n"), keep)


def remove_markup(c: Column) -> Column:
    """Text without comments, notes, tables and templates (however nested), media links, tags and link brackets."""
    c = F.regexp_replace(c, r"(?s)<!--.*?-->", "")
    c = F.regexp_replace(c, r"(?s)<ref([> ].*?)(</ref>|/>)", "")
    c = F.regexp_replace(c, r"(?s)<math([> ].*?)(</math>|/>)", " ")
    c = nested_marks_removed(c)
    c = without_categories(c)
    c = F.regexp_replace(c, r"\[\w+://[^ \]]*( [^\]]*)?\]", "$1")
    c = F.regexp_replace(c, r"\[\[[^\[\]|]*\|([^\[\]]*)\]\]", "$1")
    c = F.regexp_replace(c, r"\[\[([^\[\]]*)\]\]", "$1")
    return F.regexp_replace(c, r"(?s)<[^>]*>", "")


def strip_code(c: Column) -> Column:
    """Text without quote marks of bold and italics, link targets, tags and templates; entities as characters."""
    return _without_code(templates_removed(c))


def _without_code(c: Column) -> Column:
    c = F.regexp_replace(c, r"'{2,5}", "")
    c = F.regexp_replace(c, r"\[\[[^\[\]|]*\|([^\[\]]*)\]\]", "$1")
    c = F.regexp_replace(c, r"\[\[([^\[\]]*)\]\]", "$1")
    c = F.regexp_replace(c, r"\[\w+://[^ \]]* ?([^\]]*)\]", "$1")
    c = F.regexp_replace(c, r"(?s)<[^>]*>", "")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def feature_union(title: Column, text: Column, link_list: Column, header_list: Column) -> Column:
    """Title, text, links and headers as one text, in this order."""
    return F.concat_ws(" ", title, text, link_list, header_list)


def dissected(title: Column, raw_xml: Column, text: Column, timestamp: Column) -> dict[str, Column]:
    """The columns of a dissected article. Links and categories come from the escaped XML, the rest from its text."""
    parts = {"title": title, "clean_text": scrub(strip_code(remove_markup(without_categories(text)))), "timestamp": timestamp, "headers": headers(text), "clean_links": clean_links(raw_xml)}
    parts["parent_categories"] = F.struct(title.alias("child"), categories(raw_xml).alias("parents"))
    parts["feature_union"] = feature_union(title, parts["clean_text"], parts["clean_links"], parts["headers"])
    return parts


def link_title(url: Column) -> Column:
    """Title of an internal link: `/wiki/A_b` gives `A b`; other urls give null."""
    return F.when(F.startswith(url, F.lit("/wiki/")), F.translate(F.substr(url, F.lit(7)), "_", " "))


def unquoted(url: Column) -> Column:
    """Percent escapes decoded; plus signs stay, and a text with broken escapes stays as it is."""
    return F.coalesce(F.try_url_decode(F.replace(url, F.lit("+"), F.lit("%2B"))), url)


def label(target: Column) -> Column:
    """`computer_science` as `Computer Science`."""
    return F.initcap(F.translate(target, "_", " "))
