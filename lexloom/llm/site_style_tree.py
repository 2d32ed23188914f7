"""Main text of web pages by a site style tree.

The DOM trees of a host's pages are merged: elements with the same path of tags and classes are one node of the tree.
A node keeps how its pages differ there: the sequences of children (presentation) and the texts (content). Presentation
that is the same on all pages, and texts that many pages repeat, have low entropy-based importance; a branch's
importance mixes its own and its children's. Extraction reads each page again with its host's importances:

* what HTML or a class name declares as no content (menus, page headers, footers, sidebars, notices, adverts, forms,
  scripts, styles, comments of readers) goes;
* branches of low importance go, everywhere on the page, and so do texts that most pages of the host repeat;
* an article is evidence beside it: inside one, less importance is enough; outside one, on a page that has one, only
  what the tree knows as important stays; lists of links outside of articles go.

Pages of a host with the same longest block are copies: they count once where a text's pages are counted, so an article
that was published again is no boilerplate.

The tree's statistics are counts of (host, node, feature), summed before the shuffle, so a hot host is never together
in one task. The importances come back to pages by a join on the host: broadcast if their table is at most
`BROADCAST_BYTES`, else shuffled; both sides are plain tables then, so adaptive execution splits a hot host's pages.
What a page carries is its host's nodes that at least `LEAST_PAGES` pages have: a site's templates, not its pages.

Defined cases: null or empty html has an empty text; a null url belongs to the host ''; broken markup is read as far
as it goes, open elements end with the page; repeated rows are pages of their own; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, text_chunks

#: Pages of a host from which a node's statistics count; share of a node's own importance; least importance that stays.
LEAST_PAGES, OWN, THRESHOLD = 4, 0.3, 0.3
#: Least importance that stays inside an article, and outside one on a page that has one.
INSIDE, OUTSIDE = 0.15, 0.6
#: Largest importance table that is broadcast.
BROADCAST_BYTES = 16 * 2**20
#: Hosts whose importances a task holds at once.
HOSTS = 256

# Fixed values of HTML: elements without an end tag, with raw text, that start a block, and that are no content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe template noembed noframes xmp svg object select canvas".split())
BLOCK = frozenset("address article noscript aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul caption".split())
ENDS_P = BLOCK - frozenset("td th tr tbody thead tfoot caption option optgroup legend summary body html head".split())
ENDS_OWN = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tbody", "thead", "tr"), "tfoot": ("tbody", "tr")}
SCOPE = frozenset("table ul ol dl div section article aside nav body html".split())
NO_CONTENT = frozenset("nav footer aside form button head dialog menu fieldset label datalist noscript".split())
NO_CONTENT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
NO_CONTENT_CLASSES = frozenset(
    "ad ads adv advert advertisement adverts adsense advertising banner sponsor sponsored promo promotion popup modal overlay cookie cookies consent gdpr notice notices notification alert "
    "nav navbar navigation menu menus breadcrumb breadcrumbs sidebar aside widget widgets footer header masthead topbar toolbar pagination pager share sharing social subscribe newsletter signup login "
    "search searchbox form comment comments commentlist reply replies respond disqus related recommended recommendations tags toc skip hidden copyright legal".split()
)
#: Words that say where or how something stands; a name made of them and of the words above is one of those.
NEUTRAL = frozenset("site page main top bottom left right inner outer wrapper wrap container box block area section bar list item items links link content text row col column head title desktop mobile fixed sticky primary secondary global local js c u l m o is has no the and of for".split())
ARTICLE_CLASSES = frozenset("article articlebody post postcontent entry entrycontent story storybody".split())

HEADINGS = frozenset("header masthead banner".split())
ARTICLE_WORDS = frozenset("article post entry story".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[(?P<cdata>.*?)\]\]>|<[!?][^>]*>?|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTR = re.compile(r"(class|id|role|hidden|itemprop|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_NAME = re.compile(r"[a-z]+")


@dataclass
class Element:
    """An open or closed element: its node in the tree, what it declares, and its blocks and children in order."""

    tag: str
    node: int
    dropped: bool  # declared as no content
    article: bool  # in an article
    declared: bool = False  # the article's own element
    named: bool = False  # declared by a class name only, which an element around the article may have as well
    children: list = field(default_factory=list)  # Element, or str for a block's text
    links: int = 0  # characters of link texts
    around: bool = False  # an article is in it


def _hash(*parts) -> int:
    return xxhash.xxh3_64_intdigest("\x1f".join(map(str, parts)).encode("utf-8", "surrogatepass")) - 2**63


def _names(attrs: str) -> tuple[str, set[str], set[str], bool]:
    """(class signature without digits, words of class and id, roles, whether hidden) of an element's attributes."""
    signature, words, roles, hidden = "", set(), set(), False
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name in ("class", "id"):
            for x in value.split():
                parts = _NAME.findall(x)
                words.add("".join(parts))
                # Only a name that says nothing else: "cookie-notice-top" is one, "legal-history" is not.
                if all(p in NO_CONTENT_CLASSES or p in ARTICLE_CLASSES or p in NEUTRAL for p in parts):
                    words.update(parts)
            if name == "class":
                signature = " ".join(sorted(re.sub(r"\d+", "", x) for x in value.split()))
        elif name == "role":
            roles.update(value.split())
        elif name == "itemprop":
            words.add(value)
        else:
            hidden |= name == "hidden" or value == "true"
    return signature, words, roles, hidden


def parse(html: str) -> Element:
    """The page's tree. Texts of a block are joined; white space in it is one blank; empty blocks are left out."""
    root = Element("", _hash("root"), False, False)
    stack, text = [root], []
    in_link = 0

    def flush() -> None:
        if text:
            block = " ".join("".join(text).split())
            text.clear()
            if block:
                holder = next(e for e in reversed(stack) if e.tag in BLOCK or not e.tag)
                holder.children.append(block)

    def close(upto: int) -> None:
        nonlocal in_link
        for e in stack[upto:]:
            in_link -= e.tag == "a"
        if any(e.tag in BLOCK for e in stack[upto:]):
            flush()
        del stack[upto:]

    at, end = 0, len(html)
    while at < end:
        m = _TOKEN.search(html, at)
        if m is None:
            text.append(unescape(html[at:]))
            break
        if m.start() > at:
            piece = unescape(html[at : m.start()])
            text.append(piece)
            if in_link > 0:
                next(e for e in reversed(stack) if e.tag in BLOCK or not e.tag).links += len(piece)
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if m["end"]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    close(i)
                    break
            continue
        attrs = m["attrs"]
        if tag == "br":
            text.append(" ")
            continue
        if tag in RAW and not attrs.endswith("/"):
            stop = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
            at = stop.end() if stop else end
            if tag in BLOCK:
                flush()
            continue
        if tag in BLOCK:
            flush()
        if tag in VOID:
            continue
        if tag in ENDS_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    close(i)
                    break
                if stack[i].tag in SCOPE:
                    break
        if tag in ENDS_OWN:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in ENDS_OWN[tag]:
                    close(i)
                elif stack[i].tag in SCOPE:
                    break
        if tag not in BLOCK:
            in_link += tag == "a"
            stack.append(Element(tag, stack[-1].node, False, stack[-1].article))
            continue
        signature, words, roles, hidden = _names(attrs) if attrs else ("", set(), set(), False)
        above = next(e for e in reversed(stack) if e.tag in BLOCK or not e.tag)
        declared = tag == "article" or tag == "main" or "main" in roles or "articlebody" in words or bool(words & ARTICLE_CLASSES)
        hard = tag in NO_CONTENT or tag == "header" and not above.article or bool(roles & NO_CONTENT_ROLES) or hidden
        # An article's own heading is part of it.
        named = bool(words & (NO_CONTENT_CLASSES - HEADINGS if above.article or words & ARTICLE_WORDS else NO_CONTENT_CLASSES))
        if tag in ("body", "html", "main"):
            hard, named = hidden, False
        declared = declared and not hard and not named
        e = Element(tag, _hash(above.node, tag, signature), hard or named, above.article or declared, declared, named and not hard)
        above.children.append(e)
        stack.append(e)
    flush()
    return root


def features(root: Element) -> Iterator[tuple[int, int, int]]:
    """(node, kind, feature) of a page: kind 0 the presentation of an element, kind 1 a block's text, kind 2 the node itself.

    Kind 3 has a text in place of the node, and the page's longest block; kind 4 that block alone.
    """
    todo, texts = [root], {}
    while todo:
        e = todo.pop()
        yield e.node, 2, 0
        style: list[str] = []
        for c in e.children:
            name = "text" if isinstance(c, str) else f"{c.tag}:{c.node}"
            if not style or style[-1] != name:
                style.append(name)
            if isinstance(c, str):
                texts[c] = _hash(c)
                yield e.node, 1, texts[c]
            else:
                todo.append(c)
        yield e.node, 0, _hash(*style)
    if texts:
        longest = texts[max(texts, key=lambda x: (len(x), x))]
        yield 0, 4, longest
        for x in texts.values():
            yield x, 3, longest


def importance(e: Element, own: dict[int, tuple[float, float]], out: dict[int, float]) -> float:
    """Importance of a branch: its presentation's by the share `OWN`, else the mean of its texts' and children's."""
    presentation, content = own.get(e.node, (1.0, 1.0))
    below = [content if isinstance(c, str) else importance(c, own, out) for c in e.children]
    e.around = any(c.declared or c.around for c in e.children if not isinstance(c, str))
    out[id(e)] = OWN * presentation + (1 - OWN) * sum(below) / len(below) if below else presentation
    return out[id(e)]


def _depth_limited(e: Element, limit: int = 400) -> None:
    """Folds elements below a nesting of `limit` into their ancestor there; the order of texts stays."""

    def texts(x: Element) -> Iterator[str]:
        todo = [x]
        while todo:
            y = todo.pop()
            if isinstance(y, str):
                yield y
            elif not y.dropped:
                todo.extend(reversed(y.children))

    level = [(e, 0)]
    while level:
        x, d = level.pop()
        if d >= limit:
            x.children = list(texts(x))
        else:
            level.extend((c, d + 1) for c in x.children if not isinstance(c, str))


def main_text(html: str | None, own: dict[int, tuple[float, float]], repeated: dict[int, float] | None = None) -> str:
    """The page's main text, its blocks joined by one blank. repeated: importances of texts that pages of the host repeat.

    Without `repeated` (None) the host has too few different pages to judge the inside of articles.
    """
    if not html:
        return ""
    root = parse(html)
    _depth_limited(root)
    found: dict[int, float] = {}
    importance(root, own, found)
    kept: list[str] = []

    def walk(e: Element) -> None:
        if e.dropped and not (e.named and e.around and not e.article):
            return
        known = e.node in own
        if e.article:
            least = INSIDE if repeated is not None else 0.0
        else:
            least = OUTSIDE if root.around else THRESHOLD
        # A branch goes as a whole if all of it is low; beside an article, what the tree does not know goes too.
        stays = found[id(e)] >= least and (e.article or not root.around or known)
        stays = stays and (e.article or e.links * 2 <= sum(len(x) for x in e.children if isinstance(x, str)))
        for c in e.children:
            if not isinstance(c, str):
                walk(c)
            elif stays and (not repeated or repeated.get(_hash(c), 1.0) >= least):
                kept.append(c)

    walk(root)
    return " ".join(kept)


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


def style_tree(pages: DataFrame) -> DataFrame:
    """host, nodes (array of node, presentation, content), texts (array of text, importance; null: few pages).

    Importances of the hosts' nodes that enough pages have, and of the texts that many of their different pages repeat.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches, "html"):
            counts: Counter = Counter()
            for host, html in zip(batch.column(0).to_pylist(), texts, strict=True):
                counts.update({(host, *f) for f in features(parse(html))} if html else ())
            rows = [(*k, n) for k, n in counts.items()]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), *[pa.array(c, pa.int64()) for c in columns[1:]]], names=["host", "node", "kind", "feature", "n"])

    counted = pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(run, "host string, node long, kind long, feature long, n long")
    each = stored(counted.groupBy("host", "node", "kind", "feature").agg(F.sum("n").alias("n")), "style-features")  # read three times
    of = lambda kind, x: F.sum(F.when(F.col("kind") == kind, x))
    node = each.where("kind < 3").groupBy("host", "node").agg(of(2, F.col("n")).alias("m"), of(0, F.col("n")).alias("p_n"), of(0, F.col("n") * F.log("n")).alias("p_ln"), of(1, F.lit(1)).alias("c_n"), of(1, F.log("n")).alias("c_ln"))
    scale = F.log("m")
    presentation = (F.log("p_n") - F.col("p_ln") / F.col("p_n")) / scale  # entropy of the children's sequences
    content = F.lit(1.0) - F.col("c_ln") / F.col("c_n") / scale  # one less the mean entropy of the texts over pages
    known = node.where(F.col("m") >= LEAST_PAGES).select("host", F.struct("node", F.coalesce(presentation, F.lit(1.0)).alias("presentation"), F.coalesce(content, F.lit(1.0)).alias("content")).alias("x"))
    pages_of = each.where("kind = 4").groupBy("host").agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= LEAST_PAGES)
    text = each.where("kind = 3").groupBy("host", "node").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_PAGES - 1)
    value = F.lit(1.0) - F.log("n") / F.log("pages")
    low = text.join(pages_of, "host").select("host", F.col("node").alias("text"), value.alias("importance")).where(F.col("importance") < OUTSIDE)
    texts = low.groupBy("host").agg(F.collect_list(F.struct("text", "importance")).alias("texts"))
    texts = pages_of.select("host").join(texts, "host", "left").select("host", F.coalesce("texts", F.array().cast("array<struct<text:long,importance:double>>")).alias("texts"))
    return known.groupBy("host").agg(F.collect_list("x").alias("nodes")).join(texts, "host", "left")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    tree = stored(style_tree(pages), "style-tree").withColumnRenamed("host", "t_host")
    size = tree.agg(F.sum(F.size("nodes") * 24 + F.coalesce(F.size("texts"), F.lit(0)) * 16 + F.length("t_host") + 32)).head()[0] or 0
    tree = F.broadcast(tree) if size <= BROADCAST_BYTES else tree
    plain = pages.select("page_id", "url", "html")
    joined = plain.join(tree, host_of(F.col("url")) == F.col("t_host"), "left").select("page_id", "url", "t_host", "nodes", "texts", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hosts: dict[str | None, tuple] = {}  # of a host's importances, read once for many of its pages

        def of(host: str | None, batch: pa.RecordBatch, i: int) -> tuple:
            if host not in hosts:
                if len(hosts) >= HOSTS:
                    hosts.clear()
                nodes, low = batch.column(3)[i].as_py(), batch.column(4)[i].as_py()
                hosts[host] = {x["node"]: (x["presentation"], x["content"]) for x in nodes or ()}, None if low is None else {x["text"]: x["importance"] for x in low}
            return hosts[host]

        for batch, texts in text_chunks(batches, "html"):
            names = batch.column(2).to_pylist()
            out = [main_text(html, *of(host, batch, i)) for i, (host, html) in enumerate(zip(names, texts, strict=True))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long")
