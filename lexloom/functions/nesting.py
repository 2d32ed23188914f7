"""Removal of balanced, nested marks from texts in one pass: templates, tables and links to files.

A template is `{{`, text without braces, `}}`; a table is `{|`, text without braces, `|}`. Taking away the innermost
ones leaves blanks, and then the next ones are innermost, until none is left. No two innermost ones overlap, so the
order in which they go does not matter, and a stack of the braces seen so far finds each as soon as it ends: every
brace is pushed and popped once, so time grows with the text, however deep and however unbalanced its marks are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

_BRACES, _BRACKET = re.compile(r"[{}]"), re.compile(r"[\[\]]")
_FILE, _PLAIN_FILE = re.compile(r"\[\[(?:[iI]mage|[fF]ile):"), re.compile(r"\[\[(?:[iI]mage|[fF]ile):[^\[\]]*\]\]")


class _Cuts:
    """Ranges that are taken out of a text; a range takes in those that are inside it."""

    def __init__(self):
        self.ranges: list[tuple[int, int]] = []

    def add(self, start: int, stop: int) -> None:
        while self.ranges and self.ranges[-1][0] >= start:
            self.ranges.pop()
        self.ranges.append((start, stop))

    def apply(self, text: str, instead: str) -> str:
        out, at = [], 0
        for start, stop in self.ranges:
            out += (text[at:start], instead)
            at = stop
        return "".join(out) + text[at:]


def without_templates(text: str) -> str:
    """Text with a blank for each template, however nested."""
    if "{{" not in text or "}}" not in text:
        return text
    cuts, stack = _Cuts(), []
    for match in _BRACES.finditer(text):
        at = match.start()
        if text[at] == "}" and len(stack) > 2:
            first, second, third = stack[-3:]
            # `{{` and `}` next to each other where they stand in the text, and nothing but removed marks between.
            if third == at - 1 and text[third] == "}" and second == first + 1 and text[first] == text[second] == "{":
                del stack[-3:]
                cuts.add(first, at + 1)
                continue
        stack.append(at)
    return cuts.apply(text, " ")


def without_tables(text: str) -> str:
    """Text with a blank for each table, however nested."""
    if "{|" not in text or "|}" not in text:
        return text
    cuts, stack = _Cuts(), []
    for match in _BRACES.finditer(text):
        at = match.start()
        if text[at] == "}" and stack and text[at - 1] == "|":
            first = stack[-1]
            if text[first] == "{" and text[first + 1] == "|" and at - first > 2:
                stack.pop()
                cuts.add(first, at + 1)
                continue
        stack.append(at)
    return cuts.apply(text, " ")


def without_file_links(text: str) -> str:
    """Text without links to files and images, and without what is nested in them, to the `]]` that closes the link.

    Links without brackets in them go first, wherever they stand. In the others brackets must be balanced, single ones
    (of external links) too: a link that is never closed stays, and file links in it go.
    """
    text = _PLAIN_FILE.sub("", text)
    if "]]" not in text or not _FILE.search(text):
        return text
    cuts, stack, at, size = _Cuts(), [], 0, len(text)
    while at < size:
        match = _BRACKET.search(text, at)
        if match is None:
            break
        at, mark = match.start(), match.group()
        double = text.startswith(mark, at + 1)
        if mark == "[":
            stack.append((at, double, double and _FILE.match(text, at) is not None))
            at += 1 + double
            continue
        while stack and stack[-1][1] and not double:
            stack.pop()  # a single bracket closes no double one, which then stays open for good
        if not stack:
            at += 1
            continue
        start, was_double, is_file = stack.pop()
        at += 1 + was_double
        if is_file:
            cuts.add(start, at)
    return cuts.apply(text, "")


def without_nested_marks(text: str) -> str:
    """Text without templates, tables and links to files."""
    return without_file_links(without_tables(without_templates(text)))


# Marked nondeterministic, though they are not: so the optimizer neither runs one twice nor moves one into a filter.
def _mapped(function, texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in texts:
        yield pa.array([None if t is None else function(t) for t in batch.to_pylist()], pa.string())


@F.arrow_udf(StringType())
def templates_removed(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    return _mapped(without_templates, texts)


templates_removed = templates_removed.asNondeterministic()


@F.arrow_udf(StringType())
def nested_marks_removed(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    return _mapped(without_nested_marks, texts)


nested_marks_removed = nested_marks_removed.asNondeterministic()


@F.arrow_udf(ArrayType(StringType()))
def templates_removed_each(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Arrays of texts."""
    for batch in texts:
        own = [None if a is None else [None if t is None else without_templates(t) for t in a] for a in batch.to_pylist()]
        yield pa.array(own, pa.list_(pa.string()))


templates_removed_each = templates_removed_each.asNondeterministic()
