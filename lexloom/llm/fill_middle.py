"""Fill-in-middle rearrangement of texts by ropes.

A text becomes a rope: a balanced tree whose leaves are ranges of it, and whose nodes keep the number of line ends and
of code points below them. It is split at two ranks of units (lines), and the subtrees are joined again in another
order with sentinels between them; nothing is copied until the result is written out. `restored` does the inverse: the
rearranged text's rope is split at the ranks of code points where its sentinels stand, and the subtrees are joined in
the first order. Splits and joins go down one path of the tree.

Where a row is cut, and in which form, depends on its id and the seed alone, so reruns agree.

Defined cases: a null text is empty; an empty text, and one that contains a sentinel, stays as it is (`plain`); a line
of any length is one unit; a null doc_id counts as an empty one; repeated rows give equal results; an empty table gives
an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, slices

#: Sentinels before prefix, suffix and middle; code points of a leaf.
PREFIX, SUFFIX, MIDDLE, LEAF = "<P>", "<S>", "<M>", 1024
#: The forms: order of (sentinel, part) in the output. Part 0 is the prefix, 1 the middle, 2 the suffix.
FORMS = {"psm": ((PREFIX, 0), (SUFFIX, 2), (MIDDLE, 1)), "spm": ((SUFFIX, 2), (PREFIX, 0), (MIDDLE, 1))}
SEED, RATE, SPM_RATE = 7, 100, 50


class Leaf:
    """A range of a text."""

    __slots__ = ("text", "start", "stop", "ends", "chars")
    height = 0

    def __init__(self, text: str, start: int, stop: int):
        self.text, self.start, self.stop = text, start, stop
        self.ends, self.chars = text.count("\n", start, stop), stop - start

    def cut(self, rank: int, by: str) -> tuple[Leaf, Leaf]:
        at = self.start + rank
        if by == "ends":
            at = self.start
            for _ in range(rank):
                at = self.text.find("\n", at, self.stop) + 1
        return Leaf(self.text, self.start, at), Leaf(self.text, at, self.stop)


class Node:
    """Two ropes, one after the other, with the sums of their counts."""

    __slots__ = ("left", "right", "ends", "chars", "height")

    def __init__(self, left: Rope, right: Rope):
        self.left, self.right = left, right
        self.ends, self.chars = left.ends + right.ends, left.chars + right.chars
        self.height = 1 + max(left.height, right.height)


Rope = Leaf | Node
NOTHING = Leaf("", 0, 0)


def rope(text: str, size: int = LEAF) -> Rope:
    """The rope of a text, of leaves of `size` code points."""
    level: list[Rope] = [Leaf(text, i, min(i + size, len(text))) for i in range(0, len(text), size)] or [NOTHING]
    while len(level) > 1:
        pairs = [Node(a, b) for a, b in zip(level[::2], level[1::2], strict=False)]
        level = pairs + level[len(pairs) * 2 :]
    return level[0]


def _balanced(left: Rope, right: Rope) -> Rope:
    """Two ropes whose heights differ by two at most, as one whose sides' heights differ by one at most."""
    if left.height > right.height + 1:
        inner = left.right
        if left.left.height >= inner.height:
            return Node(left.left, Node(inner, right))
        return Node(Node(left.left, inner.left), Node(inner.right, right))
    if right.height > left.height + 1:
        inner = right.left
        if right.right.height >= inner.height:
            return Node(Node(left, inner), right.right)
        return Node(Node(left, inner.left), Node(inner.right, right.right))
    return Node(left, right)


def join(left: Rope, right: Rope) -> Rope:
    """One rope after the other."""
    if not left.chars or not right.chars:
        return left if left.chars else right
    if left.height > right.height + 1:
        return _balanced(left.left, join(left.right, right))
    if right.height > left.height + 1:
        return _balanced(join(left, right.left), right.right)
    return Node(left, right)


def split(whole: Rope, rank: int, by: str) -> tuple[Rope, Rope]:
    """The rope before and after the rank-th line end (by `ends`) or code point (by `chars`)."""
    if rank <= 0:
        return NOTHING, whole
    if isinstance(whole, Leaf):
        return whole.cut(rank, by)
    before = getattr(whole.left, by)
    if rank <= before:
        a, b = split(whole.left, rank, by)
        return a, join(b, whole.right)
    a, b = split(whole.right, rank - before, by)
    return join(whole.left, a), b


def split_units(whole: Rope, rank: int, n: int) -> tuple[Rope, Rope]:
    """The rope's first `rank` of n lines, and the others. The last line may have no end."""
    return (whole, NOTHING) if rank >= n else split(whole, rank, "ends")


def written(whole: Rope) -> str:
    """The text of a rope."""
    out, left = [], [whole]
    while left:
        at = left.pop()
        if isinstance(at, Leaf):
            out.append(at.text[at.start : at.stop])
        else:
            left += (at.right, at.left)
    return "".join(out)


def units(text: str) -> int:
    """Lines of a text."""
    return text.count("\n") + (1 if text and text[-1] != "\n" else 0)


def rearranged(text: str, first: int, last: int, form: str) -> tuple[str, int, int]:
    """(text in a form, code points of the prefix, of the middle), cut after `first` and `last` of its lines."""
    whole, n = rope(text), units(text)
    head, suffix = split_units(whole, last, n)
    prefix, middle = split_units(head, first, last)
    parts, out = (prefix, middle, suffix), NOTHING
    for sentinel, k in FORMS[form]:
        out = join(join(out, Leaf(sentinel, 0, len(sentinel))), parts[k])
    return written(out), prefix.chars, middle.chars


def restored(output: str, form: str) -> str:
    """The text from which a rearranged one was made; a plain one is itself. A text without the form's sentinels is an error."""
    if form == "plain":
        return output
    left, parts, at = rope(output), {}, 0
    places = [(output.index(sentinel), len(sentinel), k) for sentinel, k in FORMS[form]]
    for (place, size, k), end in zip(places, [*(p for p, _, _ in places[1:]), len(output)], strict=True):
        _, left = split(left, place + size - at, "chars")
        parts[k], left = split(left, end - place - size, "chars")
        at = end
    return written(join(join(parts[0], parts[1]), parts[2]))


def _chosen(doc_id: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers from the hash of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]


def fill_in_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """doc_id, n (lines), form, prefix_chars, middle_chars (null if plain), output of every row.

    `rate` and `spm_rate` are per cent: of rows that are rearranged, and of those in the form suffix, prefix, middle.
    """
    rows = documents(docs, "doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    chosen = rows.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *_chosen(F.col("doc_id"), seed))

    def one(text: str, h1: int, h2: int, h3: int, h4: int) -> tuple[int, str, int | None, int | None, str]:
        n = units(text)
        if not text or h3 % 100 >= rate or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)):
            return n, "plain", None, None, text
        form = "spm" if h4 % 100 < spm_rate else "psm"
        output, prefix, middle = rearranged(text, *sorted((h1 % (n + 1), h2 % (n + 1))), form)
        return n, form, prefix, middle, output

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            done = [one(*x) for x in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True)]
            n, form, prefix, middle, output = zip(*done, strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(form), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output)], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return chosen.mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def with_restored(rows: DataFrame) -> DataFrame:
    """Rows of `fill_in_middle` with `restored`, the text rebuilt from output and form."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "output"):
            back = [restored(o, f) for o, f in zip(batch.column("output").to_pylist(), batch.column("form").to_pylist(), strict=True)]
            yield batch.append_column("restored", pa.array(back, pa.string()))

    return rows.mapInArrow(run, f"{fields}, restored string")


def rearranged_digest(docs: DataFrame) -> DataFrame:
    """Counts, form and hashes of the rearranged and of the rebuilt text of every row."""
    back = with_restored(fill_in_middle(docs))
    return back.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))
