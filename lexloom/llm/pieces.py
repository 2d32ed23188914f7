"""Token ids of a sentencepiece model for whole texts, put together from the parts between their blanks.

The model merges neighbouring symbols for as long as the vocabulary has the merged piece. Where no piece has a blank
behind another character, no merge can reach over the beginning of a run of blanks; so the ids of a text are those of
its parts, each with the blanks before it. That property is tested on the vocabulary when it is loaded; a vocabulary
without it (or one that normalises its input) has its texts encoded whole.

A part is what follows one blank: the model itself puts a blank before everything that it is given, so `encode(part)`
gives the ids of the blank and the part, and of further blanks with which the part may begin. Texts in which no blank
has a blank beside it, and none stands at an end, are cut at every blank; only the others need an expression.
"""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import worker_keeps

#: Bytes of text that are cut at once. What stands between parts for a moment; a text that has it is encoded whole.
SLICE_BYTES, MARK = 4_000_000, "\x01"
#: Parts of a generation that a worker keeps, and the most characters of a kept one.
KEPT, LONGEST = 300_000, 64
BLANK = "▁"


def loaded(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def splits_at_blanks(model) -> bool:
    """True if no piece has a blank behind another character, and texts are taken as they are but for a blank before them."""
    pieces = map(model.id_to_piece, range(model.get_piece_size()))
    as_they_are = all(model.normalize(x) == BLANK + x.replace(" ", BLANK) for x in ("a  b ", " a", "ﬁ ｱ\t\n　x", "é"))
    return as_they_are and model.encode("") == [] and not any(a != BLANK and b == BLANK for p in pieces for a, b in zip(p, p[1:], strict=False))


class Cut:
    """Texts cut into parts: `distinct` parts, the `place` of every part among them, and each text's range of parts in `bounds`.

    `whole` are the numbers of texts that are not cut. Empty texts and those have one empty part, which counts for nothing.
    """

    def __init__(self, texts: pa.StringArray):
        has_mark = pc.match_substring(texts, MARK)
        self.whole = pc.indices_nonzero(has_mark).to_pylist()
        if self.whole:
            texts = pc.if_else(has_mark, "", texts)
        ends = pc.or_(pc.starts_with(texts, " "), pc.ends_with(texts, " "))
        runs = pc.or_(pc.match_substring(texts, "  "), ends)
        marked = pc.replace_substring(texts, " ", MARK)
        if pc.any(runs).as_py():
            # A blank behind another character becomes a mark; the blanks after it stay with the part.
            marked = pc.replace_with_mask(marked, runs, pc.replace_substring_regex(texts.filter(runs), "([^ ]) ", "\\1" + MARK))
        parts = pc.split_pattern(marked, MARK)
        coded = parts.flatten().dictionary_encode()
        self.distinct, self.place = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        self.bounds = parts.offsets.to_numpy() - parts.offsets[0].as_py()
        self.empty = pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)

    def sums(self, each: np.ndarray) -> np.ndarray:
        """For every text the sum over its parts of a number of each distinct part."""
        upto = np.concatenate([[0], np.cumsum(each[self.place])])
        out = upto[self.bounds[1:]] - upto[self.bounds[:-1]]
        out[self.empty] = 0
        return out


class Cache:
    """Values of parts: a generation of at most `most` and the one before it, from which what comes again is taken over."""

    def __init__(self, most: int = KEPT):
        self.most, self.now, self.before = most, {}, {}

    def of(self, parts: list[str], make) -> list:
        """The value of every part; `make` gives those of a list of unknown parts at once."""
        before = self.before
        out = list(map(self.now.get, parts))
        new = [i for i, v in enumerate(out) if v is None]
        for i in new:
            out[i] = before.get(parts[i])
        unknown = [i for i in new if out[i] is None]
        for i, value in zip(unknown, make([parts[i] for i in unknown]) if unknown else (), strict=True):
            out[i] = value
        for i in new:
            if len(parts[i]) <= LONGEST:
                if len(self.now) >= self.most:
                    self.before, self.now = self.now, {}
                self.now[parts[i]] = out[i]
        return out


class PieceEncoder:
    """Encodes texts with a sentencepiece model."""

    def __init__(self, path: str):
        self.model = loaded(path)
        if self.model.get_piece_size() > 65_536:
            raise ValueError("ids of this vocabulary do not fit 16 bits")
        self.cuts, self.cache = splits_at_blanks(self.model), Cache()
        self.blank = [self.model.piece_to_id(BLANK)]

    def part_ids(self, parts: list[str]) -> list[list[int]]:
        """Ids of parts, each with the blank before it."""
        return [x or self.blank for x in self.model.encode(parts, num_threads=1)]

    def ids(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, the number of each text's ids). No text is null."""
        if not self.cuts:
            each = self.model.encode(texts.to_pylist(), num_threads=1)
            return np.fromiter((i for x in each for i in x), np.uint16), np.fromiter(map(len, each), np.int64, len(each))
        cut = Cut(texts)
        known = self.cache.of(cut.distinct.to_pylist(), lambda parts: [array("H", x).tobytes() for x in self.part_ids(parts)])
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 2
        ids, starts = np.frombuffer(b"".join(known), np.uint16), np.cumsum(sizes) - sizes
        # Parts of empty texts have no ids.
        place = cut.place[~np.repeat(cut.empty, np.diff(cut.bounds))] if cut.empty.any() else cut.place
        n = sizes[place]
        ids = ids[np.repeat(starts[place] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        counts = cut.sums(sizes)
        if cut.whole:
            cut_at, pieces, last = np.append(0, np.cumsum(counts)), [], 0
            for i in cut.whole:
                own = np.array(self.model.encode(texts[i].as_py()), np.uint16)
                pieces += [ids[last : cut_at[i]], own]
                last, counts[i] = cut_at[i], len(own)
            ids = np.concatenate([*pieces, ids[last:]])
        return ids, counts


def piece_encoder(path: str, name: object = None) -> PieceEncoder:
    return worker_keeps(("pieces", path, name), lambda: PieceEncoder(path))
