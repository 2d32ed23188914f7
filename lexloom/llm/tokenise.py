"""Whole-text token ids of the `tokenizers` library, with its results for parts of a text kept for reuse.

Both vocabularies used here split a text into pieces before their merges, and no piece holds more than one leading
blank. A text is therefore cut at single blanks that have no other white space beside them (and at single line ends),
and parts seen before come from a bounded table. A new part is cut into its pieces by the vocabulary's own pattern,
and the library's model merges each piece that is not known. Asking the model for pieces skips the library's own search
for them and its offsets, which cost three to four times as much as the merges. Parts with characters beyond Latin
letters (whose normal form, lower case or class could differ between the pattern and the library) go to the library
as they are. The tests compare the ids with the library's for whole texts.

`encode_special_tokens` is set, as the vocabularies' description has it: text that spells a control token's name is
ordinary text.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from .common import worker_keeps

#: Parts, and pieces that follow no blank, of a generation that one Python worker keeps; most characters of a kept one.
KEPT_PARTS, KEPT_GLUED, LONGEST = 400_000, 50_000, 64
#: The byte-level split of the library, whose vocabulary file only names it.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes of text that are encoded at once.
SLICE_BYTES = 4_000_000
#: Stands before a text's first part, which no blank precedes.
BEGINNING = "\x01"
#: White space beside white space or the mark in a text, in Arrow's syntax; the blanks at which such a text may be cut.
_SPACE = "[\\t-\\r\\x1c-\\x20\\x85\\xa0\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
_SPECIAL, _CUT = f"{_SPACE}{_SPACE}|{BEGINNING}", re.compile(r"(?<=\S) (?=\S)")
#: The last letter that the pattern and the library surely see alike; characters that only the library handles.
LAST, _OTHER = "į", re.compile("[^\t\n\x20-\x7e\xa1-į]")


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_characters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if printable, else the next from 256."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class Kept(dict):
    """Results of `make` by text: a generation of `most` entries and the one before it, from which what comes again is taken over."""

    def __init__(self, make: Callable[[str], bytes], most: int):
        super().__init__()
        self.make, self.most, self.before = make, most, {}

    def __missing__(self, text: str) -> bytes:
        ids = self.before.get(text)
        if ids is None:
            ids = self.make(text)
            if len(text) > LONGEST:
                return ids
        if len(self) >= self.most:
            self.before = dict(self)
            self.clear()
        self[text] = ids
        return ids


class WordwiseEncoder:
    """Encodes texts with a `tokenizers` file; `encode` gives each text's ids as unsigned 16-bit numbers in bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        if self.library.get_vocab_size() > 65_536:
            raise ValueError("ids of this vocabulary do not fit 16 bits")
        #: With a normaliser that drops white space a blank is no part of a token.
        self.keeps_blanks = self.library.normalizer is None
        self.lead, self.mapped_lead = (" ", byte_characters()[32]) if self.keeps_blanks else ("", "")
        splits = [x["pattern"]["Regex"] for x in json.loads(self.library.to_str())["pre_tokenizer"].get("pretokenizers", []) if x["type"] == "Split"]
        self.find = regex.compile(splits[0] if splits else BYTE_LEVEL).findall
        self.tokenize, self.map = self.library.model.tokenize, byte_characters()
        self.parts, self.glued = Kept(self._part, KEPT_PARTS), Kept(self._merge, KEPT_GLUED)

    def whole(self, text: str) -> bytes:
        return array("H", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def _merge(self, piece: str) -> bytes:
        """Ids of one piece as it is."""
        return array("H", [t.id for t in self.tokenize(piece.encode().decode("latin-1").translate(self.map))]).tobytes()

    def _pieces(self, part: str, lead: str) -> bytes:
        """Ids of a part's pieces, by the vocabulary's pattern."""
        first, *rest = self.find(lead + part) or ("",)
        head = first[len(lead) :]
        ids = self.parts[head] if lead == self.lead and head != part and head.isalpha() else self._merge(first)
        return ids + b"".join(map(self.glued.__getitem__, rest))

    def _part(self, part: str) -> bytes:
        """Ids of a part that follows a blank, or that begins with a line's end or with the mark of a text's beginning."""
        if not part or self.keeps_blanks and part[0] == BEGINNING:
            return self.whole(part[1:] if part else self.lead)
        plain = part.isprintable() and (part.isascii() or max(part) <= LAST)
        if not plain and _OTHER.search(part):
            return self.whole(part if part[0] == "\n" else self.lead + part)
        if not self.keeps_blanks:
            part = part.lower()
        # Most parts are letters, with a full stop or comma at most: these need no pattern.
        if part.isalpha():
            if part.isascii():
                return array("H", [t.id for t in self.tokenize(self.mapped_lead + part)]).tobytes()
            return self._merge(self.lead + part)
        if part[-1:] in (".", ",") and part[:-1].isalpha():
            return self.parts[part[:-1]] + self.glued[part[-1]]
        if part[0] == "\n":
            return self.glued["\n"] + self._pieces(part[1:], "") if len(part) > 1 else self.glued["\n"]
        return self._pieces(part, self.lead)

    def _spaced(self, text: str) -> bytes:
        """Ids of a text that has white space beside white space, or the mark itself."""
        first, *rest = _CUT.split(text)
        last = self.whole(" " + rest.pop()) if rest and rest[-1][-1:].isspace() else b""
        parts = [x if x[:1] not in ("\n", BEGINNING) else None for x in rest]
        return self.whole(first) + b"".join([self.whole(" " + r) if x is None else self.parts[x] for x, r in zip(parts, rest, strict=True)]) + last

    def encode(self, texts: pa.StringArray | list[str]) -> list[bytes]:
        """The ids of every text (null: none). Parts are told apart once for all the texts, by Arrow."""
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        out: list[bytes] = [b""] * len(texts)
        line = " \n" if self.keeps_blanks else " "
        if self.keeps_blanks:
            special = pc.match_substring_regex(texts, _SPECIAL)
            for i in pc.indices_nonzero(special).to_pylist():
                out[i] = self._spaced(texts[i].as_py())
            at = pc.indices_nonzero(pc.invert(special)).to_numpy()
            texts = pc.binary_join_element_wise(pa.scalar(BEGINNING), texts.filter(pc.invert(special)), "")
        else:
            at = np.arange(len(texts))
        if not len(at):
            return out
        # A part that begins a line has no blank before it; it keeps the line's end instead.
        parts = pc.split_pattern(pc.replace_substring(texts, "\n", line), " ")
        coded = parts.flatten().dictionary_encode()
        # No part holds a blank, so all of them become strings at once.
        distinct = pc.binary_join(pa.ListArray.from_arrays([0, len(coded.dictionary)], coded.dictionary), " ")[0].as_py().split(" ")
        known = list(map(self.parts.__getitem__, distinct))
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 2
        ids, starts = np.frombuffer(b"".join(known), np.uint16), np.cumsum(sizes) - sizes
        place = coded.indices.to_numpy()
        n = sizes[place]
        ends = np.cumsum(n)
        ids = ids[np.repeat(starts[place] - (ends - n), n) + np.arange(int(ends[-1]))]
        bounds = np.append(0, ends)[parts.offsets.to_numpy() - parts.offsets[0].as_py()]
        for i, a, b in zip(at.tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            out[i] = ids[a:b].tobytes()
        return out


def encoder(path: str) -> WordwiseEncoder:
    """One encoder in a Python worker; it goes when another operator keeps something there."""
    return worker_keeps(("tokenizer", path), lambda: WordwiseEncoder(path))
