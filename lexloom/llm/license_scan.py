"""License scans: sparse TF-IDF cosine of headers and licence files to templates, then inheritance by path.

A text's terms are compared with each template in windows of the template's length: wherever one of the template's
anchors (a word such as "license" or "copyright") stands in the text, the window is laid so that the anchors meet. So
a header is found wherever it stands, in a line, in prose, or wrapped over lines behind comment marks. A licence file
(named LICENSE, LICENCE, COPYING or NOTICE) is compared as a whole besides. Vectors are sparse: terms' counts by the
templates' inverse document frequencies. A file without a notice of its own inherits the licence of the nearest
directory above it (or its own) that has a licence file: distinct directories are exploded to their ancestors and
joined with the directories that have one.

Texts are read once; what is found goes to a table without texts, from which everything else is made. Files of a hot
directory are never grouped: holders are summed before the shuffle, and the last join brings one row for each directory
to its files, broadcast by Spark's own threshold or split by adaptive execution where a directory is skewed.

Defined cases: null paths and texts are empty; empty and very long texts are scanned whole; ties go to the licence of
least name, then to the file of least id; repeated rows, also those without an id, give repeated rows with the same
result; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import log, sqrt

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, text_chunks

# The notices that licences' own texts ask for or open with, and the whole texts of short licences.
_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_AS_IS = " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version"
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
    ],
    "MIT": [
        "Released under the MIT License",
        "Licensed under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _AS_IS,
    ],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3", _GNU.format("General Public License", 3), "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2", _GNU.format("General Public License", 2), "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"],
    "LGPL-3.0": ["This library is licensed under the GNU Lesser General Public License, version 3", _GNU.format("Lesser General Public License", 3), "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3", _GNU.format("Affero General Public License", 3), "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License", _BSD + _BSD_AS_IS],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License", _BSD + _BSD_3 + _BSD_AS_IS],
    "CC-BY-4.0": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "Mozilla Public License Version 2.0"],
    "CC0-1.0": ["Released under CC0 1.0 Universal", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"],
}
#: Terms at which windows are laid: a template's first and last of them. Parts of words that a text with one of them holds.
ANCHORS = ("license", "licensed", "licence", "licenses", "copyright", "spdx", "permission", "redistribution", "waived", "released")
MARKS = ("licen", "copyright", "spdx", "permission", "redistribution", "waived", "released")
#: A term of a text in lower case; a licence file's name; least cosine of a finding.
TERM = "[a-z0-9]+(?:[.][0-9]+)*"
LICENSE_FILE = "(^|/)(LICENSE|LICENCE|COPYING|NOTICE)[^/]*$"
THRESHOLD = 0.7


def templates() -> list[tuple[str, list[str]]]:
    """(licence, terms) of every template, with an SPDX line for each licence."""
    every = [(name, text) for name, texts in TEMPLATES.items() for text in [*texts, f"SPDX-License-Identifier: {name}"]]
    return [(name, re.findall(TERM, text.lower())) for name, text in every]


def inverse_frequencies() -> tuple[dict[str, float], float]:
    """idf of the templates' terms, and of all others."""
    every = templates()
    df = Counter(t for _, terms in every for t in set(terms))
    idf = lambda n: log((1 + len(every)) / (1 + n)) + 1
    return {t: idf(n) for t, n in df.items()}, idf(0)


def anchor_places(terms: list[str]) -> list[int]:
    """Places of a template's first and last anchor."""
    at = [i for i, t in enumerate(terms) if t in ANCHORS]
    return sorted({at[0], at[-1]})


class Scanner:
    """Finds the best template of a text."""

    def __init__(self, threshold: float = THRESHOLD):
        self.threshold, (self.idf, self.unknown) = threshold, inverse_frequencies()
        self.vectors: list[tuple[str, int, dict[str, float], float]] = []
        self.at: dict[str, list[tuple[int, int]]] = {}  # anchor: (template, its place there)
        for k, (name, terms) in enumerate(templates()):
            vector = {t: n * self.idf[t] for t, n in Counter(terms).items()}
            self.vectors.append((name, len(terms), vector, sqrt(sum(x * x for x in vector.values()))))
            for place in anchor_places(terms):
                self.at.setdefault(terms[place], []).append((k, place))
        self.terms = re.compile(TERM.encode()).findall
        self.marks = [m.encode() for m in MARKS]

    def cosine(self, k: int, window: list[str]) -> float:
        _, _, vector, norm = self.vectors[k]
        weights = {t: n * self.idf.get(t, self.unknown) for t, n in Counter(window).items()}
        return sum(x * vector[t] for t, x in weights.items() if t in vector) / sqrt(sum(x * x for x in weights.values())) / norm

    def find(self, text: str, whole: bool) -> tuple[str | None, float | None]:
        """(licence, score) of a text's best window, or of all of it; (None, None) below the threshold."""
        raw = text.encode("utf-8", "surrogatepass").lower()  # of bytes: only A to Z change
        if not any(m in raw for m in self.marks):
            return None, None
        terms = [t.decode() for t in self.terms(raw)]
        best: tuple[float, str] = (0.0, "")
        windows = {(k, max(0, i - place), i - place + self.vectors[k][1]) for i, t in enumerate(terms) if t in self.at for k, place in self.at[t]}
        seen = set()
        if whole and terms:
            windows |= {(k, 0, len(terms)) for k in range(len(self.vectors))}
        for k, start, end in windows:
            window = terms[start:end]
            key = (k, *window)
            if key not in seen:
                seen.add(key)
                score = round(self.cosine(k, window), 6)
                if score >= self.threshold:
                    best = min(best, (-score, self.vectors[k][0]))
        return (best[1], -best[0]) if best[1] else (None, None)


def directory(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def findings(files: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """file_id, path, own_license, own_score: every file with its own best template, if any. files: file_id, path, text."""
    schema = files.select("file_id", "path").schema.add("own_license", "string").add("own_score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner, is_file = Scanner(threshold), re.compile(LICENSE_FILE).search
        for batch, texts in text_chunks(batches):
            found = [scanner.find(t, is_file(p) is not None) for p, t in zip(batch.column(1).to_pylist(), texts, strict=True)]
            licenses, scores = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(licenses, pa.string()), pa.array(scores, pa.float64())], names=["file_id", "path", "own_license", "own_score"])

    return files.select("file_id", F.coalesce("path", F.lit("")).alias("path"), "text").mapInArrow(run, schema)


def license_scan(files: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """file_id, path, own_license, own_score, license, origin (file, directory, none), from_dir. files: file_id, path, text."""
    scanned = stored(findings(files, threshold).withColumn("dir", directory(F.col("path"))), "license-findings")
    named = scanned.where(F.col("path").rlike(LICENSE_FILE) & F.col("own_license").isNotNull())
    holders = named.groupBy(F.col("dir").alias("h_dir")).agg(F.min(F.struct(-F.col("own_score"), F.col("own_license"), F.col("file_id")))["own_license"].alias("dir_license"))
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    asked = scanned.select("dir").distinct().select("dir", F.posexplode(above).alias("depth", "ancestor"))
    nearest = asked.join(holders, F.col("ancestor") == F.col("h_dir")).groupBy(F.col("dir").alias("d_dir")).agg(F.max(F.struct("depth", "ancestor", "dir_license")).alias("x"))
    out = scanned.join(nearest, F.col("dir") == F.col("d_dir"), "left")
    own = F.col("own_license").isNotNull()
    origin = F.when(own, "file").when(F.col("x").isNotNull(), "directory").otherwise("none")
    return out.select("file_id", "path", "own_license", "own_score", F.coalesce("own_license", "x.dir_license").alias("license"), origin.alias("origin"), F.when(~own, F.col("x.ancestor")).alias("from_dir"))


#: Documents of at most so many words with a notice stand for the licence file of their language's or of their own folder.
SHORT, MIDDLE = 30, 120


def document_paths(docs: DataFrame) -> DataFrame:
    """file_id, path, text: documents as files of a tree source/lang/folder/document, short ones with a notice as licence files."""
    text = F.coalesce("text", F.lit(""))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))  # counted only where there is a notice
    low = F.lower(text)
    notice = F.lit(False)
    for mark in MARKS:
        notice = notice | F.contains(low, F.lit(mark))
    lang = F.concat(F.lit("/"), F.coalesce("source", F.lit("-")), F.lit("/"), F.coalesce("lang", F.lit("-")))
    name = F.concat(F.lit("LICENSE-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("x")))
    folder = F.concat(lang, F.lit("/"), F.coalesce(F.floor(F.col("doc_id") / 256).cast("string"), F.lit("-")))
    plain = F.concat(folder, F.lit("/"), F.coalesce(F.col("doc_id").cast("string"), F.lit("x")), F.lit(".txt"))
    path = F.when(notice, F.when(words <= SHORT, F.concat(lang, F.lit("/"), name)).when(words <= MIDDLE, F.concat(folder, F.lit("/"), name)).otherwise(plain)).otherwise(plain)
    return docs.select(F.col("doc_id").alias("file_id"), path.alias("path"), F.col("text"))
