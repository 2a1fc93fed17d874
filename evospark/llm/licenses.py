"""License scans: TF-IDF cosine to templates, then inheritance along directories.

Every line of every text, and every window of a template's size in it, is a
sparse TF-IDF vector, also where the window spans lines; whole texts are compared
with full license texts by damped counts; inverse document frequencies of the templates'
words are counted over all documents, and any other word weighs as a word seen
once. A file's own license is its best match from ``threshold`` on. A file named
like a license file also governs its directory; files without a license of
their own take that of the nearest directory above them.
"""

from __future__ import annotations

from collections import Counter
from importlib.resources import files as files_of
from math import log

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evospark.llm.common import stored

# Usual short notices by SPDX identifier.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
_GNU = ("This program is free software: you can redistribute it and/or modify it under the terms of the {0} as published by the Free "
        "Software Foundation, either version {1} of the License, or (at your option) any later version. This program is distributed in "
        "the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
        "PARTICULAR PURPOSE. See the {0} for more details.")
_DISCLAIMER = ("THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, "
               "BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT "
               "SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL "
               "DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS "
               "INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE "
               "OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
# Standard file headers and the licenses of a few paragraphs, also found inside longer texts.
HEADERS = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
           "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, "
           "merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is "
           "furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included "
           "in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR "
           "IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO "
           "EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, "
           "TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
                    "conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and "
                    "the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of "
                    "conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. "
                    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
                    "derived from this software without specific prior written permission. " + _DISCLAIMER,
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the "
                  "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law "
                  "or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
                  "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and "
                  "limitations under the License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed "
               "with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    **{f"{k}-{v}": _GNU.format(f"GNU {kind} General Public License".replace("  ", " "), v.removesuffix(".0")) for k, kind, v in (
        ("GPL", "", "3.0"), ("GPL", "", "2.0"), ("LGPL", "Lesser", "3.0"), ("LGPL", "Lesser", "2.1"), ("AGPL", "Affero", "3.0"))},
}
# Full texts in ``license_texts``, compared with whole files.
FULL_TEXTS = ("Apache-2.0", "GPL-3.0", "GPL-2.0", "LGPL-3.0", "LGPL-2.1", "MPL-2.0")
FILE_NAMES = ("LICENSE", "LICENCE", "COPYING")
THRESHOLD = 0.8
REACH = 10
TIE = 1e-9
"""Scores closer than this are equal."""

_WORD = regex.compile(r"[\p{L}\p{N}.+-]*[\p{L}\p{N}]")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def full_text(name: str) -> str:
    return files_of("evospark.llm").joinpath("license_texts", f"{name}.txt").read_text()


def _vocabulary() -> list[str]:
    texts = [*TEMPLATES.values(), *HEADERS.values(), *map(full_text, FULL_TEXTS)]
    return sorted({w for t in texts for w in words_of(t)})


def document_frequencies(files: DataFrame) -> tuple[dict[str, int], int]:
    """Documents that hold each template word, and all documents (one number per template word)."""
    vocabulary = _vocabulary()

    def count(batches):
        found, total, known = np.zeros(len(vocabulary), np.int64), 0, {w: i for i, w in enumerate(vocabulary)}
        for batch in batches:
            total += batch.num_rows
            for text in batch.column(0).to_pylist():
                for w in set(words_of(text or "")) & known.keys():
                    found[known[w]] += 1
        yield pa.RecordBatch.from_arrays([pa.array([*vocabulary, None]), pa.array([*found, total], pa.int64())], names=["word", "n"])

    rows = files.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "word string, n long")
    sums = {r["word"]: r["n"] for r in rows.groupBy("word").agg(F.sum("n").alias("n")).collect()}
    total = sums.pop(None, 0)
    return sums, total


class Matcher:
    """Best template of one text."""

    def __init__(self, frequency: dict[str, int], total: int):
        self.known = {w: log((1 + total) / (1 + n)) + 1 for w, n in frequency.items()}
        self.other = log((1 + total) / 2) + 1
        parts = [*TEMPLATES.items(), *((f"{k} header", t) for k, t in HEADERS.items())]
        self.templates = {k: self._vector(words_of(t)) for k, t in parts}
        self.full = {k: self._damped(words_of(full_text(k))) for k in FULL_TEXTS}
        self.sizes = sorted({len(words_of(t)) for _, t in parts} | {2 * REACH})
        # A line counts only if it holds one of the rarer words of some template.
        self.telling = set()
        for _, text in parts:
            words = set(words_of(text))
            middle = sorted(self.known.get(w, self.other) for w in words)[len(words) // 2]
            self.telling |= {w for w in words if self.known.get(w, self.other) >= middle}

    def _vector(self, words: list[str]) -> dict[str, float]:
        out: dict[str, float] = {}
        for w in words:
            out[w] = out.get(w, 0.0) + self.known.get(w, self.other)
        norm = sum(v * v for v in out.values()) ** 0.5
        return {w: v / norm for w, v in out.items()}

    def _damped(self, words: list[str]) -> dict[str, float]:
        """As ``_vector`` with 1 + ln of the counts, so the commonest words of a long text don't outweigh all others."""
        out = {w: (1 + log(n)) * self.known.get(w, self.other) for w, n in Counter(words).items()}
        norm = sum(v * v for v in out.values()) ** 0.5
        return {w: v / norm for w, v in out.items()}

    def _slid(self, words: list[str], top: float) -> tuple[float, str | None, int]:
        """(score, template, first word) of the best window (of any template's size, or twice ``REACH``), if it beats ``top``; the first on ties."""
        distinct = {w: i for i, w in enumerate(dict.fromkeys(words))}
        weights = np.array([self.known.get(w, self.other) for w in distinct])
        ids = np.array([distinct[w] for w in words])
        shares = {name: (weights * np.array([t.get(w, 0.0) for w in distinct]))[ids] for name, t in self.templates.items()}
        best: tuple[float, str | None, int] = (top, None, 0)
        for n in self.sizes:
            around = np.zeros(n - 1)  # windows at the edges hold fewer words
            squares = np.concatenate([around, (weights**2)[ids], around])
            least, norms = np.sqrt(_window_sums(squares, n)), None
            for name, share in shares.items():
                inner = _window_sums(np.concatenate([around, share, around]), n)
                # A window's norm is at least that of its words as if all were different.
                if norms is None and (inner / least).max() <= best[0] + TIE:
                    continue
                if norms is None:
                    none = [len(distinct)] * (n - 1)
                    norms = np.sqrt(_window_norms([*none, *ids.tolist(), *none], squares.tolist(), n))
                scores = inner / norms
                at = int(np.flatnonzero(scores >= scores.max() - TIE)[0])
                if scores[at] > best[0] + TIE:
                    best = (float(scores[at]), name, max(0, at - n + 1))
        return best

    def best(self, text: str) -> tuple[float, str | None, int | None]:
        """(score, license, line number): of lines, their windows, windows that span lines, and the whole text."""
        top: tuple[float, str | None, int | None] = (0.0, None, None)
        lines = [words_of(line) for line in text.split("\n")]
        words = [w for line in lines for w in line]
        if not self.telling.intersection(words):
            return top
        for number, line in enumerate(lines):
            if not self.telling.intersection(line):
                continue
            vector = self._vector(line)
            for name, template in self.templates.items():
                score = sum(v * template[w] for w, v in vector.items() if w in template)
                if score > top[0] + TIE:
                    top = (score, name, number)
            score, name, _ = self._slid(line, top[0])
            if name is not None:
                top = (score, name, number)
        score, name, at = self._slid(words, top[0])
        if name is not None:
            ends = np.cumsum([len(line) for line in lines])
            top = (score, name, int(np.searchsorted(ends, at, side="right")))
        vector = self._damped(words)
        for name, template in self.full.items():
            score = sum(v * template[w] for w, v in vector.items() if w in template)
            if score > top[0] + TIE:
                top = (score, name, 0)
        return top[0], top[1] and top[1].removesuffix(" header"), top[2]


def _window_sums(values: np.ndarray, n: int) -> np.ndarray:
    total = np.append(0.0, np.cumsum(values))
    return total[n:] - total[:-n]


def _window_norms(ids: list[int], squares: list[float], n: int) -> np.ndarray:
    """Squared norms of the count vectors of all windows of ``n`` words."""
    count, norm, out = [0] * (max(ids) + 1), 0.0, []
    for i, w in enumerate(ids):
        norm += squares[i] * (2 * count[w] + 1)
        count[w] += 1
        if i >= n:
            old = ids[i - n]
            count[old] -= 1
            norm -= squares[i - n] * (2 * count[old] + 1)
        if i >= n - 1:
            out.append(norm)
    return np.array(out)


def own_licenses(files: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, path, own, score, line) of every row."""
    frequency, total = document_frequencies(files)

    def match(batches):
        matcher = Matcher(frequency, total)
        for batch in batches:
            rows = [matcher.best(t or "") for t in batch.column(2).to_pylist()]
            good = [r[0] >= threshold for r in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([r[1] if g else None for r, g in zip(rows, good, strict=True)], pa.string()),
                 pa.array([round(r[0], 9) for r in rows]), pa.array([r[2] if g else None for r, g in zip(rows, good, strict=True)], pa.int64())],
                names=["doc_id", "path", "own", "score", "line"])

    rows = files.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("path").cast("string").alias("path"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(match, "doc_id long, path string, own string, score double, line long")


def licensed(files: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, path, license, origin, score, line, from_dir of every row of ``files`` (doc_id, path, text).

    origin is ``file`` (own notice), ``directory`` (inherited) or null. Of several
    license files in one directory the best score governs, then the smallest
    name. A null path has no directories and inherits nothing; null and empty
    texts match nothing; repeated rows are all returned.
    """
    own = stored(own_licenses(files, threshold), "own")
    cut = F.split(F.col("path"), "/")
    depth = F.size(cut) - 1
    named = F.upper(F.element_at(cut, -1)).rlike("^(" + "|".join(FILE_NAMES) + r")([._-].*)?$")
    parent = F.array_join(F.slice(cut, 1, depth), "/")
    folders = own.where(named & F.col("own").isNotNull()).groupBy(parent.alias("dir")).agg(
        F.max_by("own", F.struct("score", F.lit(0) - F.col("doc_id"))).alias("inherited"))
    folders = stored(folders, "folders")
    # Distinct directories, not files, are joined with their ancestors.
    dirs = own.where("path is not null and own is null").select(parent.alias("dir"), F.slice(cut, 1, depth).alias("parts")).distinct()
    above = dirs.select("dir", F.explode(F.transform(
        F.sequence(F.lit(0), F.size("parts")), lambda n: F.struct(n.alias("n"), F.array_join(F.slice("parts", 1, n), "/").alias("up")))).alias("a"))
    nearest = above.join(folders.withColumnRenamed("dir", "up"), F.col("a.up") == F.col("up")).groupBy("dir").agg(
        F.max_by(F.struct("inherited", "up"), "a.n").alias("from"))
    nearest = stored(nearest, "nearest")
    joined = own.withColumn("dir", F.when(F.col("own").isNull(), parent)).join(nearest, "dir", "left")
    return joined.select(
        "doc_id", "path", F.coalesce("own", "from.inherited").alias("license"),
        F.when(F.col("own").isNotNull(), "file").when(F.col("from").isNotNull(), "directory").alias("origin"),
        "score", "line", F.col("from.up").alias("from_dir"))


def document_paths(docs: DataFrame) -> DataFrame:
    """(doc_id, path, text): documents as files ``source/lang/shelf/name``; a document with a short
    line that names a license is a license file of its shelf."""
    text = F.col("text").cast("string")
    notice = F.exists(F.split(text, "\n"), lambda x: (F.length(x) <= 120) & F.lower(x).rlike("licen[cs]e"))
    name = F.when(notice, F.concat(F.lit("LICENSE."), F.col("doc_id").cast("string"))).otherwise(
        F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    shelf = F.floor(F.col("doc_id") / 1000).cast("string")
    folders = [F.coalesce(F.col("source"), F.lit("unknown")), F.coalesce(F.col("lang"), F.lit("unknown")), shelf]
    return docs.select("doc_id", F.concat_ws("/", *folders, name).alias("path"), "text")
