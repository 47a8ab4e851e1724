"""Licence scan: an exact set-similarity join of licence templates with text blocks.

A block is a window of as many words as a template has (a shorter text is one block); its containment is the share
of the template's distinct words that it holds. Every block that meets the threshold is found and reported, as runs
of consecutive windows. Template words are ordered by their frequency over all documents: a block that holds
o = ceil(threshold * k) of k words must hold one of the k - o + 1 rarest (prefix filter), so only windows around those
words are looked at; texts of fewer than o words have no block (length filter), and windows stay inside the text and
keep the template's length (positional filter). Exact counts of all windows in reach come from one pass: a word
counts for the windows that begin after its previous occurrence. Plain phrases are found beside this and always count.

Related licences share most of their words, so that containment alone does not tell them apart. A block gives its
label only if it holds the words that name its licence, and if no block of a sibling, a template of another licence
whose text would meet this one's threshold, overlaps it and holds more words of its own. Blocks that do not are listed too.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .decontamination import Lookup
from .memory import lean
from .words import ALNUM, Words, split_words, text_batches

#: Phrases whose words, standing consecutively, give a label by themselves.
PHRASES = (
    ("mit", "mit license"),
    ("apache", "apache license"),
    ("gpl", "general public license"),
)

#: Public licences' texts, and the notices by which licences ask to be named; and, where their words
#: also stand in others' texts or notices, the words without which they are not named.
TEMPLATES = (
    ("mit", "Released under the MIT License.", 'mit'),
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
    documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
    to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
    whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission
    notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT
    WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A
    PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES
    OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
    SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("apache", "Licensed under the Apache License, Version 2.0.", 'apache'),
    ("apache", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
    the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable
    law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR
    CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and
    limitations under the License.""", 'apache'),
    ("gpl", "This work is licensed under the GNU General Public License, version 3.", 'gnu general'),
    ("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
    License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
    This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have
    received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""", 'general'),
    ("lgpl", """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General
    Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later
    version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
    warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.""", 'lesser'),
    ("agpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General
    Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
    version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
    warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.""", 'affero'),
    ("bsd-2-clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
    the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
    conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list
    of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS
    SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
    LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE
    COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES
    (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS
    INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE
    OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("bsd-3-clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
    the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
    conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list
    of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither
    the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this
    software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
    AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A
    PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT,
    INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
    SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN
    CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN
    IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""", 'endorse promote'),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
    provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE
    AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO
    EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING
    FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN
    CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable
    for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose,
    including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin
    of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a
    product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must
    be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or
    altered from any source distribution."""),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
    compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
    non-commercial, and by any means."""),
    ("mpl", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
    distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""", 'mozilla'),
    ("cc-by", "Licensed under CC BY 4.0.", 'cc by'),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0.", 'cc by nc'),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0.", 'cc by sa'),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0.", "cc by nd"),
    ("cc-by-nc-sa", "Licensed under CC BY-NC-SA 4.0.", "cc by nc sa"),
    ("cc-by-nc-nd", "Licensed under CC BY-NC-ND 4.0.", "cc by nc nd"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License.", 'creative commons attribution'),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", 'creative commons attribution noncommercial'),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", 'creative commons attribution sharealike'),
    ("cc-by-nd", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", "creative commons attribution noderivatives"),
    ("cc-by-nc-sa", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", "creative commons attribution noncommercial sharealike"),
    ("cc-by-nc-nd", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.", "creative commons attribution noncommercial noderivatives"),
)


def _words(texts: list[str]) -> list[np.ndarray]:
    words = split_words([t.encode() for t in texts], ALNUM)
    bounds = words.bounds()
    return [words.hash[bounds[k] : bounds[k + 1]] for k in range(len(texts))]


def _count(tokens: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, total = Lookup(tokens), np.zeros(len(tokens), np.int64)
        for batch in batches:
            for _, texts in text_batches(batch, limit=1 << 21):
                total += np.bincount(lookup.find(split_words(texts, ALNUM).hash)[1], minlength=len(tokens))
        yield pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array(total)], ["token", "n"])

    return run


class Scanner:
    """Finds phrases and template blocks in words; order: frequency of each template word in the corpus."""

    def __init__(self, templates: tuple, phrases: tuple, order: dict[int, int], threshold: float):
        self.phrases = list(zip([p[0] for p in phrases], _words([p[1] for p in phrases]), strict=True))
        self.templates = []
        self.names = [np.unique(w) for w in _words([t[2] if len(t) > 2 else "" for t in templates])]
        for (label, *_), own in zip(templates, _words([t[1] for t in templates]), strict=True):
            distinct = sorted(set(own.tolist()), key=lambda h: (order.get(h, 0), h))
            need = math.ceil(threshold * len(distinct) - 1e-9)
            self.templates.append((label, len(own), np.sort(np.array(distinct, np.uint64)), need, np.array(distinct[: len(distinct) - need + 1], np.uint64)))
        self.lookup = Lookup(np.unique(np.concatenate([t[4] for t in self.templates])) if self.templates else np.empty(0, np.uint64))
        #: Of each template those of other labels whose text would meet its threshold.
        kinds = [set(t[2].tolist()) for t in self.templates]
        self.siblings = [{j for j, other in enumerate(self.templates) if other[0] != t[0] and len(kinds[i] & kinds[j]) >= t[3]} for i, t in enumerate(self.templates)]
        #: Templates by prefix token.
        self.of_token: dict[int, list[int]] = {}
        for i, t in enumerate(self.templates):
            for h in t[4].tolist():
                self.of_token.setdefault(h, []).append(i)

    def base(self, words: Words) -> list[tuple[int, str]]:
        """(first word, label) of phrases; words count through all texts of the batch."""
        out = []
        for label, own in self.phrases:
            n = len(words.hash) - len(own) + 1
            if n <= 0 or not len(own):
                continue
            at = np.flatnonzero(words.hash[:n] == own[0])
            at = at[words.doc[at] == words.doc[at + len(own) - 1]]
            for j in range(1, len(own)):
                at = at[words.hash[at + j] == own[j]]
            out += [(int(x), label) for x in at]
        return out

    def blocks(self, words: Words) -> list[tuple[int, int, int, int, float, int, bool]]:
        """Runs of windows that reach the threshold: (first window's first word, windows, template, first word of
        the best, its containment, its words, whether it gives its label), sorted. Of the windows of a run, those that
        hold the licence's name are better than others.
        """
        bounds = words.bounds()
        reach: dict[tuple[int, int], list[int]] = {}  # of a text and template: from where to where its prefix words stand
        for at in self.lookup.find(words.hash)[0].tolist():
            doc = int(words.doc[at])
            for i in self.of_token[int(words.hash[at])]:
                reach.setdefault((doc, i), [at, at])[1] = at
        out = []
        for (doc, i), (lo, hi) in reach.items():
            _, size, tokens, need, _ = self.templates[i]
            begin, end = int(bounds[doc]), int(bounds[doc + 1])
            if end - begin < need:
                continue
            start, stop = max(begin, lo - size + 1), max(begin, min(hi, end - size)) + 1  # windows that hold one of them
            share = _held(words.hash[start : min(end, stop - 1 + size)], tokens, size, stop - start)
            enough = np.concatenate(([0], (share >= need).astype(np.int8), [0]))
            if not enough.any():
                continue
            names = self.names[i]
            named = _held(words.hash[start : min(end, stop - 1 + size)], names, size, stop - start) == len(names) if len(names) else np.ones(len(share), bool)
            for a, b in np.flatnonzero(np.diff(enough)).reshape(-1, 2).tolist():
                best = a + int((share[a:b] + named[a:b] * (len(tokens) + 1)).argmax())
                out.append((start + a, b - a, i, start + best, float(share[best] / len(tokens)), min(size, end - begin), bool(named[best])))
        return self._told_apart(sorted(out))

    def _told_apart(self, blocks: list[tuple]) -> list[tuple]:
        """The same blocks; those that a sibling's named block overlaps with more of its own words give no label."""
        held = [round(b[4] * len(self.templates[b[2]][2])) for b in blocks]
        reach = [(b[0], b[0] + b[1] + b[5] - 1) for b in blocks]
        longest = max((hi - lo for lo, hi in reach), default=0)
        starts = [lo for lo, _ in reach]
        out = []
        for k, b in enumerate(blocks):
            named, (lo, hi) = b[6], reach[k]
            if named and self.siblings[b[2]]:
                near = range(bisect.bisect_left(starts, lo - longest), bisect.bisect_left(starts, hi))
                named = not any(blocks[j][2] in self.siblings[b[2]] and blocks[j][6] and held[j] > held[k] and reach[j][1] > lo for j in near)
            out.append((*b[:6], named))
        return out


def _held(hashes: np.ndarray, tokens: np.ndarray, size: int, starts: int) -> np.ndarray:
    """How many of the tokens (sorted) each window of ``size`` words holds; windows begin at the first ``starts`` words."""
    kind = np.searchsorted(tokens, hashes)
    at = np.flatnonzero(tokens[np.minimum(kind, len(tokens) - 1)] == hashes)
    order = at[np.argsort(kind[at], kind="stable")]
    before = np.full(len(order), -1)  # where the same token stands before
    same = kind[order[1:]] == kind[order[:-1]]
    before[1:][same] = order[:-1][same]
    first = np.minimum(np.maximum(before + 1, order - size + 1), starts)
    edge = np.zeros(starts + 1, np.int64)
    np.add.at(edge, first, 1)
    np.add.at(edge, np.maximum(np.minimum(order + 1, starts), first), -1)
    return np.cumsum(edge[:-1])


_BLOCKS = "array<struct<first: long, last: long, windows: long, template: int, label: string, best: long, containment: double, named: boolean>>"
_BLOCK_TYPE = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("windows", pa.int64()), ("template", pa.int32()), ("label", pa.string()), ("best", pa.int64()), ("containment", pa.float64()), ("named", pa.bool_())]))


def _scan(templates: tuple, phrases: tuple, order: dict[int, int], threshold: float, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, phrases, order, threshold)
        for batch in batches:
            for lo, texts in text_batches(batch, limit=1 << 21):
                words = split_words(texts, ALNUM)
                bounds, n = words.bounds(), len(texts)
                places: list[list[int]] = [[] for _ in range(n)]
                names: list[set[str]] = [set() for _ in range(n)]
                for at, label in scanner.base(words):
                    k = words.doc[at]
                    places[k].append(int(at - bounds[k]))
                    names[k].add(label)
                blocks: list[list[dict]] = [[] for _ in range(n)]
                for at, windows, i, best, share, size, named in scanner.blocks(words):
                    k = words.doc[at]
                    first = int(at - bounds[k])
                    blocks[k].append({"first": first, "last": first + windows + size - 2, "windows": windows, "template": i, "label": templates[i][0], "best": int(best - bounds[k]), "containment": share, "named": named})
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, n).cast(id_type), pa.array(np.diff(bounds)), pa.array([len(p) for p in places], pa.int64()),
                        pa.array([min(p, default=None) for p in places], pa.int64()), pa.array([max(p, default=None) for p in places], pa.int64()),
                        pa.array([sorted(x) for x in names], pa.list_(pa.string())), pa.array(blocks, _BLOCK_TYPE),
                    ],
                    ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "blocks"],
                )

    return run


def scan_licences(docs: DataFrame, *, templates: tuple = TEMPLATES, phrases: tuple = PHRASES, threshold: float = 0.8) -> DataFrame:
    """Licence phrases and template blocks of every row of docs (doc_id, text; other columns are ignored).

    Returns doc_id, n_words, n_base, first_word, last_word (phrases: places, smallest and largest start in words
    from 0, null without one), base_labels and labels (sorted arrays; labels adds those of named blocks), blocks, score
    (1 with a phrase, else the best containment of a named block, else 0) and closest (the label of the named block
    with the highest containment, of equal ones the one of the longest template, then the first label; null without one).

    A block entry is a run of windows of one template that begin one word after the other and all have a
    containment of at least ``threshold``: first and last word of the run, number of windows, the template's number
    and label, where the best window begins, its containment, and whether it is named: it holds the words that name its
    licence, and no sibling's block overlaps it with more words. Related licences have entries each.

    A template is (label, text) or (label, text, words that name it).

    Null and empty texts have no words. Repeated rows give the same result each. A text shorter than a
    template is one block.
    """
    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType
    tokens = np.unique(np.concatenate([np.empty(0, np.uint64), *_words([t[1] for t in templates])]))
    counted = docs.select("text").mapInArrow(_count(tokens), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()  # a row for each template word
    order = {r["token"] & (2**64 - 1): r["n"] for r in counted}
    schema = f"doc_id {kind.simpleString()}, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, blocks {_BLOCKS}"
    found = docs.mapInArrow(lean(_scan(templates, phrases, order, threshold, to_arrow_type(kind))), schema)
    named = F.filter("blocks", lambda b: b["named"])
    labels = F.array_sort(F.array_union("base_labels", F.transform(named, lambda b: b["label"])))
    sizes = F.array(*(F.lit(len(w)) for w in _words([t[1] for t in templates])))
    by = F.transform(named, lambda b: F.struct(-b["containment"], -sizes[b["template"]], b["label"].alias("label")))
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform(named, lambda b: b["containment"])), F.lit(0.0)))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", labels.alias("labels"), "blocks", score.alias("score"), F.array_min(by)["label"].alias("closest"))
