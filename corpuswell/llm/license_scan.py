"""License scans: base phrases by place, and an exact set-similarity join of text blocks with license templates."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuswell.llm._shared import whole_text
from corpuswell.llm._textkernels import LETTER_BYTE, segment_hashes, space_words

# Base phrases with their labels, and the texts of licenses, of the headers they ask for, and of short notices.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"),
to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and
this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND,
EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR
IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the
License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is
distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
permissions and limitations under the License."""
GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software
Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT
ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You
should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/."""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions
of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the
above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither
the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior
written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO,
THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR
ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF
USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE
OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice
and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH
THE USE OR PERFORMANCE OF THIS SOFTWARE."""


@dataclass(frozen=True)
class Template:
    """A text with its label; `distinctive` are words without which no block matches, for notices too short to be told by containment alone."""

    label: str
    text: str
    distinctive: tuple[str, ...] = ()

    def words(self) -> list[str]:
        own = Words([self.text.encode()])
        return [own.word(k) for k in range(len(own.hashes))]

    def block(self) -> tuple[int, int]:
        """(words of a block, words from one block's start to the next): each run of one and a half times the template's words stands whole in a block."""
        n = len(self.words())
        return 2 * n, max(1, n // 2)


TEMPLATES = (
    Template("mit", MIT), Template("apache-2", APACHE), Template("gpl-3", GPL), Template("bsd-3", BSD), Template("isc", ISC),
    Template("mit", "released under the MIT license", ("mit", "license")),
    Template("apache-2", "licensed under the Apache license version 2.0", ("apache", "license")),
    Template("cc-by-nc", "licensed under CC BY-NC 4.0", ("cc", "by", "nc")),
    Template("gpl-3", "this work is licensed under the GNU general public license version 3", ("gnu", "general", "public", "license")),
)


class Words:
    """The words of a batch of texts: hashes, and for each text the range of its words."""

    def __init__(self, texts: list[bytes]):
        cuts = np.cumsum([0, *[len(t) + 1 for t in texts]])
        self.data = b"\n".join(texts).lower() + b"\n"
        self.starts, self.ends = space_words(self.data, LETTER_BYTE)
        self.hashes = segment_hashes(np.frombuffer(self.data, np.uint8), self.starts, self.ends)
        self.texts = np.searchsorted(self.starts, cuts)

    def word(self, k: int) -> str:
        return self.data[self.starts[k] : self.ends[k]].decode()


def _hashes(words: list[str]) -> np.ndarray:
    return Words([" ".join(words).encode()]).hashes


def _batches(batches):
    for batch in batches:
        for lo in range(0, len(batch), 512):
            part = batch.slice(lo, 512)
            yield part.column(0), Words([t.as_py() for t in part.column(1).cast(pa.binary())])


def _count_tokens(tokens: list[str]):
    hashes = _hashes(tokens)

    def run(batches):
        order, total = np.argsort(hashes), np.zeros(len(tokens), np.int64)
        for _, words in _batches(batches):
            at = order[np.minimum(np.searchsorted(hashes[order], words.hashes), len(tokens) - 1)]
            total += np.bincount(at[hashes[at] == words.hashes], minlength=len(tokens))
        yield pa.record_batch([pa.array(tokens), pa.array(total)], ["token", "n"])

    return run


def token_order(rows: DataFrame, templates: tuple[Template, ...]) -> list[str]:
    """The templates' tokens, the rarest in all documents first. Only these are counted: how others
    rank among themselves changes neither a template's prefix nor the positions of its tokens."""
    tokens = sorted({w for t in templates for w in t.words()})
    counted = rows.mapInArrow(_count_tokens(tokens), "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
    n = {r["token"]: r["n"] for r in counted.collect()}  # a row per token of the templates
    return sorted(tokens, key=lambda t: (n.get(t, 0), t))


def template_matches(words: Words, order: list[str], templates: tuple[Template, ...], threshold: float) -> list[tuple[int, str, int, float]]:
    """(text, label, first word of the block, containment) of each block that holds enough of a template's tokens, and its distinctive ones.

    Blocks are candidates by the prefix filter: of T tokens of which `need` must be there, one of the T - need + 1 rarest is. The length filter
    leaves blocks of which fewer than `need` words are of any template; the positional filter those in which the tokens that follow the first common one, in
    frequency order, cannot be enough.
    """
    ids, rank = _hashes(order), {t: k for k, t in enumerate(order)}
    by_hash = np.argsort(ids)
    at = by_hash[np.minimum(np.searchsorted(ids[by_hash], words.hashes), len(ids) - 1)]
    token = np.where(ids[at] == words.hashes, at, -1)
    found = []
    for template in templates:
        own = np.array(sorted({rank[w] for w in template.words()}))
        need = math.ceil(threshold * len(own) - 1e-9)
        size, step = template.block()
        must = {rank[w] for w in template.distinctive}
        places = np.flatnonzero(np.isin(token, own[: len(own) - need + 1]))
        text = np.searchsorted(words.texts, places, side="right") - 1
        inside = places - words.texts[text]
        first, last = np.maximum(0, (inside - size) // step + 1), inside // step
        blocks = {(t, b) for t, x, y in zip(text.tolist(), first.tolist(), last.tolist()) for b in range(x, y + 1)}
        place_of = np.full(len(order), -1)
        place_of[own] = np.arange(len(own))
        for t, b in blocks:
            lo, end = int(words.texts[t]) + b * step, int(words.texts[t + 1])
            span = token[lo : min(end, lo + size)]
            span = span[span >= 0]
            if len(span) < need:
                continue
            common = np.unique(place_of[span])
            common = common[common >= 0]
            if not len(common) or len(own) - int(common[0]) < need or len(common) < need or not must <= set(own[common].tolist()):
                continue
            found.append((t, template.label, b * step, len(common) / len(own)))
    return sorted(found)


def phrase_places(words: Words, phrases: dict[str, str]) -> list[tuple[int, int, str]]:
    """(text, word, label) of each place where a phrase's words stand one after the other."""
    found = []
    for phrase, label in phrases.items():
        parts = phrase.split()
        wanted, n = _hashes(parts), len(words.hashes) - len(parts) + 1
        if n <= 0:
            continue
        hit = np.logical_and.reduce([words.hashes[k : n + k] == h for k, h in enumerate(wanted)])
        for place in np.flatnonzero(hit).tolist():
            text = int(np.searchsorted(words.texts, place, side="right")) - 1
            if place + len(parts) <= words.texts[text + 1] and [words.word(place + k) for k in range(len(parts))] == parts:
                found.append((text, place - int(words.texts[text]), label))
    return sorted(found)


_MATCH = pa.struct([("label", pa.string()), ("word", pa.int64()), ("containment", pa.float64())])
_PLACE = pa.struct([("word", pa.int64()), ("label", pa.string())])


def _scan(order: list[str], phrases: dict[str, str], templates: tuple[Template, ...], threshold: float):
    def run(batches):
        for ids, words in _batches(batches):
            places: list = [[] for _ in range(len(ids))]
            matches: list = [[] for _ in range(len(ids))]
            for text, word, label in phrase_places(words, phrases):
                places[text].append({"word": word, "label": label})
            for text, label, word, share in template_matches(words, order, templates, threshold):
                matches[text].append({"label": label, "word": word, "containment": share})
            yield pa.record_batch([ids, pa.array(np.diff(words.texts), pa.int64()), pa.array(places, pa.list_(_PLACE)), pa.array(matches, pa.list_(_MATCH))], ["doc_id", "n_words", "places", "matches"])

    return run


def scan_licenses(docs: DataFrame, phrases: dict[str, str] | None = None, templates: tuple[Template, ...] | None = None, threshold: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_words, places (array of word, label: where base phrases start, words from 0) and
    matches (array of label, word, containment: blocks, by their first word, that hold at least `threshold` of a template's tokens).

    Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased. Blocks are of twice a template's words, a new one every
    half of them, so that a text with words added stands whole in one, and no block holds so much that it holds everything. All texts are read twice: once
    to order the templates' tokens by frequency, once to scan. Nothing but these counts is shuffled.

    Null and empty texts have no words; repeated rows give a row each; an empty table gives none; a null key stays
    null; other columns are not read.
    """
    phrases, templates = phrases or PHRASES, templates or TEMPLATES
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), whole_text(text).alias("text"))
    order = token_order(rows, templates)
    schema = "doc_id long, n_words long, places array<struct<word: long, label: string>>, matches array<struct<label: string, word: long, containment: double>>"
    return rows.mapInArrow(_scan(order, phrases, templates, threshold), schema)
