"""Licence scan with a positional index of rare words."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import batches_of, binaries


class Template(NamedTuple):
    """A licence notice: its words, and the phrases it must hold, by place and length."""

    label: str
    words: str
    phrases: tuple[tuple[int, int], ...]


#: The phrases that are always reported, and their labels.
BASE = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}
#: Own notices besides; the phrases are (first word, number of words).
NOTICES = (
    Template("apache", "licensed under the apache license version 2 0", ((0, 2), (3, 2))),
    Template(
        "gpl",
        "this work is licensed under the gnu general public license version 3",
        ((6, 4),),
    ),
    Template("mit", "this software is released under the mit license", ((6, 2),)),
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy",
        ((0, 4), (8, 5)),
    ),
    Template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are "
        "permitted",
        ((0, 8), (12, 2)),
    ),
    Template("mpl", "mozilla public license version 2 0", ((0, 3),)),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ((2, 3),)),
    Template("cc-by-sa", "licensed under cc by sa 4 0", ((2, 3),)),
    Template("cc-by", "licensed under cc by 4 0", ((0, 4), (4, 2))),
    Template("reserved", "all rights reserved", ((0, 3),)),
)
#: The common notices in full, with their key phrases in order.
FULL_NOTICES = (
    (
        "mit",
        """
        Permission is hereby granted, free of charge, to any person obtaining a copy of this
        software and associated documentation files (the "Software"), to deal in the Software
        without restriction, including without limitation the rights to use, copy, modify, merge,
        publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons
        to whom the Software is furnished to do so, subject to the following conditions:

        The above copyright notice and this permission notice shall be included in all copies or
        substantial portions of the Software.

        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED,
        INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR
        PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE
        FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
        OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
        DEALINGS IN THE SOFTWARE.
        """,
        ("permission is hereby granted", "without restriction", "this permission notice shall be",
         "without warranty of any kind"),
    ),
    (
        "bsd",
        """
        Redistribution and use in source and binary forms, with or without modification, are
        permitted provided that the following conditions are met:

        1. Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer.

        2. Redistributions in binary form must reproduce the above copyright notice, this list of
        conditions and the following disclaimer in the documentation and/or other materials
        provided with the distribution.

        THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS
        OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF
        MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.
        """,
        ("redistribution and use in source and binary forms", "must retain the above copyright notice",
         "must reproduce the above copyright notice", "are disclaimed"),
    ),
    (
        "apache",
        """
        Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file
        except in compliance with the License. You may obtain a copy of the License at

        http://www.apache.org/licenses/LICENSE-2.0

        Unless required by applicable law or agreed to in writing, software distributed under the
        License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND,
        either express or implied. See the License for the specific language governing permissions
        and limitations under the License.
        """,
        ("apache license version 2 0", "in compliance with the license",
         "unless required by applicable law", "governing permissions and limitations"),
    ),
    (
        "gpl",
        """
        This program is free software: you can redistribute it and/or modify it under the terms of
        the GNU General Public License as published by the Free Software Foundation, either version
        3 of the License, or (at your option) any later version.

        This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;
        without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.
        See the GNU General Public License for more details.

        You should have received a copy of the GNU General Public License along with this program.
        """,
        ("free software", "gnu general public license as published by", "without any warranty",
         "you should have received a copy"),
    ),
    (
        "isc",
        """
        Permission to use, copy, modify, and/or distribute this software for any purpose with or
        without fee is hereby granted, provided that the above copyright notice and this permission
        notice appear in all copies.

        THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS
        SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.
        """,
        ("for any purpose with or without fee", "appear in all copies", "the author disclaims all warranties"),
    ),
    (
        "mpl",
        """
        This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a
        copy of the MPL was not distributed with this file, You can obtain one at
        https://mozilla.org/MPL/2.0/.
        """,
        ("subject to the terms of the mozilla public license", "was not distributed with this file"),
    ),
)
#: Of a notice's words (by weight), the least share found in place.
LEAST_SHARE = 0.6
#: Of a file's licence words, the rarest ones that choose the notices to try.
RARE_WORDS = 16

_SIGNS = bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B))
#: A-Z become lower case, other ASCII signs but digits and letters become spaces.
_TABLE = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or b in _SIGNS else 0x20 for b in range(256)
)


def license_words(text: bytes | None) -> list[bytes]:
    """The words of a text: runs of ASCII letters, digits and non-ASCII signs, lower-cased."""
    return (text or b"").translate(_TABLE).split()


def notice(label: str, text: str, phrases: Iterable[str]) -> Template:
    """The template of a notice's text and its key phrases, which stand in it in this order."""
    words, places, at = license_words(text.encode()), [], 0
    for phrase in phrases:
        own = license_words(phrase.encode())
        at = next(k for k in range(at, len(words)) if words[k : k + len(own)] == own)
        places.append((at, len(own)))
    return Template(label, b" ".join(words).decode(), tuple(places))


NOTICES += tuple(notice(*row) for row in FULL_NOTICES)


class Index:
    """Postings of licence words, (template, place), with the weight of each word.

    The first ``always`` templates are tried wherever their rarest word is.
    """

    def __init__(self, templates: tuple[Template, ...], idf: dict[str, float], always: int = 0):
        self.templates, self.always = templates, always
        self.words = [t.words.encode().split() for t in templates]
        self.weight = {w.encode(): max(x, 1e-6) for w, x in idf.items()}
        self.known = frozenset(self.weight)
        self.postings: dict[bytes, list[tuple[int, int]]] = {}
        self.rarest = []
        for k, (template, words) in enumerate(zip(templates, self.words)):
            mandatory = [w for first, n in template.phrases for w in words[first : first + n]]
            self.rarest.append(max(mandatory, key=lambda w: (self.weight[w], w)))
            for place, word in enumerate(words):
                self.postings.setdefault(word, []).append((k, place))
        self.gate = frozenset(self.rarest)

    def starts(self, phrase: list[bytes], places: dict[bytes, list[int]]) -> set[int]:
        """Where the words of a phrase stand one after another: postings are intersected by
        their place relative to the phrase's start, from its rarest word on."""
        order = sorted(range(len(phrase)), key=lambda k: -self.weight[phrase[k]])
        out: set[int] | None = None
        for k in order:
            here = {place - k for place in places.get(phrase[k], ())}
            out = here if out is None else out & here
            if not out:
                return set()
        return out or set()

    def aligned(self, k: int, places: dict[bytes, list[int]]) -> list[list[int]]:
        """Where the key phrases of a template stand, one after the other, for each place of the
        first one.

        Between two of them words may have been put in or left out: two, and one of four.
        """
        words, phrases = self.words[k], self.templates[k].phrases
        found: list[list[int]] = []
        for j, (first, n) in enumerate(phrases):
            starts = sorted(self.starts(words[first : first + n], places))
            if not j:
                found = [[start] for start in starts]
                continue
            before = phrases[j - 1][0]
            slack = 2 + (first - before) // 4
            ways = []
            for way in found:
                wanted = way[-1] + first - before
                near = [s for s in starts if abs(s - wanted) <= slack]
                if near:
                    ways.append([*way, min(near, key=lambda s: (abs(s - wanted), s))])
            found = ways
        return found

    def share(self, k: int, way: list[int], words: list[bytes]) -> float:
        """The share of a template's words, by weight, that stand where the phrase next before
        them (or the first one) says, a word or two off."""
        template, phrases = self.words[k], self.templates[k].phrases
        here = total = 0.0
        j = 0
        for place, word in enumerate(template):
            total += self.weight[word]
            while j + 1 < len(phrases) and phrases[j + 1][0] <= place:
                j += 1
            at = way[j] + place - phrases[j][0]
            if word in words[max(0, at - 2) : max(0, at + 3)]:
                here += self.weight[word]
        return here / total

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int, float]], int]:
        """All (template, start, share) of a text, and the number of its licence words.

        The text's own licence words with the highest inverse document frequency are looked up in
        the index, ``RARE_WORDS`` at a time, and name the templates to try. Their key phrases are
        then found by intersecting postings by relative place. Words of a notice that was found
        are explained; the rarest of the others are looked up next, until none is left, so a
        second notice is found beside one with rarer words.
        """
        found: list[tuple[int, int, float]] = []
        if not words or self.gate.isdisjoint(words):
            return found, 0
        places: dict[bytes, list[int]] = {}
        for place, word in enumerate(words):
            if word in self.known:
                places.setdefault(word, []).append(place)
        left = sorted(places, key=lambda w: (-self.weight[w], w))
        tried: set[int] = set()
        named = set(range(self.always))
        while named or left:
            for word in left[:RARE_WORDS]:
                named.update(k for k, _ in self.postings[word])
            explained = set(left[:RARE_WORDS])
            for k in sorted(named - tried):
                if self.rarest[k] not in places:
                    continue
                first = self.templates[k].phrases[0][0]
                for way in self.aligned(k, places):
                    found.append((k, way[0] - first, self.share(k, way, words)))
                    explained.update(self.words[k])
            tried |= named
            named = set()
            left = [word for word in left if word not in explained]
        return found, sum(map(len, places.values()))


def document_frequencies(
    docs: DataFrame, words: Iterable[str], text_column: str = "text"
) -> tuple[int, dict[str, int]]:
    """The number of documents, and of those that hold each of the given words.

    Every text is read; what reaches the driver is one number per word of the templates.
    """
    wanted = frozenset(w.encode() for w in words)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()
        for batch in batches:
            total[""] += batch.num_rows
            for text in binaries(batch.column(0)):
                total.update(w.decode() for w in wanted.intersection(license_words(text)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())],
            names=["word", "n"],
        )

    rows = (
        docs.select(F.col(text_column).alias("text"))
        .mapInArrow(count, "word string, n long")
        .groupBy("word")
        .agg(F.sum("n").alias("n"))
        .collect()
    )
    counts = {row["word"]: row["n"] for row in rows}
    return counts.pop("", 0), counts


def license_scan(
    docs: DataFrame,
    base: dict[str, str] = BASE,
    notices: tuple[Template, ...] = NOTICES,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Find licence notices in every whole text; one result row per row.

    The inverse document frequency of each licence word is counted over all documents. Columns:
    ``doc_id, n_words, n_base`` (places of base phrases), ``first_word, last_word`` (their
    smallest and largest start), ``base_labels, labels`` (distinct, sorted, comma-joined),
    ``score`` (the largest share of a notice found, 0 without one) and ``places`` (all notices
    found with label, start and share). A null text is empty; repeated rows and null ids give a
    row each; an empty table gives none.
    """
    whole = tuple(
        Template(label, phrase, ((0, len(phrase.split())),)) for phrase, label in base.items()
    )
    templates = whole + notices
    vocabulary = sorted({w for t in templates for w in t.words.split()})
    n_docs, counts = document_frequencies(docs, vocabulary, text_column)
    idf = {w: math.log((n_docs + 1) / (counts.get(w, 0) + 1)) for w in vocabulary}
    n_base = len(whole)

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(templates, idf, n_base)
        place = pa.list_(
            pa.struct([("label", pa.string()), ("start", pa.int64()), ("share", pa.float64())])
        )
        for batch in batches_of(batches, "text", 1 << 24):
            rows = []
            for text in binaries(batch.column("text")):
                words = license_words(text)
                found, _ = index.scan(words)
                starts = [start for k, start, _ in found if k < n_base]
                kept = [x for x in found if x[0] < n_base or x[2] >= LEAST_SHARE]
                labels = {templates[k].label for k, _, _ in kept}
                of_base = {templates[k].label for k, _, _ in found if k < n_base}
                rows.append(
                    (
                        len(words),
                        len(starts),
                        min(starts, default=None),
                        max(starts, default=None),
                        ",".join(sorted(of_base)),
                        ",".join(sorted(labels)),
                        max((min(share, 1.0) for _, _, share in kept), default=0.0),
                        [
                            {"label": templates[k].label, "start": start, "share": share}
                            for k, start, share in sorted(kept)
                        ],
                    )
                )
            columns = list(zip(*rows)) if rows else [()] * 8
            types = [*[pa.int64()] * 4, pa.string(), pa.string(), pa.float64(), place]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, types))],
                names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels",
                       "labels", "score", "places"],
            )

    source = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(
        scan,
        f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, "
        "base_labels string, labels string, score double, "
        "places array<struct<label string, start long, share double>>",
    )
