"""License scans by template markup.

A template is mandatory wording with marked regions: ``<<optional>> ... <<end>>`` may be left out and ``<<var a-b>>``
stands for any a to b words, such as a holder's name. All templates are compiled into one automaton over words: a state is
a place in a template, an optional region adds a step around itself, a replaceable one a chain of steps on any word. It
is made deterministic as far as texts ask for it. A text is accepted from a word on if every mandatory word is there, in
place and exact; case, punctuation and white space play no part.

The phrases of the base labels are templates without regions; their places are the same automaton's.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of a text as UTF-8, after lower-casing A-Z.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_MARK = re.compile(r"<<(optional|end|var (\d+)-(\d+))>>")
#: Most deterministic steps kept; beyond that they are forgotten and found again.
STEPS = 200_000

# Base phrases, spellings that count as one, notices and license texts with their regions.
BASE = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}
SPELLINGS = {"license": ["licence"], "licensed": ["licenced"], "sublicense": ["sublicence"], "merchantability": ["merchantibility"]}
_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
    WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
    <<optional>> <<var 0-6>> <<end>> AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF
    CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE"""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
    conditions are met: <<optional>> 1 <<end>> Redistributions of source code must retain the above copyright notice, this list of conditions and the following
    disclaimer. <<optional>> 2 <<end>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
    documentation and/or other materials provided with the distribution."""
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY <<var 1-20>> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
    WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL <<var 1-20>> BE LIABLE FOR ANY DIRECT, INDIRECT,
    INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE,
    DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING
    NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE"""
_GNU = "This <<var 1-4>> is free software <<optional>>;<<end>> you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version"
TEMPLATES: list[tuple[str, str]] = [
    ("MIT", "<<optional>> released <<end>> <<optional>> licensed <<end>> under the <<optional>> terms of the <<end>> MIT license"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the "
     "Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
     "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice "
     "<<optional>> (including the next paragraph) <<end>> shall be included in all copies or substantial portions of the Software. " + _WARRANTY),
    ("Apache-2.0", "licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
     "<<var 1-12>> Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS "
     "OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License"),
    ("GPL-2.0", "licensed under the <<optional>> terms of the <<end>> GNU General Public License <<optional>> GPL <<end>> <<optional>> as published by the Free Software Foundation <<end>> version 2"),
    ("GPL-3.0", "licensed under the <<optional>> terms of the <<end>> GNU General Public License <<optional>> GPL <<end>> <<optional>> as published by the Free Software Foundation <<end>> version 3"),
    ("GPL-2.0-or-later", _GNU.format("General Public License", "2")),
    ("GPL-3.0-or-later", _GNU.format("General Public License", "3")),
    ("LGPL-2.1-or-later", _GNU.format("Lesser General Public License", "2.1")),
    ("LGPL-3.0-or-later", _GNU.format("Lesser General Public License", "3")),
    ("AGPL-3.0-or-later", _GNU.format("Affero General Public License", "3")),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_TAIL),
    ("BSD-3-Clause", _BSD_HEAD + " <<optional>> 3 <<end>> Neither the name of <<var 1-20>> nor the names of <<var 1-6>> contributors may be used to endorse or promote products derived from this software "
     "without specific prior written permission. " + _BSD_TAIL),
    ("ISC", "Permission to use, copy, modify, and <<optional>> / or <<end>> distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this "
     "permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND <<var 1-12>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF "
     "MERCHANTABILITY AND FITNESS"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at <<var 1-8>>"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software"),
    *[(f"CC-{kind}-4.0", f"licensed under <<optional>> a <<end>> CC {kind} 4.0") for kind in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND")],
    ("CC-BY-4.0", "licensed under <<optional>> a <<end>> <<optional>> the <<end>> Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "licensed under <<optional>> a <<end>> <<optional>> the <<end>> Creative Commons Attribution-NonCommercial 4.0 International License"),
    *[(name, f"SPDX-License-Identifier: {name}") for name in ("MIT", "Apache-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "BSD-2-Clause", "BSD-3-Clause", "ISC", "MPL-2.0", "Unlicense", "Zlib")],
]


def words(text: bytes) -> list[bytes]:
    return WORD.findall(text.lower())  # bytes: A-Z only


class Automaton:
    """The templates' places, made deterministic on demand. A template is (label, whether it is a base phrase, markup)."""

    def __init__(self, templates: Sequence[tuple[str, bool, str]]):
        self.takes: list[frozenset[bytes] | None] = []
        self.jumps: list[list[int]] = []
        self.final: dict[int, int] = {}
        self.labels = [(label, base) for label, base, _ in templates]
        begin = [self._compile(number, markup, spellings=not base) for number, (_, base, markup) in enumerate(templates)]
        self.known = frozenset(w for t in self.takes if t for w in t)
        self.moves: dict[tuple[frozenset[int], bytes | None], frozenset[int]] = {}
        self.start = self._closed(begin)
        self.firsts = frozenset(w for s in self.start if self.takes[s] for w in self.takes[s])

    def _place(self, takes: frozenset[bytes] | None) -> int:
        self.takes.append(takes)
        self.jumps.append([])
        return len(self.takes) - 1

    def _compile(self, number: int, markup: str, spellings: bool) -> int:
        """Adds a template's places, one behind the other, and gives the first one."""
        first = len(self.takes)
        opened: list[int] = []
        done = 0
        for mark in [*_MARK.finditer(markup), None]:
            for word in words(markup[done : mark.start() if mark else len(markup)].encode()):
                more = {x for s in SPELLINGS.get(word.decode(), ()) for x in words(s.encode())} if spellings else set()
                self._place(frozenset({word, *more}))
            if mark is None:
                break
            done = mark.end()
            if mark[1] == "optional":
                opened.append(self._place(frozenset()))
            elif mark[1] == "end":
                self.jumps[opened.pop()].append(len(self.takes))
            else:
                least, most = int(mark[2]), int(mark[3])
                chain = [self._place(None) for _ in range(most)]
                for place in chain[least:]:
                    self.jumps[place].append(len(self.takes))
        if opened:
            raise ValueError(f"template {number}: a region is not closed")
        last = self._place(frozenset())
        self.final[last] = number
        if self.takes[first] is None:
            raise ValueError(f"template {number} begins with a replaceable region")
        return first

    def _closed(self, places: Sequence[int]) -> frozenset[int]:
        """With the places that can be reached without a word; a place that takes no word at all leads to the next one."""
        out, open_ = set(), list(places)
        while open_:
            place = open_.pop()
            if place not in out:
                out.add(place)
                open_ += self.jumps[place]
                if self.takes[place] == frozenset() and place not in self.final:
                    open_.append(place + 1)
        return frozenset(out)

    def step(self, places: frozenset[int], word: bytes) -> frozenset[int]:
        key = (places, word if word in self.known else None)
        if (found := self.moves.get(key)) is None:
            if len(self.moves) >= STEPS:
                self.moves.clear()
            found = self.moves[key] = self._closed([p + 1 for p in places if (t := self.takes[p]) is None or word in t])
        return found

    def spans(self, text: Sequence[bytes]) -> list[tuple[int, int, int]]:
        """(start, end, template) of every place where a template is accepted, the longest end for each start."""
        found = []
        firsts, n = self.firsts, len(text)
        for begin in [i for i, w in enumerate(text) if w in firsts]:
            places, at, ends = self.start, begin, {}
            while places and at < n:
                places = self.step(places, text[at])
                at += 1
                for place in places & self.final.keys():
                    ends[self.final[place]] = at
            found += [(begin, end, template) for template, end in sorted(ends.items())]
        return found


def compiled(templates: Sequence[tuple[str, str]] = TEMPLATES, base: dict[str, str] = BASE) -> Automaton:
    return Automaton([*((label, True, phrase) for label, phrase in base.items()), *((label, False, markup) for label, markup in templates)])


def covered(spans: Sequence[tuple[int, int, int]]) -> int:
    """Words in at least one span; spans come by start."""
    total = reach = 0
    for start, end, _ in spans:
        total += max(0, end - max(start, reach))
        reach = max(reach, end)
    return total


SCANNED = "doc_id long, n_words long, n_covered long, spans array<struct<label: string, base: boolean, start: long, end: long>>"


def scan(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, base: dict[str, str] = BASE) -> DataFrame:
    """doc_id, n_words, n_covered (words in a span), spans (label, base, start, end in words, the end excluded) of every row.

    Null and empty texts have no words; whole texts are read, however long, and the time grows with the words, since a
    template's length is bounded. Repeated rows and null ids are rows of their own; at one start several templates may be
    accepted, in the order of the templates. An empty table gives an empty one; other columns are ignored.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(docs.sparkSession.createDataFrame([], SCANNED).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = compiled(templates, base)
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                text_words = words(text.as_py())
                spans = automaton.spans(text_words)
                out.append({"doc_id": doc_id, "n_words": len(text_words), "n_covered": covered(spans), "spans": [{"label": automaton.labels[t][0], "base": automaton.labels[t][1], "start": s, "end": e} for s, e, t in spans]})
            yield pa.RecordBatch.from_pylist(out, schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text")).mapInArrow(run, SCANNED)


def label_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row; score is the share of the
    words that lie in a span, 0 without words. Edge cases are those of ``scan``."""
    said = scan(docs)
    based = F.filter("spans", lambda s: s["base"])
    names = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    starts = F.transform(based, lambda s: s["start"])
    return said.select(
        "doc_id", "n_words", F.size(based).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), names(based).alias("base_labels"),
        names(F.col("spans")).alias("labels"), F.when(F.col("n_words") > 0, F.col("n_covered") / F.col("n_words")).otherwise(0.0).alias("score"),
    )
