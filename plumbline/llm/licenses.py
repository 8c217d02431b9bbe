"""License scans by patience alignment of texts with license templates.

A text and a template are aligned by anchoring on the words that are unique in both, keeping the longest run of anchors
that is increasing in both, and aligning the gaps between anchors the same way. Coverage is the share of the
template's words that are aligned; a place counts from ``LEAST`` on.

A whole document seldom has unique words, and it may hold a license twice, so alignments start at places. A template may have
identifying phrases, those that tell it from its relatives (name and version). They have to stand in a place word by word,
whatever its coverage, so places are the occurrences of the first of them, and what lies before and behind it is aligned.
Without phrases, at most ``(1 - LEAST)`` of a template's words can be missing, so one of its rarest words in the document, one
more than may be missing, occurs in every place that counts. Every occurrence in the whole text is visited. A window around
it has the template's length at first and grows, up to ``STRETCH`` lengths on both sides, until the place counts; so other words
(comment marks, line numbers) may stand between those of a license.

Of places that use the same words the one with most aligned words is kept; another stays if the words left to it still count.

Defined cases: null texts and texts without words hold no license; repeated rows each get their result; a template without
words is ignored; a phrase that its template lacks is an error.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import slices, utf8, words

LEAST = 0.8
#: a place lies within this many lengths of its template before and behind
STRETCH = 4
#: words of all templates together, which are sent to every task
MOST_WORDS = 1_000_000

_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
    WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT
    HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT
    OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_START = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
    conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the
    following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
    following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_NAME = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
    derived from this software without specific prior written permission."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING,
    BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL
    THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES
    (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)
    HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE)
    ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""


def _gpl_header(name: str, version: str) -> str:
    return f"""This program is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the
        Free Software Foundation, either version {version} of the License, or (at your option) any later version. This program is
        distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or
        FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details."""


# fixed values: public license notices and texts, which have to be as they are published
TEMPLATES = {
    "agpl-3.0-header": _gpl_header("GNU Affero General Public License", "3"),
    "agpl-3.0-notice": "This work is licensed under the GNU Affero General Public License, version 3.",
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required
        by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
        WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
        permissions and limitations under the License.""",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "bsd-2-clause": f"{_BSD_START} {_BSD_END}",
    "bsd-3-clause": f"{_BSD_START} {_BSD_NAME} {_BSD_END}",
    "bsd-notice": "Released under the BSD License.",
    "cc-by-4.0-notice": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "gpl-2.0-header": _gpl_header("GNU General Public License", "2"),
    "gpl-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-3.0-header": _gpl_header("GNU General Public License", "3"),
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
        provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE
        AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO
        EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING
        FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN
        CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "lgpl-3.0-header": _gpl_header("GNU Lesser General Public License", "3"),
    "lgpl-3.0-notice": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "mit": f"""Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to
        use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
        Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall
        be included in all copies or substantial portions of the Software. {_WARRANTY}""",
    "mit-notice": "Released under the MIT License.",
    "mpl-2.0-header": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "mpl-2.0-notice": "Licensed under the Mozilla Public License, Version 2.0.",
}

#: what tells a license from its relatives; each phrase is part of the template and has to stand in the text without a gap
PHRASES = {
    "agpl-3.0-header": ["GNU Affero General Public License", "version 3 of the License"],
    "agpl-3.0-notice": ["GNU Affero General Public License, version 3"],
    "all-rights-reserved": ["All rights reserved"],
    "apache-2.0-header": ["Apache License, Version 2.0"],
    "apache-2.0-notice": ["Apache License, Version 2.0"],
    "bsd-3-clause": ["Neither the name of"],
    "bsd-notice": ["BSD License"],
    "cc-by-4.0-notice": ["CC BY 4.0"],
    "cc-by-nc-4.0-notice": ["CC BY-NC 4.0"],
    "cc-by-sa-4.0-notice": ["CC BY-SA 4.0"],
    "gpl-2.0-header": ["GNU General Public License", "version 2 of the License"],
    "gpl-2.0-notice": ["GNU General Public License, version 2"],
    "gpl-3.0-header": ["GNU General Public License", "version 3 of the License"],
    "gpl-3.0-notice": ["GNU General Public License, version 3"],
    "lgpl-3.0-header": ["GNU Lesser General Public License", "version 3 of the License"],
    "lgpl-3.0-notice": ["GNU Lesser General Public License, version 3"],
    "mit-notice": ["MIT License"],
    "mpl-2.0-header": ["Mozilla Public License"],
    "mpl-2.0-notice": ["Mozilla Public License, Version 2.0"],
}


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of (place in the text, place in the template), sorted by the first, that increases in the second."""
    tails, ends, before = [], [], []
    for index, (_, j) in enumerate(pairs):
        at = bisect_left(tails, j)
        tails[at : at + 1] = [j]
        ends[at : at + 1] = [index]
        before.append(ends[at - 1] if at else -1)
    run, index = [], ends[-1] if ends else -1
    while index >= 0:
        run.append(pairs[index])
        index = before[index]
    return run[::-1]


def align(text: list[bytes], template: list[bytes]) -> list[tuple[int, int]]:
    """Patience alignment: pairs of equal words, increasing in both."""
    matched, gaps = [], [(0, len(text), 0, len(template))]
    while gaps:
        a, b, c, d = gaps.pop()
        while a < b and c < d and text[a] == template[c]:
            matched.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            matched.append((b, d))
        if a == b or c == d:
            continue
        mine, its = Counter(text[a:b]), Counter(template[c:d])
        place = {template[j]: j for j in range(c, d) if its[template[j]] == 1 and mine[template[j]] == 1}
        anchors = _increasing([(i, place[text[i]]) for i in range(a, b) if text[i] in place])
        if not anchors:
            continue
        for (i, j), (k, m) in zip([(a - 1, c - 1), *anchors], [*anchors, (b, d)]):
            if i >= a:
                matched.append((i, j))
            if i + 1 < k and j + 1 < m:
                gaps.append((i + 1, k, j + 1, m))
    return sorted(matched)


@dataclass
class Template:
    name: str
    sequence: list[bytes]
    distinct: list[bytes]
    missing: int  #: words that a place may lack
    phrases: list[tuple[int, int]]  #: begin and end, in the template, of what has to stand in a place word by word
    counts: Counter


def prepared(templates: Mapping[str, str], phrases: Mapping[str, Sequence[str]], least: float) -> list[Template]:
    out = []
    for name, text in templates.items():
        if sequence := words(text.encode()):
            allowed = int((1 - least) * len(sequence) + 1e-9)
            spans = []
            for phrase in phrases.get(name, ()):
                needed = words(phrase.encode())
                begin = next((i for i in range(len(sequence)) if needed and sequence[i : i + len(needed)] == needed), None)
                if begin is None:
                    raise ValueError(f"{name} does not hold its phrase {phrase!r}")
                spans.append((begin, begin + len(needed)))
            # longer words first: they are rarer, so documents without the license are left sooner
            distinct = sorted(set(sequence), key=lambda w: (-len(w), w))
            out.append(Template(name, sequence, distinct, allowed, spans, Counter(sequence)))
    if sum(len(t.sequence) for t in out) > MOST_WORDS:
        raise ValueError(f"templates have more than {MOST_WORDS} words")
    return out


def read_templates(table: DataFrame) -> tuple[dict[str, str], dict[str, list[str]]]:
    """Templates and phrases from a table ``(name, text, phrases array<string>)``, for :func:`scan`.

    They go to every task, so a table beyond ``MOST_WORDS`` words, counted before it is fetched, is refused.
    """
    counted = table.agg(F.coalesce(F.sum(F.size(F.split("text", r"\s+"))), F.lit(0))).first()[0]
    if counted > MOST_WORDS:
        raise ValueError(f"templates have more than {MOST_WORDS} words")
    rows = table.filter("name IS NOT NULL AND text IS NOT NULL").select("name", "text", "phrases").collect()
    return {r["name"]: r["text"] for r in rows}, {r["name"]: list(r["phrases"] or ()) for r in rows}


def _shared(text: list[bytes], counts: Counter) -> int:
    """How many words a text and a template can have in common at most, whatever their order."""
    mine = Counter(w for w in text if w in counts)
    return sum(min(n, counts[w]) for w, n in mine.items())


def _around(text: list[bytes], template: Template, at: dict[bytes, list[int]], least: float) -> Iterator[list[tuple[int, int]]]:
    """The first alignment that counts around each possible start of a place; its pairs are places in the text and the template."""
    sequence, size = template.sequence, len(template.sequence)
    begin, end = template.phrases[0] if template.phrases else (0, 0)
    if template.phrases:
        phrase = sequence[begin:end]
        rarest = min(range(len(phrase)), key=lambda k: len(at.get(phrase[k], ())))
        found = (i - rarest for i in at.get(phrase[rarest], ()))
        starts = [i - begin for i in found if i >= 0 and text[i : i + len(phrase)] == phrase]
    else:
        rare = sorted(template.distinct, key=lambda w: len(at.get(w, ())))[: template.missing + 1]
        offsets = {w: [j for j, x in enumerate(sequence) if x == w] for w in rare}
        starts = sorted({i - j for w in rare for i in at.get(w, ()) for j in offsets[w]})
    for start in starts:
        # the tight window first: in a wide one a neighbouring copy may leave no word unique
        for slack in (0, size // 4 + 2, *[size * k for k in range(1, STRETCH + 1)]):
            low, high = max(0, start - slack), max(0, start + size + slack)
            if _shared(text[low:high], template.counts) < least * size - 1e-9:
                continue
            if template.phrases:
                i = start + begin
                before = [(low + a, b) for a, b in align(text[low:i], sequence[:begin])]
                inside = [(i + k, begin + k) for k in range(end - begin)]
                behind = [(i + end - begin + a, end + b) for a, b in align(text[i + end - begin : high], sequence[end:])]
                pairs = before + inside + behind
            else:
                pairs = [(low + a, b) for a, b in align(text[low:high], sequence)]
            if len(pairs) >= least * size - 1e-9 and _whole(pairs, template.phrases[1:]):
                yield pairs
                break


def _whole(pairs: list[tuple[int, int]], phrases: list[tuple[int, int]]) -> bool:
    """Whether every phrase is aligned without a gap."""
    where = {j: i for i, j in pairs} if phrases else {}
    return all(b in where and all(where.get(j) == where[b] + j - b for j in range(b, e)) for b, e in phrases)


def places(text: list[bytes], templates: list[Template], vocabulary: set[bytes], least: float) -> list[tuple[str, float, int, int]]:
    """(template, coverage, first word, end) of every place, by template and place."""
    at: dict[bytes, list[int]] = {}
    for i, word in enumerate(text):
        if word in vocabulary:
            at.setdefault(word, []).append(i)
    found = []
    for template in templates:
        if any(w not in at for b, e in template.phrases for w in template.sequence[b:e]):
            continue
        lacking = 0
        for word in template.distinct:
            if word not in at:
                lacking += 1
                if lacking > template.missing:
                    break
        if lacking > template.missing:
            continue
        for pairs in _around(text, template, at, least):
            found.append((-len(pairs), -len(pairs) / len(template.sequence), pairs[0][0], template.name, pairs, len(template.sequence)))
    out = []
    used: set[int] = set()
    for matched, coverage, first, name, pairs, size in sorted(found, key=lambda f: f[:4]):
        own = [i for i, _ in pairs]
        if sum(i not in used for i in own) >= least * size - 1e-9:
            used.update(own)
            out.append((name, -coverage, first, own[-1] + 1))
    return sorted(out, key=lambda p: (p[0], p[2]))


def scan(
    docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, doc_id: str = "doc_id", text: str = "text", least: float = LEAST,
    phrases: Mapping[str, Sequence[str]] | None = None,
) -> DataFrame:
    """(doc_id, places): template, coverage, first word and end of every place in each document.

    ``phrases`` are the identifying phrases by template name; by default those of the templates given here.
    """
    ready = prepared(templates, (PHRASES if templates is TEMPLATES else {}) if phrases is None else phrases, least)
    vocabulary = {w for t in ready for w in t.distinct}
    source = docs.select(F.col(doc_id).alias("doc_id"), utf8(text).alias("bytes"))
    kind = pa.list_(pa.struct([("template", pa.string()), ("coverage", pa.float64()), ("first_word", pa.int32()), ("end_word", pa.int32())]))
    names = [field.name for field in kind.value_type]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "bytes"):
            found = [[dict(zip(names, p)) for p in places(words(t), ready, vocabulary, least)] for t in batch.column("bytes").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, kind)], names=["doc_id", "places"])

    id_kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {id_kind}, places array<struct<template:string,coverage:double,first_word:int,end_word:int>>")
