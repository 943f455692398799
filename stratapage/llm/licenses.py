"""License scan: winnowed fingerprints pick candidates, banded alignment confirms them.

Templates are cut to word k-grams, of which winnowing keeps the smallest hash
of each window in an inverted index. A text's grams that the index holds vote
for (template, place); around each place a banded alignment counts the template
words that the text holds in order, and where.
"""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stratapage.llm.common import prepare
from stratapage.llm.decontaminate import BREAKS
from stratapage.llm.kernels import blocks, gram_hashes, sliding_min, word_hashes

#: Words of a gram, and grams of a winnowing window: a common run of GRAM + WINDOW - 1 words is always seen.
GRAM, WINDOW = 3, 2
#: Words by which an alignment may drift from its candidate's place.
BAND = 12
#: Share of a template's words that must match.
COVERAGE = 0.75

#: Templates of so many words at most are notices: all their grams are indexed, and their names and versions must match.
NOTICE_WORDS = 60
#: Words that name a license, the rarest in prose first; those of a notice must stand in its match, and the first of them is indexed alone.
NAMES = ("affero", "gnu", "mozilla", "apache", "cc", "commons", "mit", "isc", "bsd", "creative", "attribution", "by")
#: Words, besides numbers, that make another license of the same name: a notice's match has the same as the notice.
MODIFIERS = ("affero", "lesser", "library", "nc", "sa", "nd", "noncommercial", "sharealike", "noderivatives", "noderivs")

_PERMIT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_AS_IS = (
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. "
    "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
    "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, "
    "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
)
_MIT_AS_IS = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_GRANT = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
_BSD_ADVERTISING = "All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the organization."
_BSD_NAME = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_AS_IS = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)


def _gnu(program: str, name: str, version: str, later: bool) -> str:
    """The grant that the headers of the GNU licenses have."""
    if later:
        return f"{program} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."
    return f"{program} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} version {version} as published by the Free Software Foundation."


_GNU = [("GPL", "General Public License", v) for v in ("1.0", "2.0", "3.0")] + [("LGPL", "Library General Public License", "2.0"), ("LGPL", "Lesser General Public License", "2.1"), ("LGPL", "Lesser General Public License", "3.0"), ("AGPL", "Affero General Public License", "3.0")]
_CC = {"": "", "-NC": "-NonCommercial", "-SA": "-ShareAlike", "-ND": "-NoDerivatives", "-NC-SA": "-NonCommercial-ShareAlike", "-NC-ND": "-NonCommercial-NoDerivatives"}

#: Notices and grants of headers, and the whole texts of short licenses.
TEMPLATES = {
    "MIT": f"{_MIT_GRANT}, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_MIT_AS_IS}",
    "MIT-0": f"{_MIT_GRANT}. {_MIT_AS_IS}",
    "MIT-notice": "Released under the MIT License.",
    "ISC": f"{_PERMIT}, provided that the above copyright notice and this permission notice appear in all copies. {_ISC_AS_IS}",
    "0BSD": f"{_PERMIT}. {_ISC_AS_IS}",
    "BSD-2-Clause": f"{_BSD_GRANT} {_BSD_AS_IS}",
    "BSD-3-Clause": f"{_BSD_GRANT} {_BSD_NAME} {_BSD_AS_IS}",
    "BSD-4-Clause": f"{_BSD_GRANT} {_BSD_ADVERTISING} {_BSD_NAME} {_BSD_AS_IS}",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. "
    "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. "
    "We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. "
    + _MIT_AS_IS.replace("AUTHORS OR COPYRIGHT HOLDERS", "AUTHORS"),
}
for _short, _name, _version in _GNU:
    _said = _version.removesuffix(".0")
    TEMPLATES[f"{_short}-{_version}"] = _gnu("This program", _name, _said, True)
    TEMPLATES[f"{_short}-{_version}-only"] = _gnu("This program", _name, _said, False)
    TEMPLATES[f"{_short}-{_version}-notice"] = f"This work is licensed under the GNU {_name}, version {_said}."
for _short, _long in _CC.items():
    for _version, _where in (("4.0", " International"), ("3.0", " Unported"), ("2.5", " Generic"), ("2.0", " Generic")):
        TEMPLATES[f"CC-BY{_short}-{_version}"] = f"This work is licensed under a Creative Commons Attribution{_long} {_version}{_where} License."
        TEMPLATES[f"CC-BY{_short}-{_version}-notice"] = f"Licensed under CC BY{_short} {_version}."
#: Whole texts of long licenses, one file each.
TEMPLATES |= {f"{p.stem}-text": p.read_text() for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}


def _words(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return word_hashes(data, np.array([0, len(data)]), BREAKS)[0]


def winnow(grams: np.ndarray) -> np.ndarray:
    """Places of the grams kept: the smallest of each window, the rightmost of equals; all where they are fewer than a window."""
    n = len(grams)
    if n < WINDOW:
        return np.arange(n)
    least = sliding_min(grams, WINDOW)
    keep = np.zeros(n, bool)
    for i, value in enumerate(least.tolist()):
        keep[i + WINDOW - 1 - int((grams[i : i + WINDOW][::-1] == value).argmax())] = True
    return np.flatnonzero(keep)


class Index:
    """The inverted index of the templates' fingerprints."""

    def __init__(self, templates: dict[str, str]) -> None:
        self.names = sorted(templates)
        self.words = [_words(templates[n]) for n in self.names]
        gram, template, place = [], [], []
        names = dict(zip(_words(" ".join(NAMES)).tolist(), range(len(NAMES)), strict=True))
        self.modifiers = set(_words(" ".join(MODIFIERS) + " " + " ".join(map(str, range(10)))).tolist())
        #: of each notice, the words that its match must have; no others of the modifiers may stand in it
        self.required: list[set | None] = []
        self.alone: dict[int, list[tuple[int, int]]] = {}  # a word that is indexed alone -> (template, place)
        for t, words in enumerate(self.words):
            grams = gram_hashes(words, GRAM)
            notice = len(words) <= NOTICE_WORDS
            self.required.append({w for w in words.tolist() if w in names or w in self.modifiers} if notice else None)
            own = [w for w in words.tolist() if w in names] if notice else []
            if own:
                rarest = min(own, key=names.__getitem__)
                for i in np.flatnonzero(words == rarest).tolist():
                    self.alone.setdefault(rarest, []).append((t, i))
            for i in range(len(grams)) if notice else winnow(grams):
                gram.append(int(grams[i]))
                template.append(t)
                place.append(int(i))
        order = np.argsort(np.array(gram, np.uint64), kind="stable")
        self.gram = np.array(gram, np.uint64)[order]
        self.template, self.place = np.array(template)[order], np.array(place)[order]
        self.single = np.array(sorted(self.alone), np.uint64)

    def candidates(self, words: np.ndarray) -> list[tuple[int, int]]:
        """(template, place of its first word) pairs that fingerprints vote for, places within the band as one."""
        grams = gram_hashes(words, GRAM)
        low, high = (np.searchsorted(self.gram, grams, side) for side in ("left", "right"))
        found = np.flatnonzero(high > low)
        seen = {(int(self.template[k]), int(i) - int(self.place[k])) for i in found.tolist() for k in range(low[i], high[i])}
        seen |= {(t, i - place) for i in np.flatnonzero(np.isin(words, self.single)).tolist() for t, place in self.alone[int(words[i])]}
        votes = sorted(seen)
        out: list[tuple[int, int]] = []
        for t, start in votes:
            if not out or out[-1][0] != t or start - out[-1][1] > BAND:
                out.append((t, start))
        return out

    def may(self, text: np.ndarray, t: int, start: int) -> bool:
        """Whether enough of the template's words stand within the band at all: a bound that no alignment exceeds."""
        words = self.words[t]
        low, high = start - BAND, start + len(words) + BAND
        near = np.zeros(high - low, np.uint64)
        part = text[max(0, low) : max(0, high)]
        near[max(0, -low) : max(0, -low) + len(part)] = part
        return (np.lib.stride_tricks.sliding_window_view(near, 2 * BAND + 1) == words[:, None]).any(axis=1).sum() >= COVERAGE * len(words)

    def same(self, text: list[int], t: int) -> bool:
        """Whether a match has the names, versions and modifiers of the notice, and no other modifier."""
        need = self.required[t]
        return need is None or need <= set(text) and not (self.modifiers - need) & set(text)


def align(text: list[int], template: list[int], start: int) -> tuple[int, int, int]:
    """(matched template words, first, end) of the best alignment of the template near text[start:], within the band.

    Counts the longest common subsequence with text places at most BAND off;
    of equal counts the shortest span wins.
    """
    width = 2 * BAND + 1
    best = (0, 0, 0)
    # by text place relative to the band: (matches, minus first place) of the best chain that may end there
    row: list[tuple[int, int]] = [(0, 0)] * (width + 1)
    ends: list[int] = [0] * (width + 1)
    for j, word in enumerate(template):
        base = start + j - BAND
        new, new_ends = [(0, 0)] * (width + 1), [0] * (width + 1)
        # the band moves one place a word: new[i] stands at text place base + i, row[i] one place before
        for i in range(width):
            value, end = row[i + 1] if i + 1 <= width else (0, 0), ends[min(i + 1, width)]
            at = base + i
            if 0 <= at < len(text) and text[at] == word:
                matched, first = row[i]
                chain = (matched + 1, first if matched else -at)
                if chain > value:
                    value, end = chain, at + 1
            if i and new[i - 1] > value:
                value, end = new[i - 1], new_ends[i - 1]
            new[i], new_ends[i] = value, end
        new[width], new_ends[width] = new[width - 1], new_ends[width - 1]
        row, ends = new, new_ends
    for (matched, first), end in zip(row, ends, strict=True):
        if matched > best[0] or matched == best[0] and matched and end + first < best[2] - best[1]:
            best = (matched, -first, end)
    return best


def scan(words: np.ndarray, index: Index) -> list[tuple[int, int, int, int]]:
    """(template, matched, first, end) of the templates that a text's words cover; of overlapping ones that with most matches, then the surest."""
    text = words.tolist()
    found = []
    for t, start in index.candidates(words):
        if not index.may(words, t, start):
            continue
        template = index.words[t].tolist()
        matched, first, end = align(text, template, start)
        if matched >= COVERAGE * len(template) and index.same(text[first:end], t):
            found.append((matched, matched / len(template), -first, -t, end))
    out: list[tuple[int, int, int, int]] = []
    for matched, _, first, t, end in sorted(found, reverse=True):
        if all(end <= a or -first >= b for _, _, a, b in out):
            out.append((-t, matched, -first, end))
    return sorted(out, key=lambda x: x[2])


_index: dict[str, Index] = {}

_FOUND = "doc_id long, license string, matched long, template_words long, coverage double, low long, high long"


def find_licenses(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, license, matched, template_words, coverage, low, high): one row for each template found in each text.

    low and high are the bytes of the UTF-8 text that the match spans, coverage
    the share of the template's words matched in order. Templates are
    parameters of fixed size, sent to all executors.

    Nulls: null and empty texts have no rows; null ids stay null. Repeated rows
    give repeated rows. Other columns are ignored.
    """
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(dict(templates or TEMPLATES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = repr(sorted(shared.value.items()))
        if key not in _index:
            _index.clear()
            _index[key] = Index(shared.value)
        index = _index[key]
        for batch in batches:
            ids, out = batch["doc_id"].to_pylist(), []
            for first, last, data, offsets in blocks(batch["text"]):
                words, starts, ends, begin = word_hashes(data, offsets, BREAKS)
                grams = gram_hashes(words, GRAM)
                marked = np.union1d(np.flatnonzero(np.isin(grams, index.gram)), np.flatnonzero(np.isin(words, index.single)))
                for i in np.unique(np.searchsorted(begin, marked, "right") - 1).tolist() if len(marked) else []:
                    a, b = int(begin[i]), int(begin[i + 1])
                    for t, matched, x, y in scan(words[a:b], index):
                        n = len(index.words[t])
                        out.append((ids[first + i], index.names[t], matched, n, matched / n, int(starts[a + x] - offsets[i]), int(ends[a + y - 1] - offsets[i])))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
            columns = list(zip(*out, strict=True)) if out else [()] * 7
            yield pa.record_batch([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], [c.split()[0] for c in _FOUND.split(", ")])

    slim = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return slim.mapInArrow(run, _FOUND)
