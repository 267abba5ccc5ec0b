"""Licence notices in texts, by the Dice coefficient over word bigrams.

A text as a whole, each of its lines, and windows of its words are normalised to lower-case words and
compared with templates: twice the number of shared distinct bigrams over the sum of both numbers. As
the shared ones are at most the smaller number, templates whose number of bigrams
differs too much cannot reach the threshold and are not compared; templates are found through
their bigrams.

Windows run over line ends, so notices in longer lines, wrapped over lines, or inside longer files are
found. They start and end with a bigram of the template and have as many bigrams as its upper bound at most; of
overlapping ones that with more shared bigrams counts, and a line or text that is a notice
yields only to a window that shares more. Only starts with enough bigrams of the template within the
bound are looked at, so the work is linear in the text.

Nulls count as empty texts; repeated rows are scanned alike; of templates that tie, the
first by name is reported; other columns are left out.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable

from pyspark.sql import DataFrame

from rowmender.llm.common import map_rows

# Notices in the wording of their licences.
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License.",
    ],
    "bsd-3-clause": [
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        # the whole licence
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
        "and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to "
        "endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND "
        "CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
        "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, "
        "EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS "
        "INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY "
        "WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ],
    "cc-by-4.0": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "cc-by-nc-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "cc-by-sa-4.0": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "gpl-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "mit": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        # the whole licence
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
        "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
    "unlicense": ["This is free and unencumbered software released into the public domain."],
}

TOKENS = re.compile(r"[^\W_]+").findall


def bigrams(text: str) -> set[tuple[str, str]]:
    words = TOKENS(text.lower())
    return set(zip(words, words[1:]))


class Matcher:
    """Templates by bigram, with the bounds on sizes."""

    def __init__(self, templates: dict[str, Iterable[str]], threshold: float):
        self.threshold = threshold
        self.sizes: list[tuple[str, int]] = []
        self.pairs: list[set[tuple[str, str]]] = []
        self.holders: dict[tuple[str, str], list[int]] = {}
        for name in sorted(templates):
            for text in templates[name]:
                own = bigrams(text)
                for pair in own:
                    self.holders.setdefault(pair, []).append(len(self.sizes))
                self.sizes.append((name, len(own)))
                self.pairs.append(own)
        # dice >= t needs a size of at least t / (2 - t) times the other one
        self.ratio = threshold / (2 - threshold)
        self.smallest = self.ratio * min((n for _, n in self.sizes), default=0)
        self.largest = max((n for _, n in self.sizes), default=0) / self.ratio

    def best(self, words: list[str]) -> tuple[str, float, int] | None:
        """Licence, coefficient and number of shared bigrams of the best template."""
        # a set of bigrams is no larger than the number of words less one
        if len(words) - 1 < self.smallest:
            return None
        pairs = set(zip(words, words[1:]))
        size = len(pairs)
        if not self.smallest <= size <= self.largest:
            return None
        shared: dict[int, int] = {}
        for pair in pairs & self.holders.keys():
            for i in self.holders[pair]:
                shared[i] = shared.get(i, 0) + 1
        found = None
        for i in sorted(shared):
            name, other = self.sizes[i]
            if min(size, other) < self.ratio * max(size, other):
                continue
            dice = 2 * shared[i] / (size + other)
            if dice >= self.threshold and (found is None or dice > found[1]):
                found = name, dice, shared[i]
        return found

    def windows(self, words: list[str]) -> list[tuple[int, float, int, int, str]]:
        """(shared, dice, first, last bigram, licence): the best window from each start, for each template."""
        pairs = list(zip(words, words[1:]))
        hits: dict[int, list[int]] = {}
        for at in [i for i, pair in enumerate(pairs) if pair in self.holders]:
            for i in self.holders[pairs[at]]:
                hits.setdefault(i, []).append(at)
        out = []
        for i, places in hits.items():
            (name, other), own = self.sizes[i], self.pairs[i]
            need, most = math.ceil(self.ratio * other - 1e-9), math.floor(other / self.ratio + 1e-9)
            for lo, far in zip(places, places[need - 1 :]):
                if far - lo >= most:
                    continue
                seen: set[tuple[str, str]] = set()
                shared, top = 0, None
                for at in range(lo, min(lo + most, len(pairs))):
                    pair = pairs[at]
                    if pair in own:
                        shared += pair not in seen
                        seen.add(pair)
                        dice = 2 * shared / (len(seen) + other)
                        if dice >= self.threshold and (top is None or dice > top[1]):
                            top = shared, dice, lo, at, name
                    else:
                        seen.add(pair)
                if top:
                    out.append(top)
        return out


def scan(text: str, matcher: Matcher) -> list[tuple[int, int, str, float]]:
    """(start, end, licence, dice) of each line, the whole text, or window of words that is a notice."""
    out, at = [], 0
    lines = text.split("\n")
    words: list[str] = []
    units = []  # shared bigrams, first and last bigram of the notices so far
    for line in lines:
        own = TOKENS(line.lower())
        if found := matcher.best(own):
            out.append((at, at + len(line), *found[:2]))
            units.append((found[2], len(words), len(words) + len(own) - 2))
        words += own
        at += len(line) + 1
    if len(lines) > 1 and (found := matcher.best(words)):
        out.append((0, len(text), *found[:2]))
        units.append((found[2], 0, len(words) - 2))
    if windows := matcher.windows(words):
        held = [0] * len(words)
        for shared, lo, hi in units:
            held[lo : hi + 1] = [max(shared, x) for x in held[lo : hi + 1]]
        taken = []
        for shared, dice, lo, hi, name in sorted(windows, key=lambda w: (-w[0], -w[1], *w[2:])):
            if max(held[lo : hi + 1]) < shared:
                held[lo : hi + 1] = [math.inf] * (hi + 1 - lo)
                taken.append((lo, hi, name, dice))
        if taken:
            places = word_places(text)
            out += [(places[lo][0], places[hi + 1][1], name, dice) for lo, hi, name, dice in taken]
    return sorted(out)


def word_places(text: str) -> list[tuple[int, int]]:
    """Start and end of each word in the text itself; a few letters grow in lower case."""
    lower = text.lower()
    found = [m.span() for m in re.finditer(r"[^\W_]+", lower)]
    if len(lower) == len(text):
        return found
    origin = [i for i, c in enumerate(text) for _ in c.lower()]
    return [(origin[lo], origin[hi - 1] + 1) for lo, hi in found]


def find_licenses(docs: DataFrame, threshold: float = 0.8, templates: dict[str, Iterable[str]] = TEMPLATES) -> DataFrame:
    """doc_id, number of notices, best licence with its coefficient, and all notices as licence:start:end."""

    def make():
        matcher = Matcher(templates, threshold)

        def one(text):
            found = scan(text or "", matcher)
            best = max(found, key=lambda f: (f[3], -f[0], -f[1]), default=None)
            return len(found), best and best[2], best and best[3], ",".join(f"{name}:{lo}:{hi}" for lo, hi, name, _ in found)

        def work(cols):
            rows = [one(t) for t in cols["text"]]
            names = ("n_notices", "license", "dice", "spans")
            return {"doc_id": cols["doc_id"]} | {n: [r[i] for r in rows] for i, n in enumerate(names)}

        return work

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_rows(docs.select("doc_id", "text"), make, f"doc_id {kind}, n_notices bigint, license string, dice double, spans string")
