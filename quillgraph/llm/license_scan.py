"""License scans by conditional compression.

Every cue in a text is laid on every place of the same cue in every template; the
words around it that the template would cover, across line breaks, are the block
that is compressed alone and with the template as a zstandard raw dictionary, and once more with some slack on both sides.  What
the dictionary saves, times the share that this is of the template's own saving,
which is the most that counts, ranks the templates of a cue by either block, and only the
``RANKED`` best go on.  A winner is confirmed, with the slack, by the exact word differences: its
key words must all be there and nearly all of its words must match in order,
close together.

A text has every confirmed license that rests on key words of its own: where
wordings overlap, the one that saved more takes its words first, and another one
stays only if its other key words stand beside a neighbour they have in the
template, or behind "or" or "and" and words already taken, as in "A OR B".
``n_blocks`` counts the lines that hold a cue and their paragraphs.  ``v3``, ``3.0`` and ``3`` are one word.

Edge cases: null, empty and blank texts have no block; every cue of a text of
any length is looked at; ties in rank go to fewer differences, then to the
license's name; repeated rows are scanned each; an empty table gives an empty
result; other columns are kept, clashing output names are replaced.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import pieces

# Statements and notices as their publishers word them, each with the words that tell it from its relatives.
TEMPLATES: list[tuple[str, str, str]] = [
    ("MIT", "Released under the MIT License.", "mit"),
    ("MIT", "Licensed under the MIT License.", "mit"),
    ("MIT", "MIT License", "mit license"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software", "permission hereby granted free charge"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.", "permission hereby granted free charge notice"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0.", "apache 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "apache 2.0 compliance"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3.", "gnu general public 3"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2.", "gnu general public 2"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3.", "gnu lesser general public 3"),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3.", "gnu affero general public 3"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0.", "cc by 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0.", "cc by-sa 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0.", "cc by-nc 4.0"),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0.", "cc by-nd 4.0"),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0.", "cc by-nc-sa 4.0"),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0.", "cc0 1.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0.", "mozilla public 2.0"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License.", "bsd 3-clause"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License.", "bsd 2-clause"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "redistribution source binary forms permitted"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.", "redistribution source binary forms permitted reproduce"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.", "redistribution source binary forms permitted reproduce neither endorse promote"),
    ("ISC", "Licensed under the ISC License.", "isc"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "permission use copy modify purpose fee hereby granted"),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely", "permission granted anyone purpose commercial alter redistribute freely"),
    ("Unlicense", "This is free and unencumbered software released into the public domain.", "unencumbered public domain"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.", "apache 2.0 compliance limitations"),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "gnu general public 3 later"),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", "gnu general public 2 later"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "mozilla public 2.0 mpl"),
]
#: Identifiers that an SPDX line may name.
SPDX = ["MIT", "Apache-2.0", "GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "CC-BY-ND-4.0", "CC-BY-NC-SA-4.0", "CC0-1.0", "MPL-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "Zlib", "Unlicense"]
TEMPLATES += [(name, f"SPDX-License-Identifier: {name}", f"spdx-license-identifier {name.lower()}") for name in SPDX]
TEMPLATES += [(name, f"Licensed under {name}", name.lower()) for name in SPDX]
#: Names of licenses as they stand alone.
TEMPLATES += [
    ("Apache-2.0", "Apache License, Version 2.0", "apache 2.0"),
    ("Apache-2.0", "Apache License 2.0", "apache license 2.0"),
    ("MPL-2.0", "Mozilla Public License Version 2.0", "mozilla public 2.0"),
    ("GPL-2.0", "GNU General Public License version 2", "gnu general public 2"),
    ("GPL-3.0", "GNU General Public License version 3", "gnu general public 3"),
    ("LGPL-2.1", "GNU Lesser General Public License version 2.1", "gnu lesser general public 2.1"),
    ("LGPL-3.0", "GNU Lesser General Public License version 3", "gnu lesser general public 3"),
    ("AGPL-3.0", "GNU Affero General Public License version 3", "gnu affero general public 3"),
    ("ISC", "ISC License", "isc license"),
    ("BSD-2-Clause", "BSD 2-Clause License", "bsd 2-clause license"),
    ("BSD-3-Clause", "BSD 3-Clause License", "bsd 3-clause license"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "permission hereby granted free charge"),
]
CUES = ("licen", "copyright", "permission", "redistribut", "public domain", "spdx")
#: Share of its own saving that a template must save, share of its words that must match, and templates of a cue that are confirmed at most, by either block.
MIN_SAVED, MIN_MATCH, RANKED = 0.15, 0.8, 12
#: Words that join alternatives, and words that may stand between them and a name.
JOINING, BETWEEN = {"or", "and"}, {"the", "a", "either", "both", "under"}
_cue = re.compile("|".join(c.replace(" ", r"\s+") for c in CUES))
_word = re.compile(r"[a-z0-9]+(?:[.\-][a-z0-9]+)*")
_version = re.compile(r"v?(\d+(?:\.\d+)*?)(?:\.0)*")
MATCH = T.ArrayType(T.StructType([T.StructField("license", T.StringType()), T.StructField("line", T.LongType()), T.StructField("saved", T.DoubleType()), T.StructField("n_diff", T.LongType()), T.StructField("diff", T.StringType())]))


def slack(size: int) -> int:
    """Words that a wording of ``size`` words may be longer by."""
    return max(4, size // 4)


def plain_word(word: str) -> str:
    """The word; a version number without its v and its last zeros."""
    m = _version.fullmatch(word)
    return m[1] if m else word


def words_of(text: str) -> list[str]:
    return [plain_word(w) for w in _word.findall(text.lower())]


def cues_of(text: str, starts: list[int]) -> list[tuple[int, str]]:
    """(number of the word, cue) of every cue in a lower-cased text whose words begin at ``starts``."""
    return [(max(0, bisect_right(starts, m.start()) - 1), " ".join(m.group().split())) for m in _cue.finditer(text)] if starts else []


class Scanner:
    def __init__(self, templates: list[tuple[str, str, str]] = TEMPLATES, level: int = 9):
        self.plain = zstandard.ZstdCompressor(level=level, write_content_size=False)
        self.known, self.places = [], {}
        for number, (name, wording, keys) in enumerate(templates):
            low = " ".join(words := words_of(wording))
            raw = zstandard.ZstdCompressionDict(low.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            known = zstandard.ZstdCompressor(level=level, dict_data=raw, write_content_size=False)
            own = len(self.plain.compress(low.encode())) - len(known.compress(low.encode()))
            self.known.append((name, words, {plain_word(k) for k in keys.split()}, known, own))
            for at, cue in cues_of(low, [m.start() for m in _word.finditer(low)]):
                self.places.setdefault(cue, set()).add((number, at))

    def saved(self, words: list[str], number: int) -> int:
        """Bytes that the template saves on ``words``."""
        raw = " ".join(words).encode()
        return len(self.plain.compress(raw)) - len(self.known[number][3].compress(raw))

    def rank(self, words: list[str], blocks: list[tuple[int, int, int]], sizes: dict[tuple, int]) -> list[tuple[float, float, int, int, int]]:
        """(score, share, template number, first word, end) of the best ``RANKED`` of a cue's exact blocks and of its wide ones, best first; ``sizes`` holds what was compressed before."""
        exact, wide = [], []
        for number, a, b in blocks:
            own = max(1, self.known[number][4])
            for ranked, part in ((exact, words[a:b]), (wide, words[slice(*self.widened(words, number, a, b))])):
                key = (number, *part)
                if key not in sizes:
                    sizes[key] = min(own, self.saved(part, number))
                if sizes[key] >= MIN_SAVED * own:
                    ranked.append((sizes[key] ** 2 / own, round(sizes[key] / own, 6), number, a, b))
        first = lambda ranked: sorted(ranked, key=lambda r: (-r[0], r[2:]))[:RANKED]
        best = {}
        for row in [*first(exact), *first(wide)]:
            best[row[2:]] = max(best.get(row[2:], row), row)
        return sorted(best.values(), key=lambda r: (-r[0], r[2:]))

    def confirm(self, words: list[str], number: int) -> tuple[int, str, list[int], dict[int, bool]] | None:
        """(number of differing template words, the differences, places of the matched words, places of key words and whether a neighbour stands beside), or None if the wording is another one."""
        _, template, keys, *_ = self.known[number]
        if not keys <= set(words):
            return None
        match = SequenceMatcher(None, template, words, autojunk=False)
        places = [m.b + k for m in match.get_matching_blocks() for k in range(m.size)]
        if len(places) < MIN_MATCH * len(template) or not keys <= {words[p] for p in places}:
            return None
        first, last = places[0], places[-1] + 1
        if last - first > len(template) + slack(len(template)):
            return None
        edits = [f"-{' '.join(template[a:b])}+{' '.join(words[max(c, first):min(d, last)])}" for op, a, b, c, d in match.get_opcodes() if op != "equal" and (b > a or (c >= first and d <= last))]
        met = {m.a + k: m.b + k for m in match.get_matching_blocks() for k in range(m.size)}
        beside = {q: any(0 <= t + d < len(template) and 0 <= q + d < len(words) and template[t + d] == words[q + d] for d in (-1, 1)) for t, q in met.items() if template[t] in keys}
        return len(template) - len(places), "; ".join(edits), places, beside

    def windows(self, words: list[str], cues: list[tuple[int, str]]) -> Iterator[list[tuple[int, int, int]]]:
        """For each cue, the (template number, first word, end) that the template would cover there."""
        for at, cue in cues:
            found = set()
            for number, place in self.places.get(cue, ()):
                found.add((number, max(0, at - place), min(len(words), at - place + len(self.known[number][1]))))
            yield sorted(found)

    def widened(self, words: list[str], number: int, a: int, b: int) -> tuple[int, int]:
        """A block with the slack in which its wording is looked for."""
        more = slack(len(self.known[number][1]))
        return max(0, a - more), min(len(words), b + more)

    def blocks(self, text: str) -> Iterator[tuple[int, list[str]]]:
        """(line number, words) of candidate lines, and of their paragraphs where these have more lines."""
        lines = text.split("\n")
        cued = [i for i, line in enumerate(lines) if any(c in line.lower() for c in CUES)]
        done = -1
        for i in cued:
            if words := words_of(lines[i]):
                yield i, words
            if i > done:
                end = i + 1
                while end < len(lines) and lines[end].strip():
                    end += 1
                if end > i + 1 and (words := words_of(" ".join(lines[i:end]))):
                    yield i, words
                done = end - 1

    def scan(self, text: str | None) -> tuple[int, list[dict]]:
        """(number of candidate blocks, confirmed licenses, one per license, in text order)."""
        low = text.lower() if text else ""
        if not _cue.search(low):
            return 0, []
        spans = [(m.start(), plain_word(m.group())) for m in _word.finditer(low)]
        starts, words = [p for p, _ in spans], [w for _, w in spans]
        breaks = [m.start() for m in re.finditer("\n", low)]
        cues = cues_of(low, starts)
        sizes: dict[tuple, int] = {}
        tried: dict[tuple, tuple | None] = {}
        fits = set()
        for blocks in self.windows(words, cues):
            for score, share, number, a, b in self.rank(words, blocks, sizes):
                a, b = self.widened(words, number, a, b)
                key = (number, *words[a:b])
                if key not in tried:
                    tried[key] = self.confirm(words[a:b], number)
                if fit := tried[key]:
                    fits.add((-score, fit[0], self.known[number][0], share, fit[1], tuple(a + p for p in fit[2]), tuple((a + p, by) for p, by in fit[3].items())))
        return sum(1 for _ in self.blocks(text)), accepted(fits, words, lambda place: bisect_right(breaks, starts[place]))


def accepted(fits: set[tuple], words: list[str], line_of) -> list[dict]:
    """The licenses of a text's confirmed wordings, best ranked first, each on words of its own."""
    found: dict[str, dict] = {}
    taken: set[int] = set()

    def joined(place: int) -> bool:
        """Does "or" or "and" lead from words already taken to the word at ``place``?"""
        at, joins = place - 1, False
        while at >= 0 and at not in taken and words[at] in JOINING | BETWEEN:
            joins |= words[at] in JOINING
            at -= 1
        return joins and at in taken

    for _, diff, name, share, edits, places, keys in sorted(fits):
        own = [by or joined(p) for p, by in keys if p not in taken]
        if taken.isdisjoint(places) or (own and all(own)):
            taken.update(places)
            line = line_of(places[0])
            if name not in found or line < found[name]["line"]:
                found[name] = {"license": name, "line": line, "saved": share, "n_diff": diff, "diff": edits}
    return sorted(found.values(), key=lambda m: (m["line"], m["license"]))


def scan(docs: DataFrame, keep: list[str], text_col: str = "text", templates: list[tuple[str, str, str]] = TEMPLATES) -> DataFrame:
    """Columns ``keep`` with n_blocks and matches."""
    keep = [c for c in keep if c not in ("n_blocks", "matches")]
    schema = docs.select(*keep).schema.add("n_blocks", "long").add("matches", MATCH)
    kind = pa.list_(pa.struct([("license", pa.string()), ("line", pa.int64()), ("saved", pa.float64()), ("n_diff", pa.int64()), ("diff", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        for batch in pieces(batches):
            found = [scanner.scan(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            out = [pa.array([n for n, _ in found], pa.int64()), pa.array([m for _, m in found], kind)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), *out], names=[*keep, "n_blocks", "matches"])

    return docs.select(*keep, F.col(text_col).alias("__read_text")).mapInArrow(run, schema)
