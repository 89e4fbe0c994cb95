"""License statements inside longer prose, across line breaks and after the cue."""

import pytest

from quillgraph.llm import license_scan


@pytest.mark.parametrize("around", [5, 20, 100, 300])
@pytest.mark.parametrize("name,statement", [(t[0], t[1]) for t in license_scan.TEMPLATES])
def test_statements_inside_prose(name, statement, around):
    prose = [f"word{i * 7919 % 997}" for i in range(around)]
    text = " ".join([*prose, statement, *reversed(prose)])
    assert [m["license"] for m in license_scan.Scanner().scan(text)[1]] == [name]
    broken = statement.replace(" ", "\n")
    assert [m["license"] for m in license_scan.Scanner().scan(" ".join(prose) + "\n" + broken + " " + " ".join(prose))[1]] == [name]


@pytest.mark.parametrize(
    "text,names",
    [
        ("Released under the MIT License. Licensed under CC BY 4.0.", ["CC-BY-4.0", "MIT"]),
        ("Licensed under the MIT License or the Apache License, Version 2.0.", ["Apache-2.0", "MIT"]),
        ("Licensed under the BSD 2-Clause License or the ISC License.", ["BSD-2-Clause", "ISC"]),
        ("This work is licensed under the GNU General Public License, version 2 or version 3.", ["GPL-2.0", "GPL-3.0"]),
        (" ".join(t[1] for t in license_scan.TEMPLATES), sorted({t[0] for t in license_scan.TEMPLATES})),
        ("This work is licensed under the GNU Lesser General Public License, version 3.", ["LGPL-3.0"]),
        ("This work is licensed under the GNU General Public License, version 2. 3 apples", ["GPL-2.0"]),
        ("Licensed under the Apache License, Version 2.0. Mit Freude", ["Apache-2.0"]),
    ],
)
def test_every_license_of_a_line(text, names):
    assert sorted(m["license"] for m in license_scan.Scanner().scan(text)[1]) == names


@pytest.mark.parametrize(
    "text,names",
    [
        ("Licensed under Apache-2.0 OR MIT.", ["Apache-2.0", "MIT"]),
        ("Licensed under MIT or the BSD-3-Clause.", ["BSD-3-Clause", "MIT"]),
        ("Mozilla Public License 2.0", ["MPL-2.0"]),
        ("GNU Affero General Public License v3", ["AGPL-3.0"]),
        ("GNU General Public License v3.0", ["GPL-3.0"]),
        ("ISC License", ["ISC"]),
        ('BSD 3-Clause "New" License', ["BSD-3-Clause"]),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", ["MIT"]),
        ("Apache License 2.0. Mit Freude und Permission", ["Apache-2.0"]),
    ],
)
def test_short_names_versions_and_alternatives(text, names):
    assert sorted(m["license"] for m in license_scan.Scanner().scan(text)[1]) == names


BSD3 = max((t for t in license_scan.TEMPLATES if t[0] == "BSD-3-Clause"), key=lambda t: len(t[1]))[1]


def test_bytes_saved_decide_between_templates_that_are_both_confirmed(monkeypatch):
    scanner = license_scan.Scanner()
    numbers = {name: n for n, (name, words, *_) in enumerate(scanner.known) if name.startswith("BSD") and len(words) > 100}
    block = license_scan.words_of(BSD3)
    assert all(scanner.confirm(block, numbers[n]) for n in ("BSD-2-Clause", "BSD-3-Clause"))
    assert scanner.saved(block, numbers["BSD-3-Clause"]) > scanner.saved(block, numbers["BSD-2-Clause"])
    assert [m["license"] for m in scanner.scan(BSD3)[1]] == ["BSD-3-Clause"]
    rank = license_scan.Scanner.rank
    monkeypatch.setattr(license_scan.Scanner, "rank", lambda self, *given: [(1.0, *r[1:]) for r in rank(self, *given)])
    assert [m["license"] for m in license_scan.Scanner().scan(BSD3)[1]] != ["BSD-3-Clause"]
    monkeypatch.setattr(license_scan.Scanner, "saved", lambda self, words, number: 0)
    assert license_scan.Scanner().scan(BSD3)[1] == []


def brute_force(text):
    """Every cue against every template with fresh compressors, no memory of earlier blocks."""
    import re

    import zstandard

    words = license_scan.words_of(text)
    low = text.lower()
    starts = [m.start() for m in license_scan._word.finditer(low)]
    scanner = license_scan.Scanner()
    fits = set()
    for at, cue in license_scan.cues_of(low, starts):
        ranked = {False: set(), True: set()}
        for number, (name, template, _, _, _) in enumerate(scanner.known):
            wording = " ".join(template)
            size = lambda t, w=None: len(zstandard.ZstdCompressor(level=9, write_content_size=False, **({"dict_data": zstandard.ZstdCompressionDict(w.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)} if w else {})).compress(t.encode()))
            own = size(wording) - size(wording, wording)
            raw = license_scan.TEMPLATES[number][1].lower()
            joined = " ".join(license_scan.words_of(raw))
            for place, other in license_scan.cues_of(joined, [m.start() for m in license_scan._word.finditer(joined)]):
                if other == cue:
                    more = license_scan.slack(len(template))
                    a, b = max(0, at - place - more), min(len(words), at - place + len(template) + more)
                    exact = words[max(0, at - place) : max(0, min(len(words), at - place + len(template)))]
                    for wide, t in ((False, " ".join(exact)), (True, " ".join(words[a:b]))):
                        gain = min(max(1, own), size(t) - size(t, wording))
                        if gain >= license_scan.MIN_SAVED * max(1, own):
                            ranked[wide].add((-(gain**2) / max(1, own), number, max(0, at - place), min(len(words), at - place + len(template)), a, b, round(gain / max(1, own), 6)))
        best = {}
        for rows in ranked.values():
            for row in sorted(rows)[: license_scan.RANKED]:
                best[row[1:6]] = min(best.get(row[1:6], row), row)
        for score, number, _, _, a, b, share in best.values():
            if fit := scanner.confirm(words[a:b], number):
                fits.add((score, fit[0], scanner.known[number][0], share, fit[1], tuple(a + p for p in fit[2]), tuple((a + p, by) for p, by in fit[3].items())))
    return license_scan.accepted(fits, words, lambda p: len(re.findall("\n", low[: starts[p] + 1])))


def test_the_whole_table_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: [m.asDict() for m in r.matches] for r in license_scan.scan(docs, ["doc_id"]).collect()}
    want = {r.doc_id: brute_force(r.text) if r.text and license_scan._cue.search(r.text.lower()) else [] for r in docs.collect()}
    assert got == want and sum(map(bool, got.values())) >= 3
