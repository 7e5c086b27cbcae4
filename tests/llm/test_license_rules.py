import random
import re
import textwrap

from tidemark.llm import license_rules as R

MIT = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\n"
       "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n")
BSD = ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
       "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."]
CASES = [
    (None, []), ("", []), ("no licence at all", []), ("this software is mine", []), ("Licensed under the Apache License, Version 2.0.", ["Apache-2.0"]),
    ("words before.\nThis work is licensed under the GNU General Public License, version 3.\nafter", ["GPL-3.0-only"]), ("Released under the MIT License.", ["MIT"]), ("Licensed under CC BY-NC 4.0.", ["CC-BY-NC-4.0"]),
    ("some text ending here Licensed under CC BY-NC 4.0.", ["CC-BY-NC-4.0"]), ("Licensed under CC BY-NC 4.0. Released under the MIT License.", ["CC-BY-NC-4.0", "MIT"]),
    (MIT, ["MIT"]), ("\n".join(BSD), ["BSD-3-Clause"]), ("\n".join(BSD[:3]), ["BSD-2-Clause"]), ("\n".join(BSD[::-1]), []), ("\n".join([BSD[0], *["filler line"] * 3, BSD[1], BSD[2]]), ["BSD-2-Clause"]),
    ("\n".join([BSD[0], *["filler line"] * 4, BSD[1], BSD[2]]), []), ("\n".join([BSD[0], *["x"] * 9, *BSD]), ["BSD-3-Clause"]), ("unlicensed under cc by nc 4 0x", []),
]


def brute(text, gap=3):
    """The same by plain loops."""
    known = {s: i for i, g in R.SENTENCES.items() for s in g}
    parts = [re.sub(r"[\W_]+", " ", p.lower()).strip() for p in re.split(R.BREAK, text or "")]
    ids = []
    for k, s in enumerate(p for p in parts if p):
        hit = next((known[e] for e in sorted(known, key=lambda e: (-len(e), e)) if s == e or s.endswith(" " + e)), None)
        if hit:
            ids.append((hit, k))

    return sorted({x for x, _, _ in matches(ids, gap)})


def matches(ids, gap=3):
    """(licence, first, last) by trying every end of every rule, from (identifier, sentence) pairs."""
    every = []
    for licence, rules in R.RULES.items():
        for rule in rules:
            free = 0
            for n, (_, end) in enumerate(ids):
                # the nearest place of each identifier before the next one's, back from this end
                at, k = n, len(rule) - 1
                if ids[n][0] != rule[k] or n < free:
                    continue
                while k:
                    back = [m for m in range(free, at) if ids[m][0] == rule[k - 1]]
                    if not back or ids[at][1] - ids[back[-1]][1] > gap + 1:
                        break
                    at, k = back[-1], k - 1
                if not k:
                    every.append((licence, rule, ids[at][1], end))
                    free = n + 1
    inside = lambda a, b: len(b) > len(a) and any(b[i : i + len(a)] == a for i in range(len(b)))
    return {(x, a, b) for x, r, a, b in every if not any(inside(r, q) and c <= a and b <= d for _, q, c, d in every)}


def test_licences(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "doc_id long, text string")
    got = {r.doc_id: r.licenses for r in R.recognise(df).collect()}
    assert got == {i: want for i, (_, want) in enumerate(CASES)}
    assert got == {i: brute(t) for i, (t, _) in enumerate(CASES)}


def test_plan_has_no_python(spark):
    plan = R.recognise(spark.createDataFrame([(1, "x")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_odd_rows(spark):
    long = "filler line\n" * 100_000 + "Released under the MIT License."
    df = spark.createDataFrame([(None, long, "a"), (1, None, "b"), (1, None, "b")], "doc_id long, text string, ids string")
    rows = {str(r.doc_id): r for r in R.recognise(df).collect()}
    assert rows["None"].licenses == ["MIT"] and rows["None"].places == [100_000] and rows["1"].licenses == []
    assert R.recognise(df.limit(0)).collect() == []


APACHE = "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS."
GPL3 = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.\n\nThis program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
GPL2 = GPL3.replace("software:", "software;").replace("version 3", "version 2")
AS_IS = "\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE."
ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
REAL = {
    "Apache-2.0": (APACHE, ["A1", "A2", "A3"]), "GPL-3.0-or-later": (GPL3, ["G2", "G3"]), "GPL-2.0-or-later": (GPL2, ["G4", "G3"]), "MIT": ("MIT License\n\n" + MIT + AS_IS, ["M2", "M3", "M4"]), "ISC": (ISC, ["I1"]),
    "BSD-3-Clause": (BSD[0] + "\n\n" + "\n\n".join(f"{n}. {x}" for n, x in enumerate(BSD[1:], 1)), ["B1", "B2", "B3", "B4"]), "BSD-2-Clause": (BSD[0] + "\n\n" + "\n".join(f"* {x}" for x in BSD[1:3]), ["B1", "B2", "B3"]),
    "Unlicense": ("This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy it.", ["Z1"]),
}
MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
ZLIB = "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."
REAL |= {
    "LGPL-2.1-or-later": (GPL3.replace("program", "library").replace("software:", "software;").replace("GNU General Public License as", "GNU Lesser General Public License as").replace("version 3", "version 2.1"), ["L1", "G3"]),
    "LGPL-3.0-or-later": (GPL3.replace("program", "library").replace("GNU General Public License as", "GNU Lesser General Public License as"), ["L2", "G3"]), "AGPL-3.0-or-later": (GPL3.replace("GNU General Public License as", "GNU Affero General Public License as"), ["N1", "G3"]),
    "GPL-2.0-only": ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.", ["G5"]), "MPL-2.0": (MPL, ["P1", "P2"]), "Zlib": (ZLIB, ["Y1", "Y2"]),
    "CC0-1.0": ("To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide.", ["D1"]), "BSL-1.0": ("Distributed under the Boost Software License, Version 1.0.", ["O1"]),
}
LEADERS = (("", ""), ("# ", "#"), (" * ", " *"), ("// ", "//"), ("REM ", "REM"), (";; ", ";;"))


def wrapped(text, columns, leader, blank, end="\n"):
    lines = [line for part in text.split("\n") for line in textwrap.wrap(part, columns, break_long_words=False, break_on_hyphens=False) or [""]]
    return end.join(leader + x if x else blank for x in lines)


def brute_ids(text):
    """Identifiers in order, by an own walk over words: lines lose their leaders, paragraphs are joined, words are compared one by one."""
    lines = [re.sub(r"^[\W_]*(REM(?=\W|$))?[\W_]*", "", x) for x in text.replace("\r\n", "\n").split("\n")]
    for k in range(len(lines) - 1, 0, -1):
        if lines[k].startswith("http") and not lines[k - 1]:
            del lines[k - 1]
    out = []
    for para in re.split(r"\n\n+", "\n".join(lines)):
        found = list(re.finditer(r"[^\W_]+", para))
        word = [m[0].lower() for m in found]
        gap = [para[a.end() : b.start()] for a, b in zip(found, found[1:])] + ["\n"]
        stop = ["\n" in g or bool(re.search(r"[!?;]|[.:](\W|$)", g)) for g in gap]
        full = [bool(re.search(r"[!?]|\.\W", g)) and not (word[n] == "v" and g.startswith(".")) for n, g in enumerate(gap)]
        at = 0
        while at < len(word):
            fits = [(len(s.split()), i) for i, group in R.SENTENCES.items() for s in group if word[at : at + len(s.split())] == s.split() and stop[at + len(s.split()) - 1] and not any(full[at : at + len(s.split()) - 1])]
            if fits:
                out.append(max(fits)[1])
            at += max(fits)[0] if fits else 1
    return out


def test_wrapped_real_notices(spark):
    want, rows = {}, []
    for licence, (text, ids) in REAL.items():
        for columns in (28, 50, 72, 100_000):
            for leader, blank in LEADERS:
                for end in ("\n", "\r\n"):
                    want[len(rows)] = ([licence], ids)
                    rows.append((len(rows), wrapped(text, columns, leader, blank, end)))
    got = {r.doc_id: r for r in R.recognise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        assert (got[i].licenses, got[i].sentence_ids) == want[i], text
        assert got[i].sentence_ids == brute_ids(text), text


def test_matches_are_places(spark):
    two = "\n".join([*BSD[:3], *["x"] * 9, *BSD])
    rows = [(1, two), (2, "\n".join([BSD[0], "Licensed under CC BY 4.0.", BSD[1], BSD[2]])), (3, MIT + "\n\n" + "Some words.\n" * 6 + MIT), (4, "// SPDX-License-Identifier: GPL-2.0-or-later\n/* SPDX-License-Identifier: MIT */\n# SPDX-License-Identifier: CC0-1.0")]
    got = {r.doc_id: {(m.license, m["first"], m["last"]) for m in r.matches} for r in R.recognise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: {("BSD-2-Clause", 0, 2), ("BSD-3-Clause", 12, 15)}, 2: {("BSD-2-Clause", 0, 3), ("CC-BY-4.0", 1, 1)}, 3: {("MIT", 0, 1), ("MIT", 8, 9)}, 4: {("GPL-2.0-or-later", 0, 0), ("MIT", 1, 1), ("CC0-1.0", 2, 2)}}


def test_random_sequences_equal_brute_force(spark):
    r = random.Random(6)
    names = ["B1", "B2", "B3", "B4", "M2", "M3", "M4", "G2", "G3", "A1", "A2"]
    rows, want = [], []
    for n in range(400):
        pick = [r.choice(names) if r.random() < 0.6 else None for _ in range(r.randint(0, 14))]
        rows.append((n, "\n".join(R.SENTENCES[x][0] if x else "filler words" for x in pick)))
        want.append(matches([(x, i) for i, x in enumerate(pick) if x]))
    got = {x.doc_id: {(m.license, m["first"], m["last"]) for m in x.matches} for x in R.recognise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict(enumerate(want))


def test_every_identifier_and_rule_is_reached(spark):
    odd = {"A3": "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0"}
    one = [(i, i, odd.get(i, s)) for i, group in R.SENTENCES.items() for s in group]
    rules = [(f"{licence} {n}", licence, "\n".join(R.SENTENCES[i][0] if i in R.SENTENCES else "SPDX-License-Identifier: " + licence for i in rule)) for licence, rs in R.RULES.items() for n, rule in enumerate(rs)]
    got = {r.doc_id: r for r in R.recognise(spark.createDataFrame([(n, t) for n, _, t in rules], "doc_id string, text string")).collect()}
    assert all(got[n].licenses == [licence] and len(got[n].sentence_ids) == t.count("\n") + 1 for n, licence, t in rules)
    assert all(r.sentence_ids == [r.doc_id] for r in R.recognise(spark.createDataFrame([(i, t) for i, _, t in one], "doc_id string, text string")).collect())


def test_a_wrapped_sentence_between_counts_once(spark):
    other = wrapped("Some words that no licence knows, in a sentence that is long enough to take quite a few lines of this notice, and then some more words to make it longer still, until it has an end.", 60, " * ", " *")
    text = "\n".join([BSD[0], *[other] * 3, BSD[1], BSD[2]])
    rows = R.recognise(spark.createDataFrame([(1, text), (2, "released under the mit license.see there")], "doc_id long, text string")).collect()
    assert {r.doc_id: (r.licenses, r.places) for r in rows} == {1: (["BSD-2-Clause"], [0, 4, 5]), 2: (["MIT"], [0])}
