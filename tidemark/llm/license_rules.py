"""Licence recognition by sentence rules, in DataFrame functions only.

A text is cut into sentences, each normalised to lower-case words; wrapped lines and comment leaders don't part them. Sentences that
are known from licences get their identifiers; a licence is an ordered rule of identifiers, found where its identifiers follow each
other in a text with at most ``gap`` other sentences between two of them. Every place where a rule is met counts; a rule that is part
of a longer one gives way to it only where the longer one covers it.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm._session import chosen

#: Known sentences by identifier, normalised. Wordings of the licences and of their usual notices.
SENTENCES: dict[str, tuple[str, ...]] = {
    "A1": ("licensed under the apache license version 2 0", "licensed under the apache license version 2 0 the license"),
    "A2": ("you may not use this file except in compliance with the license",),
    "A3": ("you may obtain a copy of the license at http www apache org licenses license 2 0", "you may obtain a copy of the license at https www apache org licenses license 2 0"),
    "G1": ("this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 3 as published by the free software foundation"),
    "G2": ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",),
    "G3": ("this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",),
    "G4": ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",),
    "G5": ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation", "this program is free software you can redistribute it and or modify it under the terms of version 2 of the gnu general public license as published by the free software foundation"),
    "L1": ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",),
    "L2": ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version", "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    "N1": ("this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",),
    "P1": ("this source code form is subject to the terms of the mozilla public license v 2 0",),
    "P2": ("if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0", "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0"),
    "E1": ("this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0",),
    "D1": ("to the extent possible under law the author s have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide",),
    "O1": ("distributed under the boost software license version 1 0",),
    "Y1": ("this software is provided as is without any express or implied warranty",),
    "Y2": ("in no event will the authors be held liable for any damages arising from the use of this software",),
    "M1": ("released under the mit license", "licensed under the mit license"),
    "M2": ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",),
    "M3": ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",),
    "M4": ("the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",),
    "B1": ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",),
    "B2": ("redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",),
    "B3": ("redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",),
    "B4": ("neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",),
    "C1": ("licensed under cc by nc 4 0", "this work is licensed under cc by nc 4 0"),
    "C2": ("licensed under cc by 4 0", "this work is licensed under cc by 4 0"),
    "C3": ("licensed under cc by sa 4 0", "this work is licensed under cc by sa 4 0"),
    "I1": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",),
    "Z1": ("this is free and unencumbered software released into the public domain",),
}
#: licence -> its ordered rules of sentences.
NOTICES: dict[str, tuple[tuple[str, ...], ...]] = {
    "AGPL-3.0-or-later": (("N1", "G3"), ("N1",)),
    "Apache-2.0": (("A1", "A2", "A3"), ("A1",)),
    "BSD-2-Clause": (("B1", "B2", "B3"),),
    "BSD-3-Clause": (("B1", "B2", "B3", "B4"),),
    "BSL-1.0": (("O1",),),
    "CC-BY-4.0": (("C2",),),
    "CC-BY-NC-4.0": (("C1",),),
    "CC-BY-SA-4.0": (("C3",),),
    "CC0-1.0": (("D1",),),
    "EPL-2.0": (("E1",),),
    "GPL-2.0-only": (("G5", "G3"), ("G5",)),
    "GPL-2.0-or-later": (("G4", "G3"), ("G4",)),
    "GPL-3.0-only": (("G1", "G3"), ("G1",)),
    "GPL-3.0-or-later": (("G2", "G3"), ("G2",)),
    "ISC": (("I1",),),
    "LGPL-2.1-or-later": (("L1", "G3"), ("L1",)),
    "LGPL-3.0-or-later": (("L2", "G3"), ("L2",)),
    "MIT": (("M2", "M3", "M4"), ("M2", "M3"), ("M1",)),
    "MPL-2.0": (("P1", "P2"), ("P1",)),
    "Unlicense": (("Z1",),),
    "Zlib": (("Y1", "Y2"),),
}
#: A line that names a licence by its short identifier counts, too: such a sentence is called "S:" and the identifier's words.
TAG = "spdx license identifier"


def tagged(licence: str) -> str:
    return re.sub(r"[^a-z0-9]+", " ", licence.lower())


RULES = {licence: (*rules, (f"S:{tagged(licence)}",)) for licence, rules in NOTICES.items()}
#: All rules as (licence, identifiers), and for each the rules that go further with the same identifiers in order.
LIST = [(licence, rule) for licence, rules in RULES.items() for rule in rules]
LARGER = [[n for n, (_, two) in enumerate(LIST) if len(two) > len(one) and any(two[i : i + len(one)] == one for i in range(len(two)))] for _, one in LIST]
#: Each known sentence holds one of these words; a text without any of them isn't cut up.
SIGNS = ("licensed", "license", "permission", "redistribution", "software", "warranty", "contributors", "copyright", "mozilla")
assert all(any(w in s for w in SIGNS) for group in SENTENCES.values() for s in group)
#: Ends of sentences: a known one may end at any of them. URLs, dotted names and version numbers stay whole.
BREAK = r"[!?;\n\r]+|[.:](?![A-Za-z0-9/\\_-])|(?<=[a-z])[.:](?=[A-Z])"
#: What parts words, by rank, a character each: a place within a line or at its wrap; a line's end; a colon or semicolon; a full stop,
#: a blank line or a list item. Known sentences may run over all but the last, and end at each; all but the first part sentences.
WRAP, LINE, WEAK, HARD = "\x02", "\n", "\x0b", "\f"
KNOWN = "\x01"  # goes before the identifier of a known sentence, in its place
#: (what, by which mark), in order. A line of 40 characters or more is taken to be wrapped.
MARKS = (
    (r"\r\n?", LINE),
    (r"(?im)^[ \t]*(?:rem|dnl)(?=[ \t\n]|\z)", ""),
    (r"(?i)\bv\.(?=[^\p{L}\p{N}]{0,40}[0-9])", "v"),
    (r"(?i)\n[^\p{L}\p{N}]*(?=https?://)", LINE),
    (r"\n[^\p{L}\p{N}]*\n", HARD),
    (r"\n(?=[^\p{L}\p{N}\n]*(?:[0-9]{1,2}|[A-Za-z])[.)]\s)", HARD),
    (r"(?<=[^\n\f]{40})\n", WRAP),
    (r"[!?]+|\.(?![A-Za-z0-9/\\_-])|(?<=[a-z])\.(?=[A-Z])", HARD),
    (r";+|:(?![A-Za-z0-9/\\_-])|(?<=[a-z]):(?=[A-Z])", WEAK),
    (r"(?<![0-9])[.:](?![0-9])", WRAP),
)
#: Neighbouring marks become the highest of them.
MERGED = (
    (r"[^\p{L}\p{N}\x02\n\x0b\f]+", " "),
    (r" ?\x02[ \x02]*+", WRAP),
    (r"[ \x02]?\n[ \x02\n]*+", LINE),
    (r"[ \x02\n]?\x0b[ \x02\n\x0b]*+", WEAK),
    (r"[ \x02\n\x0b]?\f[ \x02\n\x0b\f]*+", HARD),
    (r"\A[ \x02\n\x0b\f]+|[ \x02\n\x0b\f]+\z", ""),
)


def sentences(text: Column) -> Column:
    """The sentences of a text in lower-case words; a known one, and what stands before it in its sentence, ends in its identifier."""
    out = F.regexp_replace(F.translate(text, KNOWN + WRAP + WEAK, "   "), HARD, "\n\n")
    for what, mark in MARKS:
        out = F.regexp_replace(out, what, mark)
    out = F.lower(out)
    for what, mark in MERGED:
        out = F.regexp_replace(out, what, mark)
    for name, group in sorted(SENTENCES.items(), key=lambda x: (-max(map(len, x[1])), x[0])):
        any_of = "|".join(s.replace(" ", r"[ \x02\n\x0b]") for s in sorted(group, key=lambda s: (-len(s), s)))
        out = F.regexp_replace(out, rf"(?<![^ \x02\n\x0b\f])(?:{any_of})(?=[\x02\n\x0b\f]|\z)", KNOWN + name)
    short = "|".join(sorted((tagged(x) for x in RULES), key=lambda x: (-len(x), x)))
    out = F.regexp_replace(out, rf"(?<![^ \x02\n\x0b\f]){TAG}[ \x02\n\x0b]({short})(?=[\x02\n\x0b\f]|\z)", KNOWN + "S:$1")
    out = F.translate(F.regexp_replace(out, r"(\x01(?:[A-Z][0-9]|S:[a-z0-9 ]+))\x02", "$1\n"), WRAP, " ")
    return F.filter(F.split(out, r"[\n\x0b\f]"), lambda s: s != "")


MATCH = "struct<rule: int, first: int, last: int>"


def _matches(seq: Column, number: int, gap: int) -> Column:
    """Where the identifiers of a rule follow each other in ``seq``, each within ``gap`` + 1 sentences of the one before: the last start
    before each end, none over another."""
    rule = LIST[number][1]
    pair = "struct<first: int, last: int>"
    begun = [F.lit(None).cast(pair).alias(f"e{j}") for j in range(len(rule) - 1)]
    start = F.struct(*begun, F.array().cast(f"array<{MATCH}>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        reached = []
        for j, r in enumerate(rule):
            if j:
                before = acc[f"e{j - 1}"]
                ok = (x["id"] == r) & before.isNotNull() & (x["i"] - before["last"] <= gap + 1)
                reached.append(F.when(ok, F.struct(before["first"].alias("first"), x["i"].alias("last"))))
            else:
                reached.append(F.when(x["id"] == r, F.struct(x["i"].alias("first"), x["i"].alias("last"))))
        full = reached[-1]
        found = F.struct(F.lit(number).alias("rule"), full["first"].alias("first"), full["last"].alias("last"))
        held = [F.when(full.isNull(), F.coalesce(reached[j], acc[f"e{j}"])).cast(pair).alias(f"e{j}") for j in range(len(rule) - 1)]
        return F.struct(*held, F.when(full.isNotNull(), F.array_append(acc["out"], found)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(seq, start, step, lambda acc: acc["out"])


def recognise(docs: DataFrame, gap: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, sentence_ids (array), places (their sentence numbers), licenses (sorted array), matches (array of licence, first and last
    sentence, in order) for every row.

    A sentence is known if it, or its end after other words, is a known wording, however its lines are wrapped, behind whatever comment
    leaders; longest wording first. Null and empty texts have none; texts are read whole; null ids and repeated rows are rows like
    others; equal texts get equal results; extra columns are ignored; an empty table gives an empty result.
    """
    own = chosen(docs, id_col, text_col).toDF("doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    signs = F.lit(False)
    for s in SIGNS:
        signs = signs | F.contains(F.lower("text"), F.lit(s))
    cut = F.when(signs, sentences(F.col("text"))).otherwise(F.array().cast("array<string>"))
    numbered = F.transform(cut, lambda s, i: F.struct(F.when(F.contains(s, F.lit(KNOWN)), F.substring_index(s, KNOWN, -1)).alias("id"), i.alias("i")))
    rows = own.select("doc_id", F.filter(numbered, lambda x: x["id"].isNotNull()).alias("ids"))

    met = rows.select("doc_id", "ids", F.transform("ids", lambda x: x["id"]).alias("sentence_ids"))
    found = [F.when(F.array_contains("sentence_ids", rule[-1]), _matches(F.col("ids"), n, gap)).otherwise(F.array().cast(f"array<{MATCH}>")) for n, (_, rule) in enumerate(LIST)]
    met = met.select("*", F.concat(*found).alias("all"))
    larger = F.create_map(*[x for n, more in enumerate(LARGER) if more for x in (F.lit(n), F.array(*map(F.lit, more)))])

    def stands(m: Column) -> Column:
        over = lambda o: F.coalesce(F.array_contains(larger[m["rule"]], o["rule"]), F.lit(False)) & (o["first"] <= m["first"]) & (m["last"] <= o["last"])
        return ~F.exists("all", over)

    names = F.array(*[F.lit(licence) for licence, _ in LIST])
    matches = F.transform(F.filter("all", stands), lambda m: F.struct(m["first"].alias("first"), m["last"].alias("last"), F.element_at(names, m["rule"] + 1).alias("license")))
    met = met.select("doc_id", "sentence_ids", F.transform("ids", lambda x: x["i"]).alias("places"), F.array_sort(F.array_distinct(matches)).alias("matches"))
    return met.select("doc_id", "sentence_ids", "places", F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["license"]))).alias("licenses"), "matches")
