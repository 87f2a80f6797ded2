import re

import pytest

from lodestone.llm import licenses as L

MIT = """MIT License

Copyright (c) 2020 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("Prose first.\nReleased under the MIT License.\nMore prose.", ["MIT"]),
        ("This work is licensed under the GNU General Public License, version 3.", ["GPL-3.0"]),
        ("Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.", ["Apache-2.0"]),
        ("Licensed### under%%% the&&& Apache*** License, Version 2.0.%%% more", ["Apache-2.0"]),
        ("Licensed under CC BY-NC 4.0.", ["CC-BY-NC-4.0"]),
        ("All rights reserved.", ["Proprietary"]),
        ("# SPDX-License-Identifier: BSD-3-Clause\ncode", ["BSD-3-Clause"]),
        ("SPDX-License-Identifier: MIT OR Apache-2.0", ["MIT OR Apache-2.0"]),
        ("// SPDX-License-Identifier: GPL-2.0-or-later WITH Classpath-exception-2.0", ["GPL-2.0-or-later WITH Classpath-exception-2.0"]),
        ("SPDX-License-Identifier: LicenseRef-Our-Own", ["licenseref-our-own"]),
        ("Licensed under the GPL v3.", ["GPL-3.0"]),
        ("Licensed under Apache-2.0", ["Apache-2.0"]),
        ("GNU GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007\n", ["GPL-3.0"]),
        ("This project uses the Apache 2.0 license.", ["Apache-2.0"]),
        ("MIT License (MIT)", ["MIT"]),
        ("Released under the " + "#" * 5000 + " MIT License.", ["MIT"]),
        ("Apache License\nVersion 2.0, January 2004\nhttp://www.apache.org/licenses/\n\nTERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n", ["Apache-2.0"]),
        ("Boost Software License - Version 1.0 - August 17th, 2003", ["BSL-1.0"]),
        ("Eclipse Public License - v 2.0", ["EPL-2.0"]),
        ("This software is provided 'as-is', without any express or implied warranty. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:", ["Zlib"]),
        ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", ["LGPL-3.0"]),
        (MIT, ["MIT"]),
        (MIT + "\n\n" + MIT, ["MIT", "MIT"]),
        ("I read about the MIT License yesterday and found it short.", []),
        ("version software licence permission", []),
        ("", []),
    ],
)
def test_recognise(text, expected):
    assert [x[0] for x in L.recognise(text)] == expected


def test_sequence_is_one_licence():
    (name, sentences, a, b), *rest = L.recognise("Intro.\n\n" + MIT)
    assert sentences == ("mit_title", "mit_grant", "mit_notice", "mit_as_is") and not rest and a == 8


def test_every_known_sentence_holds_a_trigger():
    for name, pattern in L.SENTENCES:
        if pattern.startswith(L._STATED):
            continue  # each way to state a licence holds one: see below
        sure = re.sub(r"\(\?:(?:[^()]|\([^()]*\))*\)[?*]", "", pattern)  # what may be absent is
        assert L._HINT.search(sure.replace("\\", "")), name


def test_rules_name_known_sentences():
    names = {n for n, _ in L.SENTENCES}
    assert all(s in names for _, sequence in L.RULES for s in sequence)


def test_odd_tables(spark, odd, none):
    assert L.scan(odd).count() == 0 and L.scan(none).count() == 0
    df = spark.createDataFrame([(None, "All rights reserved.", "z"), (1, "x " * 3_000_000 + "end. \nAll rights reserved.", "z")], "doc_id long, text string, licence string")
    assert sorted(r["licence"] for r in L.scan(df).collect()) == ["Proprietary"] * 2


def notice(kind, version, what, semi, tail):
    return f"""This {what} is free software{semi} you can redistribute it and/or modify
it under the terms of the GNU {kind}General Public License as published by
the Free Software Foundation{',' if semi == ':' else ';'} either version {version} of the License, or
(at your option) any later version.

This {what} is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU
{kind}General Public License for more details.

You should have received a copy of the GNU {kind}General Public License
along with this {what}{tail}"""


OLD_TAIL = """; if not, write to the Free Software
Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA  02110-1301  USA"""
NOTICES = [("GPL-2.0", notice("", "2", "program", ";", OLD_TAIL)), ("LGPL-2.1", notice("Lesser ", "2.1", "library", ";", OLD_TAIL)), ("GPL-3.0", notice("", "3", "program", ":", ".  If not, see <https://www.gnu.org/licenses/>."))]


@pytest.mark.parametrize("comment", ["", "# ", " * "])
@pytest.mark.parametrize(("expected", "text"), NOTICES)
def test_gnu_notices(expected, text, comment):
    """One row each, with every sentence of the notice and 'or later' kept among them."""
    full = "Copyright (C) 2001 Somebody\n" + "\n".join(comment + line for line in text.split("\n")) + "\n\nint main() { return 0; }\n"
    (name, sentences, a, b), *rest = L.recognise(full)
    assert name.removesuffix("-or-later") == expected and not rest
    assert sentences == ("gpl_free_later", "gpl_hope", "gpl_see", "gpl_received")
    assert full[a:].startswith("This") and b > full.index("You should")


def test_semicolons_still_end_sentences():
    assert [x[0] for x in L.recognise("Licensed under CC BY-NC 4.0; all rights reserved; x")] == ["CC-BY-NC-4.0", "Proprietary"]
    assert L.recognise("This program is free software; use it.") == []
    only = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; version 2 of the License."
    assert [x[:2] for x in L.recognise(only)] == [("GPL-2.0", ("gpl_free",))]


def test_every_statement_holds_a_trigger():
    for statement in ("license ", "this file uses ", *(f"{v} under " for v in "licensed relicensed released distributed available published provided shared".split()), "made available under "):
        assert re.match(L._STATED, statement) and L._HINT.search(statement)


BODIES = {
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.""",
    "Apache-2.0": """                                 Apache License
                           Version 2.0, January 2004
                        http://www.apache.org/licenses/

   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION

   1. Definitions.""",
    "MPL-2.0": "Mozilla Public License Version 2.0\n==================================\n\n1. Definitions\n",
    "AGPL-3.0": "                    GNU AFFERO GENERAL PUBLIC LICENSE\n                       Version 3, 19 November 2007\n\n Everyone is permitted to copy and distribute verbatim copies\n of this license document, but changing it is not allowed.\n",
}


@pytest.mark.parametrize("name", sorted(BODIES))
def test_bodies(name):
    assert [x[0] for x in L.recognise(BODIES[name])] == [name]


def slow(text):
    """Rules by brute force: every way to go on from each first identifier is tried, the nearest first, by scanning."""
    known, out = L.identify(text), []
    used = set()
    for licence, sequence in L.RULES:
        for i in range(len(known)):
            if i in used or known[i][0] != sequence[0]:
                continue
            at = [i]
            for name in sequence[1:]:
                for k in range(at[-1] + 1, len(known)):
                    if k not in used and known[k][0] == name:
                        between = range(known[at[-1]][2] + 1, known[k][2])
                        if len([n for n in between if all(x[2] != n for x in known)]) <= L.GAP:
                            at.append(k)
                        break
                else:
                    break
                if known[at[-1]][0] != name:
                    break
            if len(at) == len(sequence):
                used |= set(at)
                params = {}
                for k in at:
                    params = known[k][1] | params
                out.append((L._name(licence, params), sequence, min(known[k][3] for k in at), max(known[k][4] for k in at)))
    return sorted(out, key=lambda x: (x[2], x[3], x[0]))


@pytest.mark.parametrize("seed", range(30))
def test_rules_against_brute_force(seed):
    import random

    rng = random.Random(seed)
    pieces = [p for t in (MIT, *BODIES.values(), NOTICES[0][1], NOTICES[2][1]) for p in t.split("\n\n")] + ["Prose that says nothing.", "All rights reserved.", "Licensed under CC BY-NC 4.0."]
    text = "\n\n".join(rng.choice(pieces) for _ in range(rng.randint(5, 40)))
    assert L.recognise(text) == slow(text) != []


def test_sentences_against_brute_force():
    """Each sentence that has no line breaks and no semicolon: its pattern, looked for one by one, without any filter."""
    lines = [x.strip() for t in (MIT, *BODIES.values()) for x in t.split("\n\n")] + ["Nothing here.", "Licensed under the LGPL v2.1 or later.", "license license", "word " * 5000]
    for line in lines:
        line = " ".join(line.split()).rstrip(".")
        if ". " in line or ";" in line:
            continue
        true = next((name for name, p in L.SENTENCES if re.fullmatch(p, L.normalise(line))), None)
        assert [x[0] for x in L.identify(line)] == [true] * (true is not None)


@pytest.mark.parametrize("line", ["MIT License\n", "this program is free software ", "this program is free software\n", "this program is free software; ", "license word ", "You may obtain a copy of the License at\n", "Copyright all rights reserved. "])
def test_long_texts_take_no_longer(line):
    import time

    began = time.monotonic()
    L.recognise(line * (2_000_000 // len(line)))
    assert time.monotonic() - began < 20
