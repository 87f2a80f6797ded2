"""License scans by sentence rules: known sentences get identifiers, and ordered rules read the sequence of identifiers.

1. A text is cut into sentences (after . ! ? ; before white space, and at blank lines), and each is normalised: lower case,
   letters, digits and dots within numbers only, single spaces, comment signs and noise gone.
2. A normalised sentence that matches a known licence sentence gets that sentence's identifier, and its parameters such as
   a version. Known sentences are whole sentences, so prose that merely speaks of a licence isn't one.
3. Rules are tried in order, the most specific first. A rule is a sequence of identifiers; it matches where they follow each
   other, with at most ``GAP`` other sentences between two of them. What a rule has used, later rules can't use.

Texts without a match of ``TRIGGER`` have no known sentence (each known sentence holds one, which a test checks), so they are
not cut at all. Texts aren't shuffled; the tables are constants.

Edge cases: null and empty texts have no licence; the same licence twice gives two rows; a sentence that could stand for
several rules goes to the first; rows that repeat are scanned each; texts, and sentences, of any length are scanned whole, in
time that grows with their length; further columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from lodestone.llm.common import per_slice

#: Unknown sentences that may lie between two of a rule.
GAP = 2

_VERSION = r"(?P<version>\d+(?:\.\d+)*)"
#: How a statement of a licence begins, and how it may end.
_BY = r"(?:(?:this|the) (?:work|file|software|project|document|code|program|library|package|module|repository|source code|book|page|text) (?:is|are) )?(?:(?:dual )?(?:re)?licensed|released|distributed|available|published|provided|shared|made available) under (?:the )?(?:terms (?:and conditions )?of )?(?:the |a |an )?"
_USES = r"(?:this|the) (?:work|file|software|project|document|code|program|library|package|module|repository) uses (?:the |a |an )?"
_STATED = rf"(?:license |(?:{_BY})|(?:{_USES}))"
_END = r"(?: licen[sc]e)?(?: see (?:the )?(?:license|copying)(?: file)?(?: for (?:more )?details)?)?"
_V = rf",? ?(?:v(?:ersion)? ?)?{_VERSION}"
#: (identifier, pattern of the whole normalised sentence)
SENTENCES: list[tuple[str, str]] = [
    ("spdx_tag", r"spdx license identifier (?P<version>[a-z0-9. ]{2,400})"),
    ("apache_by", rf"{_STATED}(?:apache(?: software)?(?: license)?|asl){_V}(?: the)?{_END}"),
    ("apache_title", rf"apache license version {_VERSION}(?: january 2004)?(?: https? www apache org licenses)?"),
    ("apache_terms", r"terms and conditions for use reproduction and distribution"),
    ("apache_end", r"end of terms and conditions"),
    ("apache_not_except", r"you may not use this file except in compliance with the license"),
    ("apache_obtain", r"you may obtain a copy of the license at(?: https? www apache org licenses license 2\.0)?"),
    ("apache_as_is", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("apache_see", r"see the license for the specific language governing permissions and limitations under the license"),
    ("mit_by", rf"{_STATED}mit{_END}"),
    ("mit_title", r"(?:the )?mit license(?: mit)?"),
    ("mit_grant", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("mit_notice", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit_as_is", r"the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("isc_grant", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("bsd_grant", r"redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd_source", r"(?:1\.? )?redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd_binary", r"(?:2\.? )?redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd_endorse", r"(?:3\.? )?neither the name of .{1,80} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd_by", rf"{_STATED}(?:(?:new |simplified |modified |revised )?bsd (?P<version>[0234]) ?clause|(?P<version2>[0234]) ?clause bsd){_END}"),
    ("bsd_title", r"(?:the )?bsd (?P<version>[234]) ?clause license"),
    ("bsd_as_is", r"this software is provided by the copyright holders? and contributors? as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    ("bsd_no_event", r"in no event shall the (?:copyright (?:holder|owner)|regents|authors?)s?(?: and|or| or)? ?contributors? be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"),
    ("isc_as_is", r"the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"),
    ("isc_by", rf"{_STATED}isc{_END}"),
    ("zlib_as_is", r"this software is provided as is without any express or implied warranty"),
    ("zlib_grant", r"permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"),
    ("zlib_by", rf"{_STATED}zlib{_END}"),
    ("boost_title", r"boost software license version 1\.0(?: august 17th 2003)?"),
    ("boost_grant", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following"),
    ("boost_by", rf"(?:{_STATED}|distributed under the )boost software license(?: version)? 1\.0(?: see accompanying file license 1 0 txt or copy at .{{0,80}})?"),
    ("epl_title", rf"eclipse public license v(?:ersion)? ?{_VERSION}"),
    ("epl_by", rf"{_STATED}(?:eclipse public license|epl){_V}{_END}"),
    ("epl_terms", rf"this program and the accompanying materials are made available under the terms of the eclipse public license v?(?:ersion)? ?{_VERSION}(?: which (?:accompanies this distribution and )?is available at .{{0,80}})?"),
    ("artistic_title", rf"(?:the )?artistic license {_VERSION}"),
    ("artistic_by", rf"{_STATED}artistic license{_V}"),
    ("wtfpl_title", r"do what the fuck you want to public license(?: version 2(?: december 2004)?)?"),
    ("wtfpl_by", rf"{_STATED}(?:wtfpl|do what the fuck you want to public)(?: license)?(?: version 2)?"),
    ("gpl_title", rf"gnu (?P<kind>affero |lesser |library )?general public license version {_VERSION}(?: (?:june|november|february|july|29 june|19 november) (?:1991|1999|2007))?"),
    ("gpl_verbatim", r"everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"),
    ("bsd_style_by", r"use of this source code is governed by a bsd style license that can be found in the license file"),
    ("gpl_by", rf"{_STATED}(?:gnu general public license|gnu gpl|gpl){_V}(?P<later> or (?:at your option )?(?:any )?later(?: version)?)?{_END}"),
    ("lgpl_by", rf"{_STATED}(?:gnu (?:lesser|library) general public license|gnu lgpl|lgpl){_V}(?P<later> or (?:at your option )?(?:any )?later(?: version)?)?{_END}"),
    ("agpl_by", rf"{_STATED}(?:gnu affero general public license|gnu agpl|agpl){_V}(?P<later> or (?:at your option )?(?:any )?later(?: version)?)?{_END}"),
    ("gpl_free_later", rf"this (?:program|library|file) is free software you can redistribute it and or modify it under the terms of the gnu (?P<kind>affero |lesser |library )?general public license as published by the free software foundation either version {_VERSION} of the license or at your option any later version"),
    ("gpl_free", rf"this (?:program|library|file) is free software you can redistribute it and or modify it under the terms of the gnu (?P<kind>affero |lesser |library )?general public license as published by the free software foundation(?: either)? version {_VERSION} of the license"),
    ("gpl_later", r"or at your option any later version(?: of the license)?"),
    ("gpl_hope", r"this (?:program|library|file) is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("gpl_without", r"without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("gpl_see", r"see the gnu (?:affero |lesser |library )?general public license for more details"),
    ("gpl_received", r"you should have received a copy of the gnu (?:affero |lesser |library )?general public license along with this (?:program|library|file).{0,80}"),
    ("mpl_terms", rf"this source code form is subject to the terms of the mozilla public license v(?:ersion)? ?\.? ?{_VERSION}"),
    ("mpl_copy", r"if a copy of the mpl was not distributed with this file you can obtain one at.{0,60}"),
    ("mpl_title", rf"mozilla public license version {_VERSION}"),
    ("mpl_by", rf"{_STATED}(?:mozilla public license|mpl){_V}{_END}"),
    ("cc_by", rf"{_STATED}(?:cc|creative commons) (?P<kind>by(?: nc| sa| nd)*|attribution(?: noncommercial| sharealike| noderivatives| noderivs| non commercial| share alike| no derivatives)*) ?{_VERSION}(?: (?:international|unported|generic))?(?: public)?(?: license)?"),
    ("cc0_by", r"(?:this (?:work|file|software|project|document|code) is )?(?:released|licensed|distributed|available|dedicated) (?:under|to the public domain under) (?:the terms of )?(?:the )?(?:cc0|creative commons zero)(?: 1\.0)?(?: universal)?(?: license)?"),
    ("unlicense_free", r"this is free and unencumbered software released into the public domain"),
    ("unlicense_by", rf"{_STATED}unlicense"),
    ("all_rights", r"(?:copyright .{0,80})?all rights reserved"),
]

#: (licence, identifiers in order). {v}: the version of the sentence that has one; {k}: its kind.
RULES: list[tuple[str, tuple[str, ...]]] = [
    ("{spdx}", ("spdx_tag",)),
    ("Apache-{v}", ("apache_title", "apache_terms", "apache_end")),
    ("Apache-{v}", ("apache_title", "apache_terms")),
    ("Apache-{v}", ("apache_title",)),
    ("Apache-{v}", ("apache_by", "apache_not_except", "apache_obtain", "apache_as_is", "apache_see")),
    ("Apache-{v}", ("apache_by", "apache_not_except")),
    ("Apache-{v}", ("apache_by",)),
    ("MIT", ("mit_title", "mit_grant", "mit_notice", "mit_as_is")),
    ("MIT", ("mit_grant", "mit_notice", "mit_as_is")),
    ("MIT", ("mit_grant", "mit_notice")),
    ("MIT", ("mit_by",)),
    ("MIT", ("mit_title",)),
    ("ISC", ("isc_grant", "isc_as_is")),
    ("ISC", ("isc_grant",)),
    ("BSD-3-Clause", ("bsd_title", "bsd_grant", "bsd_source", "bsd_binary", "bsd_endorse", "bsd_as_is", "bsd_no_event")),
    ("BSD-3-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_endorse", "bsd_as_is", "bsd_no_event")),
    ("BSD-2-Clause", ("bsd_title", "bsd_grant", "bsd_source", "bsd_binary", "bsd_as_is", "bsd_no_event")),
    ("BSD-2-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_as_is", "bsd_no_event")),
    ("BSD-3-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_endorse")),
    ("BSD-2-Clause", ("bsd_grant", "bsd_source", "bsd_binary")),
    ("BSD-{v}-Clause", ("bsd_title",)),
    ("BSD-{v}-Clause", ("bsd_by",)),
    ("BSD-style", ("bsd_style_by",)),
    ("ISC", ("isc_by",)),
    ("Zlib", ("zlib_as_is", "zlib_grant")),
    ("Zlib", ("zlib_grant",)),
    ("Zlib", ("zlib_by",)),
    ("BSL-1.0", ("boost_title", "boost_grant")),
    ("BSL-1.0", ("boost_title",)),
    ("BSL-1.0", ("boost_grant",)),
    ("BSL-1.0", ("boost_by",)),
    ("EPL-{v}", ("epl_terms",)),
    ("EPL-{v}", ("epl_title",)),
    ("EPL-{v}", ("epl_by",)),
    ("Artistic-{v}", ("artistic_title",)),
    ("Artistic-{v}", ("artistic_by",)),
    ("WTFPL", ("wtfpl_title",)),
    ("WTFPL", ("wtfpl_by",)),
    ("{gnu}", ("gpl_title", "gpl_verbatim")),
    ("{gnu}", ("gpl_title",)),
    ("{gnu}-or-later", ("gpl_free", "gpl_later", "gpl_hope", "gpl_see", "gpl_received")),
    ("{gnu}-or-later", ("gpl_free", "gpl_later")),
    ("{gnu}", ("gpl_free_later", "gpl_hope", "gpl_without", "gpl_see", "gpl_received")),
    ("{gnu}", ("gpl_free_later", "gpl_hope", "gpl_see", "gpl_received")),
    ("{gnu}", ("gpl_free_later", "gpl_hope", "gpl_see")),
    ("{gnu}", ("gpl_free_later",)),
    ("{gnu}", ("gpl_free", "gpl_hope", "gpl_without", "gpl_see", "gpl_received")),
    ("{gnu}", ("gpl_free", "gpl_hope", "gpl_see", "gpl_received")),
    ("{gnu}", ("gpl_free", "gpl_hope", "gpl_see")),
    ("{gnu}", ("gpl_free",)),
    ("AGPL-{v}", ("agpl_by",)),
    ("LGPL-{v}", ("lgpl_by",)),
    ("GPL-{v}", ("gpl_by",)),
    ("MPL-{v}", ("mpl_terms", "mpl_copy")),
    ("MPL-{v}", ("mpl_terms",)),
    ("MPL-{v}", ("mpl_title",)),
    ("MPL-{v}", ("mpl_by",)),
    ("CC-{cc}-{v}", ("cc_by",)),
    ("CC0-1.0", ("cc0_by",)),
    ("Unlicense", ("unlicense_free",)),
    ("Unlicense", ("unlicense_by",)),
    ("Proprietary", ("all_rights",)),
]

#: Each known sentence holds a match of this.
TRIGGER = r"licen[sc]|permission|permitted|redistribut|reproduction|terms|warrant|reserved|unencumbered|version|software|available|released|distributed|published|provided|shared|uses|mpl|cc0|creative|commons|\bcc\b"
_PATTERNS = [(name, re.compile(pattern)) for name, pattern in SENTENCES]
_ANY = re.compile("|".join(f"(?:{re.sub(r'[?]P<[a-z]+>', '?:', p)})" for _, p in SENTENCES))
_NOISE = re.compile(r"[^a-z0-9.]+|(?<![0-9])\.|\.(?![0-9])")
#: More words than any known sentence has: the gaps of a pattern count as words of one character.
_WORDS = max(p.count(" ") + 1 + sum(map(int, re.findall(r"\{\d+,(\d+)\}", p))) // 2 for _, p in SENTENCES)
_WORD = re.compile(r"[a-zA-Z0-9]+")


def normalise(sentence: str) -> str:
    return " ".join(_NOISE.sub(" ", sentence.lower()).split())


def _known(text: str, start: int, end: int) -> tuple[str, dict[str, str]] | None:
    """The known sentence that the text from start to end is. One of too many words is none, and is not read to its end."""
    if next(islice(_WORD.finditer(text, start, end), _WORDS, None), None) or not _HINT.search(text, start, end):
        return None
    line = normalise(text[start:end])
    if not _ANY.fullmatch(line):
        return None
    name, m = next((name, m) for name, pattern in _PATTERNS if (m := pattern.fullmatch(line)))
    return name, {k.rstrip("2"): v for k, v in m.groupdict().items() if v}


def identify(text: str) -> list[tuple[str, dict[str, str], int, int, int]]:
    """(identifier, parameters, number of the sentence, start, end) of the known sentences of a text, in order. A sentence's
    lines are tried first, as licence lines often stand in prose without a full stop; if none is known, they are one sentence."""
    out = []
    cut = _cut(text, _BREAK, 0, len(text))
    upto = 0
    for n, (a, b) in enumerate(cut):
        if n < upto or not _HINT.search(text, a, b):
            continue
        if whole := _joined(text, cut, n):
            *known, upto = whole
            out.append((known[0][0], known[0][1], n, known[1], known[2]))
            continue
        lines = _cut(text, _LINE, a, b)
        found = [(known, p, q) for p, q in lines if (known := _known(text, p, q))] or ([(known, a, b)] if len(lines) > 1 and (known := _known(text, a, b)) else [])
        out += [(name, params, n, p, q) for (name, params), p, q in found]
    return out


def _joined(text: str, cut: list[tuple[int, int]], n: int) -> tuple[tuple[str, dict[str, str]], int, int, int] | None:
    """A known sentence across semicolons that begins at a line of piece n: what is known, start, end, number of the next piece."""
    for m in _ACROSS.finditer(text, *cut[n]):
        last = n + 1
        while last < min(len(cut), n + 1 + _PIECES) and text[cut[last - 1][1]] == ";" and not _PARAGRAPH.search(text, cut[last - 1][1], cut[last][0]):
            last += 1
        for k in range(last, n, -1):
            if (k > n + 1 or m.start(1) > cut[n][0]) and (known := _known(text, m.start(1), cut[k - 1][1])):
                return known, m.start(1), cut[k - 1][1], k
    return None


_HINT = re.compile(TRIGGER, re.I)
_BREAK = re.compile(r"[.!?;][^\w\s]*\s+|\n\s*\n|(?<=:)\s*\n")
_LINE = re.compile(r"[\r\n]+")
_PARAGRAPH = re.compile(r"\n\s*\n")
#: How a known sentence begins that may have semicolons in it, at most ``_PIECES`` of them.
_ACROSS = re.compile(r"(?:\A|^)[^\w\r\n]*(this\W+(?:program|library|file)\W+is\W+(?:free\W+software|distributed\W+in\W+the\W+hope))", re.I | re.M)
_PIECES = 3


def _cut(text: str, at: re.Pattern, start: int, end: int) -> list[tuple[int, int]]:
    out = []
    for m in at.finditer(text, start, end):
        if m.start() > start:
            out.append((start, m.start()))
        start = m.end()
    return [*out, (start, end)] if start < end else out


#: Licence names in their own letters, for tags.
_SPDX = {
    x.lower(): x
    for x in """0BSD AFL-3.0 AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.1 Apache-2.0 Artistic-1.0 Artistic-2.0 BlueOak-1.0.0 BSD-1-Clause BSD-2-Clause
    BSD-2-Clause-Patent BSD-3-Clause BSD-3-Clause-Clear BSD-4-Clause BSL-1.0 BUSL-1.1 CC-BY-3.0 CC-BY-4.0 CC-BY-NC-3.0 CC-BY-NC-4.0 CC-BY-NC-ND-4.0 CC-BY-NC-SA-3.0
    CC-BY-NC-SA-4.0 CC-BY-ND-4.0 CC-BY-SA-3.0 CC-BY-SA-4.0 CC0-1.0 CDDL-1.0 CDDL-1.1 CECILL-2.1 CPL-1.0 ECL-2.0 EPL-1.0 EPL-2.0 EUPL-1.1 EUPL-1.2 GFDL-1.3 GPL-1.0
    GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.0 LGPL-2.0-only LGPL-2.0-or-later LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0
    LGPL-3.0-only LGPL-3.0-or-later LPPL-1.3c MIT MIT-0 MPL-1.1 MPL-2.0 MPL-2.0-no-copyleft-exception MS-PL MS-RL MulanPSL-2.0 NCSA ODbL-1.0 OFL-1.1 OpenSSL OSL-3.0 PHP-3.01 PostgreSQL
    PSF-2.0 Python-2.0 Ruby SSPL-1.0 Unicode-DFS-2016 Unlicense UPL-1.0 Vim W3C WTFPL X11 Zlib ZPL-2.1
    Classpath-exception-2.0 GCC-exception-3.1 LLVM-exception Linux-syscall-note Autoconf-exception-3.0 Bison-exception-2.2 Font-exception-2.0 OpenSSL-exception""".split()
}
_OPERATORS = re.compile(r" (and|or|with) ")


def _tag(words: str) -> str:
    """A tag's expression, normalised, in the letters of its licences: names by OR, AND and WITH, which stay."""
    parts = _OPERATORS.split(re.sub(r"(?<= )(or|and) (later|only)\b", r"\1~\2", words))
    return " ".join(p.upper() if k % 2 else _SPDX.get(name := p.strip().replace("~", "-").replace(" ", "-"), name) for k, p in enumerate(parts))


def _name(licence: str, params: dict[str, str]) -> str:
    version, kind = params.get("version", ""), params.get("kind", "").strip()
    if licence == "{spdx}":
        return _tag(version)
    dotted = version if "." in version else f"{version}.0"
    gnu = {"affero": "AGPL", "lesser": "LGPL", "library": "LGPL"}.get(kind, "GPL")
    kind = kind.replace("non commercial", "noncommercial").replace("share alike", "sharealike").replace("no derivatives", "noderivatives")
    cc = "-".join({"by": "BY", "attribution": "BY", "nc": "NC", "noncommercial": "NC", "sa": "SA", "sharealike": "SA", "nd": "ND", "noderivatives": "ND", "noderivs": "ND"}.get(k, "") for k in kind.split())
    name = licence.replace("{gnu}", f"{gnu}-{dotted}").replace("{cc}", cc)
    name = "0BSD" if licence.startswith("BSD-{v}") and version == "0" else name.replace("BSD-{v}", f"BSD-{version}").replace("{v}", dotted)
    return name + "-or-later" * ("later" in params and not name.endswith("later"))


def recognise(text: str) -> list[tuple[str, tuple[str, ...], int, int]]:
    """(licence, identifiers, start, end) of each licence in a text, in the order of the text."""
    known = identify(text)
    used = [False] * len(known)
    where: dict[str, list[int]] = {}
    for i, k in enumerate(known):
        where.setdefault(k[0], []).append(i)
    out = []
    for licence, sequence in RULES:
        if any(name not in where for name in sequence):
            continue
        passed = [0] * len(sequence)  # of each identifier's places, those that this rule is through with: starts only grow
        for i in where[sequence[0]]:
            if used[i]:
                continue
            at = [i]
            for j, name in enumerate(sequence[1:], 1):
                places = where[name]
                p = max(passed[j], bisect_right(places, at[-1]))
                while p < len(places) and used[places[p]]:
                    p += 1
                passed[j] = p
                # Of the sentences in between, those that aren't known count.
                if p == len(places) or (known[places[p]][2] - known[at[-1]][2] - 1) - (places[p] - at[-1] - 1) > GAP:
                    break
                at.append(places[p])
            if len(at) < len(sequence):
                continue
            for k in at:
                used[k] = True
            params: dict[str, str] = {}
            for k in at:
                params = known[k][1] | params
            out.append((_name(licence, params), sequence, min(known[k][3] for k in at), max(known[k][4] for k in at)))
    return sorted(out, key=lambda x: (x[2], x[3], x[0]))


def scan(docs: DataFrame) -> DataFrame:
    """A row for each licence found: doc_id, licence, sentences (identifiers), start and end in characters."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        hit = pc.fill_null(pc.match_substring_regex(batch.column("text"), TRIGGER, ignore_case=True), False)
        at = np.flatnonzero(hit.to_numpy(zero_copy_only=False))
        rows = []
        for i, text in zip(at.tolist(), batch.column("text").take(pa.array(at)).to_pylist()):
            rows += [(i, *found) for found in recognise(text)]
        if not rows:
            return None
        which, licence, sentences, start, end = zip(*rows)
        return pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").take(pa.array(which, pa.int64())), "licence": list(licence), "sentences": pa.array([list(s) for s in sentences], pa.list_(pa.string())), "start": pa.array(start, pa.int64()), "end": pa.array(end, pa.int64())})

    return docs.select("doc_id", "text").mapInArrow(per_slice(run, "text"), "doc_id long, licence string, sentences array<string>, start long, end long")
