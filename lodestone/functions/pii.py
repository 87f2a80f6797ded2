"""Patterns of personal data and which of them count where."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_END = r"\b"


def _digits(n: int, more: str = "") -> str:
    return rf"\d{{{n}{more}}}"


def _word(*parts: str) -> str:
    """A pattern that begins and ends at the border of a word."""
    return _END + "".join(parts) + _END


_GAP, _SLASH, _DASH = r"[-.\s]", r"\s?/\s?", r"[\s-]?"
_MONTH, _DAY, _YEAR = "(?:" + "0?[1-9]" + "|" + "1[0-2]" + ")", "(?:" + "0?[1-9]" + "|" + r"[12]\d" + "|" + "3[01]" + ")", "(?:" + "19" + "|" + "20" + ")" + r"\d" * 2
_LICENCES = "|".join(("OLN", "DLN", "DL", "OL"))
#: As the reference means them, for Python's re; ``java`` gives the same to Spark.
PATTERNS: dict[str, str] = {
    "phone": _word(_GAP.join((_digits(3), _digits(3), _digits(4)))) + "|" + rf"\({_digits(3)}\)" + f"{_GAP}?".join(("", _digits(3), _digits(4))) + _END,
    "ssn": _word("-".join(map(_digits, (3, 2, 4)))),
    "email": _word("@".join((r"[\w.+-]+", r"[\w-]+")), r"\.", r"[\w.-]+"),
    "dob_kw": "(?i)" + _word(*(f"{letter}\\.?" for letter in "DOB")),
    "alien_num": _word("A#?", _DASH.join(("", _digits(3), _digits(3), _digits(2, ",3")))),
    "driver_lic": _word(f"(?:{_LICENCES})", r"\s?".join(("", "#?", "")), r"(?=[A-Z0-9]*\d)", "[A-Z0-9]{6,}"),
    "race_sex": _word(_SLASH.join(("[BWHAI]", "[MF]"))),
    "possible_birthdate": _word("[/-]".join((_MONTH, _DAY, _YEAR))),
    "phone_compact": _word(_digits(10)),
}
_WORD = r"[\p{L}\p{N}_]"
#: What Python's classes are to Java, whose own know ASCII alone or count combining marks as letters.
_JAVA = {r"\w": _WORD, r"\d": r"\p{Nd}", r"\s": r"[\s\x1c-\x1f\x85\p{Z}]", r"\b": f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"}
#: Weak signs: they count for broad exposure alone, and the last is never redacted.
BROAD_ONLY = frozenset(("race_sex", "possible_birthdate", "phone_compact"))
REDACTION_EXEMPT = frozenset(("phone_compact",))
#: What the recipe's own check looks for.
RECIPE = ("alien_num", "ssn", "phone", "email")
PLACEHOLDERS = {k: f"[{n}]" for k, n in {"phone": "PHONE", "ssn": "SSN", "email": "EMAIL", "dob_kw": "DOB", "alien_num": "A-NUMBER", "driver_lic": "LICENSE", "race_sex": "DESCRIPTOR", "possible_birthdate": "DATE"}.items()}


#: What must follow a word's start, where it is word characters alone: it is looked at first, as it seldom holds.
_START = re.compile(r"\\b(\\d|[A-Za-z](?![?*{])|\[[A-Za-z]+\](?![?*{])|\(\?:[^()]*\)(?![?*{]))")
#: Characters without which a pattern can't match.
_NEEDS = {PATTERNS["email"]: "@", PATTERNS["race_sex"]: "/"}


def java(pattern: str) -> str:
    """The pattern for Java, with Python's Unicode meaning of \\w, \\d, \\s and \\b."""
    started = _START.sub(lambda m: f"(?={m[1]})(?<!{_WORD}){m[1]}", pattern)
    return re.sub(r"\\[wdsb]", lambda m: _JAVA[m.group()], started)


def hits(text: Column, name: str, patterns: dict[str, str] = PATTERNS) -> Column:
    t, p = text.cast("string"), patterns[name]
    found = t.rlike(java(p))
    return F.coalesce(t.contains(_NEEDS[p]) & found if p in _NEEDS else found, F.lit(False))
