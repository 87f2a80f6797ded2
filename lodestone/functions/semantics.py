"""Scalar rules that every operator shares: blanks, keywords, numbers, instants, ids. All are Column expressions."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Sequence
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as space at either end of a text: Unicode white space, not the blank alone.
_EDGES = r"(?U)^\s+|\s+$"
#: One character that Python calls space.
SPACE = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"
_NUMBER = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"
#: An instant with an offset or Z at its end.
_OFFSET = r"([zZ]|[+-]\d{2}:?\d{2})\s*$"
#: Date layouts tried in turn when a string is no ISO timestamp.
DATE_FORMATS = ("MM/dd/yyyy, hh:mm:ss a", "M/d/yyyy H:mm:ss", "M/d/yyyy H:mm", "M/d/yyyy", "d-MMM-yyyy", "MMM d, yyyy", "yyyy/MM/dd HH:mm:ss", "yyyy/MM/dd", "yyyyMMdd'T'HHmmss")


def stripped(c: Column) -> Column:
    return F.regexp_replace(c.cast("string"), _EDGES, "")


def python_strip(c: Column) -> Column:
    """Without what Python calls space at either end."""
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def canonical_json(x: Any) -> str:
    """One text for equal values: keys in order, no spaces, ASCII alone."""
    return json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=True)


def folded(c: Column) -> Column:
    """Case aside, as Unicode folds it: what differs in case alone becomes equal."""
    return F.replace(F.lower(F.replace(F.upper(c), F.lit("ẞ"), F.lit("SS"))), F.lit("ς"), F.lit("σ"))


def blank_to_null(c: Column) -> Column:
    return F.when(stripped(c) == "", None).otherwise(c)


def present(c: Column) -> Column:
    """Not null and not blank: a placeholder such as *** is present."""
    return F.coalesce(stripped(c) != "", F.lit(False))


def present_value(c: Column, kind: str) -> Column:
    """present, but a false flag is absent."""
    return F.coalesce(c, F.lit(False)) if kind == "boolean" else present(c) & F.coalesce(stripped(c) != "False", F.lit(True))


def keyword_pattern(keywords: Iterable[str]) -> str | None:
    """A case-blind pattern of whole words, the longest first; None without any word."""
    words = sorted({k.strip().lower() for k in keywords if k and k.strip()}, key=lambda k: (-len(k), k))
    escaped = (re.sub(r"([^\w\s])", r"\\\1", w) for w in words)
    return r"(?iU)\b(?:" + "|".join(escaped) + r")\b" if words else None


def has_keyword(c: Column, keywords: Iterable[str]) -> Column:
    """Whether any keyword is in the text as a whole word; null and blank texts have none."""
    pattern = keyword_pattern(keywords)
    return F.lit(False) if pattern is None else F.coalesce(c.cast("string").rlike(pattern), F.lit(False))


def number(c: Column) -> Column:
    """A double where the whole string is a decimal number, else null ('5d' or '0x1' are none)."""
    s = c.cast("string")
    return F.when(s.rlike(_NUMBER), stripped(s).try_cast("double"))


def whole(c: Column, kind: str = "string") -> Column:
    """A long, halves to the even neighbour; null where it is no number."""
    value = c.cast("double") if kind in ("int", "bigint", "smallint", "tinyint", "float", "double") or kind.startswith("decimal") else number(c)
    return F.when(~F.isnan(value), F.rint(value).try_cast("bigint"))


def instant(c: Column, kind: str, zone: str = "UTC", formats: Sequence[str] = DATE_FORMATS) -> Column:
    """A timestamp in the session's zone, UTC. Strings with an offset keep their instant; wall clocks are of the given zone, and
    those that a change of the clock skips or repeats are null. Bare times and bare years are no dates."""
    if kind == "timestamp":
        return c
    if kind in ("timestamp_ntz", "date"):
        return _wall(c.cast("timestamp_ntz").cast("timestamp"), zone)
    s = stripped(c)
    aware = F.when(s.rlike(_OFFSET) & s.rlike(r"\d{4}"), s.try_cast("timestamp"))
    plain = F.when(~s.rlike(_OFFSET) & ~s.rlike(r"^\d{1,2}:\d|^\d{4}$"), F.coalesce(s.try_cast("timestamp_ntz"), *[F.try_to_timestamp(s, F.lit(f)).cast("timestamp_ntz") for f in formats]))
    return F.coalesce(aware, _wall(plain.cast("timestamp"), zone))


def _wall(t: Column, zone: str) -> Column:
    if zone.upper() in ("UTC", "ETC/UTC", "Z"):
        return t
    utc = F.to_utc_timestamp(t, zone)
    exists = F.from_utc_timestamp(utc, zone) == t
    hour = F.expr("interval 1 hour")
    twice = (F.from_utc_timestamp(utc - hour, zone) == t) | (F.from_utc_timestamp(utc + hour, zone) == t)
    return F.when(exists & ~twice, utc)


def stable_id(*parts: Column | str) -> Column:
    """40 hexadecimal digits of the parts' digest; a null part counts as the word None."""
    cols = [F.coalesce(p.cast("string"), F.lit("None")) if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.substring(F.sha2(F.concat_ws("|", *cols), 256), 1, 40)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 or either is null."""
    return F.try_divide(a.cast("double"), b.cast("double"))
