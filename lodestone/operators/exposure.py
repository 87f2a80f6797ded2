"""Personal data in free text: tallied by distinct text and weight, redacted by merged spans."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.pii import BROAD_ONLY, PATTERNS, PLACEHOLDERS, REDACTION_EXEMPT, hits
from lodestone.functions.semantics import stripped

#: Words before a name that make it an official's.
TITLES = frozenset("agent capt captain chief cmdr col colonel commander corporal cpl cpt dep deputy det detective investigator lieutenant lt major marshal ofc ofcr officer patrolman sergeant sgt sheriff trooper".split())


def distinct_texts(df: DataFrame, column: str) -> DataFrame:
    """text (stripped, not blank), n: patterns then run once per distinct text."""
    t = stripped(F.col(column))
    return df.select(t.alias("text")).where("text <> ''").groupBy("text").agg(F.count("*").alias("n"))


def text_id(c: Column) -> Column:
    return F.substring(F.sha2(stripped(c), 256), 1, 16)


def flagged(texts: DataFrame, patterns: Mapping[str, str] = PATTERNS, person: Mapping[str, Column] | None = None) -> DataFrame:
    """texts with a boolean for each pattern and person role (involved, unknown_role, official), strict and broad exposure.

    strict: any pattern but the weak ones, or an involved person; broad: also weak ones and persons of unknown role. Officials
    alone expose nothing."""
    out = texts.withColumns({k: hits(F.col("text"), k, dict(patterns)) for k in patterns} | {f"person_{k}": F.coalesce(v, F.lit(False)) for k, v in (person or {}).items()})
    any_of = lambda names: reduce(Column.__or__, [F.col(k) for k in names], F.lit(False))
    roles = set(person or {})
    strict = [k for k in patterns if k not in BROAD_ONLY] + [f"person_{k}" for k in roles & {"involved"}]
    weak = [k for k in patterns if k in BROAD_ONLY] + [f"person_{k}" for k in roles & {"unknown_role"}]
    return out.withColumns({"strict": any_of(strict), "broad": any_of([*strict, *weak]), "redactable": any_of([k for k in patterns if k not in REDACTION_EXEMPT])})


def _tallied(df: DataFrame, column: str, patterns: Mapping[str, str]) -> DataFrame:
    """The flags of each distinct text, and n, its rows. Texts are judged where they are read; what is shuffled is a digest."""
    rows = flagged(df.select(stripped(F.col(column)).alias("text")).where("text <> ''"), patterns)
    names = [*patterns, "strict", "broad"]
    slim = rows.select(F.xxhash64("text").alias("_h1"), F.xxhash64(F.lit(7), "text").alias("_h2"), *names)
    return slim.groupBy("_h1", "_h2").agg(F.count("*").alias("n"), *[F.bool_or(k).alias(k) for k in names])


def sweep(df: DataFrame, column: str, patterns: Mapping[str, str] = PATTERNS) -> DataFrame:
    """category, weighted (rows), distinct (texts): patterns, strict, broad, and nonblank for all."""
    f = _tallied(df, column, patterns)
    names = [*patterns, "strict", "broad"]
    pairs = F.array(*[F.struct(F.lit(k).alias("category"), F.sum(F.when(F.col(k), F.col("n")).otherwise(0)).alias("weighted"), F.count_if(F.col(k)).alias("distinct_texts")) for k in names], F.struct(F.lit("nonblank").alias("category"), F.sum("n").alias("weighted"), F.count("*").alias("distinct_texts")))
    return f.agg(pairs.alias("p")).select(F.explode("p").alias("p")).select("p.category", F.coalesce("p.weighted", F.lit(0)).cast("bigint").alias("weighted"), "p.distinct_texts")


def exposed_groups(df: DataFrame, column: str, group: str, level: str = "strict") -> DataFrame:
    """Rows of exposed texts by group. Texts are judged where they are read and are not shuffled."""
    rows = df.select(F.col(group).alias("_group"), stripped(F.col(column)).alias("text")).where("text <> ''")
    return flagged(rows).where(level).groupBy(F.col("_group").alias(group)).agg(F.count("*").alias("n_exposed"))


def name_tokens(text: str) -> frozenset[str]:
    """Words of a name, in lower case and without the signs around them; what has no letter is none."""
    words = (w.strip(".,'\"-#/()") for w in text.lower().split())
    return frozenset(w for w in words if any(ch.isalpha() for ch in w))


def role_of(text: str, start: int, end: int, officials: Iterable[frozenset[str]] = (), involved: Iterable[frozenset[str]] = (), titles: Iterable[str] = TITLES) -> str:
    """official (on that roster, or with a title within two words before), involved (on that roster) or uninvolved. Rosters hold
    names as sets of words, as name_tokens makes them; a name is on it if all words of one of them are in the span."""
    name = name_tokens(text[start:end])
    if any(o and o <= name for o in officials):
        return "official"
    before = {w.strip(".").lower() for w in text[:start].split()[-2:]}
    if before & {t.lower() for t in titles}:
        return "official"
    return "involved" if any(o and o <= name for o in involved) else "uninvolved"


def initials(name: str) -> str:
    return "".join(f"{next(ch for ch in t if ch.isalpha()).upper()}." for t in name.split() if any(ch.isalpha() for ch in t))


def merge_spans(spans: Sequence[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Overlapping spans as their union, with the replacement of the longest (the earliest of those alike)."""
    out: list[tuple[int, int, str, int]] = []
    for a, b, by in sorted(spans, key=lambda s: (s[0], s[0] - s[1])):
        if out and a < out[-1][1]:
            p, q, old, length = out[-1]
            out[-1] = (p, max(q, b), by if b - a > length else old, max(length, b - a))
        else:
            out.append((a, b, by, b - a))
    return [(a, b, by) for a, b, by, _ in out]


def redact_text(text: str | None, person_spans: Callable[[str], Sequence[tuple[int, int]]] | None = None, patterns: Mapping[str, str] = PATTERNS) -> str | None:
    if text is None:
        return None
    spans = [(m.start(), m.end(), PLACEHOLDERS[k]) for k, p in patterns.items() if k not in REDACTION_EXEMPT for m in re.finditer(p, text)]
    spans += [(a, b, initials(text[a:b])) for a, b in (person_spans(text) if person_spans else ())]
    for a, b, by in reversed(merge_spans(spans)):
        text = text[:a] + by + text[b:]
    return text


def redact(df: DataFrame, column: str, to: str | None = None, person_spans: Callable[[str], Sequence[tuple[int, int]]] | None = None) -> DataFrame:
    """df with the column's texts redacted: Arrow batches, once for each row that any pattern hits."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: redact_text(t, person_spans), na_action="ignore")

    c = F.col(column)
    needs = F.lit(True) if person_spans else reduce(Column.__or__, [hits(c, k) for k in PATTERNS if k not in REDACTION_EXEMPT])
    return df.withColumn(to or column, F.when(needs, run(c)).otherwise(c))


def redact_literals(text: str, literals: Sequence[str], by: str = "[REDACTED]") -> str:
    """All occurrences of given texts, overlapping ones too."""
    spans = []
    for s in sorted({s for s in literals if s}, key=lambda s: (-len(s), s)):
        k = text.find(s)
        while k >= 0:
            spans.append((k, k + len(s), by))
            k = text.find(s, k + 1)
    for a, b, r in reversed(merge_spans(spans)):
        text = text[:a] + r + text[b:]
    return text


def local_exhibit(df: DataFrame, column: str) -> DataFrame:
    """text_id, text, n, categories (joined by ;) of flagged texts: for local eyes, not for publication."""
    f = flagged(distinct_texts(df, column))
    names = F.array_compact(F.array(*[F.when(F.col(k), F.lit(k)) for k in PATTERNS]))
    return f.where("broad").select(text_id(F.col("text")).alias("text_id"), "text", "n", F.array_join(names, ";").alias("categories"))


def _place(path: str) -> tuple[str, str]:
    """File system and absolute path of a folder, links and .. resolved where it is a local one."""
    import posixpath
    from pathlib import Path
    from urllib.parse import unquote, urlsplit

    parts = urlsplit(path)
    if len(parts.scheme) > 1 and parts.scheme != "file":
        return f"{parts.scheme}://{parts.netloc}".lower(), posixpath.normpath("/" + unquote(parts.path))
    return "file", str(Path(unquote(parts.path) if parts.scheme == "file" else path).resolve())


def write_exhibit(exhibit: DataFrame, folder: str, vaults: Sequence[str] = ()) -> None:
    """CSV; refuses a folder at or under any vault, whether they are given as paths or as URIs."""
    system, real = _place(folder)
    for v in vaults:
        where, root = _place(v)
        if where == system and (real == root or real.startswith(root.rstrip("/") + "/")):
            raise PermissionError(f"{folder} is within {v}")
    exhibit.write.mode("overwrite").option("header", True).csv(folder)
