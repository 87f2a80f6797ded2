"""Derived columns from configuration: every derivation is a Column, all of them one projection."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.semantics import blank_to_null, has_keyword, instant, present, stripped, whole

Config = Mapping[str, Any]


def _kind(df: DataFrame, column: str) -> str:
    return dict(df.dtypes)[column]


def geo(df: DataFrame, cfg: Config) -> dict[str, Column]:
    """home, away or unknown, by the trimmed and case-blind value."""
    value = F.lower(stripped(F.col(cfg["column"])))
    home = [h.strip().lower() for h in ([cfg["home"]] if isinstance(cfg["home"], str) else cfg["home"])]
    labels = {"in": "IN", "out": "OOS", "unknown": "UNK"} | dict(cfg.get("labels", {}))
    return {cfg.get("to", "geo"): F.when(value.isNull() | (value == ""), labels["unknown"]).when(value.isin(home), labels["in"]).otherwise(labels["out"])}


def reason(df: DataFrame, cfg: Config) -> dict[str, Column]:
    """The trimmed text, and the first category of which a keyword is in it."""
    text = stripped(F.col(cfg["column"]))
    found = [F.when(has_keyword(text, words), F.lit(name)) for name, words in cfg["categories"].items()]
    return {"reason_text": text, "reason_cat": F.coalesce(*found, F.lit(cfg.get("default", "Other")))}


def keyword_flag(df: DataFrame, cfg: Config) -> dict[str, Column]:
    return {cfg.get("to", "is_immigration"): has_keyword(F.col(cfg["column"]), cfg["keywords"])}


def nets(df: DataFrame, cfg: Config) -> dict[str, Column]:
    return {cfg.get("to", "nets"): whole(F.col(cfg["column"]), _kind(df, cfg["column"]))}


def has_case(df: DataFrame, cfg: Config) -> dict[str, Column]:
    """Presence, not value: *** is a case number withheld, a blank is none. Further absent marks may not be blank."""
    absent = [a.strip() for a in cfg.get("absent", ())]
    if any(not a for a in absent):
        raise ValueError("a blank mark of absence says nothing: blanks are absent anyway")
    value = F.col(cfg["column"])
    there = present(value)
    return {cfg.get("to", "has_case"): (there & ~F.coalesce(stripped(value).isin(absent), F.lit(False))) if absent else there}


def base_type(df: DataFrame, cfg: Config) -> dict[str, Column]:
    value = F.col(cfg["column"])
    pairs = [x for k, v in cfg["lookup"].items() for x in (F.lit(k), F.lit(v))]
    found = F.try_element_at(F.create_map(*pairs), value) if pairs else F.lit(None).cast("string")
    return {cfg.get("to", "base_type"): F.coalesce(found, F.lit(cfg["default"]) if cfg.get("default") is not None else value.cast("string"))}


def local_time(df: DataFrame, cfg: Config) -> dict[str, Column]:
    """Date, hour and weekday (Monday 0) in the target zone."""
    utc = instant(F.col(cfg["column"]), _kind(df, cfg["column"]), cfg.get("source_zone", "UTC"))
    local = F.from_utc_timestamp(utc, cfg.get("target_zone", "America/New_York"))
    s = cfg.get("suffix", "et")
    return {f"date_{s}": F.to_date(local), f"hour_{s}": F.hour(local), f"dow_{s}": F.weekday(local)}


DERIVATIONS = {"geo": geo, "reason": reason, "immigration": keyword_flag, "nets": nets, "has_case": has_case, "base_type": base_type, "temporal": local_time}


def derive_columns(df: DataFrame, config: Mapping[str, Config]) -> DataFrame:
    """df with the columns of all derivations named in config, in one projection. Unknown names raise."""
    if unknown := [k for k in config if k not in DERIVATIONS]:
        raise ValueError(f"no such derivation: {unknown}; there are {sorted(DERIVATIONS)}")
    new: dict[str, Column] = {}
    for name, cfg in config.items():
        new |= DERIVATIONS[name](df, cfg)
    return df.withColumns(new)


def empty_to_null(df: DataFrame) -> DataFrame:
    """White space alone becomes null, in every string column."""
    return df.withColumns({c: blank_to_null(F.col(f"`{c}`")) for c, kind in df.dtypes if kind == "string"})


def forward_fill(df: DataFrame, columns: Sequence[str], order: str, group: Sequence[str] = ()) -> DataFrame:
    """Each null takes the last value before it in the order. Without a group the window is one partition: give one at scale."""
    from pyspark.sql import Window

    before = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(before) for c in columns if c in df.columns})


STATES = frozenset("AL AK AZ AR CA CO CT DE DC FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT NE NV NH NJ NM NY NC ND OH OK OR PA RI SC SD TN TX UT VT VA WA WV WI WY".split())


def state_of(c: Column) -> Column:
    """The last word of two letters, in any case, that is a state of the US; without one, SC where South Carolina is written out."""
    tokens = F.transform(F.regexp_extract_all(c, F.lit(r"([A-Za-z]{2,})"), F.lit(1)), F.upper)
    return F.coalesce(F.try_element_at(F.filter(tokens, lambda t: t.isin(sorted(STATES))), F.lit(-1)), F.when(F.lower(c).contains("south carolina"), "SC"))


def split_category(c: Column) -> tuple[Column, Column]:
    """What is before and after the first ' - '."""
    parts = F.split(c, " - ", 2)
    return F.try_element_at(parts, F.lit(1)), F.try_element_at(parts, F.lit(2))
