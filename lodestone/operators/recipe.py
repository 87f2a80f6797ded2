"""The thirteen checks of an audit log, for one source or many at once.

Result, long: source_id, check_name, status, reason, metric, key, value. status is ok, partial (it ran, but some metric is
undefined: its value is null, never 0) or skipped (a column is missing). Scalar checks share one aggregate of the table,
checks on actors share one table of actor counts; each further grouping is one more shuffle of counts.

ai_moderation: every actor whose share of valid hours outside [day_start, day_end) is above overnight_threshold is a row
(overnight_heavy_actor, value: the share), a lead alone: hours are of one time zone, so the share can come from geography.
burst_size_distribution has a row for each burst size.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.pii import RECIPE, hits
from lodestone.functions.semantics import has_keyword, instant, present_value, ratio, whole
from lodestone.operators.quality import CEILING
from lodestone.operators.stats import concentration

CHECKS = ("truncation", "out_of_state", "immigration", "pretext", "pii", "accountability", "co_travel", "blast_radius", "mega_users", "operations", "ai_moderation", "cross_agency", "statistical_patterns")
#: Columns that a check can't do without, by the names that config maps to columns.
NEEDS: dict[str, tuple[str, ...]] = {"out_of_state": ("geo",), "accountability": ("case",), "blast_radius": ("nets",), "mega_users": ("actor",), "operations": ("ts",), "ai_moderation": ("actor", "hour"), "cross_agency": ("actor",), "statistical_patterns": ("actor",), "co_travel": ("text",), "pii": ("text",)}
_OUT = ("source_id", "check_name", "status", "reason", "metric", "key", "value")


class _Context:
    def __init__(self, df: DataFrame, cfg: Mapping[str, Any], source: str | None) -> None:
        self.cfg, self.kinds = cfg, dict(df.dtypes)
        self.df = df.withColumn("_source", F.col(source).cast("string") if source else F.lit("all"))
        self._actors: DataFrame | None = None

    def has(self, name: str) -> bool:
        return self.cfg.get(name) in self.kinds

    def col(self, name: str) -> Column:
        return F.col(self.cfg[name])

    def kind(self, name: str) -> str:
        return self.kinds[self.cfg[name]]

    def actors(self) -> DataFrame:
        if self._actors is None:
            external = F.col(self.cfg["geo"]).eqNullSafe(self.cfg.get("labels", {}).get("out", "OOS")) if self.has("geo") else F.lit(False)
            valid = day = F.lit(False)
            if self.has("hour"):
                h = self.col("hour")
                valid = F.coalesce((h >= 0) & (h <= 23), F.lit(False))
                day = valid & (h >= self.cfg.get("day_start", 6)) & (h < self.cfg.get("day_end", 18))
            counts = {"n": F.count("*"), "n_external": F.count_if(external), "n_hours": F.count_if(valid), "n_day": F.count_if(day)}
            self._actors = self.df.where(self.col("actor").isNotNull()).groupBy("_source", self.col("actor").cast("string").alias("actor")).agg(*[v.alias(k) for k, v in counts.items()])
        return self._actors

    def ts(self) -> Column:
        return instant(self.col("ts"), self.kind("ts"), self.cfg.get("zone", "UTC"))


def _flag(c: _Context, flag: str, text: str, words: str) -> Column | None:
    """A flag column if there is one (any non-empty string is true), else keywords in the text."""
    if c.has(flag):
        v = c.col(flag)
        return F.coalesce(F.length(v) > 0 if c.kind(flag) == "string" else v.cast("boolean"), F.lit(False))
    return has_keyword(c.col(text), c.cfg[words]) if c.has(text) and c.cfg.get(words) else None


def _scalars(c: _Context) -> list[tuple[str, str, Column]]:
    """(check, metric, aggregate) of all that one pass over the table answers."""
    n = F.count("*")
    out: list[tuple[str, str, Column]] = [("truncation", "rows", n), ("truncation", "truncated", (n == c.cfg.get("ceiling", CEILING)).cast("int"))]
    if c.has("geo"):
        labels = {"in": "IN", "out": "OOS", "unknown": "UNK"} | dict(c.cfg.get("labels", {}))
        of = {k: F.count_if(c.col("geo").eqNullSafe(v)) for k, v in labels.items()}
        out += [("out_of_state", f"n_{k}", v) for k, v in of.items()]
        out += [("out_of_state", "pct", ratio(of["out"], n)), ("out_of_state", "pct_known", ratio(of["out"], of["out"] + of["in"]))]
    for check, flag, words in (("immigration", "immigration", "immigration_keywords"), ("pretext", "pretext", "pretext_keywords"), ("co_travel", "co_travel", "co_travel_keywords")):
        mask = _flag(c, flag, "text", words)
        if mask is None and check == "pretext" and c.has("category") and c.cfg.get("pretext_categories"):
            mask = F.coalesce(c.col("category").isin(*c.cfg["pretext_categories"]), F.lit(False))
        if mask is not None:
            out += [(check, "n", F.count_if(mask)), (check, "pct", ratio(F.count_if(mask), n))]
    if c.has("text"):
        texts = [F.col(t) for t in c.cfg.get("pii_columns", [c.cfg["text"]]) if t in c.kinds]
        each = {p: reduce(Column.__or__, [hits(t, p) for t in texts]) for p in RECIPE}
        any_of = F.count_if(reduce(Column.__or__, each.values()))
        out += [("pii", "n_records", any_of), ("pii", "pct", ratio(any_of, n))] + [("pii", f"n_{p}", F.count_if(m)) for p, m in each.items()]
    if c.has("case"):
        there = F.count_if(present_value(c.col("case"), c.kind("case")))
        out += [("accountability", "with_case", there), ("accountability", "no_case_pct", ratio(n - there, n))]
    if c.has("nets"):
        x = whole(c.col("nets"), c.kind("nets"))
        out += [("blast_radius", "n_obs", F.count(x)), ("blast_radius", "median", F.median(x)), ("blast_radius", "max", F.max(x)), ("blast_radius", "total", F.sum(x))]
    if c.has("ts"):
        day = F.to_date(F.from_utc_timestamp(c.ts(), c.cfg.get("target_zone", "UTC")))
        active = F.count_distinct(day)
        out += [("operations", "first_day", F.unix_date(F.min(day))), ("operations", "last_day", F.unix_date(F.max(day))), ("operations", "span_days", F.datediff(F.max(day), F.min(day))), ("operations", "active_days", active), ("operations", "records_per_active_day", ratio(n, active)), ("operations", "n_undated", F.count_if(c.ts().isNull()))]
    return out


def _long(df: DataFrame, check: str, metrics: Mapping[str, Column], key: Column | None = None) -> DataFrame:
    found = F.array(*[F.struct(F.lit(m).alias("metric"), v.cast("double").alias("value")) for m, v in metrics.items()])
    return df.select(F.col("_source").alias("source_id"), F.lit(check).alias("check_name"), (F.lit(None) if key is None else key).cast("string").alias("key"), F.explode(found).alias("m")).select("source_id", "check_name", "m.metric", "key", "m.value")


def _top_key(df: DataFrame, key: Column, name: str, metric: str) -> DataFrame:
    """The key of most rows in each source, the least of those alike."""
    counted = df.where(key.isNotNull()).groupBy("_source", key.alias("k")).agg(F.count("*").alias("n"))
    best = counted.groupBy("_source").agg(F.min_by(F.col("k"), F.struct(-F.col("n"), F.col("k"))).alias("k"), F.max("n").alias("n"))
    return _long(best, name, {metric: F.col("n")}, F.col("k"))


def run_recipe(df: DataFrame, cfg: Mapping[str, Any], source: str | None = None, checks: Sequence[str] = CHECKS) -> DataFrame:
    if unknown := [k for k in checks if k not in CHECKS]:
        raise ValueError(f"no such check: {unknown}")
    c = _Context(df, cfg, source)
    parts: list[DataFrame] = []
    scalars = [s for s in _scalars(c) if s[0] in checks]
    skipped = {k: "missing " + ", ".join(x for x in NEEDS.get(k, ()) if not c.has(x)) for k in checks if any(not c.has(x) for x in NEEDS.get(k, ()))}
    answered = {s[0] for s in scalars}
    skipped |= {k: "no column and no keywords for it" for k in ("immigration", "pretext", "co_travel") if k in checks and k not in answered and k not in skipped}
    if scalars:
        one = c.df.groupBy("_source").agg(*[v.cast("double").alias(f"s{i}") for i, (_, _, v) in enumerate(scalars)])
        found = F.array(*[F.struct(F.lit(k).alias("check_name"), F.lit(m).alias("metric"), F.col(f"s{i}").alias("value")) for i, (k, m, _) in enumerate(scalars)])
        parts.append(one.select(F.col("_source").alias("source_id"), F.explode(found).alias("m")).select("source_id", "m.check_name", "m.metric", F.lit(None).cast("string").alias("key"), "m.value"))

    def grouped(check: str, name: str, metric: str, value: Column, where: Column | None = None) -> None:
        if check in checks and check not in skipped and c.has(name):
            rows = c.df.where(c.col(name).isNotNull()) if where is None else c.df.where(c.col(name).isNotNull() & where)
            g = rows.groupBy("_source", c.col(name).alias("k")).agg(value.alias("v")).where("v is not null")
            parts.append(_long(g, check, {metric: F.col("v")}, F.col("k")))

    flag = _flag(c, "immigration", "text", "immigration_keywords")
    if flag is not None:
        grouped("immigration", "subtype", "n_by_subtype", F.count("*"), flag)
    if c.has("case"):
        grouped("accountability", "group", "no_case_pct_by_group", 1 - F.avg(present_value(c.col("case"), c.kind("case")).cast("double")))
    if c.has("nets"):
        grouped("blast_radius", "severity", "median_by_severity", F.median(whole(c.col("nets"), c.kind("nets"))))
    wanted = lambda k: k in checks and k not in skipped
    if wanted("operations"):
        local = F.from_utc_timestamp(c.ts(), c.cfg.get("target_zone", "UTC"))
        parts += [_top_key(c.df, F.to_date(local), "operations", "busiest_day"), _top_key(c.df, F.hour(local), "operations", "busiest_hour")]
        if c.has("actor"):
            parts.append(_long(c.actors().groupBy("_source").agg(F.count("*").alias("n")), "operations", {"n_users": F.col("n")}))
    frac = float(cfg.get("top_frac", 0.01))
    shape = None
    if wanted("mega_users") or wanted("statistical_patterns"):
        shape = concentration(c.actors(), "n", ["_source"], frac)
    if wanted("mega_users"):
        top = c.actors().withColumn("place", F.row_number().over(Window.partitionBy("_source").orderBy(F.desc("n"), "actor"))).where(F.col("place") <= int(cfg.get("top_n", 10)))
        parts.append(_long(top, "mega_users", {"top_n": F.col("n")}, F.col("actor")))
        parts.append(_long(c.actors().groupBy("_source").agg(F.count("*").alias("users"), F.max("n").alias("largest")), "mega_users", {"n_users": F.col("users"), "largest": F.col("largest")}))
        parts.append(_long(shape, "mega_users", {"top_share": F.col("top_share")}))
    if wanted("statistical_patterns"):
        parts.append(_long(shape, "statistical_patterns", {"gini": F.col("gini"), "top_share": F.col("top_share"), "bottom_half": F.col("bottom_half")}))
    if wanted("cross_agency"):
        there = c.actors()
        parts.append(_long(there.groupBy("_source").agg(F.count("*").alias("a"), F.count_if(F.col("n_external") > 0).alias("e")), "cross_agency", {"n_actors": F.col("a"), "n_external": F.col("e") if c.has("geo") else F.lit(None)}))
        parts.append(_long(there, "cross_agency", {"actor_count": F.col("n")}, F.col("actor")))
        if c.has("geo"):
            parts.append(_long(there.where("n_external > 0"), "cross_agency", {"external_actor": F.col("n_external")}, F.col("actor")))
    if wanted("ai_moderation"):
        night = ratio(F.col("n_hours") - F.col("n_day"), F.col("n_hours"))
        overnight = F.coalesce(night > cfg.get("overnight_threshold", 0.5), F.lit(False))
        marked = c.actors().withColumns({"night": night, "overnight": overnight})
        parts.append(_long(c.df.groupBy("_source").agg(F.lit(0).alias("zero")).join(marked.groupBy("_source").agg(F.count("*").alias("a"), F.count_if("overnight").alias("o")), "_source", "left"), "ai_moderation", {"n_actors": F.coalesce("a", "zero"), "n_overnight_heavy": F.coalesce("o", "zero")}))
        parts.append(_long(marked.where("overnight"), "ai_moderation", {"overnight_heavy_actor": F.col("night")}, F.col("actor")))
        if c.has("ts"):
            sizes = c.df.where(c.ts().isNotNull() & c.col("actor").isNotNull()).groupBy("_source", c.ts().alias("t"), c.col("actor").alias("a")).agg(F.count("*").alias("size")).groupBy("_source", "size").agg(F.count("*").alias("n"))
            parts.append(_long(sizes, "ai_moderation", {"burst_size_distribution": F.col("n")}, F.col("size")))
            burst = c.df.select("_source").distinct().join(sizes.groupBy("_source").agg(F.max("size").alias("n")), "_source", "left")  # null where no time is valid
        else:
            burst = c.df.select("_source").distinct().withColumn("n", F.lit(None).cast("bigint"))
        parts.append(_long(burst, "ai_moderation", {"max_burst": F.col("n")}))
    if skipped:
        reasons = F.array(*[F.struct(F.lit(k).alias("check_name"), F.lit(v).alias("reason")) for k, v in skipped.items()])
        gone = c.df.select("_source").distinct().select(F.col("_source").alias("source_id"), F.explode(reasons).alias("m")).select("source_id", "m.*")
    result = reduce(DataFrame.unionByName, parts)
    partial = F.max(F.col("value").isNull().cast("int")).over(Window.partitionBy("source_id", "check_name"))
    result = result.withColumns({"status": F.when(partial == 1, "partial").otherwise("ok"), "reason": F.when(partial == 1, "a metric is undefined")})
    if skipped:
        result = result.unionByName(gone.withColumn("status", F.lit("skipped")), allowMissingColumns=True)
    return result.select(*_OUT)
