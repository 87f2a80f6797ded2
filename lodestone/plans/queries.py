"""Registered queries: each operator over whole tables, beside the SQL that answers the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.semantics import ratio, stable_id
from lodestone.functions.shared import new_path
from lodestone.operators import derive, documents, entities, evidence, exposure, pages, quality, resolution, rollup, stats
from lodestone.operators.citation import build_anchors
from lodestone.operators.recipe import CHECKS, run_recipe
from lodestone.plans.surface import CANNED, search, token_index
from lodestone.sources.tables import filled_by, load_table, served
from lodestone.streaming.tally import sessions, windowed_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

HOME = "NATION_0"
REASONS = {"short": ("the", "der", "les"), "legal": ("license", "licensed", "copyright"), "spanish": ("los", "las")}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _words(words: tuple[str, ...]) -> str:
    return rf"(^|[^\p{{L}}\p{{N}}_])(?:{'|'.join(words)})([^\p{{L}}\p{{N}}_]|$)"


def audit(spark: SparkSession, d: str) -> DataFrame:
    """Orders as an audit log: actor, home or away, time, reach, record type."""
    o, c, n = (table(spark, d, x) for x in ("orders", "customer", "nation"))
    log = o.join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"])
    return log.select(F.col("o_custkey").alias("actor"), F.col("n_name").alias("nation"), F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("reach"), F.col("o_orderstatus").alias("kind"), F.col("o_orderpriority").alias("reason"), F.col("c_mktsegment").alias("segment"))


_AUDIT = "select o_custkey as actor, n_name as nation, o_orderdate as ts, o_totalprice as reach, o_orderstatus as kind, o_orderpriority as reason, c_mktsegment as segment from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey"

RECIPE = {
    "actor": "actor", "geo": "geo", "ts": "ts", "hour": "hour_et", "nets": "reach", "severity": "kind", "text": "reason", "category": "kind", "case": "case_no", "group": "segment",
    "immigration_keywords": ["urgent"], "pretext_categories": ["F"], "co_travel_keywords": ["low"], "subtype": "segment", "top_n": 10, "heavy": 15, "target_zone": "America/New_York",
}


def _prepared(spark: SparkSession, d: str) -> DataFrame:
    derived = derive.derive_columns(audit(spark, d), {"geo": {"column": "nation", "home": HOME}, "temporal": {"column": "ts"}})
    return derived.withColumn("case_no", F.when(F.col("kind") == "O", "***").when(F.col("kind") == "P", " ").otherwise(F.lit(None)))


def _gini(values: str, by: str = "") -> str:
    """SQL of n, total, gini, top_share and bottom_half of values(x), plainly by row numbers."""
    part = f"partition by {by} " if by else ""
    key = f"{by}, " if by else ""
    group = f"group by {by}" if by else ""
    return f"""with v as ({values}), r as (select {key}cast(x as double) as x, row_number() over ({part}order by x) as i, count(*) over ({part.strip()}) as n from v where x is not null)
    select {key}cast(max(n) as bigint) as n, round(sum(x), 4) as total, round((2 * sum(i * x) - (max(n) + 1) * sum(x)) / (max(n) * sum(x)), 6) as gini,
    round(sum(case when i > n - greatest(1, ceil(n * 0.01)) then x else 0 end) / sum(x), 6) as top_share, round(sum(case when i <= floor(n / 2) then x else 0 end) / sum(x), 6) as bottom_half from r {group}"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({"total": F.round("total", 4)} | {c: F.round(c, 6) for c in ("gini", "top_share", "bottom_half")})


@query(f"""with a as ({_AUDIT}), g as (select count(*) as n_records, sum(case when lower(trim(nation)) <> '{HOME.lower()}' then 1 else 0 end) as away from a),
s as ({_gini('select count(*) as x from (' + _AUDIT + ') group by actor')}) select cast(n_records as bigint) as n_records, n as n_actors, gini, top_share, bottom_half, round(away / cast(n_records as double), 6) as out_of_state_pct from g, s""")
def concentration_of_activity(spark: SparkSession, d: str) -> DataFrame:
    """How concentrated is activity on actors, and how much of it comes from elsewhere?"""
    log = derive.derive_columns(audit(spark, d), {"geo": {"column": "nation", "home": HOME}})
    counts = log.groupBy("actor").agg(F.count("*").alias("n"), F.count_if(F.col("geo") == "OOS").alias("away"))
    shape = _rounded(stats.concentration(counts, "n"))
    return counts.agg(F.sum("n").alias("n_records"), F.sum("away").alias("away")).crossJoin(shape).select("n_records", F.col("n").alias("n_actors"), "gini", "top_share", "bottom_half", F.round(ratio(F.col("away"), F.col("n_records")), 6).alias("out_of_state_pct"))


@query(_gini("select event_type, value as x from events", "event_type"))
def gini_by_type(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(stats.concentration(table(spark, d, "events"), "value", ["event_type"]))


@query("select event_type, round(median(value), 6) as median from events where event_type is not null group by event_type")
def median_by_type(spark: SparkSession, d: str) -> DataFrame:
    return stats.median_by(table(spark, d, "events"), "event_type", "value").select("event_type", F.round("median", 6).alias("median"))


@query("select cast(burst_size as bigint) as burst_size, cast(count(*) as bigint) as n_groups from (select count(*) as burst_size from events where ts is not null and user_id is not null group by date_trunc('second', ts), user_id) group by burst_size")
def burst_histogram(spark: SparkSession, d: str) -> DataFrame:
    return stats.burstiness(table(spark, d, "events"), "ts", "user_id", "second")


@query("select cast(burst_size as bigint) as burst_size, cast(count(*) as bigint) as n_groups from (select count(*) as burst_size from orders where o_orderdate is not null group by o_orderdate) group by burst_size")
def burst_exact(spark: SparkSession, d: str) -> DataFrame:
    return stats.burstiness(table(spark, d, "orders"), "o_orderdate")


@query("""with e as (select user_id, extract(hour from ts) as h from events), g as (select user_id, count(*) as n_records, count(h) as n_hours, sum(case when h >= 8 and h < 18 then 1 else 0 end) as n_day, count(distinct h) as hours_used from e group by user_id)
select user_id, cast(n_records as bigint) as n_records, cast(n_hours as bigint) as n_hours, round(n_day / cast(n_hours as double), 6) as day_pct, round((n_hours - n_day) / cast(n_hours as double), 6) as night_pct, cast(hours_used as bigint) as hours_used, n_records > 60 as is_heavy from g""")
def automation(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("user_id", F.hour("ts").alias("h"))
    out = stats.automation_signature(rows, "user_id", "h", heavy=60)
    return out.withColumns({c: F.round(c, 6) for c in ("day_pct", "night_pct")})


@query("""with e as (select user_id, extract(hour from ts) as h from events where user_id is not null), g as (select user_id, count(h) as n, sum(case when h < 6 or h >= 18 then 1 else 0 end) as night from e group by user_id), s as (select user_id, case when n > 0 then (n - night) / cast(n as double) else 0 end as d, case when n > 0 then night / cast(n as double) else 0 end as o from g)
select user_id, round(d, 6) as daytime_pct, round(o, 6) as overnight_pct, o > 0.5 as overnight_heavy from s""")
def automation_overnight(spark: SparkSession, d: str) -> DataFrame:
    out = stats.overnight_signature(table(spark, d, "events").select("user_id", F.hour("ts").alias("h")), "user_id", "h")
    return out.withColumns({c: F.round(c, 6) for c in ("daytime_pct", "overnight_pct")})


@query(f"""with a as (select segment as source_id, cast(actor as varchar) as k, extract(hour from timezone('America/New_York', timezone('UTC', ts))) as h, ts from ({_AUDIT})), g as (select source_id, k, count(h) as n, sum(case when h < 6 or h >= 18 then 1 else 0 end) as night from a where k is not null group by 1, 2),
b as (select source_id, count(*) as size from a where k is not null and ts is not null group by source_id, ts, k)
select source_id, 'n_actors' as metric, null as "key", cast(count(*) as double) as value from g group by source_id union all select source_id, 'n_overnight_heavy', null, cast(sum(case when night > 0.5 * n then 1 else 0 end) as double) from g group by source_id
union all select source_id, 'overnight_heavy_actor', k, round(night / cast(n as double), 6) from g where night > 0.5 * n union all select source_id, 'burst_size_distribution', cast(size as varchar), cast(count(*) as double) from b group by source_id, size union all select source_id, 'max_burst', null, cast(max(size) as double) from b group by source_id""")
def recipe_overnight(spark: SparkSession, d: str) -> DataFrame:
    return _findings(spark, d, "ai_moderation").where("check_name = 'ai_moderation'").select("source_id", "metric", "key", F.round("value", 6).alias("value"))


@query(f"select case when nation is null or trim(nation) = '' then 'UNK' when lower(trim(nation)) = '{HOME.lower()}' then 'IN' else 'OOS' end as geo, cast(count(*) as bigint) as n from ({_AUDIT}) group by 1")
def derive_geo(spark: SparkSession, d: str) -> DataFrame:
    return derive.derive_columns(audit(spark, d), {"geo": {"column": "nation", "home": HOME}}).groupBy("geo").agg(F.count("*").alias("n"))


@query("select reason_cat, cast(count(*) as bigint) as n from (select case " + " ".join(f"when regexp_matches(lower(text), '{_words(w)}') then '{k}'" for k, w in REASONS.items()) + " else 'Other' end as reason_cat from documents) group by reason_cat")
def derive_reason(spark: SparkSession, d: str) -> DataFrame:
    return derive.derive_columns(table(spark, d, "documents"), {"reason": {"column": "text", "categories": REASONS}}).groupBy("reason_cat").agg(F.count("*").alias("n"))


@query(f"select doc_id from documents where regexp_matches(lower(text), '{_words(('token', 'license', 'secret'))}')")
def keyword_flag(spark: SparkSession, d: str) -> DataFrame:
    flagged = derive.derive_columns(table(spark, d, "documents"), {"immigration": {"column": "text", "keywords": ["token", "license", "secret"], "to": "flag"}})
    return flagged.where("flag").select("doc_id")


@query("select event_id, cast(timezone('America/New_York', timezone('UTC', ts)) as date) as date_et, cast(extract(hour from timezone('America/New_York', timezone('UTC', ts))) as integer) as hour_et, cast(extract(isodow from timezone('America/New_York', timezone('UTC', ts))) - 1 as integer) as dow_et from events")
def derive_local_time(spark: SparkSession, d: str) -> DataFrame:
    return derive.derive_columns(table(spark, d, "events"), {"temporal": {"column": "ts"}}).select("event_id", "date_et", "hour_et", "dow_et")


@query("select event_id, cast(round_even(value, 0) as bigint) as nets from events")
def derive_nets(spark: SparkSession, d: str) -> DataFrame:
    return derive.derive_columns(table(spark, d, "events"), {"nets": {"column": "value"}}).select("event_id", "nets")


@query("select o_orderkey, o_orderstatus = 'O' as has_case, case o_orderstatus when 'O' then 'Open' when 'F' then 'Final' else 'Else' end as base_type from orders")
def derive_case_and_type(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").withColumn("case_no", F.when(F.col("o_orderstatus") == "O", "***").when(F.col("o_orderstatus") == "P", "\t ").otherwise(""))
    cfg = {"has_case": {"column": "case_no"}, "base_type": {"column": "o_orderstatus", "lookup": {"O": "Open", "F": "Final"}, "default": "Else"}}
    return derive.derive_columns(rows, cfg).select("o_orderkey", "has_case", "base_type")


@query("select cast(min(ts) as date) as first_date, cast(max(ts) as date) as last_date, cast(sum(case when ts is null then 1 else 0 end) as bigint) as n_undated, cast(count(*) as bigint) as n_rows, cast(min(ts) as date) > date '2024-01-01' as head_gap, cast(max(ts) as date) < date '2024-12-31' as tail_gap from events")
def quality_date_window(spark: SparkSession, d: str) -> DataFrame:
    from datetime import date

    return quality.date_window(table(spark, d, "events"), "ts", date(2024, 1, 1), date(2024, 12, 31))


def _odd(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", F.lit(None).cast("string").alias("nothing"), F.lit("  ").alias("blanks"), F.when(F.col("o_orderkey") % 20 == 0, "x").alias("seldom"), F.when(F.col("o_orderkey") % 10 == 0, "n/a").otherwise(F.col("o_totalprice").cast("string")).alias("mostly"))


@query("""with o as (select o_orderkey, case when o_orderkey % 20 = 0 then 'x' end as seldom, o_orderkey % 10 = 0 as bad from orders), s as (select avg(case when seldom is null then 1.0 else 0.0 end) as null_share, avg(case when bad then 0.0 else 1.0 end) as number_share from o)
select 'nothing' as "column", 'all_null' as anomaly, 1.0::double as share union all select 'blanks', 'all_blank', 1.0::double union all select 'seldom', 'high_null', round(null_share, 6) from s where null_share > 0.9 union all select 'mostly', 'type_coercion_mismatch', round(number_share, 6) from s where number_share > 0.8 and number_share < 1""")
def quality_anomalies(spark: SparkSession, d: str) -> DataFrame:
    return quality.anomalies(_odd(spark, d)).withColumn("share", F.round("share", 6))


def _findings(spark: SparkSession, d: str, *checks: str) -> DataFrame:
    return run_recipe(_prepared(spark, d), RECIPE, "segment", checks or CHECKS)


@query(f"""with a as ({_AUDIT}), s as (select segment as source_id, count(*) as n, sum(case when nation <> '{HOME}' then 1 else 0 end) as o, sum(case when nation = '{HOME}' then 1 else 0 end) as i, sum(case when kind = 'F' then 1 else 0 end) as p, sum(case when kind = 'O' then 1 else 0 end) as c, count(reach) as obs, median(round_even(reach, 0)) as med, max(round_even(reach, 0)) as mx, sum(round_even(reach, 0)) as tot, count(distinct actor) as users from a group by segment)
select source_id, check_name, metric, round(value, 4) as value from (
select source_id, 'truncation' as check_name, 'rows' as metric, cast(n as double) as value from s union all
select source_id, 'out_of_state', 'n_out', o from s union all select source_id, 'out_of_state', 'pct', o / cast(n as double) from s union all select source_id, 'out_of_state', 'pct_known', o / cast(o + i as double) from s union all
select source_id, 'pretext', 'n', p from s union all select source_id, 'accountability', 'with_case', c from s union all select source_id, 'accountability', 'no_case_pct', (n - c) / cast(n as double) from s union all
select source_id, 'blast_radius', 'n_obs', obs from s union all select source_id, 'blast_radius', 'median', med from s union all select source_id, 'blast_radius', 'max', mx from s union all select source_id, 'blast_radius', 'total', tot from s union all
select source_id, 'mega_users', 'n_users', users from s)""")
def recipe_scalars(spark: SparkSession, d: str) -> DataFrame:
    wanted = "check_name || '.' || metric in ('truncation.rows', 'out_of_state.n_out', 'out_of_state.pct', 'out_of_state.pct_known', 'pretext.n', 'accountability.with_case', 'accountability.no_case_pct', 'blast_radius.n_obs', 'blast_radius.median', 'blast_radius.max', 'blast_radius.total', 'mega_users.n_users')"
    return _findings(spark, d, "truncation", "out_of_state", "pretext", "accountability", "blast_radius", "mega_users").where(wanted).select("source_id", "check_name", "metric", F.round("value", 4).alias("value"))


@query(f"""with c as (select segment as source_id, cast(actor as varchar) as k, count(*) as n from ({_AUDIT}) group by 1, 2), r as (select *, row_number() over (partition by source_id order by n desc, k) as i from c) select source_id, k as "key", cast(n as double) as value from r where i <= 10""")
def recipe_top_actors(spark: SparkSession, d: str) -> DataFrame:
    return _findings(spark, d, "mega_users").where("check_name = 'mega_users' and metric = 'top_n'").select("source_id", "key", "value")


@query(f"""with c as (select segment as source_id, actor, count(*) as x from ({_AUDIT}) group by 1, 2), g as ({_gini('select * from c', 'source_id')}) select source_id, 'gini' as metric, gini as value from g union all select source_id, 'top_share', top_share from g union all select source_id, 'bottom_half', bottom_half from g""".replace("with v as", "with v as"))
def recipe_concentration(spark: SparkSession, d: str) -> DataFrame:
    return _findings(spark, d, "statistical_patterns").where("check_name = 'statistical_patterns'").select("source_id", "metric", F.round("value", 6).alias("value"))


@query(f"""with a as (select segment as source_id, cast(timezone('America/New_York', timezone('UTC', ts)) as date) as day from ({_AUDIT})), s as (select source_id, min(day) as lo, max(day) as hi, count(distinct day) as active, count(*) as n from a group by source_id)
select source_id, 'span_days' as metric, cast(date_diff('day', lo, hi) as double) as value from s union all select source_id, 'active_days', active from s union all select source_id, 'records_per_active_day', round(n / cast(active as double), 6) from s""")
def recipe_operations(spark: SparkSession, d: str) -> DataFrame:
    return _findings(spark, d, "operations").where("check_name = 'operations' and metric in ('span_days', 'active_days', 'records_per_active_day')").select("source_id", "metric", F.round("value", 6).alias("value"))


@query(f"""with c as (select segment as source_id, cast(actor as varchar) as k, sum(case when nation <> '{HOME}' then 1 else 0 end) as e from ({_AUDIT}) group by 1, 2) select source_id, k as "key", cast(e as double) as value from c where e > 0""")
def recipe_external_actors(spark: SparkSession, d: str) -> DataFrame:
    return _findings(spark, d, "cross_agency").where("check_name = 'cross_agency' and metric = 'external_actor'").select("source_id", "key", "value")


def _recipe_sql() -> str:
    one = {
        "truncation": {"rows": "n", "truncated": "cast(n = 1048575 as integer)"},
        "out_of_state": {"n_in": "i", "n_out": "o", "n_unknown": "u", "pct": "o / cast(n as double)", "pct_known": "o / cast(o + i as double)"},
        "immigration": {"n": "urgent", "pct": "urgent / cast(n as double)"}, "pretext": {"n": "p", "pct": "p / cast(n as double)"}, "co_travel": {"n": "low", "pct": "low / cast(n as double)"},
        "pii": {"n_records": "0", "pct": "0", "n_alien_num": "0", "n_ssn": "0", "n_phone": "0", "n_email": "0"},
        "accountability": {"with_case": "c", "no_case_pct": "(n - c) / cast(n as double)"},
        "blast_radius": {"n_obs": "obs", "median": "med", "max": "mx", "total": "tot"},
        "operations": {"first_day": "date_diff('day', date '1970-01-01', lo)", "last_day": "date_diff('day', date '1970-01-01', hi)", "span_days": "date_diff('day', lo, hi)", "active_days": "active", "records_per_active_day": "n / cast(active as double)", "n_undated": "undated", "n_users": "users"},
        "mega_users": {"n_users": "users", "largest": "largest", "top_share": "top_share"},
        "statistical_patterns": {"gini": "gini", "top_share": "top_share", "bottom_half": "bottom_half"},
        "cross_agency": {"n_actors": "users", "n_external": "external"},
        "ai_moderation": {"n_actors": "users", "n_overnight_heavy": "overnight", "max_burst": "burst"},
    }
    rows = [f"select source_id, '{check}' as check_name, '{m}' as metric, null as k, cast({v} as double) as value from s" for check, metrics in one.items() for m, v in metrics.items()]
    keyed = {
        ("immigration", "n_by_subtype"): "select source_id, segment as k, count(*) as v from a where reason = '1-URGENT' group by 1, 2",
        ("accountability", "no_case_pct_by_group"): "select source_id, segment as k, avg(case when kind = 'O' then 0.0 else 1.0 end) as v from a group by 1, 2",
        ("blast_radius", "median_by_severity"): "select source_id, kind as k, median(round_even(reach, 0)) as v from a group by 1, 2",
        ("operations", "busiest_day"): "select source_id, cast(k as varchar) as k, v from (select source_id, day as k, count(*) as v, row_number() over (partition by source_id order by count(*) desc, day) as i from a group by source_id, day) where i = 1",
        ("operations", "busiest_hour"): "select source_id, cast(k as varchar) as k, v from (select source_id, h as k, count(*) as v, row_number() over (partition by source_id order by count(*) desc, h) as i from a group by source_id, h) where i = 1",
        ("mega_users", "top_n"): "select source_id, k, n as v from (select *, row_number() over (partition by source_id order by n desc, k) as i from actors) where i <= 10",
        ("cross_agency", "actor_count"): "select source_id, k, n as v from actors", ("cross_agency", "external_actor"): "select source_id, k, away as v from actors where away > 0",
        ("ai_moderation", "overnight_heavy_actor"): "select source_id, k, night / cast(hours as double) as v from actors where night > 0.5 * hours",
        ("ai_moderation", "burst_size_distribution"): "select source_id, cast(size as varchar) as k, count(*) as v from bursts group by source_id, size",
    }
    rows += [f"select source_id, '{check}', '{m}', k, cast(v as double) from ({q})" for (check, m), q in keyed.items()]
    return f"""with a as (select segment as source_id, *, cast(timezone('America/New_York', timezone('UTC', ts)) as date) as day, extract(hour from timezone('America/New_York', timezone('UTC', ts))) as h from ({_AUDIT})),
    actors as (select source_id, cast(actor as varchar) as k, count(*) as n, sum(case when nation <> '{HOME}' then 1 else 0 end) as away, count(h) as hours, sum(case when h < 6 or h >= 18 then 1 else 0 end) as night from a group by 1, 2),
    bursts as (select source_id, count(*) as size from a group by source_id, ts, actor), g as ({_gini('select source_id, n as x from actors', 'source_id')}),
    s as (select a.source_id, count(*) as n, sum(case when nation <> '{HOME}' then 1 else 0 end) as o, sum(case when nation = '{HOME}' then 1 else 0 end) as i, 0 as u, sum(case when reason = '1-URGENT' then 1 else 0 end) as urgent, sum(case when reason = '5-LOW' then 1 else 0 end) as low, sum(case when kind = 'F' then 1 else 0 end) as p, sum(case when kind = 'O' then 1 else 0 end) as c,
      count(reach) as obs, median(round_even(reach, 0)) as med, max(round_even(reach, 0)) as mx, sum(round_even(reach, 0)) as tot, min(day) as lo, max(day) as hi, count(distinct day) as active, sum(case when ts is null then 1 else 0 end) as undated, count(distinct actor) as users,
      (select max(n) from actors x where x.source_id = a.source_id) as largest, (select sum(case when away > 0 then 1 else 0 end) from actors x where x.source_id = a.source_id) as external, (select sum(case when night > 0.5 * hours then 1 else 0 end) from actors x where x.source_id = a.source_id) as overnight, (select max(size) from bursts x where x.source_id = a.source_id) as burst,
      any_value(gini) as gini, any_value(top_share) as top_share, any_value(bottom_half) as bottom_half from a join g on g.source_id = a.source_id group by a.source_id)
    select source_id, check_name, 'ok' as status, null::varchar as reason, metric, k as "key", round(value, 4) as value from ({' union all '.join(rows)})"""


@query(_recipe_sql())
def recipe_all(spark: SparkSession, d: str) -> DataFrame:
    """All thirteen checks of each segment."""
    return _findings(spark, d).withColumn("value", F.round("value", 4))


def _by_priority(spark: SparkSession, d: str, *checks: str) -> DataFrame:
    return run_recipe(_prepared(spark, d), RECIPE, "reason", checks)


@query(f"""with c as (select reason as s, cast(actor as varchar) as k, count(*) as n from ({_AUDIT}) where nation <> '{HOME}' group by 1, 2) select k as actor, cast(count(*) as bigint) as n_sources, cast(sum(n) as bigint) as total from c group by k having count(*) >= 2""")
def rollup_recurring(spark: SparkSession, d: str) -> DataFrame:
    return rollup.recurring_actors(_by_priority(spark, d, "cross_agency")).select("actor", "n_sources", "total")


@query(f"""with s as (select reason, count(*) as n, sum(case when nation <> '{HOME}' then 1 else 0 end) as o, sum(case when kind = 'F' then 1 else 0 end) as p from ({_AUDIT}) group by reason) select 'out_of_state' as check_name, cast(count(*) as bigint) as n_sources, round(sum(o) / cast(sum(n) as double), 6) as pooled_pct, round(avg(o / cast(n as double)), 6) as unweighted_mean_pct from s union all select 'pretext', cast(count(*) as bigint), round(sum(p) / cast(sum(n) as double), 6), round(avg(p / cast(n as double)), 6) from s""")
def rollup_pooled(spark: SparkSession, d: str) -> DataFrame:
    out = rollup.pooled(_by_priority(spark, d, "truncation", "out_of_state", "pretext"))
    return out.select("check_name", "n_sources", F.round("pooled_pct", 6).alias("pooled_pct"), F.round("unweighted_mean_pct", 6).alias("unweighted_mean_pct"))


@query(f"""with a as ({_AUDIT}), s as (select reason, sum(case when nation <> '{HOME}' then 1 else 0 end) / cast(count(*) as double) as pct from a group by reason), c as (select reason, cast(actor as varchar) as k, count(*) as n from a where nation <> '{HOME}' group by 1, 2),
g as ({_gini('select reason, count(*) as x from (' + _AUDIT + ') group by reason, actor', 'reason')}), r as (select k, count(*) as n_sources, sum(n) as total from c group by k having count(*) >= 2 order by n_sources desc, total desc, k limit 1)
select 'mostly_out_of_state' as thesis, cast(count(*) as bigint) as n_sources, arg_max(reason, (pct, reason)) as detail from s where pct >= 0.5 having count(*) > 0 union all select 'few_actors_do_most', cast(count(*) as bigint), arg_max(reason, (gini, reason)) from g where gini >= 0.7 having count(*) > 0 union all select 'leading_recurring_actor', cast(n_sources as bigint), k from r""")
def rollup_theses(spark: SparkSession, d: str) -> DataFrame:
    return rollup.theses(_by_priority(spark, d, "out_of_state", "statistical_patterns", "cross_agency"))


@query(r"""with t as (select text, count(*) as n from (select regexp_replace(text, '^\s+|\s+$', '', 'g') as text from documents) where text <> '' group by text), f as (select n, regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}') as email, regexp_matches(text, '(^|[^0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}([^0-9-]|$)') as ssn from t)
select 'email' as category, cast(coalesce(sum(case when email then n end), 0) as bigint) as weighted, cast(sum(case when email then 1 else 0 end) as bigint) as distinct_texts from f union all select 'ssn', cast(coalesce(sum(case when ssn then n end), 0) as bigint), cast(sum(case when ssn then 1 else 0 end) as bigint) from f union all select 'nonblank', cast(sum(n) as bigint), cast(count(*) as bigint) from f""")
def pii_sweep(spark: SparkSession, d: str) -> DataFrame:
    return exposure.sweep(table(spark, d, "documents"), "text").where("category in ('email', 'ssn', 'nonblank')")


def _pii_patterns() -> dict[str, str]:
    """The nine patterns for RE2, which has no lookaround: a word's ends are the characters beside it."""
    a, z, d, s = r"(^|[^\p{L}\p{N}_])", r"([^\p{L}\p{N}_]|$)", r"\p{Nd}", r"\s\x0b\x1c-\x1f\x85\p{Z}"
    w = r"\p{L}\p{N}_"
    letters = [rf"[A-Z]{{{k}}}[0-9][A-Z0-9]{{{5 - k},}}" for k in range(5)]
    of = {
        "phone": rf"{a}{d}{{3}}[-.{s}]{d}{{3}}[-.{s}]{d}{{4}}{z}|\({d}{{3}}\)[-.{s}]?{d}{{3}}[-.{s}]?{d}{{4}}{z}",
        "ssn": rf"{a}{d}{{3}}-{d}{{2}}-{d}{{4}}{z}",
        "email": rf"[{w}][.+-]*@[{w}-]+\.[.-]*[{w}]",
        "dob_kw": rf"{a}[Dd]\.?[Oo]\.?[Bb]{z}",
        "alien_num": rf"{a}A#?[{s}-]?{d}{{3}}[{s}-]?{d}{{3}}[{s}-]?{d}{{2,3}}{z}",
        "driver_lic": rf"{a}(?:OLN|DLN|DL|OL)[{s}]?#?[{s}]?(?:{'|'.join(letters)}|[A-Z]{{5,}}[0-9][A-Z0-9]*){z}",
        "race_sex": rf"{a}[BWHAI][{s}]?/[{s}]?[MF]{z}",
        "possible_birthdate": rf"{a}(?:0?[1-9]|1[0-2])[/-](?:0?[1-9]|[12]{d}|3[01])[/-](?:19|20){d}{d}{z}",
        "phone_compact": rf"{a}{d}{{10}}{z}",
    }
    return of


_WEAK = ("race_sex", "possible_birthdate", "phone_compact")


def _pii_sql() -> str:
    """The sweep of all nine patterns as SQL."""
    of, weak = _pii_patterns(), _WEAK
    any_of = {"strict": " or ".join(k for k in of if k not in weak), "broad": " or ".join(of), "nonblank": "true"}
    each = " union all ".join(f"select '{k}' as category, cast(coalesce(sum(case when {v} then n end), 0) as bigint) as weighted, cast(count(case when {v} then 1 end) as bigint) as distinct_texts from f" for k, v in ({k: k for k in of} | any_of).items())
    matched = ", ".join(f"regexp_matches(text, '{p}') as {k}" for k, p in of.items())
    return rf"with t as (select text, count(*) as n from (select regexp_replace(text, '^\s+|\s+$', '', 'g') as text from documents) where text <> '' group by text), f as (select n, {matched} from t) {each}"


@query(_pii_sql())
def pii_sweep_all(spark: SparkSession, d: str) -> DataFrame:
    return exposure.sweep(table(spark, d, "documents"), "text")


@query("select source, cast(count(*) as bigint) as n_exposed from documents where " + " or ".join(f"regexp_matches(text, '{p}')" for k, p in _pii_patterns().items() if k not in _WEAK) + " group by source")
def pii_exposed_sources(spark: SparkSession, d: str) -> DataFrame:
    return exposure.exposed_groups(table(spark, d, "documents"), "text", "source")


@query(r"select doc_id, substr(sha256(regexp_replace(text, '^\s+|\s+$', '', 'g')), 1, 16) as text_id from documents")
def text_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", exposure.text_id(F.col("text")).alias("text_id"))


@query()
def redacted_texts(spark: SparkSession, d: str) -> DataFrame:
    return exposure.redact(table(spark, d, "documents"), "text").select("doc_id", "text")


_SPACE = r"\s\x0b\x1c-\x1f\x85\p{Z}"
_DIAGNOSED = rf"""with k as (select doc_id, source, regexp_extract_all(t, '[A-Za-z]+') as w, length(regexp_replace(t, '^[{_SPACE}]+|[{_SPACE}]+$', '', 'g')) as n_chars, length(regexp_replace(t, '[{_SPACE}]', '', 'g')) as solid, length(regexp_replace(t, '[^A-Za-z]', '', 'g')) as letters, coalesce(list_max(list_transform(regexp_extract_all(t, '[^A-Za-z{_SPACE}]+'), lambda r: length(r))), 0) as run from (select doc_id, source, coalesce(text, '') as t from documents)),
h as (select *, case when len(w) > 0 then len(list_filter(w, lambda x: lower(x) in ({', '.join(f"'{x}'" for x in pages.COMMON)}))) / cast(len(w) as double) end as hit, solid > 0 and letters / cast(solid as double) >= 0.05 and run <= 8 as dense from k),
g as (select doc_id, source, hit, dense, case when n_chars < 12 and len(w) = 0 then 'image_only' when len(w) < 4 then 'uncertain_review' when hit < 0.2 and not dense then 'garbled_text' else 'native_ok' end as diagnosis from h)"""


@query(_DIAGNOSED + " select doc_id, diagnosis, round(hit, 6) as hit_rate, dense from g")
def page_diagnoses(spark: SparkSession, d: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return table(spark, d, "documents").select("doc_id", pages.diagnosis(F.col("text")).alias("diagnosis"), F.round(pages.hit_rate(text), 6).alias("hit_rate"), pages.density_ok(text).alias("dense"))


@query(_DIAGNOSED + """, c as (select source, count(*) as n, sum(case when diagnosis = 'uncertain_review' then 1 else 0 end) as u, sum(case when diagnosis = 'garbled_text' then 1 else 0 end) as b, sum(case when diagnosis = 'image_only' then 1 else 0 end) as i from g group by source)
select source, cast(n as bigint) as n_pages, case when 2 * u >= n then 'review' when 2 * b >= n or (b > 0 and 2 * (i + b) >= n) then 'force_full_doc_ocr' when 2 * i >= n then 'ocr_images' else 'native' end as decision from c""")
def page_gate(spark: SparkSession, d: str) -> DataFrame:
    diagnosed = table(spark, d, "documents").select("doc_id", "source", pages.diagnosis(F.col("text")).alias("diagnosis"))
    return pages.decide(diagnosed, "source")


@query("""with p as (select event_id, user_id % 50 as doc, case event_id % 4 when 0 then 'native_ok' when 1 then 'image_only' when 2 then 'native_ok' else case when event_id % 3 = 0 then 'garbled_text' else 'uncertain_review' end end as diag, event_id % 5 < 2 as ocr, case when event_id % 7 = 0 then null else (event_id % 100) / 100.0 end as score, event_id % 97 = 0 as partial from events)
select event_id, case when partial then 'partial conversion' when diag = 'garbled_text' then 'garbled text layer' when diag = 'uncertain_review' then 'uncertain: too little signal to trust the text layer' when diag = 'image_only' and not ocr then 'image-only page not OCR''d' when ocr and score < 0.85 then 'low OCR confidence (' || printf('%.2f', score) || ')' end as flag_reason from p""")
def page_flags(spark: SparkSession, d: str) -> DataFrame:
    """Events as converted pages."""
    k = F.col("event_id")
    rows = table(spark, d, "events").select("event_id", F.when(k % 4 == 1, "image_only").when((k % 4 == 3) & (k % 3 == 0), "garbled_text").when(k % 4 == 3, "uncertain_review").otherwise("native_ok").alias("diag"), (k % 5 < 2).alias("ocr"), F.when(k % 7 == 0, float("nan")).otherwise((k % 100) / 100).alias("score"), (k % 97 == 0).alias("partial"))
    return rows.select("event_id", documents.flag_reason(F.col("diag"), F.col("ocr"), F.col("score"), partial=F.col("partial")).alias("flag_reason"))


@query(r"select doc_id, cast(len(regexp_extract_all(lower(text), '[a-z]+')) as integer) as n_tokens from documents")
def page_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.size(pages.tokens(F.col("text"))).alias("n_tokens"))


@query(r"select doc_id, stamp from (select doc_id, unnest(regexp_extract_all(text, '\b[A-Z][A-Z0-9]{1,}[-_ ]?[0-9]{3,}\b')) as stamp from documents)")
def bates_stamps(spark: SparkSession, d: str) -> DataFrame:
    return pages.bates(table(spark, d, "documents"), "text", "doc_id").select("doc_id", "stamp")


@query(r"select c_custkey, stamp from (select c_custkey, unnest(regexp_extract_all('See ' || c_mktsegment || '-' || lpad(cast(c_custkey as varchar), 6, '0') || ', X1 and Ab-123; ' || c_mktsegment || c_custkey, '\b[A-Z][A-Z0-9]{1,}[-_ ]?[0-9]{3,}\b')) as stamp from customer)")
def bates_of_customers(spark: SparkSession, d: str) -> DataFrame:
    """Stamps of a made-up page for each customer."""
    key = F.col("c_custkey").cast("string")
    text = F.concat(F.lit("See "), "c_mktsegment", F.lit("-"), F.lpad(key, 6, "0"), F.lit(", X1 and Ab-123; "), "c_mktsegment", key)
    return pages.bates(table(spark, d, "customer").select("c_custkey", text.alias("text")), "text", "c_custkey").select("c_custkey", "stamp")


@query("select c_custkey, substr(sha256('ns|' || c_custkey || '|' || c_name), 1, 40) as node_id from customer")
def stable_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", stable_id("ns", F.col("c_custkey"), F.col("c_name")).alias("node_id"))


@query(r"""with recursive t as (select doc_id, text, length(text) as n from documents where regexp_matches(text, '[^\s\x0b\x1c-\x1f\x85\p{Z}]')),
w as (select doc_id, text, n, 0 as nth, 0 as a, case when n <= 1400 then n else (case when m > 0 then 1199 + m else 1400 end) end as b from (select *, length(regexp_replace(substr(text, 1200, 201), '[^ \n\t\r]*$', '')) as m from t)
union all select doc_id, text, n, nth + 1, s, case when s + 1400 >= n then n when m > 0 then lo - 1 + m else s + 1400 end from (select *, greatest(s + 1, s + 1200) as lo, length(regexp_replace(substr(text, greatest(s + 1, s + 1200), s + 1400 - greatest(s + 1, s + 1200) + 1), '[^ \n\t\r]*$', '')) as m from (select doc_id, text, n, nth, greatest(a + 1, b - 200) as s from w where b < n)))
select doc_id, nth, cast(a as integer) as start, cast(b as integer) as "end" from w""")
def text_windows(spark: SparkSession, d: str) -> DataFrame:
    return entities.windows(table(spark, d, "documents"), "text", "doc_id")


@query(r"""with c as (select distinct doc_id, unnest(string_split_regex(text, '[.!?]+')) as quote from documents), j as (select c.doc_id, quote, text, strpos(text, quote) as p from c join documents using (doc_id)),
e as (select *, case when regexp_replace(quote, '^[\s\x0b\x1c-\x1f\x85\p{Z}]+|[\s\x0b\x1c-\x1f\x85\p{Z}]+$', '', 'g') = '' then 'blank_quote' when p = 0 then 'not_found' when strpos(substr(text, p + 1), quote) > 0 then 'ambiguous'
 when (p > 1 and regexp_matches(substr(text, p - 1, 1), '[\p{L}\p{N}]') and regexp_matches(substr(quote, 1, 1), '[\p{L}\p{N}]')) or (p - 1 + length(quote) < length(text) and regexp_matches(substr(text, p + length(quote), 1), '[\p{L}\p{N}]') and regexp_matches(substr(quote, length(quote), 1), '[\p{L}\p{N}]')) then 'cuts_a_word' end as error from j)
select doc_id, quote, case when error is null then cast(p - 1 as integer) end as char_start, case when error is null then cast(p - 1 + length(quote) as integer) end as char_end, case when error is null then substr(text, greatest(1, p - 32), least(p - 1, 32)) end as prefix, case when error is null then substr(text, p + length(quote), 32) end as suffix, case when error is null then sha256(quote) end as text_hash, error from e""")
def citation_anchors(spark: SparkSession, d: str) -> DataFrame:
    """Every sentence of every document as a quote."""
    docs = table(spark, d, "documents")
    claims = docs.select("doc_id", F.explode(F.split("text", "[.!?]+", -1)).alias("quote")).distinct()
    found = build_anchors(claims, docs, ["doc_id"])
    return found.select("doc_id", "quote", "anchor.char_start", "anchor.char_end", "anchor.prefix", "anchor.suffix", "anchor.text_hash", "anchor.error")


@query("""select 'c' || c_custkey as id, m as root from customer join (select c_nationkey as k, min('c' || c_custkey) as m from customer group by 1) on k = c_nationkey where c_nationkey in (select s_nationkey from supplier)
union all select 's' || s_suppkey, m from supplier join (select c_nationkey as k, min('c' || c_custkey) as m from customer group by 1) on k = s_nationkey""")
def entity_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Customers and suppliers of one number and nation as the same: clusters by their edges."""
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("n"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("left_id"))
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("n"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("right_id"))
    return resolution.clusters(resolution.connected_by(c, s, "n"))


@query("""with recursive e as (select 'n' || n_nationkey as a, 'r' || n_regionkey as b from nation), g as (select b, min(a) as m from e group by b), l as (select a as id, m as root from e join g using (b) union select b, m from g) select id, root from l""")
def nation_clusters(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    return resolution.clusters(n.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("left_id"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("right_id")))


@query("select score_band, cast(count(*) as bigint) as n from (select case when v >= 0.98 then 'auto' when v >= 0.7 then 'review' else 'distinct' end as score_band from (select l_discount * 10 as v from lineitem)) group by score_band")
def resolution_bands(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(resolution.bucket(F.col("l_discount") * 10).alias("score_band")).groupBy("score_band").agg(F.count("*").alias("n"))


@query("select e.edge_id, e.head_id, e.tail_id from (select o_orderkey as edge_id, o_custkey as head_id, o_custkey % 100 as tail_id from orders) e where e.head_id in (select c_custkey from customer where c_acctbal > 0) and e.tail_id in (select c_custkey from customer where c_acctbal > 0)")
def graph_closure(spark: SparkSession, d: str) -> DataFrame:
    kept = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("node_id"))
    all_edges = table(spark, d, "orders").select(F.col("o_orderkey").alias("edge_id"), F.col("o_custkey").alias("head_id"), (F.col("o_custkey") % 100).alias("tail_id"))
    return entities.closure(kept, all_edges)[0]


_KEY = r"trim(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


@query(rf"""with c as (select cast(c_custkey as varchar) as id, {_KEY.format('c_name')} as k from customer), s as (select cast(s_suppkey as varchar) as id, {_KEY.format("regexp_replace(s_name, '(?i)supplier', 'Customer')")} as k from supplier),
m as (select c.id as query_id, s.id as entity_id, c.k as a, s.k as b, array_to_string(list_sort(string_split(c.k, ' ')), ' ') as x, array_to_string(list_sort(string_split(s.k, ' ')), ' ') as y from c join s on string_split(c.k, ' ')[1] = string_split(s.k, ' ')[1] or string_split(c.k, ' ')[-1] = string_split(s.k, ' ')[-1]),
g as (select query_id, entity_id, round(greatest(1 - levenshtein(a, b) / cast(greatest(length(a), length(b)) as double), 1 - levenshtein(x, y) / cast(greatest(length(x), length(y)) as double)), 6) as score from m)
select query_id, entity_id, score, 'suppliers' as dataset from (select *, row_number() over (partition by query_id order by score desc, entity_id) as i from g where score >= 0.7) where i <= 25""")
def name_matches(spark: SparkSession, d: str) -> DataFrame:
    """Customers' names against suppliers'. The last words are numbers, whose sound is the number itself."""
    c = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("id"), F.regexp_replace("s_name", "(?i)supplier", "Customer").alias("name"), F.lit("suppliers").alias("dataset"))
    return resolution.cross_reference(c, s)


_ENTRY = """sha256('{{"actor":"' || a || '","artifact_sha256":"' || sha256(cast(k as varchar)) || '","event":"' || e || '","prev_entry_sha256":"' || {prev} || '","seq":' || seq || ',"time":"t' || k || '"}}')"""


@query(f"""with recursive o as (select o_custkey as c, row_number() over (partition by o_custkey order by o_orderkey) - 1 as seq, o_orderkey as k, o_orderstatus as e, o_orderpriority as a from orders),
r as (select c, seq, {_ENTRY.format(prev="repeat('0', 64)")} as sha from o where seq = 0 union all select o.c, o.seq, {_ENTRY.format(prev="sha").replace("|| seq ||", "|| o.seq ||")} from r join o on o.c = r.c and o.seq = r.seq + 1)
select c as custkey, true as valid, cast(count(*) as bigint) as n_entries, arg_max(sha, seq) as last_entry from r group by c""")
def custody_chain(spark: SparkSession, d: str) -> DataFrame:
    """Each customer's orders as a custody log: linked, verified, and the digest that it ends with."""
    o = table(spark, d, "orders")
    events = o.select(F.col("o_custkey").alias("custkey"), "o_orderkey", F.concat(F.lit("t"), F.col("o_orderkey").cast("string")).alias("time"), F.col("o_orderstatus").alias("event"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("artifact_sha256"), F.col("o_orderpriority").alias("actor"))
    log = evidence.chains(events, "custkey", "o_orderkey")
    last = F.max_by("entry_sha256", "seq").alias("last_entry")
    return evidence.verify(log, "custkey", [last]).select("custkey", "valid", "n_entries", "last_entry")


@query("select id, cast(count(*) as bigint) as degree from (select 'c' || o_custkey as id from orders union all select 'p' || o_orderpriority from orders) group by id order by degree desc, id limit 20")
def degree_top(spark: SparkSession, d: str) -> DataFrame:
    """The twenty best connected of customers and priorities."""
    edges = table(spark, d, "orders").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("head"), F.concat(F.lit("p"), F.col("o_orderpriority")).alias("tail"))
    return resolution.degrees(edges, 20)


_NODES = "select 'n' || n_nationkey as id, 'Place' as schema, n_name as name, n_regionkey as r from nation"


@query(f"""with n as ({_NODES}), m as (select r, list_sort(list(id)) as member_ids from n group by r), k as (select r, member_ids, substr(sha256(array_to_string(member_ids, '|')), 1, 40) as canonical_id from m)
select canonical_id, (select arg_min(name, id) from n where n.r = k.r) as caption, (select arg_min(schema, id) from n where n.r = k.r) as schema, array_to_string(member_ids, ';') as members, (select string_agg(name, ';' order by id) from n where n.r = k.r) as names from k""")
def resolved_entities(spark: SparkSession, d: str) -> DataFrame:
    """Nations of a region as one entity, with the property of all their names."""
    n = table(spark, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), F.lit("Place").alias("schema"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("r"))
    first = n.groupBy("r").agg(F.min("id").alias("right_id"))
    entities_ = n.select("id", "schema", "name", F.lit(None).cast("array<string>").alias("aliases"), F.create_map(F.lit("name"), F.array("name")).alias("properties"))
    spark_ = n.sparkSession
    none = spark_.createDataFrame([], "edge_id string, schema string, head_id string, tail_id string, role string")
    out, _, _ = resolution.snapshot(entities_, none, spark_.createDataFrame([], "statement_id string, target_id string"), n.join(first, "r").select(F.col("id").alias("left_id"), "right_id"))
    return out.select("canonical_id", "caption", "schema", F.array_join("member_ids", ";").alias("members"), F.array_join(F.col("properties")["name"], ";").alias("names"))


@query("select o_orderkey, lpad(cast(o_orderkey as varchar), 12, '0') as case_number, o_totalprice as amount, o_orderstatus as note from orders")
def csv_load(spark: SparkSession, d: str) -> DataFrame:
    """The orders as a CSV file with junk lines before its header, read again: identifiers stay strings with their zeros."""
    rows = table(spark, d, "orders").select("o_orderkey", F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("case_number"), F.col("o_totalprice").alias("amount"), F.concat(F.lit("a, \"b\"\n"), F.col("o_orderstatus")).alias("note"))
    path = new_path(spark, "orders-csv")
    header = spark.range(1).select(F.lit("junk, before\nmore \"junk\no_orderkey,case_number,amount,note").alias("value"))
    quoted = F.concat(F.lit('"'), F.replace(F.col("note"), F.lit('"'), F.lit('""')), F.lit('"'))
    lines = rows.select(F.concat_ws(",", F.col("o_orderkey").cast("string"), "case_number", F.col("amount").cast("string"), quoted).alias("value"))
    header.unionByName(lines).coalesce(1).write.option("compression", "none").text(path)  # one file, as exports are
    name = spark.read.format("binaryFile").load(f"{path}/part-*").select("path").first()[0]
    df, _ = load_table(spark, name, skip_lines=2)
    return df.select("o_orderkey", "case_number", "amount", F.replace(F.col("note"), F.lit('a, "b"\n'), F.lit("")).alias("note"))


@query("select event_id, last_value(case when event_id % 7 = 0 then event_type end ignore nulls) over (order by event_id rows between unbounded preceding and current row) as label from events")
def forward_fill(spark: SparkSession, d: str) -> DataFrame:
    """Labels that stand in every seventh row alone, carried on in order over ranges of rows."""
    rows = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 7 == 0, F.col("event_type")).alias("label"))
    return filled_by(rows, ["label"], "event_id")


_RECORDS = f"""select case when lower(trim(nation)) = '{HOME.lower()}' then 'IN' else 'OOS' end as geo, case when reason in ('1-URGENT', '2-HIGH') then 'hot' else 'Other' end as reason_cat, reason = '1-URGENT' as is_immigration, cast(round_even(reach, 0) as bigint) as nets, kind = 'O' as has_case, case kind when 'O' then 'Open' when 'F' then 'Final' else 'Else' end as base_type,
 cast(extract(hour from timezone('America/New_York', timezone('UTC', ts))) as integer) as hour_et, cast(extract(isodow from timezone('America/New_York', timezone('UTC', ts))) - 1 as integer) as dow_et from ({_AUDIT})"""


def _records(spark: SparkSession, d: str, name: str) -> DataFrame:
    """The served table of derived audit rows under a name of its own, and a canned query over it."""
    cfg = {
        "geo": {"column": "nation", "home": HOME}, "reason": {"column": "reason", "categories": {"hot": ("urgent", "high")}}, "immigration": {"column": "reason", "keywords": ["urgent"], "to": "is_immigration"}, "nets": {"column": "reach"},
        "has_case": {"column": "case_no"}, "base_type": {"column": "kind", "lookup": {"O": "Open", "F": "Final"}, "default": "Else"}, "temporal": {"column": "ts"},
    }
    rows = audit(spark, d).withColumn("case_no", F.when(F.col("kind") == "O", "***").otherwise(" "))
    shown = served(derive.derive_columns(rows, cfg), ["geo", "reason_cat", "is_immigration", "nets", "has_case", "base_type", "hour_et", "dow_et"])
    view = f"records_{name}"
    shown.createOrReplaceTempView(view)
    return spark.sql(CANNED[name].replace("from records", f"from {view}"))


def _catalogue(name: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return _records(spark, d, name)

    run.__name__ = f"catalogue_{name}"
    query(f"with records as ({_RECORDS}) {CANNED[name].replace('sum(case when has_case then 1 else 0 end)', 'cast(sum(case when has_case then 1 else 0 end) as bigint)')}")(run)


for _name in CANNED:
    _catalogue(_name)


@query("select o_orderkey, o_orderstatus from orders")
def served_table(spark: SparkSession, d: str) -> DataFrame:
    return served(table(spark, d, "orders"), ["o_orderkey", "o_orderstatus", "o_totalprice"], exclude=["o_totalprice"])


@query(r"select doc_id from documents where regexp_matches(lower(text), '(^|[^\p{L}\p{N}])the([^\p{L}\p{N}]|$)') and regexp_matches(lower(text), '(^|[^\p{L}\p{N}])of([^\p{L}\p{N}]|$)')")
def token_search(spark: SparkSession, d: str) -> DataFrame:
    return search(token_index(table(spark, d, "documents"), "doc_id", ["text"]), "The of", "doc_id")


@query("select o_orderkey, o_orderstatus from orders order by cast(o_orderstatus as varchar), cast(o_orderkey as varchar) limit 50")
def public_slice(spark: SparkSession, d: str) -> DataFrame:
    from lodestone.sources.tables import public_slice as first

    return first(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), 50, ["o_orderstatus"])


@query("select date_trunc('hour', ts) as window_start, date_trunc('hour', ts) + interval 1 hour as window_end, event_type, cast(count(*) as bigint) as n from events where ts is not null group by 1, 2, 3")
def hourly_counts(spark: SparkSession, d: str) -> DataFrame:
    out = windowed_counts(table(spark, d, "events"), "ts", "event_type")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")})


@query("""with o as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minute then 0 else 1 end as new from events where ts is not null), s as (select user_id, ts, sum(new) over (partition by user_id order by ts rows unbounded preceding) as k from o)
select min(ts) as session_start, max(ts) + interval 30 minute as session_end, user_id, cast(count(*) as bigint) as n from s group by user_id, k""")
def user_sessions(spark: SparkSession, d: str) -> DataFrame:
    out = sessions(table(spark, d, "events"), "ts", "user_id")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("session_start", "session_end")})
