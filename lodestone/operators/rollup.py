"""Findings of many sources as one: pooled rates, actors that recur, theses. Input is what run_recipe returns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.semantics import ratio

OUT_OF_STATE, GINI = 0.5, 0.7


def pooled(findings: DataFrame) -> DataFrame:
    """check_name, n_sources, numerator, denominator, pooled_pct (sums over sums) and unweighted_mean_pct; skipped sources don't count."""
    ok = findings.where("status <> 'skipped' and key is null")
    size = ok.where("check_name = 'truncation' and metric = 'rows'").select("source_id", F.col("value").alias("rows"))
    n = ok.where("(check_name = 'out_of_state' and metric = 'n_out') or (check_name in ('immigration', 'pretext', 'co_travel') and metric = 'n') or (check_name = 'pii' and metric = 'n_records')")
    n = n.join(size, "source_id").groupBy("check_name")
    return n.agg(F.count("*").alias("n_sources"), F.sum("value").alias("numerator"), F.sum("rows").alias("denominator"), ratio(F.sum("value"), F.sum("rows")).alias("pooled_pct"), F.avg(ratio(F.col("value"), F.col("rows"))).alias("unweighted_mean_pct"))


def recurring_actors(findings: DataFrame, least: int = 2) -> DataFrame:
    """External actors of two or more sources: actor, n_sources, total, sources; most sources first."""
    hits = findings.where("status = 'ok' and check_name = 'cross_agency' and metric = 'external_actor'")
    out = hits.groupBy(F.col("key").alias("actor")).agg(F.count_distinct("source_id").alias("n_sources"), F.sum("value").cast("bigint").alias("total"), F.array_sort(F.collect_set("source_id")).alias("sources"))
    return out.where(F.col("n_sources") >= least).orderBy(F.desc("n_sources"), F.desc("total"), "actor")


def truncated_sources(findings: DataFrame) -> DataFrame:
    return findings.where("check_name = 'truncation' and metric = 'truncated' and value = 1").select("source_id").orderBy("source_id")


def theses(findings: DataFrame) -> DataFrame:
    """At most three rows: thesis, n_sources, detail. Leads to follow, not verdicts."""
    one = findings.where("status <> 'skipped' and key is null")
    away = one.where(f"check_name = 'out_of_state' and metric = 'pct' and value >= {OUT_OF_STATE}").agg(F.lit("mostly_out_of_state").alias("thesis"), F.count("*").alias("n_sources"), F.max_by("source_id", F.struct("value", "source_id")).alias("detail"))
    few = one.where(f"check_name = 'statistical_patterns' and metric = 'gini' and value >= {GINI}").agg(F.lit("few_actors_do_most").alias("thesis"), F.count("*").alias("n_sources"), F.max_by("source_id", F.struct("value", "source_id")).alias("detail"))
    lead = recurring_actors(findings).limit(1).select(F.lit("leading_recurring_actor").alias("thesis"), "n_sources", F.col("actor").alias("detail"))
    return away.unionByName(few).unionByName(lead).where("n_sources > 0")


def rollup(findings: DataFrame) -> dict[str, DataFrame]:
    return {"aggregate": pooled(findings), "recurring_external_actors": recurring_actors(findings), "truncated_sources": truncated_sources(findings), "theses": theses(findings)}
