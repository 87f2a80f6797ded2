import pytest

from lodestone.operators import quality, rollup
from lodestone.operators.recipe import CHECKS, run_recipe

ROWS = [("A", "OOS", True, "Traffic", "2024-01-01 10:00:00", 100), ("A", "OOS", False, "Traffic", "2024-01-01 10:00:00", 1500), ("B", "SC", True, "Homicide", "2024-01-03 23:00:00", None), ("C", None, None, "Homicide", None, 150)]
CFG = {"actor": "agency", "geo": "geo", "case": "has_case", "severity": "kind", "ts": "ts", "nets": "nets", "labels": {"in": "SC", "out": "OOS", "unknown": "UNK"}}


@pytest.fixture()
def log(spark):
    return spark.createDataFrame(ROWS, "agency string, geo string, has_case boolean, kind string, ts string, nets long")


def values(df):
    return {(r["check_name"], r["metric"], r["key"]): r["value"] for r in df.collect()}


def test_checks(log):
    out = run_recipe(log, CFG)
    v = values(out)
    assert v["out_of_state", "n_out", None] == 2 and v["out_of_state", "pct", None] == 0.5 and v["out_of_state", "pct_known", None] == pytest.approx(2 / 3)
    assert v["blast_radius", "median", None] == 150 and v["blast_radius", "median_by_severity", "Traffic"] == 800
    assert v["accountability", "with_case", None] == 2
    assert v["operations", "span_days", None] == 2 and v["operations", "active_days", None] == 2 and v["operations", "records_per_active_day", None] == 2
    assert v["operations", "busiest_hour", "10"] == 2
    assert v["mega_users", "largest", None] == 2 and v["cross_agency", "external_actor", "A"] == 2


def test_skipped_is_not_zero(log):
    status = {(r["check_name"], r["status"]) for r in run_recipe(log.drop("nets", "geo"), CFG).collect()}
    assert ("blast_radius", "skipped") in status and ("out_of_state", "skipped") in status and ("immigration", "skipped") in status
    assert ("cross_agency", "partial") in status  # actors are known, whether they are external isn't
    assert {c for c, _ in status} == set(CHECKS)
    with pytest.raises(ValueError):
        run_recipe(log, CFG, checks=["nope"])


def test_empty_nets_are_partial(spark):
    df = spark.createDataFrame([("A", None)], "agency string, nets long")
    found = {(r["metric"], r["value"], r["status"]) for r in run_recipe(df, {"actor": "agency", "nets": "nets"}).where("check_name = 'blast_radius'").collect()}
    assert ("median", None, "partial") in found and ("n_obs", 0.0, "partial") in found


def test_rollup(log, spark):
    two = log.selectExpr("*", "'x' as src").unionByName(log.selectExpr("*", "'y' as src")).unionByName(log.where("agency = 'B'").selectExpr("*", "'y' as src"))
    f = run_recipe(two, CFG, "src")
    pooled = {r["check_name"]: r for r in rollup.pooled(f).collect()}["out_of_state"]
    assert pooled["pooled_pct"] == pytest.approx(4 / 9) and pooled["unweighted_mean_pct"] == pytest.approx((2 / 4 + 2 / 5) / 2)
    assert [tuple(r) for r in rollup.recurring_actors(f).select("actor", "n_sources", "total").collect()] == [("A", 2, 4)]
    assert {r["thesis"] for r in rollup.theses(f).collect()} == {"mostly_out_of_state", "leading_recurring_actor"}


def test_quality(spark):
    df = spark.createDataFrame([(None, " ", "1", "x"), (None, "", "2", None), (None, "\t", "3", None), (None, " ", "4", None), (None, " ", "n/a", None)], "a string, b string, c string, d string")
    assert {(r["column"], r["anomaly"]) for r in quality.anomalies(df).collect()} == {("a", "all_null"), ("b", "all_blank")}
    more = df.unionByName(spark.createDataFrame([(None, " ", str(i), None) for i in range(9)], df.schema))
    assert {(r["column"], r["anomaly"]) for r in quality.anomalies(more).collect()} == {("a", "all_null"), ("b", "all_blank"), ("c", "type_coercion_mismatch"), ("d", "high_null")}
    assert quality.anomalies(df.limit(0)).count() == 0
    assert quality.check_truncation(2**20 - 1)["truncated"] and not quality.check_truncation(2**20)["truncated"]


def test_overnight_actors_of_few_rows(spark):
    rows = [("night", 23), ("night", 2), ("night", 7), ("half", 3), ("half", 12), ("early", 6), ("early", 7), ("none", None), ("none", 99)]
    df = spark.createDataFrame([(a, h, "2024-01-01 10:00:00" if a == "night" else f"2024-01-0{i + 1} 10:00:00" if a != "none" else "junk") for i, (a, h) in enumerate(rows)], "a string, h int, ts string")
    cfg = {"actor": "a", "hour": "h", "ts": "ts"}
    v = {(r["metric"], r["key"]): r["value"] for r in run_recipe(df, cfg, checks=["ai_moderation"]).collect()}
    assert v == {("n_actors", None): 4, ("n_overnight_heavy", None): 1, ("overnight_heavy_actor", "night"): pytest.approx(2 / 3), ("burst_size_distribution", "3"): 1, ("burst_size_distribution", "1"): 4, ("max_burst", None): 3}
    junk = run_recipe(df.where("a = 'none'"), cfg, checks=["ai_moderation"]).collect()
    assert {(r["metric"], r["value"], r["status"]) for r in junk} == {("n_actors", 1, "partial"), ("n_overnight_heavy", 0, "partial"), ("max_burst", None, "partial")}
