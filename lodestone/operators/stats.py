"""Distribution measures. Ranks come from counts of distinct values, which lie in ranges of values: each range ranks its own, and
only the sums of the ranges before it, a row for each, are carried on. So no group needs to fit in one task."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.semantics import ratio
from lodestone.functions.shared import narrow, written


def concentration(values: DataFrame, value: str, by: Sequence[str] = (), top_frac: float = 0.01) -> DataFrame:
    """n, total, gini, top_share and bottom_half of a numeric column, for each group: negative values raise, nulls don't count.

    gini = (2 * sum(i * x_i) - (n + 1) * total) / (n * total) with x ascending; equal values have their ranks' mean, so a row
    for each distinct value is enough."""
    by = list(by)
    x = F.col(value).cast("double")
    clean = values.where(x.isNotNull() & ~F.isnan(x)).select(*by, F.when(x < 0, F.raise_error(F.lit("negative value"))).otherwise(x).alias("x"))
    tied = clean.groupBy(*by, "x").agg(F.count("*").alias("m"))
    ranged = written(tied.repartitionByRange(*by, "x").withColumn("_p", F.spark_partition_id()), "ranged")
    parts = ranged.groupBy(*by, "_p").agg(F.sum("m").alias("_m"))
    group = Window.partitionBy(*by)  # a row for each range
    before = F.sum("_m").over(group.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], F.col("_p").alias("_q"), F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_m").over(group).alias("n"))
    same = reduce(lambda p, q: p & q, [F.col(c).eqNullSafe(F.col(f"_by{i}")) for i, c in enumerate(by)], F.col("_p") == F.col("_q"))
    up = Window.partitionBy(*by, "_p").orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = ranged.withColumn("upto", F.sum("m").over(up)).join(narrow(parts, 60), same).withColumn("upto", F.col("upto") + F.col("_before"))
    k = F.greatest(F.lit(1), F.ceil(F.col("n") * F.lit(float(top_frac))))
    half = F.floor(F.col("n") / 2)
    in_top = F.greatest(F.lit(0), F.least(F.col("m"), F.col("upto") - (F.col("n") - k)))
    in_bottom = F.greatest(F.lit(0), F.least(F.col("m"), half - (F.col("upto") - F.col("m"))))
    rank_sum = F.col("m") * (2 * F.col("upto") - F.col("m") + 1) / 2
    sums = ranked.groupBy(*by).agg(
        F.coalesce(F.max("n"), F.lit(0)).alias("n"),
        F.coalesce(F.sum(F.col("x") * F.col("m")), F.lit(0.0)).alias("total"),
        F.sum(F.col("x") * rank_sum).alias("_ranked"),
        F.sum(F.col("x") * in_top).alias("_top"),
        F.sum(F.col("x") * in_bottom).alias("_bottom"),
    )
    share = lambda c: F.coalesce(ratio(F.col(c), F.col("total")), F.lit(0.0))
    gini = F.coalesce(ratio(2 * F.col("_ranked") - (F.col("n") + 1) * F.col("total"), F.col("n") * F.col("total")), F.lit(0.0))
    return sums.select(*by, "n", "total", gini.alias("gini"), share("_top").alias("top_share"), share("_bottom").alias("bottom_half"))


def median_by(df: DataFrame, category: str, value: str) -> DataFrame:
    """Exact medians, largest first; null categories don't count."""
    return df.where(F.col(category).isNotNull()).groupBy(category).agg(F.median(value).alias("median")).where("median is not null").orderBy(F.desc("median"), category)


def automation_signature(df: DataFrame, actor: str, hour: str, day_start: int = 8, day_end: int = 18, heavy: int = 1000) -> DataFrame:
    """Of each actor: records, records with an hour, share in the half-open day, share at night, distinct hours, heavy."""
    h = F.col(hour)
    valid = F.coalesce((h >= 0) & (h <= 23), F.lit(False))
    day = valid & (h >= day_start) & (h < day_end)
    out = df.where(F.col(actor).isNotNull()).groupBy(actor).agg(F.count("*").alias("n_records"), F.count_if(valid).alias("n_hours"), F.count_if(day).alias("n_day"), F.count_distinct(F.when(valid, h)).alias("hours_used"))
    day_share = F.coalesce(ratio(F.col("n_day"), F.col("n_hours")), F.lit(0.0))
    night = F.coalesce(ratio(F.col("n_hours") - F.col("n_day"), F.col("n_hours")), F.lit(0.0))
    return out.select(actor, "n_records", "n_hours", day_share.alias("day_pct"), night.alias("night_pct"), "hours_used", (F.col("n_records") > heavy).alias("is_heavy"))


def overnight_signature(df: DataFrame, actor: str, hour: str, day_start: int = 6, day_end: int = 18, overnight_threshold: float = 0.5) -> DataFrame:
    """Of each actor: shares of valid hours in the half-open day and outside it, and whether the latter is above the threshold,
    however few the records. An actor without valid hours has shares of 0."""
    shares = automation_signature(df, actor, hour, day_start, day_end)
    return shares.select(actor, F.col("day_pct").alias("daytime_pct"), F.col("night_pct").alias("overnight_pct"), (F.col("night_pct") > overnight_threshold).alias("overnight_heavy"))


def burstiness(df: DataFrame, ts: str, actor: str | None = None, unit: str | None = None) -> DataFrame:
    """Histogram of how many records share a timestamp (and actor): burst_size, n_groups. unit: cut times to it first."""
    t = F.date_trunc(unit, F.col(ts)) if unit else F.col(ts)
    keys = [t.alias("t")] + ([F.col(actor).alias("a")] if actor else [])
    clean = df.select(*keys).dropna()
    return clean.groupBy(*clean.columns).agg(F.count("*").alias("burst_size")).groupBy("burst_size").agg(F.count("*").alias("n_groups"))


def presence_rate(mask: Column) -> Column:
    """The mean of a mask, null over no row; a null counts as False."""
    return F.avg(F.coalesce(mask, F.lit(False)).cast("double"))
