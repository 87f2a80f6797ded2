"""The gate before any finding: truncated exports, date windows, columns that are not what they seem. Leads, not verdicts."""

from __future__ import annotations

from datetime import date
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.semantics import instant, number, stripped

#: Rows of a spreadsheet less its header: an export of exactly so many was cut.
CEILING = 2**20 - 1
HIGH_NULL, MISMATCH = 0.90, 0.80


def check_truncation(rows: int | DataFrame, ceiling: int = CEILING) -> dict[str, Any]:
    n = rows.count() if isinstance(rows, DataFrame) else rows
    return {"rows": n, "ceiling": ceiling, "truncated": n == ceiling}


def date_window(df: DataFrame, column: str, start: date | None = None, end: date | None = None) -> DataFrame:
    """One row: first and last date (UTC), n_undated, and whether the data begin after the start or end before the end asked for."""
    t = instant(F.col(column), dict(df.dtypes)[column])
    out = df.agg(F.to_date(F.min(t)).alias("first_date"), F.to_date(F.max(t)).alias("last_date"), F.count_if(t.isNull()).alias("n_undated"), F.count("*").alias("n_rows"))
    ask = lambda d: F.lit(d).cast("date")
    return out.withColumns({"head_gap": F.col("first_date") > ask(start), "tail_gap": F.col("last_date") < ask(end)})


def column_profile(df: DataFrame) -> DataFrame:
    """column, n, n_null, n_blank, n_number for each column, in one pass over the table."""
    parts = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        text = kind == "string"
        blank = F.count_if(stripped(c) == "") if text else F.lit(0).cast("bigint")
        numeric = F.count_if(number(c).isNotNull()) if text else F.lit(None).cast("bigint")
        parts.append(F.struct(F.lit(name).alias("column"), F.count("*").alias("n"), F.count_if(c.isNull()).alias("n_null"), blank.alias("n_blank"), numeric.alias("n_number")))
    return df.agg(F.array(*parts).alias("p")).select(F.explode("p").alias("p")).select("p.*")


def anomalies(df: DataFrame) -> DataFrame:
    """column, anomaly, share. all_null and all_blank exclude the rest; an empty table has none."""
    p = column_profile(df).where("n > 0")
    there = F.col("n") - F.col("n_null")
    null_share, number_share = F.col("n_null") / F.col("n"), F.try_divide(F.col("n_number"), there)
    found = F.when(there == 0, F.array(F.struct(F.lit("all_null").alias("anomaly"), F.lit(1.0).alias("share"))))
    found = found.when(F.col("n_blank") == there, F.array(F.struct(F.lit("all_blank").alias("anomaly"), F.lit(1.0).alias("share"))))
    rest = F.array(F.when(null_share > HIGH_NULL, F.struct(F.lit("high_null").alias("anomaly"), null_share.alias("share"))), F.when((number_share > MISMATCH) & (number_share < 1), F.struct(F.lit("type_coercion_mismatch").alias("anomaly"), number_share.alias("share"))))
    return p.select("column", F.explode(F.array_compact(found.otherwise(rest))).alias("a")).select("column", "a.*")


def report(df: DataFrame, column: str | None = None, start: date | None = None, end: date | None = None) -> dict[str, Any]:
    """All of the gate as a small dictionary."""
    window = date_window(df, column, start, end).first().asDict() if column and column in df.columns else {"status": "skipped", "reason": "no date column"}
    return {"truncation": check_truncation(df), "date_window": window, "anomalies": [r.asDict() for r in anomalies(df).collect()]}
