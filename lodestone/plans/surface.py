"""SQL for readers: canned queries over the served table, a guard for ad-hoc SQL, and token search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

def _breakdown(column: str) -> str:
    """How many rows each value has, most first."""
    return f"select {column}, count(*) as n from records group by {column} order by n desc, {column} limit 100"


#: name: SQL over the view ``records`` of derived rows. Each has a limit, as a served table may be large.
CANNED: dict[str, str] = {
    "record_count": "select count(*) as records from records limit 1",
    "geo_breakdown": _breakdown("geo"),
    "reason_category_breakdown": _breakdown("reason_cat"),
    "base_type_breakdown": _breakdown("base_type"),
    "immigration_count": "select count(*) as immigration_records from records where is_immigration limit 1",
    "automation_by_hour": _breakdown("hour_et").replace("order by n desc, hour_et limit 100", "order by hour_et limit 24"),
    "case_presence": "select count(*) as total, sum(case when has_case then 1 else 0 end) as with_case from records limit 1",
    "sample_rows": "select * from records order by all limit 50",
}
_READS = ("Project", "Filter", "Aggregate", "Sort", "GlobalLimit", "LocalLimit", "Join", "Union", "Distinct", "SubqueryAlias", "UnresolvedRelation", "UnresolvedWith", "UnresolvedHaving", "OneRowRelation", "Intersect", "Except", "UnresolvedInlineTable", "LateralJoin", "Window", "Generate", "WithWindowDefinition", "UnresolvedSubqueryColumnAliases", "Offset", "UnresolvedOrdinal", "Pivot", "Unpivot")


def canned(spark: SparkSession, name: str) -> DataFrame:
    if name not in CANNED:
        raise ValueError(f"no such query: {name}; there are {sorted(CANNED)}")
    return spark.sql(CANNED[name])


def safe_sql(spark: SparkSession, query: str, max_rows: int | None = None) -> DataFrame:
    """A read-only query, whole unless max_rows is given. What is not made of reading operators raises."""
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(query)
    names, todo = set(), [plan]
    while todo:
        node = todo.pop()
        names.add(node.nodeName())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    if bad := sorted(names - set(_READS)):
        raise PermissionError(f"only reading is allowed, not {bad}")
    return spark.sql(query) if max_rows is None else spark.sql(query).limit(max_rows)


def token_index(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """token, key: an inverted index, one row for each distinct word of a record."""
    words = F.flatten(F.array(*[F.regexp_extract_all(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(r"(?U)([\p{L}\p{N}]+)"), F.lit(1)) for c in columns]))
    return df.select(F.explode(F.array_distinct(words)).alias("token"), key)


def search(index: DataFrame, terms: str, key: str) -> DataFrame:
    """Keys of the records that have all terms."""
    import re

    wanted = sorted({t.lower() for t in re.findall(r"[^\W_]+", terms)})
    if not wanted:
        return index.select(key).limit(0)
    return index.where(F.col("token").isin(*wanted)).groupBy(key).agg(F.count_distinct("token").alias("_n")).where(F.col("_n") == len(wanted)).select(key)
