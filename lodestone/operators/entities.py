"""Text to entities to a reviewed graph: windows, spans, nodes, edges, statements, review log, closure."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions.semantics import folded, python_strip, stable_id

MAX_CHARS, OVERLAP = 1400, 200
_PEOPLE, _BODIES = ("person", "government official"), ("organization", "government agency", "company")
#: label: schema of its entities; labels not listed are LegalEntity.
ENTITY_SCHEMAS: dict[str, str] = {
    label: schema
    for schema, labels in {
        "Person": "person, government official, attorney/legal counsel",
        "Organization": "organization, government agency",
        "Company": "company",
        "Address": "address, jurisdiction",
        "Vehicle": "vehicle",
        "Thing": "product/system/technology, date, phone, email, monetary amount, case/docket number, permit/license/contract number, statute/regulation, position/title",
    }.items()
    for label in labels.split(", ")
}
#: Labels whose entities are nodes of the graph; the others describe what is around them.
NODE_LABELS = tuple(k for k, v in ENTITY_SCHEMAS.items() if v != "Thing" or k.startswith("product"))
#: relation: (schema, labels of its head, labels of its tail, role of the edge)
RELATIONS: dict[str, tuple[str, tuple[str, ...], tuple[str, ...], str | None]] = {
    "employed by": ("Employment", _PEOPLE, _BODIES, None),
    "member of": ("Membership", _PEOPLE, _BODIES[:2], None),
    "director/officer of": ("Directorship", _PEOPLE, _BODIES, None),
    "owns/subsidiary of": ("Ownership", ("person", "company", "organization"), ("company",), None),
    "represents/counsel for": ("Representation", ("person", "attorney/legal counsel", "company"), ("person", *_BODIES), None),
    "family of": ("Family", ("person",), ("person",), None),
    "associate of": ("Associate", ("person",), ("person",), None),
    "party to contract/procurement": ("UnknownLink", _BODIES[:2], ("company", "organization"), "party to contract/procurement"),
    "affiliated/linked": ("UnknownLink", NODE_LABELS, NODE_LABELS, None),
}
#: A preset with one relation more, for records of searches across agencies.
SHARING: dict[str, tuple[str, tuple[str, ...], tuple[str, ...], str | None]] = RELATIONS | {"shares data with": ("UnknownLink", ("government agency",), ("government agency",), "data-sharing")}


def plan_windows(text: str | None, max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(start, end) windows that cover the text, none of a blank one: each but the last ends after the last blank or line end that
    is at most ``overlap`` before its full length, if there is one, and the next begins ``overlap`` before that, one character further on at
    least."""
    if max_chars <= 0 or overlap < 0 or overlap >= max_chars:
        raise ValueError("overlap must be less than max_chars")
    text, out, a = text or "", [], 0
    while text.strip() and a < len(text):
        b = min(len(text), a + max_chars)
        if b < len(text):
            low = max(a + 1, b - overlap)
            space = max(text.rfind(c, low - 1, b) for c in " \n\t\r")
            b = space + 1 if space >= 0 else b
        out.append((a, b))
        if b >= len(text):
            break
        a = max(a + 1, b - overlap)
    return out


def register_windows(spark: SparkSession, name: str = "plan_windows") -> None:
    """A table function for SQL: plan_windows(text, max_chars, overlap) gives nth, start, end and window."""

    class Planner:
        def eval(self, text: str, max_chars: int, overlap: int) -> Iterator[tuple[int, int, int, str]]:  # noqa: A003
            for n, (a, b) in enumerate(plan_windows(text, max_chars, overlap)):
                yield n, a, b, text[a:b]

    spark.udtf.register(name, F.udtf(Planner, returnType="nth int, start int, end int, window string"))


def windows(df: DataFrame, text: str, *keep: str, max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """A row for each window: keep, nth, start, end. The text isn't copied; substring gives the window."""

    @F.pandas_udf("array<struct<start:int,end:int>>")
    def plan(s: pd.Series) -> pd.Series:
        return s.map(lambda t: [{"start": a, "end": b} for a, b in plan_windows(t, max_chars, overlap)])

    return df.select(*keep, F.posexplode(plan(F.col(text))).alias("nth", "w")).select(*keep, "nth", "w.start", "w.end")


def dedup_spans(spans: Sequence[dict]) -> list[dict]:
    """Of equal spans the best score stays. Of overlapping ones of a label, taken in the order given, a longer (then better) one
    takes the place of each it beats; one that beats some and loses to another falls, and so do those it beat."""
    best: dict[tuple, dict] = {}
    for s in spans:
        key = (s["label"], s["start"], s["end"])
        if key not in best or s["score"] > best[key]["score"]:
            best[key] = s
    kept: list[dict] = []
    for s in best.values():
        worth = (s["end"] - s["start"], s["score"])
        over = [k for k in kept if k["label"] == s["label"] and k["start"] < s["end"] and s["start"] < k["end"]]
        lost = [k for k in over if (k["end"] - k["start"], k["score"]) >= worth]
        kept = [k for k in kept if k not in over or k in lost]
        if not lost:
            kept.append(s)
    return sorted(kept, key=lambda s: (s["start"], s["end"], s["label"]))


def dedup(spans: DataFrame, *by: str, order: Sequence[str] = ("start", "end", "label")) -> DataFrame:
    """spans: by..., label, start, end, score, text; one group for each page, taken in that order, as rows have none."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([*order, "score"], kind="stable")
        return pd.DataFrame(dedup_spans(rows.to_dict("records")), columns=rows.columns)

    return spans.groupBy(*by).applyInPandas(run, spans.schema)


def _lookup(table: Mapping[str, str], key: Column, default: str) -> Column:
    pairs = [x for k, v in table.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(default))


def nodes(spans: DataFrame, namespace: str) -> DataFrame:
    """node_id, doc_id, schema, name, label: one for each name in a document, without space at its ends, case aside."""
    schema = _lookup(ENTITY_SCHEMAS, F.col("label"), "LegalEntity")
    rows = spans.select("doc_id", "label", schema.alias("schema"), python_strip(F.col("text")).alias("name")).withColumn("node_id", stable_id(namespace, F.col("doc_id"), F.col("schema"), folded(F.col("name"))))
    return rows.groupBy("node_id", "doc_id", "schema").agg(F.min("name").alias("name"), F.min("label").alias("label"))


def allowed_relations(spark: SparkSession, relations: Mapping[str, tuple] = RELATIONS) -> DataFrame:
    rows = [(r, h, t, schema, role) for r, (schema, heads, tails, role) in relations.items() for h in heads for t in tails]
    return spark.createDataFrame(rows, "relation string, head_label string, tail_label string, schema string, role string")


def edges(relations: DataFrame, namespace: str, known: Mapping[str, tuple] = RELATIONS) -> DataFrame:
    """edge_id, schema, head_id, tail_id, role, label. relations: relation, head_id, head_label, tail_id, tail_label, span_key.

    A known relation between labels that it allows has its own schema and role; between others it falls. An unknown one, and an
    ownership of what can't be owned, becomes an UnknownLink whose role is the relation."""
    table = F.broadcast(allowed_relations(relations.sparkSession, known))  # a constant of some hundred rows
    owning = [k for k, v in known.items() if v[0] == "Ownership"]
    joined = relations.join(table, ["relation", "head_label", "tail_label"], "left")
    loose = F.col("schema").isNull() & (~F.col("relation").isin(*known) | F.col("relation").isin(*owning))
    out = joined.withColumns({"role": F.when(loose, F.col("relation")).otherwise(F.col("role")), "schema": F.coalesce("schema", F.when(loose, "UnknownLink"))}).where("schema is not null")
    return out.select(stable_id(namespace, F.col("schema"), F.col("head_id"), F.col("tail_id"), F.col("span_key")).alias("edge_id"), "schema", "head_id", "tail_id", "role", F.col("relation").alias("label")).distinct()


def statements(mentions: DataFrame, namespace: str) -> DataFrame:
    """One for each mention: statement_id, target_id, prop, value, where it stands, pending."""
    key = stable_id(namespace, *[F.col(c) for c in ("doc_id", "page", "char_start", "char_end", "target_id", "prop")])
    return mentions.withColumns({"statement_id": key, "review": F.lit("pending"), "supersedes": F.lit(None).cast("string")})


def decide(log: DataFrame, decisions: DataFrame) -> DataFrame:
    """log and one row more for each decision (statement_id, review, value, at): nothing is overwritten. An edit is a new
    accepted statement that supersedes the old one."""
    old = log.drop("review", "supersedes").join(decisions.withColumnRenamed("value", "_new"), "statement_id")
    edited = F.col("review") == "edited"
    new = old.withColumns({"supersedes": F.when(edited, F.col("statement_id")), "statement_id": F.when(edited, stable_id(F.col("statement_id"), F.lit("edit"), F.col("at"))).otherwise(F.col("statement_id")), "value": F.when(edited, F.col("_new")).otherwise(F.col("value")), "review": F.when(edited, "accepted").otherwise(F.col("review"))})
    return log.withColumn("at", F.lit(0).cast("bigint") if "at" not in log.columns else F.col("at")).unionByName(new.drop("_new"))


def current(log: DataFrame) -> DataFrame:
    """The last state of each statement that nothing supersedes."""
    last = log.withColumn("_k", F.row_number().over(Window.partitionBy("statement_id").orderBy(F.desc("at")))).where("_k = 1").drop("_k")
    gone = log.where("supersedes is not null").select(F.col("supersedes").alias("statement_id")).distinct()
    return last.join(gone, "statement_id", "left_anti")


def closure(kept_nodes: DataFrame, all_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges whose two ends are kept, and those that fall."""
    ids = kept_nodes.select("node_id")
    both = all_edges.join(ids, all_edges["head_id"] == ids["node_id"], "left_semi").join(ids, all_edges["tail_id"] == ids["node_id"], "left_semi")
    return both, all_edges.join(both.select("edge_id"), "edge_id", "left_anti")
