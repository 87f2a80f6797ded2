"""From documents to a published entity network: extraction with injected models, intermediate bundles, merge logs, a corpus of
one's own, and the read-only functions a reader has on it."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions.semantics import stable_id
from lodestone.operators import entities
from lodestone.operators.resolution import bucket, canonical_json, cross_reference, name_key

MAX_HITS = 25
#: Properties that go into a match query.
MATCH_PROPERTIES = ("name", "alias", "birthDate", "nationality", "country", "jurisdiction", "registrationNumber", "idNumber", "address", "topics")

#: (texts) to a list of spans {start, end, label, score} for each: the models are the caller's.
Extractor = Callable[[list[str]], list[list[dict[str, Any]]]]


def extract(pages: DataFrame, extractor: Extractor, threshold: float = 0.5) -> DataFrame:
    """doc_id, page, label, start, end, score, text: spans of the windows of each page, put back in the page's place and freed of
    doubles. pages: doc_id, page, text, trustworthy; those of documents that aren't trustworthy are left out (see refused)."""
    schema = "doc_id string, page int, label string, start int, end int, score double, text string"

    def run(frames):  # noqa: ANN001, ANN202
        for frame in frames:
            rows = []
            for doc, page, text in zip(frame["doc_id"], frame["page"], frame["text"]):
                windows = entities.plan_windows(text)
                found = extractor([text[a:b] for a, b in windows]) if windows else []
                spans = [s | {"start": s["start"] + a, "end": s["end"] + a} for (a, _), some in zip(windows, found) for s in some if s["score"] >= threshold]
                rows += [(doc, page, s["label"], s["start"], s["end"], float(s["score"]), text[s["start"] : s["end"]]) for s in entities.dedup_spans(spans)]
            yield pd.DataFrame(rows, columns=["doc_id", "page", "label", "start", "end", "score", "text"])

    return pages.where("trustworthy").select(F.col("doc_id").cast("string"), F.col("page").cast("int"), F.coalesce("text", F.lit("")).alias("text")).mapInPandas(run, schema)


def refused(pages: DataFrame) -> DataFrame:
    """Documents whose text isn't fit for extraction, and why they were left out."""
    return pages.where("not coalesce(trustworthy, false)").select("doc_id").distinct().withColumn("reason", F.lit("text is not trustworthy"))


def token_intervals(spans: DataFrame) -> DataFrame:
    """One span for each interval of tokens (doc_id, page, first, last): the longest, then the best score, then the least label."""
    best = F.row_number().over(Window.partitionBy("doc_id", "page", "first", "last").orderBy(F.desc(F.col("end") - F.col("start")), F.desc("score"), "label"))
    return spans.withColumn("_k", best).where("_k = 1").drop("_k")


def intermediate(log: DataFrame, nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes and edges that an accepted statement bears, names as they were last accepted, edges with both ends; and the edges
    that fell for want of an end."""
    accepted = entities.current(log).where("review = 'accepted'")
    targets = accepted.select(F.col("target_id").alias("node_id")).distinct()
    renamed = accepted.where("prop = 'name'").groupBy(F.col("target_id").alias("node_id")).agg(F.max_by("value", F.struct("at", "statement_id")).alias("_name"))
    kept = nodes.join(targets, "node_id", "left_semi").join(renamed, "node_id", "left").withColumn("name", F.coalesce("_name", "name")).drop("_name")
    borne = edges.join(targets.withColumnRenamed("node_id", "edge_id"), "edge_id", "left_semi")
    good, fallen = entities.closure(kept, borne)
    return kept, good, fallen


def hydrate(pairs: DataFrame, nodes: DataFrame, mentions: DataFrame) -> DataFrame:
    """Candidate pairs with name, schema and mentions of either side, as a reviewer reads them."""
    seen = mentions.groupBy(F.col("target_id").alias("id")).agg(F.array_sort(F.collect_set(F.struct("doc_id", "page", "value"))).alias("mentions"))
    sides = nodes.join(seen, "id", "left").select("id", "schema", "name", F.coalesce("mentions", F.expr("cast(array() as array<struct<doc_id:string,page:int,value:string>>)")).alias("mentions"))
    out = pairs
    for side in ("left", "right"):
        s = sides.select(F.col("id").alias(f"{side}_id"), F.struct("schema", "name", "mentions").alias(side))
        out = out.drop(f"{side}_name").join(s, f"{side}_id")
    return out


def review_band(pairs: DataFrame) -> DataFrame:
    """Pairs that people decide: in the review band and not judged."""
    judged = F.col("judgement").isNotNull() if "judgement" in pairs.columns else F.lit(False)
    return pairs.where((bucket(F.col("score")) == "review") & ~judged)


def auto_merges(pairs: DataFrame, clusters: DataFrame) -> DataFrame:
    """What was merged without a person: root, member_ids, n_pairs, least_score, by root."""
    merged = pairs.where(bucket(F.col("score")) == "auto").join(clusters.withColumnRenamed("id", "left_id"), "left_id")
    return merged.groupBy("root").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array("left_id", "right_id"))))).alias("member_ids"), F.count("*").alias("n_pairs"), F.min("score").alias("least_score")).orderBy("root")


def corpus_rows(resolved: DataFrame) -> DataFrame:
    """id, schema, caption, properties (those of the entity; name: caption and aliases, each once); a missing id, schema or name
    raises."""
    names = F.array_distinct(F.array_compact(F.concat(F.array("caption"), F.coalesce("aliases", F.expr("cast(array() as array<string>)")))))
    own = F.coalesce(F.col("properties") if "properties" in resolved.columns else F.lit(None), F.expr("cast(map() as map<string,array<string>>)"))
    need = lambda c: F.coalesce(F.col(c), F.raise_error(F.lit(f"an entity has no {c}")).cast("string"))
    return resolved.select(need("canonical_id").alias("id"), need("schema").alias("schema"), need("caption").alias("caption"), F.map_concat(F.map_filter(own, lambda k, _: k != "name"), F.create_map(F.lit("name"), names)).alias("properties"))


def write_corpus(resolved: DataFrame, folder: str, name: str) -> dict[str, Any]:
    """The corpus as JSON lines, and its manifest: the version is the digest of the rows' own digests in order, so equal rows
    give equal versions however they are spread."""
    rows = corpus_rows(resolved)
    rows.write.mode("overwrite").json(f"{folder}/{name}")
    spark = resolved.sparkSession
    stored = spark.read.text(f"{folder}/{name}")
    # Four sums of parts of the digests: their order doesn't matter, and one row reaches the driver.
    digest = F.sha2("value", 256)
    sums = stored.select(*[F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("decimal(38,0)").alias(f"d{k}") for k in range(4)]).agg(F.count("*").alias("n"), *[F.sum(f"d{k}") for k in range(4)]).first()
    manifest = {"name": name, "n": sums["n"], "version": hashlib.sha256(canonical_json([str(x) for x in sums]).encode()).hexdigest()[:16]}
    spark.createDataFrame([manifest]).coalesce(1).write.mode("overwrite").json(f"{folder}/{name}.manifest")
    return manifest


def match_queries(resolved: DataFrame) -> DataFrame:
    """id, schema and the properties that a match may use; without a name, caption and aliases stand for it. resolved: as snapshot
    gives it."""
    resolved = resolved.withColumn("id", F.col("canonical_id")) if "id" not in resolved.columns else resolved
    props = F.map_filter(F.col("properties"), lambda k, _: k.isin(*MATCH_PROPERTIES))
    names = F.array_distinct(F.array_compact(F.concat(F.array("caption"), F.coalesce(F.col("aliases"), F.expr("cast(array() as array<string>)")))))
    return resolved.select("id", "schema", F.when(F.map_contains_key(props, "name"), props).otherwise(F.map_concat(props, F.create_map(F.lit("name"), names))).alias("properties"))


def hits_by_dataset(hits: DataFrame) -> DataFrame:
    """A hit under each of its datasets; one that has none under (unknown). hits: query_id, entity_id, score, datasets."""
    return hits.select("query_id", "entity_id", "score", F.explode_outer("datasets").alias("dataset")).withColumn("dataset", F.coalesce("dataset", F.lit("(unknown)")))


class Reader:
    """What a reader may ask: only of the scopes that are allowed, never more than MAX_HITS at once."""

    def __init__(self, corpus: DataFrame, allowed: Sequence[str], default: str) -> None:
        self.corpus, self.allowed, self.default = corpus, list(allowed), default

    def _scoped(self, scopes: Sequence[str] | None) -> DataFrame:
        scopes = list(scopes or [self.default])
        if bad := [s for s in scopes if s not in self.allowed]:
            raise PermissionError(f"not allowed: {bad}")  # all are checked before anything is read
        return self.corpus.where(F.col("dataset").isin(*scopes))

    def list_datasets(self) -> DataFrame:
        return self.corpus.where(F.col("dataset").isin(*self.allowed)).groupBy("dataset").agg(F.count("*").alias("n"))

    def search(self, text: str, scopes: Sequence[str] | None = None, limit: int = MAX_HITS) -> DataFrame:
        words = name_key(F.lit(text))
        return self._scoped(scopes).where(F.size(F.array_except(F.split(words, " "), F.split(name_key(F.col("name")), " "))) == 0).orderBy("id").limit(min(limit, MAX_HITS))

    def get_entity(self, entity_id: str, scopes: Sequence[str] | None = None) -> DataFrame:
        return self._scoped(scopes).where(F.col("id") == entity_id)

    def match(self, queries: DataFrame, scopes: Sequence[str] | None = None, threshold: float = 0.7, limit: int = MAX_HITS) -> DataFrame:
        return cross_reference(queries, self._scoped(scopes), threshold, min(limit, MAX_HITS))


def graph_rows(resolved: DataFrame, edges: DataFrame, investigation: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges for a graph store, their ids scoped by the investigation."""
    scoped = lambda c: F.concat(F.lit(f"{investigation}:"), F.col(c))
    nodes = resolved.select(scoped("canonical_id").alias("scoped_id"), "canonical_id", "schema", "caption", F.to_json(F.struct("aliases", "member_ids")).alias("properties_json"))
    return nodes, edges.select(scoped("edge_id").alias("scoped_id"), scoped("head").alias("head"), scoped("tail").alias("tail"), "schema", "role")


def statement_key(namespace: str, *columns: str) -> Column:
    return stable_id(namespace, *[F.col(c) for c in columns])


def tables_in(spark: SparkSession, folder: str, names: Sequence[str]) -> DataFrame:
    """Bundles of several documents as one, by column names."""
    from functools import reduce

    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [spark.read.json(f"{folder}/{n}/entities") for n in names])
