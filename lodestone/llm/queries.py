"""Queries of this subpackage: each operator over its whole table, with its production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import cover_tree, fingerprints, html_paths, licenses, mixing, ngram_join, secrets, sentence_pieces, toxicity, warc
from lodestone.llm.common import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_paths.main_text(table(spark, sf_dir, "pages"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.encode(table(spark, sf_dir, "documents"))


def op5_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.linked(table(spark, sf_dir, "embeddings"))


def embedding_links_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same at a threshold that many vectors of small tables reach."""
    return cover_tree.linked(table(spark, sf_dir, "embeddings"), WIDE)


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.linked(table(spark, sf_dir, "documents"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint(table(spark, sf_dir, "documents"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.scan(docs, secrets.learn(docs))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


WIDE = 0.35

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_toxicity, op2_html, op3_licenses, op4_sentencepiece, op5_embeddings, op6_ngram_jaccard, op7_fingerprints, op8_secrets, op9_mixing, op10_warc, embedding_links_wide)}

#: DuckDB SQL of those that SQL can express; the others are held against brute force in tests.
_LINKS = """
with recursive v as (select vec_id as id, cast(embedding as double[]) as x from embeddings),
p as (select a.id as a, b.id as b from v a join v b on a.id <> b.id where list_cosine_similarity(a.x, b.x) >= {threshold}),
r(id, root) as (select id, id from v union select p.b, r.root from r join p on p.a = r.id)
select r.id as vec_id, min(r.root) as class_id, (select count(*) from p where p.a = r.id) as n_links from r group by r.id
"""
_SIMILAR = r"""
with recursive w as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '(?:[a-z0-9_]|[^\x00-\x7f])+') as w from documents where doc_id is not null),
g as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 3 then [w] else list_transform(range(1, len(w) - 1), lambda i: w[i:i + 2]) end) as g from w),
n as (select doc_id, count(*) as n from g group by doc_id),
p as (select a.doc_id as a, b.doc_id as b from g a join g b on a.g = b.g and a.doc_id <> b.doc_id join n x on x.doc_id = a.doc_id join n y on y.doc_id = b.doc_id
 group by a.doc_id, b.doc_id, x.n, y.n having count(*) >= 0.5 * (x.n + y.n - count(*))),
r(id, root) as (select distinct doc_id, doc_id from w union select p.b, r.root from r join p on p.a = r.id)
select r.id as doc_id, min(r.root) as class_id, (select count(*) from p where p.a = r.id) as n_links from r group by r.id
"""
ORACLES: dict[str, str] = {"op6_ngram_jaccard": _SIMILAR, "op5_embeddings": _LINKS.format(threshold=cover_tree.THRESHOLD), "embedding_links_wide": _LINKS.format(threshold=WIDE)}
