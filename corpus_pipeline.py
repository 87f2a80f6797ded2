"""From raw documents to token ids: each stage works on all that the one before kept.

What holds for every stage: an empty table gives an empty one; nulls in any column stay nulls and lead to no error; further
columns, whatever their names, stay as they are (the last stage returns doc_id, ids and n_ids alone); repeated rows are rows of
their own, alike in what is decided on their text. What else a stage does with odd rows is in its docstring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import mixing, ngram_join, secrets, sentence_pieces, toxicity
from lodestone.llm.common import table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The classifier is fitted on labelled documents of the raw table; documents that it calls toxic go.

    A null or empty text has no features and stays; texts of any length are judged whole; without labelled rows of either kind,
    or an empty labels table, nothing is toxic; labels without a doc_id or a toxic value don't count, and of labels that repeat a
    doc_id a toxic one decides."""
    model = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is linked by Jaccard similarity of word n-grams stays, the one of the least id.

    Null, empty and wordless texts and rows without doc_id are in no group and stay; texts of any length count whole; ties
    can't be, as ids differ; rows that repeat a doc_id are one document, linked where any of their texts is, and stay or go together."""
    return ngram_join.keep_one(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; secrets in its text give way to a mark, and n_chars follows. The tests' tables come from these documents.

    Null and empty texts stay as they are; texts of any length are scanned whole; equal runs are treated alike."""
    return secrets.redact(docs, secrets.learn(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target weight gives it copies: none, one or more.

    A null source is a source; null and empty texts count like others; which of equal chances win is a matter of the seed and of
    where a row lies in the table."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and n_ids of each copy. A null text has null ids, an empty one none; texts of any length are encoded whole."""
    return sentence_pieces.encode(docs, check=False)


STAGES = [("toxicity", drop_toxic), ("ngram_jaccard", drop_near_duplicates), ("secrets", redact_secrets), ("mixing", mix_sources), ("sentencepiece", encode)]

#: A fitted classifier, tests of randomness, rounding at random and tokens are beyond SQL. tests/llm/test_pipeline.py holds what
#: run() returns, and each stage, against a second version in plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES one after the other on the documents of sf_dir, each but the last written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
