"""The pipeline against its stages' operators, one after the other, and the queries of this subpackage on small tables."""

import os
from collections import Counter

import brute
import pytest

import corpus_pipeline as C
from lodestone.llm import mixing, secrets, sentence_pieces, toxicity
from lodestone.llm import queries as Q
from lodestone.llm.common import table

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")  # smaller tables have too few labels to learn from


def test_stages_decide(spark, tmp_path):
    docs = table(spark, DATA, "documents")
    columns, counts = docs.columns, [docs.count()]
    for k, (name, stage) in enumerate(C.STAGES):
        out = stage(spark, docs, DATA)
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        counts.append(docs.count())
        assert k == len(C.STAGES) - 1 or docs.columns == columns, name
    assert counts[0] > counts[1] > counts[2] == counts[3] == counts[4] == counts[5]
    assert docs.where("n_ids is null or n_ids <> size(ids)").count() == 0
    assert C.run(spark, DATA).count() == counts[-1]


def tables(spark, tmp_path, docs, labels):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


def test_run_against_brute_force(spark, tmp_path):
    """Each stage's decisions in plain Python, on what the second version of the stage before kept; the model is the operator's."""
    sentencepiece = pytest.importorskip("sentencepiece")
    d = tables(spark, tmp_path, table(spark, DATA, "documents").where("doc_id is not null").repartition(3), table(spark, DATA, "labels"))
    docs = {r["doc_id"]: r for r in table(spark, d, "documents").collect()}
    model = toxicity.fit(table(spark, d, "documents"), table(spark, d, "labels"))
    clean = {i: r["text"] for i, r in docs.items() if brute.up_to(r["text"], model)[0] < toxicity.TOXIC_FROM}
    kept = {i: clean[i] for i, (root, _) in brute.groups(clean).items() if root == i}
    assert len(docs) > len(clean) > len(kept)
    slow = brute.Secrets(kept.values(), secrets)
    plain = {i: t if t is None else slow.redacted(t) for i, t in kept.items()}
    assert any(plain[i] != kept[i] for i in plain)
    sizes = Counter(docs[i]["source"] for i in plain)
    whole = sum(n**mixing.SMOOTHING for n in sizes.values())
    rate = {s: n**mixing.SMOOTHING / whole * len(plain) / n for s, n in sizes.items()}
    got = C.run(spark, d).collect()
    copies = Counter(r["doc_id"] for r in got)
    assert len(got) == len(plain) and set(copies) <= set(plain)
    for i in plain:  # which of them win is random: how many there are isn't
        r = rate[docs[i]["source"]]
        assert int(r + 1e-9) <= copies[i] <= int(r + 1e-9) + 1
    by_source = Counter(docs[r["doc_id"]]["source"] for r in got)
    assert all(abs(by_source[s] - rate[s] * n) < 1 + 1e-6 for s, n in sizes.items())
    own = sentencepiece.SentencePieceProcessor(model_file=sentence_pieces.MODEL)
    ids = {i: own.encode(plain[i]) if plain[i] is not None else None for i in copies}
    assert all(r["ids"] == ids[r["doc_id"]] and r["n_ids"] == (None if r["ids"] is None else len(r["ids"])) for r in got)


@pytest.mark.parametrize("labelled", [True, False])
def test_odd_tables_pass_every_stage(spark, tmp_path, odd, none, labelled):
    labels = spark.createDataFrame([(1, 1, 0), (None, 1, 1), (2, None, None), (4, 0, 1), (4, 0, 0)] if labelled else [], "doc_id long, quality int, toxic int")
    d = tables(spark, tmp_path, odd, labels)
    docs = odd
    for k, (name, stage) in enumerate(C.STAGES):
        assert stage(spark, none, d).count() == 0, name
        out = stage(spark, docs, d)
        if k < len(C.STAGES) - 1:
            assert out.columns == odd.columns, name
            out.write.parquet(str(tmp_path / f"stage{k}"))
            docs = spark.read.parquet(str(tmp_path / f"stage{k}"))
    rows = C.run(spark, d).collect()
    assert len(rows) == docs.count() and {r["ids"] is None for r in rows if r["doc_id"] == 0} <= {True}


def test_empty_tables(spark, tmp_path, none):
    d = tables(spark, tmp_path, none, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert C.run(spark, d).count() == 0


#: Of each query: the column that names a row's input, its table, and whether each row of it has a row at least, or one at most.
WHOLE = {
    "op1_toxicity": ("doc_id", "documents", "doc_id"), "op2_html": ("page_id", "pages", "page_id"), "op4_sentencepiece": ("doc_id", "documents", "doc_id"), "op5_embeddings": ("vec_id", "embeddings", "vec_id"),
    "op6_ngram_jaccard": ("doc_id", "documents", "doc_id"), "op7_fingerprints": ("doc_id", "documents", "doc_id"), "embedding_links_wide": ("vec_id", "embeddings", "vec_id"),
}


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_queries_cover_their_tables(spark, name):
    df = Q.QUERIES[name](spark, DATA)
    if name in WHOLE:
        column, source, key = WHOLE[name]
        assert {r[0] for r in df.select(column).collect()} == {r[0] for r in table(spark, DATA, source).select(key).collect()}
    elif name == "op10_warc":
        assert df.where("is_last").count() == table(spark, DATA, "pages").count() == df.where("verified").count()
    elif name == "op9_mixing":
        assert df.count() == table(spark, DATA, "documents").count()
    else:  # op3 and op8 report what they find
        found = df.count()
        assert 0 < found and df.select("doc_id").distinct().count() > 5
