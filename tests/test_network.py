import pytest
from pyspark.sql import functions as F

from lodestone.operators import documents as D
from lodestone.operators import network as N


def test_extract(spark):
    def fake(texts):
        return [[{"start": t.index("Ann"), "end": t.index("Ann") + 3, "label": "person", "score": 0.9}] if "Ann" in t else [] for t in texts]

    pages = spark.createDataFrame([("d", 1, "x " * 650 + "Ann here " + "y " * 400, True), ("e", 1, "Ann", False), ("f", 1, None, True)], "doc_id string, page int, text string, trustworthy boolean")
    got = N.extract(pages, fake).collect()
    assert [(r["doc_id"], r["start"], r["text"]) for r in got] == [("d", 1300, "Ann")]
    assert [r["doc_id"] for r in N.refused(pages).collect()] == ["e"]


def test_token_intervals(spark):
    rows = [("d", 1, 0, 1, "b", 0, 4, 0.9), ("d", 1, 0, 1, "a", 0, 4, 0.9), ("d", 1, 0, 1, "c", 0, 3, 1.0)]
    df = spark.createDataFrame(rows, "doc_id string, page int, first int, last int, label string, start int, end int, score double")
    assert [r["label"] for r in N.token_intervals(df).collect()] == ["a"]


def test_reader(spark):
    corpus = spark.createDataFrame([("1", "Ann Lee", "own"), ("2", "Ann Bo", "own"), ("3", "Ann Lee", "other")], "id string, name string, dataset string")
    r = N.Reader(corpus, ["own"], "own")
    assert [x["id"] for x in r.search("lee ann").collect()] == ["1"] and r.search("ann", limit=1).count() == 1
    assert r.get_entity("3").count() == 0 and [tuple(x) for x in r.list_datasets().collect()] == [("own", 2)]
    with pytest.raises(PermissionError):
        r.search("x", ["own", "other"])
    assert [x["entity_id"] for x in r.match(spark.createDataFrame([("q", "Ann Lee")], "id string, name string"), threshold=0.9).collect()] == ["1"]


def test_corpus(spark, tmp_path):
    rows = [("1", "Person", "Ann", ["A.", "Ann"]), ("2", "Company", "Co", None)]
    df = spark.createDataFrame(rows, "canonical_id string, schema string, caption string, aliases array<string>")
    a = N.write_corpus(df, str(tmp_path / "a"), "own")
    b = N.write_corpus(df.repartition(3), str(tmp_path / "b"), "own")
    assert a == b and a["n"] == 2
    assert N.corpus_rows(df).first()["properties"]["name"] == ["Ann", "A."]
    with pytest.raises(Exception, match="has no caption"):
        N.corpus_rows(df.withColumn("caption", F.lit(None).cast("string"))).collect()


def test_redaction_leads(spark):
    files = spark.createDataFrame([("a", bytearray(b"x %%EOF y %%EOF")), ("b", bytearray(b"%%EOF"))], "path string, content binary")
    none = dict.fromkeys(D.SEVERITIES, lambda data: [])
    got = {r["path"]: r for r in D.check_redactions(files, {k: v for k, v in none.items() if k != "incremental_save"}).collect()}
    assert not got["a"]["safe_to_publish"] and got["b"]["safe_to_publish"]
    assert not any(r["safe_to_publish"] for r in D.check_redactions(files).collect())  # other checks are missing

    def dies(data):
        raise RuntimeError

    bad = D.check_redactions(files, {k: v for k, v in none.items() if k != "incremental_save"} | {"metadata": dies})
    assert all(r["unavailable"] == ["metadata"] and not r["safe_to_publish"] for r in bad.collect())
    leaky = D.check_redactions(files, {"metadata": lambda data: [("author Ann", "Ann")]})
    with pytest.raises(Exception, match="local evidence"):
        D.publishable(leaky).collect()
    assert "local" not in D.publishable(D.check_redactions(files, {"metadata": lambda data: [("an author", "Ann")]})).first()["findings"][0].asDict()


def test_flags(spark):
    nan = float("nan")
    rows = [  # document, diagnosis, OCR ran, its score, review, partial, unavailable, reason
        ("a", "native_ok", False, nan, False, False, False, None),
        ("b", "garbled_text", False, 0.9, False, False, False, "garbled text layer"),
        ("c", "uncertain_review", None, None, None, None, None, "uncertain: too little signal to trust the text layer"),
        ("d", "image_only", False, nan, False, False, False, "image-only page not OCR'd"),
        ("e", "image_only", True, 0.95, False, False, False, None),
        ("f", "image_only", True, 0.7, False, False, False, "low OCR confidence (0.70)"),
        ("g", "native_ok", False, 0.1, False, False, False, None),  # no OCR: its score says nothing
        ("h", "native_ok", True, nan, False, False, False, None),
        ("i", "native_ok", False, nan, True, True, True, "review: document not trustworthy for unattended extraction"),
        ("j", "native_ok", False, nan, False, True, False, "partial conversion"),
        ("k", "native_ok", False, nan, False, False, True, "preprocessing requested but unavailable"),
    ]
    df = spark.createDataFrame(rows, "doc string, diagnosis string, ocr boolean, score double, review boolean, partial boolean, gone boolean, expected string")
    got = df.withColumn("flag_reason", D.flag_reason(F.col("diagnosis"), F.col("ocr"), F.col("score"), F.col("review"), F.col("partial"), F.col("gone")))
    assert [r["flag_reason"] for r in got.orderBy("doc").collect()] == [r[-1] for r in rows]
    assert {r["doc"]: r["trustworthy"] for r in D.trustworthy(got, "doc").collect()} == {r[0]: r[-1] is None for r in rows}
