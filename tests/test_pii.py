import re

import pytest
from pyspark.sql import functions as F

from lodestone.functions.pii import PATTERNS, RECIPE, hits
from lodestone.operators import exposure

#: Forms that the reference's patterns accept, by category.
FORMS = {
    "phone": ["(555)-123-4567", "(555)1234567", "(555) 123-4567", "555.123.4567", "555 123 4567", "555\u00a0123\u00a04567"],
    "ssn": ["123-45-6789", "x-123-45-6789-y"],
    "email": ["a@b.org", "a.b+c@d-e.co.uk", "josé@bücher.de", "x@y.1"],
    "dob_kw": ["DOB", "dob: unknown", "D.O.B", "d.o.b. 1/2/90"],
    "alien_num": ["A# 123-456-789", "A123 456 789", "A#-123456789", "A 12345678", "A-123456789", "A#123456789"],
    "driver_lic": ["DLN 1234567", "OL#A1234567", "DL12345678", "OLN # AB12345"],
    "race_sex": ["W / M", "W/M", "B /F", "I/ M"],
    "possible_birthdate": ["03/04/2015", "03/04/1915", "3-4-1999"],
    "phone_compact": ["1234567890", "0000000000"],
}
NONE = ["", "plain words", "5551234567890", "A1234567", "A12345678901", "DL ABCDEFGH", "dl 1234567", "WW/M", "13/04/2015", "03/04/2115", "DOBERMAN", "a@b", "12-345-6789", "xA123456789"]


def test_patterns_accept_the_references_forms(spark):
    rows = [(k, t) for k, forms in FORMS.items() for t in forms] + [("", t) for t in NONE]
    got = spark.createDataFrame(rows, "kind string, text string").select("kind", "text", *[hits(F.col("text"), k).alias(k) for k in PATTERNS]).collect()
    for r in got:
        assert not r["kind"] or r[r["kind"]], (r["kind"], r["text"])
        assert {k for k in PATTERNS if r[k]} == {k for k, p in PATTERNS.items() if re.search(p, r["text"])}, r["text"]
    assert not [r for r in got if not r["kind"] and any(r[k] for k in ("phone", "ssn", "alien_num", "driver_lic", "race_sex", "possible_birthdate", "dob_kw"))]


@pytest.mark.parametrize(("text", "expected"), [("call (555)1234567", "call [PHONE]"), ("A#-123456789 x", "[A-NUMBER] x"), ("W / M, DOB", "[DESCRIPTOR], [DOB]"), ("DLN 1234567", "[LICENSE]"), ("on 03/04/2015", "on [DATE]"), ("1234567890", "1234567890")])
def test_redaction_of_the_references_forms(spark, text, expected):
    assert exposure.redact_text(text) == expected
    assert exposure.redact(spark.createDataFrame([(text,)], "t string"), "t").first()["t"] == expected


def test_recipe_counts_the_references_forms(spark):
    from lodestone.operators.recipe import run_recipe

    df = spark.createDataFrame([(t,) for k in RECIPE for t in FORMS[k]], "t string")
    got = {r["metric"]: r["value"] for r in run_recipe(df, {"text": "t"}, checks=["pii"]).collect()}
    assert got["n_records"] == df.count() and all(got[f"n_{k}"] >= len(FORMS[k]) for k in RECIPE)
