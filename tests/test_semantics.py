from pyspark.sql import functions as F

from lodestone.functions.semantics import blank_to_null, has_keyword, instant, keyword_pattern, number, present, stable_id, stripped, whole
from lodestone.operators.derive import derive_columns, split_category, state_of


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x")).alias("y")).first()["y"]


def test_blanks(spark):
    assert one(spark, "\t a \n", stripped) == "a"
    for blank in ("", "  ", "\t", None):
        assert one(spark, blank, present) is False
        assert one(spark, blank, blank_to_null) is None
    for there in ("***", "N/A", "null", "0"):
        assert one(spark, there, present) is True


def test_keywords_are_whole_words(spark):
    flag = lambda t, words: one(spark, t, lambda c: has_keyword(c, words))
    assert flag("an ICE detainer", ["ice"]) and not flag("Assist local police", ["ice"])
    assert not flag("éice", ["ice"]) and not flag(None, ["ice"]) and not flag("ice", []) and flag("C++ (x)", ["(x)"]) is False
    assert flag("traffic stop, now", ["traffic stop"])
    assert keyword_pattern(["", " "]) is None


def test_numbers(spark):
    for text, expected in (("5d", None), ("1e3", 1000.0), (" 7 ", 7.0), ("0x1", None), ("nan", None), ("-.5", -0.5), ("", None)):
        assert one(spark, text, number) == expected
    for text, expected in (("2.5", 2), ("3.5", 4), ("x", None)):
        assert one(spark, text, whole) == expected


def test_instants(spark):
    at = lambda t, zone="America/New_York": (lambda v: v and v.isoformat())(one(spark, t, lambda c: instant(c, "string", zone).cast("timestamp_ntz")))
    assert at("2024-01-05T10:00:00-05:00") == "2024-01-05T15:00:00"
    assert at("2024-07-01 10:00:00") == "2024-07-01T14:00:00"
    assert at("01/05/2024, 01:02:03 PM", "UTC") == "2024-01-05T13:02:03"
    assert at("2024-03-10 02:30:00") is None and at("2024-11-03 01:30:00") is None  # skipped, repeated
    assert at("12:30") is None and at("2024") is None and at("soon") is None and at(None) is None


def test_ids(spark):
    import hashlib

    assert one(spark, "é", lambda c: stable_id("ns", c, F.lit(None))) == hashlib.sha256("ns|é|None".encode()).hexdigest()[:40]


def test_derivations(spark):
    df = spark.createDataFrame([(" sc ", "Traffic - stop", "2.5", "***"), ("GA", None, "x", " "), (None, "warrant", None, None)], "s string, r string, n string, c string")
    out = derive_columns(df, {"geo": {"column": "s", "home": "SC"}, "reason": {"column": "r", "categories": {"T": ["traffic"], "S": ["stop"]}}, "nets": {"column": "n"}, "has_case": {"column": "c"}}).collect()
    assert [r["geo"] for r in out] == ["IN", "OOS", "UNK"]
    assert [r["reason_cat"] for r in out] == ["T", "Other", "Other"] and out[1]["reason_text"] is None
    assert [r["nets"] for r in out] == [2, None, None] and [r["has_case"] for r in out] == [True, False, False]


def test_unknown_derivation_raises(spark):
    import pytest

    with pytest.raises(ValueError):
        derive_columns(spark.range(1), {"geos": {}})
    with pytest.raises(ValueError):
        derive_columns(spark.createDataFrame([("a",)], "c string"), {"has_case": {"column": "c", "absent": [" "]}})


def test_states_and_splits(spark):
    assert one(spark, "Town PD GA via SC XX", state_of) == "SC" and one(spark, "none", state_of) is None
    assert one(spark, "Houston Tx PD", state_of) == "TX" and one(spark, "South Carolina Law Enforcement", state_of) == "SC"
    assert one(spark, "a - b - c", lambda c: split_category(c)[1]) == "b - c" and one(spark, "a", lambda c: split_category(c)[1]) is None
