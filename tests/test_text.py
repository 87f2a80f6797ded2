import hashlib

import pytest
from pyspark.sql import functions as F

from lodestone.operators import citation, entities, evidence, exposure, pages


def test_sweep_weighs_texts(spark):
    df = spark.createDataFrame([(" call 555-123-4567 ",), ("call 555-123-4567",), ("W/M",), ("",), (None,)], "t string")
    got = {r["category"]: (r["weighted"], r["distinct_texts"]) for r in exposure.sweep(df, "t").collect()}
    assert got["phone"] == (2, 1) and got["strict"] == (2, 1) and got["broad"] == (3, 2) and got["nonblank"] == (3, 2)


def test_redaction():
    assert exposure.redact_text("a@b.org or 123-45-6789") == "[EMAIL] or [SSN]"
    assert exposure.redact_text("4155551234") == "4155551234"
    assert exposure.redact_text("saw Ann Lee", lambda t: [(4, 11)]) == "saw A.L."
    assert exposure.merge_spans([(0, 4, "a"), (2, 9, "b"), (9, 10, "c")]) == [(0, 9, "b"), (9, 10, "c")]
    assert exposure.redact_literals("aaa", ["aa"], "X") == "X" and exposure.initials("ann m. o'neil") == "A.M.O."


def test_redact_column(spark):
    df = spark.createDataFrame([("x 555-123-4567",), (None,), ("plain",)], "t string")
    assert [r["t"] for r in exposure.redact(df, "t").collect()] == ["x [PHONE]", None, "plain"]


def test_exhibit_guard(spark, tmp_path):
    (tmp_path / "vault").mkdir()
    vault = tmp_path / "vault"
    (tmp_path / "link").symlink_to(vault)
    for folder in (vault, vault / "x", vault / "y" / ".." / "x", tmp_path / "link" / "x"):
        for shape in ("{}", "file://{}", "file:{}"):
            for root in ("{}", "file://{}"):
                with pytest.raises(PermissionError):
                    exposure.write_exhibit(spark.range(1), shape.format(folder), [root.format(vault)])
    with pytest.raises(PermissionError):
        exposure.write_exhibit(spark.range(1), "s3://bucket/vault/a/../b", ["S3://bucket/vault/"])
    exposure.write_exhibit(spark.range(1), f"file://{tmp_path}/vault-not", [str(vault)])
    assert (tmp_path / "vault-not" / "_SUCCESS").exists()


def test_roles():
    roster, seen = [exposure.name_tokens("Ann O'Neil")], [exposure.name_tokens("Bo Ray")]
    role = lambda t, name: exposure.role_of(t, t.index(name), t.index(name) + len(name), roster, seen)
    assert role("saw Ann Marie O'Neil #4471", "Ann Marie O'Neil #4471") == "official" and role("with Bo Ray", "Bo Ray") == "involved"
    assert role("spoke to Cmdr. Jo Li", "Jo Li") == role("Det. Sgt. Jo Li", "Jo Li") == role("Marshal Jo Li", "Jo Li") == "official"
    assert role("spoke to Jo Li", "Jo Li") == "uninvolved" and role("the officer then told Jo Li", "Jo Li") == "uninvolved"


def test_redaction_against_brute_force(spark):
    """Each character that any pattern covers goes, and what stands for a run of covered ones is the longest span's."""
    import random
    import re

    rng = random.Random(3)
    bits = ["555-123-4567", "(555)1234567", "123-45-6789", "a.b@c.org", "DOB", "A# 123-456-789", "DLN 1234567", "W / M", "01/02/2015", "0123456789", "word", "é", "x@", "-", "OL A123456", " ", " ", ", "]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 9))) for _ in range(400)] + [None, ""]

    def slow(t):
        spans = [(m.start(), m.end(), k) for k, p in exposure.PATTERNS.items() if k not in exposure.REDACTION_EXEMPT for m in re.finditer(p, t)]
        group = list(range(len(spans)))
        for _ in spans:
            for i, a in enumerate(spans):
                for j, b in enumerate(spans):
                    if max(a[0], b[0]) < min(a[1], b[1]):
                        group[i] = group[j] = min(group[i], group[j])
        out, k = "", 0
        for g in sorted(set(group), key=lambda g: min(s[0] for s, x in zip(spans, group) if x == g)):
            own = [s for s, x in zip(spans, group) if x == g]
            longest = max(s[1] - s[0] for s in own)
            out += t[k : min(s[0] for s in own)] + exposure.PLACEHOLDERS[min((s for s in own if s[1] - s[0] == longest), key=lambda s: s[0])[2]]
            k = max(s[1] for s in own)
        return out + t[k:]

    got = exposure.redact(spark.createDataFrame(list(enumerate(texts)), "i int, t string"), "t").orderBy("i").collect()
    assert [r["t"] for r in got] == [t if t is None else slow(t) for t in texts]


def test_page_gate(spark):
    rows = [("d", ""), ("d", "the man of the house was there"), ("e", "x q"), ("f", "##@@!!%%&&** zz qq ww kk ==--++==--")]
    df = spark.createDataFrame(rows, "doc string, t string").withColumn("diagnosis", pages.diagnosis(F.col("t")))
    assert [r["diagnosis"] for r in df.collect()] == ["image_only", "native_ok", "uncertain_review", "garbled_text"]
    assert {r["doc"]: r["decision"] for r in pages.decide(df, "doc").collect()} == {"d": "ocr_images", "e": "review", "f": "force_full_doc_ocr"}
    stamps = spark.createDataFrame([("see ABC-000123 and X1",)], "t string")
    assert [r["stamp"] for r in pages.bates(stamps, "t").collect()] == ["ABC-000123"]


def test_windows_cover():
    text = "word " * 900
    w = entities.plan_windows(text)
    assert w[0][0] == 0 and w[-1][1] == len(text) and all(a < d <= b for (a, b), (d, _) in zip(w, w[1:])) and all(b - a <= 1400 for a, b in w)
    assert entities.plan_windows(" \n ") == [] and entities.plan_windows("a" * 6 + " " + "b" * 9, 10, 3) == [(0, 7), (4, 14), (11, 16)]  # a blank just at the edge counts
    assert entities.plan_windows("") == [] and len(entities.plan_windows("x" * 3000)) > 2
    with pytest.raises(ValueError):
        entities.plan_windows("x", 10, 10)


def test_window_function_in_sql(spark):
    entities.register_windows(spark)
    assert spark.sql("select window from plan_windows('hello', 10, 2)").first()[0] == "hello"


def test_dedup_spans():
    s = lambda a, b, score, label="p": {"label": label, "start": a, "end": b, "score": score}
    assert entities.dedup_spans([s(0, 4, 0.5), s(0, 4, 0.9)]) == [s(0, 4, 0.9)]
    assert entities.dedup_spans([s(0, 4, 0.5), s(2, 9, 0.4)]) == [s(2, 9, 0.4)]
    assert entities.dedup_spans([s(0, 4, 0.5), s(6, 12, 0.5), s(3, 8, 0.5)]) == [s(6, 12, 0.5)]  # in the order given
    assert entities.dedup_spans([s(3, 8, 0.5), s(0, 4, 0.5), s(6, 12, 0.5)]) == [s(6, 12, 0.5)]
    assert entities.dedup_spans([s(0, 4, 0.5), s(0, 4, 0.5, "q")]) == [s(0, 4, 0.5), s(0, 4, 0.5, "q")]


def diagnosed(spark, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [tuple(r) for r in df.orderBy("i").select(pages.diagnosis(F.col("t")), pages.density_ok(F.col("t")), pages.hit_rate(F.col("t"))).collect()]


def test_density_is_of_ascii_and_runs_end_at_space(spark):
    table_page = "2026 2026 14 18 SC OOS 49417 33021 2026 11 04 GA IN 88001 70215 2026 12 09 TX OOS"
    got = diagnosed(spark, table_page, "12 34 56 78 90 name", "ÄÖÜ ßß ЖЖЖ ДДД", ";;;;;;;;; word", "1234", "\x1c\x85 ")
    assert got[0][0] == "native_ok" and got[0][1] is True and got[1][1] is True
    assert got[2][1] is False and got[3][1] is False and got[4][2] is None and got[5][:2] == ("image_only", False)


@pytest.mark.parametrize(
    ("counts", "expected"),
    [((3, 1, 1, 0), "force_full_doc_ocr"), ((3, 0, 4, 3), "native"), ((0, 0, 1, 1), "review"), ((2, 0, 2, 0), "ocr_images"), ((0, 2, 2, 0), "force_full_doc_ocr"), ((1, 1, 3, 0), "native"), ((1, 0, 0, 1), "review")],
)
def test_decision_of_a_document(spark, counts, expected):
    """counts: pages that are image_only, garbled_text, native_ok, uncertain_review."""
    kinds = ("image_only", "garbled_text", "native_ok", "uncertain_review")
    df = spark.createDataFrame([("d", k) for k, n in zip(kinds, counts) for _ in range(n)], "doc string, diagnosis string")
    assert pages.decide(df, "doc").first()["decision"] == expected


PROV = "doc_id string, block_id string, text string, prov array<struct<page_no:int,bbox:struct<l:double,t:double,r:double,b:double>>>"
ONE, OTHER = [(1, (0.0, 1.0, 2.0, 3.0))], [(2, (9.0, 9.0, 9.0, 9.0))]


def built(spark, text, quote, prov=ONE):
    claims = spark.createDataFrame([("d", "b1", quote)], "doc_id string, block_id string, quote string")
    return citation.build_anchors(claims, spark.createDataFrame([("d", "b1", text, prov)], PROV), ["doc_id", "block_id"]).first()["anchor"].asDict()


def test_anchors_are_built(spark):
    error = lambda *a: built(spark, *a)["error"]
    assert [error("aaa", "aa"), error("cat", "ca"), error("a", " "), error("a", "b"), error("a cat", "cat", []), error("a cat", "cat", ONE + OTHER)] == ["ambiguous", "cuts_a_word", "blank_quote", "not_found", "not_single_prov", "not_single_prov"]
    a = built(spark, "x" * 40 + " é\U0001f600 cat sat", "cat")
    assert (a["char_start"], a["char_end"], a["prefix"], a["suffix"], a["page_no"]) == (44, 47, ("x" * 40 + " é\U0001f600 ")[-32:], " sat", 1)
    assert a["text_hash"] == hashlib.sha256(b"cat").hexdigest() and '"l":0.0' in a["bbox"] and a["error"] is None
    assert built(spark, "cat sat", "cat sat")["prefix"] == "" and error("police ICE police", "ICE") is None and error("police", "ice") == "cuts_a_word"


def resolved(spark, quote, old, blocks):
    """A quote's anchor in a block b1 on page 1, against other blocks: (block_id, text, prov)."""
    a = built(spark, old, quote)
    assert a["error"] is None
    row = ("r", "d", "b1", a["page_no"], quote, a["char_start"], a["char_end"], a["prefix"], a["suffix"], a["text_hash"])
    records = spark.createDataFrame([row], "record_id string, doc_id string, block_id string, page_no int, quote string, char_start int, char_end int, prefix string, suffix string, text_hash string")
    return citation.resolve_anchors(records, spark.createDataFrame([("d", *b) for b in blocks], PROV)).first()


OLD = "the cat sat here"


@pytest.mark.parametrize(
    ("blocks", "level", "page", "block", "start", "n"),
    [
        ([("b1", OLD, ONE)], "exact", 1, "b1", 4, 1),
        ([("b1", "one cat sat there", ONE)], "exact", 1, "b1", 4, 1),  # the quote's own digest counts, not the block's
        ([("b1", OLD, ONE + OTHER)], "block", None, "b1", None, 1),
        ([("b1", "gone", ONE), ("b7", OLD, OTHER)], "relocated", 2, "b7", 4, 1),
        ([("b7", OLD, ONE + OTHER)], "block", None, "b7", None, 1),
        ([("b1", "gone", ONE), ("b7", OLD, OTHER), ("b8", OLD, OTHER)], "ambiguous", None, None, None, 2),
        ([("b1", "gone", ONE), ("b7", "concatenate", OTHER)], "block", 1, "b1", None, 0),  # within a word, and without its neighbours
        ([("b1", "gone", ONE), ("b7", "a cat elsewhere", OTHER)], "block", 1, "b1", None, 0),
        ([("b7", "none", ONE)], "page", 1, None, None, 0),
        ([("b1", "gone", OTHER), ("b7", "none", ONE)], "page", 1, None, None, 0),
        ([("b7", "none", OTHER)], "unresolved", None, None, None, 0),
    ],
)
def test_anchors_are_resolved(spark, blocks, level, page, block, start, n):
    r = resolved(spark, "cat", OLD, blocks)
    assert (r["level"], r["page_no"], r["block_id"], r["char_start"], r["n_matches"]) == (level, page, block, start, n)
    assert (r["char_end"] == start + 3 if start is not None else r["char_end"] is None) and (r["bbox"] is not None) == (r["page_no"] is not None and level != "page")


def test_only_sure_citations_are_clean(spark):
    df = spark.createDataFrame([(x,) for x in ("exact", "relocated", "ambiguous", "block", "page", "unresolved")], "level string")
    assert [r["level"] for r in citation.clean(df).collect()] == ["exact", "relocated"]


def test_custody(spark, tmp_path):
    log = []
    for k in range(3):
        log = evidence.append(log, f"e{k}", now=f"t{k}", artifact_sha256="0", actor="é")
    schema = "seq long, time string, event string, artifact_sha256 string, actor string, prev_entry_sha256 string, entry_sha256 string"
    table = lambda rows: spark.createDataFrame([tuple(r.values()) for r in rows], schema)
    assert evidence.verify(table(log)).first()["valid"]
    assert not evidence.verify(table([log[0], log[2]])).first()["valid"]
    assert not evidence.verify(table([log[0], log[1] | {"event": "x"}, log[2]])).first()["valid"]
    assert evidence.verify(table([])).first()["valid"] and log[0]["prev_entry_sha256"] == "0" * 64
    assert not evidence.verify(table([log[0] | {"prev_entry_sha256": None}])).first()["valid"]
    (tmp_path / "f").write_bytes(b"abc")
    assert evidence.file_digests(spark, str(tmp_path)).first()["sha256"] == hashlib.sha256(b"abc").hexdigest()


def test_chains_against_the_log(spark):
    """Entries linked in Spark are those that append makes, whatever characters they hold."""
    rows = [("a", 1, "t1", 'say "é" \\ \n\t\x07 \x7f \U0001f600 ſ', "0" * 64, "me"), ("a", 2, "t2", "", "x", None), ("b", 1, "t", "plain", "y", "you"), (None, 3, "t", "null case", "z", "")]
    df = spark.createDataFrame(rows, "case string, k int, time string, event string, artifact_sha256 string, actor string")
    linked = evidence.chains(df, "case", "k")
    for case in ("a", "b", None):
        log = []
        for _, _, time, event, digest, actor in [r for r in rows if r[0] == case]:
            evidence.append(log, event, now=time, artifact_sha256=digest, actor=actor)
        got = [r.asDict() for r in linked.where(F.col("case").eqNullSafe(case)).drop("case").orderBy("seq").collect()]
        assert got == [dict(sorted(e.items(), key=lambda kv: list(got[0]).index(kv[0]))) for e in log]
    assert {(r["case"], r["valid"], r["n_entries"]) for r in evidence.verify(linked, "case").collect()} == {("a", True, 2), ("b", True, 1), (None, True, 1)}


def test_custody_logs_move_once(spark):
    """F8: what links the entries of a case also checks them, without another shuffle; gaps, repeats and nulls are told as before."""
    events = spark.createDataFrame([("a", i, f"t{i}", "e", "0", None) for i in range(5)] + [("b", 1, "t", "e", "0", "x")], "case string, k int, time string, event string, artifact_sha256 string, actor string")
    log = evidence.chains(events, "case", "k")
    checked = evidence.verify(log, "case", [F.max_by("entry_sha256", "seq").alias("last")])
    assert checked._jdf.queryExecution().sparkPlan().toString().count("Window") == 1
    assert checked._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    last = {r["case"]: r["entry_sha256"] for r in log.orderBy("seq").collect()}
    assert {(r["case"], r["valid"], r["last"]) for r in checked.collect()} == {(c, True, last[c]) for c in "ab"}
    valid = lambda df: [r["valid"] for r in evidence.verify(df.where("case = 'a'"), "case").collect()]
    null = log.withColumn("seq", F.when(F.col("seq") != 2, F.col("seq")))
    assert valid(log.where("seq <> 2")) == valid(log.where("seq <> 0")) == valid(log.union(log.where("seq = 4"))) == valid(null) == [False]
    assert valid(log.where("seq < 3")) == [True]


def test_a_text_meets_its_quotes_once(spark):
    """the claims of a block are one row with its text, whatever their number; claims without a block, null keys and quotes and other columns stay."""
    claims = [("a", w, i) for i, w in enumerate(["one", "two", "ne t", "", None, "two three", "four", "aa", "é\U0001f600"])] + [("b", "x", 9), (None, "one", 10), ("c", "one", 11)]
    blocks = spark.createDataFrame([("a", "one two three two, aaa é\U0001f600"), ("b", None), (None, "one"), ("d", "one")], "k string, text string")
    out = citation.build_anchors(spark.createDataFrame(claims, "k string, quote string, nth int"), blocks, ["k"], 3)
    assert out.columns == ["k", "quote", "nth", "anchor"]
    assert "collect_list" in out._jdf.queryExecution().analyzed().toString().split("Join", 1)[1]
    got = {r["nth"]: r["anchor"] for r in out.collect()}
    assert {i: a["error"] for i, a in got.items()} == {0: None, 1: "ambiguous", 2: "cuts_a_word", 3: "blank_quote", 4: "blank_quote", 5: None, 6: "not_found", 7: "ambiguous", 8: None, 9: "not_found", 10: "not_found", 11: "not_found"}
    assert [got[5][c] for c in ("char_start", "char_end", "prefix", "suffix")] == [4, 13, "ne ", " tw"] and got[0]["prefix"] == "" and got[8]["suffix"] == "" and got[8]["char_start"] == 23
