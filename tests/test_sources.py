import io
import zipfile

import pytest

from lodestone.plans.surface import canned, safe_sql, search, token_index
from lodestone.sources import tables as S


def test_id_like():
    for yes in ("zip", "ZIPCode", "case_number", "caseID", "Phone 2", "user_id", "dob", "account", "driverLicense", "SSNField", "zip5"):
        assert S.is_id_like(yes), yes
    for no in ("router", "valid", "zipper_count", "amount", "idle", "number_of_searches", "postal", "badge", "accounts"):
        assert not S.is_id_like(no), no


def test_csv_keeps_identifiers(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('zip,case_number,amount,middle_name,note\n07054,0012,1.5,,"a, ""b""\nc"\n00501,NULL,2, ,N/A\n')
    df, report = S.load_table(spark, str(p))
    rows = df.collect()
    assert dict(df.dtypes) == {"zip": "string", "case_number": "string", "amount": "double", "middle_name": "string", "note": "string"}
    assert [r["zip"] for r in rows] == ["07054", "00501"] and rows[1]["case_number"] == "NULL" and rows[1]["note"] == "N/A"
    assert rows[0]["middle_name"] is None and rows[1]["middle_name"] is None and rows[0]["note"] == 'a, "b"\nc'
    assert report.encoding == "utf-8" and any("middle_name" in a for a in report.anomalies)


def test_junk_header_latin_and_fill(spark, tmp_path):
    p = tmp_path / "b.csv"
    p.write_bytes("junk\nmore,junk\ngroup,item,zip\nG\xe9,1,01\n,2,02\nH,3,03\n".encode("latin-1"))
    df, report = S.load_table(spark, str(p), skip_lines=2, forward_fill_columns=["group", "nope"])
    assert [tuple(r) for r in df.collect()] == [("Gé", 1, "01"), ("Gé", 2, "02"), ("H", 3, "03")]
    assert report.low_confidence


@pytest.mark.parametrize(("encoding", "end"), [("utf-8", "\n"), ("utf-8", "\r\n"), ("latin-1", "\n"), ("utf-16", "\n")])
def test_line_breaks_in_quotes_below_junk(spark, tmp_path, encoding, end):
    p = tmp_path / "c.csv"
    p.write_bytes(end.join(["junk", 'more "junk', "zip,note,n", '01,"two', 'lines"', "02,x,5", ""]).replace('lines"', 'lines",4').encode(encoding))
    df, report = S.load_csv(spark, str(p), skip_lines=2, encoding="utf-16" if encoding == "utf-16" else None)
    assert [tuple(r) for r in df.collect()] == [("01", "two\nlines", 4), ("02", "x", 5)]


def test_lines_by_number_and_long_headers(spark, tmp_path):
    p = tmp_path / "d.csv"
    wide = ",".join(f"column_{k}" for k in range(20_000))
    p.write_text(f"junk\n{wide}\nunits\n" + ",".join(["1"] * 20_000) + "\n")
    df, _ = S.load_csv(spark, str(p), skip_lines=[0, 2], infer=False)
    assert len(df.columns) == 20_000 and df.select("column_19999").first()[0] == "1" and df.count() == 1
    (tmp_path / "e.csv").write_text("")
    with pytest.raises(ValueError):
        S.load_csv(spark, str(tmp_path / "e.csv"))


def test_fill_across_partitions(spark):
    df = spark.createDataFrame([(k, "v" + str(k) if k in (3, 11, 12) else None, None) for k in range(40)], "k int, v string, w string").repartitionByRange(7, "k").sortWithinPartitions("k")
    got = S.filled_in_order(df, ["v", "w"]).orderBy("k").collect()
    assert [r["v"] for r in got] == [None] * 3 + ["v3"] * 8 + ["v11"] + ["v12"] * 28 and all(r["w"] is None for r in got)


def sheet(rows, merges=()):
    ref = lambda r, c: f"{chr(65 + c)}{r + 1}"
    cell = lambda r, c, v: f'<c r="{ref(r, c)}" t="inlineStr"><is><t>{v}</t></is></c>' if isinstance(v, str) else f'<c r="{ref(r, c)}"><v>{v}</v></c>'
    body = "".join("<row>" + "".join(cell(r, c, v) for c, v in enumerate(row) if v is not None) + "</row>" for r, row in enumerate(rows))
    merged = "<mergeCells>" + "".join(f'<mergeCell ref="{m}"/>' for m in merges) + "</mergeCells>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{body}</sheetData>{merged}</worksheet>')
    return out.getvalue()


def test_xlsx(spark, tmp_path):
    p = tmp_path / "c.xlsx"
    p.write_bytes(sheet([["label", "case_id", "n"], ["x", 7054.0, 1.5], [None, 9007199254740993.0, 2]], ["A2:A3"]))
    df, report = S.load_table(spark, str(p))
    rows = df.collect()
    assert [r["label"] for r in rows] == ["x", "x"] and rows[0]["case_id"] == "7054" and rows[1]["n"] == 2.0 and report.warnings


def test_served_fails_closed(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "s"), (2, "b", "t")], "id int, name string, secret string")
    with pytest.raises(ValueError):
        S.served(df, [])
    with pytest.raises(ValueError):
        S.served(df, ["nope"])
    assert S.served(df, ["id", "secret"], exclude=["secret"]).columns == ["id"]
    with pytest.raises(ValueError):
        S.publish(df.union(df), str(tmp_path / "t"), ["id"], pk=["id"])
    out = S.publish(df, str(tmp_path / "t"), ["id", "name"], pk=["id"])
    assert safe_sql(spark, "select name from records where id = 1").first()[0] == "a"
    with pytest.raises(PermissionError):
        safe_sql(spark, "drop view records")
    assert [r["id"] for r in search(token_index(out, "id", ["name"]), "A", "id").collect()] == [1]


def test_canned(spark):
    rows = [("IN", "Other", False, 5, True, "Open", 3), ("OOS", "Drugs", True, None, False, "Open", None), ("OOS", "Drugs", True, 2, None, None, 3)]
    spark.createDataFrame(rows, "geo string, reason_cat string, is_immigration boolean, nets int, has_case boolean, base_type string, hour_et int").createOrReplaceTempView("records")
    got = lambda name: [tuple(r) for r in canned(spark, name).collect()]
    assert got("record_count") == [(3,)] and got("geo_breakdown") == [("OOS", 2), ("IN", 1)] and got("immigration_count") == [(2,)]
    assert got("reason_category_breakdown") == [("Drugs", 2), ("Other", 1)] and got("automation_by_hour") == [(None, 1), (3, 2)]
    assert got("case_presence") == [(3, 1)] and got("base_type_breakdown") == [("Open", 2), (None, 1)] and len(got("sample_rows")) == 3
    assert safe_sql(spark, "select explode(sequence(1, 5000)) as x from records").count() == 15_000
    assert safe_sql(spark, "select * from records", 2).count() == 2
    with pytest.raises(ValueError):
        canned(spark, "nope")


def test_slice(spark):
    df = spark.createDataFrame([("b", 2), (" ", None), ("a", 3), ("a", 1)], "x string, y int")
    assert [tuple(r) for r in S.public_slice(df, 2).collect()] == [("a", 1), ("a", 3)]
    with pytest.raises(ValueError):
        S.public_slice(df, 0)


def test_bundle(spark, tmp_path):
    e = spark.createDataFrame([("1", "a")], "id string, name string")
    p = spark.createDataFrame([("s", "1")], "statement_id string, target_id string")
    S.write_bundle(e, p, str(tmp_path / "b"), {"dataset": "d"})
    assert S.read_bundle(spark, str(tmp_path / "b"))[0].count() == 1


def test_filled_by_a_column_in_stretches(spark, monkeypatch):
    """values are carried on over any number of ranges, of which each is filled in a place of its own."""
    monkeypatch.setattr(S, "FILL_BITS", 3)
    rows = [(i, None if i % 7 or i < 14 else f"v{i}", "x") for i in range(300)]
    want, last = {}, None
    for i, v, _ in rows:
        last = want[i] = v or last
    df = spark.createDataFrame(rows, "k long, v string, x string").repartition(3)
    out = S.filled_by(df, ["v"], "k")
    assert out.columns == ["k", "v", "x"] and {r["k"]: r["v"] for r in out.collect()} == want and out.count() == 300
    assert out._jdf.queryExecution().analyzed().toString().count("Repartition") == 0
    one = S.filled_in_order(df.coalesce(1).sortWithinPartitions("k"), ["v"])
    assert {r["k"]: r["v"] for r in one.collect()} == want
    assert S.filled_by(df.limit(0), ["v"], "k").count() == 0
