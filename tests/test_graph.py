import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import entities as E
from lodestone.operators import resolution as R


def test_clusters(spark):
    rng = random.Random(3)
    edges = [(str(rng.randrange(200)), str(rng.randrange(200))) for _ in range(120)] + [(f"c{i:03}", f"c{i + 1:03}") for i in range(60)]
    got = {r["id"]: r["root"] for r in R.clusters(spark.createDataFrame(edges, "left_id string, right_id string")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    assert got == {x: find(x) for e in edges for x in e}


def test_as_many_edges_as_rows(spark):
    """clusters of a product of pairs come from edges that are as many as the rows of both sides."""
    left, right = [(k, f"a{i:02}") for i in range(30) for k in (i % 4,)] + [(None, "a98"), (9, "a99")], [(k, f"b{i:02}") for i in range(20) for k in (i % 3,)] + [(None, "b98"), (8, "b99")]
    a, b = spark.createDataFrame(left, "k int, left_id string"), spark.createDataFrame(right, "k int, right_id string")
    edges = R.connected_by(a, b, "k")
    assert edges.count() <= len(left) + len(right)
    assert {tuple(r) for r in R.clusters(edges).collect()} == {tuple(r) for r in R.clusters(a.join(b, "k").select("left_id", "right_id")).collect()}


def test_bands(spark):
    df = spark.createDataFrame([(0.98,), (0.7,), (0.69,)], "s double")
    assert [r[0] for r in df.select(R.bucket(F.col("s"))).collect()] == ["auto", "review", "distinct"]
    with pytest.raises(Exception, match="must be a number"):
        spark.createDataFrame([(float("nan"),)], "s double").select(R.bucket(F.col("s"))).collect()


def test_candidates_and_verdicts(spark):
    ents = spark.createDataFrame([("1", "Person", "John Smith"), ("2", "Person", "SMITH, John"), ("3", "Person", "Jon Smyth"), ("4", "Company", "John Smith"), ("5", "Person", None)], "id string, schema string, name string")
    pairs = R.candidates(ents)
    assert ("1", "3") in {(r["left_id"], r["right_id"]) for r in pairs.collect()} and "4" not in {r["right_id"] for r in pairs.collect()}
    rows, digest = R.packet(pairs)
    judged = R.apply_verdicts(pairs, [{"left_id": rows[0]["left_id"], "right_id": rows[0]["right_id"], "verdict": "merge"}], digest)
    assert judged.where("judgement = 'merge'").count() == 1
    with pytest.raises(ValueError):
        R.apply_verdicts(pairs.limit(0), [], digest)
    with pytest.raises(ValueError):
        R.parse_verdicts('{"packet_hash": "x", "verdicts": [{"verdict": "maybe"}]}')


def test_snapshot(spark):
    ents = spark.createDataFrame([("a", "Person", "Ann", ["A."]), ("b", "Person", "Anne", None), ("c", "Company", "Co", None)], "id string, schema string, name string, aliases array<string>")
    edges = spark.createDataFrame([("e1", "Ownership", "a", "c", None), ("e2", "Ownership", "b", "c", None), ("e3", "Link", "a", "b", None)], "edge_id string, schema string, head_id string, tail_id string, role string")
    prov = spark.createDataFrame([("s1", "a"), ("s2", "e2"), ("s3", "e3")], "statement_id string, target_id string")
    ents2, edges2, prov2 = R.snapshot(ents, edges, prov, spark.createDataFrame([("a", "b")], "left_id string, right_id string"))
    people = {r["caption"]: r for r in ents2.collect()}
    assert set(people) == {"Ann", "Co"} and people["Ann"]["aliases"] == ["A.", "Anne"] and people["Ann"]["member_ids"] == ["a", "b"]
    assert [r["edge_ids"] for r in edges2.collect()] == [["e1", "e2"]] and {r["statement_id"] for r in prov2.collect()} == {"s1", "s2"}
    assert R.dangling(ents2, edges2, prov2).count() == 0
    assert people["Ann"]["properties"] == {} and people["Ann"]["provenance_refs"] == ["s1"]


def test_merged_properties(spark):
    """Each key has the values of all members, in order of their ids, each where it comes first."""
    ents = spark.createDataFrame([("b", "Person", "Anne", None, {"country": ["us", "fr"], "birthDate": ["1970"]}), ("a", "Person", "Ann", None, {"country": ["fr", "de"]}), ("c", "Company", "Co", None, None)], "id string, schema string, name string, aliases array<string>, properties map<string,array<string>>")
    edges = spark.createDataFrame([("e2", "Ownership", "b", "c", None, {"share": ["2", "1"]}), ("e1", "Ownership", "a", "c", None, {"share": ["1"], "date": ["x"]})], "edge_id string, schema string, head_id string, tail_id string, role string, properties map<string,array<string>>")
    prov = spark.createDataFrame([("s2", "e2"), ("s1", "e1"), ("s3", "b")], "statement_id string, target_id string")
    ents2, edges2, _ = R.snapshot(ents, edges, prov, spark.createDataFrame([("a", "b")], "left_id string, right_id string"))
    got = {r["caption"]: r for r in ents2.collect()}
    assert got["Ann"]["properties"] == {"country": ["fr", "de", "us"], "birthDate": ["1970"]} and got["Co"]["properties"] == {}
    (edge,) = edges2.collect()
    assert edge["properties"] == {"share": ["1", "2"], "date": ["x"]} and edge["provenance_refs"] == ["s1", "s2"] and got["Ann"]["provenance_refs"] == ["s3"]
    from lodestone.operators import network as N

    assert {r["caption"]: r["properties"].get("country") for r in N.corpus_rows(ents2).collect()} == {"Ann": ["fr", "de", "us"], "Co": None}
    assert {r["id"]: r["properties"]["name"] for r in N.match_queries(ents2).collect()}[got["Ann"]["canonical_id"]] == ["Ann", "Anne"]
    assert [tuple(r) for r in R.degrees(edges, 1, "head_id", "tail_id").collect()] == [("c", 2)]


def test_a_run_and_its_second_half(spark, tmp_path):
    for name, rows in (("x", [("1", "Person", "John Smith"), ("2", "Person", "Smith, John")]), ("y", [("3", "Person", "Jon Smyth"), ("4", "Company", "John Smith")])):
        spark.createDataFrame(rows, "id string, schema string, name string").write.json(str(tmp_path / name / "entities"))
    bundles, folder = [str(tmp_path / "x"), str(tmp_path / "y")], str(tmp_path / "run")
    run = R.resolve(spark, bundles, folder, generated_at="t")
    assert R.config_from_run(spark, folder) == run and run["n_auto"] == 1 and run["n_review"] == 1
    assert R.resolve(spark, bundles[::-1], str(tmp_path / "again"), generated_at="u")["packet_hash"] == run["packet_hash"]
    assert R.investigation_of(bundles) == R.investigation_of(bundles[::-1]) == run["investigation_id"]
    found, _ = R.resolved_run(spark, folder, [{"left_id": "1", "right_id": "3", "verdict": "merge"}], run["packet_hash"])
    assert {r["id"]: r["root"] for r in found.collect()} == {"1": "1", "2": "1", "3": "1"}
    with pytest.raises(ValueError):
        R.resolved_run(spark, folder, [], "another")


def slow_score(a, b):
    import re

    def lev(x, y):
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            new = [i]
            for j, d in enumerate(y, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
            row = new
        return row[-1]

    key = lambda t: re.sub(r"[\W_]+", " ", t.lower()).strip()
    out = 0
    for f in (lambda t: t, lambda t: " ".join(sorted(t.split(" ")))):
        x, y = f(key(a)), f(key(b))
        out = max(out, 1 - lev(x, y) / max(len(x), len(y), 1))
    return round(out, 6)


def test_edit_distances():
    import random

    rng = random.Random(1)
    texts = ["".join(rng.choice("abé\U0001f600 ") for _ in range(rng.choice([0, 1, 5, 12, 63, 64, 65, 90]))) for _ in range(80)]
    codes, size = R._codes(texts)
    for t in texts[:30]:
        assert R.edit_distances(t, codes, size).tolist() == [round((1 - slow_plain(t, u)) * max(len(t), len(u), 1)) for u in texts]


def slow_plain(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        new = [i]
        for j, d in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return 1 - row[-1] / max(len(a), len(b), 1)


@pytest.mark.parametrize("side", [2_000, 7])
def test_candidates_against_brute_force(spark, monkeypatch, side):
    import random

    monkeypatch.setattr(R, "SIDE", side)
    monkeypatch.setattr(R, "OTHER_SIDE", side + 1)

    rng = random.Random(4)
    first, last = ["John", "Jon", "Mary", "ann-marie", "Acme"], ["Smith", "Smyth", "O'Neil", "Corp.", "Corporation", "12 34"]
    rows = [(str(i), "P" if i % 5 else "Q", " ".join(rng.sample([rng.choice(first), rng.choice(last), rng.choice(first)], rng.randint(1, 3)))) for i in range(60)]
    got = {(r["left_id"], r["right_id"]): r["score"] for r in R.candidates(spark.createDataFrame(rows, "id string, schema string, name string")).collect()}
    sound = {r["t"]: r["s"] for r in spark.createDataFrame([(t,) for t in {w.lower() for _, _, n in rows for w in n.replace("-", " ").replace("'", " ").replace(".", " ").split()}], "t string").select("t", F.soundex("t").alias("s")).collect()}
    words = lambda n: n.lower().replace("-", " ").replace("'", " ").replace(".", " ").split()
    true = {}
    for i, s, a in rows:
        for j, t, b in rows:
            x, y = words(a), words(b)
            if i < j and s == t and (x[0] == y[0] or sound[x[-1]] == sound[y[-1]] or sorted(x) == sorted(y)) and slow_score(a, b) >= 0.7:
                true[i, j] = slow_score(a, b)
    assert got == pytest.approx(true)


def test_scoped_replace(spark, tmp_path):
    path = str(tmp_path / "graph")
    rows = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id string")
    assert R.replace_scope(spark, rows("1", "2"), path, "x", "id") == {"created": 2, "kept": 0, "deleted": 0}
    R.replace_scope(spark, rows("9"), path, "y", "id")
    assert R.replace_scope(spark, rows("2", "3"), path, "x", "id") == {"created": 1, "kept": 1, "deleted": 1}
    part = tmp_path / "graph" / "investigation_id=x"
    part.rename(tmp_path / "graph" / "_old-investigation_id=x")  # a call that ended between its two renames
    assert R.replace_scope(spark, rows("2"), path, "x", "id") == {"created": 0, "kept": 1, "deleted": 1}
    assert R.replace_scope(spark, rows(), path, "x", "id")["deleted"] == 1
    assert [tuple(r) for r in spark.read.parquet(path).collect()] == [("9", "y")]


def test_review_log(spark):
    m = spark.createDataFrame([("d", 1, 0, 3, "n1", "name", "Ann"), ("d", 1, 5, 8, "n2", "name", "Bob")], "doc_id string, page int, char_start int, char_end int, target_id string, prop string, value string")
    log = E.statements(m, "ns")
    a, b = (r["statement_id"] for r in log.orderBy("char_start").collect())
    log = E.decide(log, spark.createDataFrame([(a, "accepted", None, 1), (b, "edited", "Rob", 1)], "statement_id string, review string, value string, at long"))
    now = {r["value"]: r["review"] for r in E.current(log).collect()}
    assert now == {"Ann": "accepted", "Rob": "accepted"}


def test_edges_and_closure(spark):
    rel = spark.createDataFrame([("owns/subsidiary of", "1", "person", "2", "company", "k"), ("owns/subsidiary of", "1", "person", "3", "organization", "k"), ("employed by", "1", "company", "2", "company", "k"), ("odd", "1", "person", "2", "company", "k"), ("party to contract/procurement", "4", "government agency", "1", "company", "k")], "relation string, head_id string, head_label string, tail_id string, tail_label string, span_key string")
    out = E.edges(rel, "ns")
    assert sorted((r["schema"], r["role"] or "", r["label"]) for r in out.collect()) == [("Ownership", "", "owns/subsidiary of"), ("UnknownLink", "odd", "odd"), ("UnknownLink", "owns/subsidiary of", "owns/subsidiary of"), ("UnknownLink", "party to contract/procurement", "party to contract/procurement")]
    names = spark.createDataFrame([("d", "person", " Ann  Lee\n"), ("d", "person", "ANN  LEE"), ("d", "person", "Ann Lee"), ("d", "person", "Straße"), ("d", "person", "STRASSE"), ("d", "odd", "x")], "doc_id string, label string, text string")
    made = E.nodes(names, "ns").collect()
    assert sorted((r["schema"], r["name"]) for r in made) == [("LegalEntity", "x"), ("Person", "ANN  LEE"), ("Person", "Ann Lee"), ("Person", "STRASSE")]
    kept, gone = E.closure(spark.createDataFrame([("1",), ("2",)], "node_id string"), out)
    assert kept.count() == 2 and gone.count() == 2


def test_cross_reference(spark):
    q = spark.createDataFrame([("q", "Acme Corp")], "id string, name string")
    c = spark.createDataFrame([("1", "ACME corp.", "d"), ("2", "Zed", "d"), ("3", "Acme Corporation", None)], "id string, name string, dataset string")
    assert {(r["entity_id"], r["dataset"]) for r in R.cross_reference(q, c, 0.5).collect()} == {("1", "d"), ("3", "(unknown)")}


@pytest.mark.parametrize("side", [2_000, 3])
def test_cross_reference_keeps_the_best(spark, monkeypatch, side):
    """The cap counts over all pieces of a block, by score and then by id, for each dataset."""
    monkeypatch.setattr(R, "SIDE", side)
    monkeypatch.setattr(R, "OTHER_SIDE", side + 1)
    names = [f"acme unit {i:03d}" for i in range(40)]
    c = spark.createDataFrame([(str(i), n, "d" if i % 3 else "e") for i, n in enumerate(names)], "id string, name string, dataset string")
    q = spark.createDataFrame([(str(i), names[i]) for i in (0, 11, 25)] + [("none", None), ("other", "zzz")], "id string, name string")
    got = {(r["query_id"], r["entity_id"], r["dataset"]): r["score"] for r in R.cross_reference(q, c, 0.7, 5).collect()}
    true = {}
    for i in (0, 11, 25):
        for d in "de":
            hits = sorted(((-slow_score(names[i], n), str(k)) for k, n in enumerate(names) if ("d" if k % 3 else "e") == d))[:5]
            true |= {(str(i), k, d): -v for v, k in hits}
    assert got == pytest.approx(true)
