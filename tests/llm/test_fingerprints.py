import random

import numpy as np
import pyarrow as pa
import pytest

from lodestone.llm import fingerprints as P


def text(n, seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(rng.randint(2, 9))) for _ in range(n))


RANK = np.random.default_rng(1).permutation(P.LEVELS + 1).astype(np.int64)
RANK[: P.LEAST_LEVEL] = 1 << 20


def brute(t):
    b = t.encode()
    if 0 < len(b) < P.WINDOW:
        return [b]
    n = len(b) - P.WINDOW + 1
    top = 6 * P.WINDOW * (1 << 20)
    level = [int(np.clip((top - P._G[np.bincount(np.frombuffer(b[i : i + P.WINDOW], np.uint8), minlength=256)].sum()) * P.LEVELS // top, 0, P.LEVELS)) for i in range(n)]
    score = [0] * max(n, 0)
    for a in range(1 - P.SPAN, n):
        some = [(RANK[level[i]], i) for i in range(max(0, a), min(n, a + P.SPAN)) if RANK[level[i]] < 1 << 20]
        if some:
            score[min(some)[1]] += 1
    return list(dict.fromkeys(b[i : i + P.WINDOW] for i in range(n) if score[i] >= P.POINTS))


def test_features_against_brute_force():
    texts = [text(60, 1), None, "", "short", text(90, 2), "a" * 300, text(60, 1)]
    row, h = P.features(pa.array(texts), RANK)
    for i, t in enumerate(texts):
        windows = brute(t or "")
        assert (row == i).sum() == len(windows)
        assert h[row == i].tolist() == [int(P._hash(np.frombuffer(w, np.uint8), np.zeros(1, np.int64), len(w))[0]) for w in windows]


def test_long_text_in_pieces(monkeypatch):
    t = pa.array([text(3000, 3)])
    whole = P.features(t, RANK)[1]
    monkeypatch.setattr(P, "SLICE", 1500)
    assert (P.features(t, RANK)[1] == whole).all()


def digest(t):
    row, h = P.features(pa.array([t]), RANK)
    return [f.tobytes() for f in P.filters(row, h, 1)[0]]


def test_similarity():
    a, b = text(2000, 4), text(2000, 5)
    assert len(digest(a)) > 1
    assert P.similarity(digest(a), digest(a)) == 1.0 and P.similarity(digest(a), digest(b)) < 0.1
    assert P.similarity(digest(a), digest(a[:6000] + b[:1500])) > P.MATCH > P.similarity(digest(a), digest(b))
    assert P.similarity([], digest(a)) == 0.0 and P.similarity(digest(a), digest(b)) == pytest.approx(P.similarity(digest(b), digest(a)))


def searched(spark, rows, every):
    return {r["doc_id"]: r for r in P.fingerprint(spark.createDataFrame(rows, "doc_id long, text string"), every=every).collect()}


def test_matches(spark):
    base = text(400, 6)
    rows = [(0, base), (1, base + text(40, 7)), (2, text(400, 8)), (3, base), (3, base), (None, base), (4, None), (5, "")]
    got = P.fingerprint(spark.createDataFrame(rows, "doc_id long, text string"), every=1).collect()
    assert len(got) == len(rows)
    near = {r["doc_id"]: r["matches"] and sorted((m["doc_id"], m["copies"]) for m in r["matches"]) for r in got}
    assert near == {0: [(1, 1), (3, 1)], 1: [(0, 2)], 2: [], 3: [(0, 1), (1, 1)], None: None, 4: [], 5: []}
    assert {r["doc_id"]: r["n_matches"] for r in got} == {0: 2, 1: 2, 2: 0, 3: 2, None: None, 4: 0, 5: 0}
    assert next(r for r in got if r["doc_id"] == 3)["matches"][0]["similarity"] == 1.0


def passages():
    """Documents that share passages: some consist of nothing but what others hold too."""
    part = [text(60, 90 + k) for k in range(6)]
    rows = [(i, text(120, i % 4) + " " + text(60, 50 + i % 3)) for i in range(12)]
    rows += [(20 + i, part[i % 6] + " " + part[(i + 1) % 6]) for i in range(12)] + [(40 + i, part[i]) for i in range(6)]
    return [*rows, (60, part[0] + " " + part[1] + " " + text(300, 77))]


@pytest.mark.parametrize("every", [1, 4])
def test_search_against_brute_force(spark, every, monkeypatch):
    """All queries against all documents that share a feature, digest by digest."""
    rows = passages()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r for r in P.digests(docs, P.learn(docs), True).collect()}
    expected = {}
    for q in found:
        if q % every == 0:
            alike = {d: P.similarity(found[q]["digest"], found[d]["digest"]) for d in found if d != q and set(found[d]["features"]) & set(found[q]["features"])}
            expected[q] = {d: v for d, v in alike.items() if v >= P.MATCH}
    assert any(expected.values())
    classes = {}
    for d in sorted(found):
        classes.setdefault(tuple(found[d]["digest"]), []).append(d)
    got = {q: r for q, r in searched(spark, rows, every).items() if r["matches"] is not None}
    assert set(got) == set(expected)
    for q, r in got.items():
        assert r["n_matches"] == len(expected[q])
        reported = {(m["doc_id"], m["copies"]): m["similarity"] for m in r["matches"]}
        true = {}
        for group in classes.values():
            hit = [d for d in group if d in expected[q]]
            if hit:
                true[hit[0], len(hit)] = expected[q][hit[0]]
        assert reported == pytest.approx(true)


def test_long_lists_take_several_rows(spark, monkeypatch):
    monkeypatch.setattr(P, "LIST", 5)
    docs = spark.createDataFrame(passages(), "doc_id long, text string")
    rows = [r for r in P.fingerprint(docs, every=20).collect() if r["doc_id"] == 20]
    assert len(rows) > 1 and sum(m["copies"] for r in rows for m in r["matches"]) == rows[0]["n_matches"]


def test_odd_tables(odd, none):
    assert P.fingerprint(odd).count() == odd.count() and P.fingerprint(none).count() == 0


def test_long_lists_are_not_broadcast(spark, monkeypatch):
    """a query's list of matches counts with its length; a row of many matches is no small row."""
    from lodestone.llm import common

    rng = random.Random(5)
    words = [f"w{rng.randrange(10**9)}" for _ in range(120)]
    docs = spark.createDataFrame([(i, " ".join([*words, f"own{i}" * 12])) for i in range(30)], "doc_id long, text string")
    monkeypatch.setattr(common, "BROADCAST_BYTES", 600)
    out = P.fingerprint(docs)
    got = next(r for r in out.collect() if r["doc_id"] == 0)
    assert got["n_matches"] == len(got["matches"]) == 29
    assert "strategy=broadcast" not in out._jdf.queryExecution().analyzed().toString()
