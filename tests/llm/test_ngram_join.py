import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import ngram_join as J
from lodestone.llm.common import components


def sets(text):
    w = re.findall(r"\w+", (text or "").lower())
    return {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


def corpus(n=260, seed=5):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(900)]
    out = []
    for i in range(n):
        if i % 3 and out:
            t = rng.choice(out).split()
            for _ in range(rng.choice([0, 1, 3, 8])):
                t[rng.randrange(len(t))] = rng.choice(words)
        else:
            t = [rng.choice(words) for _ in range(rng.randint(4, 120))]
        out.append(" ".join(t))
    return out


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def brute(texts, threshold=J.THRESHOLD):
    """Of each text: the least text connected to it, and how many are linked to it."""
    s = list(map(sets, texts))
    links, root = [0] * len(s), list(range(len(s)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(s)):
        for j in range(i):
            if jaccard(s[i], s[j]) >= threshold:
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (find(i), links[i]) for i in range(len(s))}


def result(df):
    rows = df.collect()
    assert len({r["doc_id"] for r in rows}) == len(rows)
    return {r["doc_id"]: (r["class_id"], r["n_links"]) for r in rows}


def test_against_brute_force(spark):
    texts = corpus()
    assert result(J.linked(frame(spark, texts))) == brute(texts)


def test_keep_one(spark):
    texts = corpus(120, 6)
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, rep string")
    assert {r["doc_id"] for r in J.keep_one(df).collect()} == {c for c, _ in brute(texts).values()}


def test_copies_in_crowds(spark):
    df = spark.range(3000).selectExpr("id as doc_id", "case when id % 2 = 0 then 'one text that many rows have' else concat('row number ', id, ' of its own kind ', id * 7) end as text")
    assert J.keep_one(df).count() == 1501
    assert J.linked(df).where("n_links = 1499 and class_id = 0").count() == 1500


def near_copies(n, seed):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(500)}" for _ in range(80)]
    out = []
    for i in range(n):
        t = list(base)
        for _ in range(rng.choice([0, 1, 2, 4, 7])):
            t[rng.randrange(80)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(t))
    return out


def test_tiles_in_blocks(spark, monkeypatch):
    texts = corpus(90, 7) + near_copies(60, 8)
    df = frame(spark, texts)
    true = brute(texts)
    assert result(J.linked(df)) == true
    monkeypatch.setattr(J, "TILE_BYTES", 8000)
    assert result(J.linked(df)) == true
    kept = {r["doc_id"] for r in J.keep_one(df).collect()}
    assert kept == {c for c, _ in true.values()}
    monkeypatch.setattr(J, "narrow", lambda df, _: df)  # nothing broadcast
    assert result(J.linked(df)) == true


def test_several_texts_of_one_id(spark):
    a, b = near_copies(1, 1)[0], near_copies(1, 2)[0]
    df = spark.createDataFrame([(1, a), (5, a), (5, b), (7, b), (9, "on its own"), (9, "on its own")], "doc_id long, text string")
    assert result(J.linked(df)) == {1: (1, 1), 5: (1, 2), 7: (1, 1), 9: (9, 0)}
    assert sorted(r["doc_id"] for r in J.keep_one(df).collect()) == [1, 9, 9]


def test_odd_tables(odd, none):
    got = result(J.linked(odd))
    assert {d: c for d, c in got.items() if c[1]} == {4: (4, 1), 5: (4, 1), 6: (6, 1), 7: (6, 1), 9: (9, 1), 10: (9, 1)}
    assert set(got) == {r["doc_id"] for r in odd.collect()} - {None}
    kept = J.keep_one(odd)
    assert kept.columns == odd.columns and sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == [(False, i) for i in (0, 1, 2, 4, 6, 8, 9)] + [(True, 0)]
    assert J.linked(none).count() == 0 and J.keep_one(none).count() == 0


@pytest.mark.parametrize("shape", ["chain", "random", "stars", "none"])
def test_components_against_brute_force(spark, shape):
    rng = random.Random(3)
    edges = {"chain": [(i, i + 1) for i in range(40)], "random": [(rng.randrange(90), rng.randrange(90)) for _ in range(70)], "stars": [(i, i % 5) for i in range(50)], "none": [(7, 7)]}[shape]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r["v"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in root if find(x) != x}


def test_guests_meet_hosts_alone():
    """work in a tile is hosts by all, not all by all; each pair with a host comes once, no pair of guests does."""
    rng = np.random.default_rng(8)
    base = [np.unique(rng.integers(0, 2**63, 60, np.uint64)) for _ in range(6)]
    sets = [np.unique(np.concatenate([b[rng.random(len(b)) < 0.8], rng.integers(0, 2**63, int(rng.integers(1, 15)), np.uint64)])) for b in base for _ in range(12)]
    guest = rng.random(len(sets)) < 0.7
    both = np.ones(len(sets), bool)
    got = [tuple(sorted((i, int(j)))) for i, js in J.compare(sets, 0.5, both, both, guest) for j in js]
    like = lambda i, j: len(np.intersect1d(sets[i], sets[j])) >= 0.5 * len(np.union1d(sets[i], sets[j]))
    want = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if not (guest[i] and guest[j]) and like(i, j)}
    assert len(got) == len(set(got)) and set(got) == want and want


def test_a_visit_needs_a_set_that_may_be_similar(spark):
    """a tile's sets in a bucket bound what may visit it; what is similar to any of them always may, and of one set it is _fits."""
    rng = np.random.default_rng(9)
    texts = [" ".join(f"w{v}" for v in rng.permutation(90)[: rng.integers(8, 60)]) for _ in range(40)]
    texts += [t + " more words" for t in texts[:20]]
    rows = J.Classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).classes.select("rep", "size", *J._BITS)
    x, y = rows.alias("x"), rows.withColumn("tile", F.col("rep") % 9).alias("y")
    pairs = {(r["r"], r["t"]) for r in x.crossJoin(y).where(J._fits("x", "y", 0.5)).select(F.col("x.rep").alias("r"), F.col("y.tile").alias("t")).collect()}
    bounds = [F.min("size").alias("least_size"), F.max("size").alias("most_size"), *[F.expr(f"bit_{f}({b})").alias(f"{n}_{b}") for f, n in (("or", "any"), ("and", "all")) for b in J._BITS]]
    may = lambda tile: {tuple(r) for r in rows.crossJoin(rows.withColumn("tile", tile).groupBy("tile").agg(*bounds)).where(J._may_fit(0.5)).select("rep", "tile").collect()}
    assert pairs <= may(F.col("rep") % 9)
    assert may(F.col("rep")) == {(r[0], r[1]) for r in x.crossJoin(rows.alias("y")).where(J._fits("x", "y", 0.5)).select("x.rep", "y.rep").collect()} != set()
