import random

import numpy as np
import pytest

from lodestone.llm import toxicity as T

BAD = ["vile", "nasty", "rotten", "awful"]


def corpus(n, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    for i in range(n):
        toxic = i % 8 == 0
        text = [rng.choice(words) for _ in range(60)]
        for _ in range(rng.randint(2, 8) if toxic else 0):
            text.insert(rng.randrange(len(text)), rng.choice(BAD))
        yield i, " ".join(text), int(toxic)


@pytest.fixture(scope="module")
def fitted(spark):
    rows = list(corpus(1200, 1))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, t) for i, _, t in rows] + [(None, 1, 1), (5, 1, None), (99999, 0, 1)], "doc_id long, quality int, toxic int")
    return T.fit(docs, labels)


def test_held_out(spark, fitted):
    rows = list(corpus(800, 2))
    truth = {i: t for i, _, t in rows}
    got = T.score(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), fitted).collect()
    wrong = [r for r in got if r["is_toxic"] != bool(truth[r["doc_id"]])]
    assert len(got) == 800 and len(wrong) <= 8
    assert all(0 <= r["expected_severity"] <= len(fitted.cuts) for r in got)


def test_severity_is_ordered(spark, fitted):
    assert (np.diff(fitted.cuts) > 0).all()
    rows = [(k, " ".join(["w1"] * 30 + BAD * k)) for k in range(4)]
    got = [r["expected_severity"] for r in T.score(spark.createDataFrame(rows, "doc_id long, text string"), fitted).orderBy("doc_id").collect()]
    assert got == sorted(got)


def test_gradient():
    """The analytic slope of the likelihood leads to weights that a step in any direction makes no better."""
    rng = np.random.default_rng(1)
    row, feature = np.repeat(np.arange(60), 2), rng.integers(0, 3, 120)
    grade = np.where(np.bincount(row, feature == 0, minlength=60) > 0, rng.integers(0, 4, 60), 0)
    grade[:3] = 3
    w, cuts = T.fit_ordinal(row, feature, np.ones(120), grade, 3, l2=1e-3)

    def loss(w, cuts):
        up = 1 / (1 + np.exp(-(np.bincount(row, w[feature], minlength=60)[:, None] - cuts)))
        full = np.hstack([np.ones((60, 1)), up, np.zeros((60, 1))])
        weight = np.where(grade > 0, 0.5 / (grade > 0).sum(), 0.5 / (grade == 0).sum())
        return -(weight * np.log(full[np.arange(60), grade] - full[np.arange(60), grade + 1])).sum() + 5e-4 * w @ w

    for k in range(3):
        for e in (-0.05, 0.05):
            assert loss(w + e * np.eye(3)[k], cuts) >= loss(w, cuts) - 1e-6


def test_odd_tables(odd, none, fitted):
    assert T.score(odd, fitted).count() == odd.count() and T.score(none, fitted).count() == 0
    kept = T.keep_clean(odd, fitted)
    assert kept.columns == odd.columns and kept.count() == odd.count()
    unlearnt = T.fit(odd, odd.sparkSession.createDataFrame([], "doc_id long, toxic int"))
    assert T.score(odd, unlearnt).where("is_toxic or p_toxic > 0.01").count() == 0 and T.keep_clean(odd, unlearnt).count() == odd.count()


def test_score_against_brute_force(spark, fitted):
    """Words, their hashes, counts and the link, in plain Python."""
    import brute

    texts = [t for _, t, _ in corpus(60, 5)] + ["", None, "Vile VILE vile nastiness rottenly w1 éé_9 ſ", "word " * 3000 + "awful", "x"]
    got = {r["doc_id"]: r for r in T.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), fitted).collect()}
    for i, t in enumerate(texts):
        up = brute.up_to(t, fitted)
        full = [1.0, *up, 0.0]
        shares = [a - b for a, b in zip(full, full[1:])]
        assert got[i]["expected_severity"] == pytest.approx(sum(up)) and got[i]["p_toxic"] == pytest.approx(up[0]) and got[i]["grade"] == shares.index(max(shares)) and got[i]["is_toxic"] == (up[0] >= 0.5)
    kept = {r["doc_id"] for r in T.keep_clean(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), fitted).collect()}
    assert kept == {i for i, t in enumerate(texts) if brute.up_to(t, fitted)[0] < 0.5}


def test_features_against_brute_force(spark, fitted):
    """What a fit chooses: features by chi-squared and lift, counted row by row."""
    import brute

    rows = list(corpus(1200, 1))
    n1 = sum(t for _, _, t in rows)
    n0, seen = len(rows) - n1, {}
    for _, text, toxic in rows:
        for h in brute.features(text):
            a, b = seen.get(h, (0, 0))
            seen[h] = (a + toxic, b + 1 - toxic)
    chosen = set()
    for h, (a, b) in seen.items():
        d = a * (n0 - b) - b * (n1 - a)
        chi2 = d * d * (n1 + n0) / (n1 * n0 * (a + b) * max(n1 + n0 - a - b, 1))
        lift = (a + 0.5) / (n1 + 1) / ((b + 0.5) / (n0 + 1))
        if a + b >= T.MIN_ROWS and chi2 >= T.MIN_CHI2 and not 1 / T.MIN_LIFT < lift < T.MIN_LIFT:
            chosen.add(h)
    assert set(fitted.features.tolist()) == chosen and len(chosen) >= 4
