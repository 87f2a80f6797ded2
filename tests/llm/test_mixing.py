import random
from collections import Counter

import pytest

from lodestone.llm import mixing as M


def docs(spark, sizes, parts=5):
    rows = [(i, f"t{i}", s) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(parts, "doc_id")


@pytest.mark.parametrize(("weights", "total"), [(None, None), ({"a": 3.0, "b": 1.0, None: 1.0}, 101), ({"a": 1.0}, 7), ({"a": 1.0, "b": 1.0, "zzz": 5.0}, 50)])
def test_targets_are_met(spark, weights, total):
    sizes = {"a": 90, "b": 37, "c": 11, None: 8}
    got = [(r["doc_id"], r["source"]) for r in M.mix(docs(spark, sizes), weights, total).collect()]
    w = {s: n**0.5 for s, n in sizes.items()} if weights is None else {s: weights.get(s, 0.0) for s in sizes}
    n = total or sum(sizes.values())
    assert len(got) == n
    by_source, by_doc = Counter(s for _, s in got), Counter(got)
    for s in sizes:
        target = n * w[s] / sum(w.values())
        assert abs(by_source[s] - target) < 1 + 1e-6
        for k in (by_doc[d] for d in by_doc if d[1] == s):
            assert target // sizes[s] <= k <= target // sizes[s] + 1


def test_each_has_its_chance(spark):
    """Over many seeds each document gets its fraction of copies on average."""
    df = docs(spark, {"a": 9, "b": 3}, 2).cache()
    count = Counter()
    for seed in range(12):
        count.update(r["doc_id"] for r in M.mix(df, {"a": 1.0, "b": 1.0}, 6, seed=seed).collect())
    assert sum(count[i] for i in range(9)) == 3 * 12
    assert all(abs(count[i] / 12 - 1 / 3) < 0.45 for i in range(9)) and len([i for i in range(9) if count[i]]) >= 7


def test_a_duel_keeps_the_sum():
    rng = random.Random(2)
    for _ in range(500):
        p, q = rng.random(), rng.random()
        a, b = M.duel(p, q, rng.random())
        assert abs(a + b - p - q) < 1e-12 and min(abs(a), abs(a - 1), abs(b), abs(b - 1)) < 1e-12 and 0 <= a <= 1 and 0 <= b <= 1


def test_repeatable(spark):
    key = lambda: sorted(r["doc_id"] for r in M.mix(docs(spark, {"a": 50, "b": 9}), None, 30).collect())
    assert key() == key()


def test_odd_tables(spark, odd, none):
    out = M.mix(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    assert M.mix(none).count() == 0
    with pytest.raises(ValueError):
        M.mix(odd, {"a": -1.0})
    assert M.mix(odd, {"nowhere": 1.0}).count() == 0


def slow_mix(rows, weights, total, seed):
    """Copies of each row of one partition, one duel after the other; then those left open, by source."""
    sizes = Counter(s for _, s in rows)
    whole = sum(weights.get(s, 0) for s in sizes)
    p, copies, waiting = {}, {}, {}
    for i, (_, s) in enumerate(rows):
        rate = weights.get(s, 0) / whole * total / sizes[s]
        copies[i], p[i] = int(rate + 1e-9), M._close(rate - int(rate + 1e-9))
        if p[i] in (0, 1):
            continue
        if s in waiting:
            k = waiting.pop(s)
            p[k], p[i] = map(M._close, M.duel(p[k], p[i], M._uniform(seed, 0, i, s)))
            waiting |= {s: j for j in (k, i) if p[j] not in (0, 1)}
        else:
            waiting[s] = i
    left = [waiting[s] for s in sorted(waiting, key=lambda s: (s is None, s or ""))]
    if left:
        k = left[0]
        for i in left[1:]:
            p[k], p[i] = map(M._close, M.duel(p[k], p[i], M._uniform(seed, "tree", 0, i, 0, k)))
            k = i if p[k] in (0, 1) else k
    return {rows[i][0]: copies[i] + int(p[i]) for i in copies}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_mix_against_brute_force(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["a", "a", "a", "b", "c", None])) for i in range(211)]
    weights = {"a": 2.0, "b": 1.0, "c": 5.0, None: 1.0}
    spark.createDataFrame(rows, "doc_id long, source string").coalesce(1).write.parquet(str(tmp_path / "d"))
    df = spark.read.parquet(str(tmp_path / "d"))
    got = Counter(r["doc_id"] for r in M.mix(df, weights, 150, seed=seed).collect())
    true = slow_mix([tuple(r) for r in df.collect()], weights, 150, seed)
    assert {i: got.get(i, 0) for i, _ in rows} == true and sum(true.values()) == 150


def test_columns_of_any_name(spark):
    df = spark.createDataFrame([(i, "s", i, "x", 2.0, "y") for i in range(9)], "doc_id long, Source string, _mix_copies long, _mix_source string, _mix_p double, c0 string")
    out = M.mix(df, {"s": 1.0}, 18)
    assert out.columns == df.columns and out.count() == 18 and all(r["_mix_copies"] == r["doc_id"] and r["_mix_source"] == "x" for r in out.collect())
