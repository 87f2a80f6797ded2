import numpy as np
import pytest

from lodestone.llm import cover_tree as C


def vectors(n, seed, spread=0.15):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 16))
    x[n // 2 :] = x[rng.integers(0, n // 4, n - n // 2)] + rng.normal(size=(n - n // 2, 16)) * spread
    x[-3:] = x[0] * 2.5  # one direction
    return x


def brute(x, t):
    y = x / np.linalg.norm(x, axis=1, keepdims=True)
    i, j = np.nonzero(np.triu(y @ y.T >= t - 1e-12, 1))
    return set(zip(i.tolist(), j.tolist()))


@pytest.mark.parametrize("threshold", [0.95, 0.8, 0.3])
def test_pairs_are_exact(spark, threshold):
    x = vectors(400, 1)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = C.near_pairs(df, threshold, block_bytes=8_000).collect()  # several blocks
    copies = {398, 399}  # of 397: they are in pairs with the first of their class alone
    true = {(i, j) for i, j in brute(x, threshold) if not copies & {i, j}} | {(397, 398), (397, 399)}
    assert {(r["id_a"], r["id_b"]) for r in got} == true and len(got) == len(true)


def groups(x, t):
    """Of each vector: the least one connected to it, and how many are linked to it."""
    pairs, root, links = brute(x, t), list(range(len(x))), [0] * len(x)

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, j in pairs:
        links[i] += 1
        links[j] += 1
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    return {k: (find(k), links[k]) for k in range(len(x))}


@pytest.mark.parametrize(("threshold", "spread", "bytes_"), [(0.95, 0.15, 8_000), (0.95, 0.01, 8_000), (0.8, 0.3, 6_000), (0.3, 0.15, 16_000), (0.95, 0.15, 10**7)])
def test_links_are_exact(spark, threshold, spread, bytes_):
    x = vectors(600, 3, spread)
    x[50:55] = x[40]  # equal vectors
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = C.linked(df, threshold, block_bytes=bytes_).collect()
    assert {r["vec_id"]: (r["class_id"], r["n_links"]) for r in got} == groups(x, threshold) and len(got) == len(x)


def test_far_cells_do_not_meet():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(20, 16))
    x = np.repeat(centres, 50, axis=0) + rng.normal(size=(1000, 16)) * 0.02
    x, c = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (x, centres))
    cells = C.Cells({16: c})
    own = np.repeat(np.arange(20), 50)
    cells.radius = {(16, k): float(np.linalg.norm(x[own == k] - c[k], axis=1).max()) for k in range(20)}
    p, q = cells.meets(16, np.arange(20), 0.32)
    assert (p == q).all() and len(p) == 20


def test_tree_covers():
    x = vectors(500, 2)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    t = C.CoverTree(x)
    assert sorted(t.order.tolist()) == list(range(500))
    for k, (a, b) in enumerate(t.range):
        d = np.linalg.norm(x[t.order[a:b]] - x[t.centre[k]], axis=1)
        assert d.max() <= t.r[k] + 1e-6
        spans = sorted(t.range[c] for c in t.children[k])
        assert not spans or (spans[0][0] == a and spans[-1][1] == b and all(p[1] == q[0] for p, q in zip(spans, spans[1:])))


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], "c"), (2, [2.0, 0.0], "c"), (2, [2.0, 0.0], "c"), (None, [1.0, 0.0], "c"), (3, None, "c"), (4, [], "c"), (5, [0.0, 0.0], "c"), (6, [nan, 1.0], "c"), (7, [inf, 1.0], "c"), (8, [1.0, None], "c"), (9, [1.0, 0.0, 0.0], "c"), (10, [0.0, 1.0], "c"), (10, [1.0, 0.0], "c")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, id string")
    assert sorted((r["id_a"], r["id_b"], r["cosine"]) for r in C.near_pairs(df).collect()) == [(1, 2, 1.0), (1, 10, 1.0)]
    assert sorted(map(tuple, C.linked(df).collect())) == [(1, 1, 2), (2, 1, 2), (9, 9, 0), (10, 1, 2)]
    assert C.near_pairs(df.limit(0)).count() == 0 and C.linked(df.limit(0)).count() == 0
