import random

import pytest

from lodestone.operators.stats import burstiness, concentration


def brute(xs, frac=0.01):
    import math

    xs, n, total = sorted(xs), len(xs), sum(xs)
    if not n or not total:
        return 0.0, 0.0, 0.0
    k = max(1, math.ceil(n * frac))
    return (2 * sum(i * x for i, x in enumerate(xs, 1)) - (n + 1) * total) / (n * total), sum(xs[-k:]) / total, sum(xs[: n // 2]) / total


@pytest.mark.parametrize("xs", [[1, 2, 3, 10], [5], [0, 0], [3, 3, 3, 3], [random.Random(4).choice([1, 2, 2, 50, 9]) for _ in range(341)]])
def test_concentration(spark, xs):
    got = concentration(spark.createDataFrame([(float(x),) for x in xs] + [(None,), (float("nan"),)], "x double"), "x").first()
    assert got["n"] == len(xs)
    assert (got["gini"], got["top_share"], got["bottom_half"]) == pytest.approx(brute(xs))


def test_empty_and_negative(spark):
    assert concentration(spark.createDataFrame([], "x double"), "x").first()["gini"] == 0.0
    with pytest.raises(Exception, match="negative value"):
        concentration(spark.createDataFrame([(-1.0,)], "x double"), "x").collect()


def test_bursts(spark):
    rows = [("a", 1), ("a", 1), ("b", 1), (None, 1), ("a", 2)]
    got = burstiness(spark.createDataFrame(rows, "actor string, t int"), "t", "actor")
    assert {(r["burst_size"], r["n_groups"]) for r in got.collect()} == {(2, 1), (1, 2)}
