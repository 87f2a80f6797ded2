"""Toxicity severity by cumulative-link ordinal regression over sparse text features.

Features are the distinct hashed words of a text with log-scaled counts. One weight vector is shared by all
ordered thresholds: P(grade > k) = sigmoid(w.x - b_k). The result carries the expected severity, the sum of
those probabilities.

Edge cases: a null or empty text has no features and gets the prior alone; repeated rows get equal results;
an empty table gives an empty result; columns besides id and text are ignored by ``score`` and kept by
``keep_clean``, whatever their names. Where no word tells toxic labelled rows from others, as without a labelled row of
either kind, the model has no features and calls nothing toxic.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import per_slice, word_hashes

#: Labelled rows that the classifier is fitted on, at most: those with the least hash of the id.
FIT_ROWS = 20_000
#: Features kept at most, a bound of memory: those whose presence tells toxic rows best, by the chi-squared statistic. A fit on FIT_ROWS
#: rows has chosen some thousand at most so far.
FEATURES = 131_072
#: Rows that a feature is in, at least, and its least statistic.
MIN_ROWS, MIN_CHI2 = 8, 30.0
#: How many times as frequent, or as rare, a feature is in toxic rows, at least.
MIN_LIFT = 8.0
#: Grades above 0 into which toxic training rows are split by how many toxic words they have.
LEVELS = 3
#: Bytes of word beginnings that are features beside the whole words.
PREFIXES = (4, 5, 6)
#: P(grade > 0) from which a document counts as toxic.
TOXIC_FROM = 0.5


@dataclass
class OrdinalModel:
    features: np.ndarray  # 64-bit hashes, ascending
    weights: np.ndarray  # one for each, shared by all thresholds
    cuts: np.ndarray  # ascending, one per grade but the first
    seen: np.ndarray  # by the lowest 20 bits: whether any feature has them


def sparse_rows(col: pa.Array, features: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, value) for each of the given features that a row has, ordered by row."""
    h, row = word_hashes(col, PREFIXES)
    hit = seen[(h & np.uint64(0xFFFFF)).astype(np.int64)]
    h, row = h[hit], row[hit]
    at = np.minimum(np.searchsorted(features, h), max(0, len(features) - 1))
    same = features[at] == h if len(features) else np.zeros(len(h), bool)
    key, count = np.unique(row[same] * (1 << 32) + at[same], return_counts=True)
    return key >> 32, key & 0xFFFFFFFF, 1 + np.log(count)


def bitmap(features: np.ndarray) -> np.ndarray:
    seen = np.zeros(1 << 20, bool)
    seen[(features & np.uint64(0xFFFFF)).astype(np.int64)] = True
    return seen


NOTHING_LEARNT = OrdinalModel(np.zeros(0, np.uint64), np.zeros(0), 20.0 + np.arange(LEVELS), bitmap(np.zeros(0, np.uint64)))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit_ordinal(row: np.ndarray, feature: np.ndarray, value: np.ndarray, grade: np.ndarray, m: int, *, l2: float = 1e-5, steps: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Weights of m features and cuts: penalised maximum likelihood of the cumulative-link model by L-BFGS; deterministic."""
    levels, n = int(grade.max()), len(grade)
    at, hot = np.arange(n), np.arange(levels)[None, :]
    weight = np.where(grade > 0, 0.5 / (grade > 0).sum(), 0.5 / max(1, (grade == 0).sum()))  # toxic rows weigh as much together as the others

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        w, theta = x[:m], x[m:]
        up = _sigmoid(np.bincount(row, w[feature] * value, minlength=n)[:, None] - _cuts(theta)[None, :])  # P(grade > k)
        full = np.pad(np.pad(up, ((0, 0), (1, 0)), constant_values=1), ((0, 0), (0, 1)))
        slope = np.pad(up * (1 - up), ((0, 0), (1, 1)))
        p = np.maximum(full[at, grade] - full[at, grade + 1], 1e-12)
        a, b = slope[at, grade] / p * weight, slope[at, grade + 1] / p * weight
        dc = ((hot == grade[:, None] - 1) * a[:, None] - (hot == grade[:, None]) * b[:, None]).sum(axis=0)
        dtheta = np.concatenate([[dc.sum()], [dc[k + 1 :].sum() * np.exp(theta[1 + k]) for k in range(levels - 1)]])
        dw = np.bincount(feature, (b - a)[row] * value, minlength=m) + l2 * w
        return float(-(weight * np.log(p)).sum() + l2 / 2 * (w @ w)), np.concatenate([dw, dtheta])

    # Cuts as a start and the logarithms of gaps: they stay ordered.
    return (x := _minimise(loss, np.concatenate([np.zeros(m), [1.0], np.zeros(levels - 1)]), steps))[:m], _cuts(x[m:])


def _minimise(loss, x: np.ndarray, steps: int, memory: int = 10) -> np.ndarray:  # noqa: ANN001
    value, g = loss(x)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        q, kept = g.copy(), []
        for s, y in reversed(past):
            kept.append(alpha := (s @ q) / (s @ y))
            q -= alpha * y
        if past:
            q *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1])
        for (s, y), alpha in zip(past, reversed(kept)):
            q += s * (alpha - (y @ q) / (s @ y))
        step, slope = 1.0, g @ q
        while True:
            there = x - step * q
            new, h = loss(there)
            if new <= value - 1e-4 * step * slope or step < 1e-6:
                break
            step /= 2
        if step < 1e-6:
            break
        if (there - x) @ (h - g) > 1e-12:
            past = [*past[1 - memory :], (there - x, h - g)]
        done = abs(value - new) < 1e-7 * max(1, abs(value))
        x, value, g = there, new, h
        if done:
            break
    return x


def _cuts(theta: np.ndarray) -> np.ndarray:
    return theta[0] + np.concatenate([[0.0], np.cumsum(np.exp(theta[1:]))])


def grades(amount: np.ndarray, toxic: np.ndarray, levels: int = LEVELS) -> np.ndarray:
    """Severity of training rows: 0 if not toxic, else 1 to ``levels`` by quantiles of how many marked words they have."""
    cuts = np.quantile(amount[toxic], np.arange(1, levels) / levels)
    return np.where(toxic, 1 + (amount[:, None] > cuts[None, :]).sum(axis=1), 0)


def predict(model: OrdinalModel, col: pa.Array) -> np.ndarray:
    """P(grade > k) for each row and k."""
    row, feature, value = sparse_rows(col, model.features, model.seen)
    s = np.bincount(row, model.weights[feature] * value, minlength=len(col))
    return _sigmoid(s[:, None] - model.cuts[None, :])


def fit(docs: DataFrame, labels: DataFrame, *, fit_rows: int = FIT_ROWS, features: int = FEATURES, min_rows: int = MIN_ROWS) -> OrdinalModel:
    """Fits on at most fit_rows labelled documents. Features are chosen in Spark; only the chosen ones reach the driver."""
    picked = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.max("toxic") > 0).alias("_toxic"))
    picked = picked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)  # bounded, so it may be broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        h, row = word_hashes(batch.column("text"), PREFIXES)
        toxic = batch.column("_toxic").to_numpy(zero_copy_only=False).astype(bool)
        pair = _distinct(h, row)
        f, at = np.unique(pair[0], return_inverse=True)
        t = toxic[pair[1].astype(np.int64)]
        f, a, b = np.append(f, np.uint64(0)), np.bincount(at, t, minlength=len(f)), np.bincount(at, ~t, minlength=len(f))
        # The last row, of no feature, counts the rows themselves.
        return pa.RecordBatch.from_pydict({"f": pa.array(f.view(np.int64)), "a": pa.array(np.append(a, toxic.sum()).astype(np.int64)), "b": pa.array(np.append(b, (~toxic).sum()).astype(np.int64)), "is_total": pa.array(np.arange(len(f)) == len(f) - 1)})

    tally = rows.mapInArrow(per_slice(count, "text"), "f long, a long, b long, is_total boolean").groupBy("is_total", "f").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    tally = tally.where(F.col("is_total") | (F.col("a") + F.col("b") >= min_rows))
    totals = F.broadcast(tally.where("is_total").select(F.col("a").alias("n1"), F.col("b").alias("n0")))  # one row
    chi2 = "(a * (n0 - b) - b * (n1 - a)) * 1d * (a * (n0 - b) - b * (n1 - a)) * (n1 + n0) / (n1 * 1d * n0 * (a + b) * greatest(n1 + n0 - a - b, 1))"
    best = tally.where("not is_total").crossJoin(totals).where("n1 > 0 and n0 > 0").withColumn("chi2", F.expr(chi2)).where(F.col("chi2") >= MIN_CHI2)
    lift = F.expr("((a + 0.5) / (n1 + 1)) / ((b + 0.5) / (n0 + 1))")
    best = best.where((lift >= MIN_LIFT) | (lift <= 1 / MIN_LIFT))
    best = best.orderBy(F.desc("chi2"), "f").limit(features).select("f", "a", "b", "n1", "n0").toArrow()
    if not best.num_rows:
        return NOTHING_LEARNT
    chosen = best["f"].to_numpy().view(np.uint64)
    order = np.argsort(chosen)
    chosen = chosen[order]
    a, b, n1, n0 = (best[k].to_numpy()[order] for k in ("a", "b", "n1", "n0"))
    marked = (a + 0.5) / (n1 + 1) >= MIN_LIFT * (b + 0.5) / (n0 + 1)  # far more frequent in toxic rows
    seen = bitmap(chosen)

    def extract(batch: pa.RecordBatch) -> pa.RecordBatch:
        col = batch.column("text")
        row, feature, value = sparse_rows(col, chosen, seen)
        ends = np.cumsum(np.bincount(row, minlength=len(col)))[:-1]
        return pa.RecordBatch.from_pydict({"id": batch.column("doc_id"), "toxic": batch.column("_toxic"), "f": pa.array([x.astype("<i4").tobytes() for x in np.split(feature, ends)]), "v": pa.array([x.astype("<f4").tobytes() for x in np.split(value, ends)])})

    got = rows.mapInArrow(per_slice(extract, "text"), "id long, toxic boolean, f binary, v binary").toArrow().sort_by("id")
    f, v = [np.frombuffer(x, "<i4") for x in got["f"].to_pylist()], [np.frombuffer(x, "<f4") for x in got["v"].to_pylist()]
    row, f, v = np.repeat(np.arange(len(f)), [len(x) for x in f]), np.concatenate(f).astype(np.int64), np.concatenate(v)
    toxic = got["toxic"].to_numpy(zero_copy_only=False).astype(bool)
    amount = np.bincount(row, np.where(marked[f], np.exp(v - 1), 0), minlength=len(toxic))
    weights, cuts = fit_ordinal(row, f, v, grades(amount, toxic), len(chosen))
    return OrdinalModel(chosen, weights, cuts, seen)


def _distinct(h: np.ndarray, row: np.ndarray) -> np.ndarray:
    order = np.lexsort((row, h))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return np.stack([h[new], row[new].astype(np.uint64)])


def score(docs: DataFrame, model: OrdinalModel, toxic_from: float = TOXIC_FROM) -> DataFrame:
    """doc_id, expected_severity, grade (the likeliest), p_toxic, is_toxic: one row for each of docs."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        up = predict(model, batch.column("text"))
        full = np.concatenate([np.ones((len(up), 1)), up, np.zeros((len(up), 1))], axis=1)
        likeliest = np.argmax(full[:, :-1] - full[:, 1:], axis=1)
        return pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "expected_severity": pa.array(up.sum(axis=1)), "grade": pa.array(likeliest, pa.int32()), "p_toxic": pa.array(up[:, 0].astype(np.float64)), "is_toxic": pa.array(up[:, 0] >= toxic_from)})

    return docs.select("doc_id", "text").mapInArrow(per_slice(run, "text"), "doc_id long, expected_severity double, grade int, p_toxic double, is_toxic boolean")


def keep_clean(docs: DataFrame, model: OrdinalModel, toxic_from: float = TOXIC_FROM) -> DataFrame:
    """docs without the toxic ones, all columns as they were. No shuffle: texts are judged where they are read."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(predict(model, batch.column("text"))[:, 0] < toxic_from))

    return docs.mapInArrow(per_slice(run, "text"), docs.schema)
