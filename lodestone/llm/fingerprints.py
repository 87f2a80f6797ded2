"""Document fingerprints from improbable features: rare byte windows in chained Bloom filters, compared by common bits.

1. Every window of ``WINDOW`` bytes of every text has an entropy, in ``LEVELS`` steps. How often each step occurs in all
   documents gives its rank: the rarer, the lower. Steps of hardly any entropy, runs of one byte, are left out.
2. In each span of ``SPAN`` successive windows the leftmost of the least rank gets a point. Spans may reach beyond the
   ends of a text. Windows of ``POINTS`` points or more are the text's improbable features.
3. The distinct features go into Bloom filters of 2048 bits, five bits for each, ``PER_FILTER`` to a filter, in the order
   of the text: a digest, chained as long as the text needs.
4. ``similarity`` compares two digests: each filter of the shorter one meets the filter of the other with which it has most
   bits in common; of these the number expected by chance is taken off, the rest is normalised by the most there could be.

``search`` compares every query with all documents that share a feature with it. Documents of equal digests are one class, compared
once and reported by its least id and its size. Features meet in a join in which the queries' side is the small one; no
feature is left out, however many hold it. ``fingerprint`` takes as queries the documents whose id is divisible by ``EVERY``.

Edge cases: null and empty texts have no features, an empty digest and no matches; a text of fewer than WINDOW bytes has one
feature, itself; repeated rows get equal digests and equal matches, and rows that repeat a doc_id count once in a class; a row
without a doc_id gets a digest and is in no match; a query is no match of itself, though others of its class are; ties are all
reported; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import SLICE, _power_tables, mix, narrow, per_slice, raw, written

WINDOW, SPAN, POINTS = 64, 64, 16
LEVELS = 1000
#: Entropy steps below this are left out.
LEAST_LEVEL = 100
BITS, HASHES, PER_FILTER = 2048, 5, 160
#: Bit overlap above chance from which two digests are a match.
MATCH = 0.3
#: Documents whose id this divides are queries.
EVERY = 100
#: Matches in a row of the result, about: a query that has more gets several rows.
LIST = 10_000
_U = np.uint64
_G = np.concatenate([[0.0], np.arange(1, WINDOW + 2) * np.log2(np.arange(1, WINDOW + 2))])
_G = np.round(_G * (1 << 20)).astype(np.int64)
#: Bytes for which counts are made at once, so that they stay in a near cache.
_TILE = 1 << 17


def levels(data: np.ndarray) -> np.ndarray:
    """Entropy step of each window of WINDOW bytes: of one that starts at each place but the last WINDOW - 1."""
    n = len(data) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int16)
    before, after = np.zeros(len(data), np.uint8), np.zeros(len(data), np.uint8)
    for a in range(0, len(data), _TILE):
        b = min(len(data), a + _TILE)
        for k in range(1, WINDOW):
            lo = max(a, k)
            if lo < b:
                same = (data[lo:b] == data[lo - k : b - k]).view(np.uint8)
                before[lo:b] += same  # equal bytes among the WINDOW - 1 before
                after[lo - k : b - k] += same  # and after
    first = np.bincount(data[:WINDOW], minlength=256)
    # The window moves on: a byte of count c + 1 leaves, one that then has count c comes.
    gone = _G[after[: n - 1].astype(np.int64) + 1] - _G[after[: n - 1]]
    came = _G[before[WINDOW:].astype(np.int64) + 1] - _G[before[WINDOW:]]
    s = np.empty(n, np.int64)
    s[0] = _G[first].sum()
    np.cumsum(came - gone, out=s[1:])
    s[1:] += s[0]
    h = (6 * WINDOW * (1 << 20) - s) * LEVELS // (6 * WINDOW * (1 << 20))
    return np.clip(h, 0, LEVELS).astype(np.int16)


def _inside(off: np.ndarray, n: int) -> np.ndarray:
    """Whether a window that starts at each of n places lies in one text. off: bounds of the texts."""
    out = np.ones(n, bool)
    for k in range(1, WINDOW):
        cut = off[1:-1] - k
        out[cut[(cut >= 0) & (cut < n)]] = False
    return out


def points(level: np.ndarray, inside: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Of each window, in how many spans it is the leftmost of least rank."""
    n = len(level)
    none = 1 << 20
    key = np.full(n + 2 * (SPAN - 1), none << 32, np.int64)
    r = np.where(inside, rank[level], none)
    key[SPAN - 1 : SPAN - 1 + n] = np.where(r < none, (r << 32) | np.arange(n), none << 32)
    k = 1
    while k < SPAN:
        key = np.minimum(key[:-k], key[k:])
        k *= 2
    return np.bincount(key[key < none << 32] & 0xFFFFFFFF, minlength=n)


def _hash(data: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    up, down = _power_tables(len(data) + 1)
    c = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + _U(1)) * up[: len(data)], out=c[1:])
    return mix((c[at + size] - c[at]) * down[at] + _U(0x5EED))


def _pieces(col: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int, int]]:
    """Bytes, bounds and rows of the texts, and from which to which place windows count. One text that is longer than a
    slice comes in pieces that overlap by all that decides about a window."""
    off, data = raw(col)
    step, margin = 2 * SLICE, WINDOW + SPAN
    if len(off) > 2 or len(data) <= step:
        yield data, off, np.arange(len(off) - 1), 0, len(data)
        return
    for a in range(0, len(data), step):
        lo, hi = max(0, a - margin), min(len(data), a + step + margin + WINDOW)
        yield data[lo:hi], np.array([0, hi - lo]), np.zeros(1, np.int64), a - lo, min(a + step, len(data)) - lo


def features(col: pa.Array, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each feature in the order of the text; the distinct ones of each row, first come."""
    rows, hashes = [], []
    for data, off, names, lo, hi in _pieces(col):
        level = levels(data)
        if len(level):
            score = points(level, _inside(off, len(level)), rank)
            at = np.flatnonzero(score[lo:hi] >= POINTS) + lo
            rows.append(names[np.searchsorted(off, at, "right") - 1])
            hashes.append(_hash(data, at, WINDOW))
        size = np.diff(off)
        short = np.flatnonzero((size > 0) & (size < WINDOW)) if len(names) > 1 or hi == len(data) and lo == 0 else np.zeros(0, np.int64)
        if len(short):
            rows.append(names[short])
            hashes.append(np.concatenate([_hash(data[off[i] : off[i + 1]], np.zeros(1, np.int64), int(size[i])) for i in short]))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    row, h = np.concatenate(rows), np.concatenate(hashes)
    order = np.lexsort((np.arange(len(h)), h, row))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (row[order][1:] != row[order][:-1])
    keep = np.sort(order[new])
    keep = keep[np.argsort(row[keep], kind="stable")]
    return row[keep], h[keep]


def filters(row: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Filters in the order of rows as bytes, BITS // 8 to each, and how many each of n rows has."""
    size = np.bincount(row, minlength=n)
    chain = -(-size // PER_FILTER)
    start = np.concatenate([[0], np.cumsum(size)[:-1]])
    base = np.concatenate([[0], np.cumsum(chain)[:-1]])
    which = base[row] + (np.arange(len(row)) - start[row]) // PER_FILTER
    out = np.zeros((int(chain.sum()), BITS), bool)
    for k in range(HASHES):
        out[which, ((h >> _U(11 * k)) & _U(BITS - 1)).astype(np.int64)] = True
    return np.packbits(out, axis=1), chain


def learn(docs: DataFrame) -> np.ndarray:
    """Rank of each entropy step, from the windows of all documents; one pass, of which counts alone are sent."""

    def tally(batch: pa.RecordBatch) -> pa.RecordBatch:
        count = np.zeros(LEVELS + 1, np.int64)
        for data, off, _, lo, hi in _pieces(batch.column("text")):
            level = levels(data)
            good = _inside(off, len(level))[lo:hi]
            count += np.bincount(level[lo:hi][good], minlength=LEVELS + 1)
        at = np.flatnonzero(count)
        return pa.RecordBatch.from_pydict({"level": pa.array(at.astype(np.int32)), "n": pa.array(count[at])})

    found = docs.select("text").mapInArrow(per_slice(tally, "text"), "level int, n long").groupBy("level").agg(F.sum("n").alias("n"))
    count = np.zeros(LEVELS + 1, np.int64)
    for r in found.collect():  # LEVELS + 1 rows at most
        count[r["level"]] = r["n"]
    rank = np.argsort(np.lexsort((-np.arange(LEVELS + 1), count))).astype(np.int64)
    rank[:LEAST_LEVEL] = 1 << 20
    return rank


def digests(docs: DataFrame, rank: np.ndarray, with_features: bool = False) -> DataFrame:
    """doc_id, n_features, digest (an array of filters), with_features also features (hashes): one row for each of docs."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        col = batch.column("text")
        row, h = features(col, rank)
        size = np.bincount(row, minlength=len(col))
        bits, chain = filters(row, h, len(col))
        values = pa.Array.from_buffers(pa.binary(BITS // 8), len(bits), [None, pa.py_buffer(bits.tobytes())]).cast(pa.binary())
        ends = lambda x: pa.array(np.concatenate([[0], np.cumsum(x)]).astype(np.int32))
        cols = {"doc_id": batch.column("doc_id"), "n_features": pa.array(size.astype(np.int32)), "digest": pa.ListArray.from_arrays(ends(chain), values)}
        if with_features:
            cols["features"] = pa.ListArray.from_arrays(ends(size), pa.array(h.view(np.int64)))
        return pa.RecordBatch.from_pydict(cols)

    schema = "doc_id long, n_features int, digest array<binary>" + ", features array<long>" * with_features
    return docs.select("doc_id", "text").mapInArrow(per_slice(run, "text"), schema)


def similarity(a: list[bytes], b: list[bytes]) -> float:
    """From 0, no more bits in common than by chance, to 1."""
    if not a or not b:
        return 0.0
    if (len(a), a) > (len(b), b):  # the same either way round
        a, b = b, a
    x, y = (np.stack([np.frombuffer(f, np.uint64) for f in side]) for side in (a, b))
    nx, ny = np.bitwise_count(x).sum(axis=1).astype(np.float64), np.bitwise_count(y).sum(axis=1).astype(np.float64)
    common = np.stack([np.bitwise_count(f & y).sum(axis=1) for f in x]).astype(np.float64)
    chance = nx[:, None] * ny[None, :] / BITS
    most = np.minimum(nx[:, None], ny[None, :])
    share = np.clip((common - chance) / np.maximum(most - chance, 1e-9), 0, 1)
    weight = nx / nx.sum()
    return float((share.max(axis=1) * weight).sum())


def similarities(a: list[list[bytes]], b: list[list[bytes]]) -> np.ndarray:
    """similarity of each a with its b; digests of one filter all at once."""
    out = np.zeros(len(a))
    plain = np.array([len(x) == 1 and len(y) == 1 for x, y in zip(a, b)], bool)
    for i in np.flatnonzero(~plain).tolist():
        out[i] = similarity(a[i], b[i])
    at = np.flatnonzero(plain)
    if len(at):
        x, y = (np.frombuffer(b"".join(side[i][0] for i in at.tolist()), np.uint64).reshape(len(at), -1) for side in (a, b))
        nx, ny, both = (np.bitwise_count(z).sum(axis=1).astype(np.float64) for z in (x, y, x & y))
        chance = nx * ny / BITS
        out[at] = np.clip((both - chance) / np.maximum(np.minimum(nx, ny) - chance, 1e-9), 0, 1)
    return out


def search(found: DataFrame, queries: DataFrame, least: float = MATCH) -> DataFrame:
    """query_id, doc_id, copies, similarity: for each query the classes of equal digests that are a match; of its own class, the least
    other document and how many others there are. found: doc_id, digest and features; queries: doc_id."""
    with_id = found.where("doc_id is not null and n_features > 0").withColumn("d1", F.xxhash64("digest")).withColumn("d2", F.xxhash64(F.lit(7), "digest"))
    members = written(with_id.select("doc_id", "d1", "d2").distinct(), "digest-members")
    reps = members.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"))
    second = members.join(narrow(reps.where("n > 1").select("d1", "d2", "rep"), 40), ["d1", "d2"]).where("doc_id > rep").groupBy("d1", "d2").agg(F.min("doc_id").alias("second"))
    reps = written(reps.join(second, ["d1", "d2"], "left"), "digest-reps")
    asked = written(queries.select("doc_id").distinct().join(members, "doc_id"), "digest-asked")
    named = reps.select(F.col("rep").alias("doc_id"), "d1", "d2", "rep", "n")

    def of(classes: DataFrame, *columns: str) -> DataFrame:
        """Some columns of the given classes (d1, d2), from the least document of each."""
        first = named.join(narrow(classes, 24), ["d1", "d2"], "left_semi")
        return with_id.join(narrow(first, 50), ["doc_id", "d1", "d2"]).select("d1", "d2", *columns).dropDuplicates(["d1", "d2"])

    asking = of(asked.select("d1", "d2").distinct(), "digest", "features")
    asking = written(asking.toDF("q1", "q2", "q_digest", "features"), "digest-asking")
    wanted = asking.select("q1", "q2", F.explode("features").alias("f"))
    held = with_id.select("d1", "d2", F.explode("features").alias("f"))
    pairs = held.join(narrow(wanted, 40), "f").where("d1 <> q1 or d2 <> q2").select("q1", "q2", "d1", "d2").distinct()
    pairs = written(pairs, "digest-pairs")
    met = of(pairs.select("d1", "d2").distinct(), "rep", "n", "digest")
    sent = pairs.join(met, ["d1", "d2"]).join(narrow(asking.drop("features"), 40 + (BITS // 8 + 16) * F.size("q_digest")), ["q1", "q2"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = similarities(batch.column("digest").to_pylist(), batch.column("q_digest").to_pylist())
            cols = {c: batch.column(c) for c in ("q1", "q2", "rep", "n")} | {"similarity": pa.array(s, pa.float64())}
            yield pa.RecordBatch.from_pydict(cols).filter(pa.array(s >= least, pa.bool_()))

    alike = sent.select("q1", "q2", "rep", "n", "digest", "q_digest").mapInArrow(run, "q1 long, q2 long, rep long, n long, similarity double")
    alike = written(alike, "digest-alike")
    name = asked.select(F.col("doc_id").alias("query_id"), F.col("d1").alias("q1"), F.col("d2").alias("q2"))
    others = alike.join(narrow(name, 32), ["q1", "q2"]).select("query_id", F.col("rep").alias("doc_id"), F.col("n").alias("copies"), "similarity")
    own = asked.join(narrow(reps.where("n > 1"), 60), ["d1", "d2"])
    own = own.select(F.col("doc_id").alias("query_id"), F.expr("if(doc_id = rep, second, rep)").alias("doc_id"), (F.col("n") - 1).alias("copies"), F.lit(1.0).alias("similarity"))
    return others.unionByName(own)


_NONE = "cast(array() as array<struct<similarity:double,doc_id:bigint,copies:bigint>>)"


def fingerprint(docs: DataFrame, least: float = MATCH, every: int = EVERY) -> DataFrame:
    """doc_id, n_features, digest, n_matches, matches: a row for each of docs. Of a query (an id that ``every`` divides), n_matches counts
    the documents that match it, and matches has their classes: similarity, doc_id (the class's least) and copies, most alike
    first; beyond LIST of them in further rows. Of other documents both are null."""
    found = written(digests(docs, learn(docs), True), "digests")
    hits = written(search(found, found.where(F.col("doc_id") % every == 0), least), "digest-matches")
    total = hits.groupBy("query_id").agg(F.sum("copies").alias("n_matches"), F.ceil(F.count("*") / LIST).alias("_rows"))
    lists = hits.join(narrow(total, 32), "query_id").withColumn("_row", F.pmod(F.xxhash64("doc_id"), "_rows"))
    lists = lists.groupBy("query_id", "_row").agg(F.first("n_matches").alias("n_matches"), F.expr("sort_array(collect_list(named_struct('similarity', similarity, 'doc_id', doc_id, 'copies', copies)), false)").alias("matches"))
    near = narrow(written(lists.drop("_row"), "digest-lists"), 64 + 40 * F.size("matches"))
    is_query = F.coalesce(F.col("doc_id") % every == 0, F.lit(False))
    out = found.join(near, found["doc_id"] == near["query_id"], "left")
    return out.select("doc_id", "n_features", "digest", F.when(is_query, F.coalesce("n_matches", F.lit(0))).alias("n_matches"), F.when(is_query, F.coalesce("matches", F.expr(_NONE))).alias("matches"))
