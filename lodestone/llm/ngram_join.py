"""Jaccard self-join of documents over sets of word n-grams: size-banded tiles with hashed bitmaps.

1. Each text becomes a set of hashed n-grams. Documents with equal sets are one class, so copies cost nothing more.
2. Classes meet where a band of their MinHash signature agrees (``ROWS`` minima to a band, ``BANDS`` bands: a pair at
   the threshold of 0.5 meets with probability 0.99998, a pair at 0.55 with 0.9999995). No bucket is capped.
3. A class belongs to the tile of the least class with which it shares a bucket and which size and 256-bit bitmap don't
   rule out (popcount(A & ~B) elements of A can't be in B); without one, to its own. Where a bucket holds several tiles,
   its classes also visit the lesser ones. So a group of near copies is one tile, and its pairs are never rows.
4. Within a tile sets lie by size, so only those within the band of sizes meet; wider bitmaps bound the overlap from above;
   the sorted arrays of the pairs left are intersected exactly, one set with all that are left for it at once. Tiles of
   more than TILE_BYTES or TILE_SETS are split into blocks, of which any two meet in one task. What leaves a task
   is a row for each set: its number of links, and the least document that it is connected to there.

``linked`` returns a row for each document: doc_id, class_id (the least doc_id that it is linked to, directly or through
others) and n_links, the other documents whose similarity to it is at least the threshold. What is counted is exact: a
link is lost only if its classes share no bucket and no tile.

Edge cases: texts that are null or have no word have no set and no link; a text of fewer than n words is one n-gram;
rows without doc_id are left out; rows that repeat a doc_id are one document: with different texts it is linked where any of
them is, and n_links is summed over its texts; an empty table gives an empty result; further columns are ignored, whatever
their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import components, mix, narrow, per_slice, word_hashes, written

N = 3
THRESHOLD = 0.5
BANDS, ROWS = 80, 3
#: Bytes of sets, and sets, in a block of a tile, about.
TILE_BYTES, TILE_SETS = 16_000_000, 4_000
_U = np.uint64


def shingles(col: pa.Array, n: int) -> list[np.ndarray]:
    """Of each row, the ascending 64-bit hashes of its distinct word n-grams."""
    h, row = word_hashes(col)
    size = np.bincount(row, minlength=len(col))
    starts = np.concatenate([[0], np.cumsum(size)])
    padded = np.concatenate([h, np.zeros(n, np.uint64)])
    gram = np.zeros(len(h), np.uint64)
    left = starts[row + 1] - np.arange(len(h)) if len(h) else np.zeros(0, np.int64)  # words from here to the row's end
    for k in range(n):
        gram += np.where(left > k, padded[k : k + len(h)], _U(0)) * _U(0x9E3779B97F4A7C15 * (2 * k + 1) & (2**64 - 1))
    gram = mix(gram)
    return [np.unique(gram[a : max(a + 1, b - n + 1)]) if b > a else gram[:0] for a, b in zip(starts, starts[1:])]


def _prints(flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit fingerprints of each set; flat: the sets one after the other, at: where they begin."""
    return np.add.reduceat(mix(flat + _U(1)), at).view(np.int64), np.bitwise_xor.reduceat(mix(flat + _U(7)), at).view(np.int64)


def _signatures(n: int, bands: int, rows: int):  # noqa: ANN202
    rng = np.random.default_rng(20)
    factors = rng.integers(0, 2**63, bands * rows, np.uint64) * _U(2) + _U(1)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        sets = shingles(batch.column("text"), n)
        there = np.flatnonzero([len(s) > 0 for s in sets])
        if not len(there):
            return None
        flat = np.concatenate([sets[i] for i in there])
        size = np.array([len(sets[i]) for i in there])
        at = np.concatenate([[0], np.cumsum(size)[:-1]])
        keys = np.zeros((len(there), bands), np.uint64)
        for k in range(bands * rows):
            least = np.minimum.reduceat(flat * factors[k], at)
            keys[:, k // rows] = mix(keys[:, k // rows] * _U(31) + least + _U(k))
        bits = np.zeros((len(there), 256), bool)
        bits[np.repeat(np.arange(len(there)), size), (flat >> _U(56)).astype(np.int64)] = True
        words = np.packbits(bits, axis=1).view(np.int64)
        f1, f2 = _prints(flat, at)
        cols = {"doc_id": batch.column("doc_id").take(pa.array(there)), "size": pa.array(size.astype(np.int32)), "f1": pa.array(f1), "f2": pa.array(f2)}
        cols["keys"] = pa.ListArray.from_arrays(pa.array(np.arange(0, len(there) * bands + 1, bands, dtype=np.int32)), pa.array(keys.reshape(-1).view(np.int64)))
        cols |= {f"b{k}": pa.array(np.ascontiguousarray(words[:, k])) for k in range(4)}
        return pa.RecordBatch.from_pydict(cols)

    return run


_SIGNED = "doc_id long, size int, f1 long, f2 long, keys array<long>, b0 long, b1 long, b2 long, b3 long"
_BITS = ("b0", "b1", "b2", "b3")


class Classes:
    """Documents by equal sets. members: doc_id, f1, f2, size; classes: rep (the least doc_id), f1, f2, size, n (documents),
    keys, b0 to b3. A class is told by rep and f1; rep alone names it, but for a doc_id that has several texts."""

    def __init__(self, docs: DataFrame, n: int = N, bands: int = BANDS, rows: int = ROWS) -> None:
        one = docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(per_slice(_signatures(n, bands, rows), "text"), _SIGNED)
        signed = written(one, "ngram-signed")
        # Both aggregates are partial before the shuffle: a set that a third of all rows have is one row of each task.
        self.members = signed.select("doc_id", "f1", "f2", "size").distinct()
        reps = written(self.members.groupBy("f1", "f2", "size").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "ngram-reps")
        of = narrow(reps.select("f1", "f2", "size", F.col("rep").alias("doc_id"), "n"), 60)
        self.reps = reps
        self.classes = written(signed.join(of, ["doc_id", "f1", "f2", "size"]).dropDuplicates(["doc_id", "f1"]).withColumnRenamed("doc_id", "rep"), "ngram-classes")


def _fits(x: str, y: str, threshold: float) -> str:
    """SQL: whether sizes and bitmaps of two sides leave it open that they are similar."""
    lone = lambda p, q: " + ".join(f"bit_count({p}.{b} & ~{q}.{b})" for b in _BITS)
    bound = f"least({x}.size - ({lone(x, y)}), {y}.size - ({lone(y, x)})) >= {threshold / (1 + threshold)!r}d * ({x}.size + {y}.size) - 1e-6d"
    return f"{x}.size >= {threshold!r}d * {y}.size and {y}.size >= {threshold!r}d * {x}.size and {bound}"


def _may_fit(threshold: float) -> str:
    """SQL: whether a set (size and bits) may be similar to any of some, of which the least and greatest size are known, and the bits
    that any and all of them have. Of one set it is what _fits tells."""
    rate = threshold / (1 + threshold)
    mine = " + ".join(f"bit_count({b} & ~any_{b})" for b in _BITS)  # elements that none of them has
    theirs = " + ".join(f"bit_count(all_{b} & ~{b})" for b in _BITS)  # elements that each of them has beyond the set
    sizes = f"size >= {threshold!r}d * least_size and most_size >= {threshold!r}d * size"
    return f"{sizes} and size - ({mine}) >= {rate!r}d * (size + least_size) - 1e-6d and most_size - ({theirs}) >= {rate!r}d * (size + most_size) - 1e-6d"


def _tiled(classes: DataFrame, threshold: float) -> DataFrame:
    """tile, rep, f1, f2, n, size, guest: the tile that each class belongs to, and those that it visits; only tiles of two or more."""
    keyed = classes.select("rep", "f1", F.explode("keys").alias("key"))
    shared = written(keyed.groupBy("key").agg(F.count("*").alias("m"), F.min("rep").alias("first")).where("m > 1").drop("m"), "ngram-shared")
    met = written(keyed.join(narrow(shared, 40), "key"), "ngram-met")  # key, rep, f1, first
    traits = classes.select("rep", "f1", "f2", "n", "size", *_BITS)
    first = met.where("first < rep").select("rep", "f1", "first").distinct()
    heads = narrow(written(traits.join(narrow(first.select(F.col("first").alias("rep")).distinct(), 16), "rep", "left_semi"), "ngram-heads"), 90)
    x, y = traits.alias("x"), heads.alias("y")
    led = first.alias("m").join(x, (F.col("m.rep") == F.col("x.rep")) & (F.col("m.f1") == F.col("x.f1"))).join(y, F.col("m.first") == F.col("y.rep")).where(_fits("x", "y", threshold))
    lead = written(led.groupBy(F.col("x.rep").alias("rep"), F.col("x.f1").alias("f1")).agg(F.min("m.first").alias("lead")), "ngram-lead")
    placed = met.select("key", "rep", "f1").join(narrow(lead, 40), ["rep", "f1"], "left").withColumn("lead", F.coalesce("lead", "rep"))
    placed = written(placed, "ngram-placed")
    # Of a bucket's tiles each is one row, however many classes it has there, with bounds on the sizes and bitmaps of them all.
    tiles = placed.groupBy("key", "lead").agg(F.count("*").alias("m"))
    several = tiles.groupBy("key").agg(F.count("*").alias("k"), F.min("lead").alias("least")).where("k > 1").select("key", "least")
    several = written(several, "ngram-several")
    crowd = placed.join(narrow(several, 30), "key").join(traits.drop("f2", "n"), ["rep", "f1"])
    crowd = written(crowd, "ngram-crowd")  # the classes of buckets with several tiles
    held = [F.min("size").alias("least_size"), F.max("size").alias("most_size"), *[F.expr(f"bit_or({b})").alias(f"any_{b}") for b in _BITS], *[F.expr(f"bit_and({b})").alias(f"all_{b}") for b in _BITS]]
    ahead = crowd.groupBy("key", F.col("lead").alias("tile")).agg(*held)
    guests = crowd.where("lead > least").join(ahead, "key").where("tile < lead").where(_may_fit(threshold))
    visits = guests.select("rep", "f1", "tile").distinct()
    visits = written(visits, "ngram-visits")
    own = placed.select("rep", "f1", F.col("lead").alias("tile")).distinct()
    used = own.where("tile <> rep").select("tile").unionByName(visits.select("tile")).distinct()
    every = own.join(narrow(written(used, "ngram-tiles"), 16), "tile", "left_semi").withColumn("guest", F.lit(False)).unionByName(visits.withColumn("guest", F.lit(True)))
    return every.join(traits.select("rep", "f1", "f2", "n", "size"), ["rep", "f1"])


def compare(sets: list[np.ndarray], threshold: float, first: np.ndarray, second: np.ndarray, guest: np.ndarray, only_connect: bool = False):  # noqa: ANN201
    """Yields (i, those j that are similar to i). Each pair of sets comes once at most that has one in first and one in second,
    and not both guests. only_connect: leaves out pairs that those yielded before connect already."""
    size = np.array([len(s) for s in sets], np.int64)
    order = np.argsort(size, kind="stable")
    sets, size, first, second, guest = [sets[i] for i in order], size[order], first[order], second[order], guest[order]
    m = len(sets)
    values, place = np.unique(np.concatenate(sets), return_inverse=True)
    place = place.astype(np.int32 if len(values) < 2**31 else np.int64)
    begin = np.concatenate([[0], np.cumsum(size)])
    width = max(512, 1 << int(2 * size[-1] - 1).bit_length())
    bits = np.zeros((m, width // 64), np.uint64)
    hashed = values & _U(width - 1)
    for k in range(m):  # a row at a time: no table of booleans
        row = np.zeros(width, bool)
        row[hashed[place[begin[k] : begin[k + 1]]].astype(np.int64)] = True
        bits[k] = np.packbits(row).view(np.uint64)
    held = np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
    hidden = size - held  # elements that share a bit with another one of their own set
    mark = np.zeros(len(values), np.uint8)
    label = np.arange(m)
    rate = threshold / (1 + threshold)
    at_once = max(1, 4_000_000 // (width // 64))
    hosts = np.flatnonzero(~guest)
    for i in hosts.tolist():  # each pair has one that is no guest: guests meet these from either side, others from the lesser
        low = int(np.searchsorted(size, threshold * size[i] - 1e-6))  # the band of sizes
        upto = int(np.searchsorted(size, size[i] / threshold + 1e-6, "right"))
        want = (first[i] & second[low:upto]) | (second[i] & first[low:upto])
        want[: i + 1 - low] &= guest[low : i + 1]
        want[i - low] = False
        if only_connect:
            want &= label[low:upto] != label[i]
        js = np.flatnonzero(want) + low
        if not len(js):
            continue
        common = np.concatenate([np.bitwise_count(bits[js[a : a + at_once]] & bits[i]).sum(axis=1, dtype=np.int64) for a in range(0, len(js), at_once)])
        need = rate * (size[i] + size[js]) - 1e-6
        js = js[np.minimum(hidden[i], hidden[js]) + common >= need]
        if not len(js):
            continue
        mark[place[begin[i] : begin[i + 1]]] = 1
        found = []
        a = 0
        while a < len(js):
            if only_connect and a:  # what has become connected meanwhile needs no look
                js = np.concatenate([js[:a], js[a:][label[js[a:]] != label[i]]])
                if a >= len(js):
                    break
            b = a + 1 if only_connect and not a else min(len(js), a + 4096)
            part = js[a:b]
            if 2 * int(size[part].sum()) >= int(begin[part[-1] + 1] - begin[part[0]]):
                span = mark[place[begin[part[0]] : begin[part[-1] + 1]]]
                sums = np.add.reduceat(span, begin[part[0] : part[-1] + 1] - begin[part[0]], dtype=np.int64)[part - part[0]]
            else:
                sums = np.array([int(mark[place[begin[j] : begin[j + 1]]].sum()) for j in part.tolist()], np.int64)
            found.append(part[sums >= threshold * (size[i] + size[part] - sums) - 1e-9])
            a = b
        mark[place[begin[i] : begin[i + 1]]] = 0
        js = np.concatenate(found)
        if len(js):
            if only_connect:
                gone = np.unique(label[np.append(js, i)])
                label[np.isin(label, gone)] = gone[0]
            yield int(order[i]), order[js]


def _verify(threshold: float, only_connect: bool):  # noqa: ANN202
    def run(rows: pa.Table) -> pa.Table:
        out: dict[str, list[np.ndarray]] = {c: [] for c in ("rep", "f1", "links", "root")}
        rows = rows.combine_chunks()
        tile, p, q, block, rep, f1, n = (rows[c].to_numpy() for c in ("tile", "p", "q", "block", "rep", "f1", "n"))
        guest = rows["guest"].to_numpy(zero_copy_only=False)
        bodies = rows["s"].chunk(0) if rows["s"].num_chunks else []
        order = np.lexsort((f1, rep, q, p, tile))
        cuts = np.flatnonzero((np.diff(tile[order]) != 0) | (np.diff(p[order]) != 0) | (np.diff(q[order]) != 0)) + 1
        for group in np.split(order, cuts):
            if len(group) > 1:  # a repeated row brings its set twice
                same = (np.diff(rep[group]) == 0) & (np.diff(f1[group]) == 0) & (np.diff(block[group]) == 0) & (np.diff(guest[group].astype(int)) == 0)
                group = group[np.concatenate([[True], ~same])]
            if len(group) < 2:
                continue
            sets = [np.frombuffer(bodies[i].as_buffer(), "<u8") for i in group.tolist()]
            first, second = block[group] == p[group], block[group] == q[group]
            links, label = np.zeros(len(group), np.int64), rep[group].copy()
            for i, js in compare(sets, threshold, first, second, guest[group], only_connect):
                links[i] += n[group][js].sum()
                links[js] += n[group][i]
                joined = np.unique(label[np.append(js, i)])
                if len(joined) > 1:
                    label[np.isin(label, joined)] = joined[0]
            hit = links > 0
            for c, x in (("rep", rep[group]), ("f1", f1[group]), ("links", links), ("root", label)):
                out[c].append(x[hit])
        return pa.table({c: np.concatenate(x) if x else np.zeros(0, np.int64) for c, x in out.items()})

    return run


def links_of(docs: DataFrame, threshold: float = THRESHOLD, n: int = N, bands: int = BANDS, rows: int = ROWS, only_connect: bool = False) -> tuple[Classes, DataFrame]:
    """The classes, and rep, f1, links, root: linked documents of other classes, and a lesser or equal document to which a class
    is connected, once or more for each class that has a link. only_connect: links may be too few, connections are whole."""
    known = Classes(docs, n, bands, rows)
    spark = docs.sparkSession
    placed = written(_tiled(known.classes, threshold), "ngram-placed")
    volume = placed.agg(F.sum(F.col("size") * 8)).first()[0] or 0
    blocks = placed.groupBy("tile").agg(F.ceil(F.greatest(F.sum("size") * 8 / TILE_BYTES, F.count("*") / TILE_SETS)).cast("int").alias("blocks")).where("blocks > 1")
    placed = placed.join(narrow(written(blocks, "ngram-blocks"), 16), "tile", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("rep", "f1"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    parts = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(volume / TILE_BYTES))
    p, q = F.least("block", "other"), F.greatest("block", "other")
    where = F.struct(F.pmod(F.xxhash64("tile", p, q), F.lit(parts)).alias("part"), "tile", p.alias("p"), q.alias("q"), "block", "guest", "f1", "f2", "n")
    sent = written(placed.groupBy(F.col("rep").alias("doc_id")).agg(F.collect_list(where).alias("_tiles")), "ngram-sent")
    texts = docs.select("doc_id", "text").join(narrow(sent, 150), "doc_id")
    names = ("part", "tile", "p", "q", "block", "guest", "f1", "n")

    def arrays(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        found = []
        sets = shingles(batch.column("text"), n)
        for v, tiles, s in zip(batch.column("doc_id").to_pylist(), batch.column("_tiles").to_pylist(), sets):
            if len(s):
                f1, f2 = (int(x[0]) for x in _prints(s, np.zeros(1, np.int64)))
                body = s.tobytes()
                found += [(*(t[c] for c in names), v, body) for t in tiles if t["f1"] == f1 and t["f2"] == f2]
        if not found:
            return None
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*found), kinds)], [*names, "rep", "s"])

    sets = texts.mapInArrow(per_slice(arrays, "text"), "part long, tile long, p int, q int, block int, guest boolean, f1 long, n long, rep long, s binary")
    return known, sets.groupBy("part").applyInArrow(_verify(threshold, only_connect), "rep long, f1 long, links long, root long")


def linked(docs: DataFrame, threshold: float = THRESHOLD, only_connect: bool = False, **how: int) -> DataFrame:
    """doc_id, class_id, n_links: a row for each document; see the module's docstring."""
    known, found = links_of(docs, threshold, only_connect=only_connect, **how)
    found = written(found, "ngram-links")
    counts = found.groupBy("rep", "f1").agg(F.sum("links").alias("links"))
    # A document that has several texts connects their classes; it stands in members once for each.
    several = known.members.groupBy("doc_id").agg(F.count("*").alias("k")).where("k > 1").select("doc_id")
    several = written(several, "ngram-several")
    mixed = known.members.join(narrow(several, 16), "doc_id").join(known.reps, ["f1", "f2", "size"]).select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    roots = components(found.select(F.col("rep").alias("u"), F.col("root").alias("v")).unionByName(mixed))
    whole = known.reps.join(counts, ["rep", "f1"], "left").join(roots.withColumnRenamed("v", "rep"), "rep", "left")
    whole = whole.select("f1", "f2", "size", F.coalesce("root", "rep").alias("class_id"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    near = narrow(written(whole.where("n_links > 0"), "ngram-linked"), 60)
    every = known.members.join(near, ["f1", "f2", "size"], "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    rest = docs.where("doc_id is not null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return every.unionByName(rest).groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.sum("n_links").alias("n_links"))


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, **how: int) -> DataFrame:
    """docs without those that are linked, directly or through others, to a document of a smaller id.

    Every column stays. Documents without a partner, without a word or without an id all stay. Within a task, pairs that
    are connected already are not compared."""
    gone = linked(docs, threshold, only_connect=True, **how).where("class_id <> doc_id").select(F.col("doc_id").alias("_gone"))
    gone = narrow(written(gone, "ngram-gone"), 40)
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
