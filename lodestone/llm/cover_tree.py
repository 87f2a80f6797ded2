"""Embedding near-dedup: exact links within a distance, by dual traversal of cover trees.

Vectors are scaled to length 1, so cosine similarity >= t is Euclidean distance <= sqrt(2 - 2t). Equal vectors are one class,
so copies cost nothing more.

The top of the tree is one net for all: centres drawn from the data by the hash of the id, about one for each ``BLOCK_BYTES`` of vectors,
``NET_BYTES`` of them at most. Each vector belongs to the cell of its nearest centre, and a cell has the true greatest distance
from its centre as radius; one of more than BLOCK_BYTES is dealt into blocks by hash. Two cells meet unless the distance of
their centres less both radii is beyond the distance asked for, so far cells are ruled out before anything is shuffled.

Each block gets a cover tree, built once: nested levels whose radii halve. A node covers its points within its radius;
its children are a net of half the radius (no two centres are closer than that) over those points, found farthest first,
and each child keeps the true greatest distance to its points. Blocks of cells that meet are one task for each two. There
the dual traversal starts at the two roots and drops a pair of nodes when d(centres) - radius - radius exceeds the distance,
counts it whole when d(centres) + radius + radius is within it, and otherwise opens both. A leaf counts as its points, nodes
of radius 0: those of all leaves that a node opens to are measured together in single precision, and what may be near
enough exactly, in double precision.

``linked`` returns a row for each vector with a direction: vec_id, class_id (the least id that it is linked to, directly
or through others) and n_links, the other vectors of at least the threshold's similarity. ``near_pairs`` returns the pairs
of classes. Where vectors have no structure, balls overlap and most cells meet: the work, and with it the shuffle of trees, is
then quadratic, n / BLOCK_BYTES trees going to as many tasks each, as exact results ask.

Edge cases: null vectors, vectors of no element or with a null, NaN or infinite element, and zero vectors have no
direction, no link and no row; rows without an id are left out; rows that repeat an id are one vector: with different
vectors it is linked where any of them is, and n_links is summed over them; vectors of different lengths never pair; ties
all count; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import components, narrow, written

#: Cosine similarity from which two vectors are near duplicates.
THRESHOLD = 0.95
#: Bytes of vectors in a block, about.
BLOCK_BYTES = 4_000_000
#: Bytes of centres, at most: they reach the driver and every task. Beyond them cells grow, and are dealt into blocks.
NET_BYTES = 32_000_000
#: Points of a leaf, at most, unless they coincide.
LEAF = 24
#: Scalar products held at once.
_AT_ONCE = 1 << 21
#: What distances from scalar products in double precision may be off, with room to spare.
_SLACK = 1e-6
#: The same in single precision.
_ROUGH = 1e-4


class CoverTree:
    """Of the rows of x. Nodes are numbers: centre (a row), radius, children; a leaf has its range of ``order``."""

    def __init__(self, x: np.ndarray) -> None:
        self.x, self.order = x, np.arange(len(x))
        self.centre: list[int] = []
        self.radius: list[float] = []
        self.children: list[list[int]] = []
        self.range: list[tuple[int, int]] = []
        todo = [(0, len(x), 2.0, -1)]
        while todo:
            a, b, scale, parent = todo.pop()
            rows = self.order[a:b]
            own = x[rows]
            node, d = len(self.centre), _distances(own @ own[0])
            self.centre.append(int(rows[0]))  # a centre comes first in its range
            self.radius.append(float(d.max()))
            self.children.append([])
            self.range.append((a, b))
            if parent >= 0:
                self.children[parent].append(node)
            if b - a <= LEAF or self.radius[node] <= _SLACK:
                continue
            while scale >= self.radius[node]:
                scale /= 2  # a level on which the centre alone covers all its points
            owner, net = np.zeros(b - a, np.int64), 1
            while d[far := int(d.argmax())] > scale:
                other = _distances(own @ own[far])
                other[far] = 0
                closer = np.flatnonzero(other < d)
                d[closer], owner[closer] = other[closer], net
                net += 1
            by = np.lexsort((d, owner))
            self.order[a:b] = rows[by]
            ends = np.cumsum(np.bincount(owner, minlength=net)).tolist()
            todo += [(a + lo, a + hi, scale, node) for lo, hi in zip([0, *ends[:-1]], ends)]
        self.centre_rows = np.array(self.centre, np.int64)
        self.r = np.array(self.radius)


def _distances(dot: np.ndarray) -> np.ndarray:
    """Of vectors of length 1, from their scalar products; less exact than _SLACK only far below it."""
    return np.sqrt(np.maximum(2 - 2 * dot, 0))


class _Side:
    """What a node opens to: its inner children and, for all its leaves at once, their points. A leaf is points alone."""

    def __init__(self, tree: CoverTree, node: int, points: np.ndarray | None = None) -> None:
        kids = [] if points is not None else tree.children[node] or [node]
        self.inner = np.array([k for k in kids if tree.children[k]], np.int64)
        leaves = [tree.order[slice(*tree.range[k])] for k in kids if not tree.children[k]]
        self.points = points if points is not None else np.concatenate(leaves) if leaves else np.zeros(0, np.int64)
        self.centres, self.r = tree.x[tree.centre_rows[self.inner]], tree.r[self.inner]


def dual(s: CoverTree, t: CoverTree, threshold: float, whole: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
    """Yields (rows of s, rows of t, their scalar products), one of each for a pair of at least the threshold; each pair comes
    once, and if s is t as either (i, j) or (j, i), and no row with itself. whole: where all of some rows are near enough to all
    of others, yields both and None instead (if s is t and both are the same rows, any two of them)."""
    far = math.sqrt(max(0.0, 2 - 2 * threshold))
    reach, sure = far + _SLACK, far - 3 * _SLACK
    exact = max(1, _AT_ONCE // s.x.shape[1])
    x32, y32 = s.x.astype(np.float32), t.x.astype(np.float32)
    stack: list[tuple[int, np.ndarray | None, int, np.ndarray | None]] = [(0, None, 0, None)]
    while stack:
        p, a, q, b = stack.pop()
        mirrored = s is t and p == q and a is None and b is None
        if whole and a is None and b is None:
            apart = 0.0 if mirrored else float(_distances(s.x[s.centre[p]] @ t.x[t.centre[q]]))
            if apart + s.radius[p] + t.radius[q] <= sure:
                yield s.order[slice(*s.range[p])], t.order[slice(*t.range[q])], None
                continue
        left, right = _Side(s, p, a), _Side(t, q, b)
        step = max(1, _AT_ONCE // max(1, len(right.points)))
        for k in range(0, len(left.points), step):
            u, v = np.nonzero(x32[left.points[k : k + step]] @ y32[right.points].T >= threshold - _ROUGH)
            if mirrored:
                u, v = u[u + k < v], v[u + k < v]
            u, v = left.points[k + u], right.points[v]
            for c in range(0, len(u), exact):
                i, j = u[c : c + exact], v[c : c + exact]
                dot = np.einsum("ij,ij->i", s.x[i], t.x[j])
                near = dot >= threshold - 1e-12
                if near.any():
                    yield i[near], j[near], dot[near]
        if len(left.inner) and len(right.inner):
            u, v = np.nonzero(_distances(left.centres @ right.centres.T) - left.r[:, None] - right.r[None, :] <= reach)
            for i, j in zip(left.inner[u].tolist(), right.inner[v].tolist()):
                if not mirrored or i <= j:
                    stack.append((i, None, j, None))
        for k, i in enumerate(left.inner.tolist()) if len(right.points) else ():
            near = right.points[_distances(t.x[right.points] @ left.centres[k]) - left.r[k] <= reach]
            if len(near):
                stack.append((i, None, 0, near))
        for k, j in enumerate(right.inner.tolist()) if len(left.points) and not mirrored else ():
            near = left.points[_distances(s.x[left.points] @ right.centres[k]) - right.r[k] <= reach]
            if len(near):
                stack.append((0, near, j, None))


class _Links:
    """Links and connections of rows, counted as they come."""

    def __init__(self, rep: np.ndarray, n: np.ndarray) -> None:
        self.n, self.count, self.label = n, np.zeros(len(n), np.int64), rep.copy()

    def add(self, i: np.ndarray, j: np.ndarray, all_: bool) -> None:
        """Links of each i with its j, or, if all_, of all i with all j (of equal i and j, any two)."""
        if not all_:
            self.count += np.bincount(i, self.n[j], len(self.n)).astype(np.int64) + np.bincount(j, self.n[i], len(self.n)).astype(np.int64)
            self._join(i, j)
            return
        inside = len(i) == len(j) and np.array_equal(i, j)
        self.count[i] += self.n[j].sum() - (self.n[i] if inside else 0)
        if not inside:
            self.count[j] += self.n[i].sum()
        self._join(np.append(i[1:], j), np.broadcast_to(i[:1], len(i) - 1 + len(j)))

    def _join(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            a, b = self.label[i], self.label[j]
            new = a != b
            if not new.any():
                return
            i, j = i[new], j[new]
            high, low = np.maximum(a[new], b[new]), np.minimum(a[new], b[new])
            order = np.lexsort((low, high))
            high, low = high[order], low[order]
            keep = np.concatenate([[True], high[1:] != high[:-1]])  # each greater label takes the least that it meets
            high, low = high[keep], low[keep]
            at = np.minimum(np.searchsorted(high, self.label), len(high) - 1)
            self.label = np.where(high[at] == self.label, low[at], self.label)


def _matrix(col: pa.Array, width: int) -> np.ndarray:
    x = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), width)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares may not vanish or overflow
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class Cells:
    """Centres by width, with the true radius of each cell."""

    def __init__(self, centres: dict[int, np.ndarray]) -> None:
        self.centres = centres
        self.radius: dict[tuple[int, int], float] = {}

    def distances(self, x: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
        c = self.centres[x.shape[1]]
        step = max(1, _AT_ONCE // len(c))
        for a in range(0, len(x), step):
            yield slice(a, a + step), _distances(x[a : a + step] @ c.T)

    def meets(self, w: int, cells: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
        """Each of the given cells, and the equal or greater cells whose balls come within reach of its own."""
        radius = np.array([self.radius.get((w, k), -9.0) for k in range(len(self.centres[w]))])  # an empty cell meets none
        found = [np.zeros((2, 0), np.int64)]
        for at, d in self.distances(self.centres[w][cells]):
            u, v = np.nonzero((d - radius[cells[at]][:, None] - radius[None, :] <= reach) & (np.arange(len(radius))[None, :] >= cells[at][:, None]))
            found.append(np.stack([cells[at][u], v]))
        return tuple(np.concatenate(found, axis=1))


def _by_width(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    w = batch.column("w").to_numpy()
    for width in np.unique(w).tolist():
        yield width, batch.filter(pa.array(w == width))


def _classes(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """members (id, h1, h2), reps (h1, h2, rep, n), and classes with their vector (rep, h1, n, w, x)."""
    good = "exists(x, e -> isnotnull(e) and e <> 0) and not exists(x, e -> isnull(e) or isnan(e) or abs(e) > 1e300)"
    clean = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("x"))
    clean = clean.where("id is not null and x is not null").where(good).withColumn("w", F.size("x"))
    clean = clean.withColumn("h1", F.xxhash64("x")).withColumn("h2", F.xxhash64(F.lit(7), "x"))
    members = written(clean.select("id", "h1", "h2").distinct(), "vector-members")
    reps = written(members.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("n")), "vector-reps")
    one = clean.join(narrow(reps.withColumnRenamed("rep", "id"), 50), ["id", "h1", "h2"]).dropDuplicates(["id", "h1", "h2"])
    return members, reps, written(one.select(F.col("id").alias("rep"), "h1", "n", "w", "x"), "vectors")


def _cells(classes: DataFrame, block_bytes: int) -> Cells:
    share = F.least(F.lit(1.0), F.col("w") * F.lit(8.0) / block_bytes)
    bytes_ = classes.agg(F.sum(share * F.col("w") * 8)).first()[0] or 0.0
    drawn = F.pmod(F.xxhash64(F.lit(3), "rep", "h1"), F.lit(1 << 30)) / float(1 << 30) < share * min(1.0, NET_BYTES / max(1.0, bytes_))
    least = classes.groupBy("w").agg(F.min(F.struct(F.xxhash64("rep", "h1").alias("k"), "x")).alias("s")).select("w", "s.x")  # one for each width at least
    got = classes.where(drawn).select("w", "x").unionByName(least).distinct().toArrow()  # NET_BYTES, about, and a row for each width
    by: dict[int, np.ndarray] = {}
    for batch in got.combine_chunks().to_batches():
        for w, part in _by_width(batch):
            x = _matrix(part.column("x"), w)
            by[w] = np.concatenate([by[w], x]) if w in by else x
    return Cells({w: x[np.lexsort(x.T)] for w, x in by.items()})


_ASSIGNED = "rep long, h1 long, n long, w int, x array<double>, cell int, d double"
_TASK = ("w", "p", "a", "q", "b")


def _tasks(classes: DataFrame, threshold: float, block_bytes: int) -> DataFrame:
    """A row for each tree that a task needs: w, cells p <= q and their blocks a and b, and own, block and tree."""
    reach = math.sqrt(max(0.0, 2 - 2 * threshold)) + _SLACK
    spark = classes.sparkSession
    cells = _cells(classes, block_bytes)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w, part in _by_width(batch):
                found = [(d.argmin(axis=1), d.min(axis=1)) for _, d in cells.distances(_matrix(part.column("x"), w))]
                cell, d = (np.concatenate(x) for x in zip(*found))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell.astype(np.int32)), pa.array(d)], [*part.schema.names, "cell", "d"])

    assigned = written(classes.select("rep", "h1", "n", "w", "x").mapInArrow(assign, _ASSIGNED), "vector-cells")
    sizes = []
    for r in assigned.groupBy("w", "cell").agg(F.max("d").alias("r"), F.count("*").alias("n")).collect():  # a row for each centre at most
        cells.radius[r["w"], r["cell"]] = r["r"] + _SLACK
        sizes.append((r["w"], r["cell"], max(1, math.ceil(r["n"] * r["w"] * 8 / block_bytes))))
    blocks = spark.createDataFrame(sizes, "w int, cell int, blocks int")

    def build(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("rep", "ascending"), ("h1", "ascending")]).combine_chunks()
        tree = CoverTree(_matrix(rows["x"].chunk(0), key[0].as_py()))
        state = pickle.dumps((*(rows[c].to_numpy() for c in ("rep", "h1", "n")), tree.__dict__), 5)
        return pa.table({"w": [key[0].as_py()], "own": [key[1].as_py()], "block": [key[2].as_py()], "tree": [state]}, schema=pa.schema({"w": pa.int32(), "own": pa.int32(), "block": pa.int32(), "tree": pa.binary()}))

    dealt = assigned.drop("d").join(F.broadcast(blocks), ["w", "cell"]).withColumn("block", F.pmod(F.xxhash64("rep", "h1"), "blocks").cast("int"))
    trees = written(dealt.groupBy("w", "cell", "block").applyInArrow(build, "w int, own int, block int, tree binary"), "cover-trees")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w, part in _by_width(batch):
                p, q = cells.meets(w, part.column("cell").to_numpy().astype(np.int64), reach)
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int32)) for x in (np.full(len(p), w), p, q)], ["w", "p", "q"])

    met = blocks.repartition(max(1, min(len(sizes), 10_000))).mapInArrow(meet, "w int, p int, q int")
    for side, block in (("p", "a"), ("q", "b")):
        met = met.join(F.broadcast(blocks.withColumnRenamed("cell", side)), ["w", side]).withColumn(block, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    met = met.where("p < q or a <= b")
    want = written(met.select(*_TASK, F.col("p").alias("own"), F.col("a").alias("block")).union(met.select(*_TASK, "q", "b")).distinct(), "tree-tasks")
    return trees.join(narrow(want, 60), ["w", "own", "block"])


def _meetings(key: tuple, rows: pa.Table, threshold: float, whole: bool):  # noqa: ANN202
    """rep, h1 and n of a task's vectors, and an iterator of (rows, rows, products) as dual yields them."""
    found, start = {}, 0
    for own, block, blob in zip(rows["own"].to_pylist(), rows["block"].to_pylist(), rows["tree"]):
        rep, h1, n, state = pickle.loads(blob.as_buffer())
        tree = CoverTree.__new__(CoverTree)
        tree.__dict__.update(state)
        found[own, block] = (rep, h1, n), tree, start
        start += len(rep)
    _, p, a, q, b = (k.as_py() for k in key)

    def run():  # noqa: ANN202
        if (p, a) in found and (q, b) in found:  # else a block that got no vector
            (_, s, left), (_, t, right) = found[p, a], found[q, b]
            for i, j, dot in dual(s, t, threshold, whole):
                yield i + left, j + right, dot

    return *(np.concatenate([x[0][k] for x in found.values()]) for k in range(3)), run()


def near_pairs(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """id_a < id_b and cosine: all pairs of at least the threshold of the least ids of classes of equal vectors, and (least id, other, 1.0)
    within a class. As many as there are: a group of m different vectors near each other has m * m / 2."""
    members, reps, classes = _classes(vectors, id_col, vector_col)

    def task(key: tuple, rows: pa.Table) -> pa.Table:
        rep, _, _, found = _meetings(key, rows, threshold, False)
        out = []
        for i, j, dot in found:
            a, b = rep[i], rep[j]
            keep = a != b
            out.append((np.minimum(a, b)[keep], np.maximum(a, b)[keep], np.minimum(dot, 1.0)[keep]))
        a, b, c = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"id_a": a, "id_b": b, "cosine": c})

    across = _tasks(classes, threshold, block_bytes).groupBy(*_TASK).applyInArrow(task, "id_a long, id_b long, cosine double")
    within = members.join(narrow(reps.where("n > 1"), 50), ["h1", "h2"]).where("id > rep").select(F.col("rep").alias("id_a"), F.col("id").alias("id_b"), F.lit(1.0).alias("cosine"))
    return across.unionByName(within).groupBy("id_a", "id_b").agg(F.max("cosine").alias("cosine"))


def linked(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """vec_id, class_id, n_links: a row for each vector that has a direction; see the module's docstring."""
    members, reps, classes = _classes(vectors, id_col, vector_col)

    def task(key: tuple, rows: pa.Table) -> pa.Table:
        rep, h1, n, found = _meetings(key, rows, threshold, True)
        links = _Links(rep, n)
        for i, j, dot in found:
            links.add(i, j, dot is None)
        hit = np.flatnonzero(links.count)
        return pa.table({"rep": rep[hit], "h1": h1[hit], "links": links.count[hit], "root": links.label[hit]})

    found = written(_tasks(classes, threshold, block_bytes).groupBy(*_TASK).applyInArrow(task, "rep long, h1 long, links long, root long"), "vector-links")
    counts = found.groupBy("rep", "h1").agg(F.sum("links").alias("links"))
    several = written(members.groupBy("id").agg(F.count("*").alias("k")).where("k > 1").select("id"), "vector-several")
    mixed = members.join(narrow(several, 16), "id").join(reps, ["h1", "h2"]).select(F.col("id").alias("u"), F.col("rep").alias("v"))
    roots = components(found.select(F.col("rep").alias("u"), F.col("root").alias("v")).unionByName(mixed))
    all_ = reps.join(counts, ["rep", "h1"], "left").join(roots.withColumnRenamed("v", "rep"), "rep", "left")
    all_ = all_.select("h1", "h2", F.coalesce("root", "rep").alias("class_id"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    near = narrow(written(all_.where("n_links > 0"), "vector-linked"), 60)
    every = members.join(near, ["h1", "h2"], "left").select(F.col("id").alias("vec_id"), F.coalesce("class_id", "id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return every.groupBy("vec_id").agg(F.min("class_id").alias("class_id"), F.sum("n_links").alias("n_links"))
