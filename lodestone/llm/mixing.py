"""Mixing sources to target weights by pivotal (dependent) rounding.

Each source s gets the share w_s of ``total`` copies, so each of its n_s documents gets w_s * total / n_s of them: a whole
number and a fraction. Fractions are rounded in pairs: two units meet, and mass moves at random from one to the other
until one is 0 or 1. Sums stay as they are, so the copies of each source differ from their target by less than 1, and their
total not at all (while each document's own chance stays its fraction).

Partitions round their own units in one pass and write the decided rows; at most one unit for each source and partition
is left open. These residuals, small rows without texts, meet in a reduction tree: first within a source, ``FAN`` at a
time, then across sources. Decisions are joined to the rows left open alone. Random numbers are hashes of the seed, the partition and
the place in it, so a task that runs again decides alike, and the table written in between fixes what it decided: a lost
executor changes nothing. The same rows in other partitions give another sample of the same sizes.

Edge cases: a null source is a source of its own; a source without a target weight gets no copies, and weights of sources
that have no documents are spread over the others; repeated rows are documents of their own; null and empty texts are
documents like others; all columns stay, whatever their names, as they are renamed while it works; an empty table gives an empty result;
negative weights raise ValueError.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import small_enough, written

#: Without given weights, a source weighs as its size to this power.
SMOOTHING = 0.5
#: Units that meet in a node of the tree.
FAN = 64
_STATE = "_mix_part int, _mix_source string, _mix_unit long, _mix_p double"


def _uniform(*what: object) -> float:
    import hashlib

    return (int.from_bytes(hashlib.blake2b(repr(what).encode(), digest_size=8).digest(), "little") + 0.5) / 2**64


def duel(p: float, q: float, u: float) -> tuple[float, float]:
    """Two fractions after mass has moved until one is integral; u is uniform. Each keeps its expectation."""
    total = p + q
    if total <= 1:
        return (total, 0.0) if u * total < p else (0.0, total)
    return (1.0, total - 1) if u * (2 - total) < 1 - q else (total - 1, 1.0)


def _close(p: float) -> float:
    return round(p) if abs(p - round(p)) < 1e-9 else p


def rates(docs: DataFrame, weights: dict[str | None, float] | None = None, total: int | None = None, smoothing: float = SMOOTHING) -> DataFrame:
    """_mix_source and _mix_rate, the copies of a document of that source. Counts all rows; total: as many as there are."""
    sizes = docs.groupBy(F.col("source").alias("_mix_source")).agg(F.count("*").alias("n"))
    if weights is None:
        sizes = sizes.withColumn("w", F.pow("n", F.lit(float(smoothing))))
    else:
        if any(w < 0 for w in weights.values()):
            raise ValueError("weights may not be negative")
        given = docs.sparkSession.createDataFrame([(k, float(w)) for k, w in weights.items()], "k string, w double")
        sizes = sizes.join(F.broadcast(given), F.col("_mix_source").eqNullSafe(F.col("k")), "left").select("_mix_source", "n", F.coalesce("w", F.lit(0.0)).alias("w"))
    sums = sizes.agg(F.sum("w").alias("sum_w"), F.sum("n").alias("sum_n"))
    target = F.lit(float(total)) if total is not None else F.col("sum_n").cast("double")
    return sizes.crossJoin(F.broadcast(sums)).select("_mix_source", F.coalesce(F.try_divide(F.col("w"), F.col("sum_w")) * target / F.col("n"), F.lit(0.0)).alias("_mix_rate"))


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, total: int | None = None, seed: int = 1, smoothing: float = SMOOTHING) -> DataFrame:
    """docs, each row as often as it got copies."""
    names = docs.columns
    docs = docs.toDF(*[f"c{k}" for k in range(len(names))])  # no name of theirs meets one of ours
    source = f"c{[n.lower() for n in names].index('source')}"
    return _mixed(docs, source, weights, total, seed, smoothing).toDF(*names)


def _mixed(docs: DataFrame, source: str, weights: dict[str | None, float] | None, total: int | None, seed: int, smoothing: float) -> DataFrame:
    columns = docs.columns
    rate = written(rates(docs.select(F.col(source).alias("source")), weights, total, smoothing), "mix-rates")
    rate = F.broadcast(rate) if small_enough(rate, 100) else rate
    rated = docs.join(rate, docs[source].eqNullSafe(rate["_mix_source"]))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        waiting: dict[str | None, tuple[float, pa.RecordBatch, int]] = {}  # of each source the unit that isn't integral yet
        seen = 0

        def decided(rows: pa.RecordBatch, copies: pa.Array, units: pa.Array, left: pa.Array) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*rows.columns[:-2], copies, pa.array([part] * rows.num_rows, pa.int32()), rows.column("_mix_source"), units, left], schema=None, names=[*rows.schema.names[:-2], "_mix_copies", "_mix_part", "_mix_source", "_mix_unit", "_mix_p"])

        for batch in batches:
            rates = batch.column("_mix_rate").to_pylist()
            bonus: list[int | None] = [0] * len(rates)
            freed: list[tuple[pa.RecordBatch, int, int]] = []
            open_here: dict[str | None, tuple[float, int]] = {}
            for i, (source, rate) in enumerate(zip(batch.column("_mix_source").to_pylist(), rates)):
                f = _close(rate - int(rate + 1e-9))
                if f in (0, 1):
                    bonus[i] = int(f)
                    continue
                held = open_here.get(source)
                before = held or ((waiting[source][0], -1) if source in waiting else None)
                if before is None:
                    open_here[source], bonus[i] = (f, i), None
                    continue
                p, q = map(_close, duel(before[0], f, _uniform(seed, part, seen + i, source)))

                def settle(value: float, source: str | None = source, at: int = before[1]) -> None:
                    if at >= 0:
                        bonus[at] = int(value)
                    else:
                        _, row, unit = waiting.pop(source)
                        freed.append((row, unit, int(value)))

                if p in (0, 1):
                    settle(p)
                    if q in (0, 1):
                        bonus[i] = int(q)
                        open_here.pop(source, None)
                    else:
                        open_here[source], bonus[i] = (q, i), None
                else:
                    bonus[i] = int(q)
                    if before[1] >= 0:
                        open_here[source] = (p, before[1])
                    else:
                        waiting[source] = (p, *waiting[source][1:])
            for source, (p, i) in open_here.items():
                # A copy of one row: a slice would keep the whole batch.
                waiting[source] = (p, batch.take(pa.array([i])), seen + i)
            for row, unit, value in freed:
                yield decided(row, pa.array([int(row.column("_mix_rate")[0].as_py() + 1e-9) + value], pa.int64()), pa.array([unit], pa.int64()), pa.array([None], pa.float64()))
            there = pa.array([b is not None for b in bonus], pa.bool_())
            copies = pa.array([None if b is None else int(r + 1e-9) + b for r, b in zip(rates, bonus)], pa.int64())
            units = pa.array(range(seen, seen + len(rates)), pa.int64())
            some = pa.RecordBatch.from_arrays([*batch.columns, copies, units], names=[*batch.schema.names, "c", "u"]).filter(there)
            if some.num_rows:
                yield decided(some.select(batch.schema.names), some.column("c"), some.column("u"), pa.nulls(some.num_rows, pa.float64()))
            seen += len(rates)
        for p, row, unit in waiting.values():
            yield decided(row, pa.array([int(row.column("_mix_rate")[0].as_py() + 1e-9)], pa.int64()), pa.array([unit], pa.int64()), pa.array([p], pa.float64()))

    ordered = rated.select(*[docs[c] for c in columns], "_mix_source", "_mix_rate")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + ", _mix_copies long, " + _STATE
    first = written(ordered.mapInArrow(local, schema), "mix-rounded")
    left = first.where("_mix_p is not null")
    bonus = _reduce(left.select("_mix_part", "_mix_source", "_mix_unit", "_mix_p"), seed)
    bonus = F.broadcast(bonus) if small_enough(bonus, 100) else bonus
    late = left.join(bonus, ["_mix_part", "_mix_unit"]).withColumn("_mix_copies", F.col("_mix_copies") + F.col("_mix_bonus"))
    every = first.where("_mix_p is null").select(*columns, "_mix_copies").unionByName(late.select(*columns, "_mix_copies"))
    return every.where("_mix_copies > 0").withColumn("_mix_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_mix_copies")))).select(*columns)


def _reduce(units: DataFrame, seed: int) -> DataFrame:
    """_mix_part, _mix_unit and _mix_bonus, 0 or 1, of all units: nodes of FAN units, level by level, until one node is left."""

    def node(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("_mix_source", "ascending"), ("_mix_part", "ascending"), ("_mix_unit", "ascending")])
        parts, ids, p = rows["_mix_part"].to_pylist(), rows["_mix_unit"].to_pylist(), rows["_mix_p"].to_pylist()
        k = 0
        for i in range(1, len(p)):
            p[k], p[i] = map(_close, duel(p[k], p[i], _uniform(seed, "tree", parts[i], ids[i], parts[k], ids[k])))
            if p[k] in (0, 1):
                k = i  # the other one stays open
        return pa.table({"_mix_part": pa.array(parts, pa.int32()), "_mix_source": rows["_mix_source"], "_mix_unit": pa.array(ids, pa.int64()), "_mix_p": pa.array([float(x) for x in p], pa.float64())})

    found = None
    now = written(units, "mix-tree")
    for across in (False, True):
        while True:
            groups = "1" if across else "_mix_source"
            stats = now.groupBy(F.expr(groups).alias("g")).count().agg(F.max("count"), F.count("*")).first()
            if not stats[0] or stats[0] == 1:
                break
            rank = F.expr(f"row_number() over (partition by {'pmod(xxhash64(_mix_source), 1000003)' if across else '_mix_source'} order by _mix_source, _mix_part, _mix_unit)")
            place = now.withColumn("_mix_node", F.floor((rank - 1) / FAN)).withColumn("_mix_node", F.when(F.lit(across and stats[0] <= FAN), F.lit(0)).otherwise(F.xxhash64(F.lit(None) if across else F.col("_mix_source"), F.col("_mix_node"), F.pmod(F.xxhash64("_mix_source"), F.lit(max(1, stats[0] // FAN))) if across else F.lit(0))))
            done = written(place.groupBy("_mix_node").applyInArrow(node, _STATE), "mix-tree")
            settled = done.where("_mix_p in (0, 1)")
            found = settled if found is None else found.unionByName(settled)
            now = done.where("_mix_p not in (0, 1)")
            if across and stats[0] <= FAN:
                break
    # What is left over at the root is the one unit whose chance no other could take up.
    root = now.withColumn("_mix_p", F.when(F.pmod(F.xxhash64(F.lit(seed), "_mix_part", "_mix_unit"), F.lit(1 << 30)) < F.col("_mix_p") * (1 << 30), 1.0).otherwise(0.0))
    found = root if found is None else found.unionByName(root)
    return found.select("_mix_part", "_mix_unit", F.col("_mix_p").cast("int").alias("_mix_bonus"))
