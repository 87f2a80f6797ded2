"""Custody: file digests and a log whose entries each hold the digest of the one before; the first holds 64 zeros."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions.semantics import canonical_json as canonical

GENESIS = "0" * 64
#: Bytes of a file that are held at once.
CHUNK = 1 << 20


def append(log: list[dict[str, Any]], event: str, *, now: str, artifact_sha256: str, actor: str | None = None) -> list[dict[str, Any]]:
    """log with one more entry, in place; the clock is the caller's."""
    core = {"seq": len(log), "time": now, "event": event, "artifact_sha256": artifact_sha256, "actor": actor, "prev_entry_sha256": log[-1]["entry_sha256"] if log else GENESIS}
    log.append(core | {"entry_sha256": hashlib.sha256(canonical(core).encode()).hexdigest()})
    return log


def _quoted(c: Column) -> Column:
    """A JSON string in ASCII, as canonical writes it; null for null."""

    def char(x: Column) -> Column:
        n = F.ascii(x)
        code = lambda v: F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(v.cast("long"))), 4, "0"))
        short = F.create_map(*[F.lit(v) for pair in (('"', '\\"'), ("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")) for v in pair])
        high = n - 0x10000
        pair = F.concat(code(F.floor(high / 1024) + 0xD800), code(high % 1024 + 0xDC00))
        return F.coalesce(F.try_element_at(short, x), F.when((n >= 32) & (n < 127), x).when(n < 0x10000, code(n)).otherwise(pair))

    plain = c.rlike(r'^[ !#-\[\]-~]*$')
    text = F.when(plain, c).otherwise(F.array_join(F.transform(F.filter(F.split(c, ""), lambda x: x != ""), char), ""))
    return F.coalesce(F.concat(F.lit('"'), text, F.lit('"')), F.lit("null"))


def entry_digest(seq: Column, time: Column, event: Column, artifact_sha256: Column, actor: Column, prev: Column) -> Column:
    """The digest of an entry's canonical JSON, keys in order."""
    parts = {"actor": _quoted(actor), "artifact_sha256": _quoted(artifact_sha256), "event": _quoted(event), "prev_entry_sha256": _quoted(prev), "seq": F.coalesce(seq.cast("string"), F.lit("null")), "time": _quoted(time)}
    return F.sha2(F.concat(F.lit("{"), *[x for k, (name, v) in enumerate(parts.items()) for x in (F.lit(("," if k else "") + f'"{name}":'), v)], F.lit("}")), 256)


def chains(events: DataFrame, case: str, order: str) -> DataFrame:
    """A custody log for each case: events (case, order, time, event, artifact_sha256, actor) linked in order. A case's log is
    one chain and is linked in one place, as each entry needs the one before; cases are spread."""
    fields = ("time", "event", "artifact_sha256", "actor")
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), *[F.col(c).cast("string").alias(c) for c in fields])))
    grouped = events.groupBy(case).agg(rows.alias("rows"))
    kind = "array<struct<seq:bigint,time:string,event:string,artifact_sha256:string,actor:string,prev_entry_sha256:string,entry_sha256:string>>"

    def link(done: Column, x: Column) -> Column:
        seq = F.size(done).cast("bigint")
        prev = F.coalesce(F.try_element_at(done, F.lit(-1))["entry_sha256"], F.lit(GENESIS))
        entry = F.struct(seq.alias("seq"), *[x[c].alias(c) for c in fields], prev.alias("prev_entry_sha256"), entry_digest(seq, x["time"], x["event"], x["artifact_sha256"], x["actor"], prev).alias("entry_sha256"))
        return F.concat(done, F.array(entry).cast(kind))

    return grouped.select(case, F.explode(F.aggregate("rows", F.array().cast(kind), link)).alias("e")).select(case, "e.*")


def verify(log: DataFrame, case: str | None = None, also: Sequence[Column] = ()) -> DataFrame:
    """valid and n_entries (and the case): sequence from 0 without a gap, links and digests right. log: seq, time, event,
    artifact_sha256, actor, prev_entry_sha256, entry_sha256. A null that breaks a link is not valid; an empty log is. also: further
    aggregates of a log.

    Without a case each entry meets the one before by number, so a log of any length is spread. With a case its entries lie in
    order in one place, where chains put them already, so they aren't moved again; what doesn't fit into memory spills."""
    names = [F.col(c) for c in ("seq", "time", "event", "artifact_sha256", "actor", "prev_entry_sha256")]
    if case:
        order = Window.partitionBy(case).orderBy("seq")
        rows = log.withColumns({"_before": F.lag("entry_sha256").over(order), "_place": F.row_number().over(order) - 1})
        whole = F.coalesce(F.bool_and(F.coalesce(F.col("seq") == F.col("_place"), F.lit(False))), F.lit(True))
    else:
        before = log.select((F.col("seq") + 1).alias("_seq"), F.col("entry_sha256").alias("_before")).groupBy("_seq").agg(F.max("_before").alias("_before"))
        rows = log.join(before, F.col("seq") == F.col("_seq"), "left")
        whole = (F.count("seq") == F.count("*")) & F.coalesce((F.min("seq") == 0) & (F.max("seq") == F.count("*") - 1) & (F.count_distinct("seq") == F.count("*")), F.count("*") == 0)
    linked = F.when(F.col("seq") == 0, F.col("prev_entry_sha256") == GENESIS).otherwise(F.col("prev_entry_sha256") == F.col("_before"))
    good = F.coalesce(linked & (F.col("entry_sha256") == entry_digest(*names)), F.lit(False))
    return rows.groupBy(*([case] if case else [])).agg((F.coalesce(F.bool_and(good), F.lit(True)) & whole).alias("valid"), F.count("*").alias("n_entries"), *also)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """path, length, modified, sha256 of the files under path, of any size: each is read in pieces by the task that has its name."""
    from pyarrow import fs

    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", F.col("modificationTime").alias("modified"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = []
            for name in batch.column("path").to_pylist():
                system, at = fs.FileSystem.from_uri("file://" + name[5:] if name.startswith("file:/") and not name.startswith("file://") else name)
                digest = hashlib.sha256()
                with system.open_input_stream(at, compression=None) as f:
                    while piece := f.read(CHUNK):
                        digest.update(piece)
                digests.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.string())], names=[*batch.schema.names, "sha256"])

    return listed.mapInArrow(run, "path string, length long, modified timestamp, sha256 string")


def modified_after(files: DataFrame, received: str) -> DataFrame:
    """Files that changed after they were received: a warning, no proof."""
    return files.where(F.col("modified") > F.lit(received).cast("timestamp"))
