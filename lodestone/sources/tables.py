"""Dirty tables in, curated tables out: CSV and XLSX whose identifiers survive, allowlisted served tables, public slices."""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.semantics import present, stripped
from lodestone.functions.shared import new_path, written
from lodestone.operators.derive import empty_to_null
from lodestone.operators.quality import CEILING

#: Whole tokens of a column's name that make it an identifier: its zeros in front stay.
ID_TOKENS = frozenset("zip zipcode fips phone id case plate license account dob ssn".split())
SAMPLE = 65_536


@dataclass
class LoadReport:
    path: str
    encoding: str = "utf-8"
    low_confidence: bool = False
    text_columns: list[str] = field(default_factory=list)
    anomalies: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)


def name_tokens(name: str) -> list[str]:
    """Of a column's name, by humps, digits and anything that is no letter or digit."""
    parts = re.sub(r"([a-z0-9])([A-Z])|([A-Z]+)(?=[A-Z][a-z])", lambda m: m[0][:1] + " " + m[0][1:] if m[1] else m[0] + " ", name)
    return [t.lower() for t in re.findall(r"[A-Za-z]+|\d+", parts)]


def is_id_like(name: str) -> bool:
    return bool(ID_TOKENS & set(name_tokens(name)))


def sniff_encoding(head: bytes) -> tuple[str, bool]:
    """(encoding, low confidence) of the first bytes: UTF-8 where they decode, else a guess that is called one."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16le"), (b"\xfe\xff", "utf-16be")):
        if head.startswith(mark):
            return name, False
    try:
        head[: len(head) - 4 if len(head) >= SAMPLE else None].decode("utf-8")
        return "utf-8", False
    except UnicodeDecodeError as e:
        return ("utf-8", False) if e.start >= len(head) - 8 and len(head) >= SAMPLE else ("iso-8859-1", True)


def _stream(spark: SparkSession, path: str, mode: str = "open"):  # noqa: ANN202
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return getattr(p.getFileSystem(spark._jsc.hadoopConfiguration()), mode)(p)


def _head(spark: SparkSession, path: str, n: int = SAMPLE) -> bytes:
    """The first bytes of a file of any file system that Spark reads."""
    stream = _stream(spark, path)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(spark._jvm.org.apache.commons.io.input.BoundedInputStream(stream, n)))
    finally:
        stream.close()


def _first_lines(spark: SparkSession, path: str, encoding: str, count: int) -> tuple[list[str], bytes]:
    """The first lines with their ends, so many or all there are, and the bytes before the first of them (a mark of order)."""
    n = SAMPLE
    while True:
        head = _head(spark, path, n)
        mark = next((m for m in (b"\xef\xbb\xbf", b"\xff\xfe", b"\xfe\xff") if head.startswith(m)), b"")
        lines = re.findall(r"[^\r\n]*(?:\r\n|\n|\r)|[^\r\n]+", head[len(mark) :].decode(encoding, "replace"))
        if len(head) < n or len(lines) > count + 1:  # the last one may be cut
            return lines[:count], mark
        n *= 4


def _without_lines(spark: SparkSession, path: str, encoding: str, skipped: set[int]) -> str:
    """A copy of the file in the shared folder without those lines. What follows them is copied byte by byte, so line breaks
    within quotes stay what they are."""
    lines, mark = _first_lines(spark, path, encoding, max(skipped) + 1)
    kept = "".join(line for i, line in enumerate(lines) if i not in skipped)
    offset = len(mark) + len("".join(lines).encode(encoding))
    target = new_path(spark, "csv") + "/part.csv"
    source, out = _stream(spark, path), _stream(spark, target, "create")
    try:
        source.seek(offset)
        out.write(bytearray(kept.encode(encoding)))
        spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, 1 << 20, False)
    finally:
        source.close()
        out.close()
    return target


def load_csv(spark: SparkSession, path: str, *, encoding: str | None = None, text_columns: Sequence[str] = (), empty_null: bool = True, skip_lines: int | Sequence[int] = 0, infer: bool = True, delimiter: str = ",") -> tuple[DataFrame, LoadReport]:
    """The table and a report. The header is read first, so each column has its type before any row is parsed: identifiers and
    text_columns are strings, others as Spark infers them. skip_lines: so many lines, or those numbers, before the header."""
    report = LoadReport(path)
    head = _head(spark, path)
    guess, low = sniff_encoding(head)
    encoding = encoding and {"latin-1": "iso-8859-1", "latin1": "iso-8859-1", "ascii": "us-ascii", "utf8": "utf-8", "utf16": "utf-16"}.get(name := encoding.lower().replace("_", "-"), name)
    if encoding == "utf-16":
        encoding = guess if guess.startswith("utf-16") else "utf-16be"  # its mark tells the order of bytes
    report.encoding, report.low_confidence = encoding or guess, low and not encoding
    skipped = set(range(skip_lines)) if isinstance(skip_lines, int) else set(skip_lines)
    source = _without_lines(spark, path, report.encoding, skipped) if skipped else path
    first = "".join(_first_lines(spark, source, report.encoding, 1)[0])
    while first.count('"') % 2:  # a line break within a quoted name
        more = "".join(_first_lines(spark, source, report.encoding, first.count("\n") + 1)[0])
        if more == first:
            break
        first = more
    if not first.strip("\r\n"):
        raise ValueError(f"{path}: no header")
    header = next(csv.reader(io.StringIO(first, newline=""), delimiter=delimiter))
    always = {c.lower() for c in text_columns}
    report.text_columns = [c for c in header if is_id_like(c) or c.lower() in always]
    raw_schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
    options = {"encoding": report.encoding, "sep": delimiter, "multiLine": True, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "nullValue": "" if empty_null else "\u0000", "emptyValue": "" if not empty_null else "", "enforceSchema": True}
    df = spark.read.options(**options).option("header", True).schema(raw_schema).csv(source)
    if empty_null:
        df = empty_to_null(df)
    if infer:
        df = typed(df, [c for c in header if c not in report.text_columns])
    return df, report


def typed(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns that hold whole or decimal numbers alone become long or double: one pass over the rows decides."""
    if not columns:
        return df
    q = lambda c: F.col(f"`{c}`")
    checks = [F.struct(F.count(q(c)).alias("n"), F.count_if(stripped(q(c)).rlike(r"^[+-]?\d{1,18}$")).alias("whole"), F.count_if(stripped(q(c)).rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$")).alias("decimal")).alias(f"c{i}") for i, c in enumerate(columns)]
    seen = df.agg(*checks).first()
    new = {}
    for i, c in enumerate(columns):
        n, whole, decimal = seen[i]
        if n and whole == n:
            new[c] = stripped(q(c)).cast("bigint")
        elif n and decimal == n:
            new[c] = stripped(q(c)).cast("double")
    return df.withColumns(new) if new else df


def load_anomalies(df: DataFrame) -> list[str]:
    seen = df.agg(F.count("*").alias("_n"), *[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(df.columns)]).first()
    out = [f"exactly {CEILING} rows: an export may have been cut"] if seen[0] == CEILING else []
    return out + [f"column {c!r} is all null" for i, c in enumerate(df.columns) if seen[0] and seen[i + 1] == 0]


def load_table(spark: SparkSession, path: str, *, parquet_cache: str | None = None, forward_fill_columns: Sequence[str] = (), sheet: int = 0, **how: Any) -> tuple[DataFrame, LoadReport]:
    """By the ending: .csv, .tsv, .txt, .xlsx or .parquet. With parquet_cache the cleaned table is written there and read again."""
    ending = path.lower().rsplit(".", 1)[-1]
    if ending == "xlsx":
        df, report = load_xlsx(spark, path, sheet=sheet, **how)
    elif ending == "parquet":
        df, report = spark.read.parquet(path), LoadReport(path)
    elif ending in ("csv", "txt", "tsv"):
        df, report = load_csv(spark, path, **({"delimiter": "\t"} if ending == "tsv" else {}) | how)
    else:
        raise ValueError(f"no reader for .{ending}")
    fill = [c for c in forward_fill_columns if c in df.columns]
    if fill:
        df = filled_in_order(df, fill)
    if parquet_cache:
        df.write.mode("overwrite").parquet(parquet_cache)
        df = spark.read.parquet(parquet_cache)
    report.anomalies = load_anomalies(df)
    return df, report


#: Rows, as a power of two, that are filled in one place.
FILL_BITS = 18


def filled_in_order(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Each null takes the last value before it in the file's order. Stretches of rows are filled side by side, several of a partition
    too; what each ends with, a row for each, is carried on to the next ones."""
    return _filled(df.withColumn("_row", F.monotonically_increasing_id()), columns, df.columns)


def filled_by(df: DataFrame, columns: Sequence[str], order: str) -> DataFrame:
    """The same in the order of a column, nulls first. Rows are dealt into ranges of it, none of which has to be in one place with others."""
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() >> FILL_BITS))
    ranged = df.repartitionByRange(parts, F.col(f"`{order}`")).sortWithinPartitions(F.col(f"`{order}`"))
    return _filled(written(ranged.withColumn("_row", F.monotonically_increasing_id()), "ranges"), columns, df.columns)


def _filled(rows: DataFrame, columns: Sequence[str], kept: Sequence[str]) -> DataFrame:
    names = {c: f"_fill{k}" for k, c in enumerate(columns)}
    numbered = rows.withColumn("_part", F.shiftright("_row", FILL_BITS))
    ends = numbered.groupBy("_part").agg(*[F.max_by(F.col(f"`{c}`"), F.when(F.col(f"`{c}`").isNotNull(), F.col("_row"))).alias(n) for c, n in names.items()])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("_part", *[F.last(n, ignorenulls=True).over(before).alias(n) for n in names.values()])
    upto = Window.partitionBy("_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = {c: F.last(F.col(f"`{c}`"), ignorenulls=True).over(upto) for c in columns}
    joined = numbered.withColumns(own).join(F.broadcast(carried), "_part")  # a row for each stretch
    return joined.withColumns({c: F.coalesce(F.col(f"`{c}`"), F.col(n)) for c, n in names.items()}).select(*[F.col(f"`{c}`") for c in kept])


_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}


def read_xlsx(data: bytes, sheet: int = 0) -> list[list[str | float | bool | None]]:
    """Cells of a sheet; a merged region is filled from its first cell."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", _NS)]
        names = sorted((n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
        root = ElementTree.fromstring(z.read(names[sheet]))
    place = lambda ref: (int(re.sub(r"\D", "", ref)) - 1, sum((ord(c) - 64) * 26**k for k, c in enumerate(reversed(re.sub(r"\d", "", ref)))) - 1)
    cells: dict[tuple[int, int], str | float | bool | None] = {}
    for c in root.iter(f"{{{_NS['m']}}}c"):
        kind, v = c.get("t", "n"), c.find("m:v", _NS)
        if kind == "inlineStr":
            value: str | float | bool | None = "".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t"))
        elif v is None or v.text is None:
            value = None
        else:
            value = shared[int(v.text)] if kind == "s" else v.text == "1" if kind == "b" else v.text if kind in ("str", "e") else float(v.text)
        cells[place(c.get("r"))] = value
    for m in root.iter(f"{{{_NS['m']}}}mergeCell"):
        (r0, c0), (r1, c1) = (place(x) for x in m.get("ref").split(":"))
        for r in range(r0, r1 + 1):
            for k in range(c0, c1 + 1):
                cells[r, k] = cells.get((r0, c0))
    if not cells:
        return []
    return [[cells.get((r, k)) for k in range(1 + max(c for _, c in cells))] for r in range(1 + max(r for r, _ in cells))]


def load_xlsx(spark: SparkSession, path: str, *, sheet: int = 0, text_columns: Sequence[str] = (), empty_null: bool = True, skip_lines: int = 0) -> tuple[DataFrame, LoadReport]:
    """A sheet has a million rows at most, so one task reads it. Identifiers that were numbers lose their '.0'; those beyond 2**53
    may have lost digits before, which is a warning."""
    report = LoadReport(path)
    data = bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
    rows = read_xlsx(data, sheet)[skip_lines:]
    if not rows:
        raise ValueError(f"{path}: no header")
    header = [str(h) if h is not None else f"column_{i}" for i, h in enumerate(rows[0])]
    always = {c.lower() for c in text_columns}
    report.text_columns = [c for c in header if is_id_like(c) or c.lower() in always]

    def plain(v: str | float | bool | None) -> str | None:
        return None if v is None else str(int(v)) if isinstance(v, float) and v == int(v) else str(v)

    for k, c in enumerate(header):
        if c in report.text_columns and any(isinstance(r[k], float) and abs(r[k]) >= 2**53 for r in rows[1:]):
            report.warnings.append(f"column {c!r} has numbers of 2**53 or more: digits may be lost")
    df = spark.createDataFrame([tuple(map(plain, r)) for r in rows[1:]], T.StructType([T.StructField(c, T.StringType()) for c in header]))
    df = empty_to_null(df) if empty_null else df
    return typed(df, [c for c in header if c not in report.text_columns]), report


def served(df: DataFrame, include: Sequence[str], exclude: Sequence[str] = (), text_columns: Sequence[str] = ()) -> DataFrame:
    """The allowlisted columns, never an excluded one; text columns as strings. Without an allowlist, or with one that names what
    isn't there, it raises: nothing is published by default."""
    if not include:
        raise ValueError("name the columns to serve")
    if missing := [c for c in include if c not in df.columns]:
        raise ValueError(f"no such columns: {missing}")
    shown = [c for c in include if c not in set(exclude)]
    if outside := [c for c in text_columns if c not in shown]:
        raise ValueError(f"not served: {outside}")
    return df.select(*[F.col(f"`{c}`").cast("string").alias(c) if c in text_columns else F.col(f"`{c}`") for c in shown])


def publish(df: DataFrame, path: str, include: Sequence[str], *, exclude: Sequence[str] = (), text_columns: Sequence[str] = (), pk: Sequence[str] = (), append: bool = False, view: str = "records") -> DataFrame:
    out = served(df, include, exclude, text_columns)
    if pk and not out.groupBy(*pk).count().where("count > 1").isEmpty():
        raise ValueError(f"{list(pk)} is no key")
    out.write.mode("append" if append else "overwrite").parquet(path)
    result = df.sparkSession.read.parquet(path)
    result.createOrReplaceTempView(view)
    return result


def public_slice(df: DataFrame, n: int, sort_columns: Sequence[str] = ()) -> DataFrame:
    """The first n rows that aren't blank throughout, in the order of all columns as text, sort_columns first."""
    if n <= 0:
        raise ValueError("n must be positive")
    from functools import reduce

    rows = df.where(reduce(lambda a, b: a | b, [present(F.col(f"`{c}`")) for c in df.columns]))
    order = [*sort_columns, *[c for c in df.columns if c not in sort_columns]]
    return rows.orderBy(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in order]).limit(n)


def write_bundle(entities: DataFrame, provenance: DataFrame, folder: str, manifest: dict[str, Any]) -> dict[str, Any]:
    """Entities and provenance as JSON lines, and a manifest with their counts, written last."""
    entities.write.mode("overwrite").json(f"{folder}/entities")
    provenance.write.mode("overwrite").json(f"{folder}/provenance")
    spark = entities.sparkSession
    full = manifest | {"n_entities": spark.read.text(f"{folder}/entities").count(), "n_provenance": spark.read.text(f"{folder}/provenance").count()}
    spark.createDataFrame([full]).coalesce(1).write.mode("overwrite").json(f"{folder}/manifest")
    return full


def read_bundle(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Entities (the last of each id, by file name and place) and provenance; counts that don't agree with the manifest raise."""
    manifest = spark.read.json(f"{folder}/manifest").first()
    entities, provenance = spark.read.json(f"{folder}/entities"), spark.read.json(f"{folder}/provenance")
    if (entities.count(), provenance.count()) != (manifest["n_entities"], manifest["n_provenance"]):
        raise ValueError("counts differ from the manifest's")
    place = F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("r"))
    last = entities.select("*", place.alias("_at")).groupBy("id").agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in entities.columns]), "_at").alias("e"))
    return last.select("e.*"), provenance
