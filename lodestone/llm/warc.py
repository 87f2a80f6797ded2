"""WARC files as a chunked record table: payloads of any size pass through in pieces, and no record is ever held whole.

``write_warc`` turns rows into WARC/1.1 files, one for each partition, each record a gzip member of its own. ``read_warc``
streams such files (or plain, uncompressed ones) into rows of (record_id, chunk_no): the headers come with chunk 0, and
each row carries the digest of the block up to and with itself, so a reader can stop, resume or verify anywhere.
Memory is bounded by CHUNK_BYTES and the longest header, not by the records.

``verified``, in a record's last row, tells whether all digests that its head gives agree: the block digest with all bytes, the
payload digest with what follows the HTTP head where the block is an HTTP message (application/http), else with all bytes. A
revisit's payload is in another record, so its payload digest is left alone. Null: there is no digest that can be told (sha1,
sha256 or md5, in base 32 or hexadecimal).

Files are opened through pyarrow's file systems, so a path may be any URI that these know (file, hdfs, s3, gs). One file
is one task's work: WARC files are made to be about a gigabyte, and a gzip stream has no other place to start from. A
writer puts its file in place by a rename when it is complete, under a name that its partition has in every attempt.

Edge cases: a null or empty payload is one chunk of no bytes; a null URI leaves the header out and reads as null; a null id
and ids that repeat give records of ids of their own, which partition and place tell apart, so (record_id, chunk_no) is a key; a file cut short, a wrong length or a broken gzip member ends in an
error that names file and offset, or, with on_error="mark", in a last row with ``error`` set; a digest that does not match is
reported in ``verified``, not raised; repeated rows are records of their own; an empty table gives no file or
empty ones; columns besides the three named ones are ignored.
"""

from __future__ import annotations

import atexit
import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import _remove, shared_dir

CHUNK_BYTES = 65_536
#: A header block may have so many bytes; longer ones are an error.
HEADER_BYTES = 1_000_000
#: Bytes of a batch of rows that goes back to Spark.
BATCH_BYTES = 4_000_000
_SCHEMA = pa.schema(
    [
        ("file", pa.string()), ("offset", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()),
        ("headers", pa.map_(pa.string(), pa.string())), ("chunk_no", pa.int64()), ("start", pa.int64()), ("n_bytes", pa.int32()), ("chunk", pa.binary()),
        ("sha1_so_far", pa.string()), ("is_last", pa.bool_()), ("verified", pa.bool_()), ("error", pa.string()),
    ]
)
SCHEMA = "file string, offset long, record_id string, record_type string, target_uri string, headers map<string,string>, chunk_no long, start long, n_bytes int, chunk binary, sha1_so_far string, is_last boolean, verified boolean, error string"


def _sha1(digest) -> str:  # noqa: ANN001
    return "sha1:" + base64.b32encode(digest.digest()).decode()


def record_head(record_id: str, uri: str | None, length: int, digest: str, kind: str = "resource", date: str = "1970-01-01T00:00:00Z") -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}"]
    if uri is not None:
        lines.append("WARC-Target-URI: " + uri.replace("\r", " ").replace("\n", " "))
    lines += ["Content-Type: text/html", f"WARC-Block-Digest: {digest}", f"WARC-Payload-Digest: {digest}", f"Content-Length: {length}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n"


def record_id_of(key: object, part: int, place: int) -> str:
    """The same in each attempt of a task, and of one record alone."""
    return "urn:uuid:" + str(uuid.uuid5(uuid.NAMESPACE_OID, f"{part}:{place}:{key if key is not None else ''}"))


class _Told:
    """The digests that a record's head gives, followed as its block goes by."""

    def __init__(self, headers: dict[str, str]) -> None:
        kind, content = headers.get("warc-type"), headers.get("content-type", "").lower().replace(" ", "")
        self.checks = []  # what is told, digest
        for name in ("warc-block-digest", "warc-payload-digest"):
            method, _, value = headers.get(name, "").partition(":")
            if value and method.lower() in ("sha1", "sha256", "md5") and not (name == "warc-payload-digest" and kind == "revisit"):
                self.checks.append((value.strip(), hashlib.new(method.lower()), name == "warc-payload-digest"))
        #: Bytes of an HTTP head so far; None when what comes is payload.
        self.head: bytes | None = b"" if content.startswith("application/http") and any(c[2] for c in self.checks) else None

    def update(self, chunk: bytes) -> None:
        payload = chunk
        if self.head is not None:
            self.head += chunk
            end = self.head.find(b"\r\n\r\n")
            payload = self.head[end + 4 :] if end >= 0 else b""
            if end >= 0:
                self.head = None
            elif len(self.head) > HEADER_BYTES:  # no head that could be left out: what its payload is can't be told
                self.checks, self.head = [c for c in self.checks if not c[2]], None
        for _, digest, of_payload in self.checks:
            digest.update(payload if of_payload else chunk)

    def verified(self) -> bool | None:
        """An HTTP message that ends within its head has an empty payload."""
        if not self.checks:
            return None
        return all(value.upper() in (base64.b32encode(d.digest()).decode().rstrip("="), base64.b32encode(d.digest()).decode(), d.hexdigest().upper()) for value, d, _ in self.checks)


def write_warc(rows: DataFrame, folder: str, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Writes part-NNNNN.warc.gz files into folder; returns (file, n_records, n_bytes), which also makes it happen."""
    shape = rows.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{uri_col}`").cast("string").alias("uri"), F.col(f"`{payload_col}`").cast("binary").alias("payload"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        part = context.partitionId()
        system, root = fs.FileSystem.from_uri(uri(folder))
        system.create_dir(root, recursive=True)
        name = f"{root}/part-{part:05d}.warc.gz"
        draft = f"{name}.{context.taskAttemptId()}.tmp"
        n = size = 0
        with system.open_output_stream(draft, compression=None) as out:
            for batch in batches:
                for key, target, payload in zip(batch.column("id").to_pylist(), batch.column("uri").to_pylist(), batch.column("payload")):
                    body = memoryview(payload.as_buffer() if payload.is_valid else b"")
                    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
                    out.write(pack.compress(record_head(record_id_of(key, part, n), target, len(body), _sha1(hashlib.sha1(body)))))
                    for a in range(0, len(body), CHUNK_BYTES):
                        out.write(pack.compress(body[a : a + CHUNK_BYTES]))
                    out.write(pack.compress(b"\r\n\r\n") + pack.flush())
                    n, size = n + 1, size + len(body)
        if system.get_file_info(name).type != fs.FileType.NotFound:
            system.delete_file(name)  # of an attempt whose word was lost
        system.move(draft, name)
        yield pa.RecordBatch.from_pydict({"file": [name], "n_records": pa.array([n], pa.int64()), "n_bytes": pa.array([size], pa.int64())})

    return shape.mapInArrow(run, "file string, n_records long, n_bytes long")


def _opened(stream, chunk: int) -> Iterator[tuple[int, bytes]]:  # noqa: ANN001
    """Bytes of a file, gzip members laid open, never more than a chunk at once, and where the member began (-1: no gzip)."""
    rest = stream.read(2)
    if rest != b"\x1f\x8b":
        while rest:
            yield -1, rest
            rest = stream.read(chunk)
        return
    read, begins, within, unpack = len(rest), 0, False, zlib.decompressobj(31)
    while True:
        if not rest:
            rest = stream.read(chunk)
            read += len(rest)
            if not rest:
                if within:
                    raise ValueError("the file ends within a gzip member")
                return
        out, within = unpack.decompress(rest, chunk), True
        rest = unpack.unconsumed_tail
        if out:
            yield begins, out
        if unpack.eof:
            rest = unpack.unused_data
            begins, within, unpack = read - len(rest), False, zlib.decompressobj(31)


class _Input:
    """Records' parts from the bytes of a file; buffer holds what is read and not taken, a few chunks at most."""

    def __init__(self, stream, chunk: int) -> None:  # noqa: ANN001
        self.pieces, self.buffer, self.taken, self.member = _opened(stream, chunk), b"", 0, -1

    def _more(self) -> bool:
        self.member, piece = next(self.pieces, (self.member, b""))
        self.buffer += piece
        return bool(piece)

    def next_record(self) -> int | None:
        """Skips blank lines; the offset of the record, or of its gzip member; None at the end of the file."""
        while True:
            left = self.buffer.lstrip(b"\r\n")
            self.taken += len(self.buffer) - len(left)
            self.buffer = left
            if left:
                return self.member if self.member >= 0 else self.taken
            if not self._more():
                return None

    def head(self) -> bytes:
        scanned = 0
        while (end := self.buffer.find(b"\r\n\r\n", max(0, scanned - 3))) < 0:
            scanned = len(self.buffer)
            if scanned > HEADER_BYTES:
                raise ValueError("a header has no end")
            if not self._more():
                raise ValueError("the file ends within a header")
        out = self.take(end + 4)
        return out[:-4]

    def take(self, n: int) -> bytes:
        while len(self.buffer) < n:
            if not self._more():
                raise ValueError("the file ends within a payload")
        out, self.buffer = self.buffer[:n], self.buffer[n:]
        self.taken += n
        return out


def records(stream, file: str, chunk_bytes: int = CHUNK_BYTES, on_error: str = "raise") -> Iterator[dict]:  # noqa: ANN001
    """A dict for each chunk of each record of an open file."""
    row: dict = {}
    offset = 0
    try:
        source = _Input(stream, chunk_bytes)
        while (at := source.next_record()) is not None:
            offset, row = at, {}
            version, *lines = source.head().decode("utf-8", "replace").split("\r\n")
            if not version.startswith("WARC/"):
                raise ValueError(f"no record begins here but {version[:20]!r}")
            headers: dict[str, str] = {}
            for line in lines:
                if line[:1] in " \t" and headers:
                    headers[next(reversed(headers))] += " " + line.strip()  # a folded line
                else:
                    name, _, value = line.partition(":")
                    headers[name.strip().lower()] = value.strip()
            left = int(headers["content-length"])
            if left < 0:
                raise ValueError("a negative length")
            row = {"file": file, "offset": offset, "record_id": headers.get("warc-record-id", "").strip("<>") or None, "record_type": headers.get("warc-type"), "target_uri": headers.get("warc-target-uri")}
            told, digest, k, start = _Told(headers), hashlib.sha1(), 0, 0
            while True:
                chunk = source.take(min(left, chunk_bytes))
                left -= len(chunk)
                digest.update(chunk)
                told.update(chunk)
                so_far = _sha1(digest)
                yield row | {"headers": list(headers.items()) if k == 0 else None, "chunk_no": k, "start": start, "n_bytes": len(chunk), "chunk": chunk, "sha1_so_far": so_far, "is_last": not left, "verified": None if left else told.verified(), "error": None}
                k, start = k + 1, start + len(chunk)
                if not left:
                    break
    except (ValueError, KeyError, zlib.error) as e:
        what = f"{file}, record at {offset}: {e}"
        if on_error == "raise":
            raise ValueError(what) from e
        yield {f.name: None for f in _SCHEMA} | row | {"file": file, "offset": offset, "error": what}


def read_warc(spark: SparkSession, folder: str, chunk_bytes: int = CHUNK_BYTES, on_error: str = "raise") -> DataFrame:
    """The chunk table of all .warc and .warc.gz files under folder: a row for each (record_id, chunk_no)."""
    system, root = fs.FileSystem.from_uri(uri(folder))
    names = sorted(f.path for f in system.get_file_info(fs.FileSelector(root, recursive=True)) if f.path.endswith((".warc", ".warc.gz")))
    files = spark.createDataFrame([(n,) for n in names], "path string").repartition(max(1, min(len(names), 100_000)), "path")
    return chunks_of(files, folder, chunk_bytes, on_error)


def chunks_of(files: DataFrame, folder: str, chunk_bytes: int = CHUNK_BYTES, on_error: str = "raise") -> DataFrame:
    """The chunk table of the files named in a column path; folder tells which file system they are in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system = fs.FileSystem.from_uri(uri(folder))[0]
        for batch in batches:
            for path in batch.column("path").to_pylist():
                waiting, size = [], 0
                with system.open_input_stream(path, compression=None, buffer_size=1 << 20) as stream:
                    for row in records(stream, path, chunk_bytes, on_error):
                        waiting.append(row)
                        size += 1000 + (row["n_bytes"] or 0)
                        if size >= BATCH_BYTES:
                            yield pa.RecordBatch.from_pylist(waiting, _SCHEMA)
                            waiting, size = [], 0
                if waiting:
                    yield pa.RecordBatch.from_pylist(waiting, _SCHEMA)

    return files.select("path").mapInArrow(run, SCHEMA)


def uri(path: str) -> str:
    """path as pyarrow wants it: Spark also writes file:/x for file:///x."""
    return "file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path


def round_trip(pages: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """pages as WARC files in the shared folder, read again as the chunk table, without where they lay. The files go when the
    session's process ends, as the table is read whenever its rows are asked for."""
    spark = pages.sparkSession
    folder = uri(f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}")
    atexit.register(_remove, spark, folder)
    names = [r["file"] for r in write_warc(pages, folder).select("file").collect()]  # a name for each file
    files = spark.createDataFrame([(n,) for n in names], "path string").repartition(max(1, len(names)), "path")
    return chunks_of(files, folder, chunk_bytes).drop("file", "offset")
