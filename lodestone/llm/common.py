"""What several operators need: shared-folder tables, word hashing, batches of bounded size."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker handles at once.
SLICE = 2_000_000
#: Bytes to which a side may come and still be broadcast.
BROADCAST_BYTES = 32_000_000

_PRIME = 0x9E3779B97F4A7C15
_INVERSE = pow(_PRIME, -1, 2**64)
_U = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; one of our own only where that is unset and the master is local."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="lodestone-")
    atexit.register(shutil.rmtree, own, True)
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # noqa: BLE001  the session ended first: the cluster cleans its folder
        pass


def small_enough(df: DataFrame, row_bytes: int | Column) -> bool:
    """Whether df, of which a row takes about row_bytes, may be broadcast. It counts df; where rows differ in size, as those with arrays
    do, row_bytes is an expression that is summed up."""
    if isinstance(row_bytes, Column):
        return (df.agg(F.sum(row_bytes.cast("long"))).first()[0] or 0) <= BROADCAST_BYTES
    return df.count() * row_bytes <= BROADCAST_BYTES


def narrow(df: DataFrame, row_bytes: int | Column) -> DataFrame:
    """df for a join: broadcast if it is small enough."""
    return F.broadcast(df) if small_enough(df, row_bytes) else df


def components(edges: DataFrame) -> DataFrame:
    """(v, root) for each vertex that isn't the least of its component. edges: (u, v). Alternates large and small stars until
    stars are all there is; each round is a written table, and the rounds grow with the logarithm of the largest component.
    Minima are partial before the shuffle, so the middle of a star of any size is one row of each task."""
    edges = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "stars")
    while not _stars(edges):
        both = edges.select("u", "v").union(edges.select("v", "u"))
        least = narrow(written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "star-least"), 24)
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "stars")
        low = large.join(narrow(written(large.groupBy("u").agg(F.min("v").alias("m")), "star-least"), 24), "u")
        small = low.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = written(small, "stars")
    return edges.select(F.col("u").alias("v"), F.col("v").alias("root"))


def _stars(edges: DataFrame) -> bool:
    """Whether each u has one v alone, and no v is a u: then each v is the least of its component."""
    several = edges.groupBy("u").agg(F.count("*").alias("k")).where("k > 1").select("u")
    chained = edges.join(edges.select(F.col("v").alias("u")).distinct(), "u", "left_semi").select("u")
    return several.unionByName(chained).isEmpty()


def per_slice(fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], text: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: fn gets rows whose texts have SLICE bytes together, or one longer text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
            group = np.cumsum(size, dtype=np.int64) // SLICE
            cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                out = fn(batch.slice(a, b - a))
                if out is not None and out.num_rows:
                    yield out

    return run


def raw(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets from 0 and bytes of a string column; a null is an empty text."""
    col = pc.fill_null(col.cast(pa.large_string()), "")
    if not len(col):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8)[off[0] : off[-1]] if off[-1] > off[0] else np.zeros(0, np.uint8)
    return off - off[0], data


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the argument moves every bit of the result."""
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h ^= h >> _U(33)
    h *= _U(0xC4CEB9FE1A85EC53)
    h ^= h >> _U(33)
    return h


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, by doubling."""
    out = np.ones(n, np.uint64)
    if n > 1:
        out[1] = base
    k = 2
    while k < n:
        m = min(k, n - k)
        out[k : k + m] = out[:m] * _U(pow(base, k, 2**64))
        k *= 2
    return out


_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), 95]] = True
_WORD[128:] = True


def word_hashes(col: pa.Array, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Of a string column: a 64-bit hash of each word, in order, and the row it is in.

    A word is a run of ASCII letters, digits, underscores and of characters beyond ASCII, in lower case.
    prefixes: also hashes of the first so many bytes of longer words, all words first, then each length in turn.
    Long texts are cut between words, so memory stays bounded unless one word is longer than SLICE.
    """
    off, data = raw(pc.utf8_lower(pc.fill_null(col.cast(pa.large_string()), "")))
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    word = _WORD[data]
    first = np.zeros(n + 1, bool)
    first[off] = True
    begins = word.copy()
    begins[1:] &= ~word[:-1] | first[1:n]
    ends = word.copy()
    ends[:-1] &= ~word[1:] | first[1:n]
    s, e = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    if not len(s):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(off) - 1), np.diff(np.searchsorted(s, off)))
    h = np.empty((1 + len(prefixes), len(s)), np.uint64)
    a = 0
    while a < len(s):
        b = max(a + 1, int(np.searchsorted(e, s[a] + SLICE, "right")))
        base, m = s[a], int(e[b - 1] - s[a])
        up, down = _power_tables(m + 1)
        c = np.zeros(m + 1, np.uint64)
        np.cumsum((data[base : base + m].astype(np.uint64) + _U(1)) * up[:m], out=c[1:])
        left, inverse = s[a:b] - base, down[s[a:b] - base]
        h[0, a:b] = (c[e[a:b] - base] - c[left]) * inverse
        for k, size in enumerate(prefixes, 1):
            h[k, a:b] = (c[np.minimum(left + size, m)] - c[left]) * inverse + _U(k)
        a = b
    if not prefixes:
        return mix(h[0]), row
    long = [e - s > size for size in prefixes]
    return mix(np.concatenate([h[0], *(h[k][x] for k, x in enumerate(long, 1))])), np.concatenate([row, *(row[x] for x in long)])


_tables: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _tables or len(_tables[0]) < n:
        _tables[:] = [powers(_PRIME, n), powers(_INVERSE, n)]
    return _tables[0], _tables[1]


def is_blank(col):  # noqa: ANN001, ANN201
    return F.coalesce(F.trim(col) == "", F.lit(True))
