"""Tables in the folder that all executors share, and sides of joins that may be broadcast."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes to which a side may come and still be broadcast.
BROADCAST_BYTES = 32_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; one of our own, gone at the end, only where that is unset and the master is local."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="lodestone-")
    atexit.register(shutil.rmtree, own, True)
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def new_path(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that is removed when this process ends."""
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends, and a lost executor loses nothing."""
    path = new_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # noqa: BLE001  the session ended first: the cluster cleans its folder
        pass


def narrow(df: DataFrame, row_bytes: int) -> DataFrame:
    """df for a join, broadcast if its rows, counted, of about row_bytes each are few enough."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df
