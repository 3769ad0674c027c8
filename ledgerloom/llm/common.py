"""Helpers that the corpus operators share."""

from __future__ import annotations

import atexit
import ctypes
import functools
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast up to so many rows of a few numbers each (about 100 MB in memory).
BROADCAST_ROWS = 1_000_000


def session_of(df: DataFrame) -> SparkSession:
    return df.sparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset, a temporary one if all runs on
    this machine, and an error on a cluster."""
    conf = spark.sparkContext.getConf()
    if found := conf.get("spark.checkpoint.dir", ""):
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
    if not getattr(spark.sparkContext, "_ledgerloom_dir", None):
        spark.sparkContext._ledgerloom_dir = "file://" + tempfile.mkdtemp(prefix="ledgerloom-")
    return spark.sparkContext._ledgerloom_dir


_STASHED: list[tuple[SparkSession, str]] = []


def forget(spark: SparkSession, path: str) -> None:
    """Delete a stashed table."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _forget_all() -> None:
    for spark, path in _STASHED:
        try:
            forget(spark, path)
        except Exception:  # the JVM may have gone first
            return


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder for a table that goes when the driver's Python ends."""
    path = f"{shared_dir(spark)}/stash/{name}-{uuid.uuid4().hex}"
    _STASHED.append((spark, path))
    return path


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it again: this cuts the lineage, and a lost executor costs
    no more than the tasks that it ran. Files go when the driver's Python ends."""
    spark = session_of(df)
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most `limit` rows; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.count() <= limit else df


def texts(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and text, null texts as empty; other columns are left in the scan."""
    return docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def row_key() -> Column:
    """A number for a row's doc_id and text that is never null. With the doc_id, null-safe, it tells rows apart."""
    return F.xxhash64("doc_id", F.coalesce("text", F.lit("")))


@functools.cache
def _trim():
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):  # another C library
        return lambda _: 0


def release() -> None:
    """Give freed memory back to the machine: a Python worker serves one stage after another."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit numbers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
