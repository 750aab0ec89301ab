"""What the operators share: tables, words, Arrow mapping and written intermediate tables."""

from __future__ import annotations

import atexit
import ctypes
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

#: The six characters that separate words.
SPACES = " \t\n\x0b\x0c\r"
#: The same as a class for Spark's and DuckDB's regular expressions.
WORD = r"[^\x20\x09-\x0D]+"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_writing = threading.Lock()
MULT = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xD6E8FEB86659FD93)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def encoded(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "replace")


def words(text: str | None) -> list[bytes]:
    """Maximal runs of anything but the six separators: what bytes.split() gives."""
    return encoded(text).split()


def map_rows(df: DataFrame, columns: list[str], fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow over the named columns only, so that further columns neither clash nor get read."""
    return df.select(*columns).mapInArrow(fn, schema)


def batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def pieces(b: pa.RecordBatch, chars: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """A batch in slices of bounded text, so that very long texts don't add up in memory."""
    at, size = 0, 0
    text = b.column("text")
    if not b.num_rows:
        return
    if text.nbytes <= chars:
        yield b
        return
    for i in range(b.num_rows):
        size += len(text[i].as_buffer() or b"") if text[i].is_valid else 0
        if size > chars:
            yield b.slice(at, i + 1 - at)
            at, size = i + 1, 0
    if at < b.num_rows:
        yield b.slice(at)


def give_back() -> None:
    """What a task has left free goes back to the system: workers live on, and what follows in them needs it."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # where the C library has no such call, it keeps the memory
        ctypes.CDLL(None).malloc_trim(0)


def hashes(ws: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, ws), np.uint64, len(ws))


def rolled(h: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each window of n words, from the hashes of the words."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    g = np.zeros(len(h) - n + 1, np.uint64)
    for j in range(n):
        g *= MULT
        g += h[j : len(h) - n + 1 + j]
    g ^= g >> np.uint64(32)
    g *= MIX
    g ^= g >> np.uint64(29)
    return g


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; one of our own only where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir is not set: executors need a folder that all of them share")
        found = "/tmp/checkpoints/quillstone"
    return (found if "://" in found or found.startswith("file:") else f"file://{found}").rstrip("/")


def _drop(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended before us; the folder belongs to it
        return


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_drop, spark, path)
    return path


def settled(df: DataFrame, name: str) -> DataFrame:
    """The rows, written once as a table in the shared folder and read from there: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    with _writing:  # the setting is the session's: one table at a time
        before = spark.conf.get(CLEANUP, None)
        spark.conf.set(CLEANUP, "true")  # the shuffle files go when the table is written
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
