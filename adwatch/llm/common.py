"""What the operators share: folders every machine sees, tables written once, and registration of queries."""

from __future__ import annotations

import ctypes
import gc
import os
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache, wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Java pattern of the white space that separates words: space and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]+"


def query(name: str, sql: str | None = None):
    """Register a query, with its SQL twin when SQL can express it on whole tables."""

    def register(function):
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder, not yet made, in the storage that all machines see.

    That is ``spark.checkpoint.dir``; where it is unset, as in tests, the warehouse takes its place.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"


def settle(df: DataFrame, files: int | None = None) -> DataFrame:
    """Write a table once to the shared folder and read it back, so that its readers share one computation.

    ``files`` joins the last partitions to so many at most, for narrow tables.

    The files outlive executors; a task that is run again replaces its own file through Spark's commit protocol.
    """
    spark, folder = df.sparkSession, shared_folder(df.sparkSession)
    (df if files is None else df.coalesce(files)).write.option("compression", "zstd").parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def with_outputs(df: DataFrame, *names: str) -> DataFrame:
    """The table without the columns that an operator is about to add: an operator's output replaces a column of its name."""
    return df.drop(*[c for c in names if c in df.columns])


def batch_bytes(spark: SparkSession, rows: int = 2000, size: str = "8m") -> None:
    """Keep Arrow batches small where single rows may be long documents: by rows and by bytes, one row at least."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def utf8(column: str = "text"):
    """The text column as bytes, null as empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


#: Bytes a Python worker may go on holding after a task; beyond it the tables it keeps for later tasks are dropped.
WORKER_BYTES = 256 << 20
_KEPT: list[Callable[[], None]] = []


def kept(function):
    """A function whose last two results a worker keeps for its next tasks, unless memory is short."""
    cached = lru_cache(maxsize=2)(function)
    _KEPT.append(cached.cache_clear)
    return cached


def tidy(run):
    """The task function ``run``, after which the worker hands the memory it no longer needs back to the system."""

    @wraps(run)
    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            hand_back()

    return own


def hand_back() -> None:
    """Return unused memory; a worker that still holds more than ``WORKER_BYTES`` also drops what it has kept."""
    def trim() -> int:
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
            with open("/proc/self/statm") as sizes:
                return int(sizes.read().split()[1]) * os.sysconf("SC_PAGE_SIZE")
        except (AttributeError, OSError):  # not Linux
            return 0

    if trim() > WORKER_BYTES:
        for drop in _KEPT:
            drop()
        trim()
