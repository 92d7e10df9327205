"""Session settings the jobs rely on."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # keyed state of streams is larger than an executor's heap
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def local_session(cores: int | str = "*", name: str = "adwatch", **extra: str) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    partitions = str(os.cpu_count() if cores == "*" else cores)
    local = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.shuffle.partitions": partitions,
        "spark.driver.memory": "8g",
        "spark.sql.execution.arrow.pyspark.fallback.enabled": "false",
    }
    for key, value in {**SETTINGS, **local, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def apply_settings(spark: SparkSession) -> SparkSession:
    """Set the SQL options on an existing session."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def checkpoint_folder(spark: SparkSession, default: str | None = None) -> str | None:
    """The shared folder the cluster names in ``spark.checkpoint.dir``; ``default`` only where it is unset."""
    return spark.conf.get("spark.checkpoint.dir", None) or default


def widen(df: DataFrame) -> DataFrame:
    """Spread a table that is read by fewer tasks than there are cores, before costly work per row.

    A large table already has more splits than cores and passes through without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def settled(df: DataFrame) -> DataFrame:
    """Write a costly table once to the session's checkpoint folder before several readers use it.

    The checkpoint lies in shared storage, so a lost executor does not bring the work back. Without a folder the
    table stays lazy.
    """
    return df if df.sparkSession.sparkContext.getCheckpointDir() is None else df.checkpoint()
