"""Sinks. Writes replace what they wrote before, so a lost job runs again; plain appends say so where they do not."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adwatch import schema
from adwatch.operators.audit import seal_entries, with_canonical
from adwatch.operators.ordering import latest
from adwatch.operators.registry import row_counts
from adwatch.sources import readers


def write_log(entries: DataFrame, path: str) -> None:
    """Seal whole traces and replace the log. Chains stay together in files; a directory per chain would not scale."""
    sealed = seal_entries(with_canonical(entries)).drop("canonical")
    sealed.write.mode("overwrite").option("partitionOverwriteMode", "static").option("ignoreNullFields", False).json(path)


def append_log(entries: DataFrame, path: str) -> None:
    """Continue every chain of an existing log, whose entries are read for their heads. A repeated call appends again; see ``commit_log``."""
    spark = entries.sparkSession
    written = read_log(spark, path)
    heads = written.groupBy("chain").agg(F.max_by("entry_hash", "seq").alias("entry_hash"), F.max("seq").alias("_top"))
    moved = entries.join(heads.select("chain", "_top"), "chain", "left").withColumn(
        "seq", F.col("seq") + F.coalesce(F.col("_top") + 1, F.lit(0))
    ).drop("_top")
    sealed = seal_entries(with_canonical(moved), heads=heads).drop("canonical")
    sealed.write.mode("append").option("ignoreNullFields", False).json(path)


def commit_log(entries: DataFrame, path: str, batch_id: str, attempts: int = 20) -> bool:
    """Append a batch of entries to a log with a commit table; false when the batch is in it already.

    A commit is one small file: the batch, the folder of its entries, and the last hash and number of every chain that it
    went on with. Chains continue from the commits, so entries written earlier are never read. A commit is published by one
    rename to the next version's name, which fails where another writer was first: then the batch is sealed anew behind it.
    Entries of a failed attempt lie in a folder that no commit names, so no reader sees them.
    """
    spark = entries.sparkSession
    for _ in range(attempts):
        commits, version, held = _commits(spark, path), 0, None
        if commits is not None:
            if not commits.where(F.col("batch_id") == batch_id).isEmpty():
                return False
            version = commits.agg(F.max("version").alias("v")).first()["v"] + 1
            held = commits.where("chain IS NOT NULL").groupBy("chain").agg(F.max_by("entry_hash", "version").alias("entry_hash"), F.max("top").alias("_top"))
        moved = entries if held is None else entries.join(held.select("chain", "_top"), "chain", "left").withColumn(
            "seq", F.col("seq") + F.coalesce(F.col("_top") + 1, F.lit(0))).drop("_top")
        folder = f"entries/{uuid.uuid4().hex}"
        sealed = seal_entries(with_canonical(moved), heads=held).drop("canonical")
        sealed.write.option("ignoreNullFields", False).json(f"{path}/{folder}")
        stored = spark.read.schema(f"chain string, {schema.AUDIT}").json(f"{path}/{folder}")
        tips = stored.groupBy("chain").agg(F.max_by("entry_hash", "seq").alias("entry_hash"), F.max("seq").alias("top"))
        marked = spark.range(1).select(F.lit(None).cast("string").alias("chain"), F.lit(None).cast("string").alias("entry_hash"), F.lit(None).cast("long").alias("top"))
        named = tips.unionByName(marked).withColumn("batch_id", F.lit(batch_id)).withColumn("folder", F.lit(folder)).withColumn("version", F.lit(version).cast("long"))
        staged = f"{path}/staged/{uuid.uuid4().hex}"
        named.coalesce(1).write.parquet(staged)
        if _published(spark, staged, f"{path}/commits/{version:012d}.parquet"):
            return True
    raise RuntimeError(f"{path} was written by others {attempts} times in a row")


def _commits(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema("chain string, entry_hash string, top long, batch_id string, folder string, version long").parquet(f"{path}/commits")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _published(spark: SparkSession, staged: str, target: str) -> bool:
    """Rename the one file of a staged folder; false where the target is there already."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    hadoop = jvm.org.apache.hadoop.fs
    source, goal = hadoop.Path(staged), hadoop.Path(target)
    store = source.getFileSystem(conf)
    store.mkdirs(goal.getParent())
    files = [f.getPath() for f in store.listStatus(source) if f.getPath().getName().endswith(".parquet")]
    whole = store.makeQualified(files[0])
    never_over = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
    never_over[0] = getattr(hadoop, "Options$Rename").NONE
    try:
        hadoop.FileContext.getFileContext(whole.toUri(), conf).rename(whole, store.makeQualified(goal), never_over)
    except Py4JJavaError as error:
        if error.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
            return False
        raise
    return True


def read_committed(spark: SparkSession, path: str) -> DataFrame:
    """The entries of all commits, with their canonical text."""
    commits = _commits(spark, path)
    folders = [] if commits is None else [r["folder"] for r in commits.select("folder", "version").distinct().orderBy("version").collect()]  # a row per commit
    reader = spark.read.schema(f"chain string, {schema.AUDIT}")
    return with_canonical(reader.json([f"{path}/{f}" for f in folders]) if folders else spark.createDataFrame([], f"chain string, {schema.AUDIT}"))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """A log written here, with its canonical text."""
    return with_canonical(spark.read.schema(f"chain string, {schema.AUDIT}").json(path))


def write_json(df: DataFrame, path: str) -> None:
    """Metrics, distributions and results as JSON lines."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "static").json(path)


def write_json_arrays(df: DataFrame, path: str) -> None:
    """Rows as JSON arrays, one array per file; every task writes its own."""
    def bracketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = "["
        for batch in batches:
            for text in batch.column(0).to_pylist():
                yield pa.record_batch([pa.array([lead + text])], names=["value"])
                lead = ","
        yield pa.record_batch([pa.array(["[]" if lead == "[" else "]"])], names=["value"])

    lines = df.select(F.to_json(F.struct(*df.columns)).alias("value")).mapInArrow(bracketed, "value string")
    lines.write.mode("overwrite").option("partitionOverwriteMode", "static").text(path)


def write_reports(headers: DataFrame, ads: DataFrame, path: str) -> None:
    """Reports by run: ``headers/run_id=N`` holds the document head, ``ads/run_id=N`` its ordered lines."""
    headers.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").json(f"{path}/headers")
    ordered = ads.orderBy("run_id", "priority", F.desc("exact_score"), "score_id")
    ordered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").json(f"{path}/ads")


def write_documents(documents: DataFrame, path: str) -> None:
    """Nested reports as JSON under ``run_id=N/part=M``."""
    documents.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id", "part").json(path)


def export_cases(cases: DataFrame, path: str) -> None:
    """Confirmed cases as JSON lines, and beside them one row with export time and count."""
    cases.write.mode("overwrite").option("partitionOverwriteMode", "static").json(f"{path}/cases")
    summary = cases.agg(F.count(F.lit(1)).alias("count")).select(F.current_timestamp().alias("exported_at"), "count")
    summary.write.mode("overwrite").option("partitionOverwriteMode", "static").json(f"{path}/summary")


def upsert_rules(stored: DataFrame, incoming: DataFrame, position: str | None = None) -> DataFrame:
    """Rule vectors after an ingest: the incoming rule replaces the stored one with the same id.

    ``position`` is the incoming column of ingest order, by which the last of several rules with one id wins; it is not
    stored. Without it, rules of one id must be equal, and any of them stands for all.
    """
    placed = incoming.withColumn("_at", F.col(position) if position else F.lit(0)).withColumn("_new", F.lit(1))
    placed = placed.drop(position) if position and position not in stored.columns else placed
    kept = stored.withColumn("_new", F.lit(0)).withColumn("_at", F.lit(None).cast(placed.schema["_at"].dataType))
    return latest(kept.unionByName(placed), ["rule_id"], ["_new", "_at"]).drop("_new", "_at")


def write_version(df: DataFrame, path: str, version: int) -> None:
    """A new version beside the old ones, so a table can be rebuilt from itself."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(f"{path}/version={version}")


def read_newest(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """The newest version of a table and its number; only directory names are read to find it."""
    versions = spark.read.parquet(path)
    number = versions.agg(F.max("version").alias("v")).first()["v"]
    return versions.where(F.col("version") == number).drop("version"), number


def append_rows(df: DataFrame, root: str, name: str, batch: str | None = None) -> None:
    """Append facts to a table of the store.

    With ``batch``, the rows are the whole of that batch: a repeated append replaces them, so the write is repeatable.
    """
    if batch is None:
        df.write.mode("append").parquet(f"{root}/{name}")
    else:
        df.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(f"{root}/{name}/batch={batch}")


def reset_operational(spark: SparkSession, root: str, reset_extractors: bool = False) -> DataFrame:
    """Empty the operational tables, keep configuration; returns the counts before.

    ``reset_extractors`` puts the extractor versions back to the seed.
    """
    names = ("runs", "observations", "scores", "feedback", "audit_log")
    counts = row_counts({n: readers.read_table(spark, root, n) for n in names}).collect()
    before = spark.createDataFrame(counts, "name string, n bigint")
    for name, ddl in schema.OPERATIONAL_TABLES.items():
        _replace(spark.createDataFrame([], ddl), f"{root}/{name}")
    if reset_extractors:
        _replace(readers.selector_seed(spark), f"{root}/extractor_versions")
    return before


def _replace(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(path)


REQUIRED_TABLES = [*schema.OPERATIONAL_TABLES, *schema.CONFIGURATION_TABLES]
