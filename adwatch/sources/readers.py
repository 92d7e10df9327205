"""Readers of files and tables, with fixed schemas."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adwatch import fixed, schema
from adwatch.sources.elements import json_objects

CORRUPT = "_corrupt_record"


def read_ads(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """Evaluation ads: one JSON array, or JSON lines with ``multiline=False`` (lines split over tasks)."""
    return spark.read.schema(schema.EVAL_AD).option("multiLine", multiline).json(path)


def read_ad_arrays(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation ads of JSON arrays of any size: a file is read by as many tasks as it has splits."""
    objects = json_objects(spark, path)
    return objects.select(F.from_json("value", schema.EVAL_AD).alias("ad")).select("ad.*")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Ground truth: a JSON object keyed by ad id under ``labels``."""
    doc = spark.read.schema(f"labels map<string,{schema.EVAL_LABEL}>").option("multiLine", True).json(path)
    return doc.select(F.explode("labels").alias("id", "_l")).select("id", "_l.*")


def read_label_lines(spark: SparkSession, path: str) -> DataFrame:
    """Ground truth as JSON lines with ``id`` and the label's fields, split over tasks; the form for large sets."""
    fields = schema.EVAL_LABEL.removeprefix("struct<").removesuffix(">")
    return spark.read.schema(f"id string, {fields.replace(':', ' ')}").json(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Earlier evaluation results (JSON lines with ``id``); empty when there are none yet."""
    columns = f"id string, {schema.EVAL_RESULT_COLUMNS}"
    try:
        return spark.read.schema(columns).json(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], columns)


def read_results_object(spark: SparkSession, path: str) -> DataFrame:
    """Earlier results as one JSON object keyed by ad id, read by as many tasks as the file has splits."""
    objects = json_objects(spark, path)
    return objects.select(F.col("key").alias("id"), F.from_json("value", schema.EVAL_RESULT).alias("_r")).select("id", "_r.*")


def read_rule_files(spark: SparkSession, folder: str) -> DataFrame:
    """Every Markdown file of a folder as ``(path, value)``; order by ``path, position`` after parsing."""
    files = spark.read.text(folder, wholetext=True, pathGlobFilter="*.md")
    return files.select(F.col("_metadata.file_path").alias("path"), "value")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Landed crawl pages. Select ``url`` first and filter: the wide ``html`` column is then read only where needed."""
    return spark.read.schema(schema.PAGE).parquet(path)


def read_sealed_logs(spark: SparkSession, path: str) -> DataFrame:
    """Sealed JSON-lines logs (``*.jsonl``), one chain per file: ``chain`` is its whole path, ``log`` its bare name.

    ``block`` and ``line`` give the order inside a file: a split of a file is read by one task in line order, so
    the row number orders lines within it. Unreadable lines stay, marked by ``error``.
    """
    columns = schema.AUDIT.replace("seq bigint, ", "")
    reader = spark.read.schema(f"{columns}, {CORRUPT} string").option("columnNameOfCorruptRecord", CORRUPT)
    lines = reader.option("pathGlobFilter", "*.jsonl").option("recursiveFileLookup", True).json(path)
    return lines.select(
        F.col("_metadata.file_path").alias("chain"),
        F.col("_metadata.file_name").alias("log"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
        *[c.split()[0] for c in columns.split(", ")],
        F.col(CORRUPT).alias("error"),
    )


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One operational or configuration table of a parquet store; empty when nothing is written yet."""
    ddl = {**schema.OPERATIONAL_TABLES, **schema.CONFIGURATION_TABLES}[name]
    try:
        return spark.read.schema(ddl).parquet(f"{root}/{name}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], ddl)


def read_jdbc_table(spark: SparkSession, url: str, name: str, key: str, lower: int, upper: int, partitions: int, **options: str) -> DataFrame:
    """One table of a relational store, read in ranges of its key."""
    reader = spark.read.format("jdbc").options(
        url=url, dbtable=name, partitionColumn=key, lowerBound=str(lower), upperBound=str(upper), numPartitions=str(partitions), **options
    )
    return reader.load()


def platform_seed(spark: SparkSession) -> DataFrame:
    rows = [(i, *row, True) for i, row in enumerate(fixed.PLATFORM_SEED, 1)]
    return spark.createDataFrame(rows, schema.PLATFORM)


def selector_seed(spark: SparkSession) -> DataFrame:
    """The one selector set active from the start."""
    row = (1, fixed.SELECTOR_SEED_PLATFORM, fixed.SELECTOR_SEED, "active", "manual", None, None, None, None, None)
    return spark.createDataFrame([row], schema.EXTRACTOR_VERSION)
