"""From raw documents to token ids: toxic documents go, boilerplate lines go, one of each group of near copies stays,
documents with benchmark items go, the rest is encoded.

Each stage takes the documents its predecessor kept and returns the columns of ``documents``; the last returns doc_id,
lang, source, n_tokens, token_ids (little-endian unsigned 32-bit numbers) and decoded (the text those ids stand for).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adwatch.llm import bpe, decontaminate, linededup, ngramjoin, toxicity
from adwatch.llm.common import batch_bytes, settle, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
TOXIC_FROM = 0.7
#: Near copies: words of an n-gram and percent of the union.
SHINGLE_WORDS, PERCENT = 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below ``TOXIC_FROM``, with a model of the labelled ones."""
    batch_bytes(spark)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs.select(*COLUMNS), model, out="score").where(F.col("score") < TOXIC_FROM).select(*COLUMNS)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without their cross-site boilerplate lines."""
    found = linededup.dedup(docs.select(*COLUMNS), removed="_lines")
    changed = F.col("_lines") > 0
    return found.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near copies; rows of one id are one document."""
    batch_bytes(spark)
    groups = ngramjoin.link(docs, words=SHINGLE_WORDS, percent=PERCENT)
    going = groups.where("component_id <> doc_id").select("doc_id").distinct()
    return docs.select(*COLUMNS).join(going, "doc_id", "left_anti").select(*COLUMNS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    batch_bytes(spark)
    return decontaminate.clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the text they decode to."""
    batch_bytes(spark)
    path = bpe.vocabulary_path("word_bpe_49k.json")
    encoded = bpe.encode(docs.select("doc_id", "lang", "source", "text"), path)
    return bpe.decode(encoded, path).withColumn("n_tokens", (F.octet_length("token_ids") / 4).cast("long")).select(
        "doc_id", "lang", "source", "n_tokens", "token_ids", "decoded")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate),
    ("ngram_jaccard", drop_near_copies),
    ("decontamination", drop_leaks),
    ("bpe", encode),
]

#: Models and tokenizers are no SQL; the stages are tested one by one against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written once before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = settle(docs)
    return docs
