"""A stored inverted index: which ads hold which word, kept on shared storage and searched by word prefix.

A batch of ads becomes a segment of posting blocks, rows of a word and at most ``BLOCK`` sorted keys. Segments are dealt by
range of word and key and sorted, so a word of any frequency is many blocks in several files, and the words that begin
with a prefix are one range of each file: few prefixes reach the scan as pushed filters and skip the rest. Many prefixes
meet the blocks, not the texts, on equality, hot ones in parts.

An ad that arrives again replaces what earlier segments say of it: blocks stay as they are, and hits of an older segment
are dropped where a newer one lists the key. ``merge_segments`` folds segments into a base without outdated entries. Both
write under a number and replace what lies there, so a step that runs again after a failure leaves one copy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adwatch.functions import text as X
from adwatch.operators.search import INLINE_TERMS, search_body, search_terms, term_tokens
from adwatch.operators.skew import spread_join

#: Keys of a posting block.
BLOCK = 1_000
#: Terms of one prefix that meet a block together.
CHUNK = 1_000
#: Rows (pairs of word and ad, or hits) and bytes of text that a task sorts: tables are dealt to more tasks as they grow.
TASK_ROWS = 500_000
TASK_BYTES = 4 << 20


def _cut(block: int):
    """Rows of (word, key), sorted, to blocks of one word; repeated rows count once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
            word, key = rows.column(0), rows.column(1)
            codes = np.asarray(word.combine_chunks().dictionary_encode().indices)
            keys = np.asarray(key.combine_chunks().dictionary_encode(null_encoding="encode").indices)
            new = np.r_[True, codes[1:] != codes[:-1]]
            rows = rows.filter(pa.array(new | np.r_[True, keys[1:] != keys[:-1]]))
            new = new[new | np.r_[True, keys[1:] != keys[:-1]]]
            begin = np.flatnonzero(new)
            place = np.arange(len(new)) - np.repeat(begin, np.diff(np.r_[begin, len(new)]))
            starts = np.flatnonzero(place % block == 0)
            last = int(starts[-1])  # may go on in the next batch
            if len(starts) > 1:
                yield _blocks(rows.slice(0, last), starts)
            held = rows.slice(last).combine_chunks().to_batches()[0]
        if held is not None:
            yield _blocks(pa.Table.from_batches([held]), np.array([0, held.num_rows]))

    return run


def _blocks(rows: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
    rows = rows.combine_chunks()
    keys = rows.column(1).chunk(0)
    lists = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), keys)
    return pa.record_batch([rows.column(0).chunk(0).take(pa.array(starts[:-1])), lists], names=["word", "keys"])


def _tasks(spark: SparkSession, size: int | None, each: int) -> int:
    """Tasks for a table of ``size``, as many as the session's at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(size or 0) // each))


def _posted(pairs: DataFrame, block: int, ranges: int) -> DataFrame:
    """Posting blocks of (word, key) pairs in any order, sorted in so many ranges."""
    kind = pairs.schema["key"].dataType
    schema = T.StructType([T.StructField("word", T.StringType()), T.StructField("keys", T.ArrayType(kind))])
    return pairs.repartitionByRange(ranges, "word", "key").sortWithinPartitions("word", "key").mapInArrow(_cut(block), schema)


def _pairs(texts: DataFrame) -> DataFrame:
    return texts.select(F.explode(F.array_distinct(X.words(F.col("body")))).alias("word"), "key")


def _put(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(path)


def write_segment(ads: DataFrame, root: str, batch_id: int, key: str, title: str, description: str | None = None, block: int = BLOCK) -> None:
    """Store a batch of ads as segment ``batch_id``. Nothing stored earlier is read.

    Several rows of one key count as one ad, also those without a key; an ad whose texts are null is found no more.
    """
    _put(ads.select(F.col(key).alias("key"), search_body(title, description).alias("body")), f"{root}/texts/parts/batch_id={batch_id}")
    stored = ads.sparkSession.read.parquet(f"{root}/texts/parts/batch_id={batch_id}")
    size = stored.agg(F.sum(F.octet_length("body"))).first()[0]
    _put(_posted(_pairs(stored), block, _tasks(ads.sparkSession, size, TASK_BYTES)), f"{root}/words/parts/batch_id={batch_id}")


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


class Index:
    """What a reader sees of an index: the newest base and the segments after it, up to ``upto``."""

    def __init__(self, spark: SparkSession, root: str, upto: int | None = None):
        self.root, limit = root, F.lit(True) if upto is None else F.col("batch_id") <= upto
        bases = _read(spark, f"{root}/done")  # a base counts once its mark is written, after its files
        wanted = None if bases is None else bases.where(limit).agg(F.max("batch_id").alias("b")).first()["b"]
        self.done = -1 if wanted is None else wanted
        self.parts = {}
        for name in ("texts", "words"):
            part = spark.read.parquet(f"{root}/{name}/parts").where(F.col("batch_id") > self.done).where(limit)
            base = None if wanted is None else spark.read.parquet(f"{root}/{name}/base/upto={wanted}").withColumn("batch_id", F.lit(wanted))
            self.parts[name] = part if base is None else part.unionByName(base)
        newer = spark.read.parquet(f"{root}/texts/parts").where(F.col("batch_id") > self.done).where(limit)
        self.newest = newer.groupBy(F.col("key").alias("_key")).agg(F.max("batch_id").alias("_newest"))

    @property
    def texts(self) -> DataFrame:
        """key, body: the newest text of every ad."""
        return self.current(self.parts["texts"]).select("key", "body")

    @property
    def words(self) -> DataFrame:
        """word, keys, batch_id: all posting blocks."""
        return self.parts["words"]

    def current(self, rows: DataFrame, tasks: int | None = None) -> DataFrame:
        """The rows (key, batch_id, ...) that no newer segment replaces; a large table is dealt to ``tasks`` by key."""
        own = rows.withColumn("_own", F.struct("key"))  # equal also where the key is null
        newest = self.newest.select(F.struct(F.col("_key").alias("key")).alias("_own"), "_newest")
        return (own if tasks is None else own.repartition(tasks, "_own")).join(newest, "_own", "left").where(
            F.col("_newest").isNull() | (F.col("_newest") <= F.col("batch_id"))).drop("_own", "_newest")

    def hits(self, found: DataFrame, tasks: int | None = None) -> DataFrame:
        """The distinct (key, term_id, term) of current hits (key, term_id, term, batch_id): a hit stands if its newest does."""
        own = found.select(F.struct("key").alias("_own"), "term_id", "term", "batch_id")
        own = own if tasks is None else own.repartition(tasks, "_own")
        last = own.groupBy("_own", "term_id", "term").agg(F.max("batch_id").alias("batch_id"))
        newest = self.newest.select(F.struct(F.col("_key").alias("key")).alias("_own"), "_newest")
        return last.join(newest, "_own", "left").where(F.col("_newest").isNull() | (F.col("_newest") <= F.col("batch_id"))).select(
            F.col("_own.key").alias("key"), "term_id", "term")


def merge_segments(spark: SparkSession, root: str, upto: int, block: int = BLOCK) -> None:
    """Fold all segments up to ``upto`` into a new base. Readers use it once it is whole; old parts may then be dropped."""
    index = Index(spark, root, upto)
    if index.done == upto:
        return
    n_pairs = index.words.agg(F.sum(F.size("keys"))).first()[0]
    n_bytes = index.parts["texts"].agg(F.sum(F.octet_length("body"))).first()[0]
    tasks = _tasks(spark, n_pairs, TASK_ROWS)
    pairs = index.current(index.words.select("word", F.explode("keys").alias("key"), "batch_id"), tasks).select("word", "key")
    texts = index.current(index.parts["texts"], _tasks(spark, n_bytes, 8 * TASK_BYTES)).select("key", "body")
    _put(texts, f"{root}/texts/base/upto={upto}")
    _put(_posted(pairs, block, tasks), f"{root}/words/base/upto={upto}")
    _put(spark.range(1), f"{root}/done/batch_id={upto}")


def search_index(spark: SparkSession, root: str, terms: DataFrame, upto: int | None = None) -> DataFrame:
    """One search per term over the index: the distinct ``(key, term_id, term)``, as ``search_terms`` gives over the texts.

    Up to ``INLINE_TERMS`` prefixes are pushed into the scan of the blocks; more of them join. Terms without a useful word
    are looked up in the stored texts.
    """
    index = Index(spark, root, upto)
    prepared = term_tokens(terms)
    worded = prepared.where(F.size("_tokens") > 0).select("term_id", "term", F.explode("_tokens").alias("prefix"))
    plain = prepared.where(F.size("_tokens") == 0).select("term_id", "term")
    listed = worded.limit(INLINE_TERMS + 1).collect()
    by_word = index.hits(_found_inline(index, worded, listed)) if len(listed) <= INLINE_TERMS else joined_hits(index, worded)
    by_text = search_terms(index.texts, plain, "key", "body").select("key", "term_id", "term")
    return by_word.unionByName(by_text)


def prefix_blocks(index: Index, prefixes: list[str]) -> DataFrame:
    """The posting blocks of words that begin with one of a few prefixes; the scan skips all others."""
    wanted = F.lit(False)
    for prefix in sorted(prefixes):
        wanted = wanted | F.col("word").startswith(prefix)
    return index.words.where(wanted)


def _found_inline(index: Index, worded: DataFrame, listed: list) -> DataFrame:
    kind = worded.schema["term_id"].dataType
    hits = [F.when(F.col("word").startswith(r["prefix"]), F.struct(F.lit(r["term_id"]).cast(kind).alias("term_id"), F.lit(r["term"]).alias("term")))
            for r in listed]
    if not hits:
        return index.words.where("false").select(F.explode("keys").alias("key"), F.lit(None).cast(kind).alias("term_id"), F.lit("").alias("term"), "batch_id")
    met = prefix_blocks(index, list({r["prefix"] for r in listed})).select("keys", "batch_id", F.inline(F.array_compact(F.array(*hits))))
    return met.select(F.explode("keys").alias("key"), "term_id", "term", "batch_id")


def joined_hits(index: Index, worded: DataFrame) -> DataFrame:
    """The distinct current hits (key, term_id, term) of prefixes (term_id, term, prefix), by joins.

    Hits are counted first, from the sizes of blocks and the numbers of terms, and met by tasks as their number asks for.
    """
    chunk = F.pmod(F.xxhash64("term_id", "term"), F.col("chunks")).cast("int")
    counted = worded.groupBy("prefix").agg(F.count(F.lit(1)).alias("n"))
    sized = counted.select("prefix", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks"))
    chunked = worded.join(sized, "prefix").withColumn("chunk", chunk).groupBy("prefix", "chunk").agg(F.collect_list(F.struct("term_id", "term")).alias("terms"))
    lengths = worded.agg(F.collect_set(F.length("prefix")).alias("n"))
    own = F.transform(F.filter("_lengths", lambda n: n <= F.length("word")), lambda n: F.left("word", n))
    blocks = index.words.withColumn("_lengths", lengths.scalar()).select("keys", "batch_id", F.explode(own).alias("prefix"))
    n_hits = blocks.groupBy("prefix").agg(F.sum(F.size("keys")).alias("k")).join(counted, "prefix").agg(F.sum(F.col("k") * F.col("n"))).first()[0]
    tasks = _tasks(worded.sparkSession, n_hits, TASK_ROWS)
    used = spread_join(blocks, sized, ["prefix"], least_rows=10_000, tasks=tasks)
    dealt = used.select("keys", "batch_id", "prefix", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    met = spread_join(dealt, chunked, ["prefix", "chunk"], least_rows=10_000, tasks=tasks).select("keys", "batch_id", F.inline("terms"))
    return index.hits(met.select(F.explode("keys").alias("key"), "term_id", "term", "batch_id"), tasks)
