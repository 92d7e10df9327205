"""BPE encoding through a table of distinct words, and decoding through the vocabulary's table of pieces.

Texts are cut at ASCII white space, which a tokenizer with white space dropped never merges across. Tasks turn blocks of
documents into word codes and one list of distinct words per block. The lists meet by hash of the word, where every
distinct word is encoded once by the ``tokenizers`` library; the ids travel back to the blocks and take the words' places
by position. Only distinct words of bounded blocks are shuffled, so a word that is in every document moves once a block.

* Null and empty texts have no ids. Special tokens written out in a text are found as the library finds them.
* Repeated rows and rows with equal ids are encoded each for itself; an empty table gives an empty result.
* Other columns are carried along; one that has the name of an output is replaced by it.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adwatch.llm.common import kept, tidy, with_outputs

#: Bytes of text whose distinct words one block lists; bounds what a task holds.
BLOCK_BYTES = 8 << 20


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


@kept
def tokenizer(path: str):
    """One tokenizer per Python worker, without truncation and padding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    loaded = Tokenizer.from_file(path)
    loaded.no_truncation()
    loaded.no_padding()
    return loaded


@kept
def pieces(path: str) -> pa.Array:
    """The id-to-piece table, by position; ids that have no piece are null."""
    vocabulary = tokenizer(path).get_vocab(with_added_tokens=True)
    found: list = [None] * (max(vocabulary.values()) + 1)
    for piece, i in vocabulary.items():
        found[i] = piece
    return pa.array(found, pa.string())


def _packed(values: np.ndarray) -> bytes:
    """Little-endian numbers as compressed byte planes."""
    import zstandard

    planes = np.ascontiguousarray(values, "<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _blocks(carried: pa.Schema, text: str, buckets: int, schema: pa.Schema, listing: bool):
    """Blocks of documents: their word lists by hash bucket (``listing``), or the rows with codes into those lists.

    Both are made from the texts, in two runs over the same splits; ``check`` is the hash of a block's texts, so lists and
    codes can only meet if they come from the same rows in the same order.
    """

    def cut(batches: list[pa.RecordBatch], block: int) -> pa.RecordBatch:
        import xxhash
        import zstandard

        rows = pa.Table.from_batches(batches).combine_chunks()
        texts = pc.fill_null(rows.column(text).cast(pa.large_string()), "").combine_chunks()
        seal = xxhash.xxh3_64(np.asarray(pc.binary_length(texts)).tobytes())
        seal.update(texts.buffers()[2] or b"")
        check = seal.intdigest() - (1 << 63)
        words = pc.ascii_split_whitespace(texts)
        coded = words.flatten().dictionary_encode()
        listed = coded.dictionary.to_pylist()
        bucket = np.fromiter((xxhash.xxh3_64_intdigest(w) % buckets for w in listed), np.int32, len(listed))
        order = np.argsort(bucket, kind="stable")
        order = order[np.asarray(pc.binary_length(coded.dictionary))[order] > 0]  # white space at the ends leaves empty words
        if listing:
            in_order = bucket[order]
            starts = np.flatnonzero(np.r_[True, in_order[1:] != in_order[:-1]]) if len(order) else np.empty(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[starts, len(order)] if len(order) else [0], pa.int32()),
                                             coded.dictionary.take(pa.array(order)).cast(pa.string()))
            pack = zstandard.ZstdCompressor(level=3)
            packed = [pack.compress(x.as_py().encode()) for x in pc.binary_join(lists, "\n")]
            n = len(starts)
            columns = [pa.array([block] * n, pa.int64()), pa.array([check] * n, pa.int64()), pa.array(in_order[starts], pa.int32()), pa.array(packed, pa.binary())]
        else:
            code = np.full(len(listed), -1, np.int64)
            code[order] = np.arange(len(order))
            codes = code[np.asarray(coded.indices)] if len(listed) else np.empty(0, np.int64)
            ends, n = np.asarray(words.offsets), rows.num_rows
            packed = [_packed((own := codes[a:b])[own >= 0]) for a, b in zip(ends[:-1], ends[1:])]
            columns = [pa.array([block] * n, pa.int64()), pa.array([check] * n, pa.int64()),
                       *[rows.column(f.name).combine_chunks() for f in carried], pa.array(packed, pa.binary())]
        return pa.record_batch([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.nbytes
            if size >= BLOCK_BYTES:
                yield cut(held, block)
                block, held, size = block + 1, [], 0
                pa.default_memory_pool().release_unused()
        if held:
            yield cut(held, block)
        pa.default_memory_pool().release_unused()

    return run


def _encoder(path: str):
    """Encode the distinct words of one hash bucket once, for all blocks that list them."""

    def run(rows: pa.Table) -> pa.Table:
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        listed = pa.array([unpack.decompress(x).decode() for x in rows.column("words").to_pylist()], pa.large_string())
        lists = pc.split_pattern(listed, "\n")
        coded = lists.flatten().dictionary_encode()
        distinct, own = coded.dictionary.to_pylist(), tokenizer(path)
        parts, sizes = [], []
        for a in range(0, len(distinct), 2000):  # few objects of the library at a time
            ids = [e.ids for e in own.encode_batch_fast(distinct[a:a + 2000], add_special_tokens=False)]
            sizes.append(np.fromiter(map(len, ids), np.int32, len(ids)))
            parts.append(np.fromiter((i for x in ids for i in x), np.uint32, int(sizes[-1].sum())))
        lengths = np.concatenate(sizes or [np.empty(0, np.int32)])
        values = np.concatenate(parts or [np.empty(0, np.uint32)])
        per_word = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)], pa.int32()), pa.array(values))
        ends = np.asarray(lists.offsets) - lists.offsets[0].as_py()
        places, sizes, found = np.asarray(coded.indices), [], []
        for a, b in zip(ends[:-1], ends[1:]):
            sizes.append(_packed(lengths[places[a:b]]))
            found.append(_packed(np.asarray(per_word.take(pa.array(places[a:b])).flatten())))
        return pa.table({"block": rows.column("block"), "check": rows.column("check"), "bucket": rows.column("bucket"),
                         "sizes": pa.array(sizes, pa.binary()), "ids": pa.array(found, pa.binary())})

    return run


def _assembler(carried: list[str], schema: pa.Schema):
    """Put the words' ids in the places of the words' codes."""

    def run(documents: pa.Table, words: pa.Table) -> pa.Table:
        if not documents.num_rows:
            if words.num_rows:
                raise RuntimeError("a block's words have no documents: the input gave other rows when it was read again")
            return schema.empty_table()
        words = words.sort_by("bucket")
        sizes = [_unpacked(x) for x in words.column("sizes").to_pylist()]
        values = [_unpacked(x) for x in words.column("ids").to_pylist()]
        ends = np.r_[0, np.cumsum(np.concatenate(sizes or [np.empty(0, np.uint32)]), dtype=np.int64)]
        per_word = pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(np.concatenate(values or [np.empty(0, np.uint32)])))
        found = [np.asarray(per_word.take(pa.array(_unpacked(x))).flatten()).astype("<u4").tobytes() for x in documents.column("codes").to_pylist()]
        columns = [documents.column(c).combine_chunks() for c in carried] + [pa.array(found, pa.binary())]
        return pa.table([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)

    return run


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "token_ids", buckets: int | None = None) -> DataFrame:
    """Every row's text as token ids: the other columns and ``ids``, little-endian unsigned 32-bit numbers in one binary.

    ``path`` names a vocabulary file whose tokenizer drops white space. ``unpack_ids`` makes arrays of the binaries.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = df.sparkSession
    df = with_outputs(df, ids) if ids != text else df
    carried = [f for f in df.schema.fields if f.name != text]
    inner = [T.StructField(f"c{i}", f.dataType) for i, f in enumerate(carried)]  # names that can't clash with this table's own
    rows = df.select(*[F.col(f"`{f.name}`").alias(g.name) for f, g in zip(carried, inner)], F.col(f"`{text}`").cast("string").alias("text"))
    parts = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = pa.schema([to_arrow_schema(T.StructType([g])).field(0) for g in inner])
    key = [T.StructField("block", T.LongType()), T.StructField("check", T.LongType())]
    listed = T.StructType([*key, T.StructField("bucket", T.IntegerType()), T.StructField("words", T.BinaryType())])
    coded = T.StructType([*key, *inner, T.StructField("codes", T.BinaryType())])
    words = rows.mapInArrow(tidy(_blocks(own, "text", parts, to_arrow_schema(listed), True)), listed)
    encoded = words.groupBy("bucket").applyInArrow(_encoder(path), "block long, check long, bucket int, sizes binary, ids binary")
    documents = rows.mapInArrow(tidy(_blocks(own, "text", parts, to_arrow_schema(coded), False)), coded)
    result = T.StructType([*inner, T.StructField("token_ids", T.BinaryType())])
    joined = documents.groupBy("block", "check").cogroup(encoded.groupBy("block", "check")).applyInArrow(
        _assembler([g.name for g in inner], to_arrow_schema(result)), result)
    return joined.select(*[F.col(g.name).alias(f.name) for f, g in zip(carried, inner)], F.col("token_ids").alias(ids))


def decode(df: DataFrame, path: str, ids: str = "token_ids", text: str = "decoded") -> DataFrame:
    """Token ids back to text: each id meets its piece in the vocabulary's table, and the pieces are joined by spaces.

    The table is as large as the vocabulary, whatever the data. Ids without a piece are left out, special tokens stay.
    Null ids give an empty text. Added as column ``text``, in place of one of that name.
    """
    schema = T.StructType([*[f for f in df.schema.fields if f.name != text], T.StructField(text, T.StringType())])
    kept = [f.name for f in df.schema.fields if f.name != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pieces(path)
        for batch in batches:
            found = []
            for packed in batch.column(kept.index(ids)).to_pylist():
                own = np.frombuffer(packed or b"", "<u4")
                taken = known.take(pa.array(own[own < len(known)]))
                taken = taken.drop_null() if taken.null_count else taken
                row = pa.ListArray.from_arrays(pa.array([0, len(taken)], pa.int32()), taken)
                found.append(pc.binary_join(row, " ")[0].as_py() or "")
            yield pa.record_batch([*[batch.column(i) for i in range(len(kept))], pa.array(found, pa.string())], names=[*kept, text])

    return df.select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(tidy(run), schema)


def unpack_ids(ids: str = "token_ids"):
    """The packed ids as an array of longs, as a column."""
    digits = F.hex(ids)
    count = (F.length(digits) / 8).cast("int")
    at = lambda i, k: F.substring(digits, (i * 8 + 2 * k + 1).cast("int"), F.lit(2))
    one = lambda i: F.conv(F.concat(*[at(i, k) for k in (3, 2, 1, 0)]), 16, 10).cast("long")
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), one)).otherwise(F.array().cast("array<bigint>"))
