"""Bytes covered by long strings that occur elsewhere, from sorted suffixes and their common prefixes.

Every string of ``width`` bytes is known by its anchor, the place in it whose q-gram has the smallest hash; equal strings
have their anchors at equal places. Suffixes are sorted at anchors only, by shard of equal q-grams: sorted tuples of right
contexts with the length each shares with the one before, and likewise of left contexts read backwards. All other suffixes
are induced from these: strings that start ``k`` bytes before their anchors are equal when the left tuples share ``k``
bytes and the right ones the rest, so one step to the left moves both limits by one. What the method does with disk-backed
queues, Spark's shuffle sort does here: runs on disk, merged by shard, so all shards together may be far larger than
memory. A shard of more than ``MAX_SHARD`` anchors is not sorted in one task: its strings go out one by one under 128-bit
hashes and are counted by aggregation.

Only anchors that occur twice are followed, and only once per distinct context and task. Exact copies of whole texts are
counted by hash before, so a group of copies never meets in one task.

* Texts are whole, as UTF-8 bytes; null counts as empty. Strings never cross texts. Texts shorter than ``width`` lose
  nothing. Rows of equal id and text are copies of each other; rows of equal id and different text are judged each for
  itself. An empty table gives an empty result. Of other columns nothing is returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adwatch.llm.common import settle

#: Bytes of a q-gram, a power of two.
GRAM = 64
#: Bytes of text that are searched for anchors at once; places in them must fit 24 bits.
PIECE = 4 << 20
MAX_SHARD = 20_000
#: Contexts up to which a shard's are compared one with another instead of by rank.
FEW = 48
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ODD = _RNG.integers(0, 1 << 62, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = np.uint64((1 << 24) - 1)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every q-gram, by doubling."""
    with np.errstate(over="ignore"):
        hashed, n, step = _BYTE[data], 1, 0
        while n < GRAM:
            hashed = hashed[:-n] * _ODD[step] + (hashed[n:] ^ (hashed[n:] >> np.uint64(29)))
            n, step = n * 2, step + 1
        hashed = (hashed ^ (hashed >> np.uint64(32))) * _ODD[7]
        return hashed ^ (hashed >> np.uint64(29))


def anchors(data: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of all strings of ``width`` bytes in at most 16 MB: hash, place, first and last start of their strings."""
    hashed = gram_hashes(data)
    keyed = (hashed & ~_PLACE) | np.arange(len(hashed), dtype=np.uint64)
    span = width - GRAM + 1
    least, n = keyed, 1
    while n * 2 <= span:
        least = np.minimum(least[:-n], least[n:])
        n *= 2
    if n < span:
        least = np.minimum(least[:len(least) - (span - n)], least[span - n:])
    place = (least & _PLACE).astype(np.int64)
    first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    last = np.r_[first[1:], len(place)] - 1
    return hashed[place[first]].view(np.int64), place[first], first, last


def _anchor_rows(width: int):
    """Anchors of the distinct texts of a task."""

    def of(data: np.ndarray):
        for a in range(0, max(1, len(data) - width + 1), PIECE):
            found = anchors(data[a:a + PIECE + width - 1], width)
            yield found[0], found[1] + a, found[2] + a, found[3] + a

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for doc, tie, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                text = np.frombuffer(data.as_buffer() or b"", np.uint8) if data.is_valid else np.empty(0, np.uint8)
                if len(text) < width:
                    continue
                digest = hashlib.blake2b(text, digest_size=16).digest()
                if digest in seen:
                    continue
                seen.add(digest)
                for gram, place, first, last in of(text):
                    n = len(gram)
                    yield pa.record_batch([pa.array(gram), pa.array([doc] * n, pa.int64()), pa.array([tie] * n, pa.int64()),
                                           pa.array(place), pa.array(first), pa.array(last)],
                                          names=["gram", "doc_id", "tie", "place", "first", "last"])

    return run


def _contexts(width: int):
    """The bytes around each anchor; a context seen before in the task goes out without bytes, as a copy."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        seen: set[bytes] = set()
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for doc, tie, packed, found in zip(*(batch.column(i).to_pylist() for i in range(4))):
                text, rows = unpack.decompress(packed), []
                for x in found:
                    context = text[x["first"]:x["last"] + width]
                    before = x["place"] - x["first"]
                    digest = hashlib.blake2b(context + before.to_bytes(4, "little"), digest_size=16).digest()
                    again = digest in seen
                    seen.add(digest)
                    rows.append((x["gram"], doc, tie, x["first"], before, x["last"] - x["first"] + 1, digest, None if again else context, x["large"]))
                types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.bool_())
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)],
                                      names=["gram", "doc_id", "tie", "first", "before", "starts", "digest", "context", "large"])

    return run


CONTEXTS = "gram long, doc_id long, tie long, first long, before int, starts int, digest binary, context binary, large boolean"


def _table(parts: list[bytes], most: int) -> tuple[np.ndarray, np.ndarray]:
    """The parts as rows of bytes, one column more than the longest may have, and their lengths."""
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    table = np.zeros((len(parts), most + 1), np.uint8)
    held = np.arange(most + 1) < lengths[:, None]
    table[held] = np.frombuffer(b"".join(parts), np.uint8)
    return table, lengths


def _shared(one: np.ndarray, two: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Leading bytes that rows have in common."""
    differs = one != two
    differs[:, -1] = True
    return np.minimum(differs.argmax(1), lengths)


def shard(members: list[tuple[bytes, int, int]], width: int) -> list[np.ndarray]:
    """For each (context, before, starts) of one q-gram: which of its strings occur in another member.

    ``before`` is the anchor's place in the context. Members are distinct.
    """
    n = len(members)
    found = [np.zeros(m[2], bool) for m in members]
    right, right_lengths = _table([m[0][m[1]:m[1] + width] for m in members], width)
    left, left_lengths = _table([m[0][:m[1]][::-1] for m in members], width)
    most = np.fromiter((m[1] for m in members), np.int64, n)  # bytes before the anchor: of the first string
    fewest = most - np.fromiter((m[2] for m in members), np.int64, n) + 1
    if n <= FEW:
        for i in range(n - 1):
            after = _shared(right[i + 1:], right[i], np.minimum(right_lengths[i + 1:], right_lengths[i]))
            before = _shared(left[i + 1:], left[i], np.minimum(left_lengths[i + 1:], left_lengths[i]))
            low = np.maximum(np.maximum(fewest[i + 1:], fewest[i]), width - after)
            high = np.minimum(np.minimum(most[i + 1:], most[i]), before)
            for j in np.flatnonzero(low <= high).tolist():
                a, b = int(low[j]), int(high[j])
                for m in (i, i + 1 + j):
                    found[m][most[m] - b:most[m] - a + 1] = True
        return found
    by_right, by_left = (np.array(sorted(range(n), key=[row.tobytes() for row in t].__getitem__)) for t in (right, left))
    shared_right, shared_left = (np.r_[0, _shared(t[o][1:], t[o][:-1], np.minimum(k[o][1:], k[o][:-1]))]
                                 for t, o, k in ((right, by_right, right_lengths), (left, by_left, left_lengths)))
    rank_right, rank_left = np.empty(n, np.int64), np.empty(n, np.int64)
    # a step to the left asks one byte more of the left tuples and one less of the right ones
    for k in range(max(0, int(fewest.min()), width - int(shared_right.max())), min(int(most.max()), int(shared_left.max())) + 1):
        rank_right[by_right] = np.cumsum(shared_right < width - k)
        rank_left[by_left] = np.cumsum(shared_left < k)
        own = np.flatnonzero((fewest <= k) & (k <= most))
        if len(own) < 2:
            continue
        classes = rank_right[own] * (n + 1) + rank_left[own]
        order = np.argsort(classes)
        same = classes[order][1:] == classes[order][:-1]
        for i in own[order[np.r_[False, same] | np.r_[same, False]]].tolist():
            found[i][most[i] - k] = True
    return found


def _runs(first: int, marks: np.ndarray, width: int) -> list[tuple[int, int]]:
    """Covered bytes of marked starts."""
    edges = np.flatnonzero(np.diff(np.r_[False, marks, False].astype(np.int8)))
    return [(first + int(a), first + int(b) - 1 + width) for a, b in zip(edges[::2], edges[1::2])]


def _shards(width: int):
    """From contexts in order of q-gram: covered bytes of every text."""

    def settle_one(rows: list[tuple]) -> Iterator[tuple]:
        places: dict[bytes, list[tuple]] = {}
        for doc, tie, first, before, starts, digest, context in rows:
            places.setdefault(digest, []).append((doc, tie, first, before, starts, context))
        distinct = list(places.values())
        if len(distinct) > 1:
            members = [next((p[5], p[3], p[4]) for p in own if p[5] is not None) for own in distinct]
            marks = shard(members, width)
        else:
            marks = [np.zeros(own[0][4], bool) for own in distinct]
        for own, mark in zip(distinct, marks):
            if len(own) > 1:
                mark[:] = True  # the whole context occurs again
            for doc, tie, first, *_ in own:
                yield from ((doc, tie, a, b) for a, b in _runs(first, mark, width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, out = None, [], []
        for batch in batches:
            for gram, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if gram != key:
                    if len(held) > 1:
                        out.extend(settle_one(held))
                    key, held = gram, []
                held.append(row)
            if len(out) > 20_000:
                yield _covered(out)
                out = []
        if len(held) > 1:
            out.extend(settle_one(held))
        if out:
            yield _covered(out)

    return run


def _covered(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows)], names=["doc_id", "tie", "a", "b"])


def _strings(width: int):
    """The strings of contexts one by one, as hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, tie, first, starts, context in zip(*(batch.column(i).to_pylist() for i in range(5))):
                hashed = [hashlib.blake2b(context[i:i + width], digest_size=16).digest() for i in range(starts)]
                yield pa.record_batch([pa.array(hashed, pa.binary()), pa.array([doc] * starts, pa.int64()), pa.array([tie] * starts, pa.int64()),
                                       pa.array(np.arange(first, first + starts))], names=["string", "doc_id", "tie", "at"])

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without their covered bytes: bytes and runs removed, and the hash of what stays."""
    import zstandard

    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        rows = []
        for doc, tie, packed, spans in zip(*(batch.column(i).to_pylist() for i in range(4))):
            text, merged = unpack.decompress(packed), []
            for a, b in sorted((s["a"], s["b"]) for s in spans):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(b, merged[-1][1])
                else:
                    merged.append([a, b])
            kept, at = [], 0
            for a, b in merged:
                kept.append(text[at:a])
                at = b
            kept.append(text[at:])
            rows.append((doc, tie, sum(b - a for a, b in merged), len(merged), b"".join(kept)))
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["doc_id", "tie", "n_removed", "n_spans", "kept"])


def _packed_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    pack = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        data = [pack.compress(x or b"") for x in batch.column(2).to_pylist()]
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(data, pa.binary())], names=["doc_id", "tie", "data"])


def repeated(df: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 400) -> tuple[DataFrame, DataFrame]:
    """Covered bytes of texts that are no exact copies, and the distinct hashes of texts that are.

    The first table has doc_id, tie (hash of the text), spans (a, b: from and to, some overlapping), data (packed text).
    """
    rows = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.xxhash64(F.col(f"`{text}`")).alias("tie"),
                     F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).cast("binary").alias("data"))
    copies = rows.where(F.octet_length("data") >= width).groupBy(F.unhex(F.sha2("data", 256)).alias("hash")).agg(
        F.count(F.lit(1)).alias("n")).where("n > 1").select("hash")
    found = settle(rows.mapInArrow(_anchor_rows(width), "gram long, doc_id long, tie long, place long, first long, last long"))
    twice = found.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram", (F.col("n") > MAX_SHARD).alias("large"))
    wanted = found.join(twice, "gram").groupBy("doc_id", "tie").agg(F.collect_list(F.struct("gram", "place", "first", "last", "large")).alias("found"))
    packed = rows.mapInArrow(_packed_bytes, "doc_id long, tie long, data binary")
    same = lambda x, y: x["doc_id"].eqNullSafe(y["doc_id"]) & (x["tie"] == y["tie"])
    contexts = settle(packed.join(wanted, same(packed, wanted)).select(packed["doc_id"], packed["tie"], "data", "found")
                      .mapInArrow(_contexts(width), CONTEXTS))
    usual = contexts.where("NOT large").select("gram", "doc_id", "tie", "first", "before", "starts", "digest", "context")
    covered = usual.repartition("gram").sortWithinPartitions("gram").mapInArrow(_shards(width), "doc_id long, tie long, a long, b long")
    oversize = contexts.where("large")
    bytes_of = oversize.where("context IS NOT NULL").groupBy("digest").agg(F.first("context").alias("bytes"))
    strings = oversize.drop("context").join(bytes_of, "digest").select("doc_id", "tie", "first", "starts", F.col("bytes")).mapInArrow(
        _strings(width), "string binary, doc_id long, tie long, at long")
    often = strings.groupBy("string").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("string")
    more = strings.join(often, "string", "left_semi").select("doc_id", "tie", F.col("at").alias("a"), (F.col("at") + width).alias("b"))
    spans = covered.union(more).groupBy("doc_id", "tie").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    return packed.join(spans, same(packed, spans)).select(packed["doc_id"], packed["tie"], "data", "spans"), copies


def dedup(df: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 400) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (of the remaining bytes) and, where some but not all bytes
    went, kept (those bytes; null: the whole text stays, or nothing does)."""
    spans, copies = repeated(df, doc_id, text, width)
    cut = spans.mapInArrow(_cut, "doc_id long, tie long, n_removed long, n_spans long, kept binary").dropDuplicates(["doc_id", "tie"])
    data = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).cast("binary")
    rows = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.xxhash64(F.col(f"`{text}`")).alias("tie"),
                     F.octet_length(data).cast("long").alias("n_bytes"), F.sha2(data, 256).alias("sha"))
    flagged = rows.join(copies.withColumn("copy", F.lit(True)), F.unhex("sha") == F.col("hash"), "left")
    joined = flagged.join(cut, flagged["doc_id"].eqNullSafe(cut["doc_id"]) & (flagged["tie"] == cut["tie"]), "left")
    whole = F.coalesce("copy", F.lit(False))
    return joined.select(
        flagged["doc_id"], "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce(F.sha2("kept", 256), F.col("sha"))).alias("kept_sha256"),
        F.when(~whole, F.col("kept")).alias("kept"))
