"""Benchmark leaks by latent semantic retrieval: TF-IDF passages, a distributed randomised SVD, then a check word by word.

Document frequencies over all documents are counted in a sketch of fixed size. Texts are read as segments of ``SEGMENT``
words, ``STRIDE`` apart; an entry is the root of count times idf, over the words of the items. Segments without
``HEAVY - 1 + MIN_COSINE`` of any item's weight among its heaviest words can't come within the limit below and end here.
All others are rows of the matrix, beside the items' own. Subspace iteration with the matrix's Gram product, summed over
tasks, gives its leading right singular vectors; in their space the cosine search meets all items and decides what is a
candidate: the cosine must be what ``MIN_COSINE`` of the item's weight makes in a segment of that length, so that neither
short items nor ordinary text around them are lost. A candidate is a leak when its longest common subsequence with the item
covers ``VERBATIM`` of the item, by words and also by weight, or ``PARAPHRASE`` of it and ``ANSWER`` of its
answer, the last sentence, stands there too. The answer of an item of several passages may stand anywhere in the document;
an item of one sentence, or one whose answer is made of common words, has no answer, and ``ALONE`` of it is asked for.

The benchmark is the query set and is taken in blocks of ``BLOCK_ITEMS`` passages of items, fewer than the rank, so that the
latent space holds the items' own directions; a long item's passages may lie in several blocks. ``PASS_BLOCKS`` blocks are
read in one pass over the texts. What travels to tasks is bounded by them.

* Null and empty texts and items match nothing; items of equal id are one item with several texts. Repeated rows are judged
  each for itself. Empty tables give an empty result. Texts are read whole, a long one by one task. Of other columns nothing
  is returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adwatch.llm.common import settle, tidy
from adwatch.llm.ngramjoin import PART_BINS, SKETCH_BINS, _levels

#: Words of a segment and between two beginnings: any ``ITEM_WORDS`` words in a row lie in one segment.
SEGMENT, STRIDE = 80, 16
#: Words of an item up to which it is one passage; longer ones are cut to passages of as many with half as many between.
ITEM_WORDS = 64
BLOCK_ITEMS, PASS_BLOCKS, RANK, EXTRA, ROUNDS = 250, 8, 256, 8, 2
#: Share of an item's weight that a candidate holds at least; somewhat below ``PARAPHRASE``, for what the rank leaves out.
MIN_COSINE = 0.45
VERBATIM, PARAPHRASE, ANSWER, ALONE = 0.8, 0.5, 0.8, 0.65
#: Share of an item's weight that its heaviest words make up, which segments are looked through for.
HEAVY = 0.8
#: Mean idf of an answer's words, as a share of that of its item's, below which it counts as common words.
COMMON = 0.5
SLAB = 512
STRIPPED = ".,;:!?\"'()[]{}«»„“”…*_-¡¿"


def bare_words(text: str) -> list[str]:
    return [b for w in text.lower().split() if (b := w.strip(STRIPPED))]


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray]:
    """Codes of all words, ends per text, the bare words by code and their hashes; words of punctuation are left out."""
    import xxhash

    lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    coded = lists.flatten().dictionary_encode()
    known: dict[str, int] = {}
    as_bare = np.fromiter((known.setdefault(b, len(known)) if (b := w.lower().strip(STRIPPED)) else -1
                           for w in coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
    codes = as_bare[np.asarray(coded.indices)] if len(coded) else np.empty(0, np.int64)
    kept = np.r_[0, np.cumsum(codes >= 0)]
    words = list(known)
    hashed = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))
    return codes[codes >= 0], kept[np.asarray(lists.offsets)], words, hashed


def bare_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Codes of all words, ends per text, and the bare words by code; words of punctuation are left out.

    Distinct words beyond ASCII get Python's lower case as one string, in which a line feed ends each.
    """
    lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    coded = lists.flatten().dictionary_encode()
    lowered = pc.ascii_lower(coded.dictionary)
    other = pc.invert(pc.string_is_ascii(lowered))
    odd = lowered.filter(other)
    if len(odd):
        joined = pc.binary_join(pa.ListArray.from_arrays([0, len(odd)], odd), pa.scalar("\n", odd.type))[0].as_py().lower()
        lowered = pc.replace_with_mask(lowered, other, pc.split_pattern(pa.array([joined], lowered.type), "\n").flatten())
    bare = pc.utf8_trim(lowered, STRIPPED).dictionary_encode()
    numbers = np.where(np.asarray(pc.binary_length(bare.dictionary)) > 0, np.arange(len(bare.dictionary)), -1)
    codes = numbers[np.asarray(bare.indices)][np.asarray(coded.indices)] if len(coded) else np.empty(0, np.int64)
    kept = np.r_[0, np.cumsum(codes >= 0)]
    return codes[codes >= 0], kept[np.asarray(lists.offsets)], bare.dictionary


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's part of the sketch of document frequencies."""
    import zstandard
    from xxhash import xxh3_64_intdigest

    counts, any_rows = np.zeros(SKETCH_BINS, np.int64), False
    for batch in batches:
        any_rows = True
        codes, ends, words = bare_codes(batch.column(0))
        if len(codes):
            once = np.zeros(len(words), np.int64)  # documents by word
            for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
                once[codes[a:b]] += 1  # repeats of a word in a text count once: numpy adds one for each place, not for each index
            hashed = np.fromiter(map(xxh3_64_intdigest, words.to_numpy(zero_copy_only=False)), np.uint64, len(words))
            np.add.at(counts, (hashed & np.uint64(SKETCH_BINS - 1)).astype(np.int64), once)
    if any_rows:
        pack, parts = zstandard.ZstdCompressor(level=1), SKETCH_BINS // PART_BINS
        yield pa.record_batch([pa.array(range(parts), pa.int32()), pa.array([TaskContext.get().partitionId() % 256] * parts, pa.int32()),
                               pa.array([pack.compress(counts[p * PART_BINS:(p + 1) * PART_BINS].tobytes()) for p in range(parts)], pa.binary())],
                              names=["part", "shard", "counts"])


class Weights:
    """Idf of hashed words, from the sketch."""

    def __init__(self, levels: np.ndarray, n_docs: int):
        self.levels = levels
        self.by_level = np.log1p(max(1, n_docs) / np.maximum(1.0, 2.0 ** (np.arange(256) / 4) - 1))

    def of(self, hashed: np.ndarray) -> np.ndarray:
        return self.by_level[self.levels[(hashed & np.uint64(SKETCH_BINS - 1)).astype(np.int64)]]


@dataclass
class Items:
    """The passages of one block of the benchmark; words are numbered within the block."""

    words: dict[str, int]
    ids: list
    passages: list[np.ndarray]
    answers: list[np.ndarray]
    several: list[bool]
    matrix: np.ndarray
    norms: np.ndarray
    weight: np.ndarray


def item_passages(item, text: str | None) -> Iterator[tuple]:
    """The passages of one item: its id, words, the words of its answer (none if it is one sentence), and whether there are several."""
    words = bare_words(text or "")
    last = [p for p in (text or "").replace("?", ".").replace("!", ".").replace("\n", ".").split(".") if bare_words(p)]
    answer = set(bare_words(last[-1])) if len(last) > 1 else set()
    size = ITEM_WORDS
    for a in range(0, max(1, len(words) - size // 2), size // 2) if len(words) > size else (0,):
        if words[a:a + size]:
            yield item, words[a:a + size], answer, len(words) > size


def read_items(block: list[tuple], weights: Weights) -> Items:
    """Passages of items as rows of unit length over their own vocabulary."""
    import xxhash

    ids, passages, answers, several = map(list, zip(*block))
    known: dict[str, int] = {}
    for p, answer in zip(passages, answers):
        for w in [*p, *sorted(answer)]:
            known.setdefault(w, len(known))
    idf = weights.of(np.fromiter((xxhash.xxh3_64_intdigest(w) for w in known), np.uint64, len(known)))
    coded = [np.array([known[w] for w in p], np.int64) for p in passages]
    heard = [np.array(sorted(known[w] for w in a), np.int64) for a in answers]
    heard = [a if len(a) and idf[a].mean() >= COMMON * idf[p].mean() else a[:0] for a, p in zip(heard, coded)]
    matrix = np.zeros((len(passages), len(known)), np.float32)
    for row, p in zip(matrix, coded):
        np.add.at(row, p, 1.0)
    matrix = np.sqrt(matrix * idf.astype(np.float32))
    norms = np.maximum(np.linalg.norm(matrix, axis=1), 1e-9)
    return Items(known, ids, coded, heard, several, matrix / norms[:, None], norms, idf)


class Heavy:
    """The heaviest words of a block's items, to see which segments can hold ``MIN_COSINE`` of an item's weight.

    What shares that much of an item shares ``HEAVY - 1 + MIN_COSINE`` of it among the words that make up ``HEAVY`` of it.
    """

    def __init__(self, items: Items):
        listed: list[tuple[int, int, float]] = []
        for j, passage in enumerate(items.passages):
            own, times = np.unique(passage, return_counts=True)
            share = items.weight[own] * times / max(float(items.weight[passage].sum()), 1e-9)
            order = np.lexsort((own, -items.weight[own]))
            kept = order[:int(np.searchsorted(np.cumsum(share[order]), HEAVY)) + 1]
            listed += [(int(own[k]), j, float(share[k] / times[k])) for k in kept]
        listed.sort()
        self.item, self.share = np.array([x[1] for x in listed], np.int64), np.array([x[2] for x in listed])
        self.starts = np.searchsorted([x[0] for x in listed], np.arange(len(items.words) + 2))

    def segments(self, feature: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Beginnings of the segments to look at, as places of the batch; ``feature`` is the word of every place, -1 if none."""
        place = np.flatnonzero(feature >= 0)
        n = self.starts[feature[place] + 1] - self.starts[feature[place]]
        place, n = place[n > 0], n[n > 0]
        if not len(place):
            return place
        at = np.repeat(self.starts[feature[place]] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        key = self.item[at] * len(feature) + np.repeat(place, n)
        order = np.argsort(key, kind="stable")
        key, sums = key[order], np.r_[0.0, np.cumsum(self.share[at][order])]
        # each hit as the first of a segment's length; a segment may be counted over a text's end, which only keeps more
        stop = np.searchsorted(key, np.minimum(key + SEGMENT, (key // len(feature) + 1) * len(feature)))
        first = np.unique(key[sums[stop] - sums[:-1] >= HEAVY - 1 + MIN_COSINE - 1e-6] % len(feature))
        own = np.searchsorted(ends, first, "right") - 1
        begin = first - (first - ends[own]) % STRIDE
        last = np.maximum(ends[own + 1] - SEGMENT, ends[own])  # the last segment of a text that is longer than one ends with it
        return np.unique(np.concatenate([np.minimum(begin, last), np.minimum(np.maximum(begin - STRIDE, ends[own]), last)]))


def _candidate_rows(shared):
    """Segments that can hold enough of some item of a block, as sparse rows of unit length with their length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = shared.value
        listed = [pa.array(list(items.words), pa.large_string()) for items in blocks]
        looked = [Heavy(items) for items in blocks]
        wide = [np.unique(np.concatenate([a for a, s in zip(i.answers, i.several) if s] or [np.empty(0, np.int64)])) for i in blocks]
        for batch in batches:
            codes, ends, words = bare_codes(batch.column(2))
            if not len(codes):
                continue
            doc_ids, ties = batch.column(0), batch.column(1)
            for number, (items, heavy) in enumerate(zip(blocks, looked)):
                own_words = pc.fill_null(pc.index_in(words, value_set=listed[number]), -1)
                feature, rows, seen = np.asarray(own_words).astype(np.int64)[codes], [], set()
                begins = heavy.segments(feature, ends)
                owners = np.searchsorted(ends, begins, "right") - 1
                for a, d in zip(begins.tolist(), owners.tolist()):
                    own = feature[a:min(a + SEGMENT, int(ends[d + 1]))]
                    segment = own[own >= 0]
                    key = (d, segment.tobytes())
                    if key in seen:
                        continue  # a text that repeats a segment asks once
                    seen.add(key)
                    f, times = np.unique(segment, return_counts=True)
                    value = np.sqrt(times * items.weight[f])
                    length = float(np.sqrt((value ** 2).sum()))
                    whole = np.intersect1d(wide[number], feature[ends[d]:ends[d + 1]]) if len(wide[number]) else wide[number]
                    rows.append((number, doc_ids[d].as_py(), ties[d].as_py(), f.astype("<i4").tobytes(), (value / max(length, 1e-12)).astype("<f4").tobytes(),
                                 length, segment.astype("<i4").tobytes(), whole.astype("<i4").tobytes()))
                    if len(rows) == 2000:
                        yield _row_batch(rows)
                        rows = []
                if rows:
                    yield _row_batch(rows)

    return run


_ROW = "block int, doc_id long, tie long, features binary, weights binary, length double, segment binary, whole binary"


def _row_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.float64(), pa.binary(), pa.binary())
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=[f.split()[0] for f in _ROW.split(", ")])


def _gram_product(shared):
    """A task's sum of x (x' Q) over its rows, in slabs of features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, total = shared.value, None
        for batch in batches:
            for f, w in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                f, w = np.frombuffer(f, "<i4"), np.frombuffer(w, "<f4")
                total = np.zeros(q.shape, np.float64) if total is None else total
                total[f] += np.outer(w, w @ q[f])
        if total is not None:
            n = -(-len(total) // SLAB)
            yield pa.record_batch([pa.array(range(n), pa.int32()), pa.array([TaskContext.get().partitionId() % 256] * n, pa.int32()),
                                   pa.array([total[i * SLAB:(i + 1) * SLAB].astype("<f8").tobytes() for i in range(n)], pa.binary())],
                                  names=["slab", "shard", "data"])

    return run


def _added(keys: tuple[str, ...]):
    def run(rows: pa.Table) -> pa.Table:
        total = None
        for data in rows.column("data"):
            own = np.frombuffer(data.as_buffer(), "<f8")
            total = own.copy() if total is None else total + own
        return pa.table({**{k: rows.column(k).slice(0, 1) for k in keys}, "data": pa.array([total.tobytes()], pa.binary())})

    return run


def singular_vectors(rows: DataFrame, items: np.ndarray, seed: int = 11) -> np.ndarray:
    """Leading right singular vectors of the passages (sparse rows) and items (dense rows) together.

    Items weigh as much as all passages together, so that their own directions come first, whatever the passages are about;
    while a block has no more passages of items than the rank, the latent space keeps their cosines whole. As large as the
    items' vocabulary times the rank, whatever the number of passages.
    """
    spark = rows.sparkSession
    features = items.shape[1]
    width = min(RANK + EXTRA, features)
    q, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(features, width)))
    product, weight = q, 1.0 + rows.count()
    for _ in range(ROUNDS):
        shared = spark.sparkContext.broadcast(q.astype(np.float32))
        parts = rows.select("features", "weights").mapInArrow(tidy(_gram_product(shared)), "slab int, shard int, data binary")
        once = parts.groupBy("slab", "shard").applyInArrow(_added(("slab", "shard")), "slab int, shard int, data binary")
        summed = once.groupBy("slab").applyInArrow(_added(("slab",)), "slab int, data binary")
        product = weight * (items.T.astype(np.float64) @ (items @ q))
        for row in summed.collect():  # one row per SLAB features of the vocabulary
            a = row["slab"] * SLAB
            product[a:a + SLAB] += np.frombuffer(bytes(row["data"]), "<f8").reshape(-1, width)
        before, (q, _) = q, np.linalg.qr(product)
    values, turned = np.linalg.eigh((before.T @ product + product.T @ before) / 2)
    vectors, _ = np.linalg.qr(product @ turned[:, ::-1][:, :min(RANK, width)] / np.sqrt(np.maximum(values[::-1][:min(RANK, width)], 1e-12)))
    return vectors.astype(np.float32)


def common_words(one: list, two: list) -> int:
    """Length of the longest common subsequence, by bits of a long integer."""
    places: dict = {}
    for i, w in enumerate(one):
        places[w] = places.get(w, 0) | 1 << i
    full, row = (1 << len(one)) - 1, (1 << len(one)) - 1
    for w in two:
        hit = row & places.get(w, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(one) - row.bit_count()


def common_weight(one: np.ndarray, two: np.ndarray, weight: np.ndarray) -> float:
    """Weight of the heaviest common subsequence of two arrays of words."""
    best, own = np.zeros(len(one) + 1), weight[one]
    matches = {w: own * (one == w) for w in set(one.tolist()) & set(two.tolist())}
    for w in two.tolist():
        if w in matches:
            best[1:] = np.maximum.accumulate(np.where(matches[w] > 0, np.maximum(best[1:], best[:-1] + matches[w]), best[1:]))
    return float(best[-1])


def judged(items: Items, j: int, segment: np.ndarray, whole: np.ndarray) -> tuple[bool, float, float]:
    """Whether a segment leaks an item's passage, with the shares of the passage and of its answer that stand there."""
    passage, answer = items.passages[j], items.answers[j]
    needed = PARAPHRASE if len(answer) else ALONE
    share = common_words(passage.tolist(), segment.tolist()) / len(passage)
    if share >= needed:
        total = float(items.weight[passage].sum())
        share = min(share, common_weight(passage, segment, items.weight) / total if total else 0.0)
    there = 0.0
    if len(answer):
        known = np.isin(answer, segment) | (np.isin(answer, whole) if items.several[j] else False)
        there = float(items.weight[answer[known]].sum() / max(float(items.weight[answer].sum()), 1e-12))
    return share >= (VERBATIM if len(answer) else ALONE) or share >= needed and there >= ANSWER, share, there


def _search(shared):
    """Cosine search in the latent space, then the check by subsequence and answer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, vectors, latent = shared.value
        for batch in batches:
            found = []
            columns = {n: batch.column(n).to_pylist() for n in batch.schema.names}
            length = np.asarray(batch.column("length"))
            for a in range(0, batch.num_rows, 500):
                pairs = zip(columns["features"][a:a + 500], columns["weights"][a:a + 500])
                rows = np.stack([np.frombuffer(w, "<f4") @ vectors[np.frombuffer(f, "<i4")] for f, w in pairs])
                cosines = rows @ latent.T
                near = cosines >= MIN_COSINE * items.norms[None, :] / np.maximum(length[a:a + 500, None], 1e-9)
                for i, j in zip(*(x.tolist() for x in np.nonzero(near))):
                    segment, whole = (np.frombuffer(columns[n][a + i], "<i4").astype(np.int64) for n in ("segment", "whole"))
                    leak, share, there = judged(items, j, segment, whole)
                    if leak:
                        found.append((columns["doc_id"][a + i], columns["tie"][a + i], items.ids[j], float(cosines[i, j]), share, there))
            if found:
                types = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*found), types)],
                                      names=["doc_id", "tie", "item_id", "cosine", "lcs_share", "answer_share"])

    return run


def leaks(df: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
          item_text: str = "text", block_items: int | None = None) -> DataFrame:
    """Pairs of document and item: doc_id, tie (hash of the text), item_id, cosine, lcs_share, answer_share (largest of each)."""
    spark = df.sparkSession
    rows = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.xxhash64(F.col(f"`{text}`")).alias("tie"),
                     F.col(f"`{text}`").cast("string").alias("text"))
    counted = settle(rows.select("text").mapInArrow(tidy(_frequencies), "part int, shard int, counts binary"))
    weights = Weights(_levels(counted), df.count())
    asked = benchmark.select(F.col(f"`{item_id}`").cast("long").alias("item_id"), F.col(f"`{item_text}`").cast("string").alias("text"))
    schema = "doc_id long, tie long, item_id long, cosine double, lcs_share double, answer_share double"

    def search(blocks: list[Items]) -> list[DataFrame]:
        """One pass over the texts, then a space of its own for each block."""
        held = settle(rows.mapInArrow(tidy(_candidate_rows(spark.sparkContext.broadcast(blocks))), _ROW))
        found = []
        for number, items in enumerate(blocks):
            own = held.where(F.col("block") == number)
            vectors = singular_vectors(own, items.matrix)
            shared = spark.sparkContext.broadcast((items, vectors, items.matrix @ vectors))
            found.append(settle(own.mapInArrow(tidy(_search(shared)), schema), 8))
        return found

    found, blocks, block = [], [], []
    for row in asked.where("text IS NOT NULL").orderBy("item_id", "text").coalesce(4).toLocalIterator():
        for passage in item_passages(row["item_id"], row["text"]):
            block.append(passage)
            if len(block) == (block_items or BLOCK_ITEMS):
                blocks.append(read_items(block, weights))
                block = []
            if len(blocks) == PASS_BLOCKS:
                found += search(blocks)
                blocks = []
    blocks += [read_items(block, weights)] if block else []
    found += search(blocks) if blocks else []
    if not found:
        return spark.createDataFrame([], schema)
    pairs = reduce(DataFrame.union, found)
    return pairs.groupBy("doc_id", "tie", "item_id").agg(*[F.max(c).alias(c) for c in ("cosine", "lcs_share", "answer_share")])


def clean(df: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **names: str) -> DataFrame:
    """The rows that hold no item of the benchmark, with all their columns."""
    hit = leaks(df, benchmark, doc_id, text, **names).select(F.col("doc_id").alias("_id"), F.col("tie").alias("_tie")).distinct()
    own = F.col(f"`{doc_id}`").cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(F.col(f"`{text}`")) == F.col("_tie"))
    return df.join(hit, own, "left_anti")
