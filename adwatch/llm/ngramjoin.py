"""Jaccard join of word n-gram sets: subsets for small sets, inverted lists for large ones, the boundary by cost.

Texts become sets of hashed n-grams (64 bits); equal sets are one node. Two sets of sizes s and t that link must share
o(s, t) elements. Small sets list all subsets of the sizes o(s, t) that a partner can ask for; sets that link have one of
them in common. Large sets enter the inverted lists of their rarest elements, as many as a link can't avoid. Rarity comes
from a count sketch of fixed size over all texts; it orders elements and so decides cost, never the result. The boundary is
the size up to which subsets are fewer than what the lists would cost, from the histogram of sizes; sets just below it
enter the lists too, so that small and large ones meet.

Every set has a parity sketch, one bit flipped per element; the bits in which two sketches differ are a lower bound of the
elements in which the sets differ, so pairs beyond what a link allows are left out for certain before a text moves. A list
of up to ``LIST_ALL`` nodes proposes all its pairs. A longer one proposes its first node with each other one and neighbours
in order of size; when those links are joined to components, only nodes of different components are compared further: each
proposes the few that its sketch is nearest to, then more, until a list is one component or every possible link between
components has been verified. So a group of thousands of near copies proposes a few pairs a node, and no link that joins
two components is lost. Every proposal is verified on whole sets.

* Null texts, empty ones and those without words have an empty set and link with nothing. Rows without an id can link, and
  have the smallest id they reach, or null. Repeated rows are equal sets. An empty table gives an empty result. Of other
  columns nothing is returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from adwatch.llm.common import settle, tidy
from adwatch.llm.components import components

#: Bins of the count sketch, and of one of the parts in which it travels.
SKETCH_BINS, PART_BINS = 1 << 22, 1 << 16
#: Bits of a parity sketch.
BITS = 1024
#: Lists up to this length propose all their pairs.
LIST_ALL = 32
#: Largest set for which subsets are thought of at all.
SMALLEST_LARGE = 24
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F,
                 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def overlap(s: int, t: int, percent: int) -> int:
    """Elements that sets of these sizes must share to link."""
    return -(-percent * (s + t) // (100 + percent))


def least(s: int, percent: int) -> int:
    """Elements that a set of this size must share with any partner."""
    return -(-percent * s // 100)


def shingle_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of every text; A to Z count as lower case."""
    import xxhash

    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), "")))
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    coded = lists.flatten().dictionary_encode()
    hashed = np.fromiter((xxhash.xxh3_64_intdigest(w) if w else 0 for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    filled = np.asarray(pc.binary_length(coded.dictionary)) > 0
    places, ends = np.asarray(coded.indices), np.asarray(lists.offsets)
    found = []
    with np.errstate(over="ignore"):
        for a, b in zip(ends[:-1], ends[1:]):
            own = places[a:b]
            own = hashed[own[filled[own]]] if b > a else np.empty(0, np.uint64)
            if not len(own):
                found.append(np.empty(0, np.uint64))
                continue
            n = min(words, len(own))
            mixed = np.full(len(own) - n + 1, np.uint64(n))
            for i in range(n):
                mixed += (own[i:len(own) - n + 1 + i] ^ (own[i:len(own) - n + 1 + i] >> np.uint64(29))) * _ODD[i]
            mixed = (mixed ^ (mixed >> np.uint64(31))) * _ODD[0]
            found.append(np.unique(mixed ^ (mixed >> np.uint64(29))))
    return found


def _digest(values: np.ndarray) -> tuple[int, int]:
    import xxhash

    whole = xxhash.xxh3_128_intdigest(values.tobytes())
    return (whole >> 64) - (1 << 63), (whole & (1 << 64) - 1) - (1 << 63)


def _parity(values: np.ndarray) -> bytes:
    """Which bins of ``BITS`` an odd number of elements falls into."""
    odd = np.bincount((values >> np.uint64(22)).astype(np.int64) & (BITS - 1), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _measure(words: int):
    """Per row: size and digest of its set; per task: its part of the count sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        counts, any_rows = np.zeros(SKETCH_BINS, np.int64), False
        names = ["doc_id", "tie", "n", "hi", "lo", "bits", "part", "shard", "counts"]
        types = [pa.int64()] * 5 + [pa.binary(), pa.int32(), pa.int32(), pa.binary()]
        for batch in batches:
            if not batch.num_rows:
                continue
            any_rows, sets = True, shingle_sets(batch.column(2), words)
            digests = [_digest(s) for s in sets]
            bins = np.concatenate(sets) & np.uint64(SKETCH_BINS - 1)
            np.add.at(counts, bins.astype(np.int64), 1)
            n = batch.num_rows
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()),
                                   pa.array([d[0] for d in digests], pa.int64()), pa.array([d[1] for d in digests], pa.int64()),
                                   pa.array([_parity(s) for s in sets], pa.binary()), *[pa.nulls(n, t) for t in types[6:]]], names=names)
        if any_rows:
            pack, parts = zstandard.ZstdCompressor(level=1), SKETCH_BINS // PART_BINS
            shard = TaskContext.get().partitionId() % 256
            packed = [pack.compress(counts[p * PART_BINS:(p + 1) * PART_BINS].tobytes()) for p in range(parts)]
            yield pa.record_batch([*[pa.nulls(parts, t) for t in types[:6]], pa.array(range(parts), pa.int32()),
                                   pa.array([shard] * parts, pa.int32()), pa.array(packed, pa.binary())], names=names)

    return run


def _summed(key_names: tuple[str, ...]):
    def run(rows: pa.Table) -> pa.Table:
        import zstandard

        unpack, total = zstandard.ZstdDecompressor(), np.zeros(PART_BINS, np.int64)
        for data in rows.column("counts"):
            total += np.frombuffer(unpack.decompress(data.as_py()), np.int64)
        packed = zstandard.ZstdCompressor(level=1).compress(total.tobytes())
        return pa.table({**{k: rows.column(k).slice(0, 1) for k in key_names}, "counts": pa.array([packed], pa.binary())})

    return run


def _levels(parts: DataFrame) -> np.ndarray:
    """The sketch as one byte a bin, quarter steps of the logarithm of the count: 4 MB whatever the data."""
    import zstandard

    by_shard = parts.groupBy("part", "shard").applyInArrow(_summed(("part", "shard")), "part int, shard int, counts binary")
    whole = by_shard.groupBy("part").applyInArrow(_summed(("part",)), "part int, counts binary")
    unpack, levels = zstandard.ZstdDecompressor(), np.zeros(SKETCH_BINS, np.uint8)
    for row in whole.collect():  # SKETCH_BINS / PART_BINS rows
        counts = np.frombuffer(unpack.decompress(bytes(row["counts"])), np.int64)
        levels[row["part"] * PART_BINS:(row["part"] + 1) * PART_BINS] = np.minimum(255, np.round(4 * np.log2(1.0 + counts)))
    return levels


def _mean_list(levels: np.ndarray) -> float:
    """Sets that share an element with one, on average over elements, beyond what meets in a bin by chance."""
    counts = 2.0 ** (levels / 4) - 1
    total = counts.sum()
    return max(0.0, float((counts ** 2).sum() / total - total / len(counts) - 1)) if total else 0.0


def subset_sizes(s: int, percent: int) -> list[int]:
    """Sizes of the subsets that a set of size s lists: what it must share with each possible partner size."""
    return sorted({overlap(s, t, percent) for t in range(least(s, percent), 100 * s // percent + 1)})


def boundary(histogram: dict[int, int], mean_list: float, percent: int) -> int:
    """The largest size whose sets list subsets: where these and the lists of all larger sets cost least.

    A subset costs one row; an element of a prefix costs one row and a comparison with ``mean_list`` others.
    """
    small = {s: n * sum(comb(s, c) for c in subset_sizes(s, percent)) for s, n in histogram.items() if 0 < s <= SMALLEST_LARGE}
    large = {s: n * (s - least(s, percent) + 1) * (1 + mean_list) for s, n in histogram.items() if s > 0}
    cost = lambda x: sum(c for s, c in small.items() if s <= x) + sum(c for s, c in large.items() if s > x)
    return min(range(SMALLEST_LARGE + 1), key=lambda x: (cost(x), -x))


def _postings(words: int, percent: int, small: int, levels):
    """Keys under which a set can meet its partners, once per set and task."""

    def keys(values: np.ndarray) -> np.ndarray:
        import xxhash

        s, found = len(values), []
        if s <= small:
            for c in subset_sizes(s, percent):
                found += [xxhash.xxh3_64_intdigest(values[list(pick)].tobytes(), seed=c) for pick in combinations(range(s), c)]
        if s > small or s >= least(small + 1, percent):
            order = np.lexsort((values, levels.value[(values & np.uint64(SKETCH_BINS - 1)).astype(np.int64)]))
            found += values[order[:s - least(s, percent) + 1]].tolist()
        return np.array(found, np.uint64).view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            listed, nodes, sizes = [], [], []
            for values in shingle_sets(batch.column(0), words):
                node = _digest(values)[1] if len(values) else 0
                if not len(values) or node in seen:
                    continue
                seen.add(node)
                own = keys(values)
                listed.append(own)
                nodes.append(np.full(len(own), node, np.int64))
                sizes.append(np.full(len(own), len(values), np.int32))
            if listed:
                yield pa.record_batch([pa.array(np.concatenate(x)) for x in (listed, nodes, sizes)], names=["key", "node", "size"])

    return run


def _proposals(percent: int):
    """From postings in order of key, size and node: pairs to verify, and the members of long lists with their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, count, pivot, last = None, [], 0, None, None
        out: list[tuple] = []

        def member(node: int, size: int) -> None:
            nonlocal count, pivot, last
            if last is not None and last[0] == node:
                return  # the same set from another task
            count += 1
            if count <= LIST_ALL:
                out.extend((m, node, None, None, None) for m, t in held if 100 * t >= percent * size)
                held.append((node, size))
                pivot = pivot or (node, size)
            else:
                if count == LIST_ALL + 1:
                    out.extend((None, m, key, i, t) for i, (m, t) in enumerate(held))
                out.append((None, node, key, count - 1, size))
                if 100 * pivot[1] < percent * size:
                    pivot = (node, size)
                else:
                    out.append((pivot[0], node, None, None, None))
                if last[0] != pivot[0] and 100 * last[1] >= percent * size:
                    out.append((last[0], node, None, None, None))
            last = (node, size)

        for batch in batches:
            keys, nodes, sizes = (np.asarray(batch.column(i)) for i in range(3))
            if not len(keys):
                continue
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            ends = np.r_[starts[1:], len(keys)]
            for a, b in zip(starts.tolist(), ends.tolist()):
                if key is None or keys[a] != key:
                    key, held, count, pivot, last = int(keys[a]), [], 0, None, None
                for i in range(a, b):
                    member(int(nodes[i]), int(sizes[i]))
                if len(out) >= 20_000:
                    yield _pairs(out)
                    out = []
        if out:
            yield _pairs(out)

    return run


def _pairs(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["a", "b", "key", "place", "size"])


def _possible(percent: int):
    """Of pairs with sizes and sketches, those that may link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            one, two = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint64).reshape(-1, BITS // 64) for i in (4, 5))
            differ = np.bitwise_count(one ^ two).sum(1, dtype=np.int64)
            total = np.asarray(batch.column(2)) + np.asarray(batch.column(3))
            kept = batch.filter(pa.array(differ * (100 + percent) <= (100 - percent) * total))
            yield pa.record_batch([kept.column(0), kept.column(1)], names=["a", "b"])

    return run


def _further(percent: int, most: int):
    """From lists whose rows stand together: for every node its ``most`` nearest possible partners in other components.

    A list's nodes are held with 160 bytes each. A row without nodes says that some node has more partners than ``most``.
    """

    def one_list(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(rows)
        node, size, root = (held.column(i).to_numpy() for i in (1, 2, 3))
        bits = np.frombuffer(b"".join(held.column(4).to_pylist()), np.uint64).reshape(-1, BITS // 64)
        n, found, cut = len(node), [], False
        step = max(1, (1 << 20) // (n * (BITS // 64)))
        _, where, times = np.unique(root, return_inverse=True, return_counts=True)
        # every pair of components has a side outside the largest one, which asks
        asking = np.flatnonzero(where != times.argmax())
        for a in range(0, len(asking), step):
            own = asking[a:a + step]
            differ = np.bitwise_count(bits[own][:, None, :] ^ bits[None, :, :]).sum(2, dtype=np.int64)
            small, large = np.minimum(size[own][:, None], size[None, :]), np.maximum(size[own][:, None], size[None, :])
            fits = (differ * (100 + percent) <= (100 - percent) * (small + large)) & (root[own][:, None] != root[None, :]) & (100 * small >= percent * large)
            for i, row in zip(own.tolist(), range(len(own))):
                partners = np.flatnonzero(fits[row])
                if len(partners) > most:
                    cut = True
                    partners = partners[np.lexsort((node[partners], differ[row][partners]))[:most]]
                found += [(min(node[i], node[j]), max(node[i], node[j])) for j in partners.tolist()]
                if len(found) >= 20_000:
                    yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*found)], names=["a", "b"])
                    found = []
        if cut:
            found.append((None, None))
        if found:
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*found)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            keys = np.asarray(batch.column(0))
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else []
            for a, b in zip(starts, np.r_[starts[1:], len(keys)] if len(keys) else []):
                if held and keys[a] != key:
                    yield from one_list(held)
                    held = []
                key = keys[a]
                held.append(batch.slice(int(a), int(b - a)))
        if held:
            yield from one_list(held)

    return run


def _verify(words: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        known: dict[bytes, np.ndarray] = {}

        def of(data: bytes) -> np.ndarray:
            if data not in known:
                if len(known) >= 64:
                    known.clear()
                known[data] = shingle_sets(pa.array([unpack.decompress(data).decode("utf-8", "surrogatepass")]), words)[0]
            return known[data]

        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                one, two = of(x), of(y)
                shared = len(np.intersect1d(one, two, assume_unique=True))
                keep.append(100 * shared >= percent * (len(one) + len(two) - shared))
            chosen = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.record_batch([chosen.column(0), chosen.column(1)], names=["a", "b"])

    return run


def _packed_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    pack = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        data = [pack.compress((t or "").encode("utf-8", "surrogatepass")) for t in batch.column(2).to_pylist()]
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(data, pa.binary())], names=["doc_id", "tie", "data"])


def link(df: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """Per row: doc_id, n_shingles and component_id, the smallest id that links reach.

    Two sets link when 100 times their intersection is at least ``percent`` times their union.
    """
    spark = df.sparkSession
    rows = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.xxhash64(F.col(f"`{text}`")).alias("tie"),
                     F.col(f"`{text}`").cast("string").alias("text"))
    measured = settle(rows.mapInArrow(
        tidy(_measure(words)), "doc_id long, tie long, n long, hi long, lo long, bits binary, part int, shard int, counts binary"))
    ids = measured.where("n IS NOT NULL").select("doc_id", "tie", "n", "hi", "lo", "bits")
    levels = _levels(measured.where("part IS NOT NULL").select("part", "shard", "counts"))
    shared = spark.sparkContext.broadcast(levels)
    sizes = ids.where("n > 0").groupBy(F.least("n", F.lit(1000)).cast("int").alias("s")).count().collect()  # at most 1,000 rows
    small = boundary({r["s"]: r["count"] for r in sizes}, _mean_list(levels), percent)
    postings = rows.select("text").mapInArrow(tidy(_postings(words, percent, small, shared)), "key long, node long, size int")
    lists = postings.repartition("key").sortWithinPartitions("key", "size", "node")
    proposed = settle(lists.mapInArrow(tidy(_proposals(percent)), "a long, b long, key long, place long, size int"))
    long = proposed.where("key IS NOT NULL").select("key", F.col("b").alias("node"), F.col("size").cast("long").alias("size"))

    classes = ids.where("n > 0").groupBy("hi", "lo").agg(
        F.min("doc_id").alias("first"), F.min(F.struct("doc_id", "tie")).alias("rep"), F.count(F.lit(1)).alias("n_rows"))
    sketches = ids.where("n > 0").groupBy("lo").agg(F.first("n").alias("n"), F.first("bits").alias("bits"))
    ends = [sketches.select(F.col("lo").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"bits{x}")) for x in ("a", "b")]
    pairs = proposed.where("a IS NOT NULL").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    asked = settle(pairs.join(ends[0], "a").join(ends[1], "b").select("a", "b", "na", "nb", "bitsa", "bitsb")
                   .mapInArrow(tidy(_possible(percent)), "a long, b long"))
    open_nodes = asked.select("a").union(asked.select("b")).union(long.select("node")).distinct().withColumnRenamed("a", "lo")
    reps = classes.join(open_nodes, "lo").select("hi", "lo", F.col("rep.doc_id").alias("doc_id"), F.col("rep.tie").alias("tie"))
    packed = rows.select("doc_id", "tie", "text").mapInArrow(tidy(_packed_text), "doc_id long, tie long, data binary")
    texts = settle(reps.join(packed, reps["doc_id"].eqNullSafe(packed["doc_id"]) & (reps["tie"] == packed["tie"]))
                   .select("hi", "lo", "data").dropDuplicates(["hi", "lo"]))

    def verified(found: DataFrame) -> DataFrame:
        name = F.concat_ws(":", "hi", "lo")
        one = texts.select(F.col("lo").alias("a"), name.alias("na"), F.col("data").alias("da"))
        two = texts.select(F.col("lo").alias("b"), name.alias("nb"), F.col("data").alias("db"))
        both = found.join(one, "a").join(two, "b").select("na", "nb", "da", "db")
        return settle(both.mapInArrow(tidy(_verify(words, percent)), "a string, b string"))

    edges = verified(asked)
    reached = components(edges)
    most, tested, waiting = 2, asked, not long.isEmpty()
    sketched = settle(long.join(sketches.withColumnRenamed("lo", "node"), "node").select("key", "node", "size", "bits")) if waiting else None
    while waiting:
        # lists whose nodes are not yet of one component; a node that no link has reached is its own
        roots = reached.select(F.split_part("node", F.lit(":"), F.lit(2)).cast("long").alias("node"), F.xxhash64("root").alias("root"))
        marked = sketched.join(roots.dropDuplicates(["node"]), "node", "left").withColumn("root", F.coalesce("root", "node"))
        # the window deals whole lists: Spark may drop a repartition behind a join on the same key, and then deal parts of lists
        whole = Window.partitionBy("key")
        order = marked.withColumn("x", F.min("root").over(whole)).withColumn("y", F.max("root").over(whole)).where("x <> y")
        found = settle(order.select("key", "node", "size", "root", "bits").mapInArrow(tidy(_further(percent, most)), "a long, b long"))
        waiting = not found.where("a IS NULL").isEmpty()
        fresh = settle(found.where("a IS NOT NULL").distinct().join(tested, ["a", "b"], "left_anti"))
        if not fresh.isEmpty():
            edges, tested = edges.union(verified(fresh)), tested.union(fresh)
            reached = components(edges)
        most *= 8

    name = F.concat_ws(":", "hi", "lo")
    rooted = classes.withColumn("node", name).join(reached, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.sum("n_rows").alias("rows"))
    grouped = rooted.join(smallest.where("rows > 1"), "root").select("hi", "lo", "component_id")
    return ids.join(grouped, ["hi", "lo"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))
