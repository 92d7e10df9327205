"""Phrase collocations: phrases that occur far more often than their parts would by chance, counted in HAT-tries.

Words lie in pieces of a text, cut at punctuation and line ends. For every place the path of up to ``longest`` words is
added to its language's trie: nodes near the root branch by word id, below them lie hash containers of the remaining ids,
and a container of too many entries bursts into a node over smaller ones. When a task's tries hold too much, their
heaviest subtrees are spilled whole as sorted runs into the shuffle, which deals them by prefix; there the runs of a
prefix are merged in order, and a prefix's count is the sum of the paths below it. Prefixes of two words may lie in
several partitions (paths are dealt by their first three words) and single words come from each task: those sums meet by
equality, after partial sums in every task.

A phrase can only be frequent if all pairs and triples in it are. A first pass counts pairs and triples into sketches of a
fixed size (each task's counters stop at the threshold; tasks' counters add up), and paths end where the sketch rules the
next word out. A sketch never counts too little, so counts of frequent phrases are exact at every size; a crowded sketch
only leaves more paths to count. The driver holds and broadcasts two bits maps of ``1 << bits`` bits.

* A null language is ``und``; null and empty texts have no words. Texts are counted whole, in blocks of rows.
* Repeated rows count each for itself; ties are settled by score, count and phrase. An empty table gives an empty result.
* Other columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from adwatch.llm.common import settle
from adwatch.operators.skew import lookup_join, spread_join

LONGEST, LEAST = 5, 100
#: Parts of a sketch when sketches are added up.
PARTS = 32

#: Piece ends become 0xFF, a byte of no UTF-8 text; A-Z become small; tabs become spaces.
_ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
_BYTES = bytes.maketrans(bytes(range(65, 91)) + b"\t" + _ENDS, bytes(range(97, 123)) + b" " + b"\xff" * len(_ENDS))
_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Limits:
    """What a task holds at most; results do not depend on it."""

    #: Counters of a sketch, as a power of two.
    bits: int = 23
    #: Entries of a container before it bursts, and of a task's tries before subtrees are spilled; words before all is.
    burst: int = 4_096
    held: int = 400_000
    known: int = 400_000
    #: Characters of texts counted together.
    block: int = 4 << 20


class Words(dict):
    """Numbers of one language's words in a task, from 1; 0 is the end of a piece. ``hashes`` are alike in all tasks."""

    def __init__(self, lang: str):
        super().__init__({b"\xff": 0})
        self.lang, self.listed, self.hashes = lang.encode() + b"\xff", [b"\xff"], [0]

    def __missing__(self, word: bytes) -> int:
        import xxhash

        self[word] = number = len(self.listed)
        self.listed.append(word)
        self.hashes.append(xxhash.xxh3_64_intdigest(self.lang + word))
        return number

    def numbers(self, texts: list[str]) -> np.ndarray:
        """All words of the texts in order, 0 after each piece."""
        data = b"\xff".join([t.encode().translate(_BYTES) for t in texts] + [b""])
        found = data.replace(b"\xff", b" \xff ").split()
        return np.fromiter(map(self.__getitem__, found), np.int64, len(found))


def _slots(numbers: np.ndarray, words: Words, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Sketch counters of the pair and of the triple at every place; -1 where a piece ends within."""
    hashes, n = np.array(words.hashes, np.uint64)[numbers], len(numbers)
    shift, inside = np.uint64(64 - bits), numbers > 0
    with np.errstate(over="ignore"):
        pair = hashes[:-1] * _MIX
        pair = (pair ^ (pair >> np.uint64(29))) + hashes[1:]
        triple = pair[:-1] * _MIX
        triple = (triple ^ (triple >> np.uint64(29))) + hashes[2:]
        spread = lambda h: (((h ^ (h >> np.uint64(32))) * _MIX) >> shift).astype(np.int64)
        two, three = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        two[:max(0, n - 1)] = np.where(inside[:-1] & inside[1:], spread(pair), -1)
        three[:max(0, n - 2)] = np.where(inside[:-2] & inside[1:-1] & inside[2:], spread(triple), -1)
    return two, three


def _blocks(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[tuple[str, list[str]]]:
    """Texts of one language, ``block`` characters or one long text at a time."""
    held: dict[str, list[str]] = {}
    sizes: Counter = Counter()
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if text:
                held.setdefault(lang, []).append(text)
                sizes[lang] += len(text)
                if sizes[lang] >= block:
                    yield lang, held.pop(lang)
                    del sizes[lang]
        if sum(sizes.values()) >= 4 * block:  # many languages
            yield from held.items()
            held, sizes = {}, Counter()
    yield from held.items()


def _sketch(least: int, limits: Limits):
    """A task's counters of pairs and triples, up to ``least``, by part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros(1 << limits.bits, np.uint16) for _ in range(2)]
        known: dict[str, Words] = {}
        any_rows = False
        for lang, texts in _blocks(batches, limits.block):
            any_rows = True
            if sum(map(len, known.values())) > limits.known:
                known.clear()
            words = known.setdefault(lang, Words(lang))
            for own, slots in zip(counts, _slots(words.numbers(texts), words, limits.bits)):
                slots = slots[slots >= 0]
                for a in range(0, len(slots), 60_000):  # no counter can pass 65,535
                    part = slots[a:a + 60_000]
                    np.add.at(own, part, np.uint16(1))
                    own[part] = np.minimum(own[part], least)
        if any_rows:
            size = (1 << limits.bits) // PARTS
            for kind, own in enumerate(counts):
                packed = [zlib.compress(own[a:a + size].tobytes(), 1) for a in range(0, 1 << limits.bits, size)]
                yield pa.record_batch([pa.array([kind * PARTS + i for i in range(PARTS)], pa.int32()), pa.array(packed, pa.binary())],
                                      names=["part", "counts"])

    return run


def _added(least: int):
    """Parts of all tasks added up, as bits of the counters that reached ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = np.frombuffer(zlib.decompress(packed.as_py()), np.uint16)
                sums[part] = np.minimum(sums[part] + own, least) if part in sums else own
        for part, own in sums.items():
            yield pa.record_batch([pa.array([part], pa.int32()), pa.array([np.packbits(own >= least).tobytes()], pa.binary())], names=["part", "bits"])

    return run


def _bit_maps(texts: DataFrame, least: int, limits: Limits) -> list[np.ndarray]:
    parts = texts.mapInArrow(_sketch(least, limits), "part int, counts binary").repartition(2 * PARTS, "part").mapInArrow(_added(least), "part int, bits binary")
    size = (1 << limits.bits) // PARTS // 8
    maps = [np.zeros((1 << limits.bits) // 8, np.uint8) for _ in range(2)]
    for row in parts.toLocalIterator():  # 2 * PARTS rows of a fixed size
        kind, i = divmod(row["part"], PARTS)
        maps[kind][i * size:(i + 1) * size] = np.frombuffer(bytes(row["bits"]), np.uint8)
    return maps


class Node(dict):
    """Children by word id (four bytes): containers or nodes; ``ends`` counts the paths that end here."""

    ends = 0


class Trie:
    """Counts of paths of word ids, four bytes a word."""

    def __init__(self, burst: int = Limits.burst):
        self.root, self.size, self.burst = Node(), 0, burst

    def add(self, path: bytes, count: int) -> None:
        node, at = self.root, 4
        while True:
            word = path[at - 4:at]
            below = node.get(word)
            if below is None:
                below = node[word] = {}
            if type(below) is Node:
                if at == len(path):
                    self.size += not below.ends
                    below.ends += count
                    return
                node, at = below, at + 4
                continue
            rest = path[at:]
            if rest in below:
                below[rest] += count
            else:
                below[rest] = count
                self.size += 1
                if len(below) > self.burst:
                    node[word] = self._split(below)
            return

    @staticmethod
    def _split(container: dict) -> Node:
        node = Node()
        for rest, count in container.items():
            if rest:
                node.setdefault(rest[:4], {})[rest[4:]] = count
            else:
                node.ends = count
        return node

    def subtrees(self) -> list[tuple[int, bytes]]:
        """Entries below every first word, heaviest first."""
        def weight(below) -> int:
            return sum(map(weight, below.values())) + 1 if type(below) is Node else len(below)

        return sorted(((weight(b), w) for w, b in self.root.items()), reverse=True)

    def take(self, word: bytes) -> list[tuple[bytes, int]]:
        """Cut a subtree off: its paths and their counts."""
        found: list[tuple[bytes, int]] = []

        def walk(path: bytes, below) -> None:
            if type(below) is Node:
                if below.ends:
                    found.append((path, below.ends))
                for w, b in below.items():
                    walk(path + w, b)
            else:
                found.extend((path + rest, count) for rest, count in below.items())

        walk(word, self.root.pop(word))
        self.size -= len(found)
        return found


def _lengths(two: np.ndarray, three: np.ndarray, maps: list[np.ndarray], longest: int) -> np.ndarray:
    """Words of the path at every place: as far as all pairs and triples may be frequent."""
    def marked(slots, bits):
        at = np.maximum(slots, 0)
        return (slots >= 0) & ((bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1)

    pairs, triples, n = marked(two, maps[0]), marked(three, maps[1]), len(two)
    length = np.ones(n, np.int64)
    going = pairs
    length += going
    for k in range(3, longest + 1):
        going = going & np.r_[triples[k - 3:], np.zeros(min(n, k - 3), bool)] & np.r_[pairs[k - 2:], np.zeros(min(n, k - 2), bool)]
        length += going
    return length


def _counted(shared, longest: int, limits: Limits):
    """Sorted runs of paths (lang, phrase with a space after each word, words, part, n), and the counts of single words."""
    names = ["lang", "phrase", "words", "part", "n"]

    def table(lang: str, rows: list[tuple[bytes, int, int, int]]) -> pa.RecordBatch:
        phrase, words, part, n = zip(*rows)
        return pa.record_batch([pa.array([lang] * len(rows)), pa.array(phrase, pa.binary()), pa.array(words, pa.int32()), pa.array(part, pa.int32()),
                                pa.array(n, pa.int64())], names=names)

    class Held:
        def __init__(self, lang: str):
            self.lang, self.words, self.trie, self.single = lang, Words(lang), Trie(limits.burst), np.zeros(1, np.int64)

        def add(self, texts: list[str], maps) -> None:
            numbers = self.words.numbers(texts)
            self.single = np.pad(self.single, (0, len(self.words.listed) - len(self.single)))
            self.single += np.bincount(numbers, minlength=len(self.single))
            length = _lengths(*_slots(numbers, self.words, limits.bits), maps, longest)
            at = np.flatnonzero(length > 1)
            raw = numbers.astype("<u4").tobytes()
            add = self.trie.add
            for path, count in Counter([raw[a:b] for a, b in zip((4 * at).tolist(), (4 * (at + length[at])).tolist())]).items():
                add(path, count)

        def spill(self, kept: int) -> Iterator[pa.RecordBatch]:
            for _, word in self.trie.subtrees():
                if self.trie.size <= kept:
                    break
                yield self.run(self.trie.take(word))

        def run(self, found: list[tuple[bytes, int]]) -> pa.RecordBatch:
            listed, rows = self.words.listed, []
            for path, count in found:
                ids = np.frombuffer(path, "<u4").tolist()
                words = [listed[i] for i in ids]
                head = b" ".join(words[:3])
                rows.append((b" ".join(words) + b" ", len(ids), zlib.crc32(head) & 0x7FFFFFFF, count))
            rows.sort()
            return table(self.lang, rows)

        def close(self) -> Iterator[pa.RecordBatch]:
            for _, word in self.trie.subtrees():
                yield self.run(self.trie.take(word))
            rows = [(w, 1, -1, n) for w, n in zip(self.words.listed[1:], self.single[1:].tolist())]
            for a in range(0, len(rows), 50_000):
                yield table(self.lang, rows[a:a + 50_000])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps = [np.frombuffer(zlib.decompress(m), np.uint8) for m in shared.value]
        held: dict[str, Held] = {}
        for lang, texts in _blocks(batches, limits.block):
            own = held.setdefault(lang, Held(lang))
            own.add(texts, maps)
            if sum(len(h.words) for h in held.values()) > limits.known:
                for h in held.values():
                    yield from h.close()
                held.clear()
            elif (total := sum(h.trie.size for h in held.values())) > limits.held:
                for h in held.values():
                    yield from h.spill(h.trie.size * limits.held // (2 * total))
        for h in held.values():
            yield from h.close()

    return run


def _merged(least: int):
    """Prefix sums of sorted paths: every prefix of two words, and longer ones that reach ``least``."""
    names = ["lang", "phrase", "words", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lang, path, sums, out = None, [], [], []

        def close(depth: int) -> None:
            while len(path) > depth:
                n = sums.pop()
                if len(path) == 2 or len(path) > 2 and n >= least:
                    out.append((lang, b" ".join(path), len(path), n))
                path.pop()
                if sums:
                    sums[-1] += n

        def flushed() -> pa.RecordBatch:
            batch = pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.binary(), pa.int32(), pa.int64()))], names=names)
            out.clear()
            return batch

        for batch in batches:
            for own, phrase, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                words = phrase[:-1].split(b" ")
                if own != lang:
                    close(0)
                    lang = own
                common = 0
                for a, b in zip(path, words):
                    if a != b:
                        break
                    common += 1
                close(common)
                for w in words[common:]:
                    path.append(w)
                    sums.append(0)
                sums[-1] += n
            if len(out) > 20_000:
                yield flushed()
        close(0)
        if out:
            yield flushed()

    return run


def counts(df: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST, least: int = LEAST,
           limits: Limits = Limits()) -> tuple[DataFrame, DataFrame]:
    """All phrases of one to ``longest`` words with at least ``least`` occurrences (lang, phrase, words, n), and lang, total.

    ``total`` counts all word occurrences of the language. Both tables are written once.
    """
    texts = df.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text}`").cast("string").alias("text"))
    shared = df.sparkSession.sparkContext.broadcast([zlib.compress(m.tobytes(), 1) for m in _bit_maps(texts, least, limits)])
    runs = settle(texts.mapInArrow(_counted(shared, longest, limits), "lang string, phrase binary, words int, part int, n long"))
    single = runs.where("words = 1").select("lang", "phrase", "words", "n")
    merged = (runs.where("words > 1").repartition("lang", "part").sortWithinPartitions("lang", "phrase").select("lang", "phrase", "n")
              .mapInArrow(_merged(least), "lang string, phrase binary, words int, n long"))
    frequent = single.unionAll(merged).groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    totals = single.groupBy("lang").agg(F.sum("n").alias("total"))
    return settle(frequent.withColumn("phrase", F.col("phrase").cast("string"))), settle(totals, 1)


def collocations(df: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST, least: int = LEAST, top: int = 2000,
                 limits: Limits = Limits()) -> DataFrame:
    """The first ``top`` phrases of every language by score: lang, rank, phrase, a, l, r, n, score.

    ``a`` counts the phrase, ``l`` and ``r`` the two parts of its weakest cut, ``n`` all words of the language; the score is
    ``floor(1000 * a * n / (l * r))``. A phrase that only occurs inside one longer phrase is left out: since counts never
    rise with length, it is enough to look at phrases longer by one word.
    """
    frequent, totals = counts(df, text, lang, longest, least, limits)
    words = F.split("phrase", " ")
    part = lambda a, n: F.array_join(F.slice(words, a, n), " ")
    phrases = frequent.where("words > 1")
    longer = frequent.where("words > 2").withColumn("phrase", F.explode(F.array(part(F.lit(1), F.col("words") - 1), part(F.lit(2), F.col("words") - 1))))
    own = phrases.join(longer.select("lang", "phrase", "n"), ["lang", "phrase", "n"], "left_anti").withColumnRenamed("n", "a")
    cuts = own.select("lang", "phrase", "words", "a", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", part(F.lit(1), F.col("cut")).alias("first"),
                       part(F.col("cut") + 1, F.col("words") - F.col("cut")).alias("rest"))
    side = lambda name, out: frequent.select("lang", F.col("phrase").alias(name), F.col("n").alias(out))
    cuts = spread_join(cuts, side("first", "l"), ["lang", "first"], least_rows=10_000)
    cuts = spread_join(cuts, side("rest", "r"), ["lang", "rest"], least_rows=10_000)
    cuts = lookup_join(cuts, totals, ["lang"])
    big = lambda c: F.col(c).cast("decimal(14,0)")
    exact = cuts.withColumn("over", big("a") * big("total") * F.lit(1000).cast("decimal(4,0)")).withColumn("under", big("l") * big("r"))
    scored = exact.withColumn("score", F.expr("over div under"))
    weakest = scored.groupBy("lang", "phrase", "a", F.col("total").alias("n")).agg(F.min(F.struct("score", "cut", "l", "r")).alias("w"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("long")
    flat = weakest.select("lang", "phrase", "a", "w.l", "w.r", "n", "w.score")
    return flat.withColumn("rank", rank).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
