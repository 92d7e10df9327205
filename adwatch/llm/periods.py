"""Periodic runs of words: suffix trees answer how far two places agree, Lyndon roots name the candidates.

A run is a stretch of consecutive words with smallest period ``q`` and at least ``max(shortest, 2 * q)`` words that no
neighbouring word extends. For a sequence and its reversal Ukkonen's algorithm builds a suffix tree; a tour over the tree
keeps, between neighbouring leaves, the depth of their lowest common ancestor, and a sparse table of range minima over the
tour gives the ancestor's depth of any two leaves in constant time: the number of words on which two places agree to the
right, and with the reversal's tree to the left. Every run holds the longest Lyndon word at some place under the order of
the words or its inverse. These words, one a place and order, are found from the leaves' order and extended both ways.

A run of period ``q`` repeats at least ``max(shortest - q, q)`` consecutive words at distance ``q``, thus a window of
``shortest // 2`` words twice in its text, and such windows cover all of it. Only stretches that such windows cover go into
trees, which is exact; a stretch is held by one task, at some hundred bytes a word.

* Null and empty texts have no words, no runs and an empty collapsed text. Long texts are taken whole.
* Repeated rows and rows with equal ids are judged each for itself; an empty table gives an empty result.
* Other columns are carried along; one that has the name of an output is replaced by it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adwatch.llm.common import with_outputs

#: Words of the shortest run.
SHORTEST = 12
RUN = "struct<start:long,length:long,period:long>"
#: Entries of a worker's table of words; beyond it the table starts afresh with the next batch.
KNOWN_WORDS = 300_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


class SuffixTree:
    """The suffix tree of a sequence of numbers above 0, closed by a mark of its own (0), built from left to right."""

    def __init__(self, values: list[int]):
        text = [*values, 0]
        self.size, self.base = len(text), max(text) + 2
        start, end, link, edge = [0], [0], [0], {}
        n, base = self.size, self.base
        node = first = length = waiting = 0
        for i, c in enumerate(text):
            waiting += 1
            last = 0
            while waiting:
                if not length:
                    first = i
                key = node * base + text[first]
                below = edge.get(key)
                if below is None:
                    edge[key] = len(start)
                    start.append(i)
                    end.append(n)
                    link.append(0)
                    if last:
                        link[last] = node
                        last = 0
                else:
                    at = start[below]
                    span = min(end[below], i + 1) - at
                    if length >= span:
                        first, length, node = first + span, length - span, below
                        continue
                    if text[at + length] == c:
                        if last and node:
                            link[last] = node
                        length += 1
                        break
                    split = len(start)
                    start += (at, i)
                    end += (at + length, n)
                    link += (0, 0)
                    edge[key] = split
                    edge[split * base + c] = split + 1
                    start[below] = at + length
                    edge[split * base + text[at + length]] = below
                    if last:
                        link[last] = split
                    last = split
                waiting -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    first = i - waiting + 1
        self.spans = np.array(end) - np.array(start)
        self.keys = np.fromiter(edge.keys(), np.int64, len(edge))
        self.nodes = np.fromiter(edge.values(), np.int64, len(edge))

    def tour(self, mark_last: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Suffixes in order of the leaves, and the depth of the lowest common ancestor of each leaf and the one before.

        With ``mark_last`` the closing mark counts as greater than all words.
        """
        above, symbol = np.divmod(self.keys, self.base)
        order = np.argsort(above * self.base + np.where(symbol == 0, self.base - 1, symbol) if mark_last else self.keys)
        kids, parents = self.nodes[order].tolist(), above[order]
        begin = np.searchsorted(parents, np.arange(len(self.spans) + 1)).tolist()
        spans, n = self.spans.tolist(), self.size
        leaves, depths, shared = [], [], 0
        stack = [(k, 0, k != kids[0]) for k in reversed(kids[begin[0]:begin[1]])]
        while stack:
            node, depth, next_one = stack.pop()
            if next_one:
                shared = depth
            depth += spans[node]
            a, b = begin[node], begin[node + 1]
            if a == b:
                leaves.append(n - depth)
                depths.append(shared)
            else:
                stack += [(kids[k], depth, k > a) for k in range(b - 1, a - 1, -1)]
        return np.array(leaves), np.array(depths)


class Agreement:
    """Length of the common beginning of any two suffixes, by minima over the tour."""

    def __init__(self, leaves: np.ndarray, depths: np.ndarray):
        self.rank = np.empty(len(leaves), np.int64)
        self.rank[leaves] = np.arange(len(leaves))
        self.levels = [depths.astype(np.int32)]
        while len(self.levels[-1]) > 1 << (len(self.levels) - 1):
            step, below = 1 << (len(self.levels) - 1), self.levels[-1]
            self.levels.append(np.minimum(below[:-step], below[step:]))

    def __call__(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        a, b = self.rank[one], self.rank[two]
        low, high = np.minimum(a, b) + 1, np.maximum(a, b)
        level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
        found = np.zeros(len(one), np.int64)
        for k in np.unique(level):
            at, table = level == k, self.levels[k]
            found[at] = np.minimum(table[low[at]], table[high[at] + 1 - (1 << k)])
        return found


def _next_smaller(rank: np.ndarray) -> np.ndarray:
    """The place of the first later suffix of smaller rank; the closing mark is one."""
    ranks, stack, found = rank.tolist(), [], np.empty(len(rank), np.int64)
    for j, r in enumerate(ranks):
        while stack and ranks[stack[-1]] > r:
            found[stack.pop()] = j
        stack.append(j)
    return found[:-1]


def runs(values: list[int], shortest: int = SHORTEST) -> list[tuple[int, int, int]]:
    """All runs of a sequence of numbers above 0 as (start, length, period), by start, then period."""
    n = len(values)
    if n < 2:
        return []
    tree = SuffixTree(values)
    leaves, depths = tree.tour()
    right = Agreement(leaves, depths)
    back, turned = tree.tour(mark_last=True)[0], np.empty(n + 1, np.int64)
    turned[back[::-1]] = np.arange(n + 1)  # the inverse order, where the mark comes first again
    left = Agreement(*SuffixTree(values[::-1]).tour())
    i = np.tile(np.arange(n), 2)
    j = np.concatenate([_next_smaller(right.rank), _next_smaller(turned)])
    period = j - i
    after = j + right(i, j)
    before = np.zeros(len(i), np.int64)
    inner = i > 0
    before[inner] = left(n - i[inner], n - j[inner])
    start = i - before
    kept = after - start >= np.maximum(2 * period, shortest)
    found = np.unique(np.stack([start[kept], period[kept], after[kept] - start[kept]], 1), axis=0)
    return [(s, length, p) for s, p, length in found.tolist()]


def _stretches(ids: np.ndarray, owner: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Maximal stretches of the batch that are covered by windows of words found twice in their text."""
    if len(ids) < window:
        return []
    with np.errstate(over="ignore"):
        words = (ids.astype(np.uint64) + np.uint64(1)) * _MIX
        words ^= words >> np.uint64(31)
        rolled, n = np.zeros(len(ids) - window + 1, np.uint64), len(ids) - window + 1
        for k in range(window):
            rolled = rolled * _MIX + words[k:k + n]
            rolled ^= rolled >> np.uint64(29)
        rolled = rolled + owner[:n].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    places = np.flatnonzero(owner[:n] == owner[window - 1:])
    order = places[np.argsort(rolled[places], kind="stable")]
    same = rolled[order[1:]] == rolled[order[:-1]]
    twice = order[np.r_[same, False] | np.r_[False, same]] if len(order) else order
    cover = np.zeros(len(ids) + 1, np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + window, -1)
    covered = np.r_[False, np.cumsum(cover[:-1]) > 0, False]
    new = np.r_[False, owner[1:] != owner[:-1], False]  # a stretch ends with its text
    starts = np.flatnonzero(covered[1:-1] & (~covered[:-2] | new[:-1]))
    ends = np.flatnonzero(covered[1:-1] & (~covered[2:] | new[1:])) + 1
    return list(zip(starts.tolist(), ends.tolist()))


class _Known(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self) + 1
        return number


def detect(df: DataFrame, text: str = "text", shortest: int = SHORTEST, rewrite: Callable | None = None, key: str | None = None) -> DataFrame:
    """The table with ``n_words``, ``runs`` (start, length, period in words, by start, then period) and ``collapsed``.

    ``collapsed`` holds the words that no run covers after its first period, joined by one space. ``rewrite`` may replace a
    text's words before they are looked at: it takes the row's value of ``key`` and the words as bytes.
    """
    rows = with_outputs(df, "n_words", "runs", "collapsed")
    kept = rows.columns
    schema = T.StructType([*rows.schema.fields, *T.StructType.fromDDL(f"n_words long, runs array<{RUN}>, collapsed string").fields])
    run_type = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))

    def judge(batch: pa.RecordBatch, known: _Known) -> pa.RecordBatch:
        texts = [(t or "").encode().split() for t in batch.column(kept.index(text)).to_pylist()]
        if rewrite is not None:
            texts = [rewrite(k, words) for k, words in zip(batch.column(kept.index(key)).to_pylist(), texts)]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        first = np.r_[0, np.cumsum(sizes)].astype(np.int64)
        ids = np.fromiter((known[w] for words in texts for w in words), np.int64, int(first[-1]))
        owner = np.repeat(np.arange(len(texts)), sizes)
        found: list[list] = [[] for _ in texts]
        for a, b in _stretches(ids, owner, shortest // 2):
            if b - a >= shortest:
                own = int(owner[a])
                shift = a - int(first[own])
                local = np.unique(ids[a:b], return_inverse=True)[1] + 1
                found[own] += [(s + shift, n, p) for s, n, p in runs(local.tolist(), shortest)]
        collapsed = []
        for words, own in zip(texts, found):
            if own:
                lost = np.zeros(len(words) + 1, np.int64)
                for s, n, p in own:
                    lost[s + p] += 1
                    lost[s + n] -= 1
                words = [words[i] for i in np.flatnonzero(np.cumsum(lost[:-1]) == 0).tolist()]
            collapsed.append(b" ".join(words).decode())
        flat = [r for own in found for r in own]
        structs = pa.StructArray.from_arrays([pa.array([r[k] for r in flat], pa.int64()) for k in range(3)], fields=list(run_type.value_type))
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(own) for own in found])].astype(np.int32)), structs)
        return pa.record_batch([*batch.columns, pa.array(sizes), lists, pa.array(collapsed, pa.string())], names=[*kept, "n_words", "runs", "collapsed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known()
        for batch in batches:
            if len(known) > KNOWN_WORDS:
                known.clear()
            yield judge(batch, known)

    return rows.mapInArrow(run, schema)


def listed(found: str = "runs"):
    """All runs as lines of ``start,length,period``."""
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    return F.array_join(F.transform(F.col(found), line), "")


def greatest(found: str = "runs"):
    """The longest run; of equally long ones that of the smallest start, then of the smallest period. None without runs."""
    return F.reduce(F.col(found), F.lit(None).cast(RUN),
                    lambda best, r: F.when(best.isNull() | (r["length"] > best["length"]), r).otherwise(best))
