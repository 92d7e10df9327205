"""Toxicity: words as bags of character n-grams, averaged into a linear softmax, trained jointly in numpy.

A word's vector is the mean of its hashed n-grams' vectors (3 to 5 characters, with word boundaries, and the whole word),
so a misspelling shares most of a known word's vector. A passage of ``WINDOW`` words is the mean of its words. A softmax
over that mean gives the passage's logit; a text is as toxic as its most toxic passage, so long texts are not diluted.
Training first takes passages with their text's label, then, in rounds, the top passage of each text.

The classifier is fitted on a bounded sample of labelled rows (``max_toxic`` and ``max_clean``, smallest hashes of the id
first); everything else covers all rows. Since mean and softmax are linear up to the last step, the fitted model is one
number per n-gram bucket.

* Null and empty texts get the score of the bias alone. Repeated rows are scored each for itself; an empty table gives an
  empty result. Labels that are null are left out; several labels of one id count as toxic if one is. Without examples of
  both kinds every score is 0. Other columns are carried along; one that has the name of an output is replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adwatch.llm.common import tidy, with_outputs

BUCKETS, DIM, WINDOW = 1 << 16, 8, 8
SHORTEST, LONGEST = 3, 5
MAX_TOXIC, MAX_CLEAN = 2_000, 3_000
#: Words whose score a worker keeps; beyond it the table starts afresh.
CACHED_WORDS = 200_000
STRIPPED = ".,;:!?\"'()[]{}«»„“”…*_-"
_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Model:
    """The logit each n-gram bucket adds, the bias, and the line that turns a text's top logit into a score."""

    weights: np.ndarray
    bias: float
    scale: float
    shift: float


def ngrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the words and, beside them, the word each belongs to."""
    marked = ["<" + w + ">" for w in words]
    lengths = np.fromiter(map(len, marked), np.int64, len(marked))
    points = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), lengths)
    end = np.repeat(np.cumsum(lengths), lengths)
    at = np.arange(len(points))
    found, owners = [], []
    with np.errstate(over="ignore"):
        rolled = np.zeros(len(points), np.uint64)
        for n in range(1, LONGEST + 1):
            rolled = (rolled + np.r_[points[n - 1:], np.zeros(n - 1, np.uint64)] + np.uint64(n)) * _MIX
            rolled ^= rolled >> np.uint64(29)
            if n >= SHORTEST:
                fits = at + n <= end
                found.append(rolled[fits])
                owners.append(owner[fits])
        starts = np.r_[0, np.cumsum(lengths)[:-1]].astype(np.int64)
        spread = (points + np.uint64(7)) * (_MIX ** (np.uint64(3) + (at - starts[owner]).astype(np.uint64)))
        whole = np.add.reduceat(spread, starts) if len(words) else np.empty(0, np.uint64)
        found.append(whole * _MIX)
        owners.append(np.arange(len(words)))
        hashed = np.concatenate(found)
        hashed = (hashed ^ (hashed >> np.uint64(32))) * _MIX
    return (hashed >> np.uint64(48)).astype(np.int64) % BUCKETS, np.concatenate(owners)


def words_of(text: str | None) -> list[str]:
    return [w for w in (c.strip(STRIPPED) for c in (text or "").lower().split()) if w]


def word_logits(model_weights: np.ndarray, words: list[str]) -> np.ndarray:
    """The mean of every word's n-grams; made in parts, since n-grams are many times the words."""
    found = [np.empty(0)]
    for a in range(0, len(words), 20_000):
        part = words[a:a + 20_000]
        ids, owner = ngrams(part)
        found.append(np.bincount(owner, model_weights[ids], len(part)) / np.maximum(np.bincount(owner, minlength=len(part)), 1))
    return np.concatenate(found)


def top_logit(scores: np.ndarray, bias: float, codes: np.ndarray | None = None) -> float:
    """The largest mean over windows of ``WINDOW`` words, or over the whole of a shorter text.

    With ``codes``, the words' numbers, a word counts once a window: a repeated word weighs no more than a single one.
    """
    if codes is not None and len(codes) > 1:
        again = np.zeros(len(codes), bool)
        for gap in range(1, min(WINDOW, len(codes))):
            again[gap:] |= codes[gap:] == codes[:-gap]
        scores = np.where(again, 0.0, scores)
    if len(scores) <= WINDOW:
        return bias + (float(scores.sum()) / WINDOW if len(scores) else 0.0)
    sums = np.r_[0.0, np.cumsum(scores)]
    return bias + float((sums[WINDOW:] - sums[:-WINDOW]).max()) / WINDOW


def _train(arrays: list[np.ndarray], labels: np.ndarray, ids: np.ndarray, ends: np.ndarray, rounds: int = 4, seed: int = 7):
    """Joint gradient steps on n-gram vectors and softmax over passages."""
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    linear = rng.normal(0, 0.3, DIM).astype(np.float32)
    bias, seen_v, seen_l, seen_b = 0.0, np.full((BUCKETS, 1), 1e-6, np.float32), np.full(DIM, 1e-6, np.float32), 1e-6
    counts = np.diff(ends)

    def pooled(passages: list[np.ndarray]):
        """Per passage: the distinct buckets' shares, as flat arrays of bucket, passage and share."""
        sizes = np.fromiter(map(len, passages), np.int64, len(passages))
        words = np.concatenate(passages)
        own = np.repeat(np.arange(len(passages)), sizes)
        n = counts[words]
        starts = np.repeat(ends[words] - np.r_[0, np.cumsum(n)[:-1]], n)
        return ids[starts + np.arange(n.sum())], np.repeat(own, n), np.repeat(1.0 / (n * WINDOW), n).astype(np.float32)

    def step(passages, y, weight, rate):
        nonlocal bias, seen_b
        bucket, own, share = pooled(passages)
        mean = np.stack([np.bincount(own, vectors[bucket, d] * share, len(passages)) for d in range(DIM)], 1).astype(np.float32)
        p = 1 / (1 + np.exp(-np.clip(mean @ linear * SCALE + bias, -30, 30)))
        g = ((p - y) * weight / len(y)).astype(np.float32)
        toward = g[own] * share * SCALE
        pulled = np.bincount(bucket, toward, BUCKETS).astype(np.float32)
        grad_v = pulled[:, None] * linear[None, :]
        grad_l, grad_b = SCALE * (g @ mean), float(g.sum())
        np.add(seen_v, (grad_v ** 2).mean(1, keepdims=True), out=seen_v)
        np.add(seen_l, grad_l ** 2, out=seen_l)
        seen_b += grad_b ** 2
        np.subtract(vectors, rate * grad_v / np.sqrt(seen_v), out=vectors, where=pulled[:, None] != 0)
        np.subtract(linear, rate * grad_l / np.sqrt(seen_l), out=linear)
        bias -= rate * grad_b / np.sqrt(seen_b)

    def current() -> np.ndarray:
        return (vectors @ linear * SCALE).astype(np.float64)

    def by_word() -> np.ndarray:
        weights = current()[ids]
        return np.add.reduceat(weights, ends[:-1]) / counts if len(ids) else np.empty(0)

    for turn in range(rounds):
        passages, ys = [], []
        scores = by_word() if turn else None
        for words, y in zip(arrays, labels):
            if not len(words):
                continue
            if turn:
                own = np.r_[0.0, np.cumsum(scores[words])]
                a = int((own[WINDOW:] - own[:-WINDOW]).argmax()) if len(words) > WINDOW else 0
                picks = [a, *([] if y else rng.integers(0, max(1, len(words) - WINDOW), 2).tolist())]
            else:
                cuts = np.arange(0, len(words), WINDOW)
                picks = rng.permutation(cuts)[:12].tolist()
            for a in picks:
                passages.append(np.unique(words[a:a + WINDOW]))
                ys.append(y)
        ys = np.asarray(ys, np.float32)
        weight = np.where(ys > 0, 0.5 / max(ys.mean(), 1e-6), 0.5 / max(1 - ys.mean(), 1e-6)).astype(np.float32)
        order = rng.permutation(len(passages))
        for a in range(0, len(order), 512):
            part = order[a:a + 512]
            step([passages[i] for i in part], ys[part], weight[part], 0.1)
    return current(), float(bias)


#: Size of the mean's part in the logit, so that one word among a passage can decide it.
SCALE = 16.0


def fit(rows: list[tuple[str | None, int]]) -> Model | None:
    """The model of labelled texts, or None without examples of both kinds."""
    labels = np.array([y for _, y in rows], np.float32)
    if not len(rows) or labels.min() == labels.max():
        return None
    known: dict[str, int] = {}
    arrays = [np.array([known.setdefault(w, len(known)) for w in words_of(t)], np.int32) for t, _ in rows]
    if not known:
        return None
    words, parts, counts = list(known), [], []
    for a in range(0, len(words), 20_000):  # in parts, since n-grams are many times the words
        ids, owner = ngrams(words[a:a + 20_000])
        parts.append(ids[np.argsort(owner, kind="stable")].astype(np.int32))
        counts.append(np.bincount(owner))
    ids, ends = np.concatenate(parts), np.r_[0, np.cumsum(np.concatenate(counts))]
    del known, words, parts
    weights, bias = _train(arrays, labels, ids, ends)
    scores = np.add.reduceat(weights[ids], ends[:-1]) / np.diff(ends)
    tops = np.array([top_logit(scores[a], bias, a) for a in arrays])
    scale, shift = _line(tops, labels)
    return Model(weights, bias, scale, shift)


def _line(tops: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Logistic regression of the label on the top logit, by Newton's steps."""
    mid, width = float(tops.mean()), float(tops.std()) or 1.0
    x = np.stack([(tops - mid) / width, np.ones_like(tops)], 1)
    w, ridge = np.zeros(2), np.diag([1e-2, 1e-6])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (p - labels) + ridge @ w)
    return float(w[0] / width), float(w[1] - w[0] * mid / width)


def sample(documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
           max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> list[tuple[str | None, int]]:
    """At most so many labelled texts of either kind, smallest hashes of the id first."""
    marks = (labels.select(F.col(f"`{doc_id}`").alias("key"), F.col(f"`{label}`").cast("int").alias("y"))
             .where("key IS NOT NULL AND y IS NOT NULL").groupBy("key").agg(F.max("y").alias("y")))
    order = [F.xxhash64("key"), F.col("key")]
    chosen = marks.where("y = 1").orderBy(*order).limit(max_toxic).unionAll(marks.where("y = 0").orderBy(*order).limit(max_clean))
    texts = documents.select(F.col(f"`{doc_id}`").alias("key"), F.col(f"`{text}`").alias("text"))
    rows = texts.join(F.broadcast(chosen), "key").orderBy(*order, "text").limit(max_toxic + max_clean).collect()  # bounded
    return [(r["text"], r["y"]) for r in rows]


class _Scored:
    """Logits of the words a task has met, at most ``CACHED_WORDS`` and those of one batch."""

    def __init__(self, weights: np.ndarray):
        self.weights, self.places, self.logits, self.size = weights, {}, np.empty(1 << 14), 0

    def look_up(self, texts: list[list[str]]) -> None:
        if len(self.places) > CACHED_WORDS:
            self.__init__(self.weights)
        new = list({w for t in texts for w in t if w not in self.places})
        bare = list(dict.fromkeys(b for w in new if (b := w.strip(STRIPPED))))
        place = {b: self.size + i for i, b in enumerate(bare)}
        if self.size + len(bare) > len(self.logits):
            self.logits = np.resize(self.logits, 2 * (self.size + len(bare)))
        self.logits[self.size:self.size + len(bare)] = word_logits(self.weights, bare)
        self.size += len(bare)
        for w in new:
            self.places[w] = place.get(w.strip(STRIPPED), -1)


def score(df: DataFrame, model: Model | None, text: str = "text", out: str = "toxicity") -> DataFrame:
    """The table with ``out``, the score of every whole text between 0 and 1."""
    rows = with_outputs(df, out)
    kept = rows.columns
    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.DoubleType())])
    if model is None:
        return rows.withColumn(out, F.lit(0.0))
    shared = df.sparkSession.sparkContext.broadcast(model)  # one number per bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        scored = _Scored(own.weights)
        for batch in batches:
            texts = [(t or "").lower().split() for t in batch.column(kept.index(text)).to_pylist()]
            scored.look_up(texts)
            tops = []
            for t in texts:
                codes = np.fromiter(map(scored.places.__getitem__, t), np.int64, len(t))
                codes = codes[codes >= 0]
                tops.append(top_logit(scored.logits[codes], own.bias, codes))
            values = 1 / (1 + np.exp(-np.clip(own.scale * np.array(tops) + own.shift, -30, 30)))
            yield pa.record_batch([*batch.columns, pa.array(values, pa.float64())], names=[*kept, out])

    return rows.mapInArrow(tidy(run), schema)


def held_out(doc_id: str = "doc_id"):
    """Rows no label may be learnt from."""
    return F.coalesce(F.crc32(F.col(f"`{doc_id}`").cast("string")) % 3 == 1, F.lit(False))


def train(documents: DataFrame, labels: DataFrame) -> Model | None:
    """The model of the labelled rows that are not held out."""
    return fit(sample(documents, labels.where(~held_out())))
