"""Periodic runs of words against a search by definition."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from adwatch.llm import periods
from adwatch.llm.queries import QUERIES


def by_definition(values, shortest=12):
    found = []
    for p in range(1, len(values) // 2 + 1):
        k, same = 0, [values[i] == values[i + p] for i in range(len(values) - p)]
        while k < len(same):
            end = k
            while end < len(same) and same[end]:
                end += 1
            part = values[k:end + p]
            if end > k and len(part) >= max(2 * p, shortest):
                if not any(all(part[i] == part[i + q] for i in range(len(part) - q)) for q in range(1, p)):
                    found.append((k, len(part), p))
            k = end + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("shortest", [2, 5, 12])
def test_runs_of_small_sequences(shortest):
    rng = random.Random(shortest)
    for _ in range(600):
        values = [rng.randint(1, rng.choice([1, 2, 3, 5])) for _ in range(rng.randint(0, 45))]
        if values and rng.random() < 0.4:
            cut = rng.randint(1, len(values))
            values = (values[:cut] * 40)[:len(values)] + values[cut:]
        assert periods.runs(values, shortest) == by_definition(values, shortest)


def planted(doc_id, words):
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is not None and h % 10 == 0 and n > 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def expected(doc_id, text):
    words = planted(doc_id, [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w])
    runs = by_definition(words)
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            digest("".join(f"{s},{n},{p}\n" for s, n, p in runs)), digest(" ".join(w for i, w in enumerate(words) if i not in gone)))


def rows():
    rng = random.Random(8)
    some = lambda n, k: [f"w{rng.randint(1, k)}" for _ in range(n)]
    out = [(1, None), (2, ""), (3, " \t\x0b\n "), (4, "one"), (None, "a b " * 20), (None, None), (5, "x " * 11), (6, "x " * 12),
           (7, "tie " * 30 + "other " + "tie " * 30), (8, "é\xa0x ½  " * 15), (9, " ".join(some(9, 50) * 3 + some(60, 40) + some(11, 50) * 4)),
           (9, "a b c " * 10), (9, "a b c " * 10), (10, " ".join(some(2500, 30))), (11, " ".join(some(300, 200) * 2 + some(400, 300)))]
    for i in range(12, 150):
        text = some(rng.randint(0, 120), rng.choice([2, 3, 30, 300]))
        if rng.random() < 0.5 and text:
            cut, times = rng.randint(1, len(text)), rng.randint(2, 5)
            text = text[:cut] * times + text[cut:]
        out.append((i, " ".join(text)))
    return out


def test_periodic_runs(spark, folder):
    data = spark.createDataFrame(rows(), "doc_id long, text string").withColumn("runs", F.lit(1)).withColumn("n_words", F.lit("x"))
    data.repartition(3).write.parquet(f"{folder}/documents.parquet")
    got = QUERIES["op13_periodic_runs"](spark, folder)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    key = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted((expected(*r) for r in rows()), key=key)
    assert periods.detect(data.limit(0)).collect() == [] and periods.detect(data).columns == ["doc_id", "text", "n_words", "runs", "collapsed"]


def test_long_text(spark):
    rng = random.Random(2)
    part = [f"w{rng.randint(1, 900)}" for _ in range(20_000)]
    text = " ".join(part * 3 + part[:77] + ["end"])
    row = periods.detect(spark.createDataFrame([(text,)], "text string")).first()
    assert (0, 60_077, 20_000) in [tuple(r) for r in row["runs"]] and row["n_words"] == 60_078
    assert len(row["collapsed"].split()) <= 20_001
