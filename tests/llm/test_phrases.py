"""Collocations against counting by definition."""

import random
import re
from collections import Counter

import pytest

from adwatch.llm import phrases
from adwatch.llm.queries import QUERIES


def by_definition(rows, least, top=2000, longest=5):
    counted, total = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            total[lang] += len(words)
            own = counted.setdefault(lang, Counter())
            own.update(tuple(words[i:i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    out = []
    for lang, own in counted.items():
        cands = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        inside = {}
        for p, a in cands.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inside[p[i:i + k]] = max(inside.get(p[i:i + k], 0), a)
        found = []
        for p, a in cands.items():
            if 100 * inside.get(p, 0) >= 100 * a:
                continue
            score, k = min((1000 * a * total[lang] // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


def rows(seed, n):
    rng = random.Random(seed)
    vocabulary = [*"The of and To in".split(), "é½", "x\xa0y", "q\x01", *[f"w{i}" for i in range(150)]]
    fixed = [["rare", "pair"], ["of", "the", "new", "long", "chain", "here"], ["A", "a", "a", "a"], ["to", "be", "or"]]
    out = [(None, None), ("en", None), ("en", ""), (None, "The of The of " * 30), ("fr", "tie tie tie. tie\ttie\x0btie " * 40), ("en", "one two " * 5000)]
    for i in range(n):
        words = []
        for _ in range(rng.randint(0, 60)):
            words += rng.choice(fixed) if rng.random() < 0.2 else [vocabulary[int(rng.paretovariate(0.7)) % len(vocabulary)]]
            words.append(rng.choice(["", "", "", "", ",", ".", "\n", ": "]))
        out.append((rng.choice(["en", "en", "en", "fr", None]), " ".join(words) * rng.choice([1, 1, 2])))
    return out + out[-20:]


def same(got, want):
    assert sorted(tuple(r) for r in got.collect()) == want


@pytest.mark.parametrize("limits", [phrases.Limits(), phrases.Limits(bits=10, burst=3, held=50, known=120, block=4000)])
def test_collocations(spark, limits):
    data = rows(4, 500)
    df = spark.createDataFrame([(a, b, 1) for a, b in data], "lang string, text string, phrase int").repartition(5)
    for least, top in ((100, 2000), (7, 40)):
        want = by_definition(data, least, top)
        got = phrases.collocations(df, least=least, top=top, limits=limits)
        assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        same(got, want)
        assert len(want) > 30
    assert phrases.collocations(df.limit(0)).collect() == []


def test_trie_bursts_and_spills():
    rng, trie, want = random.Random(1), phrases.Trie(4), Counter()
    for _ in range(3000):
        path = b"".join(rng.randint(1, 6).to_bytes(4, "little") for _ in range(rng.randint(2, 5)))
        trie.add(path, 2)
        want[path] += 2
    assert any(type(b) is phrases.Node for b in trie.root.values())
    got = Counter()
    for _, word in trie.subtrees():
        for path, n in trie.take(word):
            got[path] += n
    assert got == want and trie.size == 0 and not trie.root


def test_query_over_whole_tables(spark, folder):
    data = rows(9, 300)
    spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(data)], "doc_id long, lang string, text string").write.parquet(f"{folder}/documents.parquet")
    same(QUERIES["op11_collocations"](spark, folder), by_definition(data, 100))
