"""The stored word index against reading all current texts."""

import random

import pytest
from pyspark.sql import functions as F

from adwatch.operators import postings as P
from adwatch.operators import search as H
from test_operators import hits_by_reading

TERMS = [(0, "lot"), (1, "d"), (2, "de la"), (3, "Vin d'été"), (4, "écaille lot"), (5, "ang"), (6, "gle"), (7, "e-"), (8, "lot"), (9, "absent"), (10, "")]


def batches():
    """Three batches over the same ads: new texts replace old ones, some lose theirs, one word is in nearly all."""
    rng = random.Random(4)
    words = ["lot", "loterie", "angle", "aigle", "vin", "vinaigre", "écaille", "dague", "de la", "e-mail", "été", "x1", "ferme"]
    def text(): return " ".join(["Lot"] * (rng.random() < 0.9) + rng.choices(words, k=rng.randint(0, 6)))
    one = [(i, text(), rng.choice([text(), None])) for i in range(120)] + [(None, "lot perdu", None)]
    two = [(i, text(), None) for i in range(40, 90)] + [(7, None, None), (8, "vin", "gris"), (8, "angle", None)]
    three = [(i, text(), text()) for i in range(80, 140)] + [(None, "ferme", None)]
    return [one, two, three]


def current(parts):
    seen = {}
    for part in parts:
        seen.update({key: [] for key, *_ in part})
        for row in part:
            seen[row[0]].append(row)
    return [row for rows in seen.values() for row in rows]


def read(docs, terms):
    """Rows of one key count as one ad."""
    return set().union(*[hits_by_reading([row], [t for t in terms if t[1]]) for row in docs])


def found(df):
    rows = [(r.key, r.term_id) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("merged", [(), (0,), (1,), (0, 2)])
def test_search_over_an_updated_index(spark, folder, merged):
    terms = spark.createDataFrame(TERMS, "term_id long, term string")
    parts = batches()
    for n, part in enumerate(parts):
        df = spark.createDataFrame(part, "id long, title string, text string").repartition(3)
        for _ in range(2):  # a batch that runs again leaves one copy
            P.write_segment(df, folder, n, "id", "title", "text", block=7)
        if n in merged:
            P.merge_segments(spark, folder, n, block=7)
            P.merge_segments(spark, folder, n, block=7)
        docs = current(parts[:n + 1])
        want = read(docs, TERMS)
        assert found(P.search_index(spark, folder, terms)) == want
        whole = spark.createDataFrame(docs, "id long, title string, text string")
        assert {(r.id, r.term_id) for r in H.search_terms(whole, terms, "id", "title", "text").collect()} == want
    index = P.Index(spark, folder)
    sizes = index.words.select(F.size("keys").alias("n"), "word").collect()
    assert max(r.n for r in sizes) <= 7 and sum(r.word == "lot" for r in sizes) > 10
    if merged == (0, 2):
        assert index.done == 2 and {r.key for r in index.words.select(F.explode("keys").alias("key")).collect()} <= {d[0] for d in docs}


def test_many_terms_join(spark, folder, monkeypatch):
    parts = batches()
    for n, part in enumerate(parts):
        P.write_segment(spark.createDataFrame(part, "id long, title string, text string"), folder, n, "id", "title", "text", block=5)
    monkeypatch.setattr(P, "INLINE_TERMS", 0)
    monkeypatch.setattr(P, "CHUNK", 2)
    many = [(t, w) for t, w in TERMS if w] + [(100 + i, "lot") for i in range(9)]
    got = found(P.search_index(spark, folder, spark.createDataFrame(many, "term_id long, term string")))
    assert got == read(current(parts), many)


def test_prefixes_reach_the_scan(spark, folder):
    P.write_segment(spark.createDataFrame([(1, "lot de vin")], "id long, title string"), folder, 0, "id", "title")
    plan = P.prefix_blocks(P.Index(spark, folder), ["lo", "vi"])._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(word,lo)" in plan and "StringStartsWith(word,vi)" in plan
    none = spark.createDataFrame([], "term_id long, term string")
    assert P.search_index(spark, folder, none).collect() == []
    P.write_segment(spark.createDataFrame([], "id long, title string"), folder, 1, "id", "title")
    assert found(P.search_index(spark, folder, spark.createDataFrame([(1, "vin")], "term_id long, term string"))) == {(1, 1)}
