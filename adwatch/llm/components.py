"""Connected components of an edge table by alternating star contraction, one written table a round."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adwatch.llm.common import settle

#: Files of an edge table; a file has edges alone and is read by as many tasks as its size asks for.
FILES = 24
#: Edges that a task joins at a time.
HELD = 1_000_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's edges with every node at its smallest neighbour's root, one edge a node and ``HELD`` edges."""
    above: dict = {}

    def root(node):
        top = node
        while (up := above.get(top, top)) != top:
            top = up
        while (up := above.get(node, node)) != node:
            above[node], node = top, up
        return top

    def stars() -> Iterator[pa.RecordBatch]:
        rows = [(n, root(n)) for n in list(above)]
        rows = [r for r in rows if r[0] != r[1]]
        if rows:
            yield pa.record_batch([pa.array(c, pa.string()) for c in zip(*rows)], names=["a", "b"])
        above.clear()

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            one, two = root(a), root(b)
            low, high = min(one, two), max(one, two)
            above.setdefault(low, low)
            above[high] = low
        if len(above) > HELD:
            yield from stars()
    yield from stars()


def _written(edges: DataFrame) -> DataFrame:
    return settle(edges.mapInArrow(_forest, "a string, b string"), FILES)


def _is_forest_of_stars(held: DataFrame) -> bool:
    """No node has two parents, and no parent has one."""
    places = held.select(F.col("a").alias("node"), F.col("b").alias("up")).union(held.select("b", F.lit(None).cast("string")))
    seen = places.groupBy("node").agg(F.min("up").alias("x"), F.max("up").alias("y"), F.max(F.col("up").isNull()).alias("top"))
    return seen.where((F.col("x") != F.col("y")) | (F.col("top") & F.col("x").isNotNull())).isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node it reaches) for every node of the edges ``a``, ``b`` (text); any order, repeats allowed.

    Tasks first join the edges they hold. Each round then links neighbours to the smallest node around, first those above a
    node, then those below. Minima are aggregates, combined before the shuffle, so a node of many edges is no one's
    problem. Rounds grow with the logarithm of the longest path. An empty table gives an empty result; an edge from a node
    to itself gives nothing.
    """
    held = _written(edges.where("a <> b").select("a", "b"))
    while not _is_forest_of_stars(held):
        both = held.union(held.select("b", "a")).toDF("u", "v")
        smallest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        above = both.join(smallest, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b")
        roots = above.groupBy("a").agg(F.min("b").alias("m"))
        below = above.join(roots, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        held = _written(below.union(roots.select("a", "m")))
    return held.select(F.col("a").alias("node"), F.col("b").alias("root")).union(held.select("b", "b")).distinct()
