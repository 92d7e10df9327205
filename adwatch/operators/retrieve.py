"""Nearest rules of an ad by cosine similarity, exact at every size of the rule table.

Vectors meet in Arrow batches as one matrix product; Spark decides which vectors meet where.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adwatch import fixed
from adwatch.functions.numbers import round_even
from adwatch.operators.skew import lookup_join
from adwatch.session import settled

INLINE_FLOATS = 4_000_000
BLOCK_FLOATS = 1_000_000
SHARD_FLOATS = 4_000_000
CLUSTERS = 1_024
FEW_CLUSTERS = 8
#: Numbers of one product of queries and rules, or of the rows that a batch of queries sends to clusters, at one time.
CELLS = 1_000_000
#: Places to which a cosine is rounded before it is compared, so that the order of a sum's terms decides nothing.
PLACES = 12


def _matrix(vectors: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit rows of the usable vectors, and their positions. Missing, odd-sized and zero vectors match nothing."""
    sizes = np.asarray(vectors.value_lengths().fill_null(-1))
    kept = np.flatnonzero(sizes == dim)
    rows = np.asarray(vectors.take(pa.array(kept)).flatten(), dtype=np.float64).reshape(len(kept), dim)
    length = np.sqrt((rows * rows).sum(axis=1))
    fine = length > 0
    return rows[fine] / length[fine, None], kept[fine]


def _slices(batch: pa.RecordBatch | pa.Table, width: int) -> Iterator[pa.RecordBatch | pa.Table]:
    """Parts of a batch that make at most ``CELLS`` numbers at ``width`` a row, one row at least: a task holds no more at once."""
    step = max(1, CELLS // max(1, width))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def _hits(queries: np.ndarray, rules: np.ndarray, k: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, rule and cosine of the ``k`` best per query; equal cosines keep rule order."""
    found = []
    step = max(1, CELLS // max(1, len(rules)))
    for at in range(0, len(queries), step):
        cosine = queries[at:at + step] @ rules.T
        np.round(cosine, PLACES, out=cosine)
        row, rule = np.nonzero(cosine >= threshold)
        value = cosine[row, rule]
        order = np.lexsort((rule, -value, row))
        row, rule, value = row[order], rule[order], value[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        best = place < k
        found.append((row[best] + at, rule[best], value[best]))
    parts = list(zip(*found)) or [(np.empty(0, int),)] * 2 + [(np.empty(0),)]
    return tuple(np.concatenate(p) for p in parts)


def _batch(names: list[str], ids: pa.Array, rule_ids: pa.Array, hits, kept: np.ndarray) -> pa.RecordBatch:
    row, rule, value = hits
    return pa.RecordBatch.from_arrays([ids.take(pa.array(kept[row])), rule_ids.take(pa.array(rule)), pa.array(value)], names=names)


def retrieve_rules(
    queries: DataFrame,
    rules: DataFrame,
    query_id: str = "query_id",
    k: int = fixed.RETRIEVAL_K,
    threshold: float = fixed.RETRIEVAL_MIN_COSINE,
    inline_floats: int = INLINE_FLOATS,
    block_floats: int = BLOCK_FLOATS,
) -> DataFrame:
    """``(query_id, rank, rule_id, cosine, score)`` of the ``k`` nearest rules at or above ``threshold``.

    ``queries`` is ``(query_id, embedding)``, ``rules`` is ``(rule_id, embedding)``. The rule table is measured first.
    Up to ``inline_floats`` numbers it travels to the tasks whole: no shuffle, no row per pair. Beyond that, rules are
    clustered, and queries visit clusters in two rounds (:func:`retrieve_clustered`). Clusters in parts of
    ``block_floats`` numbers meet shards of queries of ``SHARD_FLOATS`` numbers on an equality key, and at most ``k`` rows
    per query and part come out. Both ways give the same rows.
    """
    asking = queries.agg(F.count(F.lit(1)).alias("n")).scalar()
    size = rules.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("embedding")), F.lit(0)).alias("dim")).withColumn("asking", asking).first()
    n, dim = size["n"], size["dim"]
    asked = queries.select(query_id, F.col("embedding").cast("array<double>").alias("_q"))
    known = rules.select("rule_id", F.col("embedding").cast("array<double>").alias("_v"))
    if n * dim <= inline_floats:
        hits = _retrieve_inline(asked, known, query_id, k, threshold, dim)
    else:
        hits = _retrieve_blocked(asked, known, query_id, k, threshold, dim, -(-n * dim // block_floats), block_floats, size["asking"])
    return hits.withColumn("score", round_even(F.col("cosine"), 3))


def _schema(asked: DataFrame, known: DataFrame, query_id: str) -> T.StructType:
    return T.StructType([asked.schema[query_id], known.schema["rule_id"], T.StructField("cosine", T.DoubleType())])


def _ranked(hits: DataFrame, query_id: str, k: int) -> DataFrame:
    """The ``k`` best over all blocks; tasks cut to ``k`` rows per query before the shuffle."""
    order = Window.partitionBy(query_id).orderBy(F.desc("cosine"), "rule_id")
    ranked = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(query_id, "rank", "rule_id", "cosine")


def _retrieve_inline(asked: DataFrame, known: DataFrame, query_id: str, k: int, threshold: float, dim: int) -> DataFrame:
    table = known.orderBy("rule_id").toArrow()  # bounded by the caller's size check
    vectors = table.column("_v").combine_chunks()
    rules, usable = _matrix(vectors, dim)
    rule_ids = table.column("rule_id").combine_chunks().take(pa.array(usable))
    shared = asked.sparkSession.sparkContext.broadcast((rules, rule_ids))
    schema = T.StructType([*_schema(asked, known, query_id).fields[:1], T.StructField("rank", T.IntegerType()), *_schema(asked, known, query_id).fields[1:]])

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules, rule_ids = shared.value
        for batch in batches:
            rows, kept = _matrix(batch.column("_q"), dim)
            hits = _hits(rows, rules, k, threshold)
            out = _batch(["q", "r", "c"], batch.column(query_id), rule_ids, hits, kept)
            rank = np.arange(len(hits[0])) - np.searchsorted(hits[0], hits[0]) + 1
            yield pa.RecordBatch.from_arrays([out.column(0), pa.array(rank.astype(np.int32)), out.column(1), out.column(2)], names=schema.names)

    return asked.mapInArrow(match, schema)


def _unit_angles(rows: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(rows @ centers.T, -1.0, 1.0))


def cluster_rules(known: DataFrame, dim: int, clusters: int) -> tuple[DataFrame, np.ndarray, dict[int, tuple[float, int]]]:
    """Rules with the nearest of ``clusters`` centres, the centres, and per cluster the largest angle and the rule count.

    Centres are rules drawn by hash; they decide cost only. Rules without a usable vector drop out.
    """
    drawn = known.where(F.size("_v") == dim).orderBy(F.xxhash64("rule_id")).limit(clusters).select("_v").toArrow()  # bounded
    centers, _ = _matrix(drawn.column("_v").combine_chunks(), dim)
    schema = T.StructType([T.StructField("_cluster", T.IntegerType()), T.StructField("_angle", T.DoubleType()), known.schema["rule_id"], known.schema["_v"]])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (own for whole in batches for own in _slices(whole, max(dim, len(centers)))):
            rows, kept = _matrix(batch.column("_v"), dim)
            if len(rows):
                angles = _unit_angles(rows, centers)
                nearest = angles.argmin(1)
                own = batch.take(pa.array(kept))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(nearest.astype(np.int32)), pa.array(angles[np.arange(len(rows)), nearest]), own.column("rule_id"), own.column("_v")],
                    names=schema.names)

    placed = settled(known.select("rule_id", "_v").mapInArrow(assign, schema))
    sized = placed.groupBy("_cluster").agg(F.max("_angle").alias("r"), F.count(F.lit(1)).alias("n")).collect()  # a row per cluster
    return placed, centers, {row["_cluster"]: (row["r"], row["n"]) for row in sized}


def _first_round(angles: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """Marks the clusters that a query visits first: the nearest centres that together hold ``k`` rules."""
    near = np.argsort(angles, axis=1, kind="stable")
    held = np.cumsum(counts[near], axis=1)
    marks = np.zeros(angles.shape, bool)
    np.put_along_axis(marks, near, held - counts[near] < k, axis=1)
    return marks


def route_queries(
    asked: DataFrame, query_id: str, dim: int, threshold: float, centers: np.ndarray, sizes: dict[int, tuple[float, int]],
    k: int | None = None, first: bool = False,
) -> DataFrame:
    """Queries with each cluster that can hold a rule within reach.

    A rule is at least as far from a query as the centre's angle less the cluster's radius, so all other clusters are
    ruled out for certain. With ``k``, ``first`` gives the clusters of the first round only, and without it the others, as
    far as they can hold a cosine at or above the query's ``_bound``, which has grown from ``threshold`` by then.
    """
    listed = np.array(sorted(sizes), dtype=np.int64)
    radius = np.array([sizes[c][0] for c in listed.tolist()])
    counts = np.array([sizes[c][1] for c in listed.tolist()])
    schema = T.StructType([T.StructField("_cluster", T.IntegerType()), asked.schema[query_id], asked.schema["_q"]])
    bounded = "_bound" in asked.columns

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (own for whole in batches for own in _slices(whole, dim * max(1, len(listed)))):  # a row may go to every cluster
            rows, kept = _matrix(batch.column("_q"), dim)
            if len(rows) and len(listed):
                angles = _unit_angles(rows, centers[listed])
                bound = np.asarray(batch.column("_bound").fill_null(threshold))[kept] if bounded else np.full(len(rows), threshold)
                within = angles - radius <= np.arccos(np.clip(bound, -1.0, 1.0))[:, None] + 1e-6
                if k is not None:
                    visited = _first_round(angles, counts, k)
                    within &= visited if first else ~visited
                row, cluster = np.nonzero(within)
                own = batch.take(pa.array(kept[row]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(listed[cluster].astype(np.int32)), own.column(query_id), own.column("_q")], names=schema.names)

    return asked.select(query_id, "_q", *["_bound"] * bounded).mapInArrow(route, schema)


@dataclass
class Clusters:
    """Rules by cluster: the table, the centres by number, and the largest angle and rule count of each cluster."""

    rules: DataFrame
    centers: np.ndarray
    sizes: dict[int, tuple[float, int]]
    dim: int


def store_clusters(rules: DataFrame, path: str, clusters: int = CLUSTERS) -> None:
    """Write the rules by cluster, to be searched again and again: the rules, then a row per cluster."""
    known = rules.select("rule_id", F.col("embedding").cast("array<double>").alias("_v"))
    dim = known.agg(F.coalesce(F.max(F.size("_v")), F.lit(0)).alias("dim")).first()["dim"]
    placed, centers, _ = cluster_rules(known, dim, clusters)
    placed.sortWithinPartitions("_cluster").write.mode("overwrite").parquet(f"{path}/rules")
    stored = rules.sparkSession.read.schema(placed.schema).parquet(f"{path}/rules")
    sized = stored.groupBy("_cluster").agg(F.max("_angle").alias("radius"), F.count(F.lit(1)).alias("n"))
    rows = [(i, row.tolist()) for i, row in enumerate(centers)]  # at most ``clusters``
    middle = rules.sparkSession.createDataFrame(rows, "_cluster int, center array<double>")
    middle.join(sized, "_cluster", "left").withColumn("dim", F.lit(dim)).write.mode("overwrite").parquet(f"{path}/clusters")


def open_clusters(spark: SparkSession, path: str) -> Clusters:
    """The stored table; rows of ``clusters`` are bounded, rules stay where they are."""
    rows = sorted(spark.read.parquet(f"{path}/clusters").collect(), key=lambda r: r["_cluster"])
    dim = rows[0]["dim"] if rows else 0
    centers = np.array([r["center"] for r in rows]).reshape(len(rows), dim)
    return Clusters(spark.read.parquet(f"{path}/rules"), centers, {r["_cluster"]: (r["radius"], r["n"]) for r in rows if r["n"]}, dim)


def copies(routed: DataFrame, dim: int, shard_floats: int | None = None) -> dict[int, int]:
    """Shards per cluster, from the queries that visit it: a rule is copied once a shard of its own cluster."""
    counted = routed.groupBy("_cluster").agg(F.count(F.lit(1)).alias("n")).collect()  # a row per cluster
    return {r["_cluster"]: -(-r["n"] * dim // (shard_floats or SHARD_FLOATS)) for r in counted}


def _met(routed: DataFrame, table: Clusters, query_id: str, k: int, threshold: float, block_floats: int, shards: dict[int, int] | None) -> DataFrame:
    """The ``k`` best of every query and part of a cluster it visits. Clusters are cut into parts, their queries into shards."""
    dim = table.dim
    schema = T.StructType([routed.schema[query_id], table.rules.schema["rule_id"], T.StructField("cosine", T.DoubleType())])

    def by_cluster(numbers: dict[int, int]) -> Column:
        larger = [F.lit(x) for c, n in numbers.items() if n > 1 for x in (c, n)]  # clusters of one part or shard need no entry
        return F.coalesce(F.try_element_at(F.create_map(*larger), F.col("_cluster")), F.lit(1)) if larger else F.lit(1)

    parts, cuts = by_cluster({c: -(-n * dim // block_floats) for c, (_, n) in table.sizes.items()}), by_cluster(shards or {})
    part, shard = F.pmod(F.xxhash64("rule_id"), parts).cast("int"), F.pmod(F.xxhash64(query_id), cuts).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), (n - 1).cast("int")))
    stored = table.rules if shards is None else table.rules.where(F.col("_cluster").isin([c for c in shards])) if len(shards) < len(table.sizes) else table.rules
    stored = stored.select("_cluster", part.alias("_part"), upto(cuts).alias("_shard"), "rule_id", "_v")
    spread = routed.select("_cluster", upto(parts).alias("_part"), shard.alias("_shard"), query_id, "_q")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("rule_id").combine_chunks()
        rules, usable = _matrix(right.column("_v").combine_chunks(), dim)
        rule_ids = right.column("rule_id").combine_chunks().take(pa.array(usable))
        found = []
        for own in [*_slices(left, max(dim, len(rules)))] or [left]:  # the queries lie in memory once, as they came
            rows, kept = _matrix(own.column("_q").combine_chunks(), dim)
            found.append(_batch(schema.names, own.column(query_id).combine_chunks(), rule_ids, _hits(rows, rules, k, threshold), kept))
        return pa.Table.from_batches(found)

    keys = ("_cluster", "_part", "_shard")
    return spread.groupBy(*keys).cogroup(stored.groupBy(*keys)).applyInArrow(meet, schema)


def retrieve_clustered(
    queries: DataFrame, table: Clusters, query_id: str = "query_id", k: int = fixed.RETRIEVAL_K,
    threshold: float = fixed.RETRIEVAL_MIN_COSINE, block_floats: int = BLOCK_FLOATS, asking: int | None = None,
) -> DataFrame:
    """The nearest rules from a table of clusters, in two rounds, or in one over at most ``FEW_CLUSTERS`` clusters.

    First every query visits the nearest clusters that hold ``k`` rules; its ``k``-th cosine there is a bound that all
    other clusters must be able to reach, or the query does not visit them. Rules are copied only to shards of queries that
    visit their cluster; while all queries fit into one shard nothing is counted.
    """
    asked = queries.select(query_id, F.col("embedding").cast("array<double>").alias("_q"))
    if not table.sizes:
        schema = T.StructType([asked.schema[query_id], T.StructField("rank", T.IntegerType()), table.rules.schema["rule_id"], T.StructField("cosine", T.DoubleType())])
        return asked.sparkSession.createDataFrame([], schema)
    many = (asked.count() if asking is None else asking) * table.dim > SHARD_FLOATS
    if len(table.sizes) <= FEW_CLUSTERS:
        routed = route_queries(asked, query_id, table.dim, threshold, table.centers, table.sizes)
        return _ranked(_met(routed, table, query_id, k, threshold, block_floats, copies(routed, table.dim) if many else None), query_id, k)
    first = route_queries(asked, query_id, table.dim, threshold, table.centers, table.sizes, k, first=True)
    near = _met(first, table, query_id, k, threshold, block_floats, copies(first, table.dim) if many else None)
    near = settled(near) if many else near
    bounds = near.groupBy(query_id).agg(F.sort_array(F.collect_list("cosine"), asc=False).alias("_c")).select(
        query_id, F.get("_c", F.lit(k - 1)).alias("_bound"))
    left = asked.join(bounds, query_id, "left")
    rest = route_queries(left, query_id, table.dim, threshold, table.centers, table.sizes, k)
    far = _met(rest, table, query_id, k, threshold, block_floats, copies(rest, table.dim) if many else None)
    return _ranked(near.unionAll(far), query_id, k)


def _retrieve_blocked(
    asked: DataFrame, known: DataFrame, query_id: str, k: int, threshold: float, dim: int, blocks: int, block_floats: int,
    asking: int,
) -> DataFrame:
    placed, centers, sizes = cluster_rules(known, dim, min(CLUSTERS, blocks))
    table = Clusters(placed, centers, sizes, dim)
    return retrieve_clustered(asked.withColumnRenamed("_q", "embedding"), table, query_id, k, threshold, block_floats, asking)


def rule_titles(hits: DataFrame, rules: DataFrame, query_id: str = "query_id") -> DataFrame:
    """Per query the retrieved rules as an array of structs, nearest first, and their titles."""
    named = lookup_join(hits, rules.select("rule_id", "title", "category", "source", "text"), ["rule_id"])
    nearest = F.array_sort(F.collect_list(F.struct("rank", "title", "category", "source", "text")))
    return named.groupBy(query_id).agg(nearest.alias("rules")).withColumn(
        "rag_refs", F.transform("rules", lambda r: r["title"])
    )

