"""Latest row, first row and previous row per key, safe when one key holds most of the table.

``row_number()`` and ``lag()`` send a whole key to one task. Latest and first rows are ``max_by`` / ``min_by``
aggregates instead, which reduce each key inside every map task before the shuffle. Previous rows and positions
come from a scan over sorted ranges, with one row per range that carries values across their edges; where rows already
lie in known stretches (splits of a file, say), windows over (key, stretch) and a row per stretch do the same.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adwatch.operators.skew import lookup_join
from adwatch.session import settled


def _rest(df: DataFrame, keys: Sequence[str], columns: Sequence[str] | None) -> list[str]:
    return list(columns) if columns is not None else [c for c in df.columns if c not in keys]


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """The row with the greatest ``order`` per key. End ``order`` with a unique column."""
    kept = _rest(df, keys, columns)
    return df.groupBy(*keys).agg(F.max_by(F.struct(*kept), F.struct(*order)).alias("_row")).select(*keys, "_row.*")


def earliest(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """The row with the smallest ``order`` per key: dedupe that keeps the first occurrence."""
    kept = _rest(df, keys, columns)
    return df.groupBy(*keys).agg(F.min_by(F.struct(*kept), F.struct(*order)).alias("_row")).select(*keys, "_row.*")


def with_previous(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column | None, carried: dict[str, str]
) -> DataFrame:
    """Add the previous row's values and the 0-based ``position`` per key.

    ``carried`` maps a column to the name of its previous value. ``bucket`` must not decrease along ``order``;
    each (key, bucket) is one window group. Without a bucket a key is one group.
    """
    if bucket is None:
        whole = Window.partitionBy(*keys).orderBy(*order)
        before = [F.lag(c).over(whole).alias(name) for c, name in carried.items()]
        return df.select(*df.columns, *before, (F.row_number().over(whole) - 1).cast("long").alias("position"))
    values = F.struct(*[F.col(c).alias(name) for c, name in carried.items()])
    marked = df.withColumn("_bucket", bucket)
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    marked = marked.withColumn("_before", F.lag(values).over(inside)).withColumn(
        "_place", F.row_number().over(inside).cast("long")
    )

    edges = (
        df.select(*dict.fromkeys([*keys, *order, *carried]), bucket.alias("_bucket"))
        .groupBy(*keys, "_bucket")
        .agg(F.max_by(values, F.struct(*order)).alias("_last"), F.count(F.lit(1)).alias("_rows"))
    )
    across = Window.partitionBy(*keys).orderBy("_bucket")
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)
    edges = edges.select(
        *keys,
        "_bucket",
        F.lag("_last").over(across).alias("_carry"),
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_offset"),
    )

    joined = marked.join(edges, [*keys, "_bucket"], "left")
    before = F.coalesce("_before", "_carry")
    return joined.select(
        *df.columns,
        *[before[name].alias(name) for name in carried.values()],
        (F.col("_offset") + F.col("_place") - 1).alias("position"),
    )


def first_by_cells(df: DataFrame, keys: Sequence[str], cells: Sequence[Column], order: Sequence[str], limit: str) -> DataFrame:
    """The first rows of every key in ``order``, as many as the key's ``limit`` says, without ranking any key whole.

    ``cells`` are whole numbers from coarse to fine that never decrease along ``order`` (blocks of pages, pages, blocks of
    positions). Rows are counted by cell; level by level the counts tell in which cell a key reaches its limit. Rows of
    earlier cells stay, later ones go, and only the rows of that one cell are ranked. A window group holds the cells of
    one level inside one cell of the level above, or the rows of one finest cell. ``limit`` is the same in all rows of a key:
    null keeps all rows, 0 or less none. Rows with a null key have no limit. End ``order`` with a unique column.
    """
    keys, names = list(keys), [f"_cell{i}" for i in range(len(cells))]
    numbers = [F.coalesce(c.cast("long"), F.lit(-(2**63))).alias(n) for c, n in zip(cells, names)]  # nulls come first in order
    rows = settled(df.where(F.col(limit).isNull() | (F.col(limit) > 0)).select("*", *numbers))
    limited = rows.where(F.col(limit).isNotNull())
    left = settled(limited.groupBy(*keys, *names, F.col(limit).cast("long").alias("_need")).agg(F.count(F.lit(1)).alias("_n")))
    edge = None
    for i in range(len(names)):
        path = names[: i + 1]
        inside = left if edge is None else left.drop("_need").join(edge, [*keys, *names[:i]])
        sums = inside.groupBy(*keys, *path, "_need").agg(F.sum("_n").alias("_n"))
        reached = F.sum("_n").over(Window.partitionBy(*keys).orderBy(names[i]))
        sums = sums.withColumn("_before", reached - F.col("_n"))
        here = (F.col("_before") < F.col("_need")) & (F.col("_before") + F.col("_n") >= F.col("_need"))
        edge = sums.where(here).select(*keys, *path, (F.col("_need") - F.col("_before")).alias("_need"))
    edges = edge.select(*keys, F.struct(*names).alias("_edge"), "_need")
    placed = settled(lookup_join(rows, edges, keys, "left").withColumn("_cell", F.struct(*names)))
    extra = [*names, "_edge", "_need", "_cell"]
    before = placed.where(F.col("_edge").isNull() | (F.col("_cell") < F.col("_edge"))).drop(*extra)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    last = placed.where(F.col("_cell") == F.col("_edge")).withColumn("_rank", rank).where(F.col("_rank") <= F.col("_need"))
    return before.unionByName(last.drop(*extra, "_rank"))


def _changes(batch: pa.RecordBatch, keys: Sequence[str], last: list | None) -> np.ndarray:
    """Whether a row has the keys of the row before it; ``last`` holds the keys before the batch."""
    same = np.ones(batch.num_rows, bool)
    for i, key in enumerate(keys):
        column = batch.column(key)
        now, before = column.slice(1), column.slice(0, len(column) - 1)
        equal = pc.or_kleene(pc.equal(now, before), pc.and_(pc.is_null(now), pc.is_null(before)))
        same[1:] &= np.asarray(pc.fill_null(equal, False))
        same[0] &= last is not None and column[0].as_py() == last[i]
    return same


def previous_by_scan(df: DataFrame, keys: Sequence[str], order: Sequence[str], carried: dict[str, str], parts: int | None = None) -> DataFrame:
    """Add the previous row's values, whether there is one (``has_previous``) and the 0-based ``position`` per key.

    A prefix scan over partitions: rows are dealt by range of key and order, so a key of any size is spread evenly; each task
    passes once through its sorted range and keeps one row; a row per range then tells every range what the ranges before
    it hold of its first key, and the rows of that key are moved on. ``parts`` is the number of ranges, by default that of
    shuffle partitions. Ranges are read twice and must be the same both times, so exchanges must be reused.
    """
    spark, keys, order = df.sparkSession, list(keys), list(order)
    if spark.conf.get("spark.sql.exchange.reuse", "true").lower() != "true":
        raise ValueError("a distributed scan needs spark.sql.exchange.reuse")
    dealt = df.repartitionByRange(parts or int(spark.conf.get("spark.sql.shuffle.partitions")), *keys, *order).sortWithinPartitions(*keys, *order)
    names, kept = list(carried), dealt.schema.fields
    dealt = dealt.withColumn("_part", F.spark_partition_id())  # a task's own number moves where the result is part of a union
    extra = T.StructType.fromDDL("has_previous boolean, position long, _lead boolean")
    before = [T.StructField(f"_b{i}", dealt.schema[c].dataType) for i, c in enumerate(names)]
    inner = T.StructType([*dealt.schema.fields, *before, *extra.fields])

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """Each batch with: same key as before, place in the key's rows of this range, row of the range's first key."""
        last, count, lead = None, 0, True
        for batch in batches:
            if batch.num_rows:
                same = _changes(batch, keys, last)
                starts = np.flatnonzero(~same)
                run = np.maximum.accumulate(np.where(same, -1, np.arange(len(same))))
                place = np.where(run < 0, np.arange(len(same)) + count, np.arange(len(same)) - run)
                fresh = starts[1:] if last is None else starts  # the first row of a range begins its first key
                leading = np.arange(len(same)) < (fresh[0] if len(fresh) else len(same)) if lead else np.zeros(len(same), bool)
                lead, count = lead and not len(fresh), int(place[-1]) + 1
                last = [batch.column(k)[-1].as_py() for k in keys]
                yield batch, same, place, leading

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch, same, place, leading in passed(batches):
            mask, shifted = pa.array(same), []
            for i, name in enumerate(names):
                column = batch.column(name)
                head = pa.nulls(1, column.type) if held is None else held[i]
                shifted.append(pc.if_else(mask, pa.concat_arrays([head, column.slice(0, len(column) - 1)]), pa.nulls(len(column), column.type)))
            held = [pa.concat_arrays([batch.column(n).slice(batch.num_rows - 1)]) for n in names]
            yield pa.RecordBatch.from_arrays([*batch.columns, *shifted, mask, pa.array(place), pa.array(leading)], names=inner.names)

    ends = T.StructType([T.StructField("_part", T.IntegerType()),
                         *[T.StructField(f"_{at}{i}", dealt.schema[k].dataType) for at in "fl" for i, k in enumerate(keys)],
                         *[T.StructField(f"_v{i}", dealt.schema[c].dataType) for i, c in enumerate(names)], *T.StructType.fromDDL("_tail long, _whole boolean").fields])

    def end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = None
        for batch, same, place, leading in passed(batches):
            first = first or [batch.column(k).slice(0, 1) for k in ("_part", *keys)]
            end = batch.num_rows - 1
            row = [*first, *[batch.column(c).slice(end) for c in (*keys, *names)], pa.array([int(place[-1]) + 1]), pa.array([bool(leading[-1])])]
        if first:
            yield pa.RecordBatch.from_arrays(row, names=ends.names)

    across = Window.orderBy("_part")  # one row per range
    same_key = reduce(and_, [F.col(f"_f{i}").eqNullSafe(F.lag(f"_l{i}").over(across)) for i in range(len(keys))])
    known = F.lag("_part").over(across).isNotNull()
    linked = dealt.mapInArrow(end, ends).select("*", (known & same_key).alias("_on"), F.struct(F.lit(1), *[F.col(f"_v{i}") for i in range(len(names))]).alias("_last"))
    # a new stretch of one key begins where a range holds more than the key it goes on with
    stretch = linked.withColumn("_stretch", F.sum(F.when(F.col("_whole") & F.col("_on"), 0).otherwise(1)).over(across.rowsBetween(Window.unboundedPreceding, 0)))
    held = stretch.withColumn("_held", F.sum("_tail").over(Window.partitionBy("_stretch").orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)))
    carry = held.select("_part", F.when(F.col("_on"), F.lag("_held").over(across)).alias("_offset"), F.when(F.col("_on"), F.lag("_last").over(across)).alias("_carry"))

    scanned = dealt.mapInArrow(scan, inner).join(F.broadcast(carry), "_part", "left")
    edge = F.col("_lead") & (F.col("position") == 0) & F.col("_offset").isNotNull()
    return scanned.select(
        *[F.col(f"`{f.name}`") for f in kept],
        *[F.when(edge, F.col("_carry")[f"_v{i}"]).otherwise(F.col(f"_b{i}")).alias(carried[c]) for i, c in enumerate(names)],
        (F.col("has_previous") | edge).alias("has_previous"),
        F.when(F.col("_lead"), F.col("position") + F.coalesce("_offset", F.lit(0))).otherwise(F.col("position")).alias("position"),
    )


def first_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int) -> DataFrame:
    """The first ``n`` rows per key. Spark cuts every task to ``n`` rows per key before the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(window)).where(F.col("_rank") <= n).drop("_rank")
