"""Joins of facts with one-row-per-key tables that hold when one key owns a large share of the facts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SMALL_ROWS = 10_000
HOT_KEYS = 50_000
HOT_ROWS = 1_000_000


def lookup_join(facts: DataFrame, table: DataFrame, keys: Sequence[str], how: str = "inner", small_rows: int = SMALL_ROWS) -> DataFrame:
    """Join facts with a narrow table that has one row per key.

    The table is counted up to ``small_rows``: below, every task gets it whole; beyond, :func:`spread_join` takes over.
    """
    if table.limit(small_rows + 1).count() <= small_rows:
        return facts.join(F.broadcast(table), list(keys), how)
    return spread_join(facts, table, keys, how)


def hot_keys(facts: DataFrame, keys: Sequence[str], most: int = HOT_KEYS, least_rows: int = HOT_ROWS) -> DataFrame:
    """Keys that own more than 1/``most`` of the facts, with the number of parts to cut them into.

    There are fewer than ``most`` of them whatever the data. Only key columns are read, and counts are combined
    before the shuffle.
    """
    counts = facts.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    limit = F.greatest(F.lit(least_rows), counts.agg(F.sum("_n").alias("s")).scalar() / most)
    sized = counts.withColumn("_limit", limit)
    return sized.where(F.col("_n") > F.col("_limit")).select(*keys, F.ceil(F.col("_n") / F.col("_limit")).cast("int").alias("_parts"))


def spread_join(
    facts: DataFrame, table: DataFrame, keys: Sequence[str], how: str = "inner", most: int = HOT_KEYS, least_rows: int = HOT_ROWS,
    tasks: int | None = None,
) -> DataFrame:
    """Shuffle join with one row per key on the right; hot keys are cut into parts and their rows repeated per part.

    The hot keys travel to all tasks: their number is bounded by ``most``. Other keys keep one part, so the right
    side grows by at most 2 x ``most`` rows. Rows without a key match nothing and are spread as well. ``tasks`` is the number
    of tasks that meet, where the session's would be too few.
    """
    keys = list(keys)
    hot = F.broadcast(hot_keys(facts, keys, most, least_rows))
    whole = F.coalesce("_parts", F.lit(1))
    spread = facts.join(hot, keys, "left")
    simple = [f.name for f in facts.schema.fields if isinstance(f.dataType, T.AtomicType)]
    draw = F.xxhash64(*simple)
    no_key = reduce(or_, [F.col(k).isNull() for k in keys])
    part = F.when(whole > 1, F.pmod(draw, whole)).when(no_key, F.pmod(draw, F.lit(most))).otherwise(0)
    spread = spread.withColumn("_part", part.cast("int")).drop("_parts")
    repeated = table.join(hot, keys, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), whole - 1))).drop("_parts")
    if tasks is not None:
        spread = spread.repartition(tasks, *keys, "_part")
    return spread.join(repeated, [*keys, "_part"], how).drop("_part")
