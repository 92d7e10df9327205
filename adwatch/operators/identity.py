"""Current state and change history of ads, folded from append-only observations.

An observation is one appearance of an ad in a run. Nothing is updated in place: the state of an ad is an
associative fold, so partial folds of batches can be merged in any grouping.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adwatch.operators.ordering import earliest, previous_by_scan

KEY = ("platform", "external_id")
ORDER = ("observed_at", "seq")


def partial_state(observations: DataFrame, keys: Sequence[str] = KEY, order: Sequence[str] = ORDER) -> DataFrame:
    """Fold observations to ``first_seen_at, last_seen_at, observation_count`` and the latest row of each ad.

    The latest values win with their nulls. ``_at`` keeps the position of the latest row for later merges.
    """
    carried = [c for c in observations.columns if c not in (*keys, *order)]
    at = F.struct(*order)
    return observations.groupBy(*keys).agg(
        F.min(order[0]).alias("first_seen_at"),
        F.max(order[0]).alias("last_seen_at"),
        F.count(F.lit(1)).alias("observation_count"),
        F.max_by(F.struct(*carried), at).alias("latest"),
        F.max(at).alias("_at"),
    )


def merge_states(parts: DataFrame, keys: Sequence[str] = KEY, smallest: Sequence[str] = ()) -> DataFrame:
    """Merge partial states of the same ads; ``smallest`` names further columns that keep their minimum."""
    return parts.groupBy(*keys).agg(
        *[F.min(c).alias(c) for c in smallest],
        F.min("first_seen_at").alias("first_seen_at"),
        F.max("last_seen_at").alias("last_seen_at"),
        F.sum("observation_count").alias("observation_count"),
        F.max_by("latest", "_at").alias("latest"),
        F.max("_at").alias("_at"),
    )


def current_listings(observations: DataFrame, keys: Sequence[str] = KEY, order: Sequence[str] = ORDER) -> DataFrame:
    """One row per ad: history columns plus the latest values."""
    return flat_state(partial_state(observations, keys, order), keys)


def flat_state(state: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    return state.select(*keys, "first_seen_at", "last_seen_at", "observation_count", "latest.*")


def persist_balance(observations: DataFrame, run: str = "run_id") -> DataFrame:
    """Per run: ads received, first sightings, repeats, and rows skipped for want of an identity."""
    known = F.col("external_id").isNotNull() & (F.col("external_id") != "")
    first = earliest(observations.where(known), KEY, ORDER, [run])
    inserted = first.groupBy(run).agg(F.count(F.lit(1)).alias("inserted"))
    totals = observations.groupBy(run).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(~F.coalesce(known, F.lit(False))).alias("skipped")
    )
    fresh = F.coalesce("inserted", F.lit(0))
    return totals.join(inserted, run, "left").select(
        run, "total", fresh.alias("inserted"), (F.col("total") - F.col("skipped") - fresh).alias("observed"), "skipped"
    )


def content_changes(
    observations: DataFrame, keys: Sequence[str] = KEY, order: Sequence[str] = ORDER, parts: int | None = None
) -> DataFrame:
    """Every appearance with the previous content hash and whether the content changed.

    One pass over sorted ranges of (ad, time), so an ad seen very often is spread over tasks as evenly as all others.
    """
    seen = previous_by_scan(observations, keys, order, {"content_hash": "previous_hash"}, parts)
    first = ~F.col("has_previous")
    return seen.select(
        *observations.columns, "previous_hash", "position", first.alias("is_first"),
        (~first & ~F.col("content_hash").eqNullSafe(F.col("previous_hash"))).alias("changed"))


def unique_ads(ads: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First occurrence of every key in source order."""
    return earliest(ads, keys, order)
