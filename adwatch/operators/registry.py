"""Platforms, model versions, runs and extractor versions as folds over append-only events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adwatch import fixed
from adwatch.operators.ordering import earliest, latest, previous_by_scan
from adwatch.operators.skew import lookup_join
from adwatch.session import settled

MODEL_KEY = ("agent", "model_name", "prompt_version", "prompt_hash")


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str]):
    condition = F.lit(True)
    for k in keys:
        condition = condition & left[k].eqNullSafe(right[k])
    return condition


def null_safe_lookup(rows: DataFrame, dimension: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Add ``value`` of the dimension row with the same key, nulls equal to nulls."""
    side = dimension.select(*[F.col(k).alias(f"_{k}") for k in keys], value)
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return rows.join(side, condition, "left").drop(*[f"_{k}" for k in keys])


def new_dimension_rows(incoming: DataFrame, existing: DataFrame, keys: Sequence[str], id_column: str) -> DataFrame:
    """Keys of ``incoming`` that ``existing`` lacks, with an id that depends on the key alone.

    The id is a 128-bit hash, in hex, of the key as JSON with its nulls, so a null that moves gives another id.
    """
    fresh = incoming.select(*keys).distinct()
    missing = fresh.join(existing, _same(fresh, existing, keys), "left_anti")
    text = F.to_json(F.array(*[F.col(k).cast("string") for k in keys]))
    return missing.select(F.md5(text).alias(id_column), *keys)


def platform_availability(platforms: DataFrame, coded: DataFrame, selector_platforms: DataFrame) -> DataFrame:
    """Platforms with the flag that some extractor, coded or by selectors, exists."""
    equipped = extractor_names(coded, selector_platforms).withColumn("_yes", F.lit(True))
    return platforms.join(equipped, "name", "left").withColumn(
        "extractor_available", F.coalesce("_yes", F.lit(False))
    ).drop("_yes")


def pending_versions(candidates: DataFrame) -> DataFrame:
    """Selector candidates as extractor versions that wait for a decision.

    ``candidates`` is ``(platform, selectors, source, repair_history, validation, created_at)``; history and validation may
    be any structure and are kept as JSON. The id depends on the row's content, so a repeated insert gives the same rows.
    """
    as_text = lambda c: F.col(c) if dict(candidates.dtypes)[c] == "string" else F.to_json(c, {"ignoreNullFields": "false"})
    rows = candidates.withColumn("repair_history", as_text("repair_history")).withColumn("validation", as_text("validation"))
    content = F.to_json(F.array("platform", F.to_json("selectors"), "source", "repair_history", "validation", F.col("created_at").cast("string")))
    return rows.select(
        F.conv(F.substring(F.sha2(content, 256), 1, 15), 16, 10).cast("long").alias("version_id"), "platform", "selectors",
        F.lit("pending").alias("status"), "source", "repair_history", "validation", "created_at",
        F.lit(None).cast("timestamp").alias("decided_at"), F.lit(None).cast("string").alias("decided_by"))


def extractor_names(coded: DataFrame, selector_platforms: DataFrame) -> DataFrame:
    """All platform names that have an extractor."""
    return coded.select("name").union(selector_platforms.select("name")).distinct()


def reconcile_registry(
    platforms: DataFrame, sites: DataFrame, coded: DataFrame, selector_platforms: DataFrame
) -> DataFrame:
    """Known platforms and exploration sites side by side, with the kind of extractor each has.

    The stored address wins over a site's. Order by ``extractor_available`` descending, then ``platform``.
    """
    known = platforms.select(F.col("name").alias("platform"), F.col("base_url").alias("_own"), F.lit(True).alias("_db"))
    explored = earliest(
        sites.select("platform", F.col("base_url").alias("_site"), F.lit(True).alias("_b")), ["platform"], ["_site"], ["_site", "_b"]
    )
    by_code = coded.select(F.col("name").alias("platform"), F.lit(True).alias("_code")).distinct()
    by_selectors = selector_platforms.select(F.col("name").alias("platform"), F.lit(True).alias("_sel")).distinct()
    merged = known.join(explored, "platform", "full_outer").join(by_code, "platform", "left").join(by_selectors, "platform", "left")
    no = F.lit(False)
    kind = F.when(F.col("_code"), fixed.KIND_CODE).when(F.col("_sel"), fixed.KIND_SELECTORS).otherwise(fixed.KIND_NONE)
    return merged.select(
        "platform",
        F.when(F.col("_db"), F.col("_own")).otherwise(F.col("_site")).alias("base_url"),
        F.coalesce("_db", no).alias("in_db"),
        F.coalesce("_b", no).alias("mode_b"),
        kind.alias("kind"),
        (F.coalesce("_code", no) | F.coalesce("_sel", no)).alias("extractor_available"),
        F.col("_sel").alias("active_selectors_present"),
    )


def run_state(starts: DataFrame, ends: DataFrame) -> DataFrame:
    """Runs from their start and end events: ``running`` until an end arrives, then the last end's status."""
    begun = starts.select("run_id", "mode", "trigger", "started_at")
    closed = latest(ends, ["run_id"], ["finished_at", "event_id"], ["status", "error", "finished_at"])
    return begun.join(closed, "run_id", "left").withColumn("status", F.coalesce("status", F.lit("running")))


def version_parts(versions: DataFrame, decisions: DataFrame) -> DataFrame:
    """Mergeable state of extractor versions, one row per version: ``(version_id, platform, initial, first)``.

    ``versions`` is ``(version_id, platform, initial)``: ``initial`` marks versions active from the start.
    ``decisions`` is ``(decision_id, version_id, decision, decided_at, decided_by)`` with ``approve`` or ``reject``.
    Only a pending version can be decided, so of its decisions the first is kept. A decision may come in an earlier
    batch than its version: both halves may be null until they meet in :func:`merge_versions`.
    """
    moment = F.struct("decided_at", "decision_id", "decision", "decided_by").alias("first")
    taken = decisions.where(F.col("version_id").isNotNull()).select("version_id", moment)
    halves = versions.select("version_id", "platform", "initial").unionByName(taken, allowMissingColumns=True)
    return merge_versions(halves)


def merge_versions(states: DataFrame) -> DataFrame:
    """One row per version from partial states; their order and grouping don't matter, and a repeated one changes nothing."""
    return states.groupBy("version_id").agg(F.min("platform").alias("platform"), F.max("initial").alias("initial"), F.min("first").alias("first"))


def version_statuses(state: DataFrame) -> DataFrame:
    """Current status of every version of a merged state.

    An approval retires the version that was active on the platform, at the time of that approval. The approvals of a
    platform are read backwards in one scan over sorted ranges: the row before is the approval that came next.
    Approvals at the same time are ordered by their decision.
    """
    known = settled(state.where(F.col("platform").isNotNull()))
    first, shown = F.col("first"), ("version_id", "platform", "status", "decided_at", "decided_by")
    own = (first["decided_at"].alias("decided_at"), first["decided_by"].alias("decided_by"))
    candidates = known.where(~F.col("initial"))
    open_ = candidates.where(first.isNull()).select("version_id", "platform", F.lit("pending").alias("status"), *own)
    refused = candidates.where(first["decision"] == "reject").select("version_id", "platform", F.lit("rejected").alias("status"), *own)
    approved = candidates.where(first["decision"] == "approve").select(
        "version_id", "platform", *own, (-F.unix_micros(first["decided_at"].cast("timestamp"))).alias("_back"), (-first["decision_id"]).alias("_tie"))
    chained = previous_by_scan(approved, ["platform"], ["_back", "_tie"], {"decided_at": "_next"})
    retired = F.col("has_previous")
    chained = chained.withColumn("status", F.when(retired, "superseded").otherwise("active")).withColumn(
        "decided_at", F.when(retired, F.col("_next")).otherwise(F.col("decided_at")))
    edges = approved.groupBy("platform").agg(F.min("decided_at").alias("decided_at"), F.lit("superseded").alias("status"))
    seeds = known.where("initial").select("version_id", "platform", F.lit(None).cast("string").alias("decided_by"))
    seeds = lookup_join(seeds, edges, ["platform"], "left").withColumn("status", F.coalesce("status", F.lit("active")))
    parts = [part.select(*shown) for part in (open_, refused, chained, seeds)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def extractor_states(versions: DataFrame, decisions: DataFrame) -> DataFrame:
    """Current status of every extractor version; see :func:`version_parts` and :func:`version_statuses`."""
    return version_statuses(version_parts(versions, decisions))


def active_versions(states: DataFrame) -> DataFrame:
    return states.where(F.col("status") == "active")


def active_platforms(states: DataFrame) -> DataFrame:
    """Platforms with an active version."""
    return active_versions(states).select(F.col("platform").alias("name")).distinct()


def several_active(states: DataFrame) -> DataFrame:
    """Platforms with more than one active version: must stay empty."""
    return active_versions(states).groupBy("platform").agg(F.count(F.lit(1)).alias("active")).where(F.col("active") > 1)


def candidates_with_active(versions: DataFrame, status: str = "pending") -> DataFrame:
    """Versions of one status with the selectors active on their platform, null when there are none."""
    active = active_versions(versions).select("platform", F.col("selectors").alias("active_selectors"))
    return versions.where(F.col("status") == status).join(active, "platform", "left")


def decided_history(states: DataFrame, platform: str | None = None) -> DataFrame:
    """Versions someone decided on; the undecided seed stays out."""
    decided = states.where(F.col("decided_at").isNotNull())
    return decided if platform is None else decided.where(F.col("platform") == platform)


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count of each table."""
    counts = [df.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n")) for name, df in tables.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out
