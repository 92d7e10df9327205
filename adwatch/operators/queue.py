"""The investigation queue and its neighbours: detail, pending cases, export, lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adwatch.functions.display import tolerant_score
from adwatch.operators.ordering import latest
from adwatch.operators.paging import page
from adwatch.operators.skew import lookup_join, spread_join

LISTING_COLUMNS = ("title", "price_amount", "price_currency", "url", "last_seen_at", "seller_label")


def latest_scores(scores: DataFrame, *columns: str) -> DataFrame:
    """The named columns of the newest score per ad; no others are read."""
    return latest(scores, ["listing_id"], ["scored_at", "score_id"], columns)


def latest_decisions(feedback: DataFrame, *columns: str) -> DataFrame:
    """The named columns of the newest decision per ad."""
    return latest(feedback, ["listing_id"], ["decided_at", "feedback_id"], columns)


def _wanted(df: DataFrame, min_score: float | None, category: str | None) -> DataFrame:
    """Optional filters are added only when asked for, so they can be pushed down."""
    if min_score is not None:
        df = df.where(F.col("suspicion_score") >= min_score)
    if category is not None:
        df = df.where(F.col("category") == category)
    return df


def _ad(listings: DataFrame) -> DataFrame:
    return listings.select("listing_id", "platform_id", *LISTING_COLUMNS, F.col("structured.location").alias("location"))


def _named(df: DataFrame, platforms: DataFrame, how: str = "inner") -> DataFrame:
    return df.join(platforms.select("platform_id", F.col("name").alias("platform")), "platform_id", how).drop("platform_id")


def _reviewed(df: DataFrame, feedback: DataFrame) -> DataFrame:
    decided = latest_decisions(feedback, "decision").withColumnRenamed("decision", "review_decision")
    return df.join(decided, "listing_id", "left")


def _with_mode(df: DataFrame, runs: DataFrame) -> DataFrame:
    return lookup_join(df, runs.select("run_id", F.col("mode").alias("run_mode")), ["run_id"], "left").drop("run_id")


def queue_history(
    listings: DataFrame,
    platforms: DataFrame,
    scores: DataFrame,
    feedback: DataFrame,
    runs: DataFrame,
    min_score: float | None = None,
    category: str | None = None,
) -> DataFrame:
    """All ads with their latest score and latest decision. ``min_score`` also drops ads without a score."""
    newest = _wanted(latest_scores(scores, "category", "suspicion_score", "run_id"), min_score, category)
    how = "left" if min_score is None and category is None else "inner"
    return _with_mode(_reviewed(_named(_ad(listings), platforms).join(newest, "listing_id", how), feedback), runs)


def queue_page(
    listings: DataFrame, platforms: DataFrame, scores: DataFrame, feedback: DataFrame, runs: DataFrame, order: str, limit: int, offset: int = 0
) -> DataFrame:
    """One page of the unfiltered queue by ``recent`` or ``price_desc``, keys that the ads themselves hold.

    The page is cut before anything is joined to it, and scores, decisions and runs are read for its ads only.
    """
    if order not in ("recent", "price_desc"):
        raise ValueError(f"the order {order} needs the scores of all ads")
    cards = F.broadcast(page(_named(_ad(listings), platforms), queue_order(order), limit, offset))  # at most paging.MOST rows
    ids = cards.select("listing_id")
    semi = lambda facts: facts.join(F.broadcast(ids), "listing_id", "left_semi")
    newest = latest_scores(semi(scores), "category", "suspicion_score", "run_id")
    found = _reviewed(cards.join(F.broadcast(newest), "listing_id", "left"), semi(feedback))
    modes = runs.select("run_id", F.col("mode").alias("run_mode"))
    return found.join(modes, "run_id", "left").drop("run_id").orderBy(*queue_order(order))


def queue_run(
    listings: DataFrame,
    platforms: DataFrame,
    scores: DataFrame,
    feedback: DataFrame,
    runs: DataFrame,
    run_id: int | None = None,
    min_score: float | None = None,
    category: str | None = None,
) -> DataFrame:
    """Scores of one run (or of every run) with their ads. An ad scored twice in a run stands twice."""
    asked = scores if run_id is None else scores.where(F.col("run_id") == run_id)
    asked = _wanted(asked.select("score_id", "listing_id", "run_id", "category", "suspicion_score"), min_score, category)
    # Everything with one row per ad comes together first; the scores, where an ad may be hot, join once.
    cards = _reviewed(_named(_ad(listings), platforms), feedback)
    modes = runs.select("run_id", F.col("mode").alias("run_mode"))
    return lookup_join(spread_join(asked, cards, ["listing_id"]), modes, ["run_id"], "left")


def queue_order(order: str, last_seen: str = "last_seen_at") -> list[Column]:
    """Sort keys of the queue: ``score_desc``, ``score_asc``, ``price_desc`` or ``recent``; the id breaks ties."""
    score, price = tolerant_score(F.col("suspicion_score")), tolerant_score(F.col("price_amount"))
    keys = {
        "score_desc": score.desc(),
        "score_asc": score.asc(),
        "price_desc": price.desc(),
        "recent": F.col(last_seen).desc_nulls_last(),
    }
    return [keys[order], F.col("listing_id").asc()]


def listing_detail(listings: DataFrame, platforms: DataFrame, scores: DataFrame, feedback: DataFrame) -> DataFrame:
    """Every ad with its latest score and latest decision as structs, null when there is none."""
    score_fields = ["category", "suspicion_score", "rationale", "rag_refs", "scored_at"]
    newest = latest_scores(scores, *score_fields)
    newest = newest.select("listing_id", F.struct(*score_fields).alias("score"))
    decision_fields = ["decision", "investigator_ref", "comment", "decided_at"]
    decided = latest_decisions(feedback, *decision_fields)
    decided = decided.select("listing_id", F.struct(*decision_fields).alias("feedback"))
    return _named(listings, platforms).join(newest, "listing_id", "left").join(decided, "listing_id", "left")


def pending_cases(feedback: DataFrame, ingested: DataFrame, listings: DataFrame) -> DataFrame:
    """Confirmed decisions not ingested yet, with their ads."""
    waiting = feedback.where(F.col("decision") == "confirme").join(ingested.select("feedback_id"), "feedback_id", "left_anti")
    ads = listings.select("listing_id", "platform_id", "external_id", "title", "description", "structured")
    return spread_join(waiting.select("feedback_id", "listing_id", "score_id", "category_corrected", "decided_at"), ads, ["listing_id"])


def confirmed_cases(feedback: DataFrame, listings: DataFrame, platforms: DataFrame, scores: DataFrame) -> DataFrame:
    """Confirmed decisions with ad, platform and the score they answered."""
    ads = listings.select("listing_id", "platform_id", "title", "url", "price_amount", "price_currency", "content_hash")
    confirmed = feedback.where(F.col("decision") == "confirme").select(
        "feedback_id", "listing_id", "score_id", "decision", "category_corrected", "comment", "decided_at", "investigator_ref"
    )
    joined = spread_join(confirmed, _named(ads, platforms, "left"), ["listing_id"])
    return joined.join(scores.select("score_id", "category", "suspicion_score"), "score_id", "left")


def run_listings(scores: DataFrame, listings: DataFrame, platforms: DataFrame) -> DataFrame:
    """Scored ads of every run as a report needs them."""
    ads = listings.select(
        "listing_id", "platform_id", "title", "price_amount", "price_currency", "url", "content_hash",
        F.col("structured.location").alias("location"),
    )
    asked = scores.select("run_id", "score_id", "listing_id", "category", "suspicion_score", "rationale")
    return spread_join(asked, _named(ads, platforms), ["listing_id"])


def newest_first(df: DataFrame, time: str, tie: str, n: int | None = None) -> DataFrame:
    """Rows newest first; ``n`` keeps the head of the list (runs, candidates, decisions, audit tail)."""
    ordered = df.orderBy(F.col(time).desc_nulls_last(), F.col(tie).desc())
    return ordered if n is None else ordered.limit(n)


def oldest_first(df: DataFrame, time: str, tie: str, n: int | None = None) -> DataFrame:
    ordered = df.orderBy(F.col(time).asc_nulls_first(), F.col(tie).asc())
    return ordered if n is None else ordered.limit(n)
