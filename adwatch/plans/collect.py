"""The two collection jobs: surveillance of known platforms and free exploration."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adwatch import fixed
from adwatch.functions import responses as R
from adwatch.functions import url as U
from adwatch.functions.display import ad_query_text
from adwatch.functions.hashing import content_hash
from adwatch.functions.numbers import float_text
from adwatch.functions.text import blank as blank_text
from adwatch.operators import checks, extract, retrieve, score, scope, search
from adwatch.operators.skew import lookup_join
from adwatch.session import settled

AD_COLUMNS = ("external_id", "url", "title", "price_amount", "price_currency", "seller", "location", "description")


def in_scope(pages: DataFrame, allowlist: Sequence[str], blocklist: Sequence[str] = ()) -> DataFrame:
    """Pages that may be collected. The test reads ``url`` only, before any wide column is touched."""
    return pages.where(scope.scope_verdict(F.col("url"), allowlist, blocklist)["allowed"])


def surveillance_ads(
    pages: DataFrame, versions: DataFrame, terms: Sequence[str] = (), json_ld: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """Detail pages ``(platform, page_no, run_id, url, html)`` to ads, and the break verdict per run and platform.

    Platforms in ``json_ld`` are read from structured data, the others by their active selectors. Ads of a broken
    platform are held back, incomplete and nameless ones are dropped, and the terms filter what is left.
    """
    coded = F.col("platform").isin(list(json_ld))
    checked = settled(extract.selector_ads(extract.extract_fields(pages.where(~coded), versions)))
    verdict = extract.break_rate(checked, ["page_no"], keys=("run_id", "platform"))
    sound = verdict.where(~F.col("is_broken")).select("run_id", "platform")
    by_selectors = lookup_join(checked.where(F.size("missing") == 0), sound, ["run_id", "platform"])
    columns = ["run_id", "platform", "page_no", *AD_COLUMNS]
    ads = by_selectors.select(*columns)
    if json_ld:
        ads = ads.unionByName(extract.product_ads(pages.where(coded)).select(*columns))
    ads = checks.identified(ads)
    return search.matching_terms(ads, terms, F.col("title"), F.col("description")), verdict


def stale_run_stats(verdict: DataFrame, trials: DataFrame) -> DataFrame:
    """Runs whose extractor broke: nothing collected, and which candidate, if any, repairs it."""
    best = trials.where("chosen").select("platform", F.col("complete").alias("repair_ok"), F.col("attempt").alias("candidate_id"))
    broken = verdict.where("is_broken").select("run_id", "platform", "sample_missing")
    return broken.join(best, "platform", "left").select(
        "run_id", "platform", F.lit(0).alias("collected"), F.lit(0).alias("scored"), F.lit(True).alias("extractor_stale"),
        F.coalesce("repair_ok", F.lit(False)).alias("repair_ok"), "candidate_id",
    )


def explored_ads(answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Exploration answers ``(session_id, run_id, site, platform, base_url, raw)`` to ads, and a status per session.

    ``ok``: ads found; ``empty``: no text, or an empty list; ``invalid``: no list, or a list without one valid ad.
    """
    # Only texts with a bracket travel to Python.
    cut = answers.withColumn("_array", R.first_json_array(F.when(F.contains("raw", F.lit("[")), F.col("raw"))))
    parsed = cut.withColumn("_blank", blank_text(F.col("raw"))).withColumn("_list", R.array_items(F.col("_array"))).drop("raw", "_array")
    read = settled(parsed.withColumn("_items", F.size("_list")).withColumn("_ads", R.explored_ads(F.col("_list"))).drop("_list"))
    status = (
        F.when(F.col("_blank") | (F.col("_items") == 0), "empty")
        .when((F.coalesce("_items", F.lit(-1)) < 0) | (F.size("_ads") == 0), "invalid")
        .otherwise("ok")
    )
    sessions = read.select(
        "session_id", "run_id", "site", status.alias("status"), F.greatest(F.coalesce(F.size("_ads"), F.lit(0)), F.lit(0)).alias("ads")
    )
    ads = read.select("session_id", "run_id", "site", "platform", "base_url", F.posexplode("_ads").alias("position", "_ad"))
    ads = ads.select("session_id", "run_id", "site", "platform", "base_url", "position", "_ad.*")
    price = F.nullif(F.regexp_replace("price_json", '^"|"$', ""), F.lit("null"))
    identity = U.fallback_identity(F.col("url"), F.col("title"), price, F.col("base_url"))
    return ads.withColumn("external_id", identity), sessions


def observations(ads: DataFrame, observed_at: Column, seq: Column, source: str | None = None, tag: Column | None = None) -> DataFrame:
    """Ads of a run as appearances with a content hash, ready to append."""
    none = F.lit(None).cast("string")
    price = F.col("price_json") if "price_json" in ads.columns else float_text(F.col("price_amount"))
    hashed = content_hash({**{n: F.col(n) for n in fixed.CONTENT_FIELDS}, "price_amount": price})
    return ads.select(
        "platform", "external_id", "run_id", "url", "title", "description", "price_amount", "price_currency",
        F.col("seller").alias("seller_label"),
        F.struct(
            F.col("location"),
            (F.lit(source) if source else none).alias("source"),
            (tag if tag is not None else none).alias("source_platform_tag"),
        ).alias("structured"),
        hashed.alias("content_hash"),
        observed_at.alias("observed_at"),
        seq.alias("seq"),
    )


def with_rules(
    ads: DataFrame,
    vectors: DataFrame,
    rules: DataFrame,
    key: str = "ad_id",
    retriever: Callable[[DataFrame, DataFrame, str], DataFrame] = retrieve.retrieve_rules,
) -> DataFrame:
    """Attach the nearest rules. ``vectors`` is ``(ad_id, embedding)`` of each ad's query text.

    Any ``retriever`` that returns ``(ad_id, rank, rule_id)`` can replace the exact search.
    """
    hits = retriever(vectors, rules.select("rule_id", "embedding"), key)
    return ads.join(retrieve.rule_titles(hits, rules, key), key, "left")


def query_texts(ads: DataFrame, key: str = "ad_id") -> DataFrame:
    """Texts to embed, one per ad."""
    return ads.select(key, ad_query_text(F.col("title"), F.col("description"), fixed.QUERY_PREFIX).alias("text"))


def scored_ads(ads: DataFrame, system_prompt: str, model: str, prompt_version: str, scorer=None, parallelism: int | None = None) -> DataFrame:
    """Score facts with ``ok``. Write them before splitting good from unusable answers, or the scorer runs twice."""
    return score.score_batch(score.with_prompt(ads), system_prompt, model, prompt_version, scorer, parallelism)
