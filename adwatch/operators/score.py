"""Scoring ads and counting what a run found."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adwatch import fixed
from adwatch.functions.display import ad_prompt, rules_prompt, tolerant_score
from adwatch.functions.responses import score_response
from adwatch.functions.text import keyword_category, sha256

Scorer = Callable[[Iterator[pd.Series]], Iterator[pd.Series]]


def with_prompt(ads: DataFrame) -> DataFrame:
    """Add ``prompt``: the ad and, when an array ``rules`` is present, the rules that may apply."""
    ad = ad_prompt(*[F.col(c) for c in ("title", "description", "price_amount", "price_currency", "location")])
    rules = rules_prompt(F.col("rules")) if "rules" in ads.columns else F.lit("")
    return ads.withColumn("prompt", F.concat(ad, F.coalesce(rules, F.lit(""))))


def _annotated(scorer: Scorer) -> Scorer:
    """The scorer under the type hints that mark an iterator function."""

    def answer(prompts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from scorer(prompts)

    return answer


def score_batch(
    ads: DataFrame,
    system_prompt: str,
    model: str,
    prompt_version: str,
    scorer: Scorer | None = None,
    parallelism: int | None = None,
) -> DataFrame:
    """Add category, score, rationale and lineage to ads that carry a ``prompt``.

    ``scorer`` gets batches of prompts and yields raw answers; it is an iterator function, so a model loads once
    per task, and ``parallelism`` bounds the calls in flight. Without one, the keyword lists decide inside the
    JVM. ``ok`` is false where the answer was unusable; keep those rows apart and score them again later.
    """
    if scorer is None:
        found = keyword_category(F.concat_ws(" ", "title", "description"))
        hit = found != fixed.NO_CATEGORY
        scored = ads.withColumn(
            "_answer",
            F.struct(
                F.lit(True).alias("ok"),
                F.when(hit, 1.0).otherwise(0.0).alias("suspicion_score"),
                found.alias("category"),
                F.lit("").alias("rationale"),
            ),
        )
    else:
        answer = F.pandas_udf(_annotated(scorer), "string")
        spread = ads.repartition(parallelism) if parallelism else ads
        scored = spread.withColumn("_raw", answer("prompt")).withColumn("_answer", score_response(F.col("_raw"))).drop("_raw")
    refs = F.coalesce("rag_refs", F.array().cast("array<string>")) if "rag_refs" in ads.columns else F.array().cast("array<string>")
    return scored.select(
        *[c for c in ads.columns if c not in ("rules", "rag_refs", "prompt")],
        "_answer.*",
        refs.alias("rag_refs"),
        (F.size(refs) > 0).alias("rag_used"),
        F.lit(prompt_version).alias("prompt_version"),
        sha256(F.lit(system_prompt)).alias("prompt_hash"),
        F.lit(model).alias("model"),
    )


def is_alert(score: Column) -> Column:
    return tolerant_score(score) >= fixed.ALERT_THRESHOLD


def run_stats(scores: DataFrame, collected: DataFrame | None = None, run: str = "run_id") -> DataFrame:
    """Per run: collected, scored, alerts, and alerts per category as an array of ``struct(category, n)``.

    Counts shrink to (run, category) before anything is gathered, so the array holds at most one entry per code.
    """
    code = F.coalesce(F.nullif(F.col("category"), F.lit("")), F.lit(fixed.NO_CATEGORY))
    by_code = scores.groupBy(run, code.alias("category")).agg(
        F.count(F.lit(1)).alias("scored"), F.count_if(is_alert(F.col("suspicion_score"))).alias("alerts")
    )
    named = (F.col("category") != fixed.NO_CATEGORY) & (F.col("alerts") > 0)
    entries = F.array_sort(F.collect_list(F.when(named, F.struct((-F.col("alerts")).alias("d"), "category"))))
    stats = by_code.groupBy(run).agg(
        F.sum("scored").alias("scored"),
        F.sum("alerts").alias("alerts"),
        F.transform(entries, lambda e: F.struct(e["category"].alias("category"), (-e["d"]).alias("n"))).alias("per_category"),
    )
    if collected is None:
        return stats.select(run, F.col("scored").alias("collected"), "scored", "alerts", "per_category")
    counts = collected.groupBy(run).agg(F.count(F.lit(1)).alias("collected"))
    none = F.array().cast("array<struct<category:string,n:bigint>>")
    return counts.join(stats, run, "full_outer").select(
        run,
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("collected", "scored", "alerts")],
        F.coalesce("per_category", none).alias("per_category"),
    )


def ads_per_site(ads: DataFrame, sites: DataFrame, keys: tuple[str, ...] = ("site",)) -> DataFrame:
    """Ad counts of the chosen sites, 0 for a site without ads."""
    counts = ads.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return sites.join(counts, list(keys), "left").withColumn("ads", F.coalesce("_n", F.lit(0))).drop("_n")
