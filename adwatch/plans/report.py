"""Run reports: header, categories and ordered ads of all runs at once.

A report stays three flat tables. Its ads are never gathered into one row, so a run of any size is only a range of
sorted rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adwatch import fixed
from adwatch.functions.display import run_narrative, tolerant_score
from adwatch.functions.numbers import round_even
from adwatch.operators.skew import lookup_join


def _code() -> Column:
    return F.coalesce(F.nullif(F.col("category"), F.lit("")), F.lit(fixed.NO_CATEGORY))


def synthesis(ads: DataFrame, run: str = "run_id") -> DataFrame:
    """Per run: ads analysed, to review, to watch, and normal."""
    score = tolerant_score(F.col("suspicion_score"))
    review = score >= fixed.ALERT_THRESHOLD
    watch = (score >= fixed.WATCH_THRESHOLD) & ~review
    return ads.groupBy(run).agg(
        F.count(F.lit(1)).alias("analysed"),
        F.count_if(review).alias("revision"),
        F.count_if(watch).alias("surveillance"),
        F.count_if(~review & ~watch).alias("normal"),
    )


def signals_by_category(ads: DataFrame, run: str = "run_id") -> DataFrame:
    """Per run and category: ads at or above the watch threshold."""
    strong = ads.where(tolerant_score(F.col("suspicion_score")) >= fixed.WATCH_THRESHOLD)
    return strong.groupBy(run, _code().alias("category")).agg(F.count(F.lit(1)).alias("n"))


def other_categories(signals: DataFrame, targets: DataFrame, run: str = "run_id") -> DataFrame:
    """Categories found beside the targets of a run, most frequent first; runs without a target have none."""
    wanted = targets.where(F.size("target_categories") > 0).select(run, "target_categories")
    others = signals.join(wanted, run).where(
        ~F.array_contains("target_categories", F.col("category")) & (F.col("category") != fixed.NO_CATEGORY)
    )
    found = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("d"), "category")))
    return others.groupBy(run).agg(F.transform(found, lambda e: e["category"]).alias("other_categories"))


def site_links(runs: DataFrame) -> DataFrame:
    """Base address per run and platform from the run's snapshot: its site list, or its single platform.

    The last entry of a platform wins.
    """
    sites = F.transform("config_snapshot.sites", lambda e: F.struct(e["platform"].alias("platform"), e["base_url"].alias("base_url")))
    single = F.array(F.struct(F.col("config_snapshot.platform").alias("platform"), F.col("config_snapshot.base_url").alias("base_url")))
    rows = runs.select("run_id", F.posexplode(F.coalesce(sites, single)).alias("_i", "s")).where(
        (F.col("s.platform") != "") & (F.col("s.base_url") != "")
    )
    return rows.groupBy("run_id", F.col("s.platform").alias("platform")).agg(F.max_by("s.base_url", "_i").alias("site_url"))


def report_ads(ads: DataFrame, runs: DataFrame) -> DataFrame:
    """Report lines of all runs; ``priority`` 0 marks a target category. See :func:`report_order`."""
    targeted = runs.select("run_id", F.col("params.target_categories").alias("_targets"))
    links = site_links(runs)
    joined = lookup_join(lookup_join(ads, targeted, ["run_id"], "left"), links, ["run_id", "platform"], "left")
    first = F.coalesce(F.array_contains("_targets", F.col("category")), F.lit(False))
    has_url = F.col("url").isNotNull() & (F.col("url") != "")
    score = tolerant_score(F.col("suspicion_score"))
    return joined.select(
        "run_id",
        F.when(first, 0).otherwise(1).alias("priority"),
        score.alias("exact_score"),
        F.col("score_id"),
        F.col("listing_id").alias("id"),
        F.col("title").alias("titre"),
        _code().alias("categorie"),
        round_even(score, 3).alias("score"),
        F.col("price_amount").alias("prix"),
        F.col("price_currency").alias("devise"),
        F.col("location").alias("localisation"),
        F.col("platform").alias("plateforme"),
        "url",
        F.when(~has_url, F.col("site_url")).alias("lien_site"),
        F.col("rationale").alias("justification"),
        F.col("content_hash").alias("empreinte"),
    )


def report_order() -> list[Column]:
    """Target categories first, then score; by run. A sort on these keys range-partitions even one huge run."""
    return [F.col("run_id"), F.col("priority"), F.col("exact_score").desc(), F.col("score_id")]


def report_headers(ads: DataFrame, runs: DataFrame, generated_at: Column | None = None) -> DataFrame:
    """One row per run: narrative, thresholds, counts, categories and targets."""
    score = tolerant_score(F.col("suspicion_score"))
    review = score >= fixed.ALERT_THRESHOLD
    watch = (score >= fixed.WATCH_THRESHOLD) & ~review
    # one pass over the ads, to a row per run and category
    cells = ads.groupBy("run_id", _code().alias("category")).agg(
        F.count(F.lit(1)).alias("analysed"), F.count_if(review).alias("revision"), F.count_if(watch).alias("surveillance"))
    strong = F.col("revision") + F.col("surveillance")
    listed = F.array_sort(F.collect_list(F.when(strong > 0, F.struct((-strong).alias("d"), "category"))))
    found = cells.groupBy("run_id").agg(
        *[F.sum(c).alias(c) for c in ("analysed", "revision", "surveillance")],
        F.sum(F.col("analysed") - strong).alias("normal"),
        F.transform(listed, lambda e: F.struct(e["category"].alias("category"), (-e["d"]).alias("n"))).alias("par_categorie"),
    )
    wanted = F.coalesce("params.target_categories", F.array().cast("array<string>"))
    beside = F.filter("par_categorie", lambda e: ~F.array_contains(wanted, e["category"]) & (e["category"] != fixed.NO_CATEGORY))
    others = F.when(F.size(wanted) > 0, F.transform(beside, lambda e: e["category"]))
    none = F.array().cast("array<string>")
    steps = F.col("stats.etapes")
    mode = F.upper(F.coalesce("params.mode", F.lit("")))
    exploration = mode.isin("B", "B1", "B2") | F.coalesce("stats.mode_b", F.lit(False)) | steps["exploration"].isNotNull()
    narrative = run_narrative(
        F.coalesce(exploration, F.lit(False)),
        F.coalesce(F.size(steps["exploration"]["sites"]), F.lit(0)),
        F.get("params.seeds", F.lit(0)),
        F.when(exploration, F.col("params.target_categories")).otherwise(steps["expand"]["categories"]),
        F.when(exploration, F.size(F.coalesce("params.generated_terms", none))).otherwise(steps["expand"]["termes"]),
        steps["collecte"]["annonces"],
        steps["scoring"]["scorees"],
        steps["scoring"]["alertes"],
        F.coalesce(steps["scoring"]["par_categorie"], F.array().cast("array<struct<category:string,n:bigint>>")),
    )
    zero = F.lit(0)
    return (
        runs.join(found, "run_id", "left").withColumn("other_categories", others)
        .select(
            "run_id",
            "mode",
            "status",
            (generated_at if generated_at is not None else F.current_timestamp()).alias("generated_at"),
            F.array_join(F.coalesce("params.seeds", none), "; ").alias("prompt"),
            F.col("stats.duree_s").alias("duree_s"),
            F.lit(fixed.ALERT_THRESHOLD).alias("seuil_revision"),
            F.lit(fixed.WATCH_THRESHOLD).alias("seuil_surveillance"),
            F.when(steps.isNotNull(), narrative).otherwise("").alias("deroule"),
            F.coalesce("params.target_categories", none).alias("categorie_demandee"),
            F.coalesce("other_categories", none).alias("autres_detectees"),
            *[F.coalesce(c, zero).alias(c) for c in ("analysed", "revision", "surveillance", "normal")],
            F.coalesce("par_categorie", F.array().cast("array<struct<category:string,n:bigint>>")).alias("par_categorie"),
        )
    )


def run_list(runs: DataFrame) -> DataFrame:
    """Runs with their statistics, for the run filter; order by ``started_at`` descending."""
    return runs.select("run_id", "mode", "status", "stats", "started_at")


PART_ADS = 10_000


def _placed(ads: DataFrame) -> DataFrame:
    """Report lines with ``place``, their rank in the run from 0.

    Lines are counted by cells of the order, a priority and a score of three places, of which a run has a bounded number;
    a line's place is the count of the cells before plus its rank in its cell and a hash slice of it.
    """
    cell = ads.withColumn("_cell", F.struct(F.col("priority"), (-F.col("exact_score")).alias("s")))
    cell = cell.withColumn("_slice", F.col("score_id").cast("long").bitwiseAND(F.lit(-4096)))
    sizes = cell.groupBy("run_id", "_cell", "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("run_id").orderBy("_cell", "_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("run_id", "_cell", "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("run_id", "_cell", "_slice").orderBy("score_id")) - 1
    joined = cell.withColumn("_in", inside).join(starts, ["run_id", "_cell", "_slice"])
    return joined.withColumn("place", F.col("_start") + F.col("_in")).drop("_cell", "_slice", "_start", "_in")


def report_documents(headers: DataFrame, ads: DataFrame, part_ads: int = PART_ADS) -> DataFrame:
    """Nested documents: header, counts and ordered ads, in parts of at most ``part_ads`` ads.

    ``part`` counts from 0; every ad of a run is in exactly one part, in the run's order, and every part carries the
    header. A run without ads is one part with an empty list.
    """
    columns = [c for c in ads.columns if c not in ("run_id", "priority", "exact_score", "score_id")]
    line = F.struct(F.col("place"), F.struct(*columns).alias("ad"))
    nested = _placed(ads).groupBy("run_id", F.floor(F.col("place") / part_ads).cast("int").alias("part")).agg(
        F.transform(F.array_sort(F.collect_list(line)), lambda e: e["ad"]).alias("annonces")
    )
    counts = F.map_from_entries("par_categorie")
    empty = F.array().cast(nested.schema["annonces"].dataType)
    return headers.join(nested, "run_id", "left").select(
        "run_id",
        F.coalesce("part", F.lit(0)).alias("part"),
        F.struct("run_id", "mode", "status").alias("run"),
        "generated_at", "prompt", "duree_s",
        F.struct(F.col("seuil_revision").alias("revision"), F.col("seuil_surveillance").alias("surveillance")).alias("seuils"),
        "deroule", "categorie_demandee", "autres_detectees",
        F.struct(F.col("analysed").alias("analysees"), "revision", "surveillance", "normal", counts.alias("par_categorie")).alias("synthese"),
        F.coalesce("annonces", empty).alias("annonces"),
    )
