"""Run statistics and run reports over events."""

from __future__ import annotations

from pyspark.sql import functions as F

from adwatch import fixed
from adwatch.operators import queue as Q
from adwatch.operators import score as S
from adwatch.plans import report as R
from workload import query
from workload import views as V

_ADS = """ads AS (
  SELECT s.*, l.title, l.url, l.price_amount, l.location, l.content_hash, p.name AS platform
  FROM scores s JOIN listings l USING (listing_id) JOIN platforms p USING (platform_id))"""
_BASE = V.ctes(V.PLATFORMS, V.LISTINGS, V.SCORES, V.RUNS, _ADS)


def _ads(spark, sf):
    return Q.run_listings(V.scores(spark, sf), V.listings(spark, sf), V.platforms(spark, sf))


@query("run_stats", V.ctes(V.SCORES) + """,
c AS (SELECT run_id, category, count(*) AS scored, count(*) FILTER (WHERE suspicion_score >= 0.7) AS alerts FROM scores GROUP BY 1, 2)
SELECT run_id, sum(scored)::BIGINT AS collected, sum(scored)::BIGINT AS scored, sum(alerts)::BIGINT AS alerts,
       coalesce(string_agg(category || '=' || alerts, ',' ORDER BY alerts DESC, category) FILTER (WHERE category <> 'aucune' AND alerts > 0), '') AS per_category
FROM c GROUP BY 1""")
def run_stats(spark, sf):
    shown = F.array_join(F.transform("per_category", lambda e: F.concat(e["category"], F.lit("="), e["n"].cast("string"))), ",")
    return S.run_stats(V.scores(spark, sf)).withColumn("per_category", shown)


@query("ads_per_site", V.ctes(V.PLATFORMS, V.LISTINGS) + """
SELECT p.name AS site, count(l.listing_id) AS ads FROM platforms p LEFT JOIN listings l USING (platform_id) GROUP BY 1""")
def ads_per_site(spark, sf):
    sites = V.platforms(spark, sf).select("platform_id", F.col("name").alias("site"))
    return S.ads_per_site(V.listings(spark, sf), sites, ("platform_id",)).select("site", "ads")


@query("report_synthesis", V.ctes(V.SCORES) + """
SELECT run_id, count(*) AS analysed, count(*) FILTER (WHERE suspicion_score >= 0.7) AS revision,
       count(*) FILTER (WHERE suspicion_score >= 0.4 AND suspicion_score < 0.7) AS surveillance, count(*) FILTER (WHERE suspicion_score < 0.4) AS normal
FROM scores GROUP BY 1""")
def report_synthesis(spark, sf):
    return R.synthesis(V.scores(spark, sf))


_SIGNALS = "signals AS (SELECT run_id, category, count(*) AS n FROM scores WHERE suspicion_score >= 0.4 GROUP BY 1, 2)"


@query("report_signals", V.ctes(V.SCORES, _SIGNALS) + "SELECT * FROM signals")
def report_signals(spark, sf):
    return R.signals_by_category(V.scores(spark, sf))


@query("report_other_categories", V.ctes(V.SCORES, V.RUNS, _SIGNALS) + """
SELECT s.run_id, string_agg(category, ',' ORDER BY n DESC, category) AS other_categories FROM signals s JOIN runs r USING (run_id)
WHERE len(r.targets) > 0 AND NOT list_contains(r.targets, category) AND category <> 'aucune' GROUP BY 1""")
def report_other_categories(spark, sf):
    targets = V.runs(spark, sf).select("run_id", F.col("params.target_categories").alias("target_categories"))
    found = R.other_categories(R.signals_by_category(V.scores(spark, sf)), targets)
    return found.select("run_id", F.array_join("other_categories", ",").alias("other_categories"))


@query("report_ads", _BASE + """
SELECT a.run_id, CASE WHEN list_contains(r.targets, a.category) THEN 0 ELSE 1 END AS priority, a.score_id, a.listing_id AS id, a.title AS titre,
       a.category AS categorie, a.suspicion_score::DOUBLE AS score, a.price_amount AS prix, a.location AS localisation, a.platform AS plateforme,
       a.url, CASE WHEN a.url IS NULL AND a.platform = r.site_platform THEN r.site_url END AS lien_site, a.rationale AS justification,
       a.content_hash AS empreinte
FROM ads a LEFT JOIN runs r USING (run_id)""")
def report_ads(spark, sf):
    lines = R.report_ads(_ads(spark, sf), V.runs(spark, sf))
    return lines.orderBy(*R.report_order()).drop("exact_score", "devise")


def _label_sql(c: str) -> str:
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fixed.CATEGORY_LABELS.items())
    return f"CASE {c} {cases} ELSE {c} END"


_LABELS = f"array_to_string(list_transform(targets, lambda t: {_label_sql('t')}), ', ')"


@query("report_headers", V.ctes(V.PLATFORMS, V.LISTINGS, V.SCORES, V.RUNS, _ADS, _SIGNALS) + f""",
counts AS (SELECT run_id, count(*) AS analysed, count(*) FILTER (WHERE suspicion_score >= 0.7) AS revision,
       count(*) FILTER (WHERE suspicion_score >= 0.4 AND suspicion_score < 0.7) AS surveillance, count(*) FILTER (WHERE suspicion_score < 0.4) AS normal
       FROM ads GROUP BY 1),
cats AS (SELECT run_id, string_agg(category || '=' || n, ',' ORDER BY n DESC, category) AS c FROM signals GROUP BY 1)
SELECT run_id, mode, 'seed ' || run_id AS prompt, seen / 10.0::DOUBLE AS duree_s, analysed, revision, surveillance, normal, coalesce(c, '') AS par_categorie,
  CASE WHEN mode = 'B' THEN
    'En exploration (Mode B), l''agent a parcouru librement le site désigné. La requête « seed ' || run_id || ' »' ||
    CASE WHEN len(targets) > 0 THEN ' (rattachée à : ' || {_LABELS} || ')' ELSE '' END ||
    ' a orienté l''exploration et la priorisation des résultats. LLM-EXPAND en a dérivé ' || (run_id % 4 + 1) || ' formulation(s) associée(s) pour guider l''agent.'
  ELSE 'La recherche ' || CASE WHEN len(targets) > 0 THEN 'a ciblé la catégorie ' || {_LABELS} ELSE 'n''a ciblé aucune catégorie précise' END ||
    ' et a généré ' || (run_id % 4 + 1) || ' termes de recherche.' END
  || ' La collecte a relevé ' || seen || ' annonces. ' ||
  CASE WHEN run_id % 5 > 0 THEN 'L''analyse a produit ' || (run_id % 5) || ' signal(aux) prioritaire(s) sur ' || seen || ' annonces analysées (' || (run_id % 5) || ' Arme).'
  ELSE 'L''analyse a examiné ' || seen || ' annonces, sans signal prioritaire.' END AS deroule
FROM runs LEFT JOIN counts USING (run_id) LEFT JOIN cats USING (run_id)""")
def report_headers(spark, sf):
    heads = R.report_headers(_ads(spark, sf), V.runs(spark, sf))
    shown = F.array_join(F.transform("par_categorie", lambda e: F.concat(e["category"], F.lit("="), e["n"].cast("string"))), ",")
    return heads.select(
        "run_id", "mode", "prompt", "duree_s", "analysed", "revision", "surveillance", "normal", shown.alias("par_categorie"), "deroule"
    )


@query("site_links", V.ctes(V.RUNS) + "SELECT run_id, site_platform AS platform, site_url FROM runs")
def site_links(spark, sf):
    return R.site_links(V.runs(spark, sf))


@query("report_documents", _BASE + """
, placed AS (SELECT run_id, listing_id, count(*) OVER (PARTITION BY run_id) AS analysees,
       row_number() OVER (PARTITION BY run_id ORDER BY CASE WHEN list_contains(targets, category) THEN 0 ELSE 1 END, suspicion_score DESC, score_id) - 1 AS place
       FROM ads JOIN runs USING (run_id))
SELECT run_id, (place // 20)::INTEGER AS part, any_value(analysees) AS analysees, count(*)::INTEGER AS lines,
       string_agg(listing_id, ',' ORDER BY place) AS ads FROM placed GROUP BY 1, 2""")
def report_documents(spark, sf):
    ads, runs = _ads(spark, sf), V.runs(spark, sf)
    documents = R.report_documents(R.report_headers(ads, runs), R.report_ads(ads, runs), part_ads=20)
    return documents.select(
        "run_id", "part", "synthese.analysees", F.size("annonces").alias("lines"),
        F.array_join(F.transform("annonces", lambda a: a["id"].cast("string")), ",").alias("ads"),
    )
