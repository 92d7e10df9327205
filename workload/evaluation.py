"""Detector evaluation over documents and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from adwatch.functions.numbers import round_even
from adwatch.operators import evaluate as E
from workload import query
from workload import views as V

# Keyword lists of words that occur in the driver's documents.
LISTS = {"tabac": ["the of", "ation"], "alcool": ["eau "], "cites": ["sch", "ung"], "viande": ["ción"], "contrefacon": ["http"], "arme": ["re the"]}


def _hit_sql(words):
    return "(" + " OR ".join(f"contains(low, '{w}')" for w in words) + ")"


_CATEGORY_SQL = "CASE " + " ".join(f"WHEN {_hit_sql(w)} THEN '{c}'" for c, w in LISTS.items()) + " ELSE 'aucune' END"
_BASE = f"""
ads AS (SELECT doc_id::VARCHAR AS id, lower(text) AS low, n_chars, lang, source FROM documents),
results AS (
  SELECT id, printf('%.3f', least(1.0::DOUBLE, n_chars / 3000.0::DOUBLE))::DOUBLE AS llm_score,
         CASE WHEN source IN ('src1', 'src2', 'src3', 'src4', 'src5') THEN 'tabac' ELSE 'alcool' END AS llm_category,
         {_CATEGORY_SQL} AS kw_category, ({' OR '.join(_hit_sql(w) for w in LISTS.values())}) AS kw_flag
  FROM ads),
truth AS (
  SELECT l.doc_id::VARCHAR AS id, toxic = 1 AS suspect, CASE d.lang WHEN 'fr' THEN 'alcool' WHEN 'en' THEN 'tabac' WHEN 'de' THEN 'cites' ELSE 'viande' END AS categorie,
         CASE WHEN toxic = 1 THEN CASE WHEN quality = 1 THEN 'explicite' ELSE 'implicite' END WHEN quality = 0 THEN 'piege' ELSE 'aucune' END AS difficulte,
         toxic = 0 AND quality = 0 AS piege
  FROM labels l JOIN documents d USING (doc_id)),
rows AS (SELECT * FROM ads JOIN truth USING (id) JOIN results USING (id))"""


def _results(spark, sf):
    docs = V.spread(spark, sf, "documents")
    first = F.col("source").isin("src1", "src2", "src3", "src4", "src5")
    found = E.detect_keywords(docs, F.col("text"), LISTS)
    return found.select(
        F.col("doc_id").alias("id"),
        round_even(F.least(F.lit(1.0), F.col("n_chars") / F.lit(3000.0)), 3).alias("llm_score"),
        F.when(first, "tabac").otherwise("alcool").alias("llm_category"),
        "kw_category",
        "kw_flag",
    )


def _truth(spark, sf):
    toxic, good = F.col("toxic") == 1, F.col("quality") == 1
    lang = F.col("lang")
    code = F.when(lang == "fr", "alcool").when(lang == "en", "tabac").when(lang == "de", "cites").otherwise("viande")
    level = F.when(toxic, F.when(good, "explicite").otherwise("implicite")).when(~good, "piege").otherwise("aucune")
    joined = V.table(spark, sf, "labels").join(V.table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    return joined.select(
        F.col("doc_id").alias("id"), toxic.alias("suspect"), code.alias("categorie"), level.alias("difficulte"), (~toxic & ~good).alias("piege")
    )


def _ads(spark, sf):
    return V.table(spark, sf, "documents").select(F.col("doc_id").alias("id"))


def _rows(spark, sf):
    return E.evaluation_rows(_ads(spark, sf), _truth(spark, sf), _results(spark, sf))


@query("keyword_detect", f"WITH ads AS (SELECT doc_id, lower(text) AS low FROM documents) SELECT doc_id, {_CATEGORY_SQL} AS kw_category, ({' OR '.join(_hit_sql(w) for w in LISTS.values())}) AS kw_flag FROM ads")
def keyword_detect(spark, sf):
    return E.detect_keywords(V.spread(spark, sf, "documents"), F.col("text"), LISTS).select("doc_id", "kw_category", "kw_flag")


@query("eval_rows", f"WITH {_BASE} SELECT id, suspect, categorie, difficulte, llm_score, llm_category, kw_flag, kw_category FROM rows")
def eval_rows(spark, sf):
    return _rows(spark, sf)


_DETECTORS = """, answers AS (
  SELECT 'llm_rag' AS detector, llm_score >= 0.5 AS flagged, llm_category AS found, * FROM rows
  UNION ALL SELECT 'baseline_motscles', kw_flag, kw_category, * FROM rows)"""
_COUNTS = """, counts AS (
  SELECT detector, count(*) FILTER (WHERE flagged AND suspect) AS tp, count(*) FILTER (WHERE flagged AND NOT suspect) AS fp,
         count(*) FILTER (WHERE NOT flagged AND suspect) AS fn, count(*) FILTER (WHERE NOT flagged AND NOT suspect) AS tn,
         count(*) FILTER (WHERE flagged AND suspect AND found = categorie) AS category_hits
  FROM answers GROUP BY 1)"""


@query("eval_confusion", f"WITH {_BASE}{_DETECTORS}{_COUNTS} SELECT * FROM counts")
def eval_confusion(spark, sf):
    return E.confusion(E.detectors(_rows(spark, sf)))


@query("eval_quality", f"""WITH {_BASE}{_DETECTORS}{_COUNTS},
r AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0.0::DOUBLE ELSE tp::DOUBLE / (tp + fp)::DOUBLE END AS p,
             CASE WHEN tp + fn = 0 THEN 0.0::DOUBLE ELSE tp::DOUBLE / (tp + fn)::DOUBLE END AS q FROM counts)
SELECT detector, tp, fp, fn, tn, printf('%.3f', p)::DOUBLE AS precision, printf('%.3f', q)::DOUBLE AS recall,
       printf('%.3f', CASE WHEN p + q = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * p * q / (p + q) END)::DOUBLE AS f1,
       printf('%.3f', CASE WHEN tp = 0 THEN 0.0::DOUBLE ELSE category_hits::DOUBLE / tp::DOUBLE END)::DOUBLE AS category_accuracy
FROM r""")
def eval_quality(spark, sf):
    return E.quality(E.confusion(E.detectors(_rows(spark, sf))))


@query("eval_levels", f"""WITH {_BASE}{_DETECTORS},
c AS (SELECT detector, difficulte, count(*) FILTER (WHERE flagged) AS flagged, count(*) AS total FROM answers GROUP BY 1, 2)
SELECT detector, difficulte, CASE WHEN difficulte IN ('explicite', 'implicite') THEN 'rappel' ELSE 'evitement' END AS reading,
       printf('%.3f', (CASE WHEN difficulte IN ('explicite', 'implicite') THEN flagged ELSE total - flagged END)::DOUBLE / total::DOUBLE)::DOUBLE AS value, flagged, total
FROM c""")
def eval_levels(spark, sf):
    return E.by_difficulty(E.detectors(_rows(spark, sf)))


@query("eval_pending", "SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def eval_pending(spark, sf):
    done = V.table(spark, sf, "labels").select(F.col("doc_id").alias("id"))
    return E.pending_evaluation(_ads(spark, sf), done)


@query("eval_common_ids", "SELECT doc_id::VARCHAR AS id FROM documents INTERSECT SELECT doc_id::VARCHAR FROM labels")
def eval_common_ids(spark, sf):
    return E.common_ids(_ads(spark, sf), V.table(spark, sf, "labels").select(F.col("doc_id").alias("id")))


@query("corpus_summary", f"""WITH {_BASE}
SELECT 'total' AS measure, '' AS code, count(*) AS n FROM truth UNION ALL
SELECT 'suspects', '', count(*) FILTER (WHERE suspect) FROM truth UNION ALL SELECT 'pieges', '', count(*) FILTER (WHERE piege) FROM truth UNION ALL
SELECT 'benignes', '', count(*) FILTER (WHERE NOT suspect AND NOT piege) FROM truth UNION ALL
SELECT 'difficulte', difficulte, count(*) FROM truth GROUP BY 2 UNION ALL SELECT 'categorie', categorie, count(*) FROM truth WHERE suspect GROUP BY 2""")
def corpus_summary(spark, sf):
    return E.corpus_summary(_truth(spark, sf))


_SCORED = ", scored AS (SELECT id, llm_score::DECIMAL(4,3) AS score, suspect, piege, difficulte FROM results JOIN truth USING (id))"


def _scored(spark, sf):
    return E.scored_labels(_results(spark, sf), _truth(spark, sf))


@query("score_stats", f"""WITH {_BASE}{_SCORED},
g AS (SELECT score, CASE WHEN suspect THEN 'illicites' ELSE 'licites' END AS grp FROM scored UNION ALL
      SELECT score, 'pieges' FROM scored WHERE piege UNION ALL SELECT score, 'niveau:' || difficulte FROM scored),
o AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY score) - 1 AS i, count(*) OVER (PARTITION BY grp) AS n FROM g)
SELECT grp, count(*) AS n, min(score)::DOUBLE AS min, max(score)::DOUBLE AS max, round_even(sum(score)::DOUBLE / count(*)::DOUBLE, 3) AS mean,
       max(score) FILTER (WHERE i = n // 2)::DOUBLE AS median
FROM o GROUP BY grp""")
def score_stats(spark, sf):
    return E.score_stats(E.score_groups(_scored(spark, sf)))


@query("score_histogram", f"""WITH {_BASE}{_SCORED}
SELECT b::INTEGER AS bin, count(*) FILTER (WHERE suspect) AS illicites, count(*) FILTER (WHERE NOT suspect) AS licites
FROM range(10) t(b) LEFT JOIN scored ON least(9, floor(score::DOUBLE * 10)) = b GROUP BY 1""")
def score_histogram(spark, sf):
    return E.score_histogram(_scored(spark, sf))


@query("score_separation", f"""WITH {_BASE}{_SCORED}
SELECT lo::DOUBLE AS lowest_illicit, hi::DOUBLE AS highest_licit, (lo - hi)::DOUBLE AS gap, lo > hi AS clean
FROM (SELECT min(score) FILTER (WHERE suspect) AS lo, max(score) FILTER (WHERE NOT suspect) AS hi FROM scored)""")
def score_separation(spark, sf):
    return E.separation(_scored(spark, sf))


@query("eval_ads", "SELECT p_partkey AS id, p_name AS title, p_type AS description, floor(p_retailprice)::BIGINT AS price_amount, 'CHF' AS price_currency, p_brand AS location FROM part")
def eval_ads(spark, sf):
    parts = V.table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_type").alias("description"), F.floor("p_retailprice").alias("price"),
        F.lit("CHF").alias("currency"), F.col("p_brand").alias("location"),
    )
    return E.eval_ads(parts)
