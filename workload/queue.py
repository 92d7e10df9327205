"""The investigation queue over events, customers and nations."""

from __future__ import annotations

from pyspark.sql import functions as F

from adwatch.functions import display as D
from adwatch.operators import checks, ordering, paging
from adwatch.operators import queue as Q
from workload import query
from workload import views as V
from workload.streams import work_folder

_LATEST = """latest_score AS (
  SELECT listing_id, arg_max(category, (scored_at, score_id)) AS category,
         arg_max(suspicion_score, (scored_at, score_id)) AS suspicion_score, arg_max(run_id, (scored_at, score_id)) AS run_id,
         arg_max(rationale, (scored_at, score_id)) AS rationale, arg_max(rag_ref, (scored_at, score_id)) AS rag_ref,
         max(scored_at) AS scored_at
  FROM scores GROUP BY listing_id)"""
_DECIDED = """decided AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY listing_id ORDER BY decided_at DESC, feedback_id DESC) AS rn FROM feedback)
  WHERE rn = 1)"""
_QUEUE_SQL = V.ctes(V.PLATFORMS, V.LISTINGS, V.SCORES, V.FEEDBACK, V.RUNS, _LATEST, _DECIDED) + """
SELECT l.listing_id, l.title, l.price_amount, l.price_currency, l.url, p.name AS platform, l.seller_label, l.location,
       s.category, s.suspicion_score::DOUBLE AS suspicion_score, d.decision AS review_decision, r.mode AS run_mode,
       {stamp} AS last_seen
FROM listings l JOIN platforms p USING (platform_id)
LEFT JOIN latest_score s USING (listing_id) LEFT JOIN runs r ON r.run_id = s.run_id LEFT JOIN decided d ON d.listing_id = l.listing_id
""".replace("{stamp}", V.stamp_sql("l.last_seen_at"))

_COLUMNS = ["listing_id", "title", "price_amount", "price_currency", "url", "platform", "seller_label", "location", "category"]


def _shown(df):
    return df.select(
        *_COLUMNS, F.col("suspicion_score").cast("double"), "review_decision", "run_mode", V.stamp("last_seen_at").alias("last_seen")
    )


def _history(spark, sf, **filters):
    return Q.queue_history(
        V.listings(spark, sf), V.platforms(spark, sf), V.scores(spark, sf), V.feedback(spark, sf), V.runs(spark, sf), **filters
    )


def _page(spark, sf, order, limit, offset=0):
    return Q.queue_page(
        V.listings(spark, sf), V.platforms(spark, sf), V.scores(spark, sf), V.feedback(spark, sf), V.runs(spark, sf), order, limit, offset
    )


@query("queue_history", _QUEUE_SQL)
def queue_history(spark, sf):
    return _shown(_history(spark, sf))


@query("queue_min_score", _QUEUE_SQL + "WHERE s.suspicion_score >= 0.2")
def queue_min_score(spark, sf):
    return _shown(_history(spark, sf, min_score=0.2))


@query("queue_category", _QUEUE_SQL + "WHERE s.suspicion_score >= 0.1 AND s.category = 'arme'")
def queue_category(spark, sf):
    return _shown(_history(spark, sf, min_score=0.1, category="arme"))


@query("queue_page", _QUEUE_SQL + "ORDER BY l.last_seen_at DESC, l.listing_id LIMIT 50 OFFSET 100")
def queue_page(spark, sf):
    return _shown(_page(spark, sf, "recent", 50, 100))


@query("queue_by_price", _QUEUE_SQL + "ORDER BY coalesce(l.price_amount, 0) DESC, l.listing_id LIMIT 50")
def queue_by_price(spark, sf):
    return _shown(_page(spark, sf, "price_desc", 50))


_RUN_SQL = V.ctes(V.PLATFORMS, V.LISTINGS, V.SCORES, V.FEEDBACK, V.RUNS, _DECIDED) + """
SELECT s.score_id, s.run_id, l.listing_id, l.title, l.price_amount, l.location, p.name AS platform, s.category,
       s.suspicion_score::DOUBLE AS suspicion_score, d.decision AS review_decision, r.mode AS run_mode
FROM scores s JOIN listings l USING (listing_id) JOIN platforms p USING (platform_id)
LEFT JOIN runs r ON r.run_id = s.run_id LEFT JOIN decided d ON d.listing_id = l.listing_id
"""


def _run_queue(spark, sf, **filters):
    found = Q.queue_run(
        V.listings(spark, sf), V.platforms(spark, sf), V.scores(spark, sf), V.feedback(spark, sf), V.runs(spark, sf), **filters
    )
    return found


def _run_shown(df):
    return df.select(
        "score_id", "run_id", "listing_id", "title", "price_amount", "location", "platform", "category",
        F.col("suspicion_score").cast("double"), "review_decision", "run_mode",
    )


@query("queue_runs", _RUN_SQL)
def queue_runs(spark, sf):
    return _run_shown(_run_queue(spark, sf))


@query("queue_one_run", _RUN_SQL + "WHERE s.run_id = 7 AND s.suspicion_score >= 0.05 ORDER BY s.suspicion_score DESC, l.listing_id, s.score_id LIMIT 100")
def queue_one_run(spark, sf):
    found = _run_queue(spark, sf, run_id=7, min_score=0.05)
    return _run_shown(paging.page(found, [*Q.queue_order("score_desc"), F.col("score_id")], 100))


@query("latest_score", V.ctes(V.SCORES) + f"""
SELECT listing_id, score_id, category, suspicion_score::DOUBLE AS suspicion_score, {V.stamp_sql('scored_at')} AS scored FROM (
  SELECT *, row_number() OVER (PARTITION BY listing_id ORDER BY scored_at DESC, score_id DESC) AS rn FROM scores) WHERE rn = 1""")
def latest_score(spark, sf):
    newest = Q.latest_scores(V.scores(spark, sf), "score_id", "category", "suspicion_score", "scored_at")
    return newest.select("listing_id", "score_id", "category", F.col("suspicion_score").cast("double"), V.stamp("scored_at").alias("scored"))


@query("listing_detail", V.ctes(V.PLATFORMS, V.LISTINGS, V.SCORES, V.FEEDBACK, _LATEST, _DECIDED) + f"""
SELECT l.listing_id, l.external_id, l.title, l.description, p.name AS platform, s.category, s.suspicion_score::DOUBLE AS suspicion_score,
       s.rationale, s.rag_ref, {V.stamp_sql('s.scored_at')} AS scored, d.decision, d.investigator_ref, d.comment, {V.stamp_sql('d.decided_at')} AS decided
FROM listings l JOIN platforms p USING (platform_id) LEFT JOIN latest_score s USING (listing_id) LEFT JOIN decided d ON d.listing_id = l.listing_id""")
def listing_detail(spark, sf):
    found = Q.listing_detail(V.listings(spark, sf), V.platforms(spark, sf), V.scores(spark, sf), V.feedback(spark, sf))
    return found.select(
        "listing_id", "external_id", "title", "description", "platform", "score.category",
        F.col("score.suspicion_score").cast("double").alias("suspicion_score"), "score.rationale",
        F.array_join("score.rag_refs", ",").alias("rag_ref"), V.stamp("score.scored_at").alias("scored"),
        "feedback.decision", "feedback.investigator_ref", "feedback.comment", V.stamp("feedback.decided_at").alias("decided"),
    )


_PENDING_SQL = V.ctes(V.LISTINGS, V.FEEDBACK, V.INGESTED) + f"""
SELECT f.feedback_id, f.listing_id, f.score_id, f.category_corrected, {V.stamp_sql('f.decided_at')} AS decided, l.external_id, l.title, l.location
FROM feedback f JOIN listings l USING (listing_id)
WHERE f.decision = 'confirme' AND NOT EXISTS (SELECT 1 FROM ingested i WHERE i.feedback_id = f.feedback_id)
"""


def _pending(spark, sf):
    return Q.pending_cases(V.feedback(spark, sf), V.ingested(spark, sf), V.listings(spark, sf))


def _pending_shown(df):
    return df.select(
        "feedback_id", "listing_id", "score_id", "category_corrected", V.stamp("decided_at").alias("decided"), "external_id", "title",
        F.col("structured.location").alias("location"),
    )


@query("pending_cases", _PENDING_SQL)
def pending_cases(spark, sf):
    return _pending_shown(_pending(spark, sf))


@query("pending_head", _PENDING_SQL + "ORDER BY f.decided_at, f.feedback_id LIMIT 100")
def pending_head(spark, sf):
    return _pending_shown(Q.oldest_first(_pending(spark, sf), "decided_at", "feedback_id", 100))


@query("confirmed_export", V.ctes(V.PLATFORMS, V.LISTINGS, V.SCORES, V.FEEDBACK) + f"""
SELECT f.feedback_id, f.decision, f.category_corrected, f.comment, {V.stamp_sql('f.decided_at')} AS decided, f.investigator_ref, l.title, l.url,
       l.price_amount, l.content_hash, p.name AS platform, s.category, s.suspicion_score::DOUBLE AS suspicion_score
FROM feedback f JOIN listings l USING (listing_id) LEFT JOIN platforms p USING (platform_id) LEFT JOIN scores s ON s.score_id = f.score_id
WHERE f.decision = 'confirme'""")
def confirmed_export(spark, sf):
    found = Q.confirmed_cases(V.feedback(spark, sf), V.listings(spark, sf), V.platforms(spark, sf), V.scores(spark, sf))
    return found.select(
        "feedback_id", "decision", "category_corrected", "comment", V.stamp("decided_at").alias("decided"), "investigator_ref", "title",
        "url", "price_amount", "content_hash", "platform", "category", F.col("suspicion_score").cast("double"),
    )


@query("queue_labels", V.ctes(V.FEEDBACK) + """
SELECT feedback_id, CASE decision WHEN 'confirme' THEN 'Confirmé' WHEN 'rejete' THEN 'Écarté' ELSE 'À vérifier' END AS decision_label,
       CASE category_corrected WHEN 'tabac' THEN 'Tabac' WHEN 'alcool' THEN 'Alcool' WHEN 'cites' THEN 'CITES (espèces protégées)' WHEN 'viande' THEN 'Viande'
         WHEN 'contrefacon' THEN 'Contrefaçon' WHEN 'arme' THEN 'Arme' WHEN 'autre' THEN 'Autre (hors taxonomie)' WHEN 'aucune' THEN 'Aucune' END AS category_label,
       CASE WHEN feedback_id % 3 = 0 THEN 'A · Surveillance' WHEN feedback_id % 3 = 1 THEN 'B · Exploration' ELSE '—' END AS origin
FROM feedback""")
def queue_labels(spark, sf):
    mode = F.when(F.col("feedback_id") % 3 == 0, "A").when(F.col("feedback_id") % 3 == 1, "B")
    return V.feedback(spark, sf).select(
        "feedback_id", D.decision_label(F.col("decision")).alias("decision_label"),
        D.category_label(F.col("category_corrected")).alias("category_label"), D.origin_label(mode).alias("origin"),
    )


@query("risk_bands", V.ctes(V.SCORES) + """
SELECT score_id, CASE WHEN suspicion_score >= 0.7 THEN 'eleve' WHEN suspicion_score >= 0.4 THEN 'moyen' ELSE 'normal' END AS band,
       suspicion_score::DOUBLE AS score, printf('%.0f', suspicion_score::DOUBLE * 100)::INTEGER AS points
FROM scores""")
def risk_bands(spark, sf):
    score = D.tolerant_score(F.col("suspicion_score"))
    return V.scores(spark, sf).select("score_id", D.risk_band(score).alias("band"), score.alias("score"), D.points(score).alias("points"))


@query("incoherent_scores", V.ctes(V.SCORES) + """
SELECT score_id, category, suspicion_score::DOUBLE AS suspicion_score FROM scores
WHERE (suspicion_score < 0.3 AND category <> 'aucune') OR (suspicion_score > 0.5 AND category = 'aucune')""")
def incoherent_scores(spark, sf):
    return checks.incoherent_scores(V.scores(spark, sf)).select("score_id", "category", F.col("suspicion_score").cast("double"))


@query("invalid_codes", """
SELECT event_id, event_type FROM events WHERE event_type NOT IN ('view', 'click', 'purchase')""")
def invalid_codes(spark, sf):
    return checks.invalid_codes(V.table(spark, sf, "events"), "event_type", ["view", "click", "purchase"]).select("event_id", "event_type")


@query("page_count", "SELECT count(*) AS total, greatest(1, ceil(count(*) / 20.0))::BIGINT AS pages FROM orders")
def page_count(spark, sf):
    return paging.page_count(V.table(spark, sf, "orders"), 20)


@query("orders_page", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40")
def orders_page(spark, sf):
    rows, _ = paging.numbered_page(V.table(spark, sf, "orders"), [F.desc("o_totalprice"), F.asc("o_orderkey")], 3, 20)
    return rows.select("o_orderkey", "o_totalprice")


@query("orders_middle_page", """
WITH o AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS rn, count(*) OVER () AS n FROM orders)
SELECT o_orderkey, o_totalprice FROM o WHERE rn // 20 = ((n + 19) // 20) // 2 - 1""")
def orders_middle_page(spark, sf):
    """The page in the middle, through a map of ranges that is written and read again."""
    orders, path = V.table(spark, sf, "orders"), f"{work_folder(spark)}/map"
    paging.PageMap.of(orders, [("o_totalprice", False), ("o_orderkey", True)], 4_096).store(spark, path)
    pages = paging.PageMap.load(spark, path)
    rows, _ = pages.numbered(orders, -(-pages.total // 20) // 2, 20)
    return rows.select("o_orderkey", "o_totalprice")


@query("orders_keyset_page", """
WITH last AS (SELECT o_totalprice, o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1 OFFSET 19)
SELECT o.o_orderkey, o.o_totalprice FROM orders o, last
WHERE o.o_totalprice < last.o_totalprice OR (o.o_totalprice = last.o_totalprice AND o.o_orderkey > last.o_orderkey)
ORDER BY o.o_totalprice DESC, o.o_orderkey LIMIT 20""")
def orders_keyset_page(spark, sf):
    orders = V.table(spark, sf, "orders")
    edge = orders.orderBy(F.desc("o_totalprice"), "o_orderkey").offset(19).limit(1).first()
    return paging.page_after(orders, "o_totalprice", edge["o_totalprice"], "o_orderkey", edge["o_orderkey"], 20).select("o_orderkey", "o_totalprice")


@query("run_head", V.ctes(V.RUNS) + f"SELECT run_id, mode, {V.stamp_sql('started_at')} AS started FROM runs ORDER BY started_at DESC, run_id DESC LIMIT 10")
def run_head(spark, sf):
    from adwatch.plans.report import run_list

    return Q.newest_first(run_list(V.runs(spark, sf)), "started_at", "run_id", 10).select("run_id", "mode", V.stamp("started_at").alias("started"))


@query("latest_event_per_user", """
SELECT user_id, event_id, event_type FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""")
def latest_event_per_user(spark, sf):
    return ordering.latest(V.table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"]).select(
        "user_id", "event_id", "event_type"
    )
