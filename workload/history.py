"""Ad state and history over events."""

from __future__ import annotations

from pyspark.sql import functions as F

from adwatch.operators import identity as I
from workload import query
from workload import views as V

STATE_SQL = V.ctes(V.OBSERVATIONS) + f"""
SELECT platform, external_id, {V.stamp_sql('min(observed_at)')} AS first_seen, {V.stamp_sql('max(observed_at)')} AS last_seen, count(*) AS observation_count,
       arg_max({{title}}, (observed_at, seq)) AS title, max(price_amount) FILTER (WHERE rn = 1) AS price_amount,
       max(description) FILTER (WHERE rn = 1) AS description, max(content_hash) FILTER (WHERE rn = 1) AS content_hash
FROM (SELECT *, row_number() OVER (PARTITION BY platform, external_id ORDER BY observed_at DESC, seq DESC) AS rn FROM observations WHERE external_id IS NOT NULL)
GROUP BY 1, 2""".replace("{title}", "title")


def state_shown(df):
    return df.select(
        "platform", "external_id", V.stamp("first_seen_at").alias("first_seen"), V.stamp("last_seen_at").alias("last_seen"),
        "observation_count", "title", "price_amount", "description", "content_hash",
    )


def known(spark, sf):
    return V.observations(spark, sf).where(F.col("external_id").isNotNull())


@query("listing_state", STATE_SQL)
def listing_state(spark, sf):
    return state_shown(I.current_listings(known(spark, sf)))


@query("persist_balance", V.ctes(V.OBSERVATIONS) + """,
firsts AS (SELECT platform, external_id, arg_min(run_id, (observed_at, seq)) AS run_id FROM observations WHERE external_id IS NOT NULL GROUP BY 1, 2),
fresh AS (SELECT run_id, count(*) AS inserted FROM firsts GROUP BY 1)
SELECT run_id, total, coalesce(inserted, 0) AS inserted, total - skipped - coalesce(inserted, 0) AS observed, skipped
FROM (SELECT run_id, count(*) AS total, count(*) FILTER (WHERE external_id IS NULL) AS skipped FROM observations GROUP BY 1) LEFT JOIN fresh USING (run_id)""")
def persist_balance(spark, sf):
    return I.persist_balance(V.observations(spark, sf))


@query("content_changes", V.ctes(V.OBSERVATIONS) + """
SELECT seq, platform, external_id, content_hash, previous_hash, position, position = 0 AS is_first,
       position > 0 AND content_hash IS DISTINCT FROM previous_hash AS changed
FROM (SELECT *, lag(content_hash) OVER w AS previous_hash, row_number() OVER w - 1 AS position FROM observations WHERE external_id IS NOT NULL
      WINDOW w AS (PARTITION BY platform, external_id ORDER BY observed_at, seq))""")
def content_changes(spark, sf):
    seen = known(spark, sf).select("platform", "external_id", "content_hash", "observed_at", "seq")
    return I.content_changes(seen).select("seq", "platform", "external_id", "content_hash", "previous_hash", "position", "is_first", "changed")


@query("unique_documents", """
SELECT sha256(text) AS fingerprint, min(doc_id) AS doc_id, arg_min(source, doc_id) AS source FROM documents GROUP BY 1""")
def unique_documents(spark, sf):
    docs = V.table(spark, sf, "documents").select(F.sha2("text", 256).alias("fingerprint"), "doc_id", "source")
    return I.unique_ads(docs, ["fingerprint"], ["doc_id"]).select("fingerprint", "doc_id", "source")


@query("content_hash", V.ctes(V.OBSERVATIONS) + "SELECT seq, content_hash FROM observations")
def content_hash(spark, sf):
    return V.observations(spark, sf).select("seq", "content_hash")
