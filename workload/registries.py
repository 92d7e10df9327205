"""Platforms, model versions, runs and extractor versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from adwatch.operators import checks
from adwatch.operators import registry as R
from adwatch.streaming import ingest
from workload import query
from workload import views as V
from workload.streams import _arriving, work_folder

# --- platforms ------------------------------------------------------------------------------------------------


def _names(spark, sf, condition):
    return V.table(spark, sf, "nation").where(condition).select(F.col("n_name").alias("name"))


def _sites(spark, sf):
    """Exploration sites: suppliers' nations, some of them unknown to the platform table."""
    platform = F.concat(F.lit("NATION_"), (F.col("s_nationkey") + 10).cast("string"))
    return V.table(spark, sf, "supplier").select(platform.alias("platform"), F.concat(F.lit("https://"), F.lower("s_name"), F.lit(".test")).alias("base_url"))


@query("registry_merge", V.ctes(V.PLATFORMS) + """,
sites AS (SELECT 'NATION_' || (s_nationkey + 10) AS platform, min('https://' || lower(s_name) || '.test') AS base_url FROM supplier GROUP BY 1),
m AS (SELECT coalesce(p.name, s.platform) AS platform, CASE WHEN p.name IS NOT NULL THEN p.base_url ELSE s.base_url END AS base_url, p.name IS NOT NULL AS in_db, s.platform IS NOT NULL AS mode_b
      FROM platforms p FULL OUTER JOIN sites s ON s.platform = p.name),
c AS (SELECT n_name FROM nation WHERE n_regionkey = 0), v AS (SELECT n_name FROM nation WHERE n_regionkey < 2)
SELECT platform, base_url, in_db, mode_b, CASE WHEN platform IN (FROM c) THEN 'figé (code)' WHEN platform IN (FROM v) THEN 'sélecteurs (réparable)' ELSE '—' END AS kind,
       platform IN (FROM c) OR platform IN (FROM v) AS extractor_available, CASE WHEN platform IN (FROM v) THEN 'yes' ELSE '' END AS active_selectors_present FROM m""")
def registry_merge(spark, sf):
    merged = R.reconcile_registry(V.platforms(spark, sf), _sites(spark, sf), _names(spark, sf, "n_regionkey = 0"), _names(spark, sf, "n_regionkey < 2"))
    shown = F.when(F.col("active_selectors_present"), "yes").otherwise("")
    return merged.withColumn("active_selectors_present", shown).orderBy(F.desc("extractor_available"), "platform")


@query("platform_available", "SELECT n_name AS name, n_regionkey = 0 OR n_regionkey = 3 AS extractor_available FROM nation")
def platform_available(spark, sf):
    found = R.platform_availability(V.platforms(spark, sf), _names(spark, sf, "n_regionkey = 0"), _names(spark, sf, "n_regionkey = 3"))
    return found.select("name", "extractor_available")


@query("extractor_names", "SELECT n_name AS name FROM nation WHERE n_regionkey = 0 UNION SELECT n_name FROM nation WHERE n_regionkey < 3")
def extractor_names(spark, sf):
    return R.extractor_names(_names(spark, sf, "n_regionkey = 0"), _names(spark, sf, "n_regionkey < 3"))


@query("missing_platforms", "SELECT 'NATION_' || (s_nationkey + 10) AS name FROM supplier EXCEPT SELECT n_name FROM nation")
def missing_platforms(spark, sf):
    return checks.missing_tables(_sites(spark, sf).select(F.col("platform").alias("name")), V.platforms(spark, sf))


# --- model versions -------------------------------------------------------------------------------------------

_KEYS_SQL = """SELECT CASE c_mktsegment WHEN 'BUILDING' THEN 'LLM-SCORE' ELSE 'LLM-PARSE' END AS agent, 'm' || (c_nationkey % 5) AS model_name,
  CASE WHEN c_nationkey % 2 = 0 THEN 'v' || (c_nationkey % 3) END AS prompt_version, CASE WHEN c_nationkey % 3 = 0 THEN sha256(c_nationkey::VARCHAR) END AS prompt_hash"""


def _keys(df, *more):
    nation = F.col("c_nationkey")
    return df.select(
        "c_custkey", *more,
        F.when(F.col("c_mktsegment") == "BUILDING", "LLM-SCORE").otherwise("LLM-PARSE").alias("agent"),
        F.concat(F.lit("m"), (nation % 5).cast("string")).alias("model_name"),
        F.when(nation % 2 == 0, F.concat(F.lit("v"), (nation % 3).cast("string"))).alias("prompt_version"),
        F.when(nation % 3 == 0, F.sha2(nation.cast("string"), 256)).alias("prompt_hash"),
    )


_DIM_SQL = f"""dim AS (SELECT CASE WHEN c_acctbal > 5000 AND c_nationkey < 20 THEN agent ELSE agent || '-old' END AS agent, model_name, prompt_version, prompt_hash, count(*) AS size
  FROM ({_KEYS_SQL}, c_acctbal, c_nationkey FROM customer) GROUP BY ALL)"""


def _dimension(spark, sf):
    customers = V.table(spark, sf, "customer")
    listed = F.expr("c_acctbal > 5000 AND c_nationkey < 20")
    known = _keys(customers, listed.alias("listed")).withColumn("agent", F.when(F.col("listed"), F.col("agent")).otherwise(F.concat("agent", F.lit("-old"))))
    return known.groupBy(*R.MODEL_KEY).agg(F.count(F.lit(1)).alias("size"))


@query("model_version_lookup", f"""WITH {_DIM_SQL}
SELECT c_custkey, coalesce(size, 0) AS size FROM ({_KEYS_SQL}, c_custkey FROM customer) k LEFT JOIN dim d ON k.agent = d.agent AND k.model_name = d.model_name
  AND k.prompt_version IS NOT DISTINCT FROM d.prompt_version AND k.prompt_hash IS NOT DISTINCT FROM d.prompt_hash""")
def model_version_lookup(spark, sf):
    rows = _keys(V.table(spark, sf, "customer"))
    return R.null_safe_lookup(rows, _dimension(spark, sf), R.MODEL_KEY, "size").select("c_custkey", F.coalesce("size", F.lit(0)).alias("size"))


@query("model_version_new", f"""WITH {_DIM_SQL}
SELECT md5('[' || concat_ws(',', '"' || agent || '"', '"' || model_name || '"', coalesce('"' || prompt_version || '"', 'null'), coalesce('"' || prompt_hash || '"', 'null')) || ']') AS model_version_id, *
FROM (SELECT DISTINCT agent, model_name, prompt_version, prompt_hash FROM ({_KEYS_SQL} FROM customer) EXCEPT SELECT agent, model_name, prompt_version, prompt_hash FROM dim)""")
def model_version_new(spark, sf):
    rows = _keys(V.table(spark, sf, "customer"))
    return R.new_dimension_rows(rows, _dimension(spark, sf), R.MODEL_KEY, "model_version_id")


# --- runs -------------------------------------------------------------------------------------------------------


@query("run_state", f"""
WITH s AS (SELECT o_orderkey AS run_id, o_orderdate AS started_at FROM orders),
e AS (SELECT CASE WHEN l_discount < 0.03 THEN l_orderkey ELSE -l_orderkey END AS run_id, l_linestatus AS status, l_shipdate AS finished_at, l_partkey * 1000000000 + l_suppkey * 100000 + l_quantity::BIGINT * 100 + l_linenumber AS event_id FROM lineitem),
l AS (SELECT run_id, arg_max(status, (finished_at, event_id, status)) AS status, max(finished_at) AS finished_at FROM e GROUP BY 1)
SELECT run_id, coalesce(status, 'running') AS status, {V.stamp_sql('finished_at')} AS finished FROM s LEFT JOIN l USING (run_id)""")
def run_state(spark, sf):
    starts = V.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("run_id"), F.lit("A").alias("mode"), F.lit("api").alias("trigger"), F.col("o_orderdate").alias("started_at")
    )
    number = F.col("l_partkey") * 1000000000 + F.col("l_suppkey") * 100000 + F.col("l_quantity").cast("long") * 100 + F.col("l_linenumber")
    # events of runs that never started match nothing
    ends = V.table(spark, sf, "lineitem").select(
        F.when(F.col("l_discount") < 0.03, F.col("l_orderkey")).otherwise(-F.col("l_orderkey")).alias("run_id"), F.col("l_linestatus").alias("status"), F.lit(None).cast("string").alias("error"),
        F.col("l_shipdate").alias("finished_at"), F.struct(number.alias("n"), "l_linestatus").alias("event_id"),
    )
    return R.run_state(starts, ends).select("run_id", "status", V.stamp("finished_at").alias("finished"))


# --- extractor versions ------------------------------------------------------------------------------------------

_STATE_SQL = """decisions AS (SELECT event_id AS decision_id, floor(value)::BIGINT * 1000 + user_id AS version_id, CASE WHEN event_type IN ('purchase', 'click') THEN 'approve' ELSE 'reject' END AS decision, ts AS decided_at, event_type AS decided_by FROM events),
versions AS (SELECT DISTINCT floor(value)::BIGINT * 1000 + user_id + CASE WHEN value < 200 THEN 0 ELSE 1000000000 END AS version_id, 'P' || (user_id % 40) AS platform, false AS initial FROM events
  UNION ALL SELECT -1 - n_nationkey::BIGINT, 'P' || n_nationkey, true FROM nation),
firsts AS (SELECT d.version_id, any_value(v.platform) AS platform, arg_min(decision, (decided_at, decision_id)) AS decision, arg_min(decided_by, (decided_at, decision_id)) AS decided_by, min((decided_at, decision_id)) AS moment
  FROM decisions d JOIN versions v USING (version_id) WHERE NOT v.initial GROUP BY 1),
approved AS (SELECT version_id, platform, moment, lead(moment) OVER (PARTITION BY platform ORDER BY moment) AS next_at FROM firsts WHERE decision = 'approve'),
edge AS (SELECT platform, max(moment) AS last_at, min(moment) AS first_at FROM approved GROUP BY 1),
states AS (
  SELECT v.version_id, v.platform, CASE WHEN v.initial THEN CASE WHEN e.last_at IS NULL THEN 'active' ELSE 'superseded' END WHEN f.decision IS NULL THEN 'pending' WHEN f.decision = 'reject' THEN 'rejected'
      WHEN f.moment = e.last_at THEN 'active' ELSE 'superseded' END AS status,
    CASE WHEN v.initial THEN struct_extract(e.first_at, 1) WHEN f.decision = 'approve' AND a.next_at IS NOT NULL THEN struct_extract(a.next_at, 1) ELSE struct_extract(f.moment, 1) END AS decided_at, f.decided_by
  FROM versions v LEFT JOIN firsts f USING (version_id) LEFT JOIN edge e ON e.platform = v.platform LEFT JOIN approved a ON a.version_id = v.version_id)"""


def _version_id():
    return F.floor("value") * 1000 + F.col("user_id")


def _versions(spark, sf):
    """Versions, some active from the start, and the decisions on them."""
    events = V.table(spark, sf, "events")
    decision = F.when(F.col("event_type").isin("purchase", "click"), "approve").otherwise("reject")
    decisions = events.select(
        F.col("event_id").alias("decision_id"), _version_id().alias("version_id"), decision.alias("decision"), F.col("ts").alias("decided_at"), F.col("event_type").alias("decided_by")
    )
    # candidates of high value are versions that no one has decided on
    candidates = events.select(
        (_version_id() + F.when(F.col("value") < 200, 0).otherwise(1000000000)).alias("version_id"), F.concat(F.lit("P"), (F.col("user_id") % 40).cast("string")).alias("platform"), F.lit(False).alias("initial")
    ).distinct()
    seeds = V.table(spark, sf, "nation").select(
        (F.lit(-1) - F.col("n_nationkey").cast("long")).alias("version_id"), F.concat(F.lit("P"), F.col("n_nationkey").cast("string")).alias("platform"), F.lit(True).alias("initial")
    )
    return candidates.unionByName(seeds), decisions


def _states(spark, sf):
    return R.extractor_states(*_versions(spark, sf))


@query("extractor_states", f"WITH {_STATE_SQL} SELECT version_id, platform, status, {V.stamp_sql('decided_at')} AS decided, decided_by FROM states")
def extractor_states(spark, sf):
    return _states(spark, sf).select("version_id", "platform", "status", V.stamp("decided_at").alias("decided"), "decided_by")


@query("stream_versions", f"WITH {_STATE_SQL} SELECT version_id, platform, status, {V.stamp_sql('decided_at')} AS decided, decided_by FROM states")
def stream_versions(spark, sf):
    """Decisions arrive in batches, partly before their versions; one batch is stored twice."""
    versions, decisions = _versions(spark, sf)
    root = work_folder(spark)
    stream = _arriving(spark, decisions.withColumn("seq", F.col("decision_id")), root)
    ingest.ingest_decisions(stream.drop("seq"), root, f"{root}/checkpoint").awaitTermination()
    early = decisions.where(F.col("decision") == "approve")
    for _ in range(2):
        ingest.append_decisions(early, "versions", root, versions)
    return ingest.version_states(spark, root).select("version_id", "platform", "status", V.stamp("decided_at").alias("decided"), "decided_by")


@query("active_platforms", f"WITH {_STATE_SQL} SELECT DISTINCT platform AS name FROM states WHERE status = 'active'")
def active_platforms(spark, sf):
    return R.active_platforms(_states(spark, sf))


@query("several_active", f"WITH {_STATE_SQL} SELECT platform, count(*) AS active FROM states WHERE status = 'active' GROUP BY 1 HAVING count(*) > 1")
def several_active(spark, sf):
    return R.several_active(_states(spark, sf))


@query("decided_history", f"WITH {_STATE_SQL} SELECT version_id, status FROM states WHERE decided_at IS NOT NULL AND platform = 'P3'")
def decided_history(spark, sf):
    return R.decided_history(_states(spark, sf), "P3").select("version_id", "status")


@query("candidates_with_active", f"""WITH {_STATE_SQL}
SELECT s.version_id, s.platform, coalesce(a.version_id, 0) AS active_version FROM states s LEFT JOIN (SELECT * FROM states WHERE status = 'active') a USING (platform) WHERE s.status = 'rejected'""")
def candidates_with_active(spark, sf):
    versions = _states(spark, sf).withColumn("selectors", F.col("version_id"))
    found = R.candidates_with_active(versions, "rejected")
    return found.select("version_id", "platform", F.coalesce("active_selectors", F.lit(0)).alias("active_version"))


@query("row_counts", """
SELECT 'runs' AS name, count(DISTINCT day(ts)) AS n FROM events UNION ALL SELECT 'listings', count(*) FROM customer UNION ALL
SELECT 'scores', count(*) FROM events WHERE event_type IN ('view', 'click') UNION ALL SELECT 'feedback', count(*) FROM events WHERE event_type NOT IN ('view', 'click') UNION ALL
SELECT 'audit_log', count(*) FROM conversations""")
def row_counts(spark, sf):
    return R.row_counts({
        "runs": V.run_ids(spark, sf), "listings": V.listings(spark, sf), "scores": V.scores(spark, sf), "feedback": V.feedback(spark, sf),
        "audit_log": V.table(spark, sf, "conversations"),
    })
