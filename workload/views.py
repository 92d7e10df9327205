"""The domain tables as projections of the driver tables, in Spark and as SQL common table expressions.

listings = customers, platforms = nations, scores / feedback / observations = events by type, runs = days.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from adwatch import fixed
from adwatch.functions.hashing import content_hash
from adwatch.functions.numbers import float_text
from adwatch.session import widen



def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A driver table for work that is costly per row."""
    return widen(table(spark, sf, name))


def stamp(c: Column | str) -> Column:
    """Timestamp as text, for comparison with other engines."""
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def stamp_sql(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S.%f')"


def code_at(index: Column) -> Column:
    """Category by position in the vocabulary."""
    return F.element_at(F.array(*[F.lit(c) for c in fixed.CATEGORIES]), index.cast("int") + 1)


CODES_SQL = "[" + ",".join(f"'{c}'" for c in fixed.CATEGORIES) + "]"


def platforms(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").select(
        F.col("n_nationkey").cast("long").alias("platform_id"),
        F.col("n_name").alias("name"),
        F.concat(F.lit("https://"), F.lower("n_name"), F.lit(".example.com/")).alias("base_url"),
    )


PLATFORMS = """platforms AS (
  SELECT n_nationkey::BIGINT AS platform_id, n_name AS name, 'https://' || lower(n_name) || '.example.com/' AS base_url
  FROM nation)"""


def listings(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("c_custkey")
    text = key.cast("string")
    return table(spark, sf, "customer").select(
        key.alias("listing_id"),
        F.col("c_nationkey").cast("long").alias("platform_id"),
        F.concat(F.lit("C"), text).alias("external_id"),
        F.col("c_name").alias("title"),
        F.concat(F.lit("Segment "), F.col("c_mktsegment")).alias("description"),
        F.col("c_acctbal").alias("price_amount"),
        F.lit("CHF").alias("price_currency"),
        F.when(F.col("c_acctbal") >= 0, F.concat(F.lit("https://ads.example.com/listing/"), text)).alias("url"),
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(c_custkey as int), 0)").alias("last_seen_at"),
        F.col("c_mktsegment").alias("seller_label"),
        F.struct(F.lower("c_mktsegment").alias("location")).alias("structured"),
        F.sha2(F.col("c_name"), 256).alias("content_hash"),
    )


LISTINGS = """listings AS (
  SELECT c_custkey AS listing_id, c_nationkey::BIGINT AS platform_id, 'C' || c_custkey AS external_id, c_name AS title,
         'Segment ' || c_mktsegment AS description, c_acctbal AS price_amount, 'CHF' AS price_currency,
         CASE WHEN c_acctbal >= 0 THEN 'https://ads.example.com/listing/' || c_custkey END AS url,
         TIMESTAMP '2024-01-01 00:00:00' + to_minutes(c_custkey::INT) AS last_seen_at, c_mktsegment AS seller_label,
         lower(c_mktsegment) AS location, sha256(c_name) AS content_hash
  FROM customer)"""


def _score(c: Column) -> Column:
    """Event value as a score with three decimals."""
    return (F.floor(F.least(c, F.lit(100.0)) * 10) / F.lit(1000.0)).cast("decimal(4,3)")


SCORE_SQL = "(floor(least(value, 100.0::DOUBLE) * 10) / 1000.0::DOUBLE)::DECIMAL(4,3)"


def _code(props: Column) -> Column:
    return code_at(F.get_json_object(props, "$.k").cast("int") % 8)


CODE_SQL = f"{CODES_SQL}[json_extract_string(props, '$.k')::INT % 8 + 1]"


def scores(spark: SparkSession, sf: str) -> DataFrame:
    kept = table(spark, sf, "events").where(F.col("event_type").isin("view", "click"))
    return kept.select(
        F.col("event_id").alias("score_id"),
        F.col("user_id").alias("listing_id"),
        F.dayofmonth("ts").cast("long").alias("run_id"),
        _code(F.col("props")).alias("category"),
        _score(F.col("value")).alias("suspicion_score"),
        F.concat(F.lit("k "), F.get_json_object("props", "$.k")).alias("rationale"),
        F.array(F.col("event_type")).alias("rag_refs"),
        F.col("ts").alias("scored_at"),
    )


SCORES = f"""scores AS (
  SELECT event_id AS score_id, user_id AS listing_id, day(ts)::BIGINT AS run_id, {CODE_SQL} AS category,
         {SCORE_SQL} AS suspicion_score, 'k ' || json_extract_string(props, '$.k') AS rationale,
         event_type AS rag_ref, ts AS scored_at
  FROM events WHERE event_type IN ('view', 'click'))"""


def feedback(spark: SparkSession, sf: str) -> DataFrame:
    kept = table(spark, sf, "events").where(F.col("event_type").isin("purchase", "error", "signup"))
    decision = F.when(F.col("event_type") == "purchase", "confirme").when(F.col("event_type") == "error", "rejete").otherwise("incertain")
    return kept.select(
        F.col("event_id").alias("feedback_id"),
        F.col("user_id").alias("listing_id"),
        (F.col("event_id") - 1).alias("score_id"),
        F.concat(F.lit("inv"), F.pmod("event_id", F.lit(7)).cast("string")).alias("investigator_ref"),
        decision.alias("decision"),
        F.when(F.col("value") > 100, _code(F.col("props"))).alias("category_corrected"),
        F.when(F.col("value") > 50, F.col("props")).alias("comment"),
        F.col("ts").alias("decided_at"),
        F.col("value"),
    )


FEEDBACK = f"""feedback AS (
  SELECT event_id AS feedback_id, user_id AS listing_id, event_id - 1 AS score_id, 'inv' || (event_id % 7) AS investigator_ref,
         CASE event_type WHEN 'purchase' THEN 'confirme' WHEN 'error' THEN 'rejete' ELSE 'incertain' END AS decision,
         CASE WHEN value > 100 THEN {CODE_SQL} END AS category_corrected, CASE WHEN value > 50 THEN props END AS comment,
         ts AS decided_at, value
  FROM events WHERE event_type IN ('purchase', 'error', 'signup'))"""


def ingested(spark: SparkSession, sf: str) -> DataFrame:
    return feedback(spark, sf).where((F.col("decision") == "confirme") & (F.col("value") > 50)).select(
        "feedback_id", F.col("decided_at").alias("ingested_at")
    )


INGESTED = "ingested AS (SELECT feedback_id, decided_at AS ingested_at FROM feedback WHERE decision = 'confirme' AND value > 50)"


def run_ids(spark: SparkSession, sf: str) -> DataFrame:
    days = table(spark, sf, "events").groupBy(F.dayofmonth("ts").cast("long").alias("run_id"))
    return days.agg(F.min("ts").alias("started_at"), F.max("ts").alias("finished_at"), F.count(F.lit(1)).alias("seen"))


def runs(spark: SparkSession, sf: str) -> DataFrame:
    """Days as runs: odd days explore, every third run has no target."""
    run = F.col("run_id")
    odd, free = run % 2 == 1, run % 3 == 0
    targets = F.when(free, F.array().cast("array<string>")).otherwise(F.array(code_at(run % 6), code_at((run + 1) % 6)))
    terms = F.transform(F.sequence(F.lit(1), run % 4 + 1), lambda i: F.concat(F.lit("t"), i.cast("string")))
    site = F.struct(
        F.concat(F.lit("Site "), (run % 25).cast("string")).alias("label"),
        F.concat(F.lit("https://site"), (run % 25).cast("string"), F.lit(".example.com")).alias("base_url"),
        F.concat(F.lit("NATION_"), (run % 25).cast("string")).alias("platform"),
    )
    return run_ids(spark, sf).select(
        "run_id",
        F.when(odd, "B").otherwise("A").alias("mode"),
        F.lit("completed").alias("status"),
        F.struct(
            F.array(F.concat(F.lit("seed "), run.cast("string"))).alias("seeds"),
            targets.alias("target_categories"),
            F.when(odd, "B1").alias("mode"),
            F.when(odd, terms).alias("generated_terms"),
        ).alias("params"),
        F.struct(
            F.col("seen").alias("collected"), odd.alias("mode_b"), (F.col("seen") / 10.0).alias("duree_s"),
            F.struct(
                F.struct(targets.alias("categories"), (run % 4 + 1).alias("termes")).alias("expand"),
                F.when(odd, F.struct(F.create_map(F.lit("Site"), F.col("seen")).alias("sites"), F.lit("standard").alias("profondeur"))).alias("exploration"),
                F.struct(F.col("seen").alias("annonces")).alias("collecte"),
                F.struct(
                    F.col("seen").alias("scorees"), (run % 5).alias("alertes"),
                    F.when(run % 5 > 0, F.array(F.struct(F.lit("arme").alias("category"), (run % 5).alias("n")))).alias("par_categorie"),
                ).alias("scoring"),
            ).alias("etapes"),
        ).alias("stats"),
        F.struct(
            F.when(~odd, site["platform"]).alias("platform"), F.when(~odd, site["base_url"]).alias("base_url"),
            F.when(odd, F.array(site)).alias("sites"),
        ).alias("config_snapshot"),
        "started_at",
        "finished_at",
    )


RUNS = f"""runs AS (
  SELECT run_id, CASE WHEN run_id % 2 = 1 THEN 'B' ELSE 'A' END AS mode, started_at, finished_at, seen,
         CASE WHEN run_id % 3 = 0 THEN [] ELSE [{CODES_SQL}[run_id % 6 + 1], {CODES_SQL}[(run_id + 1) % 6 + 1]] END AS targets,
         'NATION_' || (run_id % 25) AS site_platform, 'https://site' || (run_id % 25) || '.example.com' AS site_url
  FROM (SELECT day(ts)::BIGINT AS run_id, min(ts) AS started_at, max(ts) AS finished_at, count(*) AS seen FROM events GROUP BY 1))"""


def observations(spark: SparkSession, sf: str) -> DataFrame:
    """Every event as one appearance of an ad; cheap ones lack an identity."""
    rows = table(spark, sf, "events")
    price = F.floor(F.col("value") / 20).cast("double")
    return rows.select(
        F.concat(F.lit("NATION_"), (F.col("user_id") % 25).cast("string")).alias("platform"),
        F.when(F.col("value") >= 1, F.col("user_id").cast("string")).alias("external_id"),
        F.dayofmonth("ts").cast("long").alias("run_id"),
        F.col("event_type").alias("title"),
        price.alias("price_amount"),
        F.when(F.col("value") < 60, F.col("props")).alias("description"),
        content_hash({"title": F.col("event_type"), "price_amount": float_text(price)}).alias("content_hash"),
        F.col("ts").alias("observed_at"),
        F.col("event_id").alias("seq"),
    )


OBSERVATIONS = """observations AS (
  SELECT 'NATION_' || (user_id % 25) AS platform, CASE WHEN value >= 1 THEN user_id::VARCHAR END AS external_id,
         day(ts)::BIGINT AS run_id, event_type AS title, floor(value / 20)::DOUBLE AS price_amount,
         CASE WHEN value < 60 THEN props END AS description,
         sha256('{"description": null, "location": null, "price_amount": ' || floor(value / 20)::BIGINT ||
                '.0, "price_currency": null, "seller": null, "title": "' || event_type || '"}') AS content_hash,
         ts AS observed_at, event_id AS seq
  FROM events)"""


def ctes(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def title_sql(html: str = "html") -> str:
    """Text of the title element with its entities resolved."""
    text = f"trim(regexp_extract({html}, '(?is)<title[^>]*>(.*?)</title>', 1))"
    for entity, char in (("&lt;?", "<"), ("&gt;?", ">"), ("&quot;?", '"'), ("&#39;|&#x27;", "''"), ("&amp;?", "&")):
        text = f"regexp_replace({text}, '{entity}', '{char}', 'g')"
    return text
