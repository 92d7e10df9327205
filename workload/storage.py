"""Files and tables written from the driver tables and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from adwatch.operators import queue as Q
from adwatch.operators import registry as R
from adwatch.sources import readers, writers
from adwatch.streaming import ingest
from workload import query
from workload import views as V
from workload.streams import _arriving, work_folder


@query("ads_files", "SELECT p_partkey AS id, p_name AS title, p_brand AS platform, p_size::BIGINT AS price FROM part")
def ads_files(spark, sf):
    """Evaluation ads as JSON lines."""
    root = work_folder(spark)
    ads = V.table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_brand").alias("platform"), F.col("p_name").alias("title"), F.col("p_size").cast("long").alias("price"))
    writers.write_json(ads, f"{root}/ads")
    return readers.read_ads(spark, f"{root}/ads", multiline=False).select("id", "title", "platform", "price")


@query("array_files", "SELECT doc_id AS id, lang AS platform, '}{\"[' || text AS description, n_chars::BIGINT AS price FROM documents")
def array_files(spark, sf):
    """Evaluation ads as JSON arrays; texts hold quotes, brackets and line ends."""
    root = work_folder(spark)
    ads = V.table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), F.col("lang").alias("platform"), F.concat(F.lit('}{"['), "text").alias("description"), F.col("n_chars").cast("long").alias("price"))
    writers.write_json_arrays(ads, f"{root}/ads")
    return readers.read_ad_arrays(spark, f"{root}/ads").select("id", "platform", "description", "price")


@query("result_objects", "SELECT doc_id::VARCHAR AS id, toxic / 1.0::DOUBLE AS llm_score, quality = 1 AS kw_flag FROM labels")
def result_objects(spark, sf):
    """Earlier results as JSON objects of at most 1,000 ads, several to a file."""
    root = work_folder(spark)
    results = V.table(spark, sf, "labels").select(
        "doc_id", F.col("doc_id").cast("string").alias("id"), F.struct(F.col("toxic").cast("double").alias("llm_score"), (F.col("quality") == 1).alias("kw_flag")).alias("r"))
    objects = results.groupBy(F.floor(F.col("doc_id") / 1000).alias("_block")).agg(F.map_from_entries(F.collect_list(F.struct("id", "r"))).alias("m"))
    objects.select(F.to_json("m").alias("value")).write.text(f"{root}/results")
    return readers.read_results_object(spark, f"{root}/results").select("id", "llm_score", "kw_flag")


@query("label_files", "SELECT doc_id::VARCHAR AS id, toxic = 1 AS suspect, CASE WHEN quality = 1 THEN 'facile' END AS difficulte FROM labels")
def label_files(spark, sf):
    """Ground truth as JSON lines; absent fields are null."""
    root = work_folder(spark)
    labels = V.table(spark, sf, "labels").select(
        F.col("doc_id").cast("string").alias("id"), (F.col("toxic") == 1).alias("suspect"), F.when(F.col("quality") == 1, "facile").alias("difficulte"))
    writers.write_json(labels, f"{root}/labels")
    return readers.read_label_lines(spark, f"{root}/labels").select("id", "suspect", "difficulte")


@query("export_files", V.ctes(V.FEEDBACK) + """
SELECT feedback_id, listing_id, (SELECT count(*) FROM feedback WHERE decision = 'confirme') AS count FROM feedback WHERE decision = 'confirme'""")
def export_files(spark, sf):
    """Confirmed cases and their summary as exported."""
    root = work_folder(spark)
    confirmed = V.feedback(spark, sf).where("decision = 'confirme'").select("feedback_id", "listing_id")
    writers.export_cases(confirmed, root)
    cases = spark.read.schema("feedback_id bigint, listing_id bigint").json(f"{root}/cases")
    return cases.crossJoin(F.broadcast(spark.read.schema("count bigint").json(f"{root}/summary")))  # one row


@query("stored_scores", V.ctes(V.SCORES) + "SELECT score_id, listing_id, suspicion_score::DOUBLE AS suspicion_score FROM scores")
def stored_scores(spark, sf):
    """Facts of two batches, one of them written twice."""
    root = work_folder(spark)
    scores = V.scores(spark, sf)
    low = scores.where("score_id % 2 = 0")
    for rows, batch in ((low, "0"), (scores.where("score_id % 2 = 1"), "1"), (low, "0")):
        writers.append_rows(rows, root, "scores", batch)
    return readers.read_table(spark, root, "scores").select("score_id", "listing_id", F.col("suspicion_score").cast("double"))


@query("reset_counts", V.ctes(V.SCORES, V.FEEDBACK) + """
SELECT 'scores' AS name, count(*) AS before, 0::BIGINT AS after FROM scores UNION ALL SELECT 'feedback', count(*), 0 FROM feedback
UNION ALL SELECT unnest(['runs', 'observations', 'audit_log']), 0, 0""")
def reset_counts(spark, sf):
    """Operational tables before and after a reset."""
    root = work_folder(spark)
    writers.append_rows(V.scores(spark, sf), root, "scores")
    writers.append_rows(V.feedback(spark, sf), root, "feedback")
    before = writers.reset_operational(spark, root)
    after = R.row_counts({n: readers.read_table(spark, root, n) for n in ("runs", "observations", "scores", "feedback", "audit_log")})
    return before.withColumnRenamed("n", "before").join(after.withColumnRenamed("n", "after"), "name").select("name", "before", "after")


@query("stream_feedback", V.ctes(V.FEEDBACK) + "SELECT feedback_id, listing_id, decision FROM feedback")
def stream_feedback(spark, sf):
    """Decisions appended by a stream that fires at intervals."""
    root = work_folder(spark)
    decisions = V.feedback(spark, sf).withColumn("seq", F.col("feedback_id"))
    running = ingest.append_stream(_arriving(spark, decisions, root), f"{root}/feedback", f"{root}/checkpoint", every="1 second")
    running.processAllAvailable()
    running.stop()
    return spark.read.schema(decisions.schema).parquet(f"{root}/feedback").select("feedback_id", "listing_id", "decision")


@query("candidate_inserts", """
SELECT 'site' || s_nationkey AS platform, '.t' || s_suppkey AS title, 'pending' AS status, '{"tried":' || s_suppkey || ',"error":null}' AS repair_history,
       '{"complete":' || CASE WHEN s_nationkey > 12 THEN 'true' ELSE 'false' END || '}' AS validation, true AS named FROM supplier""")
def candidate_inserts(spark, sf):
    """Selector candidates stored as versions that wait for a decision, written twice under one batch."""
    root = work_folder(spark)
    made = V.table(spark, sf, "supplier").select(
        F.concat(F.lit("site"), F.col("s_nationkey").cast("string")).alias("platform"),
        F.create_map(F.lit("title"), F.concat(F.lit(".t"), F.col("s_suppkey").cast("string"))).alias("selectors"), F.lit("llm").alias("source"),
        F.struct(F.col("s_suppkey").alias("tried"), F.lit(None).cast("string").alias("error")).alias("repair_history"),
        F.struct((F.col("s_nationkey") > 12).alias("complete")).alias("validation"), F.timestamp_seconds(F.col("s_suppkey")).alias("created_at"))
    for _ in range(2):
        writers.append_rows(R.pending_versions(made), root, "extractor_versions", "0")
    stored = readers.read_table(spark, root, "extractor_versions")
    return stored.select("platform", F.col("selectors")["title"].alias("title"), "status", "repair_history", "validation", F.col("version_id").isNotNull().alias("named"))


@query("pending_export", V.ctes(V.FEEDBACK) + "SELECT feedback_id FROM feedback WHERE decision = 'confirme' AND feedback_id % 3 > 0")
def pending_export(spark, sf):
    """Cases still to deliver after the marks of a stored table."""
    root = work_folder(spark)
    decisions = V.feedback(spark, sf)
    marks = decisions.where("feedback_id % 3 = 0").select("feedback_id", F.current_timestamp().alias("ingested_at"))
    writers.append_rows(marks, root, "ingested", "0")
    return Q.pending_cases(decisions, readers.read_table(spark, root, "ingested"), V.listings(spark, sf)).select("feedback_id")


@query("character_references", "SELECT doc_id, text FROM documents WHERE text IS NOT NULL")
def character_references(spark, sf):
    """Whole texts with signs and accented letters written as named, decimal and hexadecimal references, and resolved again."""
    from adwatch.functions.text import unescape

    documents = V.spread(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", "text")
    written = F.replace(F.col("text"), F.lit("&"), F.lit("&amp;"))
    for sign, reference in ((".", "&period;"), ("é", "&eacute;"), ("ñ", "&#241;"), ("ü", "&#xFC;"), ("ó", "&#x000f3;"), ("<", "&lt;"), ("\n", "&NewLine;")):
        written = F.replace(written, F.lit(sign), F.lit(reference))
    return documents.select("doc_id", written.alias("text")).select("doc_id", unescape(F.col("text")).alias("text"))
