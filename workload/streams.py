"""Streams over events: the state after all batches must equal the batch fold."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from adwatch.functions.numbers import round_even
from adwatch.operators import queue as Q
from adwatch.session import checkpoint_folder
from adwatch.sources import readers, writers
from adwatch.streaming import ingest
from workload import query
from workload import views as V
from workload.history import STATE_SQL, known, state_shown


def work_folder(spark) -> str:
    """A new folder in the shared checkpoint folder; where the session names none, in the warehouse, which is shared too."""
    shared = checkpoint_folder(spark, spark.conf.get("spark.sql.warehouse.dir"))
    return f"{shared.rstrip('/')}/adwatch-{uuid.uuid4().hex}"


def _arriving(spark, df, root: str):
    """The rows as files that arrive in a few batches; as many files as the table has splits, four at least."""
    files = max(4, df.rdd.getNumPartitions())
    df.repartition(files, "seq").write.parquet(f"{root}/landing")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", -(-files // 4)).parquet(f"{root}/landing")


def _ingested(spark, sf) -> str:
    root = work_folder(spark)
    stream = _arriving(spark, known(spark, sf), root)
    ingest.ingest_observations(stream, f"{root}/store", f"{root}/checkpoint").awaitTermination()
    return f"{root}/store"


@query("stream_state", STATE_SQL)
def stream_state(spark, sf):
    return state_shown(ingest.current_state(spark, _ingested(spark, sf)))


@query("stream_state_compacted", STATE_SQL)
def stream_state_compacted(spark, sf):
    store = _ingested(spark, sf)
    ingest.compact(spark, store, 1)
    return state_shown(ingest.current_state(spark, store))


@query("stream_balance", V.ctes(V.OBSERVATIONS) + """
SELECT count(*)::BIGINT AS total, count(DISTINCT (platform, external_id))::BIGINT AS inserted, (count(*) - count(DISTINCT (platform, external_id)))::BIGINT AS observed
FROM observations WHERE external_id IS NOT NULL""")
def stream_balance(spark, sf):
    balance = ingest.batch_balance(spark, _ingested(spark, sf))
    return balance.agg(*[F.sum(c).alias(c) for c in ("total", "inserted", "observed")])


@query("stream_new_ads", V.ctes(V.OBSERVATIONS) + """
SELECT platform, external_id, count(*)::BIGINT AS observations, 1::BIGINT AS times_new FROM observations WHERE external_id IS NOT NULL GROUP BY 1, 2""")
def stream_new_ads(spark, sf):
    """Every ad is told as new once, by the batch that holds it first, over two runs of the stream."""
    root = work_folder(spark)
    rows = known(spark, sf)
    stream = _arriving(spark, rows.where("seq % 2 = 0"), root)
    ingest.tell_new_ads(stream, root, f"{root}/checkpoint").awaitTermination()
    rows.where("seq % 2 = 1").repartition(2).write.mode("append").parquet(f"{root}/landing")
    ingest.tell_new_ads(stream, root, f"{root}/checkpoint").awaitTermination()
    arrivals = spark.read.parquet(f"{root}/arrivals")
    return arrivals.groupBy("platform", "external_id").agg(F.sum("n").alias("observations"), F.count_if("is_new").alias("times_new"))


@query("stream_scores", V.ctes(V.SCORES) + "SELECT score_id, listing_id, suspicion_score::DOUBLE AS suspicion_score FROM scores")
def stream_scores(spark, sf):
    root = work_folder(spark)
    scores = V.scores(spark, sf).withColumn("seq", F.col("score_id"))
    ingest.append_stream(_arriving(spark, scores, root), f"{root}/scores", f"{root}/checkpoint").awaitTermination()
    return spark.read.schema(scores.schema).parquet(f"{root}/scores").select("score_id", "listing_id", F.col("suspicion_score").cast("double"))


@query("stream_confirmed", V.ctes(V.FEEDBACK) + "SELECT feedback_id, listing_id FROM feedback WHERE decision = 'confirme'")
def stream_confirmed(spark, sf):
    """Confirmed cases delivered once each; afterwards none is pending."""
    root = work_folder(spark)
    decisions = V.feedback(spark, sf).withColumn("seq", F.col("feedback_id"))
    stream = _arriving(spark, decisions, root)
    deliver = lambda batch, i: batch.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(f"{root}/out/batch_id={i}")
    ingest.ingest_confirmed(stream, deliver, f"{root}/ingested", f"{root}/checkpoint").awaitTermination()
    marks = spark.read.parquet(f"{root}/ingested").select("feedback_id")
    pending = Q.pending_cases(V.feedback(spark, sf), marks, V.listings(spark, sf)).select("feedback_id", "listing_id")
    return spark.read.parquet(f"{root}/out").select("feedback_id", "listing_id").unionByName(pending)


@query("resumed_evaluation", """
SELECT doc_id::VARCHAR AS id, printf('%.3f', least(1.0::DOUBLE, n_chars / 3000.0::DOUBLE))::DOUBLE AS llm_score FROM documents WHERE lang <> 'es'""")
def resumed_evaluation(spark, sf):
    """Two sittings over the same ads; failing ads stay open, finished ones are not scored again."""
    root = work_folder(spark)
    docs = V.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "n_chars", "lang")

    def score(ads):
        return ads.select(
            F.col("id").cast("string").alias("id"), round_even(F.least(F.lit(1.0), F.col("n_chars") / F.lit(3000.0)), 3).alias("llm_score"),
            F.lit("autre").alias("llm_category"), (F.col("lang") != "es").alias("ok"),
        )

    ingest.evaluate_rest(docs.where("n_chars < 500"), f"{root}/results", f"{root}/errors", score)
    ingest.evaluate_rest(docs, f"{root}/results", f"{root}/errors", score)
    return readers.read_results(spark, f"{root}/results").select("id", "llm_score")


@query("report_files", V.ctes(V.SCORES) + """
SELECT run_id::INTEGER AS run_id, score_id, suspicion_score::DOUBLE AS score FROM scores""")
def report_files(spark, sf):
    """Reports written as JSON by run and read back."""
    from adwatch.plans import report as R

    root = work_folder(spark)
    ads = Q.run_listings(V.scores(spark, sf), V.listings(spark, sf), V.platforms(spark, sf))
    runs = V.runs(spark, sf)
    writers.write_reports(R.report_headers(ads, runs), R.report_ads(ads, runs), root)
    return spark.read.schema("run_id int, score_id bigint, score double").json(f"{root}/ads").select("run_id", "score_id", "score")


@query("log_files", "SELECT conv_id::INTEGER AS chain, true AS ok, count(*) AS count FROM conversations GROUP BY 1")
def log_files(spark, sf):
    """A log written in two sittings continues its chains."""
    from adwatch.operators import audit as A
    from workload.logs import _entries

    root = work_folder(spark)
    entries = _entries(spark, sf).drop("canonical").withColumn("chain", F.col("chain").cast("int"))
    writers.write_log(entries.where("seq < 2"), f"{root}/log")
    # A second sitting numbers its entries from 0 again.
    low = entries.where("seq >= 2").groupBy("chain").agg(F.min("seq").alias("_low"))
    later = entries.where("seq >= 2").join(low, "chain").withColumn("seq", F.col("seq") - F.col("_low")).drop("_low")
    writers.append_log(later, f"{root}/log")
    written = writers.read_log(spark, f"{root}/log").withColumn("chain", F.col("chain").cast("int"))
    return A.verify_chains(written).select("chain", "ok", "count")
