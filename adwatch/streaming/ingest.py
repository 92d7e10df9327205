"""Incremental ingestion with Structured Streaming.

A batch appends its observations and its partial state under its batch id, overwriting that id, so a batch that runs
twice after a lost executor or driver leaves one copy. The state of an ad is the merge of the partial states. A
compaction folds old parts into a base; readers use the newest base plus the parts after it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from adwatch.operators import identity as I
from adwatch.operators import registry as R

SIX_HOURS = "6 hours"


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    """A stored table, or nothing before the first write."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def _put(df: DataFrame, path: str, batch_id: int | str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(f"{path}/batch_id={batch_id}")


def append_batch(batch: DataFrame, batch_id: int, root: str) -> None:
    """Store one batch of observations and its partial state. Nothing stored earlier is read.

    The state remembers the first batch of each ad, which tells new ads from known ones when asked.
    """
    usable = batch.where(F.col("external_id").isNotNull() & (F.col("external_id") != ""))
    _put(usable, f"{root}/observations", batch_id)
    stored = usable.sparkSession.read.schema(usable.schema).parquet(f"{root}/observations/batch_id={batch_id}")
    _put(I.partial_state(stored).withColumn("first_batch", F.lit(batch_id).cast("long")), f"{root}/parts", batch_id)


def newest_base(spark: SparkSession, root: str, before: int | None = None) -> tuple[DataFrame | None, int]:
    """The newest compacted state and the last batch in it (-1 when there is none)."""
    bases = _stored(spark, f"{root}/base")
    if bases is None:
        return None, -1
    wanted = bases if before is None else bases.where(F.col("upto") < before)
    upto = wanted.agg(F.max("upto").alias("u")).first()["u"]
    return (None, -1) if upto is None else (bases.where(F.col("upto") == upto).drop("upto"), upto)


def merged_state(spark: SparkSession, root: str, upto: int | None = None) -> DataFrame:
    """Mergeable state of all ads after all batches (or after batch ``upto``)."""
    base, done = newest_base(spark, root, None if upto is None else upto + 1)
    parts = spark.read.parquet(f"{root}/parts").where(F.col("batch_id") > done)
    if upto is not None:
        parts = parts.where(F.col("batch_id") <= upto)
    fresh = parts.drop("batch_id")
    return I.merge_states(fresh if base is None else base.unionByName(fresh), smallest=("first_batch",))


def current_state(spark: SparkSession, root: str) -> DataFrame:
    """One row per ad, equal to the batch fold over all observations."""
    return I.flat_state(merged_state(spark, root))


def compact(spark: SparkSession, root: str, upto: int) -> None:
    """Fold everything up to batch ``upto`` into a new base. Old parts may be dropped once no reader needs them."""
    state = merged_state(spark, root, upto)
    state.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(f"{root}/base/upto={upto}")


def new_ads(spark: SparkSession, root: str, batch_id: int) -> DataFrame:
    """Keys of the ads that a batch saw first."""
    return merged_state(spark, root).where(F.col("first_batch") == batch_id).select(*I.KEY)


def batch_balance(spark: SparkSession, root: str) -> DataFrame:
    """Per stored batch: observations, ads seen for the first time and observations of known ads."""
    totals = spark.read.parquet(f"{root}/parts").groupBy("batch_id").agg(F.sum("observation_count").alias("total"))
    fresh = merged_state(spark, root).groupBy(F.col("first_batch").alias("batch_id")).agg(F.count(F.lit(1)).alias("_new"))
    inserted = F.coalesce("_new", F.lit(0))
    return totals.join(fresh, "batch_id", "left").select(
        "batch_id", "total", inserted.alias("inserted"), (F.col("total") - inserted).alias("observed")
    )


class SeenAds(StatefulProcessor):
    """Keeps in the stream's state store how often an ad was observed, and tells at every batch whether it is new."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._observed = handle.getValueState("observed", "n long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        fresh = sum(row["n"] for row in rows)
        before = self._observed.get()[0] if self._observed.exists() else 0
        self._observed.update((before + fresh,))
        yield Row(**dict(zip(I.KEY, key)), n=fresh, observation_count=before + fresh, is_new=before == 0)

    def close(self) -> None:
        pass


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows per key of every Arrow batch, so that an ad seen very often sends few rows to the task of its state."""
    for batch in batches:
        counts = pa.Table.from_batches([batch]).group_by(list(I.KEY)).aggregate([([], "count_all")])
        yield from counts.rename_columns([*I.KEY, "n"]).to_batches()


def tell_new_ads(stream: DataFrame, root: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Tell the new and the known ads of a batch when it arrives: ``arrivals`` under the batch's id.

    A row per ad of the batch: how often the batch holds it, how often it was observed so far, and whether it is new. The
    numbers come from keyed state that lies in the checkpoint with the batch, so nothing stored is merged or read, and a
    batch that runs again after a restart starts from the state before it. A known ad stays known however old it is, so the
    state has no watermark and holds one number per ad, in RocksDB (``session.SETTINGS``). Observations without an identity
    are left out.
    """
    usable = stream.where(F.col("platform").isNotNull() & F.col("external_id").isNotNull() & (F.col("external_id") != ""))
    counted = usable.select(*I.KEY).mapInArrow(_counted, "platform string, external_id string, n long")
    told = counted.groupBy(*I.KEY).transformWithState(
        SeenAds(), "platform string, external_id string, n long, observation_count long, is_new boolean", "Update", "None")
    writer = told.writeStream.outputMode("update").foreachBatch(lambda batch, batch_id: _put(batch, f"{root}/arrivals", batch_id))
    return _start(writer.option("checkpointLocation", checkpoint), every)


def told_balance(spark: SparkSession, root: str) -> DataFrame:
    """Per batch: observations, new ads and observations of known ads, as :func:`tell_new_ads` told them."""
    inserted = F.count_if("is_new")
    arrivals = spark.read.parquet(f"{root}/arrivals").groupBy("batch_id")
    return arrivals.agg(F.sum("n").alias("total"), inserted.alias("inserted"), (F.sum("n") - inserted).alias("observed"))


def ingest_observations(stream: DataFrame, root: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Run the upsert on a stream: once over what is there, or again and again (``every="6 hours"``)."""
    writer = stream.writeStream.foreachBatch(lambda batch, batch_id: append_batch(batch, batch_id, root))
    return _start(writer.option("checkpointLocation", checkpoint), every)


def append_decisions(batch: DataFrame, batch_id: int | str, root: str, versions: DataFrame | None = None) -> None:
    """Store the partial state that a batch of decisions (and of new versions) makes; nothing stored earlier is read.

    A batch that runs twice overwrites itself, and merging a part twice would change nothing either.
    """
    fresh = batch.sparkSession.createDataFrame([], "version_id long, platform string, initial boolean") if versions is None else versions
    _put(R.version_parts(fresh, batch), f"{root}/versions", batch_id)


def ingest_decisions(stream: DataFrame, root: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Fold a stream of decisions on extractor versions into partial states, one per batch."""
    writer = stream.writeStream.foreachBatch(lambda batch, batch_id: append_decisions(batch, batch_id, root))
    return _start(writer.option("checkpointLocation", checkpoint), every)


def version_states(spark: SparkSession, root: str) -> DataFrame:
    """Current status of every version after all batches, equal to ``registry.extractor_states`` over all decisions."""
    return R.version_statuses(R.merge_versions(spark.read.parquet(f"{root}/versions").drop("batch_id")))


def append_stream(stream: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Append facts (scores, decisions, events) from a stream; the file sink writes each batch exactly once."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return _start(writer.outputMode("append"), every)


def ingest_confirmed(
    decisions: DataFrame, deliver: Callable[[DataFrame, int], None], ingested_path: str, checkpoint: str, every: str | None = None
) -> StreamingQuery:
    """Deliver newly confirmed cases and mark them. ``deliver`` gets a batch and its id and must allow repeats.

    Marks are append-only facts under the batch id; the decision rows are never changed.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        confirmed = batch.where(F.col("decision") == "confirme")
        deliver(confirmed, batch_id)
        _put(confirmed.select("feedback_id", F.current_timestamp().alias("ingested_at")), ingested_path, batch_id)

    return _start(decisions.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint), every)


def _start(writer, every: str | None) -> StreamingQuery:
    return writer.trigger(availableNow=True).start() if every is None else writer.trigger(processingTime=every).start()


def evaluate_rest(
    ads: DataFrame, results_path: str, errors_path: str, score: Callable[[DataFrame], DataFrame]
) -> None:
    """Score the ads that have no result yet and append; failed ads go to an error table and are tried again next time.

    ``score`` returns the result columns plus ``ok``. Answers are written once, then split, so no ad is scored twice.
    """
    from adwatch.operators.evaluate import pending_evaluation
    from adwatch.sources.readers import read_results

    spark = ads.sparkSession
    answered = score(pending_evaluation(ads, read_results(spark, results_path)))
    answered.where("ok").drop("ok").write.mode("append").json(results_path)
    rest = pending_evaluation(ads, read_results(spark, results_path))
    rest.select(F.col("id").cast("string").alias("id")).write.mode("overwrite").option(
        "partitionOverwriteMode", "static"
    ).json(errors_path)
