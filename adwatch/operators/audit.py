"""Sealed logs: hash chains that show any later change.

Checking needs only the stored hash before an entry, so every entry is checked in parallel. Sealing is sequential
inside a chain by definition; it runs as one sorted pass per chain that holds one hash in memory. A global log is sealed
in parts of bounded size plus a short chain over the parts' last hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adwatch import fixed
from adwatch.functions.hashing import canonical_detail, canonical_entry, entry_hash, iso_stamp, json_text
from adwatch.operators.ordering import previous_by_scan, with_previous

def with_canonical(entries: DataFrame, detail_is_canonical: bool = True) -> DataFrame:
    """Add the text that is sealed: compact sorted JSON of the sealed fields."""
    fields = {n: F.col(n) for n in fixed.SEALED_FIELDS}
    if not detail_is_canonical:
        fields["detail"] = canonical_detail(F.col("detail"))
    return entries.withColumn("canonical", canonical_entry(fields))


def verify_chains(entries: DataFrame, chain: str = "chain", seq: str = "seq", bucket: Column | None = None) -> DataFrame:
    """Per chain: ``ok``, the position of the first bad entry and the number of entries.

    An entry is bad when its ``prev_hash`` differs from the stored hash before it or its ``entry_hash`` from the
    recomputed one. Entries are compared in sorted ranges, or inside the stretches of ``bucket`` where they are known, so one
    global chain spreads over tasks.
    """
    return _verify(entries, chain, [seq], bucket).drop("error")


def _verify(entries: DataFrame, chain: str, order: list[str], stretch: Column | None, error: Column | None = None) -> DataFrame:
    error = error if error is not None else F.lit(None).cast("string")
    narrow = entries.select(chain, *order, "prev_hash", "entry_hash", "canonical", error.alias("error"))
    carried = {"entry_hash": "_before"}
    linked = previous_by_scan(narrow, [chain], order, carried) if stretch is None else with_previous(narrow, [chain], order, stretch, carried)
    good = F.col("prev_hash").eqNullSafe(F.col("_before")) & F.col("entry_hash").eqNullSafe(
        entry_hash(F.col("_before"), F.col("canonical"))
    )
    return linked.groupBy(chain).agg(
        F.count_if(~good).alias("_bad"),
        F.min(F.when(~good, F.col("position"))).alias("first_bad"),
        F.count(F.lit(1)).alias("count"),
        F.min("error").alias("error"),
    ).select(chain, (F.col("_bad") == 0).alias("ok"), "first_bad", "count", "error")


def verify_logs(lines: DataFrame) -> DataFrame:
    """Verdict per log file as read by ``read_sealed_logs``; a file with an unreadable line carries it as ``error``.

    Splits of a file are the stretches, so the check runs where the lines were read in.
    """
    checked = _verify(with_canonical(lines, detail_is_canonical=False), "chain", ["block", "line"], F.col("block"), F.col("error"))
    whole = F.col("error").isNull()
    return checked.select("chain", (F.col("ok") & whole).alias("ok"), F.when(whole, F.col("first_bad")).alias("first_bad"), "count", "error")


def seal_entries(entries: DataFrame, chain: str = "chain", seq: str = "seq", heads: DataFrame | None = None) -> DataFrame:
    """Add ``prev_hash`` and ``entry_hash`` along each chain.

    ``heads`` (``chain, entry_hash``) continues existing logs. Rows stream through in chain order; a task keeps one
    hash, whatever the length of a chain.
    """
    if heads is not None:
        entries = entries.join(heads.select(chain, F.col("entry_hash").alias("_head")), chain, "left")
    else:
        entries = entries.withColumn("_head", F.lit(None).cast("string"))
    ordered = entries.repartition(chain).sortWithinPartitions(chain, seq)
    kept = [f for f in ordered.schema.fields if f.name != "_head"]
    out = T.StructType([*kept, T.StructField("prev_hash", T.StringType()), T.StructField("entry_hash", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, last = object(), None
        for batch in batches:
            before, after = [], []
            columns = (batch.column(c).to_pylist() for c in (chain, "_head", "canonical"))
            for name, head, text in zip(*columns):
                if name != at:
                    at, last = name, head
                before.append(last)
                last = hashlib.sha256(((last or "") + text).encode()).hexdigest()
                after.append(last)
            arrays = [batch.column(f.name) for f in kept] + [pa.array(before, pa.string()), pa.array(after, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=out.names)

    return ordered.mapInArrow(run, out)


def seal_segments(entries: DataFrame, chain: str = "chain", seq: str = "seq", size: int = 1000) -> tuple[DataFrame, DataFrame]:
    """Seal a log in segments of ``size`` sequence numbers, and the segments' last hashes as a chain per log.

    Segments are sealed in parallel by a fold inside the JVM; a group holds at most ``size`` entries when the
    sequence is unique. Returns the sealed entries (with ``segment``) and the sealed heads.
    """
    rows = entries.withColumn("segment", F.floor(F.col(seq) / size))
    columns = [c for c in rows.columns if c not in (chain, "segment")]
    grouped = rows.groupBy(chain, "segment").agg(F.array_sort(F.collect_list(F.struct(seq, F.struct(*columns).alias("row")))).alias("_items"))
    hashes = F.aggregate(
        "_items",
        F.array().cast("array<string>"),
        lambda done, item: F.concat(done, F.array(entry_hash(F.try_element_at(done, F.lit(-1)), item["row"]["canonical"]))),
    )
    sealed = grouped.withColumn("_hashes", hashes).select(
        chain, "segment", F.posexplode(F.arrays_zip(F.col("_items").alias("item"), F.col("_hashes").alias("h"))).alias("_i", "_z"), "_hashes"
    )
    sealed = sealed.select(
        chain, "segment", "_z.item.row.*",
        F.when(F.col("_i") > 0, F.get("_hashes", F.col("_i") - 1)).alias("prev_hash"),
        F.col("_z.h").alias("entry_hash"),
    )
    tips = sealed.groupBy(chain, "segment").agg(F.max_by("entry_hash", seq).alias("canonical"))
    return sealed, seal_entries(tips, chain, "segment")


def seal_parts(entries: DataFrame, part: Column, seq: str = "seq") -> tuple[DataFrame, DataFrame]:
    """Seal a global log as bounded sub-chains and a short chain of their heads; the form for logs of any length.

    A single chain is sequential: one task hashes it from end to end. ``part`` cuts the log into chains that are sealed side
    by side, a run or a day say, and must leave parts of a size that one task can pass through. Returns the sealed entries
    (``chain`` names the part) and the heads (``log``, ``part``), sealed in order of the part. ``verify_chains`` checks both:
    a changed entry breaks its part, and a part that is changed and sealed anew no longer fits the heads.
    """
    sealed = seal_entries(entries.withColumn("chain", part.cast("string")), "chain", seq)
    tips = sealed.groupBy("chain").agg(F.max_by("entry_hash", seq).alias("tip"), F.count(F.lit(1)).alias("entries"))
    heads = tips.select(
        F.lit("heads").alias("log"), F.col("chain").alias("part"),
        F.to_json(F.struct("entries", F.col("chain").alias("part"), "tip")).alias("canonical"))
    return sealed, seal_entries(heads, "log", "part")


def heads_fit(sealed: DataFrame, heads: DataFrame, seq: str = "seq") -> DataFrame:
    """Per part: whether its last hash and number of entries are those that the heads have sealed."""
    tips = sealed.groupBy("chain").agg(F.max_by("entry_hash", seq).alias("tip"), F.count(F.lit(1)).alias("entries"))
    now = tips.select(F.col("chain").alias("part"), F.to_json(F.struct("entries", F.col("chain").alias("part"), "tip")).alias("now"))
    both = now.join(heads.select("part", "canonical"), "part", "full")
    return both.select("part", F.col("now").eqNullSafe(F.col("canonical")).alias("fits"))


def chain_heads(sealed: DataFrame, chain: str = "chain", seq: str = "seq") -> DataFrame:
    """Last hash of every chain."""
    return sealed.groupBy(chain).agg(F.max_by("entry_hash", seq).alias("entry_hash"))


def _detail(**fields: Column) -> Column:
    """Compact JSON with sorted keys, nulls kept. Each value is already JSON text."""
    parts = []
    for name in sorted(fields):
        parts += [F.lit(("{" if not parts else ",") + f'"{name}":'), fields[name]]
    return F.concat(*parts, F.lit("}"))


def session_entries(sessions: DataFrame) -> DataFrame:
    """Exploration sessions to log entries: an opening, one row per action, a closing.

    ``sessions`` carries ``chain, started_at, result, start_url, allowed_domains, max_steps, model, prompt_version,
    prompt_hash`` and ``trace`` with parallel arrays ``urls, actions, thoughts``; a shorter array leaves nulls.
    """
    created = iso_stamp(F.col("started_at"))
    actions = F.coalesce("trace.actions", F.array().cast("array<string>"))

    def entry(seq: Column, action: Column, detail: Column) -> Column:
        return F.struct(seq.cast("long").alias("seq"), action.alias("action"), detail.alias("detail"))

    def step(action: Column, i: Column) -> Column:
        url, number = json_text(F.get("trace.urls", i)), (i + 1).cast("string")
        thought = F.get("trace.thoughts", i)
        reasoned = _detail(step=number, url=url, reasoning=canonical_thought(thought))
        return entry(i + 1, action, F.when(thought.isNull(), _detail(step=number, url=url)).otherwise(reasoned))

    opening = _detail(
        **{n: json_text(F.col(n)) for n in ("start_url", "model", "prompt_version", "prompt_hash")},
        max_steps=F.coalesce(F.col("max_steps").cast("string"), F.lit("null")),
        allowed_domains=F.coalesce(F.to_json("allowed_domains"), F.lit("null")),
    )
    count = F.size(actions)
    length = F.length(F.coalesce("result", F.lit("")))
    closing = _detail(steps=count.cast("string"), result_chars=length.cast("string"))
    # One array per session, so its wide trace is read once.
    rows = F.concat(
        F.array(entry(F.lit(0), F.lit("browse_start"), opening)),
        F.transform(actions, step),
        F.array(entry(count + 1, F.lit("browse_done"), closing)),
    )
    none = F.lit(None).cast("long")
    return sessions.select("chain", created.alias("created_at"), F.explode(rows).alias("_e")).select(
        "chain", "_e.seq", none.alias("run_id"), none.alias("listing_id"), F.lit(fixed.BROWSE_ACTOR).alias("actor"),
        "_e.action", "_e.detail", "created_at",
    )


def canonical_thought(thought: Column) -> Column:
    """A stated thought as JSON with sorted keys."""
    return _detail(**{n: json_text(thought[n]) for n in ("eval", "memory", "next_goal")})


def session_footer(sessions: DataFrame) -> DataFrame:
    """Steps taken and length of the result per session."""
    return sessions.select(
        "chain",
        F.size(F.coalesce("trace.actions", F.array().cast("array<string>"))).alias("steps"),
        F.length(F.coalesce("result", F.lit(""))).alias("result_chars"),
    )


def log_lines(entries: DataFrame) -> DataFrame:
    """What a reader of a log wants to see: action, place and the stated next goal."""
    def field(name: str) -> Column:
        return F.get_json_object("detail", f"$.{name}")

    return entries.select(
        "chain", "seq", "action",
        F.coalesce(F.nullif(field("url"), F.lit("")), F.nullif(field("start_url"), F.lit("")), F.lit("")).alias("place"),
        F.get_json_object("detail", "$.reasoning.next_goal").alias("next_goal"),
    )


def action_events(
    starts: DataFrame, ends: DataFrame, observations: DataFrame, scores: DataFrame, feedback: DataFrame, ingested: DataFrame
) -> DataFrame:
    """The audit rows that fact appends imply. ``at`` orders them; ``source_id`` breaks ties."""
    none = F.lit(None).cast("long")

    def rows(df: DataFrame, actor: Column, action: str, at: str, source: str, detail: Column, run=none, ad=none) -> DataFrame:
        return df.select(
            run.cast("long").alias("run_id"), ad.cast("long").alias("listing_id"), actor.alias("actor"),
            F.lit(action).alias("action"), detail.alias("detail"), F.col(at).alias("at"), F.col(source).cast("long").alias("source_id"),
        )

    run, ad = F.col("run_id"), F.col("listing_id")
    flag = F.when(F.col("is_new"), "true").otherwise("false")
    return (
        rows(starts, F.col("actor"), "run_start", "started_at", "run_id", _detail(mode=json_text(F.col("mode")), trigger=json_text(F.col("trigger"))), run)
        .unionByName(rows(ends, F.col("actor"), "run_end", "finished_at", "run_id", _detail(status=json_text(F.col("status"))), run))
        .unionByName(rows(observations, F.col("actor"), "collect", "observed_at", "seq", _detail(new=flag, external_id=json_text(F.col("external_id"))), run, ad))
        .unionByName(rows(scores, F.lit(fixed.SCORE_ACTOR), "score", "scored_at", "score_id", _detail(category=json_text(F.col("category")), suspicion_score=F.col("suspicion_score").cast("double").cast("string")), run, ad))
        .unionByName(rows(feedback, F.lit("investigator"), "validate", "decided_at", "feedback_id", _detail(decision=json_text(F.col("decision")), investigator_ref=json_text(F.col("investigator_ref"))), none, ad))
        .unionByName(rows(ingested, F.lit("system"), "ingest", "ingested_at", "feedback_id", _detail(feedback_id=F.col("feedback_id").cast("string")), none, ad))
    )
