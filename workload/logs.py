"""Sealed logs over conversations and events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from adwatch.functions.hashing import iso_stamp
from adwatch.operators import audit as A
from adwatch.operators import queue as Q
from adwatch.session import settled
from adwatch.sources import readers, writers
from workload import query
from workload import views as V
from workload.streams import work_folder


def _entries(spark, sf):
    """One chain per conversation, one entry per turn."""
    turns = V.table(spark, sf, "conversations")
    detail = F.concat(F.lit('{"text":'), A.json_text(F.col("text")), F.lit("}"))
    none = F.lit(None).cast("long")
    entries = turns.select(
        F.col("conv_id").alias("chain"), F.col("turn").alias("seq"), none.alias("run_id"), F.col("conv_id").alias("listing_id"),
        F.col("role").alias("actor"), F.lit("turn").alias("action"), detail.alias("detail"), F.lit("2024-01-01T00:00:00.000000+00:00").alias("created_at"),
    )
    return A.with_canonical(entries)


_CANONICAL = """canon AS (
  SELECT conv_id AS chain, turn AS seq, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn,
    '{"action":"turn","actor":"' || role || '","created_at":"2024-01-01T00:00:00.000000+00:00","detail":{"text":' || to_json(text)::VARCHAR || '},"listing_id":' || conv_id || ',"run_id":null}' AS canonical
  FROM conversations)"""
_SEALED = _CANONICAL + """, sealed AS (
  SELECT chain, seq, rn, canonical, NULL::VARCHAR AS prev_hash, sha256(canonical) AS entry_hash FROM canon WHERE rn = 1
  UNION ALL SELECT c.chain, c.seq, c.rn, c.canonical, s.entry_hash, sha256(s.entry_hash || c.canonical) FROM sealed s JOIN canon c ON c.chain = s.chain AND c.rn = s.rn + 1)"""


@query("seal_chain", f"WITH RECURSIVE {_SEALED} SELECT chain, seq, prev_hash, entry_hash FROM sealed")
def seal_chain(spark, sf):
    return A.seal_entries(_entries(spark, sf)).select("chain", "seq", "prev_hash", "entry_hash")


@query("seal_continued", f"""WITH RECURSIVE {_CANONICAL}, sealed AS (
  SELECT chain, seq, rn, sha256(chain::VARCHAR) AS prev_hash, sha256(sha256(chain::VARCHAR) || canonical) AS entry_hash FROM canon WHERE rn = 1
  UNION ALL SELECT c.chain, c.seq, c.rn, s.entry_hash, sha256(s.entry_hash || c.canonical) FROM sealed s JOIN canon c ON c.chain = s.chain AND c.rn = s.rn + 1)
SELECT chain, max_by(entry_hash, seq) AS entry_hash FROM sealed GROUP BY 1""")
def seal_continued(spark, sf):
    entries = _entries(spark, sf)
    heads = entries.groupBy("chain").agg(F.sha2(F.col("chain").cast("string"), 256).alias("entry_hash"))
    return A.chain_heads(A.seal_entries(entries, heads=heads))


def _verdict(df):
    """-1 for no bad entry."""
    return df.withColumn("first_bad", F.coalesce("first_bad", F.lit(-1)))


@query("verify_chain", "SELECT conv_id AS chain, true AS ok, -1::BIGINT AS first_bad, count(*) AS count FROM conversations GROUP BY 1")
def verify_chain(spark, sf):
    return _verdict(A.verify_chains(A.seal_entries(_entries(spark, sf))))


@query("verify_tampered", """
WITH n AS (SELECT conv_id AS chain, turn AS seq, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
SELECT chain, chain % 4 = 3 OR (chain % 4 = 2 AND max(n) <= 2) AS ok,
       coalesce(CASE chain % 4 WHEN 3 THEN NULL WHEN 0 THEN 0 WHEN 1 THEN max(n) - 1 ELSE CASE WHEN max(n) > 2 THEN 1 END END, -1)::BIGINT AS first_bad,
       CASE WHEN chain % 4 = 2 AND max(n) > 1 THEN max(n) - 1 ELSE max(n) END::BIGINT AS count
FROM n GROUP BY chain""")
def verify_tampered(spark, sf):
    """Chains by number: content changed at the start, hash changed at the end, second entry removed, untouched."""
    sealed = A.seal_entries(_entries(spark, sf))
    kind, top = F.col("chain") % 4, F.col("_top")
    size = sealed.groupBy("chain").agg(F.max("seq").alias("_top"), F.min("seq").alias("_low"))
    second = sealed.join(size.select("chain", "_low"), "chain").where(F.col("seq") > F.col("_low")).groupBy("chain").agg(F.min("seq").alias("_second"))
    rows = sealed.join(size, "chain").join(second, "chain", "left")
    rows = rows.where(F.coalesce((kind != 2) | (F.col("seq") != F.col("_second")), F.lit(True)))
    changed = (
        rows.withColumn("canonical", F.when((kind == 0) & (F.col("seq") == F.col("_low")), F.concat("canonical", F.lit(" "))).otherwise(F.col("canonical")))
        .withColumn("entry_hash", F.when((kind == 1) & (F.col("seq") == top), F.reverse("entry_hash")).otherwise(F.col("entry_hash")))
    )
    return _verdict(A.verify_chains(changed))


@query("verify_segments", """
SELECT conv_id AS chain, turn // 3 AS segment, true AS ok, count(*) AS count FROM conversations GROUP BY ALL""")
def verify_segments(spark, sf):
    sealed, _ = A.seal_segments(_entries(spark, sf), size=3)
    part = sealed.withColumn("part", F.concat_ws("#", "chain", "segment"))
    checked = A.verify_chains(part, "part")
    names = part.select("part", "chain", "segment").distinct()
    return checked.join(names, "part").select("chain", "segment", "ok", "count")


def _sessions(spark, sf):
    """One exploration session per order; the weekday gives the number of actions."""
    orders = V.table(spark, sf, "orders")
    size = F.dayofweek("o_orderdate") - 1
    steps = F.when(size > 0, F.sequence(F.lit(1), size)).otherwise(F.array().cast("array<int>"))
    text = F.col("o_orderkey").cast("string")
    thought = F.struct(F.lit(None).cast("string").alias("eval"), F.col("o_orderpriority").alias("memory"), F.lit("next").alias("next_goal"))
    trace = F.struct(
        F.transform(F.slice(steps, 1, 2), lambda i: F.concat(F.lit("https://s.test/"), i.cast("string"))).alias("urls"),
        F.transform(steps, lambda i: F.concat(F.lit("act"), i.cast("string"))).alias("actions"),
        F.transform(F.slice(steps, 1, 1), lambda i: thought).alias("thoughts"),
    )
    return orders.select(
        text.alias("chain"), F.col("o_orderdate").alias("started_at"), F.col("o_orderpriority").alias("result"), F.concat(F.lit("https://s.test/"), text).alias("start_url"),
        F.array(F.lit("s.test")).alias("allowed_domains"), F.lit(15).alias("max_steps"), F.lit("m").alias("model"), F.lit("browse_v1").alias("prompt_version"),
        F.lit(None).cast("string").alias("prompt_hash"), trace.alias("trace"),
    )


_SESSION_SQL = """entries AS (
  SELECT o_orderkey::VARCHAR AS chain, 0::BIGINT AS seq, 'browse_start' AS action,
    '{"allowed_domains":["s.test"],"max_steps":15,"model":"m","prompt_hash":null,"prompt_version":"browse_v1","start_url":"https://s.test/' || o_orderkey || '"}' AS detail, o_orderdate FROM orders
  UNION ALL SELECT o_orderkey::VARCHAR, i, 'act' || i,
    '{' || CASE WHEN i = 1 THEN '"reasoning":{"eval":null,"memory":"' || o_orderpriority || '","next_goal":"next"},' ELSE '' END || '"step":' || i || ',"url":' ||
    CASE WHEN i <= 2 THEN '"https://s.test/' || i || '"' ELSE 'null' END || '}', o_orderdate FROM orders, range(1, 7) t(i) WHERE i <= dayofweek(o_orderdate)
  UNION ALL SELECT o_orderkey::VARCHAR, dayofweek(o_orderdate) + 1, 'browse_done', '{"result_chars":' || length(o_orderpriority) || ',"steps":' || dayofweek(o_orderdate) || '}', o_orderdate FROM orders)"""


@query("session_log", f"WITH {_SESSION_SQL} SELECT chain, seq, action, detail, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%f+00:00') AS created_at, 'LLM-BROWSE' AS actor FROM entries")
def session_log(spark, sf):
    return A.session_entries(_sessions(spark, sf)).select("chain", "seq", "action", "detail", "created_at", "actor")


@query("session_lines", f"""WITH {_SESSION_SQL}
SELECT chain, seq, action, CASE WHEN action = 'browse_start' THEN 'https://s.test/' || chain WHEN seq <= 2 AND action <> 'browse_done' THEN 'https://s.test/' || seq ELSE '' END AS place,
       CASE WHEN action = 'act1' THEN 'next' END AS next_goal FROM entries""")
def session_lines(spark, sf):
    return A.log_lines(A.session_entries(_sessions(spark, sf)))


@query("session_footer", "SELECT o_orderkey::VARCHAR AS chain, dayofweek(o_orderdate)::INTEGER AS steps, length(o_orderpriority)::INTEGER AS result_chars FROM orders")
def session_footer(spark, sf):
    return A.session_footer(_sessions(spark, sf))


@query("session_seal", """
SELECT o_orderkey::VARCHAR AS chain, true AS ok, -1::BIGINT AS first_bad, dayofweek(o_orderdate) + 2 AS count FROM orders""")
def session_seal(spark, sf):
    return _verdict(A.verify_chains(A.seal_entries(A.with_canonical(A.session_entries(_sessions(spark, sf))))))


_ACTIONS = V.ctes(V.SCORES, V.FEEDBACK, V.INGESTED, V.RUNS, V.OBSERVATIONS) + f""",
first_rows AS (SELECT platform, external_id, arg_min(seq, (observed_at, seq)) AS seq FROM observations WHERE external_id IS NOT NULL GROUP BY 1, 2),
actions AS (
  SELECT run_id, NULL::BIGINT AS listing_id, 'api' AS actor, 'run_start' AS action, '{{"mode":"' || mode || '","trigger":"api"}}' AS detail, started_at AS moment, run_id AS source_id FROM runs
  UNION ALL SELECT run_id, NULL, 'api', 'run_end', '{{"status":"completed"}}', finished_at, run_id FROM runs
  UNION ALL SELECT run_id, external_id::BIGINT, 'collector', 'collect', '{{"external_id":"' || external_id || '","new":' || (seq IN (SELECT seq FROM first_rows)) || '}}', observed_at, seq FROM observations WHERE external_id IS NOT NULL
  UNION ALL SELECT run_id, listing_id, 'LLM-SCORE', 'score', '{{"category":"' || category || '","suspicion_score":' || suspicion_score::DOUBLE || '}}', scored_at, score_id FROM scores
  UNION ALL SELECT NULL, listing_id, 'investigator', 'validate', '{{"decision":"' || decision || '","investigator_ref":"' || investigator_ref || '"}}', decided_at, feedback_id FROM feedback
  UNION ALL SELECT NULL, NULL, 'system', 'ingest', '{{"feedback_id":' || feedback_id || '}}', ingested_at, feedback_id FROM ingested)"""


def _actions(spark, sf):
    runs = V.runs(spark, sf).withColumn("actor", F.lit("api")).withColumn("trigger", F.lit("api"))
    seen = V.observations(spark, sf).where(F.col("external_id").isNotNull())
    first = seen.groupBy("platform", "external_id").agg(F.min_by("seq", F.struct("observed_at", "seq")).alias("seq")).select("seq", F.lit(True).alias("_first"))
    marked = seen.join(first, "seq", "left").withColumn("is_new", F.coalesce("_first", F.lit(False)))
    marked = marked.withColumn("actor", F.lit("collector")).withColumn("listing_id", F.col("external_id").cast("long"))
    ingested = V.ingested(spark, sf).withColumn("listing_id", F.lit(None).cast("long"))
    return A.action_events(runs, runs, marked, V.scores(spark, sf), V.feedback(spark, sf), ingested)


@query("action_events", _ACTIONS + f"SELECT coalesce(run_id, -1) AS run_id, coalesce(listing_id, -1) AS listing_id, actor, action, detail, {V.stamp_sql('moment')} AS stamp FROM actions")
def action_events(spark, sf):
    run, ad = [F.coalesce(c, F.lit(-1)).alias(c) for c in ("run_id", "listing_id")]
    return _actions(spark, sf).select(run, ad, "actor", "action", "detail", V.stamp("at").alias("stamp"))


_PART = "coalesce(run_id::VARCHAR, strftime(moment, '%Y-%m-%d'))"


@query("sealed_actions", _ACTIONS + f"""
SELECT {_PART} AS part, count(*) AS entries, true AS ok, true AS fits, NOT bool_or(action = 'score' AND source_id % 50 = 0) AS tampered_ok,
       NOT bool_or(action = 'score' AND source_id % 50 = 0) AS resealed_fits FROM actions GROUP BY 1""")
def sealed_actions(spark, sf):
    """All audit rows sealed by run (without a run: by day) and by heads; changed rows break their part, sealed anew its head."""
    rows = _actions(spark, sf).withColumn("seq", F.struct("at", "action", "source_id")).withColumn("created_at", V.stamp("at"))
    part = F.coalesce(F.col("run_id").cast("string"), F.substring("created_at", 1, 10))
    entries = settled(A.with_canonical(rows.drop("at", "source_id")))
    sealed, heads = A.seal_parts(entries, part)
    sealed = settled(sealed)
    heads = settled(heads)
    whole = F.lit(0)
    changed = (F.col("action") == "score") & (F.col("seq.source_id") % 50 == 0)
    tampered = A.with_canonical(sealed.withColumn("actor", F.when(changed, "someone").otherwise(F.col("actor"))))
    again = A.seal_parts(tampered.drop("prev_hash", "entry_hash", "chain"), part)[0]
    heads_ok = A.verify_chains(heads, "log", "part", whole).select("ok")
    found = A.verify_chains(sealed, "chain", "seq", whole).select(F.col("chain").alias("part"), F.col("count").alias("entries"), "ok")
    found = found.join(A.heads_fit(sealed, heads), "part")
    found = found.join(A.verify_chains(tampered, "chain", "seq", whole).select(F.col("chain").alias("part"), F.col("ok").alias("tampered_ok")), "part")
    found = found.join(A.heads_fit(again, heads).withColumnRenamed("fits", "resealed_fits"), "part")
    return found.crossJoin(F.broadcast(heads_ok.withColumnRenamed("ok", "_heads"))).select(  # one row
        "part", "entries", (F.col("ok") & F.col("_heads")).alias("ok"), "fits", "tampered_ok", "resealed_fits")


@query("audit_tail", _ACTIONS + f"SELECT action, source_id, {V.stamp_sql('moment')} AS stamp FROM actions ORDER BY moment DESC, source_id DESC, action DESC LIMIT 100")
def audit_tail(spark, sf):
    tail = Q.newest_first(_actions(spark, sf).withColumn("tie", F.struct("source_id", "action")), "at", "tie", 100)
    return tail.select("action", "source_id", V.stamp("at").alias("stamp"))


@query("iso_stamps", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f+00:00') AS stamp FROM events")
def iso_stamps(spark, sf):
    return V.table(spark, sf, "events").select("event_id", iso_stamp(F.col("ts").cast("timestamp")).alias("stamp"))


@query("committed_log", f"WITH RECURSIVE {_SEALED} SELECT chain, seq, prev_hash, entry_hash FROM sealed")
def committed_log(spark, sf):
    """A log appended in three batches, one of them twice: each chain goes on where the commits say."""
    root = work_folder(spark)
    entries = _entries(spark, sf).drop("canonical")
    first = Window.partitionBy("chain").orderBy("seq")
    numbered = entries.withColumn("_n", F.row_number().over(first))
    for batch, part in (("a", F.col("_n") == 1), ("b", F.col("_n") == 2), ("a", F.col("_n") == 1), ("c", F.col("_n") > 2)):
        own = numbered.where(part).withColumn("seq", F.when(F.lit(batch == "c"), F.col("_n") - 3).otherwise(0).cast("long")).drop("_n")
        writers.commit_log(own, root, batch)
    stored = writers.read_committed(spark, root).select(F.col("chain").cast("long").alias("chain"), F.col("seq").alias("_at"), "prev_hash", "entry_hash")
    names = numbered.select("chain", "seq", (F.col("_n") - 1).alias("_at"))
    return stored.join(names, ["chain", "_at"]).drop("_at")


@query("verify_files", """
SELECT (conv_id % 7)::BIGINT AS part, count(*)::BIGINT AS entries, true AS ok, conv_id % 7 = 3 AS torn_ok FROM conversations GROUP BY 1, 4""".replace("conv_id % 7 = 3 AS torn_ok", "conv_id % 7 <> 3 AS torn_ok"))
def verify_files(spark, sf):
    """Logs as files of JSON lines, verified where they lie; then one of them again with a line that can't be read."""
    root = work_folder(spark)
    entries = _entries(spark, sf).withColumn("part", F.col("chain") % 7)
    order = Window.partitionBy("part").orderBy("chain", "seq")
    chained = entries.withColumn("seq", F.row_number().over(order).cast("long")).withColumn("chain", F.col("part"))
    sealed = settled(A.seal_entries(chained))
    fields = ["run_id", "listing_id", "actor", "action", "detail", "created_at", "prev_hash", "entry_hash"]
    line = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    torn = F.when((F.col("part") == 3) & (F.col("seq") == 1), F.concat(line, F.lit("\n{torn"))).otherwise(line)
    found = []
    for name, text in (("ok", line), ("torn_ok", torn)):
        lines = sealed.select("part", "seq", text.alias("value")).repartition(7, "part").sortWithinPartitions("part", "seq")
        lines.select("value", "part").write.partitionBy("part").text(f"{root}/{name}")
        _named(spark, f"{root}/{name}")
        verdict = A.verify_logs(readers.read_sealed_logs(spark, f"{root}/{name}"))
        part = F.regexp_extract("chain", r"part=(\d+)", 1).cast("long")
        found.append(verdict.select(part.alias("part"), F.col("count").alias("entries"), F.col("ok").alias(name)))
    return found[0].join(found[1].drop("entries"), "part")


def _named(spark, folder: str) -> None:
    """Log files end in ``.jsonl``: seven parts are renamed."""
    jvm, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    store = jvm.Path(folder).getFileSystem(conf)
    for part in [f.getPath() for f in store.listStatus(jvm.Path(folder)) if f.isDirectory()]:
        for file in [f.getPath() for f in store.listStatus(part) if f.getPath().getName().endswith(".txt")]:
            store.rename(file, jvm.Path(part, file.getName().replace(".txt", ".jsonl")))
