"""Readers, writers and incremental jobs on files."""

import json
import os
import random

import pytest
from pyspark.errors import PythonException, StreamingQueryException
from pyspark.sql import functions as F

from adwatch import fixed, schema
from adwatch.operators import audit as A
from adwatch.operators import checks
from adwatch.operators import identity as I
from adwatch.sources import readers, writers
from adwatch.sources.elements import json_objects
from adwatch.streaming import ingest
from test_operators import chained, sample


def put(path, text):
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def test_evaluation_files(spark, folder):
    put(f"{folder}/ads.json", json.dumps([{"id": 1, "title": "A", "price": 3}, {"id": 2, "title": "B"}]))
    put(f"{folder}/manifest.json", json.dumps({"labels": {"1": {"suspect": True, "categorie": "arme", "difficulte": "explicite", "piege": False}}}, indent=1))
    put(f"{folder}/results.json", json.dumps({"1": {"llm_score": 0.5, "llm_category": "arme", "kw_flag": True, "kw_category": "arme", "rag_refs": ["x"]}}, indent=1))
    assert sorted((r.id, r.price) for r in readers.read_ads(spark, f"{folder}/ads.json").collect()) == [(1, 3), (2, None)]
    label = readers.read_labels(spark, f"{folder}/manifest.json").first()
    assert (label.id, label.suspect, label.leurre_categorie) == ("1", True, None)
    assert readers.read_results_object(spark, f"{folder}/results.json").first().rag_refs == ["x"]
    assert readers.read_results(spark, f"{folder}/none").count() == 0
    assert readers.read_table(spark, folder, "scores").columns == [c.split()[0] for c in "score_id listing_id run_id model_version_id category suspicion_score category_breakdown rationale rag_refs scored_at".split()]


def test_foreign_logs(spark, folder):
    """Logs with the writer's own spacing and key order, blank lines, float values and a broken line."""
    entries = chained([{**e, "detail": {"z": 1.0, "suspicion_score": 0.95, "b": {"y": None, "x": "é"}}} for e in sample(6)])
    lines = [json.dumps(e, ensure_ascii=False) for e in entries]
    put(f"{folder}/good.jsonl", "\n".join(lines[:3]) + "\n\n" + "\n".join(lines[3:]) + "\n")
    entries[2]["action"] = "changed"
    put(f"{folder}/bad.jsonl", "\n".join(json.dumps(e, ensure_ascii=False) for e in entries))
    put(f"{folder}/torn.jsonl", "\n".join(lines[:2]) + "\n{broken")
    os.makedirs(f"{folder}/other")
    put(f"{folder}/other/good.jsonl", "\n".join(lines[:2]))
    put(f"{folder}/notes.txt", "no log")
    verdicts = A.verify_logs(readers.read_sealed_logs(spark, folder)).collect()
    got = {r.chain.split(os.path.basename(folder) + "/")[1]: (r.ok, r.first_bad, r["count"], r.error) for r in verdicts}
    assert got["other/good.jsonl"] == (True, None, 2, None) and len(got) == 4
    assert got["good.jsonl"] == (True, None, 6, None) and got["bad.jsonl"] == (False, 2, 6, None)
    assert got["torn.jsonl"][0] is False and "broken" in got["torn.jsonl"][3]


def test_written_logs_continue(spark, folder):
    def rows(*chains):
        made = [(c, i, None, i, "a", f"x{i}", '{"n":1}', "t") for c in chains for i in range(4)]
        return spark.createDataFrame(made, "chain string, seq long, run_id long, listing_id long, actor string, action string, detail string, created_at string")

    writers.write_log(rows("c", "d"), f"{folder}/log")
    writers.append_log(rows("c", "e"), f"{folder}/log")
    log = writers.read_log(spark, f"{folder}/log")
    assert {r.chain: (r.ok, r["count"]) for r in A.verify_chains(log).collect()} == {"c": (True, 8), "d": (True, 4), "e": (True, 4)}
    whole = chained([dict(run_id=None, listing_id=i, actor="a", action=f"x{i}", detail={"n": 1}, created_at="t") for _ in range(2) for i in range(4)])
    assert {r.chain: r.entry_hash for r in A.chain_heads(log).collect()}["c"] == whole[-1]["entry_hash"]


def test_commit_table(spark, folder):
    """A repeated batch leaves one copy, old entries are not read, a lost race seals behind the winner, leftovers stay unseen."""
    def rows(*chains):
        made = [(c, i, None, i, "a", f"x{i}", '{"n":1}', "t") for c in chains for i in range(4)]
        return spark.createDataFrame(made, "chain string, seq long, run_id long, listing_id long, actor string, action string, detail string, created_at string")

    assert writers.read_committed(spark, folder).count() == 0
    assert writers.commit_log(rows("c", "d"), folder, "one") and not writers.commit_log(rows("c", "d"), folder, "one")
    first = writers._commits(spark, folder).where("folder IS NOT NULL").first()["folder"]
    hidden = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{first}")
    away = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/away")
    store = hidden.getFileSystem(spark._jsc.hadoopConfiguration())
    store.rename(hidden, away)  # entries of the first batch can't be read now, and need not be
    assert writers.commit_log(rows("c", "e"), folder, "two")
    store.rename(away, hidden)
    rows("z").write.json(f"{folder}/entries/leftover")
    log = writers.read_committed(spark, folder)
    assert {r.chain: (r.ok, r["count"]) for r in A.verify_chains(log).collect()} == {"c": (True, 8), "d": (True, 4), "e": (True, 4)}
    real, lost = writers._published, []

    def late(spark, staged, target):
        if not lost:  # another writer takes the version first
            lost.append(target)
            real(spark, staged, f"{folder}/unused/x.parquet")
            writers._published = real
            assert writers.commit_log(rows("c"), folder, "other")
            return False
        return real(spark, staged, target)

    writers._published = late
    try:
        assert writers.commit_log(rows("c"), folder, "three")
    finally:
        writers._published = real
    log = writers.read_committed(spark, folder)
    assert {r.chain: (r.ok, r["count"]) for r in A.verify_chains(log).collect()} == {"c": (True, 16), "d": (True, 4), "e": (True, 4)}
    writers.write_json(rows("x"), f"{folder}/other.json")
    spark.createDataFrame([(1,)], "a int").write.parquet(f"{folder}/staged/again")
    assert not real(spark, f"{folder}/staged/again", f"{folder}/commits/{0:012d}.parquet")


def test_seeds(spark):
    assert readers.platform_seed(spark).count() > 0 and readers.selector_seed(spark).first()["status"] == "active"


def test_rule_upsert_and_versions(spark, folder):
    old = spark.createDataFrame([("a", [1.0], "x"), ("b", [2.0], "y")], "rule_id string, embedding array<float>, title string")
    new = spark.createDataFrame([("b", [3.0], "z"), ("c", [4.0], "w")], old.schema)
    writers.write_version(old, f"{folder}/rules", 1)
    stored, number = writers.read_newest(spark, f"{folder}/rules")
    writers.write_version(writers.upsert_rules(stored, new), f"{folder}/rules", number + 1)
    writers.write_version(writers.upsert_rules(writers.read_newest(spark, f"{folder}/rules")[0], new), f"{folder}/rules", 3)
    twice = spark.createDataFrame([("b", [5.0], "first", 1), ("b", [6.0], "last", 2)], "rule_id string, embedding array<float>, title string, at int")
    assert [r.title for r in writers.upsert_rules(old, twice, "at").where("rule_id = 'b'").collect()] == ["last"]
    newest, number = writers.read_newest(spark, f"{folder}/rules")
    assert number == 3 and sorted((r.rule_id, r.title) for r in newest.collect()) == [("a", "x"), ("b", "z"), ("c", "w")]


def test_reset(spark, folder):
    writers.append_rows(spark.createDataFrame([(1, 1, None, "i", "confirme", None, None, None)], schema.FEEDBACK), folder, "feedback")
    writers.append_rows(readers.platform_seed(spark), folder, "platforms")
    counts = {r.name: r.n for r in writers.reset_operational(spark, folder, reset_extractors=True).collect()}
    assert counts == {"runs": 0, "observations": 0, "scores": 0, "feedback": 1, "audit_log": 0}
    assert readers.read_table(spark, folder, "feedback").count() == 0 and readers.read_table(spark, folder, "platforms").count() == len(fixed.PLATFORM_SEED)
    assert readers.read_table(spark, folder, "extractor_versions").first().selectors == fixed.SELECTOR_SEED


def test_export_and_reports(spark, folder):
    cases = spark.createDataFrame([(1, "a"), (2, "b")], "feedback_id int, title string")
    writers.export_cases(cases, folder)
    assert spark.read.json(f"{folder}/summary").first()["count"] == 2 and spark.read.json(f"{folder}/cases").count() == 2


def test_code_checks(spark):
    df = spark.createDataFrame([("confirme", 0.2, "arme"), ("peut-etre", 0.6, "aucune"), (None, 0.9, "arme")], "decision string, suspicion_score double, category string")
    assert [r.decision for r in checks.invalid_codes(df, "decision", fixed.DECISIONS).collect()] == ["peut-etre"]
    assert checks.incoherent_scores(df).count() == 2 and checks.out_of_range_scores(df).count() == 0
    names = lambda *n: spark.createDataFrame([(x,) for x in n], "name string")
    assert [r.name for r in checks.missing_tables(names("a", "b"), names("a")).collect()] == ["b"]


def observations(spark, rows):
    return spark.createDataFrame(rows, "platform string, external_id string, observed_at long, seq long, title string")


def test_a_repeated_batch_changes_nothing(spark, folder):
    """A batch that runs again after a failure, and batches with late rows, leave the batch fold."""
    one = observations(spark, [("p", "a", 5, 1, "x"), ("p", "b", 5, 2, None), ("p", None, 5, 3, "skip")])
    two = observations(spark, [("p", "a", 4, 4, "late"), ("p", "c", 6, 5, "new")])
    ingest.append_batch(one, 0, folder)
    ingest.append_batch(two, 1, folder)
    ingest.append_batch(two, 1, folder)
    whole = I.current_listings(one.unionByName(two).where("external_id is not null"))
    assert {tuple(r) for r in ingest.current_state(spark, folder).collect()} == {tuple(r) for r in whole.collect()}
    assert {r.batch_id: (r.total, r.inserted, r.observed) for r in ingest.batch_balance(spark, folder).collect()} == {0: (2, 2, 0), 1: (2, 1, 1)}
    ingest.compact(spark, folder, 1)
    three = observations(spark, [("p", "c", 7, 6, "again"), ("q", "a", 7, 7, "other")])
    ingest.append_batch(three, 2, folder)
    ingest.append_batch(three, 2, folder)
    whole = I.current_listings(one.unionByName(two).unionByName(three).where("external_id is not null"))
    assert {tuple(r) for r in ingest.current_state(spark, folder).collect()} == {tuple(r) for r in whole.collect()}
    assert {r.batch_id: r.inserted for r in ingest.batch_balance(spark, folder).collect()} == {0: 2, 1: 1, 2: 1}
    assert [(r.platform, r.external_id) for r in ingest.new_ads(spark, folder, 2).collect()] == [("q", "a")]


def test_stream_resumes_from_its_checkpoint(spark, folder):
    rows = [observations(spark, [("p", str(i % 3), i, i, f"t{i}")]) for i in range(4)]
    for r in rows[:2]:
        r.coalesce(1).write.mode("append").parquet(f"{folder}/in")

    def run():
        stream = spark.readStream.schema(rows[0].schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
        ingest.ingest_observations(stream, f"{folder}/store", f"{folder}/ck").awaitTermination()
        return {r.external_id: r.observation_count for r in ingest.current_state(spark, f"{folder}/store").collect()}

    assert run() == {"0": 1, "1": 1}
    for r in rows[2:]:
        r.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    assert run() == {"0": 2, "1": 1, "2": 1}


def test_failed_ads_stay_open(spark, folder):
    ads = spark.createDataFrame([(i,) for i in range(6)], "id long")
    calls = []

    def score(broken):
        def run(df):
            calls.append(df.count())
            return df.select(F.col("id").cast("string").alias("id"), F.lit(0.5).alias("llm_score"), (~F.col("id").isin(broken)).alias("ok"))

        return run

    ingest.evaluate_rest(ads, f"{folder}/r", f"{folder}/e", score([1, 2]))
    assert sorted(r.id for r in spark.read.json(f"{folder}/e").collect()) == ["1", "2"]
    ingest.evaluate_rest(ads, f"{folder}/r", f"{folder}/e", score([2]))
    assert calls == [6, 2] and readers.read_results(spark, f"{folder}/r").count() == 5


def test_new_ads_are_told_on_arrival(spark, folder, monkeypatch):
    """Balances told from keyed state equal those of the fold over all batches, also where a batch fails and runs again."""
    from adwatch.session import SETTINGS

    for name, value in SETTINGS.items():
        if "stateStore" in name:
            spark.conf.set(name, value)
    batches = [[("p", "a", 1), ("p", "a", 2), ("p", "b", 3), (None, "a", 4), ("p", None, 5), ("p", "", 6)], [("p", "a", 7), ("q", "a", 8)],
               [("q", "a", 9)] * 40 + [("p", "é", 9), ("p", "b", 9)]]
    frames = [observations(spark, [(*r, 0, "t") for r in b]).coalesce(1) for b in batches]
    put, calls = ingest._put, []

    def failing(df, path, batch_id):
        put(df, path, batch_id)
        calls.append(batch_id)
        if calls == [0, 1]:
            raise OSError("lost")

    monkeypatch.setattr(ingest, "_put", failing)

    def run():
        stream = spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
        ingest.tell_new_ads(stream, folder, f"{folder}/ck").awaitTermination()

    for f in frames[:2]:
        f.write.mode("append").parquet(f"{folder}/in")
    with pytest.raises(StreamingQueryException):
        run()
    frames[2].write.mode("append").parquet(f"{folder}/in")
    run()
    assert calls == [0, 1, 1, 2]
    for i, f in enumerate(frames):
        ingest.append_batch(f.where("platform IS NOT NULL"), i, f"{folder}/fold")

    def shown(balance):
        return {tuple(r) for r in balance.select("batch_id", "total", "inserted", "observed").collect()}

    assert shown(ingest.told_balance(spark, folder)) == shown(ingest.batch_balance(spark, f"{folder}/fold")) == {(0, 3, 2, 1), (1, 2, 1, 1), (2, 42, 1, 41)}
    told = spark.read.parquet(f"{folder}/arrivals").where("batch_id = 2")
    assert {tuple(r) for r in told.drop("batch_id").collect()} == {("q", "a", 40, 41, False), ("p", "é", 1, 1, True), ("p", "b", 1, 2, False)}


@pytest.mark.parametrize("small_rows", [10_000, 3])
def test_huge_json_is_read_by_many_tasks(spark, folder, small_rows):
    """Objects over splits of some hundred bytes: strings with quotes, brackets and escapes, nested objects, one object over many splits."""
    draw = random.Random(3)
    signs = ["a", "é", '"', "\\", "{", "}", "[", "]", ",", ":", "\n", "}{", '\\"']
    word = lambda most: "".join(draw.choice(signs) for _ in range(draw.randrange(most)))
    ads = [{"id": i, "title": word(30), "x": {"y": [word(5), {"z": word(3_000 if i == 40 else 8)}]}} for i in range(150)] + [{}]
    by_key = {f"{word(8)}{i}": ad for i, ad in enumerate(ads)}
    os.makedirs(f"{folder}/mixed")
    put(f"{folder}/array.json", json.dumps(ads, indent=1, ensure_ascii=False))
    put(f"{folder}/object.json", json.dumps(by_key))
    put(f"{folder}/mixed/plain.json", '[1, {"a": "x"}, "}", null, {"a": "y"}]')
    put(f"{folder}/mixed/empty.json", "")
    put(f"{folder}/mixed/none.json", "[]\n")
    put(f"{folder}/deep.json", '{"labels": {"1": {"a": 1}, "2": {"a": 2}}}')
    put(f"{folder}/bad.json", '[[{"a": 1}]]')
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    for n, v in zip(names, ("499", "0")):
        spark.conf.set(n, v)
    try:
        read = lambda name, level=1: json_objects(spark, f"{folder}/{name}", level, small_rows)
        assert spark.read.option("lineSep", "}").text(f"{folder}/array.json").rdd.getNumPartitions() > 20
        plain = lambda rows: sorted(json.dumps(r, sort_keys=True) for r in rows)
        found = read("array.json").collect()
        assert plain(json.loads(r.value) for r in found) == plain(ads) and {r.key for r in found} == {None}
        assert {r.key: json.loads(r.value) for r in read("object.json").collect()} == by_key
        assert sorted(json.loads(r.value)["a"] for r in read("mixed").collect()) == ["x", "y"]
        assert {r.key for r in read("deep.json", 2).collect()} == {"1", "2"}
        with pytest.raises(PythonException, match="not an object"):
            read("bad.json").collect()
    finally:
        for n, v in zip(names, before):
            spark.conf.set(n, v)
