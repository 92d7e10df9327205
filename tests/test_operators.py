"""Operators against brute force and known small cases."""

import hashlib
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from adwatch import fixed
from adwatch.operators import audit as A
from adwatch.operators import evaluate as E
from adwatch.operators import identity as I
from adwatch.operators import ordering as O
from adwatch.operators import paging as P
from adwatch.operators import queue as Q
from adwatch.operators import registry as R
from adwatch.operators import retrieve as T
from adwatch.operators import score as S
from adwatch.operators import search as H
from adwatch.plans import report


def test_previous_row_across_buckets(spark):
    """One hot key over many buckets, sparse and negative sequence numbers."""
    draw = random.Random(7)
    rows = [("hot", s) for s in draw.sample(range(-500, 5000), 300)] + [("cold", 3), ("cold", 4000)]
    df = spark.createDataFrame([(k, s, f"v{s}" if s % 5 else None) for k, s in rows], "k string, s long, v string")
    got = {(r.k, r.s): (r.before, r.position) for r in O.with_previous(df, ["k"], ["s"], F.floor(F.col("s") / 100), {"v": "before"}).collect()}
    assert got == {(r.k, r.s): (r.before, r.position) for r in O.with_previous(df, ["k"], ["s"], None, {"v": "before"}).collect()}
    for key in ("hot", "cold"):
        seen = sorted(s for k, s in rows if k == key)
        for i, s in enumerate(seen):
            before = seen[i - 1] if i else None
            assert got[key, s] == (f"v{before}" if before is not None and before % 5 else None, i)


def test_latest_keeps_nulls_and_breaks_ties(spark):
    df = spark.createDataFrame([("a", 1, 1, "x"), ("a", 2, 2, None), ("a", 2, 1, "y")], "k string, t int, id int, v string")
    assert [(r.k, r.v) for r in O.latest(df, ["k"], ["t", "id"]).select("k", "v").collect()] == [("a", None)]
    assert O.earliest(df, ["k"], ["t", "id"], ["v"]).first().v == "x"


def test_state_merges_in_any_grouping(spark):
    draw = random.Random(3)
    rows = [("p", str(draw.randrange(9)), draw.randrange(50), i, draw.choice(["a", "b", None])) for i in range(300)]
    df = spark.createDataFrame(rows, "platform string, external_id string, observed_at int, seq long, title string")
    whole = {tuple(r) for r in I.current_listings(df).collect()}
    parts = I.partial_state(df.where("seq % 3 = 0")).unionByName(I.partial_state(df.where("seq % 3 <> 0")))
    assert {tuple(r) for r in I.flat_state(I.merge_states(parts)).collect()} == whole
    want = {}
    for p, e, at, seq, title in sorted(rows, key=lambda r: (r[2], r[3])):
        first, _, n, _ = want.get(e, (at, at, 0, None))
        want[e] = (first, at, n + 1, title)
    assert {(r[1]): tuple(r[2:]) for r in whole} == want


def test_balance(spark):
    df = spark.createDataFrame([(1, "p", "a", 1, 1), (1, "p", "a", 1, 2), (1, "p", None, 1, 3), (2, "p", "a", 2, 4), (2, "p", "b", 2, 5)],
                               "run_id int, platform string, external_id string, observed_at int, seq int")
    assert {r.run_id: tuple(r)[1:] for r in I.persist_balance(df).collect()} == {1: (3, 1, 1, 1), 2: (2, 1, 1, 0)}


@pytest.mark.parametrize("sizes", [dict(), dict(inline_floats=0, block_floats=40)])
def test_nearest_rules_equal_brute_force(spark, sizes):
    draw = np.random.default_rng(5)
    rules, queries = draw.normal(size=(30, 8)), draw.normal(size=(60, 8))
    rules[7] = rules[3]  # an exact tie goes to the smaller id
    queries[0] = rules[3]
    q = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(queries)] + [(98, None), (99, [0.0] * 8)], "query_id long, embedding array<float>")
    r = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rules)], "rule_id long, embedding array<float>")
    got = {}
    for row in T.retrieve_rules(q, r, k=3, threshold=0.3, **sizes).collect():
        got.setdefault(row.query_id, {})[row.rank] = (row.rule_id, row.score)
    rules, queries = rules.astype(np.float32).astype(float), queries.astype(np.float32).astype(float)
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    cosine = unit(queries) @ unit(rules).T
    for i in range(60):
        best = sorted(((-c, j) for j, c in enumerate(cosine[i]) if c >= 0.3))[:3]
        assert got.get(i, {}) == {n + 1: (j, round(-c, 3)) for n, (c, j) in enumerate(best)}
    assert 98 not in got and 99 not in got
    assert [got[0][1][0], got[0][2][0]] == [3, 7]


def reads(term, body):
    """Whether a text answers a term: a word begins with a useful word of it, or it stands there when it has none."""
    import re

    useful = tuple(w for w in re.findall(fixed.SEARCH_WORD, term.lower()) if len(w) > 2 and w not in fixed.SEARCH_STOPWORDS)
    return any(w.startswith(useful) for w in re.findall(fixed.SEARCH_WORD, body)) if useful else term.lower() in body


def hits_by_reading(docs, terms):
    bodies = {d: "\n".join(part or "" for part in parts).lower() for d, *parts in docs}
    return {(d, t) for d, body in bodies.items() for t, term in terms if reads(term, body)}


def test_search_paths_equal_brute_force(spark):
    docs = [(1, "Cartouches de cigarettes", "Lot non taxé"), (2, "Bureau d'angle", "défense, dague"), (3, None, "Eau-de-vie de la ferme"),
            (4, "VIN rouge", "vinaigre"), (5, "", ""), (6, "aux écailles", None)]
    terms = [(0, "cartouche"), (1, "d"), (2, "de la"), (3, "Vin d'été"), (4, "écaille lot"), (5, "angle"), (6, "gle"), (7, "e-")]
    df = spark.createDataFrame(docs, "id long, title string, text string")
    t = spark.createDataFrame(terms, "term_id long, term string")
    want = hits_by_reading(docs, terms)
    assert {(r.id, r.term_id) for r in H.search_terms(df, t, "id", "title", "text").collect()} == want
    body = H._body(F.col("title"), F.col("text"))
    joined = [(r.id, r.term_id) for r in H._search_joined(df, H.term_tokens(t), "id", body).collect()]
    assert set(joined) == want and len(joined) == len(want)
    for n, term in terms:
        found = {r.id for r in H.prefix_search(df, term, F.col("title"), F.col("text")).collect()}
        assert found == {d for d, k in want if k == n}
    first = {r.id: r.term_id for r in H.first_hits(H.search_terms(df, t, "id", "title", "text"), "id").collect()}
    assert first == {d: min(k for e, k in want if e == d) for d, _ in want}


def test_term_filter_has_no_fallback(spark):
    df = spark.createDataFrame([("Charme", None), ("Table", "en bois")], "title string, description string")
    keep = lambda terms: H.matching_terms(df, terms, F.col("title"), F.col("description")).count()
    assert (keep(["ARM", ""]), keep(["xyz"]), keep([]), keep(["charme"])) == (1, 0, 2, 1)


def test_expansion(spark):
    rows = spark.createDataFrame([(1, 0, ["a", "b"]), (1, 1, ["b", "c", "a"]), (2, 0, ["z"])], "run_id int, seed_no int, terms array<string>")
    ordered = lambda df: [r.term for r in df.where("run_id = 1").orderBy("seed_no", "position").collect()]
    assert ordered(H.expanded_terms(rows)) == ["a", "b", "c"] and ordered(H.expanded_terms(rows, 2)) == ["a", "b"]


# --- evaluation ---------------------------------------------------------------------------------------------------

LABELS = [("1", True, "tabac", "explicite"), ("2", True, "alcool", "implicite"), ("3", True, "arme", "implicite"), ("4", False, "aucune", "piege"), ("5", False, "aucune", "aucune")]
RESULTS = [("1", 0.5, "tabac", True, "tabac"), ("2", 0.9, "tabac", False, "aucune"), ("3", 0.1, "aucune", False, "aucune"), ("4", 0.7, "cites", True, "cites"), ("5", 0.0, "aucune", False, "aucune")]


def evaluation(spark):
    labels = spark.createDataFrame([(*r, r[3] == "piege") for r in LABELS], "id string, suspect boolean, categorie string, difficulte string, piege boolean")
    results = spark.createDataFrame(RESULTS, "id string, llm_score double, llm_category string, kw_flag boolean, kw_category string")
    return labels, results


def test_confusion(spark):
    labels, results = evaluation(spark)
    ads = spark.createDataFrame([(i,) for i in range(1, 8)], "id long")
    rows = E.detectors(E.evaluation_rows(ads, labels, results))
    q = {r.detector: r for r in E.quality(E.confusion(rows)).collect()}["llm_rag"]
    assert (q.tp, q.fp, q.fn, q.tn, q.precision, q.recall, q.f1, q.category_accuracy) == (2, 1, 1, 1, 0.667, 0.667, 0.667, 0.5)
    levels = {(r.detector, r.difficulte): (r.reading, r.value, r.flagged, r.total) for r in E.by_difficulty(rows).collect()}
    assert levels["llm_rag", "explicite"] == ("rappel", 1.0, 1, 1) and levels["llm_rag", "implicite"] == ("rappel", 0.5, 1, 2)
    assert levels["llm_rag", "piege"] == ("evitement", 0.0, 1, 1) and levels["llm_rag", "aucune"] == ("evitement", 1.0, 0, 1)
    assert {r.id for r in E.pending_evaluation(ads, results).collect()} == {6, 7}


def test_quality_formulas(spark):
    df = spark.createDataFrame([(8, 2, 4, 0, 0), (0, 0, 0, 0, 0)], "tp long, fp long, fn long, tn long, category_hits long")
    got = [(r.precision, r.recall, r.f1, r.category_accuracy) for r in E.quality(df).orderBy(F.desc("tp")).collect()]
    assert got == [(0.8, 0.667, 0.727, 0.0), (0.0, 0.0, 0.0, 0.0)]


def test_score_distribution(spark):
    labels, results = evaluation(spark)
    scored = E.scored_labels(results, labels)
    stats = {r.grp: (r.n, r.min, r.max, round(r.mean, 3), r.median) for r in E.score_stats(E.score_groups(scored)).collect()}
    assert stats["illicites"] == (3, 0.1, 0.9, 0.5, 0.5) and stats["licites"] == (2, 0.0, 0.7, 0.35, 0.7) and stats["pieges"][0] == 1
    hist = {r.bin: (r.illicites, r.licites) for r in E.score_histogram(scored).collect()}
    assert len(hist) == 10 and hist[7] == (0, 1) and hist[9] == (1, 0) and hist[3] == (0, 0)
    gap = E.separation(scored).first()
    assert (gap.lowest_illicit, gap.highest_licit, round(gap.gap, 3), gap.clean) == (0.1, 0.7, -0.6, False)
    top = spark.createDataFrame([("a", 1.0, True)], "id string, s double, suspect boolean").withColumn("score", F.col("s").cast("decimal(4,3)"))
    assert E.score_histogram(top).where("bin = 9").first().illicites == 1


def test_corpus_summary(spark):
    labels, _ = evaluation(spark)
    got = {(r.measure, r.code): r.n for r in E.corpus_summary(labels).collect()}
    assert got["total", ""] == 5 and got["suspects", ""] == 3 and got["pieges", ""] == 1 and got["benignes", ""] == 1
    assert got["difficulte", "implicite"] == 2 and got["categorie", "arme"] == 1 and ("categorie", "aucune") not in got


# --- sealed logs --------------------------------------------------------------------------------------------------


def sealed_text(entry):
    """The text of an entry that its hash covers."""
    return json.dumps({name: entry.get(name) for name in sorted(fixed.SEALED_FIELDS)}, ensure_ascii=False, separators=(",", ":"), sort_keys=True)


def chained(entries, head=None):
    """The entries, each with the hash before it and its own."""
    links = [head]
    for entry in entries:
        links.append(hashlib.sha256(f"{links[-1] or ''}{sealed_text(entry)}".encode()).hexdigest())
    return [{**e, "prev_hash": a, "entry_hash": b} for e, a, b in zip(entries, links, links[1:])]


ENTRY = "chain string, seq long, run_id long, listing_id long, actor string, action string, detail string, created_at string"


def sample(n, chain="c"):
    return [dict(run_id=i if i % 2 else None, listing_id=None, actor="é", action=f"a{i}", detail={"k": "x\"\n", "b": [i, None]}, created_at="t") for i in range(n)]


def as_rows(entries, chain="c", extra=()):
    return [(chain, i, e["run_id"], e["listing_id"], e["actor"], e["action"], json.dumps(e["detail"], sort_keys=True, separators=(",", ":"), ensure_ascii=False), e["created_at"],
             *[e[x] for x in extra]) for i, e in enumerate(entries)]


def test_seal_equals_the_definition(spark):
    entries = sample(7)
    df = A.with_canonical(spark.createDataFrame(as_rows(entries) + as_rows(entries[:3], "d"), ENTRY))
    sealed = A.seal_entries(df)
    got = {(r.chain, r.seq): (r.prev_hash, r.entry_hash) for r in sealed.collect()}
    for i, e in enumerate(chained(entries)):
        assert got["c", i] == (e["prev_hash"], e["entry_hash"])
        if i < 3:
            assert got["d", i] == (e["prev_hash"], e["entry_hash"])
    assert {r.chain: (r.ok, r.first_bad, r["count"]) for r in A.verify_chains(sealed).collect()} == {"c": (True, None, 7), "d": (True, None, 3)}
    parts, heads = A.seal_segments(df, size=2)
    part = parts.withColumn("part", F.concat_ws("#", "chain", "segment"))
    assert all(r.ok for r in A.verify_chains(part, "part").collect())
    assert {r.chain: (r.ok, r["count"]) for r in A.verify_chains(heads, "chain", "segment").collect()} == {"c": (True, 4), "d": (True, 2)}


@pytest.mark.parametrize("change, first_bad", [
    (lambda e: e[1].update(action="x"), 1), (lambda e: e[1].update(entry_hash="0"), 1), (lambda e: e.pop(1), 1),
    (lambda e: e.insert(1, e.pop(2)), 1), (lambda e: None, None), (lambda e: e[0].update(prev_hash="z"), 0),
    (lambda e: e.insert(3, dict(e[2])), 3),
])
@pytest.mark.parametrize("width", [1, 2, 65536])
def test_tampering(spark, change, first_bad, width):
    entries = chained(sample(5))
    change(entries)
    df = spark.createDataFrame(as_rows(entries, extra=("prev_hash", "entry_hash")), f"{ENTRY}, prev_hash string, entry_hash string")
    got = A.verify_chains(A.with_canonical(df), bucket=F.floor(F.col("seq") / width)).first()
    assert (got.ok, got.first_bad, got["count"]) == (first_bad is None, first_bad, len(entries))


def test_session_entries(spark):
    from adwatch import schema

    row = ("s", None, "abc", "https://a", ["a"], 8, "m", None, None, (["https://a"], ["navigate", "click"], [("e", "m", "n")]))
    sessions = spark.createDataFrame([row, ("t", None, None, None, None, None, None, None, None, None)], schema.SESSION).withColumn("started_at", F.lit("2024-01-01").cast("timestamp"))
    got = A.session_entries(sessions).where("chain = 's'").orderBy("seq").collect()
    assert [r.action for r in got] == ["browse_start", "navigate", "click", "browse_done"]
    details = [json.loads(r.detail) for r in got]
    assert details[1] == {"reasoning": {"eval": "e", "memory": "m", "next_goal": "n"}, "step": 1, "url": "https://a"}
    assert details[2] == {"step": 2, "url": None} and details[3] == {"steps": 2, "result_chars": 3}
    assert all(r.detail == json.dumps(d, sort_keys=True, separators=(",", ":")) for r, d in zip(got, details))
    assert [r.action for r in A.session_entries(sessions).where("chain = 't'").orderBy("seq").collect()] == ["browse_start", "browse_done"]
    assert [r.place for r in A.log_lines(A.session_entries(sessions)).where("chain = 's'").orderBy("seq").collect()] == ["https://a", "https://a", "", ""]


# --- queue, report, registry ---------------------------------------------------------------------------------------


def report_tables(spark, target):
    ads = [(1, 1, 11, "alcool", "0.900"), (1, 2, 12, "arme", "0.750"), (1, 3, 13, "arme", "0.850"), (1, 4, 14, None, "x"), (1, 5, 15, "tabac", "0.650")]
    df = spark.createDataFrame([(*a, None, "p", None) for a in ads], "run_id long, listing_id long, score_id long, category string, suspicion_score string, url string, platform string, title string")
    for c in ("price_amount", "price_currency", "location", "rationale", "content_hash"):
        df = df.withColumn(c, F.lit(None).cast("string"))
    from adwatch import schema

    scoring = {"scorees": 41, "alertes": 5, "par_categorie": [{"category": "tabac", "n": 2}, {"category": "arme", "n": 3}]}
    stats = {"etapes": {"expand": {"categories": target, "termes": 14}, "collecte": {"annonces": 41}, "scoring": scoring}}
    run = dict(run_id=1, mode="A", status="completed", params={"target_categories": target, "seeds": ["x", "y"]}, stats=stats, config_snapshot={"platform": "p", "base_url": "https://p"})
    return df, spark.createDataFrame([run], schema.RUN)


def test_report(spark):
    ads, runs = report_tables(spark, ["arme"])
    lines = report.report_ads(ads, runs).orderBy(*report.report_order()).collect()
    assert [(r.categorie, r.score) for r in lines] == [("arme", 0.85), ("arme", 0.75), ("alcool", 0.9), ("tabac", 0.65), ("aucune", 0.0)]
    assert {r.lien_site for r in lines} == {"https://p"}
    head = report.report_headers(ads, runs).first()
    assert (head.analysed, head.revision, head.surveillance, head.normal) == (5, 3, 1, 1)
    assert head.autres_detectees == ["alcool", "tabac"] and head.prompt == "x; y"
    assert [tuple(c) for c in head.par_categorie] == [("arme", 2), ("alcool", 1), ("tabac", 1)]
    assert "14 termes" in head.deroule and "41 annonces" in head.deroule and "5 signal" in head.deroule and "(3 Arme, 2 Tabac)" in head.deroule
    lines = report.report_ads(ads, runs)
    document = report.report_documents(report.report_headers(ads, runs), lines).first()
    assert [a.score for a in document.annonces] == [0.85, 0.75, 0.9, 0.65, 0.0] and document.synthese.par_categorie == {"arme": 2, "alcool": 1, "tabac": 1}
    assert document.seuils.revision == 0.7 and document.run.run_id == 1
    parts = report.report_documents(report.report_headers(ads, runs), lines, part_ads=2).orderBy("part").collect()
    assert [[a.score for a in p.annonces] for p in parts] == [[0.85, 0.75], [0.9, 0.65], [0.0]]
    assert [p.part for p in parts] == [0, 1, 2] and {p.synthese.analysees for p in parts} == {5}
    none = report.report_documents(report.report_headers(ads.limit(0), runs), lines.limit(0)).collect()
    assert [(d.part, d.annonces) for d in none] == [(0, [])]
    ads, runs = report_tables(spark, [])
    assert [r.score for r in report.report_ads(ads, runs).orderBy(*report.report_order()).collect()] == [0.9, 0.85, 0.75, 0.65, 0.0]
    assert report.report_headers(ads, runs).first().autres_detectees == []


def test_run_stats(spark):
    ads, _ = report_tables(spark, [])
    got = S.run_stats(ads).first()
    assert (got.collected, got.scored, got.alerts, [tuple(c) for c in got.per_category]) == (5, 5, 3, [("arme", 2), ("alcool", 1)])
    collected = spark.createDataFrame([(1,), (2,)], "run_id long")
    assert {r.run_id: (r.collected, r.scored) for r in S.run_stats(ads, collected).collect()} == {1: (1, 5), 2: (1, 0)}


def test_minimum_score_drops_unscored_ads(spark):
    listings = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "listing_id long, platform_id long, title string")
    for c in ("price_amount", "price_currency", "url", "seller_label"):
        listings = listings.withColumn(c, F.lit(None).cast("string"))
    listings = listings.withColumn("last_seen_at", F.current_timestamp()).withColumn("structured", F.struct(F.lit("x").alias("location")))
    platforms = spark.createDataFrame([(1, "p")], "platform_id long, name string")
    scores = spark.createDataFrame([(1, 1, 1, "arme", 0.1, 1), (2, 1, 1, "arme", 0.95, 2)], "score_id long, listing_id long, run_id long, category string, suspicion_score double, scored_at long")
    feedback = spark.createDataFrame([], "feedback_id long, listing_id long, decision string, decided_at long")
    runs = spark.createDataFrame([(1, "A")], "run_id long, mode string")
    ids = lambda **f: sorted(r.listing_id for r in Q.queue_history(listings, platforms, scores, feedback, runs, **f).collect())
    assert (ids(), ids(min_score=0.5), ids(min_score=0.96), ids(category="arme"), ids(category="tabac")) == ([1, 2], [1], [], [1], [])


def test_pages(spark):
    df = spark.range(45)
    rows, flags = P.numbered_page(df, [F.col("id")], 9, 20)
    assert [r.id for r in rows.collect()] == list(range(40, 45)) and flags == {"page": 3, "pages": 3, "total": 45, "has_previous": True, "has_next": False}
    assert P.numbered_page(df.where("id < 0"), [F.col("id")], 1, 20)[1]["pages"] == 1


@pytest.mark.parametrize("order", [[("v", True), ("id", True)], [("v", False), ("id", True)], [("w", True), ("v", False), ("id", False)]])
def test_page_map(spark, folder, order):
    """Every page of every size equals the sorted table's; ties and nulls span ranges."""
    draw = random.Random(2)
    rows = [(i, draw.choice([None, 1, 1, 1, 2, 5, 9]), draw.choice(["a", "b", None])) for i in range(230)]
    df = spark.createDataFrame(rows, "id long, v int, w string").repartition(3)
    whole = [r.id for r in df.orderBy(*[F.col(n).asc() if up else F.col(n).desc() for n, up in order]).collect()]
    P.PageMap.of(df, order, 20).store(spark, folder)
    pages = P.PageMap.load(spark, folder)
    assert pages.total == 230 and len(pages.ranges) >= 8
    for offset, limit in ((0, 10), (15, 30), (113, 7), (200, 100), (229, 5), (230, 5)):
        assert [r.id for r in pages.page(df, limit, offset).collect()] == whole[offset:offset + limit]
    rows, flags = pages.numbered(df, 99, 50)
    assert [r.id for r in rows.collect()] == whole[200:] and flags["page"] == 5 and not flags["has_next"]
    with pytest.raises(ValueError):
        pages.page(df, 501)
    assert P.PageMap.of(df.limit(0), order).numbered(df.limit(0), 1, 10)[1]["pages"] == 1


def test_deep_page_reads_one_range(spark, folder):
    """Sorted files: the scan skips all row groups but those of the page's range."""
    spark.range(20_000).withColumn("v", F.col("id") * 3).repartitionByRange(10, "v").sortWithinPartitions("v").write.parquet(f"{folder}/t")
    df = spark.read.parquet(f"{folder}/t")
    pages = P.PageMap.of(df, [("v", True), ("id", True)], 2_000)
    found = pages.page(df, 20, 15_100)
    assert [r.id for r in found.collect()] == list(range(15_100, 15_120))
    spark.conf.set("spark.sql.maxMetadataStringLength", 5_000)
    plan = pages.page(df, 20, 15_100)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = plan[plan.index("PushedFilters"):]
    assert "GreaterThanOrEqual(v," in pushed and "LessThan(v," in pushed
    for n, first, last in pages.ranges:
        assert df.where(P._from(pages.order, first, True) & P._from(pages.order, last, False)).count() == n < 3_000


def test_extractor_decisions(spark):
    versions = spark.createDataFrame([(1, "p", True), (2, "p", False), (3, "p", False), (4, "p", False), (5, "q", False), (6, "q", False)], "version_id long, platform string, initial boolean")
    decisions = [(1, 2, "approve", 10), (2, 2, "reject", 20), (3, 3, "reject", 30), (4, 3, "approve", 40), (5, 4, "approve", 50), (6, 1, "reject", 60), (7, 9, "approve", 70)]
    df = spark.createDataFrame([(*d, "boss") for d in decisions], "decision_id long, version_id long, decision string, t long, decided_by string")
    df = df.withColumn("decided_at", F.timestamp_seconds("t"))
    states = R.extractor_states(versions, df)
    got = {r.version_id: (r.status, r.s) for r in states.select("*", F.unix_timestamp("decided_at").alias("s")).collect()}
    assert got == {1: ("superseded", 10), 2: ("superseded", 50), 3: ("rejected", 30), 4: ("active", 50), 5: ("pending", None), 6: ("pending", None)}
    assert R.several_active(states).count() == 0 and [r.name for r in R.active_platforms(states).collect()] == ["p"]


def test_version_states_merge(spark, folder):
    """Parts in any cut and order, some twice, give what one fold gives; two approvals at one time follow their decision."""
    from adwatch.streaming import ingest

    draw = random.Random(5)
    rows = [(i, f"p{i % 3}" if i < 60 else "hot", i % 20 == 0) for i in range(240)]
    versions = spark.createDataFrame(rows, "version_id long, platform string, initial boolean")
    made = [(i, draw.randrange(250), draw.choice(["approve", "reject"]), draw.randrange(1, 40), f"b{i}") for i in range(300)]
    made += [(900, 3, "approve", 39, "x"), (901, 6, "approve", 39, "y"), (902, None, "approve", 1, "z")]
    schema = "decision_id long, version_id long, decision string, t long, decided_by string"

    def taken(some):
        return spark.createDataFrame(some, schema).withColumn("decided_at", F.timestamp_seconds("t")).drop("t")

    first = {}
    for n, version, decision, t, who in made:
        if version is not None and (version not in first or (t, n) < first[version][:2]):
            first[version] = (t, n, decision, who)
    wanted = {}
    for version, platform, initial in rows:
        line = sorted(first[v][:2] for v, p, seed in rows if p == platform and not seed and v in first and first[v][2] == "approve")
        t, n, decision, who = first.get(version, (None,) * 4)
        if initial:
            wanted[version] = ("superseded", line[0][0], None) if line else ("active", None, None)
        elif decision == "approve":
            later = [m for m in line if m > (t, n)]
            wanted[version] = ("superseded", later[0][0], who) if later else ("active", t, who)
        else:
            wanted[version] = ("pending", None, None) if decision is None else ("rejected", t, who)

    def shown(states):
        return {r.version_id: (r.status, r.s, r.decided_by) for r in states.select("*", F.unix_timestamp("decided_at").alias("s")).collect()}

    assert shown(R.extractor_states(versions, taken(made))) == wanted
    ingest.append_decisions(taken(made[150:]), 0, folder)  # before the versions, and later decisions first
    for _ in range(2):
        ingest.append_decisions(taken(made[:200]), 1, folder, versions)
    assert shown(ingest.version_states(spark, folder)) == wanted
    assert R.extractor_states(versions.limit(0), taken(made)).count() == 0


def test_null_safe_dimension(spark):
    keys = "agent string, model_name string, prompt_version string, prompt_hash string"
    known = spark.createDataFrame([("a", "m", None, None, 7)], f"{keys}, model_version_id long")
    rows = spark.createDataFrame([("a", "m", None, None), ("a", "m", "v", None), ("a", "m", "v", None)], keys)
    assert sorted((r.prompt_version or "", r.model_version_id or 0) for r in R.null_safe_lookup(rows, known, R.MODEL_KEY, "model_version_id").collect()) == [("", 7), ("v", 0), ("v", 0)]
    fresh = R.new_dimension_rows(rows, known, R.MODEL_KEY, "model_version_id").collect()
    assert [(r.prompt_version, r.prompt_hash) for r in fresh] == [("v", None)]
    again = R.new_dimension_rows(rows.limit(2), known, R.MODEL_KEY, "model_version_id").collect()
    assert again[0].model_version_id == fresh[0].model_version_id
    moved = spark.createDataFrame([("a", "m", "v1", None), ("a", "m", None, "v1"), ("a", "m", "null", None)], keys)
    ids = R.new_dimension_rows(moved, known, R.MODEL_KEY, "model_version_id").select("model_version_id").distinct().count()
    assert ids == 3  # a null that moves to another column gives another id


# --- skew ----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("how", ["inner", "left"])
def test_spread_join_equals_plain_join(spark, how):
    """A hot key, a null key and a key without a match."""
    from adwatch.operators import skew

    rows = [(i, "hot") for i in range(200)] + [(200 + i, f"k{i % 7}") for i in range(50)] + [(300, None), (301, "none")]
    facts = spark.createDataFrame(rows, "id int, k string")
    table = spark.createDataFrame([("hot", 1)] + [(f"k{i}", i) for i in range(9)], "k string, v int")
    hot = {r.k: r._parts for r in skew.hot_keys(facts, ["k"], most=10, least_rows=5).collect()}
    assert hot == {"hot": 8}
    plain = sorted(map(tuple, facts.join(table, "k", how).select("id", "k", "v").collect()))
    for joined in (skew.spread_join(facts, table, ["k"], how, most=10, least_rows=5), skew.lookup_join(facts, table, ["k"], how),
                   skew.lookup_join(facts, table, ["k"], how, small_rows=3)):
        assert sorted(map(tuple, joined.select("id", "k", "v").collect())) == plain


@pytest.mark.parametrize("parts", [1, 2, 5, 16])
def test_previous_row_by_scan(spark, parts):
    """Keys over many ranges, over two, within one, null keys and values, ranges of one row, and ties of the whole order."""
    draw = random.Random(parts)
    rows = [("hot", s) for s in draw.sample(range(-500, 5000), 300)] + [("cold", 3), ("cold", 4000), (None, 1), (None, 2), ("one", 7)]
    rows += [(f"k{i % 9}", i) for i in range(60)]
    data = [(k, s, f"v{s}" if s % 5 else None, s % 3) for k, s in rows]
    df = spark.createDataFrame(data, "k string, s long, v string, w int").repartition(3)
    got = O.previous_by_scan(df, ["k"], ["s"], {"v": "before", "w": "_b"}, parts)
    assert got.columns == ["k", "s", "v", "w", "before", "_b", "has_previous", "position"]
    want = {}
    for key in {k for k, _ in rows}:
        seen = sorted((s, v, w) for k, s, v, w in data if k == key)
        for i, (s, v, w) in enumerate(seen):
            want[key, s] = (v, w, *(seen[i - 1][1:] if i else (None, None)), i > 0, i)
    assert {(r.k, r.s): tuple(r)[2:] for r in got.collect()} == want
    other = spark.range(0, 3, 1, 3).selectExpr("'other' AS k", "id AS s", "'' AS before")
    both = other.unionAll(got.select("k", "s", "before")).where("k IS NULL OR k <> 'other'")  # tasks of a union are numbered anew
    assert {(r.k, r.s): r.before for r in both.collect()} == {k: v[2] for k, v in want.items()}
    assert "ReusedExchange" in got._jdf.queryExecution().executedPlan().toString()
    assert O.previous_by_scan(df.limit(0), ["k"], ["s"], {"v": "before"}, parts).collect() == []
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert parts < 5 or max(sizes) < 3.5 * sum(sizes) / parts
    with pytest.raises(ValueError):
        spark.conf.set("spark.sql.exchange.reuse", "false")
        try:
            O.previous_by_scan(df, ["k"], ["s"], {"v": "before"})
        finally:
            spark.conf.unset("spark.sql.exchange.reuse")


def test_routing_is_exact_and_spares_pairs(spark):
    import numpy as np

    from adwatch.operators import retrieve

    rng = np.random.default_rng(5)
    middles = rng.normal(size=(12, 16))
    rules = [(i, (middles[i % 12] + 0.15 * rng.normal(size=16)).tolist()) for i in range(240)] + [(900, [0.0] * 16), (901, None), (902, [1.0])]
    queries = [(i, (middles[i % 12] + 0.15 * rng.normal(size=16)).tolist()) for i in range(150)] + [(900, None), (901, [0.0] * 16)]
    known = spark.createDataFrame(rules, "rule_id long, embedding array<double>")
    asked = spark.createDataFrame(queries, "query_id long, embedding array<double>")
    one = retrieve.retrieve_rules(asked, known, k=4, threshold=0.8)
    two = retrieve.retrieve_rules(asked, known, k=4, threshold=0.8, inline_floats=0, block_floats=200)
    rows = lambda df: sorted((r.query_id, r["rank"], r.rule_id, r.cosine) for r in df.collect())
    assert rows(one) == rows(two) and len(rows(one)) > 400
    vectors = known.select("rule_id", F.col("embedding").alias("_v"))
    _, centers, sizes = retrieve.cluster_rules(vectors, 16, 20)
    routed = retrieve.route_queries(asked.select("query_id", F.col("embedding").alias("_q")), "query_id", 16, 0.8, centers, sizes)
    assert routed.count() < 0.6 * len(sizes) * 150
    first = retrieve.route_queries(asked.select("query_id", F.col("embedding").alias("_q")), "query_id", 16, 0.8, centers, sizes, 4, first=True)
    assert first.count() < 0.3 * len(sizes) * 150


@pytest.mark.parametrize("shard_floats, block_floats", [(4_000_000, 1_000_000), (16 * 20, 16 * 7)])
def test_two_rounds_over_stored_clusters(spark, folder, monkeypatch, shard_floats, block_floats):
    """Rows equal the plain search; a grown bound spares visits; rules are copied once a shard of their own cluster."""
    monkeypatch.setattr(T, "SHARD_FLOATS", shard_floats)
    rng = np.random.default_rng(9)
    middles = rng.normal(size=(15, 16))
    near = lambda i: (middles[i % 15 if i % 3 else 0] + 0.3 * rng.normal(size=16)).tolist()  # noqa: E731 - a third around one centre
    rules = spark.createDataFrame([(i, near(i)) for i in range(300)] + [(900, None), (901, [1.0]), (902, [0.0] * 16)], "rule_id long, embedding array<double>")
    asked = spark.createDataFrame([(i, near(i)) for i in range(200)] + [(900, None)], "query_id long, embedding array<double>")
    T.store_clusters(rules, folder, 25)
    table = T.open_clusters(spark, folder)
    assert len(table.sizes) == len(table.centers) == 25 and sum(n for _, n in table.sizes.values()) == 300
    rows = lambda df: sorted((r.query_id, r["rank"], r.rule_id, r.cosine) for r in df.collect())
    want = rows(T.retrieve_rules(asked, rules, k=3, threshold=0.3))
    assert rows(T.retrieve_clustered(asked, table, k=3, threshold=0.3, block_floats=block_floats)) == want and len(want) == 600
    q = asked.select("query_id", F.col("embedding").alias("_q"))
    route = lambda df, **more: T.route_queries(df, "query_id", 16, 0.3, table.centers, table.sizes, **more)
    bounds = spark.createDataFrame([(i, c) for i, r, _, c in want if r == 3], "query_id long, _bound double")
    plain, first = route(q).count(), route(q, k=3, first=True)
    rest = route(q.join(bounds, "query_id"), k=3).count()
    assert first.count() + rest < 0.6 * plain
    shards = T.copies(first, 16, 16 * 20)
    visits = {r["_cluster"]: r["count"] for r in first.groupBy("_cluster").count().collect()}
    assert shards == {c: -(-n // 20) for c, n in visits.items()}
    copied = sum(table.sizes[c][1] * n for c, n in shards.items())
    assert copied < 0.5 * 300 * -(-200 // 20)  # every rule to every shard
    T.store_clusters(rules.limit(0), f"{folder}/none", 25)
    assert T.retrieve_clustered(asked, T.open_clusters(spark, f"{folder}/none")).collect() == []
