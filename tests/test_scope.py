"""Scope verdicts, budgets and allow-lists."""

from pyspark.sql import functions as F

from adwatch.operators import scope

ALLOW, BLOCK = ["ricardo.ch", ".Anibis.ch"], ["login", "checkout"]


def verdicts(column, urls, **options):
    return [tuple(v) for v in column(lambda c: scope.scope_verdict(c, ALLOW, BLOCK, **options), urls)]


def test_domains(column):
    urls = ["https://ricardo.ch/x", "https://www.ricardo.ch/x", "https://m.anibis.ch", "https://google.com", "https://ricardo.ch.evil.com",
            "https://evil-ricardo.ch", "", "about:blank"]
    assert column(lambda c: scope.domain_allowed(c, ALLOW), urls) == [True, True, True, False, False, False, False, False]


def test_reasons_in_order(column):
    got = verdicts(column, [
        "https://ricardo.ch/annonce/1", "https://ricardo.ch/login", "https://ricardo.ch/x?next=/LOGIN", "https://ricardo.ch/fichier.pdf",
        "https://ricardo.ch/export.XLSX?x=1", "https://tracker.example/login", "nothing", "https://ricardo.ch/a?file=x.pdf",
    ])
    assert got == [
        (True, "ok"), (False, "chemin interdit (blocklist)"), (False, "chemin interdit (blocklist)"), (False, "téléchargement interdit"),
        (False, "téléchargement interdit"), (False, "hors allowlist: tracker.example"), (False, "hors allowlist: None"), (True, "ok"),
    ]
    assert verdicts(column, ["https://ricardo.ch/fichier.pdf"], allow_downloads=True) == [(True, "ok")]


def test_domain_table_matches_the_literal_list(spark):
    urls = ["https://ricardo.ch/x", "https://www.ricardo.ch/x", "https://google.com", "https://ricardo.ch.evil.com", "https://evil-ricardo.ch", "x"]
    pages = spark.createDataFrame([(u,) for u in urls], "url string")
    allow = spark.createDataFrame([(d,) for d in ALLOW], "domain string")
    literal = {r.url for r in pages.where(scope.domain_allowed(F.col("url"), ALLOW)).collect()}
    assert {r.url for r in scope.in_domain_table(pages, allow).collect()} == literal == set(urls[:2])


def test_budget(spark):
    rows = spark.createDataFrame([("a", i) for i in range(5)] + [("b", 0)], "session string, at int")
    kept = scope.within_budget(rows, ["session"], ["at"], 3).collect()
    assert sorted((r.session, r["at"]) for r in kept) == [("a", 0), ("a", 1), ("a", 2), ("b", 0)]
    use = {r.session: (r.requested, r.used, r.cut, r.remaining) for r in scope.budget_use(rows, ["session"], 3).collect()}
    assert use == {"a": (5, 3, 2, 0), "b": (1, 1, 0, 2)}


def test_site_selection(spark):
    sites = spark.createDataFrame([("A", "http://a", None), ("B", "http://b", "bee"), ("", "http://c", None), ("D", "", None)],
                                  "label string, base_url string, platform string")
    asked = spark.createDataFrame([("A",), ("B",), ("D",), ("X",)], "label string")
    accepted, rejected = scope.split_by_allowlist(asked, sites)
    assert sorted((r.label, r.platform) for r in accepted.collect()) == [("A", "A"), ("B", "bee")]
    assert sorted(r.label for r in rejected.collect()) == ["D", "X"]


def test_canonical_urls(spark):
    platforms = spark.createDataFrame([("a", "https://a.ch/"), ("b", None)], "name string, base_url string")
    asked = spark.createDataFrame([("a", "https://a.ch"), ("a", None), ("a", "https://x"), ("b", "https://b"), ("b", None), ("z", "u")],
                                  "platform string, base_url string")
    got = sorted((r.platform, r.base_url or "", r.verdict, r.effective_url) for r in scope.canonical_check(asked, platforms).collect())
    assert got == [("a", "", "ok", "https://a.ch"), ("a", "https://a.ch", "ok", "https://a.ch"), ("a", "https://x", "refused", None),
                   ("b", "", "no_url", None), ("b", "https://b", "ok", "https://b"), ("z", "u", "unknown_platform", None)]
