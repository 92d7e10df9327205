"""Extraction on small page tables."""

import json
import random

import pytest

from pyspark.sql import functions as F

from adwatch import fixed
from adwatch.functions import markup as M
from adwatch.operators import extract as X
from adwatch.operators.ordering import first_by_cells
from adwatch.plans import collect as C
from adwatch.sources import readers

V1 = ("<article class='listing card'><h1 class='listing-title'>Lampe en laiton</h1><div class='listing-price price'>95 CHF</div>"
      "<span class='seller'>kiosque</span><span class='location'>Vevey</span><div class='listing-description'>Peu servie.</div></article>")
V2 = ("<section class='goods card'><h2 class='goods-head'>Lampe en laiton</h2><p class='goods-cost'><span>95</span> <span>CHF</span></p>"
      "<div class='goods-text'>Peu servie.</div></section>")
V2_SELECTORS = {"title": "h2.goods-head", "price": ".goods-cost", "description": ".goods-text", "seller": ".x", "location": ".y"}


def pages_of(spark, *rows):
    return spark.createDataFrame(rows, "platform string, run_id long, page_no long, url string, html string")


def versions_of(spark, selectors, platform="shop"):
    return spark.createDataFrame([(platform, selectors)], "platform string, selectors map<string,string>")


def test_selector_steps():
    root = M.parse("<div id=a><p class='x y' data-k='1'>T &amp; <b>B</b><br>c</p><p>2</p></div><p class=x>out<script>no</script></p>")
    assert M.pick(root, "p.x.y") == "T &Bc"
    assert M.pick(root, "#a p") == "T &Bc" and M.pick(root, "p[data-k=1] b") == "B"
    assert M.pick(root, "p[data-k]@data-k") == "1" and M.pick(root, "ul li") is None and M.pick(root, "") is None
    assert [n.text() for n in M.select(root, "p")] == ["T &Bc", "2", "out"]


def test_versions_of_a_page(spark):
    pages = pages_of(spark, ("shop", 1, 1, "http://m/shop/listing/1", V1))
    got = X.selector_ads(X.extract_fields(pages, versions_of(spark, {**fixed.SELECTOR_SEED, "_max_pages": "3"}))).first()
    assert (got.external_id, got.title, got.price_amount, got.price_currency, got.seller, got.missing) == (
        "1", "Lampe en laiton", 95.0, "CHF", "kiosque", [])
    pages = pages_of(spark, ("shop", 1, 1, "u1", V1), ("shop", 1, 2, "u2", V2), ("shop", 1, 3, "u3", V2))
    checked = X.selector_ads(X.extract_fields(pages, versions_of(spark, fixed.SELECTOR_SEED)))
    rate = X.break_rate(checked, ["page_no"]).first()
    assert (rate.total, rate.broken, rate.is_broken, rate.sample_page_no, rate.sample_missing) == (3, 2, True, 2, ["title", "price", "description"])


def test_candidate_trials(spark):
    samples = spark.createDataFrame([("shop", V2)], "platform string, html string")
    rows = [("shop", 0, fixed.SELECTOR_SEED), ("shop", 1, {**fixed.SELECTOR_SEED, "title": "h2.goods-head"}), ("shop", 2, V2_SELECTORS), ("shop", 3, V2_SELECTORS)]
    tried = X.trial_candidates(spark.createDataFrame(rows, "platform string, attempt long, selectors map<string,string>"), samples)
    assert [(r.attempt, r.missing, r.complete, r.chosen) for r in tried.orderBy("attempt").collect()] == [
        (0, ["title", "price", "description"], False, False), (1, ["price", "description"], False, False), (2, [], True, True), (3, [], True, False)]
    odd = spark.createDataFrame([("shop", 0, {**V2_SELECTORS, "title": "h2::before"})], "platform string, attempt long, selectors map<string,string>")
    assert X.trial_candidates(odd, samples).first().missing == ["title"]
    partial = X.trial_candidates(spark.createDataFrame(rows[:2], "platform string, attempt long, selectors map<string,string>"), samples)
    assert [r.chosen for r in partial.orderBy("attempt").collect()] == [False, True]


def test_candidate_merge(spark):
    row = spark.createDataFrame([({"title": "h1", "_list_path": "/l"}, {"title": "h2", "price": ".p"}, {"title": "h1"})],
                                "b map<string,string>, p map<string,string>, same map<string,string>")
    got = row.select(X.merge_candidate(F.col("b"), F.col("p")).alias("m"), X.merge_candidate(F.col("b"), F.col("same")).alias("s"),
                     X.cap_settings(F.col("b")).alias("c")).first()
    assert got.m == {"_list_path": "/l", "title": "h2", "price": ".p"} and got.s is None and tuple(got.c) == (1, 0)


def test_result_and_detail_pages(spark):
    html = ("<div class='listing-card'><a class='listing-link' href='/listing/7701'><h2 class='listing-title'>Trois vases</h2></a>"
            "<span class='listing-price'>18 CHF</span><span class='listing-platform'>marche</span></div><div class='listing-card'></div>"
            "<a class='page-next' href='/search?page=2'>Plus</a>")
    page = pages_of(spark, ("m", 1, 1, "http://m/search", html))
    cards = X.result_cards(page).orderBy("position").collect()
    assert [(c.external_id, c.url, c.title, c.price_amount, c.price_currency, c.card_platform) for c in cards] == [
        ("7701", "/listing/7701", "Trois vases", 18.0, "CHF", "marche"), (None, None, "", None, None, "")]
    assert [r.link for r in X.page_links(page, css_class="page-next").collect()] == ["http://m/search?page=2"]
    detail = ("<article class='listing-detail'><h1 class='title'>Cadre &#x27;neuf&#x27;</h1><div class='price'>73 CHF</div><div class='platform'>marche</div>"
              "<div class='seller'>Par : m12</div><div class='location'>Ville : Nyon</div><div class='description'>Avec verre.</div>"
              "<div class='external-id'>Numéro : 6150</div></article>")
    ad = X.detail_ads(pages_of(spark, ("m", 1, 1, "u", detail))).first()
    assert (ad.external_id, ad.title, ad.price_amount, ad.platform, ad.seller, ad.location) == ("6150", "Cadre 'neuf'", 73.0, "marche", "m12", "Nyon")


def ld(*blocks):
    return "".join(f"<script type='application/ld+json'>{b if isinstance(b, str) else json.dumps(b)}</script>" for b in blocks)


def test_structured_data(spark):
    product = {"@type": "Product", "name": "Tapis", "url": "https://a.ch/fr/vi/x/41880233", "description": "laine", "offers": {
        "price": 310, "priceCurrency": "CHF", "seller": {"name": "V", "address": {"postalCode": "1260", "addressLocality": "Gland"}}}}
    bare = {"@type": ["Thing", "Product"], "name": "B", "offers": [{"price": "1'200", "url": "https://a.ch/7"}]}
    pages = pages_of(
        spark, ("a", 1, 1, "https://a.ch/p1", ld({"@type": "WebPage"}, product)), ("a", 1, 2, "https://a.ch/p2", ld({"@type": "Offer"})),
        ("a", 1, 3, "https://a.ch/p3", "<p>nothing</p>"), ("a", 1, 4, "https://a.ch/p4", ld("{broken", {"@graph": [{"@type": "X"}, bare]})),
        ("a", 1, 5, "https://a.ch/88?x", ld([1, {"@type": "Product", "name": "C"}])))
    ads = {r.page_no: r for r in X.product_ads(pages).collect()}
    assert sorted(ads) == [1, 4, 5]
    a = ads[1]
    assert (a.external_id, a.title, a.price_amount, a.price_currency, a.seller, a.location) == ("41880233", "Tapis", 310.0, "CHF", "V", "1260 Gland")
    assert (ads[4].external_id, ads[4].price_amount, ads[4].location) == ("7", 1200.0, None)
    assert (ads[5].external_id, ads[5].url, ads[5].price_amount) == ("88", "https://a.ch/88?x", None)


def test_listing_caps(spark):
    cards = [(1, 1, 0, "a"), (1, 1, 1, "b"), (1, 2, 0, "b"), (1, 2, 1, "c"), (1, 4, 0, "z"), (2, 2, 0, "q")]
    cards = spark.createDataFrame(cards, "run_id int, page_no int, position int, link string")
    pages = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (1, 4), (2, 1), (2, 2)], "run_id int, page_no int")

    def links(*caps, run=1):
        table = spark.createDataFrame(list(caps), "run_id int, max_pages int, max_listings int") if caps else None
        return [r.link for r in X.capped_listing_links(cards, pages, caps=table).where(f"run_id = {run}").orderBy("page_no", "position").collect()]

    assert links() == ["a", "b", "c"]
    assert links((1, 1, 0)) == ["a", "b"]
    assert links((1, 9, 2), (2, 9, 1)) == ["a", "b"]
    assert links((1, 1, 0), run=2) == ["q"] and links((2, 1, 0), run=2) == []


def test_frontier(spark):
    html = "<a class='card big' href='/1'>x</a><a href='2' data-item>y</a><!-- <a href='/no'> --><A HREF=/1>z</A><a name=q>n</a>"
    pages = pages_of(spark, ("m", 1, 1, "http://m/list", html), ("m", 1, 2, "http://m/2", ""))
    links = X.page_links(pages)
    assert [r.link for r in links.orderBy("position").collect()] == ["http://m/1", "http://m/2", "http://m/1"]
    assert [(r.link, r.position) for r in X.next_frontier(links, pages, ["page_no", "position"]).collect()] == [("http://m/1", 0)]
    assert [r.href for r in X.page_links(pages, css_class="card").collect()] == ["/1"]
    assert [r.href for r in X.page_links(pages, attribute="data-item").collect()] == ["2"]


def test_rule_files(spark, folder):
    with open(f"{folder}/b.md", "w", encoding="utf-8") as f:
        f.write("# T\n- **Règle** : before\n### Un \n- **Catégorie** : tabac\n- **Source** : LTab\n- **URL** : https://x\n- **Règle** : Texte.\n## Next\n### Deux\n- **Source** : y\n### Trois\n-**Regle**: ok\n")
    with open(f"{folder}/note.txt", "w") as f:
        f.write("### Non\n- **Règle** : x\n")
    rules = X.markdown_rules(readers.read_rule_files(spark, folder)).orderBy("path", "position").collect()
    assert [(r.title, r.category, r.source, r.url, r.text) for r in rules] == [("Un", "tabac", "LTab", "https://x", "Texte."), ("Trois", None, None, None, "ok")]


def test_surveillance_job(spark):
    product = ld({"@type": "Product", "name": "Tabac", "url": "https://a.ch/5", "description": "cartouches"})
    pages = pages_of(
        spark, ("shop", 1, 1, "http://m/listing/1", V1), ("old", 1, 1, "http://o/listing/1", V2), ("ld", 1, 1, "https://a.ch/p", product),
        ("ld", 1, 2, "https://a.ch/q", ld({"@type": "Product", "name": "Chaise"})))
    versions = versions_of(spark, fixed.SELECTOR_SEED).union(versions_of(spark, fixed.SELECTOR_SEED, "old"))
    ads, verdict = C.surveillance_ads(pages, versions, ["LAITON", "", "cartouche"], ["ld"])
    assert sorted((a.platform, a.external_id) for a in ads.collect()) == [("ld", "5"), ("shop", "1")]
    assert {v.platform: v.is_broken for v in verdict.collect()} == {"shop": False, "old": True}
    trials = spark.createDataFrame([("old", 2, True, True)], "platform string, attempt long, complete boolean, chosen boolean")
    stale = C.stale_run_stats(verdict, trials).collect()
    assert [(s.platform, s.extractor_stale, s.repair_ok, s.candidate_id) for s in stale] == [("old", True, True, 2)]
    seen = C.observations(ads, F.current_timestamp(), F.col("page_no")).where("platform = 'shop'").first()
    assert len(seen.content_hash) == 64 and seen.structured.location == "Vevey"
    assert [p.url for p in C.in_scope(pages, ["a.ch"], ["/q"]).collect()] == ["https://a.ch/p"]


def test_exploration_job(spark):
    rows = [("s1", 'vu : [{"title": "A"}, {"title": "B", "url": "https://s/1"}]'), ("s2", "[]"), ("s3", ""), ("s4", "rien"), ("s5", '[{"x": 1}]'), ("s6", None)]
    answers = spark.createDataFrame([(i, 1, "site", "p", "https://s", raw) for i, raw in rows],
                                    "session_id string, run_id long, site string, platform string, base_url string, raw string")
    ads, sessions = C.explored_ads(answers)
    assert {s.session_id: (s.status, s.ads) for s in sessions.collect()} == {
        "s1": ("ok", 2), "s2": ("empty", 0), "s3": ("empty", 0), "s4": ("invalid", 0), "s5": ("invalid", 0), "s6": ("empty", 0)}
    assert sorted(a.external_id[:7] for a in ads.collect()) == ["browse:", "https:/"]


PAGE = """<html><body><div class="c price-box" id="one" lang="fr-CH"><h1>Lamp</h1><p>first</p><p class="pricey">second</p><span>s</span><p>third</p></div>
<ul><li>a</li><li>b</li><li class="x">c</li><li>d</li></ul><section><div><h2>Deep</h2></div></section></body></html>"""


@pytest.mark.parametrize("selector,want", [
    ("div > h1", ["Lamp"]), ("div.c>h1", ["Lamp"]), ("h2, h1", ["Lamp", "Deep"]), ("h1 + p", ["first"]), ("h1 ~ p", ["first", "second", "third"]),
    ("p:nth-child(2)", ["first"]), ("[class^=pri]", ["second"]), ("[class~=price-box] > span", ["s"]), ("[class$='box'] h1", ["Lamp"]),
    ("[class*=ice] > h1", ["Lamp"]), ("div[lang|=fr] h1", ["Lamp"]), ("li:nth-child(odd)", ["a", "c"]), ("li:nth-child(2n)", ["b", "d"]),
    ("li:nth-child(-n+2)", ["a", "b"]), ("li:first-child", ["a"]), ("li:last-child", ["d"]), ("li:not(.x):not(:first-child)", ["b", "d"]),
    ("p:nth-of-type(2)", ["second"]), ("section > h2", []), ("section h2", ["Deep"]), ("#one > p:last-of-type", ["third"]), ("UL > li.x", ["c"]),
    ("li:nth-last-child(2)", ["c"]), ("*:is(h1, h2)", ["Lamp", "Deep"]), ("body div:not(#one) h2", ["Deep"]),
])
def test_selectors(selector, want):
    from adwatch.functions import markup

    assert [e.text() for e in markup.select(markup.parse(PAGE), selector)] == want


@pytest.mark.parametrize("selector", ["p::before", "p:hover", "div >", "> p", "p:nth-child(x)", "p[", "a:has(b)", "p,,q", "p !x"])
def test_unsupported_selectors_raise(selector):
    from adwatch.functions import markup

    with pytest.raises(markup.UnsupportedSelector):
        list(markup.select(markup.parse(PAGE), selector))


@pytest.mark.parametrize("cell", [2, 7, 1_000])
def test_first_rows_by_cells(spark, cell):
    """One run with most links, ties, nulls, limits of all kinds: as many rows as a rank of whole runs keeps."""
    draw = random.Random(cell)
    limits = {0: 430, 1: 3, 2: None, 3: 0, 4: 10_000, 5: 20, None: 2}
    runs = [0] * 900 + [draw.choice([1, 2, 3, 4, 5, None]) for _ in range(400)]
    rows = [(r, draw.choice([None, *range(1, 9)]), draw.choice([None, *range(30)]), i, limits[r]) for i, r in enumerate(runs)]
    df = spark.createDataFrame(rows, "run_id int, page_no int, position int, link int, most int")
    cells = [F.floor(F.col("page_no") / cell), F.col("page_no"), F.floor(F.col("position") / cell)]
    got = first_by_cells(df, ["run_id"], cells, ["page_no", "position", "link"], "most")
    assert got.columns == df.columns
    wanted = set()
    for run, most in limits.items():
        ranked = sorted((r for r in rows if r[0] == run), key=lambda r: tuple(-1 if v is None else v for v in r[1:4]))
        wanted |= set(ranked if run is None else ranked[:most])
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(wanted) and set(found) == wanted
    assert first_by_cells(df.limit(0), ["run_id"], cells, ["link"], "most").count() == 0
