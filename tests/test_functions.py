"""Column builders on literal rows."""

import hashlib
import json
import uuid

from pyspark.sql import functions as F

from adwatch import fixed
from adwatch.functions import display as D
from adwatch.functions import hashing as H
from adwatch.functions import numbers as N
from adwatch.functions import price as P
from adwatch.functions import responses as R
from adwatch.functions import text as X
from adwatch.functions import url as U


def pairs(rows):
    return [tuple(r) for r in rows]


def test_strict_price(column):
    got = pairs(column(P.strict_price, ["484 CHF", "prix à discuter", "1 200 CHF", "1.200,50 CHF", "12'500.- chf", "50"]))
    assert got == [(484.0, "CHF"), (None, None), (1200.0, "CHF"), (None, "CHF"), (None, None), (None, None)]


def test_tolerant_price(column):
    got = pairs(column(P.tolerant_price, ["380 CHF", "1'250 CHF", "1’250 CHF", "1 200 CHF", "1.200,50 CHF", "", "gratuit"]))
    assert got == [
        (380.0, "CHF"), (1250.0, "CHF"), (1250.0, "CHF"), (1.0, None), (None, "CHF"), (None, None), (None, None)
    ]


def test_amounts(column):
    assert column(P.structured_amount, ["420", "1'200", "12,5", "", None, "abc", "12d"]) == [420.0, 1200.0, 12.5, None, None, None, None]
    assert column(P.loose_amount, ["1'200.-", "380", "sur demande"]) == [1200.0, 380.0, None]


def test_categories(column):
    assert column(X.category, ["Contrefaçon", "arnaque", " ARME ", None, "Autre"]) == [
        "contrefacon", "aucune", "arme", "aucune", "autre"
    ]
    assert column(X.fold, ["Règle", "Catégorie ", "œuvre"]) == ["regle", "categorie", "uvre"]


def test_external_ids(column):
    base = "https://site.test"
    got = column(U.external_id, [
        f"{base}/listing/1229", f"{base}/nikka-whisky-70cl/54518054", f"{base}/nikka-whisky-70cl/54518054/",
        f"{base}/nikka-whisky-70cl/54518054?sid=42", f"{base}/annonce/velo-electrique", f"{base}/annonce/velo-electrique?utm=x",
        f"{base}/annonce/autre",
    ])
    assert got[:4] == ["1229", "54518054", "54518054", "54518054"]
    assert got[4] == got[5] == hashlib.sha256(f"{base}/annonce/velo-electrique".encode()).hexdigest()[:16] != got[6]
    assert column(U.numeric_tail_id, [f"{base}/fr/53577445?sid=1", f"{base}/fr/seller?id=999"]) == ["53577445", None]


def test_fallback_identity(column):
    got = column(U.fallback_identity, [("http://a/1", "t", "1", "s"), (None, "Titre", "1200", "http://s")],
                 "u string, t string, p string, s string")
    assert got[0] == "http://a/1"
    assert got[1] == "browse:" + hashlib.sha256(b"Titre|1200|http://s").hexdigest()[:16]


def test_hosts(column):
    got = column(U.host, [
        "http://fake_market:8000/a", "https://WWW.Ricardo.CH/x", "https://user:pw@a.b:1/", "//x.y/z", "relative/path",
        "http://[2001:db8::1]:80/", "mailto:a@b",
    ])
    assert got == ["fake_market", "www.ricardo.ch", "a.b", "x.y", None, "2001:db8::1", None]
    assert column(U.allowed_domains, ["http://a.ch/x", "x"]) == [["a.ch", "http*://a.ch/*"], []]


def test_clean_url(column):
    got = column(U.clean_url, [
        " https://example.test/a ", "https://example.test/annonce/123 (URL approximative)", "ftp://x/y", "http:///x", "", None,
        "HTTP://X.CH", "http://[bad/x",
    ])
    assert got == ["https://example.test/a", None, None, None, None, None, "HTTP://X.CH", None]


def test_resolve_link(column):
    from urllib.parse import urljoin

    base = "http://s.test/shop/list.html?page=1#top"
    links = ["/listing/1", "item/2", "../up", "./here", "?page=2", "#frag", "//other.test/x", "https://z.test/q", "mailto:a@b", "",
             "a//b/../c?x=1", "..", "."]
    assert column(U.resolve_link, [(base, h) for h in links], "b string, h string") == [urljoin(base, h) for h in links]
    bare = "http://s.test"
    assert column(U.resolve_link, [(bare, h) for h in links[:2]], "b string, h string") == [urljoin(bare, h) for h in links[:2]]


def test_search_urls(column):
    from urllib.parse import quote

    terms = ["foie gras", "eau-de-vie é", "a/b~c*d", "x&y"]
    assert column(lambda c: U.search_url(F.lit("http://m/"), c), terms) == [f"http://m/search?q={quote(t)}&page=1" for t in terms]
    got = column(lambda c: U.page_url(F.lit("http://m/l"), F.lit("?page="), c), [1, 2], "p int")
    assert got == ["http://m/l", "http://m/l?page=2"]


def test_html_text(column):
    page = "<html><style>p{}</style><h1>Titre</h1> \n<script>alert(1)</script><p>Texte</p></html>"
    assert column(X.html_text, [page]) == ["Titre Texte"]


def test_labels_and_bands(column):
    assert column(D.risk_band, [0.7, 0.69, 0.4, 0.1], "v double") == ["eleve", "moyen", "moyen", "normal"]
    assert column(D.category_label, ["cites", "inconnu"]) == ["CITES (espèces protégées)", "inconnu"]
    assert column(D.tolerant_score, ["0.950", None, "abc", "1"]) == [0.95, 0.0, 0.0, 1.0]
    assert column(D.points, [0.125, 0.135, 0.5], "v double") == [12, 14, 50]
    assert column(D.decision_label, ["rejete", None]) == ["Écarté", "Non examiné"]
    assert column(D.origin_label, ["A", "B", None]) == ["A · Surveillance", "B · Exploration", "—"]
    assert column(D.depth_steps, ["rapide", "approfondie", "x", None]) == [8, 25, 15, 15]
    assert column(U.public_link, ["http://fake_market:8000/a", "https://x.ch"]) == ["http://localhost:8001/a", "https://x.ch"]
    assert column(D.compose_location, [("5012", "Schönenwerd"), (None, "Berne"), ("", None)], "a string, b string") == [
        "5012 Schönenwerd", "Berne", None
    ]


def test_third_party(column):
    rows = [("anthropic/x", None), ("openai/x", None), ("openai/x", "http://inside:8000/v1"), ("openai/x", "https://api.openai.com/v1"), ("ollama/q", None), ("plain", None)]
    assert column(D.third_party_transfer, rows, "m string, b string") == [True, True, False, True, False, False]


def test_rounding_follows_the_binary_value(column):
    values = [2.675, 0.6125, 0.0625, 1 / 3, 0.9995]
    assert column(lambda c: N.round_even(c, 3), values, "v double") == [round(v, 3) for v in values]
    assert column(N.float_text, [484.0, 0.5, 12345678.0, 12345678.25, 0.0005, 0.0], "v double") == [
        "484.0", "0.5", "12345678.0", "12345678.25", "0.0005", "0.0"
    ]


def test_content_hash(column):
    ad = {"title": 'Vélo "x"', "description": None, "price_amount": 1200.0, "price_currency": "CHF", "seller": "a\nb", "location": "Genève"}
    want = hashlib.sha256(json.dumps(ad, ensure_ascii=False, sort_keys=True).encode()).hexdigest()
    names = ["title", "description", "price_amount", "price_currency", "seller", "location"]
    fields = lambda c: {**dict(zip(names, c)), "price_amount": N.float_text(c[2])}
    got = column(lambda *c: H.content_hash(fields(c)), [tuple(ad[n] for n in names)],
                 "a string, b string, c double, d string, e string, f string")
    assert got == [want]


def test_rule_id(column):
    want = str(uuid.uuid5(uuid.UUID(fixed.RULE_NAMESPACE), "Loi é|Titre"))
    assert column(H.rule_id, [("Loi é", "Titre")], "a string, b string") == [want]


def test_iso_stamp(spark):
    got = spark.sql("select timestamp'2024-01-02 03:04:05.678901' t").select(H.iso_stamp(F.col("t"))).first()[0]
    assert got == "2024-01-02T03:04:05.678901+00:00"


def test_score_responses(column):
    answer = {"score": 0.8, "categorie": "Tabac", "justification": " x "}
    text = json.dumps(answer)
    got = pairs(column(R.score_response, [
        text, f"```json\n{text}\n```", f"Voici : {text} merci", "pas de json", '{"score": 1.7}', '{"score": -0.5}',
        '{"score": "0.7", "categorie": "arnaque"}', '{"score": "haut"}', "[1, 2]", '{"score": null}', None,
    ]))
    good = (True, 0.8, "tabac", "x")
    bad = (False, None, None, None)
    assert got[:3] == [good] * 3
    assert got[3] == bad
    assert [g[1] for g in got[4:7]] == [1.0, 0.0, 0.7]
    assert got[6][2] == "aucune"
    assert got[7] == got[8] == got[9] == got[10] == bad


def test_expansion_responses(column):
    got = column(R.terms_response, ['{"termes": ["Clopes","clopes"," CLOPES "]}', '{"terms": ["A", ""]}', '{"termes": []}', "x"])
    assert got == [["clopes"], ["a"], [], None]
    got = column(R.categories_response, ['{"categories": ["Tabac","x","tabac"]}', '{"categorie": "arme"}', '{"categories": "cites"}', "{}"])
    assert got == [["tabac"], ["arme"], ["cites"], []]


def test_first_json_array(column):
    got = column(R.first_json_array, ['a [x] then [{"t": 1}] [2]', "[]", "none", 'see [1] ok', None, '["]", 2] tail'])
    assert got == ['[{"t": 1}]', "[]", None, "[1]", None, '["]", 2]']


def test_explored_ads(column):
    text = json.dumps([
        {"title": " Montre ", "price_amount": 12, "price_currency": " chf", "url": "https://a.b/1 (approx)"},
        {"title": ""}, "text", {"description": "x"}, {"title": "B", "seller": " s ", "url": "https://a.b/2", "price_amount": "3.5"},
    ])
    ads = [a.asDict() for a in column(lambda c: R.explored_ads(R.array_items(c)), [text])[0]]
    assert [a["price_json"] for a in ads] == ["12", '"3.5"']
    assert [(a["title"], a["price_amount"], a["price_currency"], a["url"], a["seller"]) for a in ads] == [
        ("Montre", 12.0, "CHF", None, None), ("B", 3.5, None, "https://a.b/2", "s")
    ]


def test_parsed_ads(column):
    got = column(R.parsed_ad, ['{"title":"T","price_amount":"1\'200.-","price_currency":"chf"}', '{"price_amount": 5}', "x"])
    assert (got[0].title, got[0].price_amount, got[0].price_currency, got[0].parsed) == ("T", 1200.0, "CHF", True)
    assert (got[1].title, got[1].price_amount) == (None, 5.0)
    assert got[2].parsed is False


def test_prompts(column):
    rows = [("T", "D", 484.0, "CHF", "Berne"), ("T", None, None, None, ""), ("T", "D", 5.0, None, None)]
    got = column(D.ad_prompt, rows, "a string, b string, c double, d string, e string")
    assert got == ["Titre : T\nDescription : D\nPrix : 484.0 CHF\nLieu : Berne", "Titre : T\nDescription : ", "Titre : T\nDescription : D\nPrix : 5.0"]
    rules = [([("t", "tabac", "s", "x")],), ([],)]
    got = column(D.rules_prompt, rules, "r array<struct<title:string,category:string,source:string,text:string>>")
    assert got == ["\n" + fixed.PROMPT_RULES + "\n- [tabac] t (s) : x", ""]
    brief = column(lambda f: D.exploration_brief("go {start_url}{focus_block}", F.lit("http://a"), f, F.array(F.lit("x"), F.lit("y"))), ["ivoire", " "])
    assert "ivoire" in brief[0] and "x, y" in brief[0] and brief[1] == "go http://a"
    many = F.transform(F.sequence(F.lit(1), F.lit(30)), lambda i: F.concat(F.lit("t"), i.cast("string")))
    whole = column(lambda f: D.exploration_brief("{focus_block}", F.lit("u"), f, many), ["x"])[0]
    first = column(lambda f: D.exploration_brief("{focus_block}", F.lit("u"), f, many, most_terms=10), ["x"])[0]
    assert "t30" in whole and "t10" in first and "t11" not in first


def test_character_references(column):
    import html

    texts = ["Caf&eacute; &amp; th&#233; &nbsp;&laquo;x&raquo; &#x20AC; &#128512; &unknown; &#0; &#x110000; &#150; plain", "a & b &amp;lt; &#39;", None, "none",
             "&#99999999999999999999;", "&NotEqualTilde; &fjlig;"]
    assert column(X.unescape, texts) == [t if t is None else html.unescape(t) for t in texts]
    loose = ["&copy 2024 &ltx &notit; &AMP&amp", "?a=1&copy=2"]
    assert column(X.unescape_text, loose) == [html.unescape(t) for t in loose]
    assert column(X.unescape, ["?a=1&copy=2&lt"]) == ["?a=1&copy=2&lt"]


def test_keyword_detector_is_ordered_and_by_substring(column):
    texts = ["Un charme fou", "Vin divin et tabac", "table en bois", "Réplique d'arme"]
    assert column(X.keyword_category, texts) == ["arme", "tabac", "aucune", "contrefacon"]
    assert column(lambda c: X.keyword_flag(X.keyword_category(c)), texts) == [True, True, False, True]
