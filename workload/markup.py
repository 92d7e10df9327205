"""Extraction from pages: crawled ones, and ad pages rendered by Spark from parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from adwatch.operators import extract
from workload import query
from workload import views as V


def _url():
    return F.concat(F.lit("https://shop.test/fr/vi/"), F.lower("p_type"), F.lit("/"), F.col("p_partkey").cast("string"))


_URL_SQL = "'https://shop.test/fr/vi/' || lower(p_type) || '/' || p_partkey"


@query("product_ads", f"""
SELECT p_partkey, p_partkey::VARCHAR AS external_id, {_URL_SQL} AS url, p_name AS title, p_type AS description, p_retailprice AS price_amount, 'CHF' AS price_currency,
       p_brand AS seller, p_size || ' ' || p_type AS location FROM part WHERE p_type <> 'ECONOMY'""")
def product_ads(spark, sf):
    """Structured data in every shape a page may hold: one object, a list, a graph, a list of offers."""
    seller = F.struct(
        F.col("p_brand").alias("name"),
        F.struct(F.col("p_size").cast("string").alias("postalCode"), F.col("p_type").alias("addressLocality")).alias("address"),
    )
    offer = F.struct(F.col("p_retailprice").cast("string").alias("price"), F.lit("CHF").alias("priceCurrency"), seller.alias("seller"))
    one = F.col("p_size") % 2 == 0
    offers = F.when(one, F.to_json(offer)).otherwise(F.to_json(F.array(offer)))
    kind = F.when(F.col("p_type") == "ECONOMY", '"Offer"').when(one, '"Product"').otherwise('["Thing","Product"]')
    product = F.concat(
        F.lit('{"@type":'), kind, F.lit(',"name":"'), F.col("p_name"), F.lit('","description":"'), F.col("p_type"), F.lit('","url":"'), _url(),
        F.lit('","offers":'), offers, F.lit("}"),
    )
    shape = F.col("p_size") % 3
    block = (
        F.when(shape == 0, product).when(shape == 1, F.concat(F.lit('[{"@type":"WebPage"},'), product, F.lit("]")))
        .otherwise(F.concat(F.lit('{"@graph":[1,'), product, F.lit("]}")))
    )
    html = F.concat(
        F.lit('<html><script type="application/ld+json">not json</script><script type="application/ld+json">{"@type":"WebPage"}</script>'),
        F.lit("<script type='application/ld+json'>\n"), block, F.lit("\n</script></html>"),
    )
    pages = V.spread(spark, sf, "part").select("p_partkey", F.lit("https://shop.test/page").alias("url"), html.alias("html"))
    return extract.product_ads(pages)


def _detail_page():
    return F.concat(
        F.lit("<html><article class='x listing-detail'><h1 class='title'>"), F.col("p_name"), F.lit(" &amp; co</h1><div class='price'>"),
        F.floor("p_retailprice").cast("string"), F.lit(" CHF</div><div class='platform'>marche</div><div class='seller'>Par : "), F.col("p_brand"),
        F.lit("</div><div class='location'>Ville : "), F.col("p_type"), F.lit("</div><div class='description'>A <b>fine</b> thing<script>x()</script></div><div class='external-id'>Numéro : "),
        F.col("p_partkey").cast("string"), F.lit("</div></article></html>"),
    )


@query("detail_ads", """
SELECT p_partkey, p_partkey::VARCHAR AS external_id, p_name || ' & co' AS title, floor(p_retailprice)::DOUBLE AS price_amount, 'CHF' AS price_currency, 'marche' AS platform,
       p_brand AS seller, p_type AS location, 'Afinething' AS description FROM part""")
def detail_ads(spark, sf):
    pages = V.spread(spark, sf, "part").select("p_partkey", _detail_page().alias("html"))
    return extract.detail_ads(pages)


@query("result_cards", """
SELECT p_partkey, i::INTEGER AS position, (p_partkey * 10 + i)::VARCHAR AS external_id, '/listing/' || (p_partkey * 10 + i) AS url, p_name || ' ' || i AS title,
       (p_size + i)::DOUBLE AS price_amount, 'CHF' AS price_currency, 'foire' AS card_platform FROM part, range(3) t(i)""")
def result_cards(spark, sf):
    card = F.transform(
        F.array(F.lit(0), F.lit(1), F.lit(2)),
        lambda i: F.concat(
            F.lit("<div class='listing-card'><a class='listing-link' href='/listing/"), (F.col("p_partkey") * 10 + i).cast("string"),
            F.lit("'><h2 class='listing-title'>"), F.col("p_name"), F.lit(" "), i.cast("string"), F.lit("</h2></a><span class='listing-price'>"),
            (F.col("p_size") + i).cast("string"), F.lit(" CHF</span><span class='listing-platform'>foire</span></div>"),
        ),
    )
    html = F.concat(F.lit("<body><div class='listing-list'>"), F.array_join(card, ""), F.lit("</div></body>"))
    pages = V.spread(spark, sf, "part").select("p_partkey", F.lit("https://m.test/search").alias("url"), html.alias("html"))
    return extract.result_cards(pages).drop("page_url")


_SELECTORS = {"title": "article h1", "price": ".ad", "description": "title", "_list_path": "/shop"}


def _crawled(spark, sf):
    return V.spread(spark, sf, "pages").select(
        "page_id", "url", "html", F.when(F.col("url").startswith("https"), "secure").otherwise("plain").alias("platform")
    )


def _versions(spark, sf):
    names = F.array(F.lit("secure"), F.lit("plain"))
    maps = F.create_map(*[F.lit(x) for pair in _SELECTORS.items() for x in pair])
    broken = F.create_map(*[F.lit(x) for pair in {**_SELECTORS, "price": ".gone"}.items() for x in pair])
    regions = V.table(spark, sf, "region").where("r_regionkey < 2")
    return regions.select(F.element_at(names, F.col("r_regionkey") + 1).alias("platform"), F.when(F.col("r_regionkey") == 0, maps).otherwise(broken).alias("selectors"))


@query("selector_fields", f"""
SELECT page_id, {V.title_sql()} AS title,
       CASE WHEN url LIKE 'https%' THEN regexp_extract(html, '(?is)<div class="ad">(.*?)</div>', 1) END AS ad FROM pages""")
def selector_fields(spark, sf):
    found = extract.extract_fields(_crawled(spark, sf), _versions(spark, sf))
    return found.select("page_id", F.col("fields")["description"].alias("title"), F.col("fields")["price"].alias("ad"))


@query("break_rate", """
SELECT CASE WHEN url LIKE 'https%' THEN 'secure' ELSE 'plain' END AS platform, count(*) AS total, count(*) FILTER (WHERE url NOT LIKE 'https%') AS broken,
       url NOT LIKE 'https%' AS is_broken, coalesce(min(page_id) FILTER (WHERE url NOT LIKE 'https%'), -1) AS sample_page_id,
       CASE WHEN url NOT LIKE 'https%' THEN 'price' END AS missing
FROM pages GROUP BY ALL""")
def break_rate(spark, sf):
    checked = extract.selector_ads(extract.extract_fields(_crawled(spark, sf), _versions(spark, sf)))
    return extract.break_rate(checked, ["page_id"]).select(
        "platform", "total", "broken", "is_broken", F.coalesce("sample_page_id", F.lit(-1)).alias("sample_page_id"), F.array_join("sample_missing", ",").alias("missing")
    )


@query("candidate_trials", """
SELECT p AS platform, a::BIGINT AS attempt, CASE a WHEN 0 THEN 'price' WHEN 1 THEN '' ELSE '' END AS missing, a > 0 AS complete, a = 1 AS chosen
FROM (VALUES ('secure'), ('plain')) x(p), range(3) t(a) WHERE (SELECT count(*) FROM pages) > 0""")
def candidate_trials(spark, sf):
    base = {k: v for k, v in _SELECTORS.items() if not k.startswith("_")}
    tries = [{**base, "price": ".gone"}, base, {**base, "title": "h1"}]
    maps = F.array(*[F.create_map(*[F.lit(x) for pair in t.items() for x in pair]) for t in tries])
    candidates = _versions(spark, sf).select("platform", F.posexplode(maps).alias("attempt", "selectors"))
    candidates = candidates.withColumn("attempt", F.col("attempt").cast("long"))
    return extract.trial_candidates(candidates, _crawled(spark, sf)).select(
        "platform", "attempt", F.array_join("missing", ",").alias("missing"), "complete", "chosen"
    )


@query("selector_merge", """
SELECT s_suppkey, CASE WHEN s_nationkey % 2 = 1 THEN '_list_path=/l' || s_suppkey || ',title=h2' END AS merged, s_nationkey + 1 AS max_pages, 0 AS max_listings
FROM supplier""")
def selector_merge(spark, sf):
    key = F.col("s_suppkey").cast("string")
    broken = F.create_map(F.lit("title"), F.lit("h1"), F.lit("_list_path"), F.concat(F.lit("/l"), key))
    proposed = F.create_map(F.lit("title"), F.when(F.col("s_nationkey") % 2 == 1, "h2").otherwise("h1"))
    caps = extract.cap_settings(F.create_map(F.lit("_max_pages"), (F.col("s_nationkey") + 1).cast("string"), F.lit("_max_listings"), F.lit("x")))
    merged = F.array_sort(F.map_entries(extract.merge_candidate(broken, proposed)))
    shown = F.array_join(F.transform(merged, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return V.table(spark, sf, "supplier").select("s_suppkey", shown.alias("merged"), caps["max_pages"].alias("max_pages"), caps["max_listings"].alias("max_listings"))


def _read_titles(urls, htmls):
    """A stand-in page parser: the page title is the ad."""
    import pandas as pd

    from adwatch.schema import LISTING

    names = [part.split()[0] for part in LISTING.split(", ")]
    ads = pd.DataFrame({n: pd.Series([None] * len(urls), dtype="object") for n in names})
    ads["external_id"], ads["url"] = urls.str.extract(r"/(\d+)(?:[./?#].*)?$")[0], urls
    ads["title"] = htmls.str.extract(r"<title>(.*?)</title>")[0]
    ads["price_amount"] = ads["price_amount"].astype("float64")
    return ads


@query("custom_ads", r"""
SELECT page_id, regexp_extract(url, '/(\d+)(?:[./?#].*)?$', 1) AS external_id, url, regexp_extract(html, '<title>(.*?)</title>', 1) AS title FROM pages
WHERE regexp_matches(url, '/(\d+)(?:[./?#].*)?$')""")
def custom_ads(spark, sf):
    pages = V.spread(spark, sf, "pages")
    return extract.custom_ads(pages, _read_titles, ["page_id"]).select("page_id", "external_id", "url", "title")


@query("surveillance_ads", rf"""
SELECT page_id, 'secure' AS platform, CASE WHEN regexp_matches(b, '/\d+$') THEN regexp_extract(b, '/(\d+)$', 1) ELSE left(sha256(b), 16) END AS external_id,
       {V.title_sql()} AS description
FROM (SELECT *, regexp_replace(regexp_extract(url, '^[^?#]*'), '/+$', '') AS b FROM pages)
WHERE url LIKE 'https://%' AND regexp_matches(url, '^https://([^/]*\.)?example\.(com|org)/') AND NOT contains(url, 'utm_source')""")
def surveillance_ads(spark, sf):
    """Pages in scope to ads, with the platform whose selectors broke held back."""
    from adwatch.plans import collect

    pages = collect.in_scope(_crawled(spark, sf), ["example.com", "example.org"], ["UTM_source"])
    pages = pages.withColumn("run_id", F.lit(1)).withColumn("page_no", F.col("page_id"))
    ads, _ = collect.surveillance_ads(pages.drop("page_id"), _versions(spark, sf))
    return ads.select(F.col("page_no").alias("page_id"), "platform", "external_id", "description")
