"""Scope, identity and link queries over crawled pages and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from adwatch import fixed
from adwatch.functions import url as U
from adwatch.operators import extract, scope
from workload import query
from workload import views as V

ALLOWED = ["example.com", "blog.ththan.example.net", "thther.example.org"]
BLOCKED = ["utm_source", "pills"]
_HOST = r"regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)"
_IN = "(" + " OR ".join(f"h = '{d}' OR suffix(h, '.{d}')" for d in ALLOWED) + ")"
_BARE = r"regexp_replace(regexp_extract(url, '^[^?#]*'), '/+$', '')"


@query("url_host", f"SELECT page_id, {_HOST} AS host FROM pages")
def url_host(spark, sf):
    return V.table(spark, sf, "pages").select("page_id", U.host(F.col("url")).alias("host"))


@query("url_scope", f"""WITH p AS (SELECT page_id, url, {_HOST} AS h FROM pages)
SELECT page_id, reason = 'ok' AS allowed, reason FROM (
  SELECT page_id, CASE WHEN NOT {_IN} THEN 'hors allowlist: ' || h
    WHEN contains(lower(url), 'utm_source') OR contains(lower(url), 'pills') THEN 'chemin interdit (blocklist)'
    WHEN regexp_matches(lower(regexp_extract(url, '^[^?#]*')), '[.](zip|rar|7z|tar|gz|exe|msi|dmg|apk|bin|iso|pdf|doc|docx|xls|xlsx|ppt|pptx)$') THEN 'téléchargement interdit'
    ELSE 'ok' END AS reason FROM p)""")
def url_scope(spark, sf):
    return V.table(spark, sf, "pages").select("page_id", scope.scope_verdict(F.col("url"), ALLOWED, BLOCKED).alias("v")).select("page_id", "v.*")


@query("domain_table", f"""WITH p AS (SELECT page_id, {_HOST} AS h FROM pages), d AS (SELECT 'thth' || lower(substr(n_name, 8)) AS x FROM nation)
SELECT page_id FROM p WHERE h LIKE '%.example.net' OR h = 'spam-farm.example.org'""")
def domain_table(spark, sf):
    rows = V.table(spark, sf, "region").select(F.when(F.col("r_regionkey") % 2 == 0, ".Example.NET").otherwise("spam-farm.example.org").alias("domain"))
    return scope.in_domain_table(V.table(spark, sf, "pages").select("page_id", "url"), rows).select("page_id")


@query("clean_url", """
SELECT page_id, CASE WHEN page_id % 5 = 0 THEN NULL WHEN page_id % 5 = 1 THEN NULL ELSE url END AS clean FROM pages""")
def clean_url(spark, sf):
    raw = F.when(F.col("page_id") % 5 == 0, F.concat("url", F.lit(" (approx)"))).when(
        F.col("page_id") % 5 == 1, F.concat(F.lit("ftp:"), "url")
    ).otherwise(F.concat(F.lit("  "), "url", F.lit("\n")))
    return V.table(spark, sf, "pages").select("page_id", U.clean_url(raw).alias("clean"))


@query("external_id", rf"""SELECT page_id, CASE WHEN regexp_matches({_BARE}, '/\d+$') THEN regexp_extract({_BARE}, '/(\d+)$', 1)
  ELSE left(sha256({_BARE}), 16) END AS external_id, nullif(regexp_extract({_BARE}, '/(\d+)$', 1), '') AS numeric_id FROM pages""")
def external_id(spark, sf):
    url = F.col("url")
    return V.table(spark, sf, "pages").select("page_id", U.external_id(url).alias("external_id"), U.numeric_tail_id(url).alias("numeric_id"))


@query("fallback_identity", """
SELECT c_custkey, CASE WHEN c_acctbal >= 5000 THEN 'https://x.test/' || c_custkey
  ELSE 'browse:' || left(sha256(c_name || '|' || floor(c_acctbal)::BIGINT || '|https://x.test'), 16) END AS identity FROM customer""")
def fallback_identity(spark, sf):
    url = F.when(F.col("c_acctbal") >= 5000, F.concat(F.lit("https://x.test/"), F.col("c_custkey").cast("string")))
    identity = U.fallback_identity(url, F.col("c_name"), F.floor("c_acctbal"), F.lit("https://x.test"))
    return V.table(spark, sf, "customer").select("c_custkey", identity.alias("identity"))


@query("search_urls", """SELECT p_partkey, 'https://m.test/search?q=' || replace(p_name, ' ', '%20') || '&page=1' AS search,
  'https://m.test/l' || CASE WHEN p_size <= 1 THEN '' ELSE '?page=' || p_size END AS page FROM part""")
def search_urls(spark, sf):
    return V.table(spark, sf, "part").select(
        "p_partkey", U.search_url(F.lit("https://m.test/"), F.col("p_name")).alias("search"),
        U.page_url(F.lit("https://m.test/l"), F.lit("?page="), F.col("p_size")).alias("page"),
    )


@query("allowed_domains", f"SELECT page_id, {_HOST} || ' http*://' || {_HOST} || '/*' AS domains FROM pages")
def allowed_domains(spark, sf):
    return V.table(spark, sf, "pages").select("page_id", F.array_join(U.allowed_domains(F.col("url")), " ").alias("domains"))


@query("action_budget", """SELECT user_id, event_id FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) WHERE rn <= 40""")
def action_budget(spark, sf):
    events = V.table(spark, sf, "events").select("user_id", "event_id", "ts")
    return scope.within_budget(events, ["user_id"], ["ts", "event_id"], fixed.ACTION_BUDGET).select("user_id", "event_id")


@query("budget_use", """SELECT user_id, count(*) AS requested, least(count(*), 40) AS used, greatest(count(*) - 40, 0) AS cut, greatest(40 - count(*), 0) AS remaining
FROM events GROUP BY 1""")
def budget_use(spark, sf):
    return scope.budget_use(V.table(spark, sf, "events"), ["user_id"], fixed.ACTION_BUDGET)


@query("canonical_check", V.ctes(V.PLATFORMS) + """,
asked AS (SELECT s_suppkey, 'NATION_' || (s_nationkey + s_suppkey % 2) AS platform,
                 CASE s_suppkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 'https://nation_' || s_nationkey || '.example.com' ELSE 'https://other.test' END AS base_url FROM supplier)
SELECT s_suppkey, a.platform, CASE WHEN p.name IS NULL THEN 'unknown_platform' WHEN a.base_url IS NOT NULL AND a.base_url <> rtrim(p.base_url, '/') THEN 'refused' ELSE 'ok' END AS verdict,
       CASE WHEN p.name IS NOT NULL AND (a.base_url IS NULL OR a.base_url = rtrim(p.base_url, '/')) THEN rtrim(p.base_url, '/') END AS effective_url
FROM asked a LEFT JOIN platforms p ON p.name = a.platform""")
def canonical_check(spark, sf):
    key = F.col("s_suppkey")
    asked = V.table(spark, sf, "supplier").select(
        "s_suppkey",
        F.concat(F.lit("NATION_"), (F.col("s_nationkey") + key % 2).cast("string")).alias("platform"),
        F.when(key % 3 == 1, F.concat(F.lit("https://nation_"), F.col("s_nationkey").cast("string"), F.lit(".example.com")))
        .when(key % 3 == 2, "https://other.test").alias("base_url"),
    )
    return scope.canonical_check(asked, V.platforms(spark, sf)).select("s_suppkey", "platform", "verdict", "effective_url")


@query("rejected_sites", "SELECT s_name AS label FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3)")
def rejected_sites(spark, sf):
    sites = V.table(spark, sf, "nation").where(F.col("n_regionkey") < 3).select(
        F.col("n_nationkey").cast("string").alias("label"), F.lit("https://x.test").alias("base_url"), F.lit("").alias("platform")
    )
    asked = V.table(spark, sf, "supplier").select(F.col("s_nationkey").cast("string").alias("label"), "s_name")
    return scope.split_by_allowlist(asked, sites)[1].select(F.col("s_name").alias("label"))


_LINKS = r"""anchors AS (
  SELECT page_id, url, unnest(regexp_extract_all(body, '(?is)<a\s[^>]*>')) AS a, generate_subscripts(regexp_extract_all(body, '(?is)<a\s[^>]*>'), 1) - 1 AS position
  FROM (SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g') AS body FROM pages)),
links AS (
  SELECT page_id, position::INTEGER AS position, href, CASE WHEN regexp_matches(href, '^[a-z]+:') THEN href WHEN href LIKE '/%' THEN regexp_extract(url, '^[a-z]+://[^/?#]*') || href
     WHEN href LIKE '#%' THEN regexp_extract(url, '^[^#]*') || href ELSE NULL END AS link
  FROM (SELECT page_id, url, position, replace(regexp_extract(a, '(?is)\shref\s*=\s*"([^"]*)"', 1), '&amp;', '&') AS href FROM anchors) WHERE href <> '')"""


@query("page_links", f"WITH {_LINKS} SELECT * FROM links")
def page_links(spark, sf):
    pages = V.spread(spark, sf, "pages").select("page_id", "url", "html")
    return extract.page_links(pages).select("page_id", "position", "href", "link")


@query("next_frontier", f"""WITH {_LINKS}
SELECT link, min(page_id) AS page_id, arg_min(position, (page_id, position)) AS position FROM links WHERE link NOT IN (SELECT url FROM pages) GROUP BY 1""")
def next_frontier(spark, sf):
    pages = V.spread(spark, sf, "pages").select("page_id", "url", "html")
    return extract.next_frontier(extract.page_links(pages), pages, ["page_id", "position"])


@query("capped_links", """
WITH cards AS (SELECT l_suppkey AS run_id, l_linenumber AS page_no, l_orderkey AS position, l_partkey AS link FROM lineitem),
fetched AS (SELECT s_suppkey AS run_id, unnest(range(1, 10)) AS page_no FROM supplier),
caps AS (SELECT s_suppkey AS run_id, s_nationkey % 5 + 1 AS max_pages, CASE WHEN s_nationkey % 3 = 0 THEN NULL ELSE s_nationkey + 5 END AS max_listings FROM supplier),
stops AS (SELECT f.run_id, min(f.page_no) AS stop FROM fetched f LEFT JOIN (SELECT DISTINCT run_id, page_no FROM cards) c USING (run_id, page_no) WHERE c.run_id IS NULL AND f.page_no > 1 GROUP BY 1),
firsts AS (SELECT c.run_id, c.link, min((c.page_no, c.position)) AS seen FROM cards c LEFT JOIN stops s USING (run_id) JOIN caps k USING (run_id) WHERE c.page_no <= k.max_pages AND (s.stop IS NULL OR c.page_no < s.stop) GROUP BY 1, 2)
SELECT run_id, link FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY seen, link) AS rn FROM firsts) JOIN caps USING (run_id) WHERE max_listings IS NULL OR rn <= max_listings""")
def capped_links(spark, sf):
    items = V.table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("run_id"), F.col("l_linenumber").alias("page_no"), F.col("l_orderkey").alias("position"),
        F.col("l_partkey").alias("link"),
    )
    sites = V.table(spark, sf, "supplier")
    fetched = sites.select(F.col("s_suppkey").alias("run_id"), F.explode(F.sequence(F.lit(1), F.lit(9))).alias("page_no"))
    key = F.col("s_nationkey")
    selectors = F.create_map(
        F.lit("_max_pages"), (key % 5 + 1).cast("string"),
        F.lit("_max_listings"), F.when(key % 3 == 0, F.lit("many")).otherwise((key + 5).cast("string")))
    caps = sites.select(F.col("s_suppkey").alias("run_id"), extract.cap_settings(selectors).alias("c")).select("run_id", "c.*")
    return extract.capped_listing_links(items, fetched, caps=caps).select("run_id", "link")


@query("public_links", "SELECT page_id, regexp_replace(url, '^[a-z]+://[^/?#]*', 'http://localhost:8001') AS link FROM pages")
def public_links(spark, sf):
    internal = F.regexp_replace("url", "^[a-z]+://[^/?#]*", "http://fake_market:8000")
    return V.table(spark, sf, "pages").select("page_id", U.public_link(internal).alias("link"))
