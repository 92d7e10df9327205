"""Crawled pages to ads, links and rules.

Everything that regular expressions and VARIANT can express stays in the JVM. Only CSS selection runs in Arrow
batches; the page text is dropped right after it, before any shuffle.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adwatch import fixed, schema
from adwatch.functions import url as U
from adwatch.functions.display import compose_location
from adwatch.functions.price import strict_price, structured_amount, tolerant_price
from adwatch.functions.text import after_colon, fold, strip, unescape, unescape_text, visible_html
from adwatch.operators.checks import identified, missing_fields
from adwatch.operators.ordering import earliest, first_by_cells
from adwatch.operators.skew import lookup_join

CELL = 1_000  # pages, and places on a page, that are counted together


@F.pandas_udf(T.StringType())
def _pick_fields(html: pd.Series, selectors: pd.Series) -> pd.Series:
    """JSON object of selected texts, one page with its own selectors per row; a selector that is not understood raises."""
    return _picked(html, selectors, False)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _try_fields(html: pd.Series, selectors: pd.Series) -> pd.Series:
    """The same for all proposed selectors of a page, which is parsed once; a selector that is not understood picks nothing."""
    return _picked_all(html, selectors, True)


def _picked(html: pd.Series, selectors: pd.Series, lenient: bool) -> pd.Series:
    return _picked_all(html, selectors.map(lambda spec: [spec]), lenient).map(lambda found: found[0])


def _picked_all(html: pd.Series, selectors: pd.Series, lenient: bool) -> pd.Series:
    from adwatch.functions.markup import UnsupportedSelector, parse
    from adwatch.functions.markup import pick as strict

    def pick(root, path: str) -> str | None:
        try:
            return strict(root, path)
        except UnsupportedSelector:
            if not lenient:
                raise
            return None

    parsed: dict[str, dict] = {}

    def fields(root, spec: str | None) -> str:
        if spec not in parsed:
            parsed[spec] = json.loads(spec) if spec else {}
        return json.dumps({name: pick(root, path or "") for name, path in parsed[spec].items()}, ensure_ascii=False)

    def one(page: str | None, specs) -> list[str]:
        root = parse(page or "")
        return [fields(root, spec) for spec in specs]

    return pd.Series([one(page, specs) for page, specs in zip(html, selectors)])


def _scoped(scope: str, fields: dict[str, str], every: bool):
    """Arrow function: JSON array of records, one per scope element (or the first, or the whole page)."""

    @F.pandas_udf(T.StringType())
    def cut(html: pd.Series) -> pd.Series:
        from adwatch.functions.markup import parse, pick, select

        def one(page: str | None) -> str:
            root = parse(page or "")
            scopes = list(select(root, scope))
            if not every:
                scopes = scopes[:1] or [root]
            return json.dumps([{n: pick(s, p) for n, p in fields.items()} for s in scopes], ensure_ascii=False)

        return html.map(one)

    return cut


def _record_type(fields: dict[str, str]) -> str:
    return "array<struct<" + ",".join(f"{n}:string" for n in fields) + ">>"


def result_cards(pages: DataFrame, scope: str = fixed.CARD_SCOPE, fields: dict[str, str] | None = None) -> DataFrame:
    """Result pages to one row per card, with the card's position on its page."""
    fields = fields or fixed.CARD_FIELDS
    kept = [c for c in pages.columns if c not in ("html", "url")]
    cards = pages.select(*kept, F.col("url").alias("page_url"), _scoped(scope, fields, True)("html").alias("_cards"))
    cards = cards.select(*kept, "page_url", F.posexplode(F.from_json("_cards", _record_type(fields))).alias("position", "_card"))
    card, price = F.col("_card"), strict_price(F.coalesce("_card.price", F.lit("")))
    empty = F.lit("")
    return cards.select(
        *kept,
        "page_url",
        "position",
        F.nullif(F.regexp_extract(card["url"], r"/listing/(\d+)", 1), empty).alias("external_id"),
        card["url"].alias("url"),
        F.coalesce(card["title"], empty).alias("title"),
        price["amount"].alias("price_amount"),
        price["currency"].alias("price_currency"),
        F.coalesce(card["platform"], empty).alias("card_platform"),
    )


def detail_ads(pages: DataFrame, scope: str = fixed.DETAIL_SCOPE, fields: dict[str, str] | None = None) -> DataFrame:
    """Detail pages to one ad each; labelled values lose their label."""
    fields = fields or fixed.DETAIL_FIELDS
    kept = [c for c in pages.columns if c not in ("html", "platform")]
    cut = pages.select(*kept, F.from_json(_scoped(scope, fields, False)("html"), _record_type(fields))[0].alias("_ad"))
    ad, empty = F.col("_ad"), F.lit("")
    price = strict_price(F.coalesce(ad["price"], empty))
    text = {n: F.coalesce(ad[n], empty) for n in fields}
    return cut.select(
        *kept,
        F.nullif(after_colon(text["external_id"]), empty).alias("external_id"),
        text["title"].alias("title"),
        price["amount"].alias("price_amount"),
        price["currency"].alias("price_currency"),
        text["platform"].alias("platform"),
        after_colon(text["seller"]).alias("seller"),
        after_colon(text["location"]).alias("location"),
        text["description"].alias("description"),
    )


def field_selectors(selectors: Column) -> Column:
    """The extraction fields of a selector map."""
    return F.map_filter(selectors, lambda k, v: ~k.startswith("_"))


def navigation_keys(selectors: Column) -> Column:
    """The navigation keys of a selector map."""
    return F.map_filter(selectors, lambda k, v: k.startswith("_"))


def merge_candidate(broken: Column, proposed: Column) -> Column:
    """A candidate map: the navigation of the broken version under the proposed fields; null when nothing changes."""
    fields = field_selectors(broken)
    same = F.to_json(F.array_sort(F.map_entries(proposed))) == F.to_json(F.array_sort(F.map_entries(fields)))
    nav = F.map_filter(navigation_keys(broken), lambda k, v: ~F.map_contains_key(proposed, k))
    return F.when(~same & (F.size(proposed) > 0), F.map_concat(nav, proposed))


def extract_fields(pages: DataFrame, versions: DataFrame) -> DataFrame:
    """Apply each platform's selector map to its pages; adds ``fields`` (map of text) and drops ``html``.

    ``versions`` holds one row per platform. Pages stay where they were read unless that table is large.
    """
    specs = versions.select("platform", F.to_json(field_selectors(F.col("selectors"))).alias("_spec"))
    paired = lookup_join(pages, specs, ["platform"])
    return paired.select(
        *[c for c in pages.columns if c != "html"],
        F.from_json(_pick_fields("html", "_spec"), "map<string,string>").alias("fields"),
    )


def selector_ads(extracted: DataFrame, required: Sequence[str] = fixed.REQUIRED_FIELDS) -> DataFrame:
    """``fields`` to ad columns, with the ``missing`` required fields."""
    f = F.col("fields")
    price = tolerant_price(F.coalesce(f["price"], F.lit("")))
    return extracted.select(
        *[c for c in extracted.columns if c != "fields"],
        U.external_id(F.col("url")).alias("external_id"),
        f["title"].alias("title"),
        price["amount"].alias("price_amount"),
        price["currency"].alias("price_currency"),
        f["seller"].alias("seller"),
        f["location"].alias("location"),
        f["description"].alias("description"),
        missing_fields({n: f[n] for n in required}).alias("missing"),
    )


def break_rate(
    checked: DataFrame, order: Sequence[str], keys: Sequence[str] = ("platform",), threshold: float = fixed.BREAK_THRESHOLD
) -> DataFrame:
    """Per platform: pages, broken pages, verdict and the first broken page with its missing fields.

    Only the ordering columns travel; fetch the sample page's HTML by them when a repair needs it.
    """
    bad = F.size("missing") > 0
    sample = F.struct(*order, "missing")
    return (
        checked.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("total"),
            F.count_if(bad).alias("broken"),
            F.min_by(F.when(bad, sample), F.when(bad, F.struct(*order))).alias("_sample"),
        )
        .withColumn("is_broken", F.col("broken") / F.col("total") >= threshold)
        .select(
            *keys, "total", "broken", "is_broken",
            *[F.col("_sample")[c].alias(f"sample_{c}") for c in order],
            F.col("_sample")["missing"].alias("sample_missing"),
        )
    )


def trial_candidates(
    candidates: DataFrame, samples: DataFrame, required: Sequence[str] = fixed.REQUIRED_FIELDS
) -> DataFrame:
    """Try every candidate selector map on its platform's sample pages.

    A selector that is not understood counts as missing. Adds ``missing`` (fields blank on any sample), ``complete`` and ``chosen``: the first complete candidate by
    ``attempt``, or the one with fewest missing fields.
    """
    spec = F.struct("attempt", F.to_json(field_selectors(F.col("selectors"))).alias("spec"))
    specs = candidates.groupBy("platform").agg(F.collect_list(spec).alias("_specs"))  # a handful of candidates per platform
    # one narrow row per platform goes to the pages, which stay where they are read
    paired = lookup_join(samples.select("platform", "html"), specs, ["platform"])
    # a page is parsed once for all candidates
    found = paired.select("platform", "_specs", _try_fields("html", F.col("_specs")["spec"]).alias("_found"))
    zipped = found.select("platform", F.explode(F.arrays_zip(F.col("_specs")["attempt"].alias("attempt"), F.col("_found").alias("f"))).alias("_t"))
    tried = zipped.select("platform", "_t.attempt", F.from_json("_t.f", "map<string,string>").alias("f"))
    tried = tried.withColumn("missing", missing_fields({n: F.col("f")[n] for n in required}))
    outcome = tried.groupBy("platform", "attempt").agg(
        *[F.max(F.array_contains("missing", n)).alias(f"_no_{n}") for n in required]
    )
    names = F.filter(F.array(*[F.when(F.col(f"_no_{n}"), F.lit(n)) for n in required]), lambda n: n.isNotNull())
    outcome = outcome.select("platform", "attempt", names.alias("missing"))
    best = outcome.groupBy("platform").agg(
        F.min_by("attempt", F.struct(F.size("missing"), "attempt")).alias("_best")
    )
    return (
        candidates.join(outcome, ["platform", "attempt"], "left")
        .join(best, "platform", "left")
        .withColumn("complete", F.size("missing") == 0)
        .withColumn("chosen", F.col("attempt") == F.col("_best"))
        .drop("_best")
    )


_JSON_LD = r"""(?is)<script[^>]*type\s*=\s*["']?application/ld\+json["']?[^>]*>(.*?)</script>"""


def _ld_objects(html: Column) -> Column:
    """All JSON-LD objects of a page in order: single objects, lists and ``@graph`` members."""
    blocks = F.transform(F.regexp_extract_all(html, F.lit(_JSON_LD), 1), lambda s: F.try_parse_json(strip(s)))
    blocks = F.filter(blocks, lambda v: v.isNotNull())
    listed = F.transform(
        blocks,
        lambda v: F.coalesce(
            F.try_variant_get(v, "$", "array<variant>"),
            F.try_variant_get(v, '$["@graph"]', "array<variant>"),
            F.array(v),
        ),
    )
    return F.filter(F.flatten(listed), lambda v: F.schema_of_variant(v).startswith("OBJECT"))


def _is_product(v: Column) -> Column:
    kinds = F.try_variant_get(v, '$["@type"]', "array<string>")
    return F.coalesce(
        F.array_contains(kinds, "Product"), F.try_variant_get(v, '$["@type"]', "string") == "Product", F.lit(False)
    )


def product_ads(pages: DataFrame) -> DataFrame:
    """Ads from the first schema.org Product of each page; pages without one drop out."""
    first = F.slice(F.filter(_ld_objects(F.col("html")), _is_product), 1, 1)
    kept = [c for c in pages.columns if c not in ("html", "url")]
    # Exploding none or one object drops pages without a product; a filter would parse every page again.
    found = pages.select(*kept, F.col("url").alias("_page"), F.explode(first).alias("_p"))
    p = F.col("_p")
    offers = F.try_variant_get(p, "$.offers", "array<variant>")
    offer = F.when(offers.isNotNull(), F.try_element_at(offers, F.lit(1))).otherwise(
        F.try_variant_get(p, "$.offers", "variant")
    )

    def text(path: str) -> Column:
        return F.try_variant_get(F.col("_o"), path, "string")

    own_url = F.try_variant_get(p, "$.url", "string")
    found = found.withColumn("_o", offer)
    ad_url = F.coalesce(F.nullif(own_url, F.lit("")), F.nullif(text("$.url"), F.lit("")), "_page")
    return found.select(
        *kept,
        U.numeric_tail_id(ad_url).alias("external_id"),
        ad_url.alias("url"),
        F.try_variant_get(p, "$.name", "string").alias("title"),
        F.try_variant_get(p, "$.description", "string").alias("description"),
        structured_amount(text("$.price")).alias("price_amount"),
        text("$.priceCurrency").alias("price_currency"),
        text("$.seller.name").alias("seller"),
        compose_location(text("$.seller.address.postalCode"), text("$.seller.address.addressLocality")).alias("location"),
    )


def custom_ads(pages: DataFrame, parser: Callable[[pd.Series, pd.Series], pd.DataFrame], keys: Sequence[str]) -> DataFrame:
    """Ads of pages no other reader covers: ``parser(urls, htmls)`` returns one ad per page in the same order.

    ``keys`` are the page columns to keep. Pages whose ad has no identity drop out.
    """
    kept = pages.select(*keys, "url", "html")
    out = T.StructType([*[kept.schema[k] for k in keys], *T.StructType.fromDDL(schema.LISTING).fields])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ads = parser(batch["url"], batch["html"]).reset_index(drop=True)
            yield pd.concat([batch[list(keys)].reset_index(drop=True), ads], axis=1)[out.names]

    return identified(kept.mapInPandas(run, out))


def page_links(pages: DataFrame, css_class: str | None = None, attribute: str | None = None) -> DataFrame:
    """Links of every page in order, made absolute: ``(…, page_url, position, href, link)``.

    ``css_class`` keeps anchors of one class (result cards, the "next" link); ``attribute`` keeps anchors that
    carry an attribute. Links in comments, scripts and styles do not count.
    """
    body = F.regexp_replace(visible_html(F.col("html")), "(?s)<!--.*?-->", " ")
    anchors = F.regexp_extract_all(body, F.lit(r"(?is)<a\s[^>]*>"), 0)
    if css_class:
        pattern = rf"(?i)\sclass\s*=\s*(?:[\"'](?:[^\"']*\s)?{css_class}(?:\s[^\"']*)?[\"']|{css_class}[\s>])"
        anchors = F.filter(anchors, lambda a: a.rlike(pattern))
    if attribute:
        anchors = F.filter(anchors, lambda a: a.rlike(rf"(?i)\s{attribute}[\s=>]"))
    kept = [c for c in pages.columns if c not in ("html", "url")]
    quoted = r"""(?is)\shref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""

    def link(anchor: Column, i: Column) -> Column:
        double, single, bare = (F.regexp_extract(anchor, quoted, g) for g in (1, 2, 3))
        href = F.when(double != "", double).when(single != "", single).otherwise(bare)
        return F.struct(i.alias("position"), unescape(href).alias("href"))

    found = F.filter(F.transform(anchors, link), lambda a: a["href"] != "")
    links = pages.select(*kept, F.col("url").alias("page_url"), F.inline(found))
    return links.withColumn("link", U.resolve_link(F.col("page_url"), F.col("href")))


def next_frontier(links: DataFrame, visited: DataFrame, order: Sequence[str]) -> DataFrame:
    """Distinct links not visited yet, each with its first sighting."""
    fresh = earliest(links, ["link"], order, order)
    return fresh.join(visited.select(F.col("url").alias("link")).distinct(), "link", "left_anti")


def capped_listing_links(
    cards: DataFrame, pages: DataFrame, run: str = "run_id", caps: DataFrame | None = None
) -> DataFrame:
    """Ad links a run may open.

    ``pages`` is ``(run, page_no)`` of fetched result pages, ``cards`` is ``(run, page_no, position, link)``.
    A run stops at its first empty page after page 1. ``caps`` is ``(run, max_pages, max_listings)``, as
    :func:`cap_settings` reads them from the selectors of the run's platform: a run stops at ``max_pages`` and after
    ``max_listings`` distinct links; 0, null, or no row mean no limit. Where a run reaches that number is told by
    counts per page, so only links of that page are ranked, however many the run has.
    """
    filled = cards.groupBy(run, "page_no").agg(F.lit(True).alias("_filled"))
    stop = (
        pages.join(filled, [run, "page_no"], "left")
        .where(F.col("_filled").isNull() & (F.col("page_no") > 1))
        .groupBy(run)
        .agg(F.min("page_no").alias("_stop"))
    )
    open_cards = lookup_join(cards, stop, [run], "left").where(F.col("_stop").isNull() | (F.col("page_no") < F.col("_stop")))
    if caps is None:
        return earliest(open_cards, [run, "link"], ["page_no", "position"], ["page_no", "position"])
    limits = caps.select(run, F.nullif("max_pages", F.lit(0)).alias("_pages"), F.nullif("max_listings", F.lit(0)).alias("_ads"))
    within = lookup_join(open_cards, limits, [run], "left").where(F.col("_pages").isNull() | (F.col("page_no") <= F.col("_pages")))
    first = earliest(within, [run, "link"], ["page_no", "position"], ["page_no", "position", "_ads"])
    page, position = F.col("page_no"), F.col("position")
    cells = [F.floor(page / CELL), page, F.floor(position / CELL)]
    return first_by_cells(first, [run], cells, ["page_no", "position", "link"], "_ads").drop("_ads")


def cap_settings(selectors: Column, default_pages: int = 1, default_listings: int = 0) -> Column:
    """``struct(max_pages, max_listings)`` of a selector map; unusable values fall back to the defaults.

    A selector set without ``_max_pages`` reads one page, as the reader of such sets does.
    """
    pages = F.coalesce(F.try_element_at(selectors, F.lit("_max_pages")).try_cast("int"), F.lit(default_pages))
    ads = F.coalesce(F.try_element_at(selectors, F.lit("_max_listings")).try_cast("int"), F.lit(default_listings))
    return F.struct(F.greatest(F.lit(1), pages).alias("max_pages"), F.greatest(F.lit(0), ads).alias("max_listings"))


def markdown_rules(files: DataFrame) -> DataFrame:
    """Rule files (``path, value``) to rules; a ``###`` line starts one, rules without text drop out."""
    text = F.concat(F.lit("\n"), F.regexp_replace("value", "\r\n?", "\n"))
    blocks = files.select("path", F.posexplode(F.split(text, "\n### ")).alias("position", "_block"))
    blocks = blocks.where(F.col("position") > 0)
    lines = F.transform(F.split("_block", "\n"), strip)
    pairs = F.transform(
        F.filter(lines, lambda s: s.rlike(fixed.RULE_FIELD_LINE)),
        lambda s: F.struct(
            fold(F.regexp_extract(s, fixed.RULE_FIELD_LINE, 1)).alias("k"), strip(F.regexp_extract(s, fixed.RULE_FIELD_LINE, 2)).alias("v")
        ),
    )

    def last(test) -> Column:
        return F.try_element_at(F.filter("_pairs", lambda p: test(p["k"])), F.lit(-1))["v"]

    rules = blocks.select(
        "path", "position", strip(F.element_at(F.split("_block", "\n"), 1)).alias("title"), pairs.alias("_pairs")
    )
    return rules.select(
        "path",
        "position",
        "title",
        last(lambda k: k.startswith("categ")).alias("category"),
        last(lambda k: k == "source").alias("source"),
        last(lambda k: k == "url").alias("url"),
        last(lambda k: k.startswith("regl")).alias("text"),
    ).where(F.col("text") != "")


def page_title(html: Column) -> Column:
    """Text of the ``<title>`` element."""
    return unescape_text(strip(F.regexp_extract(html, "(?is)<title[^>]*>(.*?)</title>", 1)))
