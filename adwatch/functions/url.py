"""URL parts, cleaning, joining and the identities derived from URLs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from adwatch import fixed
from adwatch.functions.numbers import once
from adwatch.functions.text import SPACE, sha256, strip

_SCHEME = r"^([a-zA-Z][a-zA-Z0-9+.-]*):"
_AUTHORITY = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)"


def authority(url: Column) -> Column:
    return F.regexp_extract(url, _AUTHORITY, 1)


def host_text(url: Column) -> Column:
    """Lower-case host without user and port, empty when there is none.

    ``parse_url`` returns null for hosts with an underscore, hence the regex.
    """
    bare = F.regexp_replace(authority(url), "^.*@", "")
    bracketed = F.regexp_extract(bare, r"^\[([^\]]*)\]", 1)
    name = F.when(bare.startswith("["), bracketed).otherwise(F.regexp_extract(bare, "^[^:]*", 0))
    return F.lower(name)


def host(url: Column) -> Column:
    """The same, null when there is none."""
    return F.nullif(host_text(url), F.lit(""))


def path(url: Column) -> Column:
    """Path without query, fragment and trailing parameters."""
    rest = F.regexp_replace(F.regexp_replace(url, _AUTHORITY, ""), r"^[a-zA-Z][a-zA-Z0-9+.-]*:", "")
    return F.regexp_replace(F.regexp_extract(rest, r"^[^?#]*", 0), ";[^/]*$", "")


def site(url: Column) -> Column:
    """``scheme://authority`` of an absolute URL."""
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*", 0)


def clean_url(c: Column) -> Column:
    """The trimmed URL when it is an exact http(s) address, else null."""
    url = strip(c)
    fine = url.rlike(rf"^(?i:https?)://[^/?#]") & ~url.rlike(SPACE)
    balanced = authority(url).contains("[") == authority(url).contains("]")
    return F.when(fine & balanced, url)


def allowed_domains(url: Column) -> Column:
    """Host plus the URL pattern that covers it; empty when there is no host."""
    h = host(url)
    return F.when(h.isNull(), F.array().cast("array<string>")).otherwise(
        F.array(h, F.concat(F.lit("http*://"), h, F.lit("/*")))
    )


def bare_url(url: Column) -> Column:
    """URL without query, fragment and trailing slashes."""
    return F.regexp_replace(F.regexp_extract(url, r"^[^?#]*", 0), "/+$", "")


def external_id(url: Column) -> Column:
    """Ad number at the end of the path, else the first 16 hex digits of the URL fingerprint."""
    bare = bare_url(url)
    number = F.regexp_extract(bare, r"/(\d+)$", 1)
    return F.when(number != "", number).otherwise(F.left(sha256(bare), F.lit(16)))


def numeric_tail_id(url: Column) -> Column:
    return F.nullif(F.regexp_extract(bare_url(url), r"/(\d+)$", 1), F.lit(""))


def fallback_identity(url: Column, title: Column, price: Column, site_url: Column) -> Column:
    """The ad URL, or a fingerprint of title, price text and site when an explored ad has no URL."""
    basis = F.concat_ws("|", F.coalesce(title, F.lit("")), F.coalesce(price.cast("string"), F.lit("")), site_url)
    mark = F.concat(F.lit(fixed.BROWSE_ID_PREFIX), F.left(sha256(basis), F.lit(16)))
    return F.when(url.isNull() | (url == ""), mark).otherwise(url)


def quote(term: Column) -> Column:
    """Percent-encode for a URL path or query, ``/`` and ``~`` kept."""
    fixes = (("+", "%20"), ("%2F", "/"), ("%7E", "~"), ("*", "%2A"))
    return reduce(lambda c, pair: F.replace(c, F.lit(pair[0]), F.lit(pair[1])), fixes, F.url_encode(term))


def search_url(base: Column, term: Column, page: Column | int = 1) -> Column:
    page = page if isinstance(page, Column) else F.lit(page)
    return F.concat(F.rtrim(base, F.lit("/")), F.lit("/search?q="), quote(term), F.lit("&page="), page.cast("string"))


def page_url(list_url: Column, page_param: Column, page: Column) -> Column:
    """Indexed result page; page 1 is the list URL itself."""
    return F.when(page <= 1, list_url).otherwise(F.concat(list_url, page_param, page.cast("string")))


def _without_dots(segments: Column) -> Column:
    """Path text of segments, ``.`` and ``..`` resolved in one fold, with a leading slash."""
    empty = F.array().cast("array<string>")
    folded = F.aggregate(
        segments,
        empty,
        lambda done, s: F.when(s == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))))
        .when(s == ".", done)
        .otherwise(F.concat(done, F.array(s))),
    )
    tail = F.when(F.element_at(segments, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(empty)
    return once(
        F.array_join(F.concat(folded, tail), "/"), lambda p: F.when(p.startswith("/"), p).otherwise(F.concat(F.lit("/"), p))
    )


def _without_gaps(segments: Column) -> Column:
    """Drop empty segments between the first and the last."""
    inner = F.filter(F.slice(segments, F.lit(2), F.greatest(F.size(segments) - 2, F.lit(0))), lambda s: s != "")
    ends = [F.slice(segments, at, F.lit(1)) for at in (F.lit(1), F.size(segments))]
    return F.when(F.size(segments) > 1, F.concat(ends[0], inner, ends[1])).otherwise(segments)


def resolve_link(base: Column, href: Column) -> Column:
    """Absolute address of a link found on page ``base`` (RFC 3986 joining). Rooted links without dots take a short way."""
    root = site(base)
    base_path = F.regexp_extract(F.regexp_replace(base, _AUTHORITY, ""), r"^[^?#]*", 0)
    base_query = F.regexp_extract(base, r"^[^?#]*(\?[^#]*)?", 1)
    link_path = F.regexp_extract(href, r"^[^?#]*", 0)
    link_tail = F.regexp_extract(href, r"^[^?#]*(.*)$", 1)
    folder = once(F.split(F.regexp_replace(base_path, "[^/]*$", ""), "/"), lambda f: F.slice(f, F.lit(1), F.size(f) - 1))
    below = once(F.concat(folder, F.split(link_path, "/")), _without_gaps)
    segments = F.when(href.startswith("/"), F.split(link_path, "/")).otherwise(below)
    return (
        F.when(href.isNull() | (href == ""), base)
        .when(href.rlike("^/(?!/)") & ~href.contains("/."), F.concat(root, href))
        .when(href.rlike(_SCHEME), href)
        .when(href.startswith("//"), F.concat(F.regexp_extract(base, _SCHEME, 1), F.lit(":"), href))
        .when(href.startswith("#"), F.concat(root, base_path, base_query, href))
        .when(href.startswith("?"), F.concat(root, base_path, href))
        .otherwise(F.concat(root, once(segments, _without_dots), link_tail))
    )


def public_link(url: Column, hosts: dict[str, str] | None = None) -> Column:
    """Rewrite internal demo hosts to the published ones; the first match wins."""
    out = None
    for internal, public in (hosts or fixed.PUBLIC_HOSTS).items():
        swapped = F.replace(url, F.lit(internal), F.lit(public))
        out = F.when(url.contains(internal), swapped) if out is None else out.when(url.contains(internal), swapped)
    return out.otherwise(url)
