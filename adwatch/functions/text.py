"""Text clean-up, word splitting and category folding."""

from __future__ import annotations

import json
import re
import unicodedata
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from adwatch import fixed

# White space in the Unicode sense; the same class text works in Java regexes and in RE2.
SPACE = (
    r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def squeeze(c: Column) -> Column:
    return F.regexp_replace(c, f"{SPACE}+", " ")


def blank(c: Column) -> Column:
    """True for null, empty and all-white text."""
    return c.isNull() | ~c.rlike(f"(?s)[^{SPACE[1:]}")


def after_colon(c: Column) -> Column:
    """Text after the first ``:``, trimmed; the whole text when there is none."""
    return strip(F.element_at(F.split(c, ":", 2), -1))


def _accents() -> tuple[str, str]:
    """Single letters whose compatibility form is one ASCII letter plus marks, by Unicode rule."""
    source, target = [], []
    for start, stop in ((0xA0, 0x250), (0x1E00, 0x1F00), (0xFF01, 0xFF5F)):
        for code in range(start, stop):
            folded = unicodedata.normalize("NFKD", chr(code)).encode("ascii", "ignore").decode()
            if len(folded) == 1:
                source.append(chr(code))
                target.append(folded)
    return "".join(source), "".join(target)


_ACCENTED, _PLAIN = _accents()


def fold(c: Column) -> Column:
    """Remove accents and every other non-ASCII character, then lower-case and trim."""
    return strip(F.lower(F.regexp_replace(F.translate(c, _ACCENTED, _PLAIN), r"[^\x00-\x7f]", "")))


def category(c: Column) -> Column:
    """Known category code, or ``aucune``."""
    folded = fold(F.coalesce(c, F.lit("")))
    return F.when(folded.isin(fixed.CATEGORIES), folded).otherwise(fixed.NO_CATEGORY)


def visible_html(html: Column) -> Column:
    """HTML without script and style elements (two passes: RE2 and this regex share no back-references)."""
    html = F.regexp_replace(html, "(?is)<script[^>]*>.*?</script>", " ")
    return F.regexp_replace(html, "(?is)<style[^>]*>.*?</style>", " ")


def html_text(html: Column) -> Column:
    """Readable text of a page, whole."""
    return strip(squeeze(F.regexp_replace(visible_html(html), "<[^>]+>", " ")))


# Names that also count without their semicolon, longest first, so that the longest one is taken.
_LOOSE = sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
_NUMERIC = r"&#(?:[0-9]+|[xX][0-9a-fA-F]+);?"


def _character(code: Column) -> Column:
    """The character of a code point; codes that no text can hold give the replacement character, as in a browser."""
    fits = (code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    # 0x80 to 0x9f are read as windows-1252
    windows = F.element_at(F.array(*[F.lit(bytes([i]).decode("cp1252", "replace")) for i in range(0x80, 0xA0)]), (code - 0x7F).cast("int"))
    plain = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    return F.when(~fits | code.isNull(), F.lit("\ufffd")).when(code.between(0x80, 0x9F), windows).otherwise(plain)


def _resolved(c: Column, loose: str) -> Column:
    """Every character reference of the text resolved, once; other text and unknown names stay."""
    named = F.from_json(F.lit(json.dumps(html5)), "map<string,string>")  # constant, folded while planning
    pattern = rf"(?s){_NUMERIC}|&[A-Za-z][A-Za-z0-9]{{1,31}};|{loose}&|[^&]+"

    def coded(token: Column) -> Column:
        digits = F.regexp_extract(token, "0*([0-9a-fA-F]+);?$", 1)
        # more digits than a code point can have are beyond every character
        value = F.when(F.length(digits) > 7, "110000").when(token.rlike("^&#[xX]"), digits).otherwise(F.conv(digits, 10, 16))
        return F.struct(token.alias("t"), F.when(token.startswith("&#") & (F.length(token) > 2), F.conv(value, 16, 10).cast("long")).alias("code"))

    def by_name(token: Column) -> Column:
        known = F.try_element_at(named, F.substr(token, F.lit(2)))
        prefix = F.regexp_extract(token, f"^&({'|'.join(_LOOSE)})", 1)
        by_prefix = F.when(prefix != "", F.concat(F.try_element_at(named, prefix), F.substr(token, F.length(prefix) + 2)))
        return F.coalesce(known, by_prefix if loose else F.lit(None), token)

    def one(x: Column) -> Column:
        return F.when(x["code"].isNotNull(), _character(x["code"])).when(x["t"].startswith("&"), by_name(x["t"])).otherwise(x["t"])

    tokens = F.regexp_extract_all(c, F.lit(pattern), 0)
    joined = F.array_join(F.transform(F.transform(tokens, coded), one), "")
    return F.when(F.contains(c, F.lit("&")), joined).otherwise(c)


def unescape(c: Column) -> Column:
    """Character references of an attribute: numeric ones and all names, with their semicolon."""
    return _resolved(c, "")


def unescape_text(c: Column) -> Column:
    """The same for page text, where old names also count without their semicolon."""
    return _resolved(c, f"&(?:{'|'.join(_LOOSE)})|")


def words(c: Column) -> Column:
    """Lower-case search words in order."""
    return F.regexp_extract_all(F.lower(c), F.lit(fixed.SEARCH_WORD), 0)


def search_tokens(query: Column) -> Column:
    """Words of a query that carry meaning: long enough and not a stop word."""
    kept = F.array_except(words(query), F.array(*[F.lit(w) for w in fixed.SEARCH_STOPWORDS]))
    return F.filter(kept, lambda w: F.length(w) >= fixed.SEARCH_MIN_TOKEN)


def tokens_of(query: str) -> list[str]:
    """The same for a query known while planning."""
    found = re.findall(fixed.SEARCH_WORD, query.lower())
    return [w for w in dict.fromkeys(found) if len(w) >= fixed.SEARCH_MIN_TOKEN and w not in fixed.SEARCH_STOPWORDS]


def starts_word(low: Column, token: str) -> Column:
    """A word of the lower-case text starts with ``token``. The plain ``contains`` turns most texts away."""
    return low.contains(token) & low.rlike(f"(?<!{fixed.SEARCH_WORD.removesuffix('+')}){token}")


def contains_any(text: Column, needles: list[str]) -> Column:
    """True when any needle is a substring. One ``contains`` per needle stays inside code generation.

    A needle that contains another one adds nothing.
    """
    hit = F.lit(False)
    for needle in [n for n in needles if not any(m in n for m in needles if m != n)]:
        hit = hit | text.contains(needle)
    return hit


def keyword_category(text: Column, lists: dict[str, list[str]] | None = None) -> Column:
    """First category with a keyword inside the text, else ``aucune``."""
    low, found = F.lower(text), None
    for code, keywords in (lists or fixed.KEYWORDS).items():
        hit = contains_any(low, keywords)
        found = F.when(hit, code) if found is None else found.when(hit, code)
    return found.otherwise(fixed.NO_CATEGORY)


def keyword_flag(found: Column) -> Column:
    """Whether the keyword detector found a category."""
    return found != fixed.NO_CATEGORY


def sha256(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)
