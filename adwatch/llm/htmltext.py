"""Main text of web pages: blocks of a page, less its frame, less the lines that it shares with pages of near addresses.

A page becomes blocks of text in page order. Elements that are never article text (navigation, forms, scripts and the
like, by tag, role, or a word of their class or id) are marked while blocks are cut. An article element, or else a main
element, is a landmark: what lies outside is the page's frame and is left out, and marks on elements around the landmark
do not count. A page without a landmark keeps all unmarked blocks.

What markup does not tell is found by differences. Pages are sorted by host and path, so each stands beside the pages of
the nearest addresses. It is paired with up to ``PARTNERS`` of them on either side, its blocks are aligned with all blocks of
the other page by longest common subsequence, and shared blocks are deleted: in a page without a landmark where half of the partners share them, inside a
landmark only where all of three or more do, since articles may quote the same passage. Pages that share most of their
words are copies of one article and say nothing about each other: they are no partners.

Pages are dealt by range of host, path and id, so a host of any size is spread over tasks, and a task reads its range as a
stream. Pages at the ends of a range are sent to where two ranges meet and are decided there; a range of fewer than
``2 * REACH`` pages meets the range before with its first half and the range after with its second.

* Null and empty pages have an empty text. Pages without an address are not paired. Long pages are taken whole.
* Repeated rows and rows with equal ids are pages of their own; a page's copies are no partners. An empty table gives an
  empty result.
* Other columns are carried along; one that has the name of an output is replaced by it.
"""

from __future__ import annotations

import html as references
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adwatch.llm.common import with_outputs

#: Pages looked at and partners taken on either side; share of words, in percent, from which two pages are copies.
REACH, PARTNERS, COPY = 4, 2, 80

# Elements of HTML.
BLOCKS = set("""address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form
h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot
th thead title tr ul""".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script style textarea title noscript iframe template xmp noframes noembed".split()
DROPPED = set("""aside audio button canvas datalist dialog footer head iframe input label map menu meter nav noembed
noframes noscript object progress script search select style svg template textarea title video""".split())
ROLES = set("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search status toolbar".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6 hgroup".split())
# Words of a class or id that mark a page's frame, and beginnings of such words.
MARKS = set("""ad ads adsense adslot adbox alert banner bottombar disqus gdpr legal masthead modal nav notice notices overlay
pager pagination popup popover privacy related reply replies respond share sharing shares signup skip social teaser teasers toast
toolbar topbar widget widgets""".split())
BEGINNINGS = ("advert", "sponsor", "promo", "sidebar", "comment", "cookie", "consent", "newsletter", "subscri", "navbar", "navigation",
              "breadcrumb", "menu", "footer", "recommend", "copyright", "disclaimer")
ARTICLE_MARKS = set("articlebody article-body post-body post-content entry-content article-content story-body".split())

_RAW_END = {t: re.compile(rf"</{t}\s*>|</{t}\s[^>]*>|\Z", re.I) for t in RAW}
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?=\s|/|$)", re.I)
#: A tag that closes an open one of the second set, if no block of the third lies between.
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
           "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
           "option": ({"option"}, {"select"})}
_ENDS_P = BLOCKS - {"caption", "body", "html", "head", "tr", "td", "th", "tbody", "thead", "tfoot", "option", "legend", "summary", "title"}


@dataclass
class _Open:
    tag: str
    number: int
    drops: bool
    marked: bool
    landmark: str


def _marked(tag: str, attributes: str) -> tuple[bool, str]:
    """Whether an element belongs to a page's frame, and the kind of landmark it is."""
    landmark = tag if tag in ("article", "main") else ""
    marked, named = tag in ("form", "fieldset"), ""
    if not attributes:
        return marked, landmark
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), references.unescape("".join(values)).lower()
        if name == "role":
            marked |= value in ROLES
            landmark = landmark or ("main" if value == "main" else "article" if value == "article" else "")
        elif name == "itemprop" and value == "articlebody":
            landmark = landmark or "article"
        elif name in ("class", "id"):
            for whole in value.split():
                if whole in ARTICLE_MARKS:
                    named = "article"
                if whole.startswith(("has-", "no-", "with-", "is-")):
                    continue
                words = re.split(r"[^a-z0-9]+", whole)
                words = words[:1] if tag == "article" else words
                marked |= any(w in MARKS or w.startswith(BEGINNINGS) for w in words)
        elif name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            marked = True
    marked |= _HIDDEN.search(attributes) is not None
    if tag in ("html", "body") or tag in HEADINGS:
        marked = False
    if tag == "main" or landmark == "article" and named:
        marked = False
    return marked, "" if marked else landmark or named


def blocks(page: str | None) -> tuple[list[str], bool, list[str]]:
    """The page's blocks that may be article text, whether they come from a landmark, and all its blocks."""
    page = page or ""
    stack: list[_Open] = []
    found: list[tuple[str, list[_Open], list[_Open]]] = []
    text: list[str] = []
    around: dict[str, set[int]] = {}
    numbers = 0

    def flush() -> None:
        if text:
            words = " ".join(references.unescape("".join(text)).split())
            text.clear()
            if words:
                found.append((words, [e for e in stack if e.drops or e.marked], [e for e in stack if e.landmark]))

    def close(tag: str, limit: set | None = None) -> None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i].tag == tag:
                if any(e.tag in BLOCKS for e in stack[i:]):
                    flush()
                del stack[i:]
                return
            if limit and stack[i].tag in limit:
                return

    at = 0
    while True:
        token = _TOKEN.search(page, at)
        if token is None:
            text.append(page[at:])
            break
        text.append(page[at:token.start()])
        at = token.end()
        tag = (token[2] or token[5] or "").lower()
        if not tag:
            continue
        if token[1] or token[4]:
            if tag in BLOCKS and not any(e.tag == tag for e in stack):
                flush()
            close(tag, {"article", "main", "section", "nav", "aside", "body"} - {tag} if tag not in BLOCKS else None)
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag in BLOCKS:
            flush()
            if tag in _ENDS_P and any(e.tag == "p" for e in stack):
                close("p", {"td", "th", "table", "button", "object"})
        if tag in _CLOSES:
            closed, limit = _CLOSES[tag]
            while any(e.tag in closed for e in reversed(stack)):
                inner = next(e for e in reversed(stack) if e.tag in closed or e.tag in limit)
                if inner.tag in limit:
                    break
                close(inner.tag)
        if tag in VOID:
            continue
        attributes = token[3] or token[6] or ""
        if tag in _RAW_END:
            at = _RAW_END[tag].search(page, at).end()
            continue
        if attributes.endswith("/") and tag not in BLOCKS:
            continue
        numbers += 1
        marked, landmark = _marked(tag, attributes)
        inside = max((i for i, e in enumerate(stack) if e.landmark), default=-1)
        drops = tag in DROPPED or tag == "header" and inside < 0
        if landmark and not drops and not any(e.drops for e in stack):
            weak = any(e.marked and e.tag not in ("form", "fieldset") for e in stack[inside + 1:]) or inside >= 0 and stack[inside].landmark[0] == "~"
            landmark = "~" * weak + landmark
            around.setdefault(landmark, set()).update(e.number for e in stack)
        else:
            landmark = ""
        stack.append(_Open(tag, numbers, drops, marked, landmark))
    flush()

    def kept(kind: str, ignored: set[int]) -> list[str]:
        return [words for words, out, landmarks in found
                if not any(e.drops or e.number not in ignored for e in out) and (not kind or any(e.landmark == kind for e in landmarks))]

    every = [words for words, out, _ in found if not any(e.drops for e in out)]
    for kind in ("article", "main", "", "~article", "~main"):  # those with ~ lie in marked elements
        if own := kept(kind, around.get(kind, set())) if kind in around or not kind else []:
            return own, bool(kind), every
    ignored: set[int] = set()
    while not (own := kept("", ignored)):  # marks on elements around all text say nothing
        outer = {e.number for _, out, _ in found if not any(e.drops for e in out) for e in [e for e in out if e.number not in ignored][:1]}
        if not outer:
            break
        ignored |= outer
    return own, False, every


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Length of the longest common subsequence of ``a`` and every beginning of ``b``, by bits of one long number."""
    places: dict[int, int] = {}
    for i, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(b)) - 1
    row = full
    for x in a:
        match = row & places.get(x, 0)
        row = ((row + match) | (row - match)) & full
    bits = np.unpackbits(np.frombuffer(row.to_bytes((len(b) + 7) // 8 or 1, "little"), np.uint8), bitorder="little")[:len(b)]
    return np.r_[0, np.cumsum(bits == 0)]


def shared_lines(a: list[int], b: list[int]) -> list[int]:
    """Places in ``a`` of a longest common subsequence of both."""
    common = set(a) & set(b)
    at = [i for i, x in enumerate(a) if x in common]
    found: list[int] = []

    def align(places: list[int], other: list[int]) -> None:
        while places and other and a[places[0]] == other[0]:
            found.append(places[0])
            places, other = places[1:], other[1:]
        tail = []
        while places and other and a[places[-1]] == other[-1]:
            tail.append(places[-1])
            places, other = places[:-1], other[:-1]
        if len(places) == 1 or not other:
            found.extend(p for p in places if a[p] in other)
        elif places:
            half = len(places) // 2
            one, two = places[:half], places[half:]
            total = _lengths([a[p] for p in one], other) + _lengths([a[p] for p in reversed(two)], other[::-1])[::-1]
            cut = int(total.argmax())
            align(one, other[:cut])
            align(two, other[cut:])
        found.extend(reversed(tail))

    if common:
        align(at, [x for x in b if x in common])
    return found


@dataclass
class _Page:
    host: str
    lines: list[int]
    sizes: list[int]
    landmark: bool
    every: list[int]
    words: int = field(init=False)

    def __post_init__(self):
        self.words = sum(self.sizes)


def _lost(own: _Page, before: list[_Page], after: list[_Page]) -> set[int]:
    """Places of the lines to delete; neighbours are given from near to far."""
    votes: dict[int, int] = {}
    partners = 0
    for side in (before, after):
        taken = 0
        for other in side:
            if taken == PARTNERS or other.host != own.host or not own.host:
                break
            if not other.words or not own.words:
                continue
            places = shared_lines(own.lines, other.lines)
            if 100 * sum(own.sizes[i] for i in places) >= COPY * min(own.words, other.words):
                continue
            taken += 1
            for i in places if other.every == other.lines else shared_lines(own.lines, other.every):
                votes[i] = votes.get(i, 0) + 1
        partners += taken
    if own.landmark:
        return {i for i, n in votes.items() if n == partners and partners >= 3}
    return {i for i, n in votes.items() if 2 * n >= partners}


def _text(lines: list[str], lost: set[int]) -> str:
    return "\n\n".join(w for i, w in enumerate(lines) if i not in lost)


def extract(df: DataFrame, page: str = "html", url: str = "url", page_id: str = "page_id", out: str = "text") -> DataFrame:
    """The table with ``out``, the main text of each page: blocks joined by an empty line; the page itself is left out."""
    rows = with_outputs(df, out) if out != page else df
    kept = [c for c in rows.columns if c != page]
    schema = T.StructType([*[f for f in rows.schema.fields if f.name != page], T.StructField(out, T.StringType())])
    held_schema = T.StructType([*schema.fields, *T.StructType.fromDDL(
        "_meet int, _side int, _place int, _own boolean, _lines array<string>, _landmark boolean, _host string, _every array<string>").fields])
    address = F.coalesce(F.col(f"`{url}`").cast("string"), F.lit(""))
    host = F.lower(F.regexp_extract(address, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1))
    path = F.regexp_replace(address, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*", "")
    order = ("_host", "_path", "_key", "_tie")
    dealt = rows.select(*[F.col(f"`{c}`") for c in rows.columns], host.alias("_host"), path.alias("_path"), F.col(f"`{page_id}`").alias("_key"),
                        F.xxhash64(F.col(f"`{page}`")).alias("_tie"))
    # the ranges are read twice, so their number is fixed: pages at their ends must be the same both times
    ranges = max(1, min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.count() // (16 * REACH)))
    dealt = dealt.repartitionByRange(ranges, *[F.col(c) for c in order]).sortWithinPartitions(*order)
    carried = T.StructType(schema.fields[:-1])

    def line(words: str) -> int:
        import xxhash

        return xxhash.xxh3_64_intdigest(words)

    def known(host: str, lines: list[str], landmark: bool, every: list[str]) -> _Page:
        return _Page(host, [line(w) for w in lines], [w.count(" ") + 1 for w in lines], landmark, [line(w) for w in every])

    def table(items: list[dict]) -> pa.RecordBatch:
        return pa.record_batch([pa.array([i.get(f.name) for i in items], _arrow(f.dataType)) for f in held_schema.fields], names=held_schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Decide pages of a sorted range; those at its ends go to the places where ranges meet, with what they need."""
        part = 0
        window: deque = deque()  # (values, blocks, page), up to 2 * REACH before the page that is decided and REACH after
        seen = 0
        out_rows: list[dict] = []

        def waiting(item, meet: int, side: int, place: int, own: bool) -> dict:
            values, (lines, landmark, every), page = item
            return (values if own else {}) | {"_meet": meet, "_side": side, "_place": place, "_own": own, "_lines": lines,
                                              "_landmark": landmark, "_host": page.host, "_every": every}

        def decided(k: int) -> dict:
            items = list(window)
            values, (lines, *_), page = items[k]
            lost = _lost(page, [i[2] for i in reversed(items[max(0, k - REACH):k])], [i[2] for i in items[k + 1:k + 1 + REACH]])
            return values | {out: _text(lines, lost)}

        for batch in batches:
            columns = {c: batch.column(batch.schema.get_field_index(c)).to_pylist() for c in [*kept, page, "_host"]}
            if batch.num_rows:  # the range's own number: a task's number moves where the result is part of a union
                part = batch.column(batch.schema.get_field_index("_range"))[0].as_py()
            for n in range(batch.num_rows):
                cut = blocks(columns[page][n])
                window.append(({c: columns[c][n] for c in kept}, cut, known(columns["_host"][n], *cut)))
                seen += 1
                if part and seen == 2 * REACH:
                    head = list(window)
                    out_rows += [waiting(i, part - 1, 1, k, k < REACH) for k, i in enumerate(head)]
                first = seen - len(window)  # the place of the oldest page held
                ready = seen - 2 * REACH - 1  # REACH pages follow, and REACH more keep the end of the range undecided
                if ready >= (REACH if part else 0) and ready >= first:
                    out_rows.append(decided(ready - first))
                while len(window) > 3 * REACH + 1:
                    window.popleft()
                if len(out_rows) >= 200:
                    yield table(out_rows)
                    out_rows = []
        items, first = list(window), seen - len(window)
        if seen < 2 * REACH:
            half = (seen + 1) // 2 if part else 0
            if part:
                out_rows += [waiting(i, part - 1, 1, k, k < half) for k, i in enumerate(items)]
            out_rows += [waiting(i, part, 0, k, k >= half) for k, i in enumerate(items)]
        else:
            for place in range(max(REACH if part else 0, seen - 2 * REACH), seen - REACH):
                out_rows.append(decided(place - first))
            own_from = max(seen - REACH, REACH if part else 0)
            out_rows += [waiting(items[place - first], part, 0, place, place >= own_from) for place in range(max(first, seen - 2 * REACH), seen)]
        if out_rows:
            yield table(out_rows)

    def meet(group: pa.Table) -> pa.Table:
        items = sorted(group.to_pylist(), key=lambda r: (r["_side"], r["_place"]))
        pages = [known(i["_host"], i["_lines"], i["_landmark"], i["_every"]) for i in items]
        done = []
        for k, item in enumerate(items):
            if item["_own"]:
                lost = _lost(pages[k], pages[max(0, k - REACH):k][::-1], pages[k + 1:k + 1 + REACH])
                done.append(item | {out: _text(item["_lines"], lost)})
        return pa.table([pa.array([d[f.name] for d in done], _arrow(f.dataType)) for f in schema.fields], names=schema.names)

    held = dealt.select(*[f"`{f.name}`" for f in carried.fields], f"`{page}`", "_host", "_path", "_key", "_tie", F.spark_partition_id().alias("_range")).mapInArrow(
        run, held_schema)
    inner = held.where("_meet IS NULL").select(*schema.names)
    return inner.unionAll(held.where("_meet IS NOT NULL").groupBy("_meet").applyInArrow(meet, schema))


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)
