"""Small helper: text of elements picked by CSS selectors, for use inside Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from html.parser import HTMLParser

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = {"script", "style", "template"}


class Element:
    __slots__ = ("tag", "attrs", "parent", "content")

    def __init__(self, tag: str, attrs: dict, parent: Element | None) -> None:
        self.tag, self.attrs, self.parent, self.content = tag, attrs, parent, []

    def children(self) -> list[Element]:
        return [c for c in self.content if isinstance(c, Element)]

    def below(self) -> Iterator[Element]:
        stack = self.children()[::-1]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(node.children()[::-1])

    def text(self) -> str:
        out, stack = [], list(reversed(self.content))
        while stack:
            item = stack.pop()
            if isinstance(item, str):
                out.append(item.strip())
            elif item.tag not in HIDDEN:
                stack.extend(reversed(item.content))
        return "".join(out)


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Element("", {}, None)

    def handle_starttag(self, tag, attrs):
        node = Element(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.content.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.content.append(Element(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        node = self.at
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        self.at.content.append(data)


def parse(html: str) -> Element:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


class UnsupportedSelector(ValueError):
    """A selector that is malformed or uses what this helper doesn't know."""


Test = Callable[[Element], bool]
_NAME = r"-?[_a-zA-Z\u0080-\U0010ffff][\w\u0080-\U0010ffff-]*"
_SIMPLE = re.compile(
    rf"(?P<tag>{_NAME}|\*)|#(?P<id>[\w-]+)|\.(?P<cls>{_NAME})"
    rf"|\[\s*(?P<attr>[\w:-]+)\s*(?:(?P<op>[~|^$*]?=)\s*(?:\"(?P<dq>[^\"]*)\"|'(?P<sq>[^']*)'|(?P<bare>[^\s\]\"']+))\s*(?P<flag>[iI])?\s*)?\]"
    rf"|:(?P<pseudo>[a-z-]+)(?P<open>\()?")
_NTH = re.compile(r"\s*(?:(?P<word>odd|even)|(?P<a>[+-]?\d*)n\s*(?:(?P<sign>[+-])\s*(?P<b>\d+))?|(?P<only>[+-]?\d+))\s*$", re.I)


def _attribute(name: str, op: str | None, value: str, fold: bool) -> Test:
    name, value = name.lower(), value.lower() if fold else value
    tests: dict[str | None, Callable[[str], bool]] = {
        None: lambda v: True,
        "=": lambda v: v == value,
        "~=": lambda v: value != "" and value in v.split(),
        "|=": lambda v: v == value or v.startswith(value + "-"),
        "^=": lambda v: value != "" and v.startswith(value),
        "$=": lambda v: value != "" and v.endswith(value),
        "*=": lambda v: value != "" and value in v,
    }
    holds = tests[op]
    return lambda e: name in e.attrs and holds(e.attrs[name].lower() if fold else e.attrs[name])


def _place(e: Element, same_tag: bool, from_end: bool) -> int:
    around = [c for c in e.parent.children() if not same_tag or c.tag == e.tag] if e.parent is not None else [e]
    at = next(i for i, c in enumerate(around) if c is e)
    return len(around) - at if from_end else at + 1


def _nth(text: str, same_tag: bool, from_end: bool) -> Test:
    m = _NTH.match(text)
    if m is None:
        raise UnsupportedSelector(f"unknown place ({text})")
    if m["word"]:
        a, b = 2, int(m["word"].lower() == "odd")
    elif m["only"]:
        a, b = 0, int(m["only"])
    else:
        a = int(m["a"] + "1") if m["a"] in ("", "+", "-") else int(m["a"])
        b = int((m["sign"] or "+") + (m["b"] or "0"))

    def test(e: Element) -> bool:
        k = _place(e, same_tag, from_end) - b
        return k == 0 if a == 0 else k % a == 0 and k // a >= 0

    return test


_PLACES = {
    "first-child": ("1", False, False), "last-child": ("1", False, True), "first-of-type": ("1", True, False), "last-of-type": ("1", True, True),
}
_NTHS = {"nth-child": (False, False), "nth-last-child": (False, True), "nth-of-type": (True, False), "nth-last-of-type": (True, True)}


def _closing(text: str, at: int) -> int:
    depth, quote = 1, ""
    for i in range(at, len(text)):
        c = text[i]
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
            if depth == 0:
                return i
    raise UnsupportedSelector(f"no closing bracket in {text}")


def _pseudo(name: str, inside: str | None) -> Test:
    if name in _PLACES and inside is None:
        return _nth(*_PLACES[name])
    if name in ("only-child", "only-of-type") and inside is None:
        same = name == "only-of-type"
        return lambda e: _place(e, same, False) == 1 == _place(e, same, True)
    if name == "empty" and inside is None:
        return lambda e: not any(isinstance(c, Element) or c for c in e.content)
    if name in _NTHS and inside is not None:
        return _nth(inside, *_NTHS[name])
    if name in ("not", "is", "where") and inside is not None:
        inner = compiled(inside)
        return (lambda e: not any(f(e) for f in inner)) if name == "not" else (lambda e: any(f(e) for f in inner))
    raise UnsupportedSelector(f":{name} is not supported")


def _compound(text: str, at: int) -> tuple[Test, int]:
    tests: list[Test] = []
    while at < len(text):
        m = _SIMPLE.match(text, at)
        if m is None or m["tag"] and tests:
            break
        at = m.end()
        if m["tag"]:
            tag = m["tag"].lower()
            tests.append((lambda e: True) if tag == "*" else lambda e, tag=tag: e.tag == tag)
        elif m["id"]:
            tests.append(lambda e, v=m["id"]: e.attrs.get("id") == v)
        elif m["cls"]:
            tests.append(lambda e, v=m["cls"]: v in e.attrs.get("class", "").split())
        elif m["attr"]:
            value = next((v for v in (m["dq"], m["sq"], m["bare"]) if v is not None), "")
            tests.append(_attribute(m["attr"], m["op"], value, bool(m["flag"])))
        else:
            inside = None
            if m["open"]:
                end = _closing(text, at)
                inside, at = text[at:end], end + 1
            tests.append(_pseudo(m["pseudo"], inside))
    if not tests:
        raise UnsupportedSelector(f"can't read {text[at:]!r} in {text!r}")
    return (tests[0] if len(tests) == 1 else lambda e: all(t(e) for t in tests)), at


def _before(e: Element) -> list[Element]:
    """Elements before this one under the same parent, nearest first."""
    if e.parent is None:
        return []
    around = e.parent.children()
    return around[:next(i for i, c in enumerate(around) if c is e)][::-1]


def _above(e: Element) -> Iterator[Element]:
    while e.parent is not None and e.parent.tag:
        e = e.parent
        yield e


def _joined(outer: Test, sign: str, own: Test) -> Test:
    if sign == ">":
        return lambda e: own(e) and e.parent is not None and e.parent.tag != "" and outer(e.parent)
    if sign == "+":
        return lambda e: own(e) and any(outer(b) for b in _before(e)[:1])
    if sign == "~":
        return lambda e: own(e) and any(outer(b) for b in _before(e))
    return lambda e: own(e) and any(outer(a) for a in _above(e))


@lru_cache(maxsize=512)
def compiled(selector: str) -> list[Test]:
    """The tests of a selector list; an element is selected when one of them holds.

    Known are type, universal, class, id and attribute selectors with all operators, the four combinators, lists, places
    among siblings (``:nth-child`` and its kin, ``:first-child``, ``:only-child``, ``:empty``), ``:not``, ``:is`` and
    ``:where``. Everything else raises :class:`UnsupportedSelector`.
    """
    text, at, found = selector.strip(), 0, []
    while True:
        test, at = _compound(text, at)
        while at < len(text) and text[at] != ",":
            m = re.compile(r"\s*([>+~])\s*|\s+").match(text, at)
            if m is None:
                raise UnsupportedSelector(f"can't read {text[at:]!r} in {text!r}")
            at = m.end()
            if at < len(text) and text[at] == "," and not m[1]:
                break
            own, at = _compound(text, at)
            test = _joined(test, m[1] or " ", own)
        found.append(test)
        if at >= len(text):
            return found
        at += 1 + len(text[at + 1:]) - len(text[at + 1:].lstrip())


def select(root: Element, selector: str) -> Iterator[Element]:
    """Elements below ``root`` that the selector matches, in document order."""
    tests = compiled(selector)
    return (e for e in root.below() if any(t(e) for t in tests))


_ATTRIBUTE = re.compile(r"(.*?)@([\w:-]+)\s*$", re.S)


def pick(root: Element, selector: str) -> str | None:
    """Text of the first match, or an attribute with ``selector@attr``; a blank selector picks nothing."""
    m = _ATTRIBUTE.match(selector)
    path, attr = (m[1], m[2]) if m else (selector, "")
    node = next(select(root, path), None) if path.strip() else None
    if node is None:
        return None
    return node.attrs.get(attr) if attr else node.text()
