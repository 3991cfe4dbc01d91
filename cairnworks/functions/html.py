"""A small HTML tree on the standard parser: text, attributes, order, and a subset of selectors.

Comments, scripts and styles give no text. Tags left open are closed by their parents' end; void elements
have no content.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
SILENT = {"script", "style", "template"}
_CLOSES = {"li": {"li"}, "p": {"p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SPACE = re.compile(r"[\s\x1c-\x1f]+")
_STEP = re.compile(r"(?P<tag>[\w*-]+)?(?P<rest>(?:[.#][\w-]+|\[[\w-]+(?:[*^$]?=[^\]]*)?\])*)")
_PART = re.compile(r"\.(?P<cls>[\w-]+)|#(?P<id>[\w-]+)|\[(?P<name>[\w-]+)(?:(?P<op>[*^$]?=)(?P<value>[^\]]*))?\]")


def clean(text: str) -> str:
    return _SPACE.sub(" ", text).strip()


class Element:
    def __init__(self, tag: str, attrs: dict[str, str], parent: "Element | None"):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []  # children: Element or str

    def elements(self) -> Iterator["Element"]:
        """Descendants in document order."""
        for c in self.children:
            if isinstance(c, Element):
                yield c
                yield from c.elements()

    def strings(self) -> Iterator[str]:
        for c in self.children:
            if isinstance(c, str):
                yield c
            elif c.tag not in SILENT:
                yield from c.strings()

    def text(self, sep: str = " ") -> str:
        return clean(sep.join(self.strings()))

    def siblings_after(self) -> list["Element"]:
        if self.parent is None:
            return []
        at = self.parent.children.index(self)
        return [c for c in self.parent.children[at + 1 :] if isinstance(c, Element)]

    def has_class(self, name: str) -> bool:
        return name in self.attrs.get("class", "").split()

    def select(self, selector: str) -> list["Element"]:
        """Descendants that match; steps are joined by white space, alternatives by commas."""
        found = {id(e): e for alt in selector.split(",") for e in self._chain(alt.split())}
        return [e for e in self.elements() if id(e) in found]

    def first(self, selector: str) -> "Element | None":
        return next(iter(self.select(selector)), None)

    def _chain(self, steps: list[str]) -> list["Element"]:
        at = [self]
        for step in steps:
            at = list({id(e): e for root in at for e in root.elements() if _matches(e, step)}.values())
        return at


def _matches(e: Element, step: str) -> bool:
    m = _STEP.fullmatch(step)
    if not m or m["tag"] not in (None, "*", e.tag):
        return False
    for p in _PART.finditer(m["rest"]):
        if p["cls"]:
            ok = e.has_class(p["cls"])
        elif p["id"]:
            ok = e.attrs.get("id") == p["id"]
        else:
            value, want = e.attrs.get(p["name"]), (p["value"] or "").strip("'\"")
            ok = value is not None and {None: True, "=": value == want, "*=": want in value, "^=": value.startswith(want), "$=": value.endswith(want)}[p["op"]]
        if not ok:
            return False
    return True


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Element("", {}, None)

    def handle_starttag(self, tag, attrs):
        if self.at.tag in _CLOSES.get(tag, ()):
            self.at = self.at.parent
        e = Element(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(e)
        if tag not in VOID:
            self.at = e

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Element(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        e = self.at
        while e.parent is not None and e.tag != tag:
            e = e.parent
        if e.parent is not None:
            self.at = e.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse(html: str | None) -> Element:
    b = _Builder()
    b.feed(html or "")
    b.close()
    return b.root


def fragment_text(html: str | None) -> str | None:
    """The cleaned text of a fragment, null where there is none."""
    return parse(html).text() or None if html else None
