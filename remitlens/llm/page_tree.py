"""A page as a tree of elements and text, from markup that need not be well formed."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

_NAME = re.compile(r"[^\s/>]+")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=][^\s>/=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_IN_TAG = re.compile(r"""[>"']""")

# fixed values: element kinds of the HTML standard
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s "
    "samp small span strike strong sub sup time tt u var br wbr img nobr".split()
)
#: Start tags that end an open element, and the elements within which they look for it.
_ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr",), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tbody": (("thead", "tbody", "tfoot"), ("table",)),
    "tfoot": (("thead", "tbody", "tfoot"), ("table",)),
    "option": (("option",), ("select", "datalist")),
    "body": (("head",), ()),
}
_P_SCOPE = ("td", "th", "caption", "button", "object", "table", "template", "marquee", "applet")


@dataclass
class Element:
    """An element; children are elements and pieces of undecoded text, in page order."""

    name: str
    attributes: str = ""
    parent: Element | None = None
    children: list[Element | str] = field(default_factory=list)

    def attribute_values(self) -> dict[str, str]:
        found = {}
        for name, a, b, c in _ATTRIBUTE.findall(self.attributes):
            found.setdefault(name.lower(), a or b or c)
        return found


def _tag_end(html: str, at: int) -> int:
    """Place of the ``>`` that ends a tag, quoted ones skipped; the end of the page if none does."""
    while found := _IN_TAG.search(html, at):
        if found.group() == ">":
            return found.start()
        at = html.find(found.group(), found.end()) + 1
        if not at:
            break
    return len(html)


def tokens(html: str) -> Iterator[tuple[str, str, str]]:
    """("text", text, ""), ("start", name, attributes) and ("end", name, ""); comments are left out.

    The time is linear in the page: what is not found to its right is not searched again.
    """
    at, n = 0, len(html)
    no_comment_end = False
    missing: set[str] = set()  # raw elements that have no end tag any more
    lower = html.lower() if len(html.lower()) == n else re.sub("[A-Z]", lambda m: m[0].lower(), html)
    while at < n:
        tag = html.find("<", at)
        if tag < 0:
            yield "text", html[at:], ""
            return
        after = html[tag + 1 : tag + 2]
        closing = after == "/"
        first = html[tag + 2 : tag + 3] if closing else after
        if not (first.isascii() and first.isalpha()) and after not in ("!", "?", "/") or after == "":
            yield "text", html[at : tag + 1], ""
            at = tag + 1
            continue
        if tag > at:
            yield "text", html[at:tag], ""
        if html.startswith("<!--", tag):
            end = -1 if no_comment_end else html.find("-->", tag + 2)
            no_comment_end = end < 0
            at = n if end < 0 else end + 3
            continue
        if not (first.isascii() and first.isalpha()):
            end = html.find(">", tag)
            at = n if end < 0 else end + 1
            continue
        name = _NAME.match(html, tag + 1 + closing)
        end = _tag_end(html, name.end())
        kind = name.group().lower()
        at = end + 1
        if end == n:
            return  # a tag that the page breaks off in
        yield ("end", kind, "") if closing else ("start", kind, html[name.end() : end])
        if not closing and kind in RAW:
            end = -1 if kind in missing else lower.find(f"</{kind}", at)
            if end < 0:
                missing.add(kind)
                end = n
            if end > at:
                yield "text", html[at:end], ""
            at = end


class _Builder:
    def __init__(self) -> None:
        self.root = Element("#page")
        self.open = [self.root]
        self.places: dict[str, list[int]] = {}  # where elements of a name are open

    def last(self, *names: str) -> int:
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=0)

    def close(self, place: int) -> None:
        while len(self.open) > place:
            self.places[self.open.pop().name].pop()

    def start(self, name: str, attributes: str) -> None:
        if name in ("html", "body") and self.last(name):
            return
        if name not in INLINE and name not in RAW and self.last("p") > self.last(*_P_SCOPE):
            self.close(self.last("p"))
        ended, within = _ENDS.get(name, ((), ()))
        if ended and self.last(*ended) > self.last(*within):
            self.close(self.last(*ended))
        element = Element(name, attributes, self.open[-1])
        self.open[-1].children.append(element)
        if name not in VOID:
            self.places.setdefault(name, []).append(len(self.open))
            self.open.append(element)

    def end(self, name: str) -> None:
        # text after the end of the body still belongs to it
        if name not in ("html", "body") and (place := self.last(name)):
            self.close(place)


def parse(html: str) -> Element:
    """The root of the tree; start tags close open paragraphs, items and cells as browsers do."""
    builder = _Builder()
    for kind, value, attributes in tokens(html):
        if kind == "text":
            builder.open[-1].children.append(value)
        elif kind == "start":
            builder.start(value, attributes)
        else:
            builder.end(value)
    return builder.root


def in_order(root: Element) -> list[Element]:
    """All elements, parents before children, in page order."""
    found, todo = [], [root]
    while todo:
        element = todo.pop()
        found.append(element)
        todo.extend(c for c in reversed(element.children) if isinstance(c, Element))
    return found
