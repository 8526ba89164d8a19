"""Main text of web pages by composite text density.

For every node of the page, characters per tag are adjusted by the share of characters that
are in links; each node also gets the sum of the densities of its children. The node of the largest
sum is the core of the article. The least density on the path from the body to it is the
threshold: other subtrees that reach it hold content too. Scripts, forms, menus and other
parts that name themselves as boilerplate are cut off before.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from math import e, log

import pyarrow as pa
from pyspark.sql import DataFrame

from remitlens.llm.common import bounded_batches
from remitlens.llm.page_tree import INLINE, Element, in_order, parse

# fixed values: elements, roles and class words of what is no article text
NO_CONTENT = frozenset(
    "head script style template noscript iframe object embed applet canvas audio video svg map "
    "noembed noframes nav footer aside dialog menu button input select textarea option datalist "
    "fieldset label progress meter".split()
)
NO_CONTENT_ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar "
    "toolbar".split()
)
NO_CONTENT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie "
    "cookies consent gdpr notice alert newsletter subscribe subscription paywall sidebar widget widgets menu "
    "nav navbar navigation breadcrumb breadcrumbs footer header masthead comment comments "
    "commentlist disqus respond replies share sharing social related recommended popup modal overlay toolbar "
    "pagination pager skip login signup search".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_LANDMARKS = frozenset(["article", "main"])
_SPACE_AFTER = frozenset("br wbr td th img hr".split())
_WORDS = re.compile(r"[a-z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


def _class_words(attributes: dict[str, str]) -> set[str]:
    """Words that a class or an id is, begins or ends with."""
    found = set()
    for name in f"{attributes.get('class', '')} {attributes.get('id', '')}".lower().split():
        words = _WORDS.findall(name)
        found.update(words[:1] + words[-1:])
    return found


def _is_landmark(element: Element, attributes: dict[str, str]) -> bool:
    known = element.name in _LANDMARKS or attributes.get("role") in _LANDMARKS
    return known or attributes.get("itemprop") == "articleBody"


class Page:
    """The tree of a page with the figures of every node, by position in page order."""

    def __init__(self, html: str) -> None:
        self.nodes = in_order(parse(html))
        place = {id(node): i for i, node in enumerate(self.nodes)}
        n = len(self.nodes)
        self.parent = [place[id(x.parent)] if x.parent else -1 for x in self.nodes]
        self.runs = [[unescape(c) for c in x.children if isinstance(c, str)] for x in self.nodes]
        self.own = [sum(len("".join(r.split())) for r in runs) for runs in self.runs]
        values = [x.attribute_values() if x.attributes else {} for x in self.nodes]
        self.landmark = [_is_landmark(x, v) for x, v in zip(self.nodes, values, strict=True)]
        self.end = [i + 1 for i in range(n)]  # the subtree of i is i to end[i]
        for i in range(n - 1, 0, -1):
            self.end[self.parent[i]] = max(self.end[self.parent[i]], self.end[i])
        self.block_up = [-1] * n  # the nearest element around that is not inline
        self.article = [-1] * n  # the article, or else the main part, around or at the node
        self.heading = [False] * n
        for i, (node, up) in enumerate(zip(self.nodes, self.parent, strict=True)):
            if up >= 0:
                inline = self.nodes[up].name in INLINE
                self.block_up[i] = self.block_up[up] if inline else up
                self.heading[i] = self.heading[up] and node.name in INLINE
                self.article[i] = self.article[up]
            self.heading[i] |= node.name in HEADINGS
            if self.landmark[i] and (node.name == "article" or self.article[i] < 0):
                self.article[i] = i
        self.kept = self._without_boilerplate(values)
        self._measure()

    def _without_boilerplate(self, values: list[dict[str, str]]) -> list[bool]:
        """False for the nodes of cut-off subtrees."""
        n = len(self.nodes)
        named = [bool(_class_words(v) & NO_CONTENT_WORDS) if v else False for v in values]
        # marks of an article in a subtree keep a wrapper with an unlucky class
        guarded = [0] * n
        text = list(self.own)
        for i in range(n - 1, 0, -1):
            mark = self.landmark[i] or self.nodes[i].name == "h1"
            guarded[self.parent[i]] += guarded[i] + (mark and not named[i])
            text[self.parent[i]] += text[i]
        kept = [True] * n
        inside = [False] * n  # within an article or the main part
        header = [False] * n  # within the header of an article: headings only
        for i, (node, v) in enumerate(zip(self.nodes, values, strict=True)):
            up = self.parent[i]
            if up >= 0:
                inside[i] = inside[up] or self.landmark[up]
                header[i] = header[up]
            kept[i] = up < 0 or kept[up]
            if not kept[i] or node.name in ("html", "body"):
                continue
            header[i] |= node.name == "header" and inside[i]
            hidden = "hidden" in v or v.get("aria-hidden") == "true" or _HIDDEN.search(v.get("style", ""))
            if (
                node.name in NO_CONTENT
                or hidden
                or node.name == "header" and not inside[i] and not guarded[i]
                or node.name == "form" and not guarded[i] and 2 * text[i] < text[0]
                or v.get("role") in NO_CONTENT_ROLES and not guarded[i]
                or named[i] and not guarded[i] and not self._alone(i) and node.name not in HEADINGS
            ):
                kept[i] = False
        for i in range(n):
            if header[i] and not self.heading[i]:
                self.runs[i] = ["" for _ in self.runs[i]]
                self.own[i] = 0
        return kept

    def _alone(self, i: int) -> bool:
        """True if the node is all that the body has: a wrapper of the page."""
        up = self.parent[i]
        return self.nodes[up].name == "body" and self.end[i] - i == self.end[up] - up - 1

    def _measure(self) -> None:
        """Characters, tags, those in links, density and density sum of every kept node."""
        n = len(self.nodes)
        in_link = [False] * n
        for i in range(n):
            in_link[i] = self.nodes[i].name == "a" or i > 0 and in_link[self.parent[i]]
        # the share of links is that of the whole body, menus and all
        body = next((i for i in range(n) if self.nodes[i].name == "body"), 0)
        whole = range(body, self.end[body])
        links = sum(self.own[i] for i in whole if in_link[i])
        self.linked = links / max(sum(self.own[i] for i in whole), 1)
        chars = [own if kept else 0 for own, kept in zip(self.own, self.kept, strict=True)]
        link_chars = [c if linked else 0 for c, linked in zip(chars, in_link, strict=True)]
        tags, link_tags = [0] * n, [0] * n
        for i in range(n - 1, 0, -1):
            if self.kept[i]:
                up = self.parent[i]
                chars[up] += chars[i]
                tags[up] += tags[i] + 1
                link_chars[up] += link_chars[i]
                link_tags[up] += link_tags[i] + in_link[i]
        self.chars, self.link_chars = chars, link_chars
        self.density = [
            self._density(chars[i], tags[i], link_chars[i], link_tags[i]) for i in range(n)
        ]
        self.sum = [self._density(own, 0, 0, 0) if own else 0.0 for own in self.own]
        for i in range(n - 1, 0, -1):
            if self.kept[i]:
                self.sum[self.parent[i]] += self.density[i]

    def _density(self, chars: int, tags: int, link_chars: int, link_tags: int) -> float:
        """Characters per tag, adjusted by links; without any link on the page, characters per tag."""
        plain = chars / max(tags, 1)
        base = log(chars / max(chars - link_chars, 1) * link_chars + self.linked * chars + e)
        if not chars or base <= 1:
            return plain
        ratio = chars / max(link_chars, 1) * max(tags, 1) / max(link_tags, 1)
        return plain * log(max(ratio, 1)) / log(base)

    def content(self) -> list[bool]:
        """True for the nodes whose text is main text."""
        n = len(self.nodes)
        blocks = [i for i in range(n) if self.kept[i] and self.chars[i] and self.nodes[i].name not in INLINE]
        chosen = [False] * n
        if not blocks:
            return chosen
        core = max(blocks, key=lambda i: (self.sum[i], -i))
        threshold, up = self.density[core], core
        while up > 0 and self.nodes[up].name != "html":
            threshold = min(threshold, self.density[up])
            up = self.parent[up]
        # the largest sum in each subtree: where it is, the outermost first
        best = list(range(n))
        for i in reversed(blocks):
            above = self.block_up[i]
            if above >= 0 and self.sum[best[i]] > self.sum[best[above]]:
                best[above] = best[i]
        marked = set()
        reached = [False] * n  # all on the path to it are as dense as the threshold
        for i in blocks:
            outside = self.parent[i] < 0 or self.nodes[i].name in ("html", "body")
            reached[i] = outside or self.density[i] >= threshold and reached[self.block_up[i]]
            if reached[i]:
                marked.add(self.article[best[i]] if self.article[best[i]] >= 0 else best[i])
        done = 0
        for i in sorted(marked):
            for k in range(max(i, done), self.end[i]):
                chosen[k] = True
            done = max(done, self.end[i])
        self._fill(chosen)
        return chosen

    def _fill(self, chosen: list[bool]) -> None:
        """Choose, among the children of a node, also those between chosen ones and headings before."""
        children: dict[int, list[int]] = {}
        for i in range(1, len(self.nodes)):
            if self.kept[i] and self.chars[i] and self.nodes[i].name not in INLINE:
                children.setdefault(self.parent[i], []).append(i)
        for found in children.values():
            hits = [k for k, i in enumerate(found) if chosen[i]]
            if not hits or chosen[self.parent[found[0]]]:
                continue
            first, last = hits[0], hits[-1]
            while first and self.nodes[found[first - 1]].name in HEADINGS:
                first -= 1
            for i in found[first : last + 1]:
                if 2 * self.link_chars[i] <= self.chars[i]:
                    for k in range(i, self.end[i]):
                        chosen[k] = True

    def text(self) -> str:
        """Blocks of the main text, white space in each as one space, two line feeds between them."""
        chosen = self.content()
        place = {id(node): i for i, node in enumerate(self.nodes)}
        blocks: list[list[str]] = [[]]
        todo: list[tuple[int, Iterator]] = [(0, iter(self.nodes[0].children))]
        runs = [iter(r) for r in self.runs]
        while todo:
            i, rest = todo[-1]
            name = self.nodes[i].name
            child = next(rest, None)
            if child is None:
                todo.pop()
                if name in _SPACE_AFTER:
                    blocks[-1].append(" ")
                elif name not in INLINE:
                    blocks.append([])
            elif isinstance(child, str):
                run = next(runs[i])
                if chosen[i] and self.kept[i]:
                    blocks[-1].append(run)
            else:
                k = place[id(child)]
                if self.kept[k]:
                    if child.name not in INLINE and child.name not in _SPACE_AFTER or child.name == "hr":
                        blocks.append([])
                    todo.append((k, iter(child.children)))
        joined = (" ".join("".join(b).split()) for b in blocks)
        return "\n\n".join(b for b in joined if b)


def main_text(html: str | None) -> str:
    """The article of a page; empty if it has none. Null counts as the empty page."""
    return Page(html).text() if html else ""


def extract_main_text(pages: DataFrame, column: str = "html") -> DataFrame:
    """All columns of ``pages`` with text, the main text of the page, and n_chars, its code points.

    Columns of ``pages`` called text or n_chars are replaced. Null and empty pages, pages without
    text and pages of nothing but boilerplate have the empty text. Pages are taken one by one,
    whole, in time linear in their length.
    """
    bounded_batches(pages.sparkSession)
    names = [c for c in pages.columns if c not in ("text", "n_chars")]
    wanted = pages.select(*(f"`{c}`" for c in names))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(html.as_py()) for html in batch.column(column)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())],
                [*names, "text", "n_chars"],
            )

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in wanted.schema)
    return wanted.mapInArrow(extract, f"{kinds}, text string, n_chars long")
