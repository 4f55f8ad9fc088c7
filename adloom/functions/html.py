"""HTML selection inside Arrow batches.

Spark ships only the html column to Python and gets back the selected strings;
everything after the selection (joining, trimming, resolving) is built-in
expressions. Selectors are plain data, see :class:`Selector`.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Sequence
from dataclasses import dataclass
from html import unescape
from html.entities import html5

from pyspark.sql import Column

from adloom.operators.isolate import isolated


@dataclass(frozen=True)
class Selector:
    """Elements by tag name, with optional conditions.

    ``op`` is ``eq`` (whole attribute equals ``value``) or ``token`` (one of its
    space-separated tokens does). ``parent`` is the tag of the direct parent;
    ``ancestor`` is a selector met at any depth above.
    """

    tag: str
    attr: str | None = None
    value: str | None = None
    op: str = "eq"
    parent: str | None = None
    ancestor: Selector | None = None

    def accepts(self, markup: str) -> bool:
        """Whether the attribute part of a start tag meets the condition."""
        if self.attr is None:
            return True
        if self.value not in markup and "&" not in markup:
            return False
        found = attribute(markup, self.attr)
        if found is None:
            return False
        return found == self.value if self.op == "eq" else self.value in found.split(" ")


# Where ads keep their text, and where listings keep their links.
AD_AXES = (
    Selector("title", parent="head"),
    Selector("span", "class", "pre"),
    Selector("table", "id", "attributeTable"),
    Selector("div", "class", "col-md-8"),
)
LISTING_LINKS = (
    Selector("a", ancestor=Selector("div", "class", "asset-list", op="token")),
    Selector("a", "class", "href-link", op="token"),
)

# Elements without an end tag, and elements whose content is raw.
VOID = frozenset(
    "area base br col command embed hr img input keygen link meta param source track wbr".split()
)
RAW = frozenset(("script", "style"))

# Comment, declaration, or tag. Possessive, and open-ended at the end of the page,
# so that broken markup is still read in one pass.
_TAG = re.compile(
    r"<(?:(/?)([A-Za-z][^\s/>]*+)"
    r"""([^>=]*+(?:=(?:\s*+"[^"]*+"|\s*+'[^']*+')?[^>=]*+)*+)(?:>|\Z)"""
    r"|!--.*?(?:-->|\Z)|[!?][^>]*+(?:>|\Z))",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(
    r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?"""
)
_SELF_CLOSED = re.compile(r"""(?:\A|[\s"'])/\s*\Z""")
_RAW_END = {name: re.compile(rf"</{name}\b", re.IGNORECASE) for name in RAW}
_REFERENCE = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|([A-Za-z][A-Za-z0-9]*));")


def decode(text: str) -> str:
    """Character references replaced; unknown names stay as they are."""
    if "&" not in text:
        return text
    return _REFERENCE.sub(
        lambda m: html5.get(m[1] + ";", m[0]) if m[1] else unescape(m[0]), text
    )


def attribute(markup: str, name: str) -> str | None:
    """First value of an attribute, decoded; None when absent."""
    for match in _ATTRIBUTE.finditer(markup):
        if match[1].lower() == name:
            return decode(match[2] or match[3] or match[4] or "")
    return None


def self_closed(markup: str) -> bool:
    """Whether the attribute part of a tag ends in a slash of its own."""
    return markup.rstrip().endswith("/") and _SELF_CLOSED.search(markup) is not None


def select_text(html: str, axes: Sequence[Selector]) -> list[list[list[str]]]:
    """Text nodes below every match: one list per axis, then per match.

    An end tag closes the nearest open element of its name together with all
    elements inside; one without an open element is ignored.
    """
    found: list[list[list[str]]] = [[] for _ in axes]
    by_tag = defaultdict(list)
    for number, axis in enumerate(axes):
        by_tag[axis.tag].append((number, axis))
    stack: list[tuple[str, int]] = []
    open_names: dict[str, int] = {}
    receivers: list[list[str]] = []
    pieces: list[str] = []
    at, size = 0, len(html)

    def flush() -> None:
        node = "".join(pieces)
        pieces.clear()
        for receiver in receivers:
            receiver.append(node)

    search = _TAG.search
    while at < size:
        tag = search(html, at)
        if receivers:
            text = html[at : tag.start() if tag else size]
            if text:
                pieces.append(decode(text))
        if tag is None:
            break
        at = tag.end()
        end, name, rest = tag.groups()
        if name is None:
            if pieces:
                flush()
            continue
        name = name.lower()
        if end:
            if not open_names.get(name):
                continue
            if pieces:
                flush()
            closed = None
            while closed != name:
                closed, matches = stack.pop()
                open_names[closed] -= 1
                if matches:
                    del receivers[-matches:]
            continue
        if pieces:
            flush()
        opened = []
        for number, axis in by_tag.get(name, ()):
            parent = stack[-1][0] if stack else None
            if axis.parent in (None, parent) and axis.accepts(rest):
                nodes: list[str] = []
                found[number].append(nodes)
                opened.append(nodes)
        if name in VOID or self_closed(rest):
            continue
        receivers.extend(opened)
        stack.append((name, len(opened)))
        open_names[name] = open_names.get(name, 0) + 1
        if name in RAW:
            close = _RAW_END[name].search(html, at)
            stop = close.start() if close else size
            if receivers and stop > at:
                pieces.append(html[at:stop])
            at = stop
    if pieces:
        flush()
    return found


def select_links(html: str, selectors: Sequence[Selector]) -> list[list[str]]:
    """``href`` of every match in document order, one list per selector.

    An ancestor spans from its start tag to the end tag that pairs with it by
    name; a start tag that is never closed contains nothing.
    """
    numbered = list(enumerate(selectors))
    by_tag = defaultdict(list)
    by_ancestor = defaultdict(list)
    for number, selector in numbered:
        by_tag[selector.tag].append((number, selector))
        if selector.ancestor:
            by_ancestor[selector.ancestor.tag].append((number, selector.ancestor))
    watched = {*by_tag, *by_ancestor}
    open_ancestors: dict[str, list[tuple[int, list[int]]]] = {name: [] for name in by_ancestor}
    anchors: list[tuple[str | None, list[int]]] = []
    # Per selector: +1 where a matching ancestor starts, -1 where it ends.
    cover = [Counter() for _ in selectors]
    for tag in _TAG.finditer(html):
        end, name, rest = tag.groups()
        if name is None or (name := name.lower()) not in watched:
            continue
        nesting = open_ancestors.get(name)
        if end:
            if nesting:
                start, matched = nesting.pop()
                for number in matched:
                    cover[number][start] += 1
                    cover[number][len(anchors)] -= 1
            continue
        hits = [number for number, selector in by_tag.get(name, ()) if selector.accepts(rest)]
        if hits:
            anchors.append((attribute(rest, "href"), hits))
        if nesting is not None and not self_closed(rest):
            matched = [number for number, upper in by_ancestor[name] if upper.accepts(rest)]
            nesting.append((len(anchors), matched))
    result: list[list[str]] = [[] for _ in selectors]
    depth = [0] * len(numbered)
    for index, (href, hits) in enumerate(anchors):
        for number, selector in numbered:
            depth[number] += cover[number].get(index, 0)
            if number in hits and href is not None and (depth[number] or not selector.ancestor):
                result[number].append(href)
    return result


def text_nodes(html: Column, axes: Sequence[Selector] = AD_AXES) -> Column:
    """Struct ``(value, error)``; value is axis -> match -> text nodes."""
    chosen = tuple(axes)
    if any(axis.ancestor for axis in chosen):
        raise ValueError("text is selected by parent, not by ancestor")
    return isolated(lambda page: select_text(page, chosen), "array<array<array<string>>>")(html)


def links(html: Column, selectors: Sequence[Selector] = LISTING_LINKS) -> Column:
    """Struct ``(value, error)``; value is selector -> hrefs in document order."""
    chosen = tuple(selectors)
    if any(s.parent or (s.ancestor and s.ancestor.ancestor) for s in chosen):
        raise ValueError("links are selected by one ancestor, not by parent")
    return isolated(lambda page: select_links(page, chosen), "array<array<string>>")(html)
