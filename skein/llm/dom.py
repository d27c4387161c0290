"""Reads HTML into a small tree of block elements and runs of text, for many pages at once."""

from __future__ import annotations

import re
from html import unescape

import numpy as np

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)(?:>|\Z)", re.S
)
_NAMED = re.compile(r"""([^\s"'=/<>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
#: Elements that sit inside a line of text. All others begin and end a block.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark math mi mn mo nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
#: Elements without an end tag.
VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
#: Elements whose inside is characters and no markup.
RAW = frozenset("script style xmp iframe noembed noframes textarea title plaintext".split())
#: Elements of which nothing is text of the page.
UNREAD = frozenset("script style noscript template head title svg canvas object applet audio video iframe noembed noframes select datalist textarea button".split())
#: What a start tag ends, as far as it is open inside the given borders.
_P_ENDS = frozenset(
    "address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table ul".split()
)
_ENDS = {"li": ("li", ("ul", "ol", "menu", "dir")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")),
         "thead": ("thead tbody tfoot tr td th", ("table",)), "tbody": ("thead tbody tfoot tr td th", ("table",)), "tfoot": ("thead tbody tfoot tr td th", ("table",)), "option": ("option", ("select",))}
_BORDER = frozenset("td th table caption body html".split())
_TABLE = frozenset("table tr td th thead tbody tfoot caption".split())


class Forest:
    """The trees of some pages, as parallel lists over nodes in page order; a parent comes before its children."""

    def __init__(self):
        self.page, self.parent, self.depth, self.key, self.text, self.linked = [], [], [], [], [], []
        self.pages = 0
        self.keys: dict[tuple[str, str], int] = {}

    def _node(self, parent: int, key: int, text: str | None = None, linked: int = 0) -> int:
        self.page.append(self.pages)
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        self.key.append(key)
        self.text.append(text)
        self.linked.append(linked)
        return len(self.page) - 1

    def _key(self, tag: str, attributes: str) -> int:
        return self.keys.setdefault((tag, attributes), len(self.keys))

    def add(self, page: str) -> None:
        """Appends one page. Its first node is a root of its own; text nodes have a text, elements None."""
        stack, names = [self._node(-1, self._key("#page", ""))], ["#page"]
        open_count: dict[str, int] = {}
        run: list[str] = []
        linked, link_at, unread = 0, 0, 0  # link_at: size of the stack at the open link, or 0

        def flush() -> None:
            nonlocal linked
            if run:
                text = " ".join("".join(run).split())
                if text:
                    self._node(stack[-1], 0, text, min(linked, len(text)))
                run.clear()
            linked = 0

        def pop_to(size: int) -> None:
            nonlocal link_at, unread
            flush()
            while len(stack) > size:
                stack.pop()
                name = names.pop()
                open_count[name] -= 1
                unread -= name in UNREAD
            if link_at > len(stack):
                link_at = 0

        def close(wanted: frozenset | tuple | str, borders) -> None:
            """Ends the outermost open element of `wanted` that no border element shields."""
            found = 0
            for at in range(len(names) - 1, 0, -1):
                if names[at] in wanted:
                    found = at
                elif names[at] in borders:
                    break
            if found:
                pop_to(found)

        def read(text: str) -> None:
            nonlocal linked
            if text and not unread:
                text = unescape(text) if "&" in text else text
                run.append(text)
                if link_at:
                    linked += len(text)

        at, end = 0, len(page)
        while at < end:
            m = _TOKEN.search(page, at)
            if not m:
                read(page[at:])
                break
            read(page[at : m.start()])
            at = m.end()
            closing, opening, attributes = m.groups()
            if opening:
                tag = opening.lower()
                if tag in INLINE:
                    if tag == "a":
                        link_at = len(stack)
                    continue
                if tag in VOID:
                    if tag == "br":
                        read(" ")
                    elif tag == "hr":
                        flush()
                    continue
                if tag in ("html", "body") and open_count.get(tag):
                    continue
                flush()
                if tag == "body" and open_count.get("head"):
                    close(("head",), ())
                if tag in _P_ENDS and open_count.get("p"):
                    close(("p",), _BORDER)
                if tag in _ENDS:
                    ended, borders = _ENDS[tag]
                    close(ended.split(), borders)
                if tag in RAW:
                    rest = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at) if tag != "plaintext" else None
                    stop, at = (rest.start(), rest.end()) if rest else (end, end)
                    if tag not in UNREAD and not unread:
                        text = " ".join(page[m.end() : stop].split())
                        if text:
                            self._node(self._node(stack[-1], self._key(tag, attributes)), 0, text)
                    continue
                stack.append(self._node(stack[-1], self._key(tag, attributes)))
                names.append(tag)
                open_count[tag] = open_count.get(tag, 0) + 1
                unread += tag in UNREAD
            elif closing:
                tag = closing.lower()
                if tag == "a":
                    link_at = 0
                elif tag == "br":
                    read(" ")
                elif tag == "p" and not open_count.get("p"):
                    flush()
                elif tag not in INLINE and open_count.get(tag):
                    borders = () if tag in ("body", "html") else ("table",) if tag in _TABLE and tag != "table" else () if tag == "table" else _BORDER
                    for k in range(len(names) - 1, 0, -1):
                        if names[k] == tag:
                            pop_to(k)
                            break
                        if names[k] in borders:
                            break
        flush()
        self.pages += 1


def attribute_words(attributes: str) -> list[str]:
    """Words of an element's class, id, role and item property, and marks of hidden elements."""
    out = []
    for name, value in _NAMED.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id", "role", "itemprop", "aria-label", "data-testid", "data-component", "name"):
            out += [w.lower() for w in _WORD.findall(value)]
            out += [w.lower() for w in value.split() if len(w) < 40]
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
            out.append("#hidden")
    return out[:64]


def levels(depth: np.ndarray) -> list[np.ndarray]:
    """Node numbers of each depth, from the roots down."""
    order = np.argsort(depth, kind="stable")
    return np.split(order, np.cumsum(np.bincount(depth))[:-1]) if len(depth) else []
