"""Pages as trees of block elements and text blocks, for main-text extraction.

A fast, forgiving reading of HTML: unknown, unclosed and crossed tags are
taken as browsers would take them, near enough for text. Every block element
is a node; every run of text between block tags is a leaf below it.
"""

from __future__ import annotations

import html
import re

_TAG = re.compile(
    r"<!--(?:.*?-->|.*\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)>"
    r"|<[!?][^>]*+>",
    re.S,
)
_ATTR = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")

#: Elements that run within a line of text.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark nobr q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr picture source".split())
#: Elements whose content is never text of the page.
SKIPPED = frozenset("script style noscript template iframe object svg math canvas audio video textarea select title".split())
VOID = frozenset("area base col embed hr input link meta param track".split())
#: Opening one of these ends an open paragraph.
_ENDS_P = frozenset("address article aside blockquote center details dialog dd dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section table ul".split())
_SAME = {"li": ("li", frozenset(["ul", "ol", "menu"])), "dt": ("dt dd", frozenset(["dl"])), "dd": ("dt dd", frozenset(["dl"])), "tr": ("tr td th", frozenset(["table"])), "td": ("td th", frozenset(["tr", "table"])), "th": ("td th", frozenset(["tr", "table"])), "option": ("option", frozenset(["select"]))}


class Node:
    """A block element, or with ``tag`` "#text" a block of text."""

    __slots__ = ("tag", "attrs", "parent", "text", "link_chars", "chars")

    def __init__(self, tag: str, attrs: str, parent: int):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.text, self.link_chars, self.chars = "", 0, 0


def attributes(raw: str) -> dict[str, str]:
    """Attributes of a tag, names lower-cased; of equal names the first counts."""
    out: dict[str, str] = {}
    for m in _ATTR.finditer(raw):
        out.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    return out


def parse(page: str | None) -> list[Node]:
    """Nodes in page order; node 0 is the root, parents come before children."""
    nodes = [Node("#root", "", -1)]
    stack = [0]
    parts: list[str] = []
    linked: list[str] = []
    in_link = 0
    text = page or ""

    def flush() -> None:
        if parts:
            words = " ".join(html.unescape("".join(parts)).split())
            if words:
                leaf = Node("#text", "", stack[-1])
                leaf.text, leaf.chars = words, len(words)
                leaf.link_chars = len(" ".join(html.unescape("".join(linked)).split()))
                nodes.append(leaf)
            parts.clear()
        linked.clear()

    def close(names: str, stop: frozenset) -> None:
        wanted = names.split()
        for k in range(len(stack) - 1, 0, -1):
            tag = nodes[stack[k]].tag
            if tag in wanted:
                del stack[k:]
                return
            if tag in stop:
                return

    at, n = 0, len(text)
    while at < n:
        m = _TAG.search(text, at)
        if not m:
            parts.append(text[at:])
            break
        if m.start() > at:
            run = text[at : m.start()]
            parts.append(run)
            if in_link:
                linked.append(run)
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        tag, closing = name.lower(), m[1] or m[4]
        if tag in INLINE:
            if tag == "br":
                parts.append(" ")
            elif tag == "a":
                in_link = 0 if closing else 1
                if not closing:
                    linked.append(" ")
            continue
        if tag in SKIPPED:
            if not closing and not (m[3] or m[6] or "").rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(text, at)
                at = end.end() if end else (n if tag in ("script", "style") else at)
            continue
        flush()
        if closing:
            for k in range(len(stack) - 1, 0, -1):
                if nodes[stack[k]].tag == tag:
                    del stack[k:]
                    break
            continue
        if tag in _ENDS_P:
            close("p", frozenset(["table", "td", "th", "button"]))
        if tag in _SAME:
            close(*_SAME[tag])
        if tag in VOID:
            continue
        nodes.append(Node(tag, m[3] or m[6] or "", stack[-1]))
        stack.append(len(nodes) - 1)
    flush()
    return nodes
