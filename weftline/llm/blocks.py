"""HTML pages as numbered text blocks with their container paths.

A block is a maximal run of text between cutting tags.  Every tag cuts except
the inline ones; comments and a fixed set of elements are dropped with their
content.  Pages may be sloppy: tags in any case, unclosed paragraphs, list
items and table cells, stray closing tags, attributes with ``>`` inside
quotes.  The parser never fails; unclosed dropped elements reach to the end of
their parent (``head`` ends at ``body``, raw elements at their own end tag).
"""

from __future__ import annotations

import html
import re

# Elements whose content is no text, and tags that do not cut a block.
DROPPED = frozenset("head script style noscript iframe form button svg".split())
INLINE = frozenset("a b i em strong span code".split())
RAW = frozenset("script style".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag of the key closes an open element of the value, unless a scope element lies between.
_PARA = frozenset(
    "p div ul ol dl table section article aside nav main header footer h1 h2 h3 h4 h5 h6 pre blockquote figure address hr".split()
)
_CLOSES = {
    "li": frozenset(("li", "p")),
    "dt": frozenset(("dt", "dd", "p")),
    "dd": frozenset(("dt", "dd", "p")),
    "tr": frozenset(("tr", "td", "th", "p")),
    "td": frozenset(("td", "th", "p")),
    "th": frozenset(("td", "th", "p")),
    "option": frozenset(("option",)),
} | {t: frozenset(("p",)) for t in _PARA}
_SCOPE = {
    "li": frozenset(("ul", "ol", "menu")),
    "dt": frozenset(("dl",)),
    "dd": frozenset(("dl",)),
    "tr": frozenset(("table",)),
    "td": frozenset(("table", "tr")),
    "th": frozenset(("table", "tr")),
}
_NO_SCOPE: frozenset[str] = frozenset()

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""",
    re.S,
)
_TOKEN_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_CLASS = re.compile(r"""\bclass\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_RAW_END = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in RAW}


class Block:
    """A text block: its text, container path, own tag and what of it is link text."""

    __slots__ = ("text", "path", "tag", "linked", "links", "node", "order")

    def __init__(self, text, path, tag, linked, links, node):
        self.text, self.path, self.tag, self.linked, self.links, self.node = text, path, tag, linked, links, node


def _name(tag: str, attrs: str) -> str:
    """Generalised name of an element: tag and class, digits of ordinals left in."""
    if attrs and (m := _CLASS.search(attrs)):
        value = m.group(1) or m.group(2) or m.group(3) or ""
        if value := ".".join(value.split()):
            return f"{tag}.{value}"
    return tag


def blocks(page: str | None) -> list[Block]:
    """The text blocks of a page in page order; none for null or blank pages."""
    out: list[Block] = []
    if not page:
        return out
    #: open elements: (tag, path, node number)
    stack: list[tuple[str, str, int]] = [("", "", 0)]
    pieces: list[str] = []
    linked: list[str] = []
    links = nodes = in_link = 0
    drop = ""
    depth = 0
    at = 0
    n = len(page)

    def cut() -> None:
        nonlocal links
        if pieces:
            text = "".join(pieces)
            if "&" in text:
                text = html.unescape(text)
            text = " ".join(text.split())
            if text:
                tag, path, node = stack[-1]
                link = "".join(linked)
                if "&" in link:
                    link = html.unescape(link)
                out.append(Block(text, path, tag, len("".join(link.split())), links, node))
            pieces.clear()
        linked.clear()
        links = 0

    find = _TOKEN.search
    while at < n:
        m = find(page, at)
        if m is None:
            if not drop:
                pieces.append(page[at:])
            break
        start, end = m.span()
        if not drop and start > at:
            text = page[at:start]
            pieces.append(text)
            if in_link:
                linked.append(text)
        at = end
        tag = m.group(2)
        if tag is None:
            continue
        tag = tag.lower()
        close = m.group(1)
        if drop:
            if tag == drop:
                depth += -1 if close else 1
                if not depth:
                    drop = ""
            elif drop == "head" and tag == "body":
                drop = ""
            elif tag in RAW and not close:
                e = _RAW_END[tag].search(page, at)
                at = e.end() if e else n
            if drop or tag != "body":
                continue
        if tag in INLINE:
            if tag == "a":
                if close:
                    in_link = 0
                else:
                    in_link = 1
                    links += 1
            continue
        if tag in DROPPED:
            cut()
            if not close:
                if tag in RAW:
                    e = _RAW_END[tag].search(page, at)
                    at = e.end() if e else n
                elif not m.group(3).endswith("/"):
                    drop, depth = tag, 1
            continue
        cut()
        if tag in VOID:
            continue
        if close:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
            continue
        closes = _CLOSES.get(tag)
        if closes:
            scope = _SCOPE.get(tag, _NO_SCOPE)
            i = len(stack) - 1
            lowest = 0
            while i > 0 and stack[i][0] not in scope:
                if stack[i][0] in closes:
                    lowest = i
                elif tag not in _SCOPE:
                    break
                i -= 1
            if lowest:
                del stack[lowest:]
        nodes += 1
        name = _name(tag, m.group(3))
        stack.append((tag, f"{stack[-1][1]}>{name}", nodes))
    cut()
    return out
