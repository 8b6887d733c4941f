"""Quote-aware tokenizer for fields that pack several values.

An automaton over the structural characters of a field: escapes, quotes,
brackets and delimiters.  Its state is the open quote, the nesting depth and
the start of the open value.  Delimiters outside quotes (and, for nested values,
outside brackets) end a value; a list in brackets around the whole field is no
nesting.  Where a ``Packing`` says how values begin, a delimiter ends one only
if another value follows (blanks, quotes, brackets and more delimiters may stand
between) or the field ends; elsewhere it belongs to its value.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cached_property


@dataclass(frozen=True)
class Packing:
    """How values are packed: the structural characters, how a value begins, and whether bracketed groups are values."""

    delimiters: str = ";,|\n\r\t"
    quotes: str = "\"'"
    escape: str = "\\"
    opening: str = "["
    closing: str = "]"
    begins: str | None = None
    nested: bool = True

    def _class(self, chars: str) -> str:
        return f"[{re.escape(chars)}]" if chars else r"(?!)"

    @cached_property
    def event(self) -> re.Pattern[str]:
        """The next structural character."""
        return re.compile(self._class(self.escape + self.quotes + self.opening + self.closing + self.delimiters))

    @cached_property
    def gap(self) -> re.Pattern[str]:
        """What may stand between two values."""
        return re.compile(f"[{re.escape(self.delimiters + self.quotes + self.opening + self.closing)} ]*")

    @cached_property
    def after(self) -> re.Pattern[str]:
        """What follows a closing quote or bracket: the end of the value."""
        return re.compile(rf"[ {re.escape(self.closing)}]*(?:{self._class(self.delimiters)}|\Z)")

    @cached_property
    def start(self) -> re.Pattern[str] | None:
        return re.compile(self.begins, re.I) if self.begins else None

    @cached_property
    def escaped(self) -> re.Pattern[str] | None:
        return re.compile(f"{re.escape(self.escape)}(.)", re.S) if self.escape else None


#: Links: values that start with http:// or https:// in any case, their slashes escaped or not; brackets only enclose lists.
LINKS = Packing(begins=r"https?:\\?/\\?/", nested=False)


def split_values(field: str | None, packing: Packing = Packing()) -> list[str]:
    """The values of a packed field in order; ``[]`` for null, empty and blank fields.

    Quotes, escapes and surrounding blanks are taken off, empty values skipped,
    repeated values kept.  A quote that is never closed is an ordinary
    character before a value and dropped.  Linear in the field's length.
    """
    out: list[str] = []
    if not field:
        return out
    p = packing
    n = len(field)
    base = _enclosed(field, p) if p.nested else 0
    quote = ""
    #: ``first``: place of the first character of the open value that is no blank; ``skip``: end of an escape.
    depth = start = first = skip = 0
    #: End of the gap last looked at and whether it separates; the position from which a quote is known not to close.
    gap_end, separates = -1, False
    open_ended: dict[str, int] = {}
    begins, after, gap = p.start, p.after, p.gap
    delimiters, quotes, opening, edge = p.delimiters, p.quotes, p.opening, p.quotes + p.delimiters + " "

    def emit(end: int) -> None:
        value = field[start:end].strip()
        if not value:
            return
        if begins:
            m = begins.match(value) or begins.search(value)
            if not m:
                return
            value = value[m.start() :].rstrip(edge)
        if p.escaped and p.escape in value:
            value = p.escaped.sub(r"\1", value)
        out.append(value)

    def opened(at: int) -> bool:
        """Whether the open value has a character before ``at``; every blank is looked at once."""
        nonlocal first
        if first < start:
            first = start
        while first < at and field[first].isspace():
            first += 1
        return first < at

    def closes(q: str, at: int) -> bool:
        """Whether the quote is closed later with a value's end after it."""
        if at >= open_ended.get(q, n + 1):
            return False
        begin = at
        while (at := field.find(q, at)) >= 0:
            if after.match(field, at + 1):
                return True
            at += 1
        open_ended[q] = begin
        return False

    for m in p.event.finditer(field):
        at = m.start()
        if at < skip:
            continue
        c = field[at]
        if c in delimiters:
            if begins:
                if at >= gap_end:
                    gap_end = gap.match(field, at).end()
                    separates = gap_end == n or begins.match(field, gap_end) is not None
                if not separates or quote and quote not in field[at:gap_end]:
                    continue
            elif quote or p.nested and depth > base:
                continue
            emit(at)
            quote, start = "", at + 1
        elif c in quotes:
            if quote:
                if c == quote and after.match(field, at + 1):
                    emit(at)
                    quote, start = "", at + 1
            elif not opened(at):
                quote = c if closes(c, at + 1) else ""
                start = at + 1
        elif c in p.escape:
            skip = at + 2
        elif quote:
            continue
        elif c in opening:
            if opened(at):
                depth += p.nested and depth > base
            else:
                depth += 1
                if not p.nested or depth <= base:
                    start = at + 1
        elif depth:
            if p.nested and depth > base:
                depth -= 1
            elif after.match(field, at + 1):
                emit(at)
                depth, start = depth - 1, at + 1
    emit(n)
    return out


def _enclosed(field: str, p: Packing) -> int:
    """How many pairs of brackets enclose the whole field."""
    bare = field.strip()
    ends = 0
    while ends < len(bare) // 2 and bare[ends] in p.opening and bare[-1 - ends] in p.closing:
        ends += 1
    if not ends:
        return 0
    depth, least, quote, skip = 0, ends, "", 0
    for m in p.event.finditer(bare, 0, len(bare) - ends):
        at = m.start()
        c = bare[at]
        if at < skip:
            continue
        if c in p.escape:
            skip = at + 2
        elif c in p.quotes:
            quote = "" if c == quote else quote or c
        elif not quote and (c in p.opening or c in p.closing):
            depth += 1 if c in p.opening else -1
            if at >= ends:
                least = min(least, depth)
    return max(0, least)


def split_items(field: str | None) -> list[str]:
    """The links of a packed field in order."""
    return split_values(field, LINKS)


def posting(item: str) -> tuple[str, str, str, str]:
    """(url, word count, positions, packed title) of one posting, from its right end.

    An item with fewer parts is a url without the rest.
    """
    parts = item.rsplit(":", 3)
    if len(parts) == 4 and len(parts[0]) > 7:
        return parts[0], parts[1], parts[2], parts[3]
    return item, "", "", ""
