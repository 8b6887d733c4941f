"""Which lines of a text are prose, and statistics of the text.

A line is no prose if it is marked as a list entry, is a row of cells, a log
line, a link, a pair of key and value, code, or has hardly any function words.
Lines wrapped at a width are joined first; runs of short lines without an end
mark are menus or lists.
"""

from __future__ import annotations

import re

from weftline.llm.words import OTHER_SHARE, WORD, function_words, other_letters

_MARK = re.compile(r"\s*(?:[-*•–·‣◦▪+>#]+|\(?\d{1,4}[.)]|\(?[A-Za-z][.)]|\d+ ?[x×])\s")
_LOG = re.compile(r"\s*\[?(?:\d{4}-\d\d-\d\d|\d\d?[./]\d\d?[./]\d{4}|\d\d:\d\d)[ T,\]]")
_LINK = re.compile(r"\s*(?:https?://|www\.)\S+\s*$", re.I)
_CELL = re.compile(r"[|\t;,•·/»]|  +| [-–>] ")
_CODE = re.compile(r"[{}=<>()\[\]\;_$^~`|@#*%&]")
_END = re.compile(r"[.!?…:;,。！？、][\"'»”’)\]」]*$")
_STOP = re.compile(r"[.!?…。！？][\"'»”’)\]」]*$")
_PAIR = re.compile(r"\s*\S+(?: \S+){0,2} ?:(?: \S+){0,2}\s*$")
#: Lines of up to so many words without an end mark may be entries of a menu or list.
SHORT_WORDS = 9
#: Share of function words under which a line of three or more words is no prose.
LEAST_FUNCTION_WORDS = 0.12

#: Names of the statistics, in the order in which ``statistics`` gives them after ``junk``.
STATISTICS = ("n_words", "mean_word_length", "symbol_ratio", "punct_line_share", "common_word_share")


class Line:
    """A non-blank line (or wrapped ones joined) with what is counted once: words, visible characters, letters."""

    __slots__ = ("text", "words", "size", "letters", "prose", "ended")

    def __init__(self, text: str):
        self.text = text
        self.words = WORD.findall(text.lower())
        self.size = len("".join(text.split()))
        self.letters = sum(map(len, self.words))
        self.prose = False
        self.ended = _STOP.search(text) is not None


def _filled(lines: list[Line]) -> bool:
    """Whether lines were wrapped at a width: mostly, the next line's first word would not have fitted.

    The width is a high but not the highest length, as some lines may have
    grown after wrapping.
    """
    if len(lines) < 2:
        return False
    sizes = [len(x.text) for x in lines]
    width = sorted(sizes[:-1])[int(0.7 * (len(sizes) - 2))] if len(lines) > 3 else max(sizes)
    if width < 35:
        return False
    fit = sum(n + 1 + len(b.text.split(None, 1)[0]) > width for n, b in zip(sizes, lines[1:]))
    return fit >= 0.8 * (len(lines) - 1)


def _plain(line: Line) -> bool:
    """Whether a line may be prose by its own form."""
    text, n = line.text, line.size
    if _MARK.match(text) or _LOG.match(text) or _LINK.match(text) or _PAIR.match(text):
        return False
    if n >= 20 and " " not in text and text.isascii():
        return False
    if line.letters >= 0.97 * n and "  " not in text:
        return True
    if line.letters < 0.7 * n or len(_CODE.findall(text)) >= 0.12 * n:
        return False
    return not (len(line.words) > 1 and len(_CELL.findall(text)) >= 0.6 * len(line.words))


def _sentence(words: list[str], ended: bool, known: bool) -> bool:
    """Whether words are a sentence: by function words, in an unknown language by an end mark or their number."""
    if len(words) < 3:
        return ended
    if not known and (ended or len(words) >= SHORT_WORDS):
        return True
    return function_words(words)[0] >= LEAST_FUNCTION_WORDS * len(words)


def judge(text: str) -> list[Line]:
    """The non-blank lines of a text, each marked as prose or not."""
    known = text.isascii() or other_letters(text.lower()) < OTHER_SHARE * len(text)
    lines: list[Line] = []
    paragraph: list[Line] = []
    run: list[Line] = []

    def close_run() -> None:
        if len(run) > 2:
            for x in run:
                x.prose = False
        run.clear()

    def close() -> None:
        # A heading or two may stand over the wrapped lines.
        for start in range(min(3, len(paragraph))):
            if _filled(paragraph[start:]):
                break
        else:
            start = len(paragraph)
        for x in paragraph[:start]:
            x.prose = _sentence(x.words, x.ended, known)
            n = x.text.count(" ") + 1
            if n <= SHORT_WORDS and not _END.search(x.text) or n <= 3:
                run.append(x)
            else:
                close_run()
        if start < len(paragraph):
            close_run()
            rest = paragraph[start:]
            prose = _sentence([w for x in rest for w in x.words], rest[-1].ended, known)
            for x in rest:
                x.prose = prose
        paragraph.clear()

    for raw in text.splitlines():
        text_ = raw.strip()
        if not text_:
            close()
            close_run()
            continue
        line = Line(text_)
        lines.append(line)
        if _plain(line):
            paragraph.append(line)
        else:
            close()
            if len(line.words) <= SHORT_WORDS and not line.ended:
                run.append(line)
            else:
                close_run()
    close()
    close_run()
    return lines


def statistics(text: str | None) -> tuple[int, float, float, float, float, float, float] | None:
    """(language index, share of characters outside prose, then STATISTICS) of a text.

    Shares of characters are without white space; the language is the one with
    most function words, -1 if they are under LEAST_FUNCTION_WORDS of all words.
    None for null, empty and blank texts; a text without words has 0 for what is
    counted by word.
    """
    if not text:
        return None
    lines = judge(text)
    total = sum(x.size for x in lines)
    if not total:
        return None
    junk = sum(x.size for x in lines if not x.prose)
    words = [w for x in lines for w in x.words]
    n, letters = len(words), sum(x.letters for x in lines)
    common, lang = function_words(words)
    if common < LEAST_FUNCTION_WORDS * n:
        lang = -1
    ended = sum(x.ended for x in lines) / len(lines)
    return lang, junk / total, float(n), letters / n if n else 0.0, 1 - letters / total, ended, common / n if n else 0.0
