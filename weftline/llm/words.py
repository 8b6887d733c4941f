"""Words, and function words of five languages."""

from __future__ import annotations

import re
from collections import Counter

LANGS = ("en", "fr", "de", "es", "it")

WORD = re.compile(r"[^\W\d_]+")

#: Function words by language, chosen by hand: articles, prepositions, conjunctions, pronouns, auxiliaries, adverbs.
FUNCTION_WORDS = {
    "en": "the a an of and in to is was that it for with on by at from this be are as or not but have has had he she they we his her their which can will there been were been than when while because if so into through under over between about after before until although its one everyone somebody nobody you your",
    "fr": "le la les l un une des du de d et à au aux en est sont n ne pas que qui dans par pour sur avec ce cette ces se s il elle ils plus mais ou où quand parce puisque alors sans sous chez entre jamais été depuis jusqu a fait près côté après avant derrière qu",
    "de": "der die das den dem des ein eine einen einem einer eines und in im ist sind nicht zu mit von für auf am an bei aus nach vor über hinter neben zwischen während seit bis aber doch denn weil wenn als auch wird wurde war noch nie so sehr vom zum zur ohne oder es er sie sich",
    "es": "el la los las un una unos unas de del y en a al es son no que se por para con sin su sus lo como más pero porque cuando mientras ya está fue nunca tan muy hasta desde hace sobre entre detrás antes después durante junto cerca también o si",
    "it": "il lo la i gli le l un uno una di del della dei delle e in nel nella a al alla ai è sono non che si per con senza su sul sulla da dal dalla come più ma o perché quando mentre poiché mai stato così fino anche prima dopo dietro sotto tra durante vicino accanto d ed fra",
}
SETS = tuple(frozenset(FUNCTION_WORDS[x].split()) for x in LANGS)

#: word -> bit mask of the languages that have it as a function word.
MASKS: dict[str, int] = {}
for _i, _s in enumerate(SETS):
    for _w in _s:
        MASKS[_w] = MASKS.get(_w, 0) | 1 << _i


_MEMBERS = {m: tuple(i for i in range(len(LANGS)) if m >> i & 1) for m in range(1, 1 << len(LANGS))}


def function_words(words: list[str]) -> tuple[int, int]:
    """(number of function words, language index) of the language that has most of them; -1 if none has any."""
    counts = [0] * len(LANGS)
    for mask, n in Counter(map(MASKS.get, words)).items():
        if mask:
            for i in _MEMBERS[mask]:
                counts[i] += n
    most = max(counts)
    return (most, counts.index(most)) if most else (0, -1)


#: Letters that the five languages are written with; and share of others from which a text is in none of them.
LETTERS = "a-zàâäáæçéèêëíìîïñóòôöœúùûüßÿªº"
OTHER_SHARE = 0.02
_OTHER = re.compile(rf"[^\W\d_{LETTERS}]", re.I)


def other_letters(lower: str) -> int:
    """Letters of a lower-case text that none of the five languages uses."""
    return 0 if lower.isascii() else len(_OTHER.findall(lower))
