"""Porter's suffix stripping (1980), from the rules of the paper."""

from __future__ import annotations

import re
from functools import lru_cache

_VOWELS = "aeiou"


def _form(word: str) -> str:
    """Letters as c (consonant) or v; y is a vowel after a consonant."""
    out = ""
    for i, ch in enumerate(word):
        vowel = ch in _VOWELS or (ch == "y" and i > 0 and out[-1] == "c")
        out += "v" if vowel else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _form(stem)))


def _cvc(stem: str) -> bool:
    return _form(stem).endswith("cvc") and stem[-1] not in "wxy"


def _double(stem: str) -> bool:
    return len(stem) > 1 and stem[-1] == stem[-2] and _form(stem)[-1] == "c"


# Suffixes of the paper's steps 2 to 4 with their replacements.
_STEP2 = """ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous
ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble"""
_STEP3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
_STEP4 = "al: ance: ence: er: ic: able: ible: ant: ement: ment: ent: ion: ou: ism: ate: iti: ous: ive: ize:"


def _rules(text: str) -> list[tuple[str, str]]:
    """Longest suffix first, as the paper takes the longest match."""
    return sorted((tuple(r.split(":")) for r in text.split()), key=lambda r: -len(r[0]))


_RULES = [(_rules(_STEP2), 0), (_rules(_STEP3), 0), (_rules(_STEP4), 1)]


def _replace(word: str, rules: list[tuple[str, str]], least: int) -> str:
    for suffix, by in rules:
        if word.endswith(suffix):
            base = word[: len(word) - len(suffix)]
            fits = _measure(base) > least and (suffix != "ion" or base.endswith(("s", "t")))
            return base + by if fits else word
    return word


def _step1(word: str) -> str:
    for suffix, by in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if word.endswith(suffix):
            word = word[: len(word) - len(suffix)] + by
            break
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    for suffix in ("ed", "ing"):
        base = word[: -len(suffix)]
        if word.endswith(suffix) and "v" in _form(base):
            if base.endswith(("at", "bl", "iz")):
                return base + "e"
            if _double(base) and base[-1] not in "lsz":
                return base[:-1]
            return base + "e" if _measure(base) == 1 and _cvc(base) else base
    return word


@lru_cache(1 << 16)
def stem(word: str) -> str:
    """The stem of a lower-case word; words of up to two letters and words with other characters than a-z stay."""
    if len(word) < 3 or not re.fullmatch("[a-z]+", word):
        return word
    word = _step1(word)
    if word.endswith("y") and "v" in _form(word[:-1]):
        word = word[:-1] + "i"
    for rules, least in _RULES:
        word = _replace(word, rules, least)
    if word.endswith("e"):
        base = word[:-1]
        m = _measure(base)
        if m > 1 or m == 1 and not _cvc(base):
            word = base
    return word[:-1] if word.endswith("ll") and _measure(word) > 1 else word
