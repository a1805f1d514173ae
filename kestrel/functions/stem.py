"""English stems by Porter's published rules (An algorithm for suffix
stripping, 1980), for the distinct terms of a dictionary."""

from __future__ import annotations

import re

# The usual English stop words of search engines.
STOP_WORDS = ("a an and are as at be but by for if in into is it no not of on or such that the their then there these "
              "they this to was will with")

# Suffixes and what they become, by the rules' steps 2 to 4.
STEP2 = ("ational ate, tional tion, enci ence, anci ance, izer ize, abli able, alli al, entli ent, eli e, ousli ous, ization ize, "
         "ation ate, ator ate, alism al, iveness ive, fulness ful, ousness ous, aliti al, iviti ive, biliti ble")
STEP3 = "icate ic, ative, alize al, iciti ic, ical ic, ful, ness"
STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize"


def _kinds(word: str) -> str:
    """c for each consonant, v for each vowel; y is a vowel behind a
    consonant."""
    out = ""
    for i, x in enumerate(word):
        vowel = x in "aeiou" or (x == "y" and i > 0 and out[-1] == "c")
        out += "v" if vowel else "c"
    return out


def _measure(word: str) -> int:
    return len(re.findall("v+c+", _kinds(word)))


def _has_vowel(word: str) -> bool:
    return "v" in _kinds(word)


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _kinds(word)[-1] == "c"


def _short_end(word: str) -> bool:
    """Ends consonant, vowel, consonant other than w, x, y."""
    return _kinds(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _pairs(table: str) -> list[tuple[str, str]]:
    rows = [(*x.split(), "")[:2] for x in table.split(", ")]
    return sorted(rows, key=lambda r: -len(r[0]))  # the longest suffix decides


_2, _3, _4 = _pairs(STEP2), _pairs(STEP3), sorted(STEP4.split(), key=lambda s: -len(s))


def _replaced(word: str, table: list[tuple[str, str]]) -> str:
    for suffix, put in table:
        if word.endswith(suffix):
            base = word[:len(word) - len(suffix)]
            return base + put if _measure(base) > 0 else word
    return word


def _plural(word: str) -> str:
    for suffix, put in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if word.endswith(suffix):
            return word[:len(word) - len(suffix)] + put
    return word


def _past(word: str) -> str:
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    for suffix in ("ed", "ing"):
        if word.endswith(suffix):
            base = word[:len(word) - len(suffix)]
            if not _has_vowel(base):
                return word
            if base.endswith(("at", "bl", "iz")):
                return base + "e"
            if _double(base) and base[-1] not in "lsz":
                return base[:-1]
            return base + "e" if _measure(base) == 1 and _short_end(base) else base
    return word


def stem(word: str) -> str:
    """Stem of a lower-case word; words of one or two letters and words with
    anything but a to z stay."""
    if len(word) < 3 or not re.fullmatch("[a-z]+", word):
        return word
    word = _past(_plural(word))
    if word.endswith("y") and _has_vowel(word[:-1]):
        word = word[:-1] + "i"
    word = _replaced(_replaced(word, _2), _3)
    for suffix in _4:
        if word.endswith(suffix):
            base = word[:len(word) - len(suffix)]
            if _measure(base) > 1 and (suffix != "ion" or base.endswith(("s", "t"))):
                word = base
            break
    if word.endswith("e"):
        base = word[:-1]
        if _measure(base) > 1 or (_measure(base) == 1 and not _short_end(base)):
            word = base
    if word.endswith("ll") and _measure(word[:-1]) > 1:
        word = word[:-1]
    return word
