"""An English stemmer by suffix rules (the published Porter2 rules), for vocabularies.

A stem is found for each distinct word once; searches meet documents by the
vocabulary's stems, so a stem is never computed for an occurrence.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

#: Words with stems of their own, and words that are their stems.
IRREGULAR = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie",
    "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
#: Words that end as they are once a plural is gone.
WHOLE = frozenset("inning outing canning herring earring proceed exceed succeed".split())
#: Beginnings after which the first region starts.
PREFIXES = ("gener", "commun", "arsen")
#: Suffixes of the second and third step and what takes their place.
SECOND = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize",
    "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful",
    "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og",
    "fulli": "ful", "lessli": "less", "li": "",
}
THIRD = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
#: Suffixes that the fourth step takes away.
FOURTH = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")

_VOWEL = re.compile("[aeiouy]")
_REGION = re.compile("[aeiouy][^aeiouy]")
_DOUBLE = re.compile(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)\Z")
_SHORT = re.compile(r"([^aeiouy][aeiouy][^aeiouywxY]|\A[aeiouy][^aeiouy])\Z")


def _longest(word: str, suffixes: Iterable[str]) -> str:
    return max((s for s in suffixes if word.endswith(s)), key=len, default="")


def _regions(word: str) -> tuple[int, int]:
    """Where the two regions begin: each after the first consonant that follows a vowel."""

    def after(at: int) -> int:
        m = _REGION.search(word, at)
        return m.end() if m else len(word)

    first = next((len(p) for p in PREFIXES if word.startswith(p)), None)
    first = after(0) if first is None else first
    return first, after(first)


def _first(word: str, r1: int) -> str:
    """Plurals, participles and a last y."""
    s = _longest(word, ("sses", "ied", "ies", "us", "ss", "s"))
    if s == "sses":
        word = word[:-2]
    elif s in ("ied", "ies"):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif s == "s" and _VOWEL.search(word[:-2]):
        word = word[:-1]
    if word in WHOLE:
        return word
    s = _longest(word, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if s in ("eed", "eedly"):
        if len(word) - len(s) >= r1:
            word = word[: -len(s)] + "ee"
    elif s and _VOWEL.search(word[: -len(s)]):
        word = word[: -len(s)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif _DOUBLE.search(word):
            word = word[:-1]
        elif r1 >= len(word) and _SHORT.search(word):
            word += "e"
    if len(word) > 2 and word[-1] in "yY" and not _VOWEL.match(word[-2]):
        word = word[:-1] + "i"
    return word


def _replaced(word: str, rules: dict[str, str], r1: int, r2: int) -> str:
    s = _longest(word, rules)
    at = len(word) - len(s)
    if not s or at < r1 or s == "ogi" and word[at - 1 : at] != "l" or s == "li" and word[at - 1 : at] not in tuple("cdeghkmnrt") or s == "ative" and at < r2:
        return word
    return word[:at] + rules[s]


def stem(word: str) -> str:
    """The stem of a lower-case word; words that are not of Latin letters a to z, and of one or two letters, stay."""
    if len(word) <= 2 or not word.isascii() or not word.replace("'", "").isalpha():
        return word
    if word in IRREGULAR:
        return IRREGULAR[word]
    word = re.sub("'s'?$|'$", "", word.lstrip("'"))
    # A y that is a consonant: at the beginning and after a vowel.
    word = re.sub(r"\Ay|(?<=[aeiouy])y", "Y", word)
    r1, r2 = _regions(word)
    word = _first(word, r1)
    if word in WHOLE:
        return word
    word = _replaced(_replaced(word, SECOND, r1, r2), THIRD, r1, r2)
    s = _longest(word, FOURTH)
    at = len(word) - len(s)
    if s and at >= r2 and (s != "ion" or word[at - 1 : at] in ("s", "t")):
        word = word[:at]
    at = len(word) - 1
    if word.endswith("e") and (at >= r2 or at >= r1 and not _SHORT.search(word[:-1])) or word.endswith("ll") and at >= r2:
        word = word[:-1]
    return word.lower()
