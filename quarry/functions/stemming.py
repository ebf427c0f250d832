"""The English stemmer of the Snowball project ("Porter2"), for words of ASCII letters; others stay as they are."""

from __future__ import annotations

import re
from functools import lru_cache

_VOWELS = "aeiouy"
_REGION = re.compile(f"[{_VOWELS}][^{_VOWELS}]")
_SHORT = re.compile(f"(?:^[{_VOWELS}][^{_VOWELS}]|[^{_VOWELS}][{_VOWELS}][^{_VOWELS}wxY])$")
_VOWEL = re.compile(f"[{_VOWELS}]")

# The published lists of irregular words, beginnings and suffixes.
_WHOLE = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
_WHOLE |= {w: w for w in ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes")}
_AFTER_PLURAL = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_BEGINNINGS = ("gener", "commun", "arsen")
_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_BEFORE_LI = "cdeghkmnrt"
_STEP2 = {"tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": ""}
_STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
_STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion"]


_VERBAL, _ENDS2, _ENDS3, _ENDS4 = (tuple(sorted(x, key=len, reverse=True)) for x in (("eed", "eedly", "ed", "edly", "ing", "ingly"), _STEP2, _STEP3, _STEP4))


def _longest(word: str, suffixes: tuple[str, ...]) -> str | None:
    """The first of ``suffixes`` (the longest ones come first) that ends the word."""
    return next(s for s in suffixes if word.endswith(s)) if word.endswith(suffixes) else None


def _after(word: str, at: int) -> int:
    """Where the region behind the first consonant behind a vowel begins."""
    found = _REGION.search(word, at)
    return found.end() if found else len(word)


def _marked(word: str) -> str:
    """A y that stands for a consonant becomes Y: at the start and behind a vowel."""
    if "y" not in word:
        return word
    out = ""
    for c in word:
        out += "Y" if c == "y" and (not out or out[-1] in _VOWELS) else c
    return out


def _verb(w: str, r1: int) -> str:
    end = _longest(w, _VERBAL)
    if end in ("eed", "eedly"):
        return w[: -len(end)] + "ee" if len(w) - len(end) >= r1 else w
    if end is None or not _VOWEL.search(w[: -len(end)]):
        return w
    w = w[: -len(end)]
    if w.endswith(("at", "bl", "iz")):
        return w + "e"
    if w.endswith(_DOUBLES):
        return w[:-1]
    return w + "e" if r1 >= len(w) and _SHORT.search(w) else w


@lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    if len(word) < 3 or not word.isascii() or not word.isalpha():
        return word
    if word in _WHOLE:
        return _WHOLE[word]
    w = _marked(word)
    begins = _longest_start(w)
    r1 = len(begins) if begins else _after(w, 0)
    r2 = _after(w, r1)
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and _VOWEL.search(w[:-2]):
        w = w[:-1]
    if w in _AFTER_PLURAL:
        return w
    w = _verb(w, r1)
    if w[-1] in "yY" and len(w) > 2 and w[-2] not in _VOWELS:
        w = w[:-1] + "i"
    end = _longest(w, _ENDS2)
    if end and len(w) - len(end) >= r1 and (end != "ogi" or w[-4:-3] == "l") and (end != "li" or w[-3:-2] in tuple(_BEFORE_LI)):
        w = w[: -len(end)] + _STEP2[end]
    end = _longest(w, _ENDS3)
    if end and len(w) - len(end) >= (r2 if end == "ative" else r1):
        w = w[: -len(end)] + _STEP3[end]
    end = _longest(w, _ENDS4)
    if end and len(w) - len(end) >= r2 and (end != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(end)]
    if w.endswith("e") and (len(w) > r2 or (len(w) > r1 and not _SHORT.search(w[:-1]))):
        w = w[:-1]
    elif w.endswith("ll") and len(w) > r2:
        w = w[:-1]
    return w.lower()


def _longest_start(w: str) -> str | None:
    return next((b for b in _BEGINNINGS if w.startswith(b)), None)
